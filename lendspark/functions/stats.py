"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p value of a distance."""
    lam = d * F.sqrt(n * m / (n + m))
    ks = F.sequence(F.lit(1), F.lit(60))
    high = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    low = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(-F.pow(2.0 * k - 1, F.lit(2.0)) * (math.pi**2) / (8 * lam * lam)))
    p = F.when(lam <= 0, 1.0).when(lam < 1, 1 - F.sqrt(F.lit(2 * math.pi)) / lam * low).otherwise(high)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def chi2_1_tail(x: Column) -> Column:
    """Upper tail of the chi-square law with one degree of freedom: erfc(sqrt(x / 2)).

    A series serves small arguments, a continued fraction, taken from its
    inside out, large ones; both are exact to about 1e-12 of the value.
    """
    z = F.sqrt(x / 2)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("t"), z.alias("s")),
        lambda acc, k: F.struct((acc["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * z * z / (2 * k + 1)).alias("s")),
        lambda acc: acc["s"],
    )
    small = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * terms
    tail = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda acc, k: z + k / 2.0 / acc)
    large = F.exp(-z * z) / (F.lit(math.sqrt(math.pi)) * tail)
    return F.when(x <= 0, 1.0).when(z < 2.5, small).otherwise(large)
