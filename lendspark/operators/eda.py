"""Exploratory queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Per class: n, pct, and the ratio of the larger class to it."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row a class
    return counts.select(target, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(whole), 4).alias("pct"), F.round(F.max("n").over(whole) / F.col("n"), 4).alias("imbalance"))


def class_histogram(df: DataFrame, target: str, features: Sequence[str], bins: int = 30) -> DataFrame:
    """feature, class, bin (1 to ``bins``), n, density: equal bins between each feature's extremes."""
    rows = df.select(F.col(target).alias("class"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["class"], list(features), "feature", "value")
    rows = rows.where("value is not null and not isnan(value)")
    ends = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = rows.join(F.broadcast(ends), "feature")  # one row a feature
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col("value") - F.col("lo")) / width) + 1)).otherwise(1)
    counts = rows.groupBy("feature", "class", bin_.cast("int").alias("bin"), width.alias("width")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature", "class"))
    return counts.select("feature", "class", "bin", "n", F.when(F.col("width") > 0, F.col("n") / (total * F.col("width"))).alias("density"))


#: Columns of a block of the correlation matrix.
BLOCK = 64
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _pair_sums(df: DataFrame, columns: Sequence[str], middle: Sequence[float]) -> DataFrame:
    """(i, j, n, sa, sb, saa, sbb, sab): sums over the rows where columns i <= j are both present, less ``middle``.

    A task multiplies blocks of its rows with blocks of columns and hands on
    one buffer a block pair; these are added up pair by pair.
    """
    wide, center = len(columns), np.array(middle)
    schema = "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)
    blocks = [(a, b) for a in range(0, wide, BLOCK) for b in range(a, wide, BLOCK)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(wide)]).astype(float) - center
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            for a, b in blocks:
                xa, xb, ta, tb = x[:, a : a + BLOCK], x[:, b : b + BLOCK], there[:, a : a + BLOCK], there[:, b : b + BLOCK]
                part = np.stack([ta.T @ tb, xa.T @ tb, ta.T @ xb, (xa * xa).T @ tb, ta.T @ (xb * xb), xa.T @ xb])
                total[a, b] = total[a, b] + part if (a, b) in total else part
        for (a, b), part in total.items():
            i, j = (v.ravel() for v in np.mgrid[a : a + part.shape[1], b : b + part.shape[2]])
            keep = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *(pa.array(p.ravel()[keep]) for p in part)], ["i", "j", *_SUMS])

    parts = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(sums, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr for each pair of columns, over the rows where both are present (null and NaN count as absent).

    The driver sees a mean a column; the matrix comes from products of blocks
    of columns and stays a distributed table. Null where a column is constant
    or fewer than two rows have both.
    """
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    s = _pair_sums(df, columns, [m or 0.0 for m in means])
    names = F.array(*map(F.lit, columns))
    va, vb = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n") for c in "ab")
    same = F.col("i") == F.col("j")
    flat = (F.col("n") < 2) | (va <= 1e-12 * F.col("saa")) | (vb <= 1e-12 * F.col("sbb"))
    corr = F.when(flat, None).when(same, 1.0).otherwise((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    return s.where("n > 0").select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), corr.alias("corr"))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` features by absolute correlation with the target."""
    row = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c) for c in columns])
    return row.unpivot([], list(columns), "feature", "abs_corr").where("abs_corr is not null").orderBy(F.desc("abs_corr"), "feature").limit(top)


def default_rate_by_category(df: DataFrame, features: Sequence[str], target: str, more_than: int = 100) -> DataFrame:
    """feature, category, default_rate, n of categories with more rows than that."""
    rows = df.select(F.col(target).cast("double").alias("__y"), *[F.col(c).cast("string").alias(c) for c in features]).unpivot(["__y"], list(features), "feature", "category")
    out = rows.groupBy("feature", "category").agg(F.round(F.avg("__y"), 6).alias("default_rate"), F.count("*").alias("n"))
    return out.where(F.col("n") > more_than).orderBy("feature", F.desc("default_rate"))
