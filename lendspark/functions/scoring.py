"""Scores, tiers, decisions and losses as column expressions, shared by batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers in order of risk, their upper bounds, loss given default, the mark of unemployment.
TIERS = ("Low Risk", "Medium Risk", "High Risk", "Very High Risk")
BOUNDS = (0.10, 0.20, 0.35)
LGD = 0.45
UNEMPLOYED = 365243


def ratio(num: str, den: str, otherwise: float) -> Column:
    """num / den where den is positive; a null or non-positive den gives ``otherwise``."""
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(float(otherwise)))


def mean_external(cols: Sequence[str]) -> Column:
    """Mean of external scores, a missing one counting 0.5."""
    total = F.coalesce(F.col(cols[0]), F.lit(0.5))
    for c in cols[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0.5))
    return total / float(len(cols))


def heuristic_pd(employment: bool = True, no_income: float = 5.0) -> Column:
    """Probability of default from debt ratio, external scores and employment.

    The streaming form has the employment term and takes a debt ratio of 5
    without income; the batch form has neither (``employment=False``, 0).
    """
    debt = ratio("AMT_CREDIT", "AMT_INCOME_TOTAL", no_income)
    score = F.lit(0.08) + F.when(debt > 5, 0.08).when(debt > 3, 0.04).otherwise(-0.02)
    score = score + (F.lit(0.5) - mean_external([f"EXT_SOURCE_{k}" for k in (1, 2, 3)])) * 0.3
    if employment:
        days = F.col("DAYS_EMPLOYED")
        score = score + F.when(days == UNEMPLOYED, 0.12).when(days > -365, 0.04).otherwise(-0.03)
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), score))


def risk_tier(pd: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """The tier of a PD; null and NaN are in the last."""
    tier = F.when(pd < bounds[0], TIERS[0])
    for bound, name in zip(bounds[1:], TIERS[1:], strict=False):
        tier = tier.when(pd < bound, name)
    return tier.otherwise(TIERS[-1])


def decision(tier: Column) -> Column:
    """What the tier means for the application."""
    return F.when(tier.isin(*TIERS[:2]), "APPROVE").when(tier == TIERS[2], "REVIEW").otherwise("REJECT")


def add_expected_loss(df: DataFrame, pd: str = "pd_score", ead: str = "AMT_CREDIT", lgd: float = LGD, out: str = "expected_loss") -> DataFrame:
    """Adds lgd, ead and their product with the PD."""
    return df.withColumns({"lgd": F.lit(float(lgd)), "ead": F.col(ead).cast("double")}).withColumn(out, F.col(pd) * F.col("lgd") * F.col("ead"))


def score_applications(df: DataFrame) -> DataFrame:
    """The stateless scoring of a stream: pd_score, risk_tier, decision, expected_loss."""
    df = df.withColumn("pd_score", heuristic_pd())
    df = df.withColumn("risk_tier", risk_tier(F.col("pd_score")))
    return df.withColumns({"decision": decision(F.col("risk_tier")), "expected_loss": F.round(F.col("pd_score") * LGD * F.col("AMT_CREDIT"), 2)})


def score_book(df: DataFrame) -> DataFrame:
    """Batch scoring with the streaming heuristic: pd_score, risk_tier, lgd, ead, expected_loss."""
    df = df.withColumn("pd_score", heuristic_pd())
    return add_expected_loss(df.withColumn("risk_tier", risk_tier(F.col("pd_score"))))
