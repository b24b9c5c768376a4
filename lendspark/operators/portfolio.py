"""Portfolio metrics, segmentation and stress tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import TIERS

#: Fixed values: (name, PD multiplier, LGD multiplier).
SCENARIOS = (("baseline", 1.0, 1.0), ("mild_recession", 1.5, 1.1), ("severe", 2.5, 1.3), ("black_swan", 4.0, 1.5))


def _tiers(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, t) for k, t in enumerate(TIERS)], "tier_order int, risk_tier string")


def el_band(rate: Column) -> Column:
    """How healthy a portfolio's loss rate (a share of EAD) is. The bands."""
    return F.when(rate < 0.01, "very healthy").when(rate < 0.03, "healthy").when(rate < 0.05, "moderate").when(rate < 0.10, "elevated").otherwise("high")


def overview(df: DataFrame, target: str | None = "TARGET") -> DataFrame:
    """One row: counts, sums, rates, the band of the loss rate, and the capital estimate."""
    actual = F.avg(target) if target else F.lit(0.0)
    row = df.agg(
        F.count("*").alias("total_customers"),
        F.coalesce(F.sum("ead"), F.lit(0.0)).alias("total_ead"),
        F.coalesce(F.sum("expected_loss"), F.lit(0.0)).alias("total_expected_loss"),
        F.coalesce(F.avg("pd_score"), F.lit(0.0)).alias("avg_pd"),
        F.coalesce(F.avg("lgd"), F.lit(0.45)).alias("avg_lgd"),
        F.coalesce(actual, F.lit(0.0)).alias("actual_default_rate"),
    )
    row = row.withColumn("el_rate", F.when(F.col("total_ead") > 0, F.col("total_expected_loss") / F.col("total_ead")).otherwise(0.0))
    return row.withColumns({"el_band": el_band(F.col("el_rate")), "unexpected_loss": 3 * F.col("total_expected_loss"), "economic_capital": 4.5 * F.col("total_expected_loss")})


def _by_tier(df: DataFrame) -> DataFrame:
    """One row for each tier, in order; the counts of absent ones are null."""
    counts = df.groupBy("risk_tier").agg(F.count("*").alias("count"), F.sum("ead").alias("ead"), F.sum("expected_loss").alias("el"), F.avg("pd_score").alias("pd"))
    rows = _tiers(df).join(counts, "risk_tier", "left")
    return rows.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("n_all"))))


def segmentation(df: DataFrame) -> DataFrame:
    """tier_order, risk_tier, count, pct of all tiers."""
    n = F.coalesce("count", F.lit(0))
    return _by_tier(df).select("tier_order", "risk_tier", n.cast("long").alias("count"), F.coalesce(F.round(n * 100.0 / F.col("n_all"), 2), F.lit(0.0)).alias("pct"))


def tier_breakdown(df: DataFrame) -> DataFrame:
    """Per tier: count, pct_customers, ead_m, el_m, el_rate_pct, avg_pd; absent tiers with zeros."""
    n, ead, el = F.coalesce("count", F.lit(0)), F.coalesce("ead", F.lit(0.0)), F.coalesce("el", F.lit(0.0))
    return _by_tier(df).select(
        "tier_order",
        "risk_tier",
        n.cast("long").alias("count"),
        F.coalesce(F.round(n * 100.0 / F.col("n_all"), 2), F.lit(0.0)).alias("pct_customers"),
        F.round(ead / 1e6, 2).alias("ead_m"),
        F.round(el / 1e6, 2).alias("el_m"),
        F.when(ead > 0, F.round(el / ead * 100, 2)).otherwise(0.0).alias("el_rate_pct"),
        F.coalesce(F.round("pd", 4), F.lit(0.0)).alias("avg_pd"),
    )


def tier_profile(df: DataFrame) -> DataFrame:
    """Per tier that occurs: count, mean PD, expected loss; by mean PD."""
    out = df.groupBy("risk_tier").agg(F.count("*").alias("n"), F.round(F.avg("pd_score"), 4).alias("avg_pd"), F.round(F.sum("expected_loss"), 0).alias("total_el"))
    return out.orderBy("avg_pd")


def scenarios_from(config: Mapping[str, Mapping]) -> list[tuple[str, float, float]]:
    """Scenarios of a configuration: name -> pd_multiplier and lgd_multiplier, each 1 if absent, in its order."""
    return [(name, float(given.get("pd_multiplier", 1.0)), float(given.get("lgd_multiplier", 1.0))) for name, given in config.items()]


def scenario_table(df: DataFrame, scenarios: Sequence[tuple[str, float, float]] = SCENARIOS) -> DataFrame:
    """The scenarios as rows: a configuration of a few."""
    rows = [(k, *s) for k, s in enumerate(scenarios)]
    return df.sparkSession.createDataFrame(rows, "scenario_order int, scenario string, pd_multiplier double, lgd_multiplier double")


def stressed(df: DataFrame, scenarios: Sequence[tuple[str, float, float]] = SCENARIOS, drop_null_pd: bool = False) -> DataFrame:
    """Each row under each scenario: stressed_pd, stressed_lgd, stressed_el.

    Both are cut at 1. A null PD is stressed to 1, as the smaller of null and 1;
    ``drop_null_pd`` leaves such rows out.
    """
    rows = df.where(F.col("pd_score").isNotNull()) if drop_null_pd else df
    rows = rows.crossJoin(F.broadcast(scenario_table(df, scenarios)))
    rows = rows.withColumns({"stressed_pd": F.least(F.lit(1.0), F.col("pd_score") * F.col("pd_multiplier")), "stressed_lgd": F.least(F.lit(1.0), F.col("lgd") * F.col("lgd_multiplier"))})
    return rows.withColumn("stressed_el", F.col("stressed_pd") * F.col("stressed_lgd") * F.col("ead"))


def stress_test(df: DataFrame, scenarios: Sequence[tuple[str, float, float]] = SCENARIOS) -> DataFrame:
    """Per scenario, in one pass over ``df``: sums, rates, customers at risk, capital."""
    keys = ["scenario_order", "scenario", "pd_multiplier", "lgd_multiplier"]
    out = stressed(df, scenarios).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("ead"), F.lit(0.0)).alias("total_ead"),
        F.coalesce(F.sum("stressed_el"), F.lit(0.0)).alias("total_el"),
        F.coalesce(F.avg("stressed_pd"), F.lit(0.0)).alias("avg_pd"),
        F.coalesce(F.avg("stressed_lgd"), F.lit(0.0)).alias("avg_lgd"),
        F.count_if(F.col("stressed_pd") >= 0.20).alias("customers_high_risk"),
        F.count_if(F.col("stressed_pd") >= 0.50).alias("customers_default_zone"),
    )
    rate = F.when(F.col("total_ead") > 0, F.col("total_el") / F.col("total_ead") * 100).otherwise(0.0)
    return out.withColumns({"el_rate_pct": rate, "capital_required": 3 * F.col("total_el")})


def stress_comparison(results: DataFrame) -> DataFrame:
    """scenario, el_ratio and added_loss_m against the baseline; empty without one, or if it is 0."""
    base = results.where((F.col("scenario") == "baseline") & (F.col("total_el") > 0)).select(F.col("total_el").alias("__base")).limit(1)
    others = results.where("scenario != 'baseline'").crossJoin(F.broadcast(base))
    return others.select("scenario", F.round(F.col("total_el") / F.col("__base"), 2).alias("el_ratio"), F.round((F.col("total_el") - F.col("__base")) / 1e6, 2).alias("added_loss_m"))
