"""Ratio features and column choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import UNEMPLOYED, mean_external, ratio


def add_domain_features(df: DataFrame) -> DataFrame:
    """Adds each ratio feature whose inputs ``df`` has."""
    have = set(df.columns)
    age, work = F.col("DAYS_BIRTH") if "DAYS_BIRTH" in have else None, "DAYS_EMPLOYED"
    new: dict[str, Column] = {}
    for name, num, den, otherwise, factor in (
        ("FEAT_DEBT_INCOME_RATIO", "AMT_CREDIT", "AMT_INCOME_TOTAL", 0.0, 1),
        ("FEAT_ANNUITY_INCOME_RATIO", "AMT_ANNUITY", "AMT_INCOME_TOTAL", 0.0, 12),
        ("FEAT_CREDIT_GOODS_RATIO", "AMT_CREDIT", "AMT_GOODS_PRICE", 1.0, 1),
        ("FEAT_CREDIT_TERM", "AMT_CREDIT", "AMT_ANNUITY", 0.0, 1),
    ):
        if {num, den} <= have:
            new[name] = ratio(num, den, otherwise) if factor == 1 else F.when(F.col(den) > 0, F.col(num) * factor / F.col(den)).otherwise(otherwise)
    if age is not None and work in have:
        new["FEAT_EMPLOYMENT_RATIO"] = F.when((age < 0) & (F.col(work) != UNEMPLOYED), F.col(work) / age).otherwise(0.0)
    if external := [c for c in ("EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3") if c in have]:
        new["FEAT_EXT_SOURCE_MEAN"] = mean_external(external)
    return df.withColumns(new) if new else df


def null_rates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """feature, n_null, null_rate, kept for every column, in one pass. Kept: rate below the threshold."""
    counts = df.select(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.unpivot("__n", df.columns, "feature", "n_null")
    rate = F.when(F.col("__n") > 0, F.col("n_null") / F.col("__n"))
    return long.select("feature", "n_null", rate.alias("null_rate"), F.coalesce(rate < threshold, F.lit(False)).alias("kept"))


def feature_columns(df: DataFrame, target: str, ids: tuple[str, ...], threshold: float = 0.5) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns with few nulls, in order of the schema."""
    kept = {r["feature"] for r in null_rates(df, threshold).where("kept").collect()}
    fields = [f for f in df.schema.fields if f.name in kept and f.name != target and f.name not in ids]
    return [f.name for f in fields if isinstance(f.dataType, T.NumericType)], [f.name for f in fields if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame, most: int = 20) -> DataFrame:
    """feature, n_distinct of the string columns with 2 to ``most`` values; null counts as one.

    A first reading sketches the number of values of all columns and leaves
    out those that surely have more than ``most`` (a sketch of few values is
    off by a few per cent; the margin is a factor of two). A second one
    gathers the few values of the others: one row, no row times columns.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    empty = df.sparkSession.createDataFrame([], "feature string, n_distinct long")
    if not names:
        return empty
    about = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"n{k}") for k, c in enumerate(names)]).first()
    few = [c for k, c in enumerate(names) if about[k] <= 2 * most + 10]
    if not few:
        return empty
    counts = df.agg(*[(F.size(F.collect_set(col(c))) + F.coalesce(F.max(col(c).isNull().cast("int")), F.lit(0))).cast("long").alias(c) for c in few])
    return counts.unpivot([], few, "feature", "n_distinct").where((F.col("n_distinct") > 1) & (F.col("n_distinct") <= most))


def add_class_weights(df: DataFrame, target: str, out: str = "class_weight") -> DataFrame:
    """Adds n / (2 n_class) of the row's class; 1 if a class is empty."""
    n = df.agg(F.count_if(F.col(target) == 1).alias("__pos"), F.count_if(F.col(target) == 0).alias("__neg"), F.count("*").alias("__all"))
    weight = F.when((F.col("__pos") == 0) | (F.col("__neg") == 0), 1.0).otherwise(F.col("__all") / (2 * F.when(F.col(target) == 1, F.col("__pos")).otherwise(F.col("__neg"))))
    # One row of totals is all that is broadcast.
    return df.crossJoin(F.broadcast(n)).withColumn(out, weight).drop("__pos", "__neg", "__all")


def key_digest(key: str, seed: int = 42) -> Column:
    """A number from 0 up to 2**32 that the key's text and the seed decide: digits of an MD5 digest, which any SQL engine gives alike.

    A null key counts as an empty text.
    """
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, key: str, parts: tuple[int, ...] = (70, 15, 15), seed: int = 42, out: str = "split") -> DataFrame:
    """Adds the number of a part, by digest of the key: stable under any partitioning, and in other engines."""
    bucket = F.shiftright(key_digest(key, seed) * sum(parts), 32)
    value = F.lit(len(parts) - 1)
    for k in range(len(parts) - 2, -1, -1):
        value = F.when(bucket < sum(parts[: k + 1]), k).otherwise(value)
    return df.withColumn(out, value)


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """The rows whose key's digest lies in the first ``fraction`` of all digests: the same rows in every run."""
    return df.where(key_digest(key, seed) < round(fraction * 2**32))
