"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a share of the token budget by its weight, at most a given
number of epochs of itself (the excess goes to the others, by weight). Whole
epochs are taken first. The rest of a target is an Efraimidis-Spirakis sample:
every document draws an exponential key, divided by its quality weight, and
the documents with the smallest keys are taken until their prefix sum of words
comes nearest the rest. Keys are hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, uniform, written

#: Quality weights reach from this to 1. Ranges of keys are even for documents of this weight; others crowd at most four to one.
LEAST_WEIGHT = 0.25


def quality_weight(text: Column) -> Column:
    """0.25 to 1: how much of a text is letters, digits and white space."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", ""))
    return F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * plain / F.greatest(F.length(text), F.lit(1))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """One row (source, source_size, target) for each row (source, source_size).

    Sources in order of code points, null last, get ``weights`` in turn. The
    budget is ``share`` times all sizes. With caps of ``most_epochs`` times the
    size, resharing the excess until none is above its cap ends at one level L
    with target = least(cap, weight * L); sources are sorted by cap / weight
    and prefix sums find L. Sources of size 0 have target 0.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % n
    w = F.lit(float(weights[-1]))
    for k in range(n - 1):
        w = F.when(turn == k, float(weights[k])).otherwise(w)
    caps = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    above = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps = (
        caps.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.sum("w").over(above) <= F.col("left") * F.col("w"))
    )
    level = (F.first("budget").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(
        F.when(F.col("full"), 0.0).otherwise(F.col("w"))
    ).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    caps = caps.withColumn("open_w", open_w).withColumn("level", F.when(F.col("open_w") > 0, level))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("level")))
    return caps.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 17,
    buckets: int = 4096,
    size: Column | None = None,
    weight: Column | None = None,
    luck: Column | None = None,
) -> DataFrame:
    """The columns of ``docs`` but text, with size, source_size, target and taken.

    ``docs`` has doc_id, source and text, or ``size``, ``weight`` and ``luck``
    (a number in (0, 1) for each row) say what is to be known of the text.
    taken is size times the number of times the mix takes the document. A
    source's taken words miss its target by at most half of one document. A
    source may hold most rows, so its sampling order isn't sorted in one task:
    keys fall into ``buckets`` ranges, whose sizes are prefix-summed first, and
    rows are sorted and summed within a range. Null source: a source of its
    own. Null or empty text: size 0, taken 0. Rows equal in doc_id and text
    draw the same key and follow each other in any order. Columns of ``docs``
    that are called like a result are replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "size", "source_size", "target", "taken")]
    size = n_words("text") if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    luck = uniform(F.lit(seed), F.col("doc_id"), F.xxhash64("text")) if luck is None else luck
    key, b, s, c, n, t, before_, within_ = (free_name(f"__{x}", docs) for x in ("key", "b", "s", "c", "n", "t", "before", "within"))
    rows = docs.select(*names, size.cast("long").alias("size"), (-F.log(luck) / weight).alias(key))
    bucket = F.least(F.floor(F.lit(buckets) * (1 - F.exp(-F.col(key) * LEAST_WEIGHT))), F.lit(buckets - 1)).cast("int")
    # Texts are measured once; all that follows reads narrow rows.
    rows = written(rows.withColumn(b, bucket), "measured")
    ranges = rows.groupBy(F.col("source").alias(s), F.col(b).alias(c)).agg(F.sum("size").alias(n))
    targets = source_targets(ranges.groupBy(F.col(s).alias("source")).agg(F.sum(n).alias("source_size")), weights, share, most_epochs)
    before = Window.partitionBy(s).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(s, c, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(before_))
    targets = targets.withColumnRenamed("source", t)
    ranges = ranges.join(targets, F.col(s).eqNullSafe(F.col(t))).drop(t)
    within = Window.partitionBy("source", b).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(within_, F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col(s)) & (F.col(b) == F.col(c)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    chosen = (F.col(before_) + F.col(within_) + F.col("size") / 2 < rest).cast("long")
    taken = F.col("size") * (epochs + chosen)
    return rows.select(*names, "size", "source_size", "target", taken.cast("long").alias("taken"))
