"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard depends on its key and the number of shards alone. No ring or
table is kept, and when shards are appended a row either stays or moves to a
new shard. Both steps are DataFrame expressions; assigning needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free_name, written

#: Fixed values of the published algorithm's generator and of its arithmetic.
MULTIPLIER = 2862933555777941757
TWO_64 = 2**64


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to ``shards`` - 1, of a whole-number key.

    The 64-bit products wrap; as Spark's bigint raises on overflow, they are
    taken as decimals of up to 38 digits, which hold them exactly. A null key
    counts as 0. A jump lands at least one shard further, so ``shards`` steps
    always suffice; those after the last jump change nothing.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    two_64 = F.lit(str(TWO_64)).cast("decimal(20,0)")
    k = F.when(k < 0, (k + two_64).cast("decimal(20,0)")).otherwise(k)
    start = F.struct(k.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(acc: Column, _: Column) -> Column:
        product = (acc["k"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)")
        k = (product.cast("decimal(38,0)") % two_64).cast("decimal(20,0)")
        r = F.floor(k / F.lit(str(2**33)).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        j = F.floor((acc["j"].cast("double") + 1.0) * (F.lit(float(2**31)) / r))
        nxt = F.struct(k.alias("k"), acc["j"].alias("b"), j.cast("long").alias("j"))
        return F.when(acc["j"] < shards, nxt).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, jump, lambda acc: acc["b"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with column ``out``; with ``grown``, also the shard under one more."""
    df = df.withColumn(out, jump_hash(F.col(key), shards))
    return df.withColumn(grown, jump_hash(F.col(key), shards + 1)) if grown else df


def number_slots(df: DataFrame, key: str, shard: str = "shard", out: str = "slot", ties: tuple[str, ...] = ()) -> DataFrame:
    """Numbers the rows of each shard from 0, without gaps, by key and ``ties``.

    A shard may hold any number of rows, so no task sorts a whole shard: rows
    are cut into ranges of shard, key and ties by sampled quantiles, whatever
    the keys are; each range is numbered on its own, and a prefix sum over the
    ranges' row counts adds the offset. A null key comes first; rows equal in
    key and ties get their numbers in any order, and many of them fall into
    several ranges. The ranges are written once, as a second sampling might cut
    elsewhere. Columns of ``df`` called like ``out`` are replaced.
    """
    order = [shard, key, *ties]
    any_, at, range_, s, r, n, first, before_ = (free_name(f"__{x}", df) for x in ("any", "at", "range", "s", "r", "n", "first", "before"))
    rows = df.drop(out).withColumn(any_, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, any_).sortWithinPartitions(*order, any_)
    # The number of the range, and under its lowest 33 bits the row's place in it.
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()).drop(any_), "ranges")
    rows = rows.withColumn(range_, F.shiftright(at, 33))
    sizes = rows.groupBy(F.col(shard).alias(s), F.col(range_).alias(r)).agg(F.count("*").alias(n), F.min(at).alias(first))
    before = Window.partitionBy(s).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(s, r, first, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(before_))
    # As many rows as tasks, and one more for each shard that begins within a range.
    rows = rows.join(F.broadcast(sizes), (F.col(shard) == F.col(s)) & (F.col(range_) == F.col(r)))
    return rows.withColumn(out, F.col(before_) + F.col(at) - F.col(first)).select(*columns(df.drop(out)), out)
