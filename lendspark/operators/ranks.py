"""Running counts and exact quantiles of (feature, value) rows, without sorting a feature in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Sketches are exact to one rank in so many; brackets reach SLACK of all ranks to both sides of a quantile.
ACCURACY, SLACK = 20_000, 2e-4
#: Features of fewer values than that are counted whole: a bracket may be narrower than a rank there.
WHOLE = 20_000
#: The same for medians, of which a table has many.
MEDIAN_ACCURACY, MEDIAN_SLACK = 4_000, 1e-3
#: A round at the ninth digit moves an edge by less than that.
NEAR = 1e-8


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


_RUN = "feature string, value double, c0 long, c1 long, part int, w0 long, w1 long"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (feature, value, c0, c1) of a task, with the task's number and the sums of what stands before within the feature."""
    part, last, carry = TaskContext.get().partitionId(), None, np.zeros(2, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        feature = batch.column("feature").dictionary_encode()
        codes = feature.indices.to_numpy()
        counts = np.stack([batch.column(c).to_numpy() for c in ("c0", "c1")])
        before = np.cumsum(counts, axis=1) - counts
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        base = before[:, starts].copy()
        if feature[0].as_py() == last:
            base[:, 0] -= carry
        before -= np.repeat(base, np.diff(starts, append=len(codes)), axis=1)
        last, carry = feature[-1].as_py(), before[:, -1] + counts[:, -1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part), pa.int32()), *map(pa.array, before)], ["feature", "value", "c0", "c1", "part", "w0", "w1"])


def running_counts(rows: DataFrame, group: str, area: Scratch) -> DataFrame:
    """(feature, value, c0, c1, b0, b1, n0, n1): how often a value occurs in groups 0 and 1, how many smaller ones do, and the groups' sizes.

    Counted values are sorted by range over all tasks, summed up within each
    range, and written. One row of totals a task and feature then gives what
    lies before each range.
    """
    g = F.col(group)
    counts = rows.where(g.isin(0, 1)).groupBy("feature", "value").agg(F.count_if(g == 0).alias("c0"), F.count_if(g == 1).alias("c1"))
    local = area.written(counts.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").mapInArrow(_run, _RUN))
    totals = local.groupBy("feature", "part").agg(F.sum("c0").alias("p0"), F.sum("c1").alias("p1"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    offsets = totals.select("feature", "part", _zero(F.sum("p0").over(before)).alias("o0"), _zero(F.sum("p1").over(before)).alias("o1"), F.sum("p0").over(whole).alias("n0"), F.sum("p1").over(whole).alias("n1"))
    counts = local.join(F.broadcast(offsets), ["feature", "part"])  # one row a task and feature
    return counts.select("feature", "value", "c0", "c1", (F.col("o0") + F.col("w0")).alias("b0"), (F.col("o1") + F.col("w1")).alias("b1"), "n0", "n1")


def pick_quantiles(values: DataFrame, sizes: DataFrame, bins: int) -> dict[str, dict[int, float]]:
    """Linear quantiles 0 to ``bins`` by feature, of those whose ranks ``values`` has.

    ``values`` (feature, value, c, b): a value, how often it occurs and how
    many smaller ones do; ``sizes`` (feature, n): one row a feature.
    """
    rows = values.where("c > 0").join(F.broadcast(sizes), "feature")
    place = lambda k: k * (F.col("n") - 1) / bins
    holds = lambda rank: (rank >= F.col("b")) & (rank < F.col("b") + F.col("c"))
    hits = F.filter(F.sequence(F.lit(0), F.lit(bins)), lambda k: holds(F.floor(place(k))) | holds(F.ceil(place(k))))
    rows = rows.select("feature", "n", "value", "b", "c", F.explode(hits).alias("k"))
    low, high = F.max(F.when(holds(F.floor(place(F.col("k")))), F.col("value"))), F.max(F.when(holds(F.ceil(place(F.col("k")))), F.col("value")))
    at = rows.groupBy("feature", "n", "k").agg(low.alias("low"), high.alias("high"))
    rest = place(F.col("k")) - F.floor(place(F.col("k")))
    out: dict[str, dict[int, float]] = {}
    for r in at.select("feature", "k", (F.col("low") * (1 - rest) + F.col("high") * rest).alias("q")).where("q is not null").collect():
        out.setdefault(r["feature"], {})[r["k"]] = r["q"]
    return out


def _brackets(rows: DataFrame, bins: int) -> tuple[list[tuple[str, int]], dict[str, list[list[float]]]]:
    """By feature: the number of values, and disjoint intervals that hold the values at the wanted ranks."""
    at = [min(1.0, max(0.0, k / bins + side * SLACK)) for k in range(bins + 1) for side in (-1, 1)]
    sketch = rows.groupBy("feature").agg(F.count("*").alias("n"), F.percentile_approx("value", F.array(*map(F.lit, at)), ACCURACY).alias("at")).collect()
    found = {}
    for r in sketch:
        merged: list[list[float]] = [] if r["n"] >= WHOLE else [[float("-inf"), float("inf")]]
        for low, high in zip(r["at"][::2], r["at"][1::2], strict=True) if not merged else ():
            if merged and low - NEAR <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high + NEAR)
            else:
                merged.append([low - NEAR, high + NEAR])
        found[r["feature"]] = merged
    return [(r["feature"], r["n"]) for r in sketch], found


def quantile_counts(rows: DataFrame, group: str, bins: int, area: Scratch, first_only: bool = False) -> tuple[DataFrame, dict[str, list[float]]]:
    """(feature, value, c0, c1) and the exact linear quantiles 0 to ``bins`` of each feature.

    ``rows`` (feature, value, group) is read twice. A mergeable sketch of all
    rows (``first_only``: of those of group 0) brackets each quantile; then values within brackets are counted one by one, those
    between two brackets together, under the smallest of them: no quantile
    lies there. Should a rank lie outside its bracket, its feature is counted
    again as a whole.
    """
    g = F.col(group)
    rows = rows.where(g.isin(0, 1)).select("feature", "value", g.alias("g"))
    ends, brackets = _brackets(rows.where("g = 0") if first_only else rows, bins)
    spark, c = rows.sparkSession, F.col("c0") if first_only else F.col("c0") + F.col("c1")
    sizes = spark.createDataFrame(ends, "feature string, n long")
    while True:
        bounds = spark.createDataFrame([(f, [lo for lo, _ in b], [hi for _, hi in b]) for f, b in brackets.items()], "feature string, low array<double>, high array<double>")
        passed = [F.get("low", F.lit(i)) <= F.col("value") for i in range(bins + 1)] + [F.get("high", F.lit(i)) < F.col("value") for i in range(bins + 1)]
        slot = sum((F.when(p, 1).otherwise(0) for p in passed), F.lit(0))  # odd within a bracket
        placed = rows.join(F.broadcast(bounds), "feature").select("feature", "value", "g", slot.alias("slot"))  # one row a feature
        inside = F.when(F.col("slot") % 2 == 1, F.col("value"))
        counts = placed.groupBy("feature", "slot", inside.alias("one")).agg(F.min("value").alias("value"), F.count_if(F.col("g") == 0).alias("c0"), F.count_if(F.col("g") == 1).alias("c1"))
        counts = area.written(counts.drop("one"))
        slots = counts.groupBy("feature", "slot").agg(F.sum(c).alias("c"))
        before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        offsets = slots.select("feature", "slot", _zero(F.sum("c").over(before("feature", "slot"))).alias("o"))
        within = counts.where("slot % 2 = 1").join(F.broadcast(offsets), ["feature", "slot"])  # two rows a bin and feature
        within = within.select("feature", "value", c.alias("c"), (F.col("o") + _zero(F.sum(c).over(before("feature", "slot", "value")))).alias("b"))
        found = pick_quantiles(within, sizes, bins)
        missed = [f for f, _ in ends if len(found.get(f, ())) <= bins and brackets[f][0][0] != float("-inf")]
        if not missed:
            return counts.select("feature", "value", "c0", "c1"), {f: [found[f][k] for k in range(bins + 1)] for f in found}
        brackets |= {f: [[float("-inf"), float("inf")]] for f in missed}


def median_moments(df: DataFrame, names: Sequence[str], area: Scratch) -> dict[str, tuple[int, float, float, float]]:
    """By column: number of values, exact median, mean and sum of squared differences from it, in two readings of ``df``.

    Null and NaN are left out, and columns without values. One reading takes
    the moments and a sketch that brackets the median; the other counts what
    lies below each bracket as one value, what lies in it value by value.
    Should a median lie outside its bracket, its column is counted as a whole.
    """
    numbers = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(str(k)) for k, c in enumerate(names)])
    long = lambda wide: wide.unpivot([], wide.columns, "feature", "value").where("value is not null")
    at = F.percentile_approx("value", F.array(F.lit(0.5 - MEDIAN_SLACK), F.lit(0.5 + MEDIAN_SLACK)), MEDIAN_ACCURACY)
    sketch = {r["feature"]: r for r in long(numbers).groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), at.alias("at")).collect()}
    everything = (float("-inf"), float("inf"))
    brackets = {f: (r["at"][0] - NEAR, r["at"][1] + NEAR) if r["n"] >= WHOLE else everything for f, r in sketch.items()}
    medians: dict[str, float] = {}
    while brackets:
        inside = [F.when(F.col(f) < low, float("-inf")).when(F.col(f) <= high, F.col(f)).alias(f) for f, (low, high) in brackets.items()]
        counts = area.written(long(numbers.select(*inside)).groupBy("feature", "value").agg(F.count("*").alias("c")))
        before = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        sizes = df.sparkSession.createDataFrame([(f, sketch[f]["n"]) for f in brackets], "feature string, n long")
        found = pick_quantiles(counts.withColumn("b", _zero(F.sum("c").over(before))), sizes, 2)
        medians |= {f: found[f][1] for f, b in brackets.items() if 1 in found.get(f, ()) and (b == everything or found[f][1] > b[0])}
        brackets = {f: everything for f in brackets if f not in medians}
    return {names[int(f)]: (r["n"], medians[f], r["mean"], r["var"] * r["n"]) for f, r in sketch.items()}
