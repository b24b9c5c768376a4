"""Nearest neighbours by vantage-point trees, one tree for each shard.

On unit vectors, Euclidean distance orders pairs as cosine does and obeys the
triangle inequality. Shards are balls around pivots; a query goes to the shards
that the inequality doesn't rule out. A tree splits a shard's points by their
distance from a vantage point; a search skips a side that the inequality rules
out. ``relax`` shrinks the margin that it must keep: 1 is exact, less is faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 64
_EPS = 1e-7

#: Vectors of the sample that bounds the queries' distances, at most, and how
#: many of them are pivots of shards, at most.
SAMPLE, PIVOTS = 8192, 2048


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest part to 0.5 to 1: no
    digit changes, and no product of two parts overflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = scaled(vectors)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    q, x = scaled(q), scaled(x)
    return np.einsum("ij,ij->i", q, x) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def build(points: np.ndarray, rows: np.ndarray) -> tuple:
    """A leaf ("leaf", rows) or a node (vantage row, radius, inner, outer)."""
    if len(rows) <= LEAF:
        return ("leaf", rows)
    vantage, rest = rows[0], rows[1:]
    d = np.sqrt(np.maximum(0, 2 - 2 * (points[rest] @ points[vantage])))
    radius = np.median(d)
    inner = d <= radius
    if inner.all():  # ties: no ball tells these points apart
        return ("leaf", rows)
    return (vantage, radius, build(points, rest[inner]), build(points, rest[~inner]))


def search(tree: tuple, points: np.ndarray, queries: np.ndarray, k: int, relax: float, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays (query rows, point rows) that hold each query's k nearest,
    and all points that tie with the last of them. All queries go down the tree
    together, so each node is met once or twice: first every query goes to the
    one leaf that it lies in, which bounds its k-th distance, as ``bound`` does
    from the start; then that bound, as it shrinks, prunes sides."""
    bound = bound.copy()
    best = np.full((len(queries), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distances(qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return _distances(queries[qs], points[rows])

    def home(node: tuple, qs: np.ndarray) -> None:
        if not len(qs):
            return
        if isinstance(node[0], str):
            d = distances(qs, node[1][:1024])
            if d.shape[1] >= k:
                bound[qs] = np.minimum(bound[qs], np.partition(d, k - 1, axis=1)[:, k - 1])
            return
        vantage, radius, inner, outer = node
        inside = distances(qs, np.array([vantage]))[:, 0] <= radius
        home(inner, qs[inside])
        home(outer, qs[~inside])

    def take(qs: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        near = d <= bound[qs][:, None] + _EPS
        i, j = np.nonzero(near)
        if not len(i):
            return
        found.append((qs[i], rows[j], d[i, j]))
        hit = np.flatnonzero(near.any(axis=1))
        both = np.concatenate([best[qs[hit]], d[hit]], axis=1)
        best[qs[hit]] = np.partition(both, k - 1, axis=1)[:, :k]
        bound[qs[hit]] = np.minimum(bound[qs[hit]], best[qs[hit], k - 1])

    def down(node: tuple, qs: np.ndarray) -> None:
        if not len(qs):
            return
        if isinstance(node[0], str):
            for a in range(0, len(node[1]), 1024):  # a leaf of ties may be large
                take(qs, node[1][a : a + 1024], distances(qs, node[1][a : a + 1024]))
            return
        vantage, radius, inner, outer = node
        d = distances(qs, np.array([vantage]))
        take(qs, np.array([vantage]), d)
        d = d[:, 0]
        down(inner, qs[d - radius <= relax * bound[qs] + _EPS])
        down(outer, qs[radius - d <= relax * bound[qs] + _EPS])

    home(tree, np.arange(len(queries)))
    down(tree, np.arange(len(queries)))
    worst = bound
    for qs, rows, d in found:
        keep = d <= worst[qs] + _EPS
        yield qs[keep], rows[keep]


class Shard:
    """The tree of one shard's candidates (uid, vec_id, v)."""

    def __init__(self, candidates: pd.DataFrame):
        candidates = candidates.sort_values(["vec_id", "uid"], kind="stable")
        self.ids, self.uids = candidates["vec_id"].to_numpy(), candidates["uid"].to_numpy()
        self.x = _matrix(candidates["v"])
        self.kinds, kind = np.unique(self.x, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        self.order = np.argsort(kind, kind="stable")
        self.starts = np.searchsorted(kind[self.order], np.arange(len(self.kinds) + 1))
        self.points = unit(self.kinds)
        self.tree = build(self.points, np.random.default_rng(len(self.points)).permutation(len(self.points)))

    def nearest(self, queries: pd.DataFrame, k: int, relax: float) -> pd.DataFrame:
        q, q_ids, q_uids = _matrix(queries["v"]), queries["vec_id"].to_numpy(), queries["uid"].to_numpy()
        # One more, as the query itself may be among the points.
        found = list(search(self.tree, self.points, unit(q), k + 1, relax, queries["bound"].to_numpy()))
        qs, rows = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        n = self.starts[rows + 1] - self.starts[rows]
        qi = np.repeat(qs, n)
        xi = self.order[np.repeat(self.starts[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        other = self.uids[xi] != q_uids[qi]
        qi, xi = qi[other], xi[other]
        out = pd.DataFrame({"query": q_uids[qi], "query_id": q_ids[qi], "uid": self.uids[xi], "vec_id": self.ids[xi], "score": cosine(q[qi], self.x[xi])})
        out = out.sort_values(["query", "score", "vec_id", "uid"], ascending=[True, False, True, True], kind="stable")
        return out[out.groupby("query").cumcount() < k]


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64)


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """Few rows of one length at a time, as each meets the whole sample: 256 rows, 16 MB of distances."""
    for dim, rows in batch.groupby("dim"):
        for a in range(0, len(rows), 256):
            yield dim, rows.iloc[a : a + 256]


def _searched(k: int, relax: float):
    """Of rows sorted by shard, candidates first: a tree of the candidates, which
    then the queries meet a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts, shard = None, [], None
        for batch in batches:
            for own, rows in batch.groupby(["dim", "shard", "part"], sort=True):
                if own != key:
                    key, parts, shard = own, [], None
                queries = rows["bound"].notna()
                if not queries.all():
                    parts.append(rows.loc[~queries, ["uid", "vec_id", "v"]])
                if queries.any() and parts:
                    shard = shard or Shard(pd.concat(parts))
                    yield shard.nearest(rows[queries], k, relax)

    return run


def _placed(sample: dict[int, np.ndarray], pivots: dict[int, int], k: int):
    """Adds shard (of the nearest pivot), gap (its distance), bound (that of the
    (k + 1)-th nearest vector of the sample: no farther is the k-th neighbour)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in _chunks(batch):
                d = _distances(unit(_matrix(rows["v"])), sample[dim])
                own = d[:, : pivots[dim]].argmin(axis=1)
                bound = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(d), np.inf)
                yield rows.assign(shard=own, gap=d[np.arange(len(d)), own], bound=bound)

    return run


def _routed(sample: dict[int, np.ndarray], radii: dict[int, tuple[np.ndarray, np.ndarray]], relax: float):
    """Each query once for every shard, and part of it, that may hold a neighbour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in _chunks(batch):
                radius, parts = radii[dim]
                near = _distances(unit(_matrix(rows["v"])), sample[dim][: len(radius)]) - radius <= relax * rows["bound"].to_numpy()[:, None] + _EPS
                near[np.arange(len(rows)), rows["shard"].to_numpy()] = True  # its own shard, however small the factor
                i, shard = np.nonzero(near & (parts > 0))
                n = parts[shard]
                i, shard = np.repeat(i, n), np.repeat(shard, n)
                part = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(i), 10_000):
                    z = slice(a, a + 10_000)
                    yield rows.iloc[i[z]].assign(shard=shard[z], part=part[z])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, relax: float = 1.0, shard_rows: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest cosine for each
    row of ``vectors`` (vec_id, embedding) that ``is_query`` (a column) holds for.

    The row itself is no candidate; ties go to the smaller vec_id; with fewer
    candidates, all come. Null, empty and zero vectors and those with null or
    non-finite parts take no part; vectors of another length aren't compared.
    Rows of one vec_id are rows like any others: each is a candidate of the
    others, and each that is a query has its own ranks.

    Candidates go to the shard of their nearest pivot, and shards of more than
    ``shard_rows`` rows are dealt into parts; of equal vectors only as many go
    as can be found. Pivots come from a sample of at most ``SAMPLE`` vectors of
    each length, which also bounds how far a query's neighbours may be. A task
    holds one part of a shard, and its queries by batches.
    """
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).withColumns({"dim": F.size("v"), "uid": F.monotonically_increasing_id()})
    v = written(v, "vectors")
    counts = {r["dim"]: r["n"] for r in v.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    luck = F.pmod(F.xxhash64("uid", F.lit("sample")), F.lit(1_000_000))
    most = F.coalesce(*[F.when(F.col("dim") == d, F.lit(1_000_000 * SAMPLE // n + 1)) for d, n in counts.items()], F.lit(0))
    drawn = v.where(luck < most).select("dim", "v", F.row_number().over(Window.partitionBy("dim").orderBy(luck, "uid")).alias("r")).where(F.col("r") <= SAMPLE)
    vectors_of: dict[int, list] = {d: [] for d in counts}
    for r in drawn.orderBy("dim", "r").collect():
        vectors_of[r["dim"]].append(r["v"])
    sample = {d: unit(np.array(x, dtype=np.float64)) for d, x in vectors_of.items() if x}
    pivots = {d: min(PIVOTS, len(sample[d]), -(-n // shard_rows)) for d, n in counts.items()}
    kind = vectors.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, v array<double>, q boolean, dim int, uid long"
    placed = written(v.mapInPandas(_placed(sample, pivots, k), f"{columns}, shard long, gap double, bound double"), "placed")
    # Of equal vectors, the k + 1 smallest ids are enough: one may be the query's own.
    same = Window.partitionBy("v").orderBy("vec_id", "uid")
    candidates = placed.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    candidates = written(candidates.select("uid", "vec_id", "v", "dim", "shard", "gap"), "candidates")
    radii = {d: (np.zeros(p), np.zeros(p, dtype=np.int64)) for d, p in pivots.items()}
    for r in candidates.groupBy("dim", "shard").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():
        radius, parts = radii[r["dim"]]
        radius[r["shard"]], parts[r["shard"]] = r["radius"], -(-r["n"] // shard_rows)
    queries = placed.where("q").mapInPandas(_routed(sample, radii, relax), f"{columns}, shard long, gap double, bound double, part long")
    many = F.coalesce(*[F.when((F.col("dim") == d) & (F.col("shard") == s), F.lit(int(n))) for d, (_, parts) in radii.items() for s, n in enumerate(parts) if n > 1], F.lit(1))
    deal = F.pmod(F.xxhash64("uid", F.lit(1)), many)
    rows = candidates.select("uid", "vec_id", "v", "dim", "shard", deal.alias("part"), F.lit(None).cast("double").alias("bound"))
    rows = rows.unionByName(queries.select("uid", "vec_id", "v", "dim", "shard", "part", "bound"))
    total = max(1, sum(int(parts.sum()) for _, parts in radii.values()))
    rows = rows.repartition(total, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.col("bound").isNotNull())
    found = rows.mapInPandas(_searched(k, relax), f"query long, query_id {kind}, uid long, vec_id {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
