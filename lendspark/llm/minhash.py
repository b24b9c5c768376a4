"""Near-duplicate detection by MinHash, banding, checks on full sets, components.

Documents with the same set of shingles form a class; only one of a class goes
on. Minima of many universal hashes are cut into bands; classes that agree in a
band share a bucket. In a bucket each class is compared with the smallest one
first; components of the confirmed links then tell which comparisons are still
open: pairs in one bucket but in different components. Those are compared, all
of them in small buckets; the classes of large ones are joined exactly, by
prefixes of their full sets. So a group of thousands of copies costs about one
comparison a member and bucket, and not all pairs. Every link is confirmed on
the full sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few, let, written
from .components import components
from .textbytes import Prefix, mix

#: Buckets of up to so many classes are compared pair by pair.
SMALL = 8

#: Shingles of more sets than this are hot: sets aren't compared because they share one.
HOT = 64

#: Longs of the bitmaps that tell sets which can't share enough.
BITMAP = 8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, in order.

    A-Z are lower-cased. A text of fewer words has one shingle, its whole
    sequence; a null text or one without words has none.
    """
    coefficients = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(group[-1]) + 1
        if size < _CHUNK and k + 1 < len(texts):
            continue
        data = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(end) and space[0] and end[0] == 0:
            end = end[1:]
        w = Prefix(data).hashes(start, end)
        first = np.searchsorted(start, np.cumsum([0] + [len(g) + 1 for g in group]))
        n = len(w) - words + 1
        all_shingles = mix(sum(w[i : i + n] * coefficients[i] for i in range(words))) if n > 0 else w[:0]
        for a, z in zip(first[:-1], first[1:], strict=True):
            if z - a >= words:
                yield np.unique(all_shingles[a : z - words + 1])
            elif z > a:
                yield mix(np.array([int((w[a:z] * coefficients[: z - a]).sum()) & (2**64 - 1)], dtype=np.uint64) + np.uint64(z - a))
            else:
                yield w[:0]
        group, size = [], 0


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each hash function x -> a x + b modulo 2**64: the upper 32 bits of the minimum."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 256):
        v = shingles[k : k + 256, None] * a[None, :]
        v += b[None, :]
        np.minimum(least, v.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _bands(sig: np.ndarray, bands: int, rows: int) -> list[int]:
    """A hash of each band of minima and its number."""
    parts = sig.view(np.uint32).astype(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64).tolist()


def _sketch(sig: np.ndarray) -> list[int]:
    """The lowest four bits of each of the first 128 minima, in eight numbers."""
    low = np.zeros(128, dtype=np.uint8)
    low[: len(sig)] = (sig[:128] & 15).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).view(np.int64).tolist()


def signatures(docs: DataFrame, words: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """doc_id, size (of the set), node (name of the set; null if empty), keys (of its bands), low (sketch of its minima)."""
    a = mix(np.arange(seed, seed + bands * rows, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    b = mix(a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), words)
            out = [(len(s), _name(s), _bands(sig := signature(s, a, b), bands, rows), _sketch(sig)) if len(s) else (0, None, None, None) for s in sets]
            n, node, keys, low = zip(*out, strict=True) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "size": n, "node": node, "keys": keys, "low": low})

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {doc_type}, size long, node binary, keys array<long>, low array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, items): the full sets of all texts whose doc_ids ``nodes`` (node, doc_id) has.

    Other texts of those doc_ids come along, and repeated ones come repeatedly."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(_name(s), s.view(np.int64)) for s in shingle_sets(batch["text"].tolist(), words) if len(s)]
            yield pd.DataFrame(rows, columns=["node", "items"])

    ids = few(nodes.select(F.col("doc_id").cast(doc_type).alias("__id")).distinct())
    return docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").mapInPandas(run, "node binary, items array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets, of ``sets`` (node, items), are similar enough."""
    v = sets.select(F.col("node").alias("v"), F.col("items").alias("iv")).join(few(pairs), "v")
    u = sets.select(F.col("node").alias("u"), F.col("items").alias("iu")).join(few(pairs.select("u").distinct()), "u", "left_semi")
    both = F.size(F.array_intersect("iu", "iv"))
    return v.join(u, "u").where(100 * both >= percent * (F.size("iu") + F.size("iv") - both)).select("u", "v").distinct()


def _alike(a: Column, b: Column, percent: int, slack: float) -> Column:
    """Whether two classes (size, low) may be linked, by sizes and sketches.

    low holds four bits of each of 128 minima. At similarity s these agree
    with chance s + (1 - s) / 16; a pair at the threshold of 0.8 has more than
    ``slack`` = 0.2 less than that with a chance of about 3e-8.
    """

    def unlike(k: int) -> Column:  # how many of 16 minima differ
        x = a["low"][k].bitwiseXOR(b["low"][k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    differ = functools.reduce(lambda x, y: x + y, [unlike(k) for k in range(8)])
    most = int(128 * (1 - percent / 100 - (1 - percent / 100) / 16 + slack))
    return (100 * F.least(a["size"], b["size"]) >= percent * F.greatest(a["size"], b["size"])) & (differ <= most)


def _likely(pairs: DataFrame, members: DataFrame, percent: int, slack: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sizes and sketches allow a link."""
    info = lambda name: members.select(F.col("node").alias(name), F.struct("size", "low").alias(f"i{name}"))
    both = pairs.distinct().join(info("u"), "u").join(info("v"), "v")
    return both.where(_alike(F.col("iu"), F.col("iv"), percent, slack)).select("u", "v")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components in each bucket of ``rows`` (key, node, comp); buckets are small."""
    groups = rows.groupBy("key").agg(F.collect_list(F.struct("node", "comp")).alias("g"))
    x = groups.select("g", F.explode("g").alias("x"))
    y = x.select("x", F.explode(let(F.col("x"), lambda me: F.filter("g", lambda o: (o["node"] > me["node"]) & (o["comp"] != me["comp"])))).alias("y"))
    return y.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def _enough(shared: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of so many elements together that share so many are linked."""
    return (100 + percent) * shared >= percent * sizes


def _bits(item: str) -> list[Column]:
    """Aggregates: a bitmap of the elements, each setting one of 64 * BITMAP bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(item, 8), F.lit(64)).cast("int"))
    return [F.coalesce(F.bit_or(F.when(F.pmod(F.col(item), F.lit(BITMAP)) == k, bit)), F.lit(0).cast("long")).alias(f"b{k}") for k in range(BITMAP)]


def _lacks(a: Column, b: Column) -> Column:
    """At least so many elements of one set aren't in the other: a bit that only one bitmap has stands for one or more."""
    return functools.reduce(lambda x, y: x + y, [F.bit_count(a[f"b{k}"].bitwiseAND(F.bitwise_not(b[f"b{k}"]))) for k in range(BITMAP)])


def exact_pairs(sets: DataFrame, percent: int, hot: int) -> DataFrame:
    """Pairs (u, v) among which are all linked ones of different components that can't be told otherwise.

    ``sets`` has node, size, comp and items: size is that of the whole set, of
    which items may be a part that holds all that may be shared. Sets of sizes
    a and b are linked if they share need = percent / (100 + percent) * (a + b);
    that is at least percent of either size.

    Only shingles that occur in several components count, and sets that have
    enough of them. In more than ``hot`` sets they are hot, else cold; all are
    ranked from rare to frequent. Linked sets that share a cold shingle share
    one that has need - 1 shingles that count behind it in either set: were it
    not so, those that they share would be less than need. So the first cold
    shingles of each set are joined, none of which has many sets, and bitmaps
    tell more pairs that can't share enough.

    Linked sets that share hot shingles only have enough hot ones each. Those
    are grouped by their hot part: in a group, if any member is linked with
    the others by its hot part, it is so with the smallest one, and between two
    groups, linked members are linked with the smallest one of the other group.
    So distinct hot parts, with the sizes of their smallest members, are joined
    by this function itself. Where they are hardly fewer than their sets, that
    would not end, and all shingles count as cold.
    """
    spark = sets.sparkSession
    none = spark.createDataFrame([], sets.select(F.col("node").alias("u"), F.col("node").alias("v")).schema)
    if sets.limit(2).count() < 2:
        return none
    need = F.ceil(percent * F.col("size") / 100)
    tokens = sets.select("node", "size", "comp", F.explode("items").alias("item"))
    shared = tokens.groupBy("item").agg(F.count("*").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("item", "n")
    left = tokens.join(shared, "item").groupBy("node", "size", "comp").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("ranked"), *_bits("item"))
    left = written(left.where(F.size("ranked") >= need), "counting")
    prefix = F.filter(F.slice("ranked", F.lit(1), (F.size("ranked") - need + 1).cast("int")), lambda r: r["n"] <= hot)
    prefix = left.select(F.struct("node", "size", F.size("ranked").alias("left"), *[f"b{k}" for k in range(BITMAP)]).alias("x"), "comp", F.posexplode(prefix).alias("pos", "r"))
    row = lambda side: prefix.select(F.col("r.item").alias("item"), F.col("x").alias(side), F.col("comp").alias(f"c{side}"), F.col("pos").alias(f"p{side}"))
    sizes = F.col("x.size") + F.col("y.size")
    behind = lambda me: _enough(F.col(f"{me}.left") - F.col(f"p{me}"), sizes, percent)
    likely = lambda me, you: _enough(F.col(f"{me}.left") - _lacks(F.col(me), F.col(you)), sizes, percent)
    different = (F.col("x.node") < F.col("y.node")) & (F.col("cx") != F.col("cy"))
    met = row("x").join(row("y"), "item").where(different & behind("x") & behind("y") & likely("x", "y") & likely("y", "x"))
    out = met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    hots = F.array_sort(F.transform(F.filter("ranked", lambda r: r["n"] > hot), lambda r: r["item"]))
    parts = left.select("node", "size", "comp", need.alias("need"), hots.alias("hots"))
    # Groups of one hot part.
    mostly = parts.where(F.size("hots") >= F.col("need")).select("node", "size", "comp", "hots", F.concat(F.hex(F.xxhash64("hots")), F.lit("."), F.hex(F.xxhash64("hots", F.lit(1)))).alias("group"))
    groups = mostly.groupBy("group").agg(F.min(F.struct("size", "node", "comp")).alias("s"), F.first("hots").alias("hots"), F.count("*").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    groups = written(groups, "hot-groups")
    n, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not n_groups:
        return written(out.distinct(), "exact-pairs")
    mine = mostly.select("group", "node", "size", "comp").join(groups.select("group", "s", F.size("hots").alias("h")), "group")
    mine = mine.where((F.col("comp") != F.col("s.comp")) & _enough(F.col("h"), F.col("size") + F.col("s.size"), percent))
    out = out.unionByName(mine.select(F.col("s.node").alias("u"), F.col("node").alias("v")))
    # A group of several components may be linked with any other.
    whole = groups.select(F.col("group").alias("node"), F.col("s.size").alias("size"), F.when(F.col("c1") == F.col("c2"), F.col("c1")).otherwise(F.xxhash64("group")).alias("comp"), F.col("hots").alias("items"))
    between = exact_pairs(whole, percent, hot if 2 * n_groups <= n else max(hot, n_groups))
    side = lambda g: groups.select(F.col("group").alias(g), F.col("s").alias(f"s{g}"), F.col("hots").alias(f"h{g}"))
    between = between.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "sv", F.size(F.array_intersect("hu", "hv")).alias("o"))
    between = written(between.where(_enough(F.col("o"), F.col("su.size") + F.col("sv.size"), percent)), "group-pairs")
    ways = between.select(F.col("u").alias("group"), F.col("sv").alias("s"), "o").unionByName(between.select(F.col("v").alias("group"), F.col("su").alias("s"), "o"))
    across = mostly.select("group", "node", "size").join(ways, "group").where(_enough(F.col("o"), F.col("size") + F.col("s.size"), percent))
    out = out.unionByName(across.select(F.least("s.node", "node").alias("u"), F.greatest("s.node", "node").alias("v")))
    return written(out.distinct(), "exact-pairs")


def _open(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` (key, node) with comp and n, their buckets' sizes; without buckets that are in one component."""
    rows = rows.join(comps.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    buckets = rows.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 != c2").select("key", "n")
    return rows.join(buckets, "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, slack: float = 0.2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Two documents are linked if 100 times the size of their sets' intersection
    is at least ``percent`` times that of the union. component_id is the
    smallest doc_id that links reach, kept tells whether it is the row's own.
    Documents without words have an empty set and are linked with nothing;
    rows of one doc_id count each by its text. Null doc_ids can't be a
    component's name: a component of only such has a null one and keeps none.
    With 32 bands of 4 minima, a pair at similarity 0.8 has no common band with
    a chance of 5e-8.
    """
    sigs = written(signatures(docs, words, bands, rows), "signatures")
    classes = sigs.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("size", "keys", "low")])
    classes = written(classes, "classes")
    # Buckets of one class are most of them; only the sizes of buckets are shuffled to find the others.
    keyed = classes.select("node", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = written(keyed.join(several, "key", "left_semi").select("key", "node"), "buckets")
    members = buckets.select(F.col("node").alias("__node")).distinct()
    members = written(classes.drop("keys").join(members, F.col("node") == F.col("__node"), "left_semi"), "members")
    first = buckets.groupBy("key").agg(F.min("node").alias("first"))
    pairs = buckets.join(first, "key").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    tried = written(_likely(pairs, members, percent, slack), "pairs")
    ends = lambda pairs: pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    full = lambda nodes: written(_sets(docs, members.select("node", "doc_id").join(nodes, "node"), words), "sets")
    sets = full(ends(tried))
    links = written(_similar(tried, sets, percent), "links")
    discard(sets)
    comps = written(components(links), "components")
    # Linked sets differ in size by a quarter at most: buckets are split by size, each class going with the next.
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    still = buckets.join(members.select(F.col("node").alias("__node"), "size"), F.col("node") == F.col("__node"))
    still = still.select(F.explode(F.transform(F.array(size_class, size_class + 1), lambda k: F.xxhash64("key", k))).alias("key"), "node")
    still = written(_open(still, comps), "open")
    discard(buckets)
    pairs = written(_likely(_small_pairs(still.where(F.col("n") <= SMALL)), members, percent, slack).join(tried, ["u", "v"], "left_anti"), "pairs")
    # Classes of large buckets in which components still differ are joined exactly.
    large = still.where(F.col("n") > SMALL).select(F.col("node").alias("__node"), "comp").distinct()
    large = written(members.join(large, F.col("node") == F.col("__node")).select("node", "size", F.xxhash64("comp").alias("comp")), "large")
    sets = full(ends(pairs).unionByName(large.select("node")).distinct())
    if not large.isEmpty():
        big = written(sets.join(large, "node").dropDuplicates(["node"]), "large-sets")
        pairs = pairs.unionByName(exact_pairs(big, percent, HOT).join(tried, ["u", "v"], "left_anti")).distinct()
    more = written(_similar(written(pairs, "pairs"), sets, percent), "links")
    discard(sets)
    if not more.isEmpty():
        comps = written(components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more)), "components")
    linked = comps.join(members.select("node", F.col("doc_id").alias("d")), "node")
    names = linked.groupBy("comp").agg(F.min("d").alias("component"))
    named = linked.join(names, "comp").select("node", F.col("component"))
    # A class without links is a component of its own.
    named = classes.select("node", "doc_id").join(named.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", F.coalesce("component", "doc_id").alias("component_id"))
    out = sigs.select("doc_id", F.col("size").alias("n_shingles"), F.col("node").alias("own")).join(named, F.col("own") == F.col("node"), "left")
    component = F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
