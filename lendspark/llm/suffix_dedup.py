"""Removal of repeated strings by suffix arrays over shards.

Every window of ``length`` bytes chooses the smallest of the hashes of its
``gram``-byte strings as its anchor; equal windows choose equal anchors. A
document is thus cut into runs of windows that share an anchor, and equal
windows meet by joining on anchors. Runs of equal bytes are settled by their
hashes. Different runs with one anchor go to shards, where a suffix array by
induced sorting and its permuted common prefixes tell the equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .suffixes import common_prefixes, suffix_array
from .textbytes import BASE2, Prefix

_CHUNK = 1 << 19
_PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)

#: Windows' places around the anchor that a run is cut into; narrower where an
#: anchor has more than HOT_RUNS different runs.
BLOCK, HOT_BLOCK, HOT_RUNS = 34, 4, 2048

#: One of so many documents is looked at for frequent anchors: those with at
#: least FREQUENT runs there, the MOST_FREQUENT of them at most, have their runs
#: dealt over SALTS groups, equal ones over COPY_SALTS. Which anchors these are
#: changes the work's shares and no result.
LOOKED_AT, FREQUENT, MOST_FREQUENT, SALTS, COPY_SALTS = 64, 64, 10_000, 256, 32

#: Runs in a shard, about.
SHARD_RUNS = 20_000


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _runs(data: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows of texts joined in ``data``; ``first`` has their starts and the end.

    (text, first window, last window, anchor's place, anchor hash, run hash)."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    at = np.arange(len(data) - gram + 1)
    hashes = Prefix(data, BASE2).hashes(at, at + gram)
    place = _sliding_min(hashes & ~_PLACE | at.astype(np.uint64), length - gram + 1) & _PLACE
    windows = np.arange(len(place))
    text = np.searchsorted(first, windows, side="right") - 1
    whole = windows + length <= first[text + 1]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(place)) - 1
    good = whole[start]
    start, stop = start[good], stop[good]
    anchor = place[start].astype(np.int64)
    own = Prefix(data).hashes(start, stop + length)
    return text[start], start, stop, anchor, hashes[anchor].view(np.int64), own.view(np.int64)


def _find_runs(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_bytes(t) for t in batch["text"]]
            did, th = batch["did"].to_numpy(), batch["th"].to_numpy()
            pieces: list[tuple[int, int, bytes]] = []
            for k, b in enumerate(texts):
                pieces += [(k, a, b[a : a + _PIECE + length - 1]) for a in range(0, max(1, len(b) - length + 1), _PIECE)]
            group: list[tuple[int, int, bytes]] = []
            size = 0
            for n, piece in enumerate(pieces):
                group.append(piece)
                size += len(piece[2])
                if size < _CHUNK and n + 1 < len(pieces):
                    continue
                data = np.frombuffer(b"".join(p[2] for p in group), dtype=np.uint8)
                first = np.cumsum([0] + [len(p[2]) for p in group])
                text, lo, hi, anchor, a, seg = _runs(data, first, length, gram)
                doc = np.array([p[0] for p in group])[text] if len(text) else text
                shift = (np.array([p[1] for p in group])[text] - first[text]) if len(text) else text
                yield pd.DataFrame({"did": did[doc], "th": th[doc], "a": a, "seg": seg, "lo": lo + shift, "hi": hi + shift, "at": anchor + shift})
                group, size = [], 0

    return run


def _cut(length: int):
    """Cuts runs by their windows' places around the anchor, a block of places at
    a time. All windows of a block hold the same bytes at the same places, the
    block's core, as do all equal windows; its hash is the new key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for did, th, text, runs in batch[["did", "th", "text", "runs"]].itertuples(index=False):
                data = _bytes(text)
                for r in runs:
                    lo, hi, at, block = r["lo"], r["hi"], r["at"], HOT_BLOCK if r["hot"] else BLOCK
                    for j in range((at - hi) // block, (at - lo) // block + 1):
                        w1, w2, c = max(lo, at - block * j - block + 1), min(hi, at - block * j), at - block * j
                        key = hashlib.blake2b(data[c : c + length - block + 1] + j.to_bytes(4, "little"), digest_size=8).digest()
                        out.append((int.from_bytes(key, "little", signed=True), did, th, w1, w2, data[w1 : w2 + length]))
            yield pd.DataFrame(out, columns=["a", "did", "th", "lo", "hi", "b"])

    return run


def _repeats(length: int):
    """Of the runs of one shard: the windows whose bytes an earlier window has."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates(["a", "did", "th", "lo"]).sort_values(["did", "th", "lo"], kind="stable")
        parts = shard["b"].tolist()
        first = np.cumsum([0] + [len(p) + 1 for p in parts])
        # Runs follow each other in order of document and place, each ended by symbol 1; 0 ends all.
        t = np.ones(first[-1] + 1, dtype=np.int64)
        t[-1] = 0
        body = np.ones(len(t), dtype=bool)
        body[first[1:] - 1] = False
        body[-1] = False
        t[body] = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64) + 2
        sa = suffix_array(t, 258)
        equal = common_prefixes(t, sa)[sa] >= length
        text = np.searchsorted(first, sa, side="right") - 1
        text = np.minimum(text, len(parts) - 1)
        whole = sa + length <= first[text + 1] - 1
        cluster = np.cumsum(~equal)
        sa, text, cluster = sa[whole], text[whole], cluster[whole]
        order = np.lexsort((sa, cluster))
        sa, text, cluster = sa[order], text[order], cluster[order]
        again = np.zeros(len(sa), dtype=bool)
        again[1:] = cluster[1:] == cluster[:-1]
        sa, text = sa[again], text[again]
        order = np.argsort(sa)
        sa, text = sa[order], text[order]
        new = np.ones(len(sa), dtype=bool)
        new[1:] = (np.diff(sa) > 1) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(sa)) - 1 if len(sa) else start
        k = text[start]
        lo = shard["lo"].to_numpy()[k] + sa[start] - first[k]
        hi = lo + (sa[stop] - sa[start]) + length if len(sa) else lo
        return pd.DataFrame({"did": shard["did"].to_numpy()[k], "th": shard["th"].to_numpy()[k], "lo": lo, "hi": hi})

    return run


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in batch[["text", "spans"]].itertuples(index=False):
            data = _bytes(text)
            kept, removed, n, end = [], 0, 0, 0
            starts = sorted((s["lo"], s["hi"]) for s in spans) if spans is not None else []
            k = 0
            while k < len(starts):
                lo, hi = starts[k]
                while k < len(starts) and starts[k][0] <= hi:
                    hi = max(hi, starts[k][1])
                    k += 1
                kept.append(data[end:lo])
                removed, n, end = removed + hi - lo, n + 1, hi
            kept.append(data[end:])
            out.append((len(data), removed, n, b"".join(kept)))
        n_bytes, n_removed, n_spans, rest = zip(*out, strict=True) if out else ((), (), (), ())
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "kept": rest})


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for each row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``length`` bytes covers it that also
    starts earlier: in a row of smaller doc_id, or earlier in the same text.
    Strings are judged on the input. Null texts are empty; a null doc_id is
    the smallest. Rows equal in doc_id and text count as one document and lose
    the same bytes; other rows of one doc_id are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    long = rows.where(F.octet_length("text") >= length).select("did", "th", "text")
    find = lambda texts: texts.mapInPandas(_find_runs(length, gram), "did long, th long, a long, seg long, lo long, hi long, at long")
    some = long.where(F.pmod(F.xxhash64("did", "th", F.lit("looked-at")), F.lit(LOOKED_AT)) == 0)
    frequent = find(some).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n")).limit(MOST_FREQUENT)
    runs = find(long).join(F.broadcast(frequent.select("a", F.lit(True).alias("often"))), "a", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    salt = F.pmod(F.xxhash64("seg", F.pmod(F.xxhash64("did", "th"), F.lit(COPY_SALTS))), F.lit(SALTS))
    runs = runs.withColumn("salt", F.when(F.col("often"), salt).otherwise(F.lit(0)))
    # A frequent anchor's groups don't see each other; so all of them count as repeated, of several kinds and hot.
    same_a = Window.partitionBy("a", "salt")
    runs = runs.withColumns({"n": F.count("*").over(same_a), "s1": F.min("seg").over(same_a), "s2": F.max("seg").over(same_a)}).where("often or n > 1")
    place = F.struct("did", "th", "lo")
    ordered = Window.partitionBy("a", "salt", "seg").orderBy("did", "th", "lo")
    runs = runs.withColumn("first", F.first(place).over(ordered) == place)
    runs = runs.select("did", "th", "a", "salt", "often", "lo", "hi", "at", "first", (F.col("often") | (F.col("s1") != F.col("s2"))).alias("many"))
    runs = runs.withColumn("hot", F.col("often") | (F.count_if("first").over(same_a) > HOT_RUNS)).drop("salt", "often")
    runs = written(runs, "repeated-runs")
    spans = runs.where(~F.col("first")).select("did", "th", "lo", (F.col("hi") + length).alias("hi"))
    # Bytes of the first run of each kind, where an anchor has several kinds.
    asked = runs.where("first and many").groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi", "at", "hot")).alias("runs"))
    asked = asked.withColumnsRenamed({"did": "d", "th": "h"})
    texts = rows.where(F.octet_length("text") >= length).join(asked, (F.col("did") == F.col("d")) & (F.col("th") == F.col("h")))
    parts = texts.select("did", "th", "text", "runs").mapInPandas(_cut(length), "a long, did long, th long, lo long, hi long, b binary")
    same = Window.partitionBy("a", "b").orderBy("did", "th", "lo")
    parts = written(parts.withColumn("first", F.first(place).over(same) == place), "cut-runs")
    spans = spans.unionByName(parts.where(~F.col("first")).select("did", "th", "lo", (F.col("hi") + length).alias("hi")))
    shared = parts.where("first").withColumn("n", F.count("*").over(Window.partitionBy("a"))).where("n > 1")
    cool = written(shared.select("a", "did", "th", "lo", "hi", "b"), "shard-runs")
    shards = max(1, -(-cool.count() // SHARD_RUNS))
    shard = F.pmod(F.xxhash64("a"), F.lit(shards))
    found = cool.groupBy(shard.alias("shard")).applyInPandas(lambda pdf: _repeats(length)(pdf), "did long, th long, lo long, hi long")
    spans = spans.unionByName(found).groupBy("did", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = spans.withColumnsRenamed({"did": "d", "th": "h"})
    out = rows.join(spans, (F.col("did") == F.col("d")) & (F.col("th") == F.col("h")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInPandas(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
