"""Scoring of texts by an n-gram model with deleted interpolation.

Probabilities are maximum-likelihood estimates of all orders, mixed from the
longest context to the shortest and last with an even share for each token of
the vocabulary and one for unknown ones:

    P_k(w | h) = weight_k(bucket(c(h))) c(h w) / c(h) + (1 - weight) P_(k-1)(w | h')

The weight depends on the order and on how often the context occurred (by
powers of two). A tenth of the training texts, by hash of the text, is deleted
from the counts, and expectation-maximisation fits the weights to it; the
model then counts all training texts.

The counts of all n-grams are as large as the corpus and never in one place.
Texts are read in blocks of a few megabytes; a block sends its distinct
n-grams, with its own counts, to the shards that their hashes fall into; a
shard adds the counts up and answers each block in the order that it asked.
So every distinct n-gram of a block travels once, frequent n-grams are summed
up where they are read, and no task holds more than a block or a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

#: Bytes of text that a block holds (or one text, if that is longer) and that fall to a shard.
BLOCK_BYTES, SHARD_BYTES = 2 << 20, 8 << 20
#: One training text in so many is deleted from the counts to fit the weights.
DELETED = 10
#: Rounds of expectation-maximisation, unless no weight moves by more than this any more.
ROUNDS, STILL = 30, 1e-3
BUCKETS = 64

_END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word holds a space
_START = [np.uint64(xxhash.xxh64_intdigest(b" start %d" % k)) for k in range(16)]


# ── n-grams of a block ───────────────────────────────────────────────────────


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Tokens of some texts: words (lower-cased A to Z, cut at ASCII white space), and an end for each text."""

    def __init__(self, texts: pa.Array, order: int):
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # a copy: Arrow's ascii_lower misreads slices
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        real = pc.not_equal(words, "")
        words, doc = words.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)]
        names = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words.dictionary))
        n = len(texts)
        self.n_tokens = np.bincount(doc, minlength=n) + 1
        self.ends = np.cumsum(self.n_tokens) - 1
        self.doc = np.repeat(np.arange(n), self.n_tokens)
        token = np.empty(len(self.doc), dtype=np.uint64)
        token[self.ends] = _END
        token[np.arange(len(doc)) + doc] = names[words.indices.to_numpy()]
        self.starts = self.ends + 1 - self.n_tokens
        self.grams, self.place = [], []  # by order: the distinct n-grams in order, and where each token's is
        gram = token
        for k in range(order):
            if k:
                gram = _mixed(self.before(gram, _START[k]) * np.uint64(0x9E3779B97F4A7C15) + token)
            distinct, place = np.unique(gram, return_inverse=True)
            self.grams.append(distinct)
            self.place.append(place)

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """The value one token earlier; ``first`` at a text's start."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def counts(self, k: int, of: np.ndarray) -> np.ndarray:
        """How often the distinct n-grams of order k + 1 occur in the chosen texts."""
        return np.bincount(self.place[k][of[self.doc]], minlength=len(self.grams[k]))


def _pack(counts: np.ndarray) -> bytes:
    """Most counts are small: a byte each, and eight more for those of 255 and up."""
    return np.int32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, 4 + n)
    return out


def _names(grams: np.ndarray, k: int) -> bytes:
    """Words by 64 bits; within a shard the low 48 bits tell longer n-grams apart (two of 10**9 may be taken for one)."""
    return grams.tobytes() if k == 0 else grams.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _numbers(names: bytes, k: int) -> np.ndarray:
    if k == 0:
        return np.frombuffer(names, np.uint64)
    out = np.zeros((len(names) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(names, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Neighbouring rows (key, text, ...) of about BLOCK_BYTES of text, numbered by task and place."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // BLOCK_BYTES, prepend=0, append=-1))
        at = 0
        for cut in cuts:
            if cut > at or cut == batch.num_rows:
                yield number, batch.slice(at, cut - at)
                number, at = number + 1, cut


# ── counting ─────────────────────────────────────────────────────────────────

_SENT = "shard long, block long, k long, grams binary, kept binary, deleted binary"
_ANSWER = "block long, k long, shard long, part long, counts binary, sizes array<long>"
#: Parts of an answer: counts of all training texts; counts without the deleted ones, for the deleted texts' n-grams; sizes.
ALL, KEPT, SIZES = 0, 1, 2


def _answers(rows: DataFrame, order: int, shards: int) -> DataFrame:
    """Counts of each block's distinct n-grams; ``rows``: text, train, deleted."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _blocks(batches):
            block = Block(batch.column("text"), order)
            train, deleted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("train", "deleted"))
            out = []
            for k in range(order):
                grams, kept, gone = block.grams[k], block.counts(k, train & ~deleted), block.counts(k, train & deleted)
                shard = ((grams >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
                at = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
                for a, b in zip(at, [*at[1:], len(grams)], strict=True):
                    out.append((int(shard[a]), number, k, _names(grams[a:b], k), _pack(kept[a:b]), _pack(gone[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["shard", "block", "k", "grams", "kept", "deleted"])

    def add_up(group: pa.Table) -> pa.Table:
        out, shard = [], group.column("shard")[0].as_py()
        for k in range(order):
            rows = group.filter(pc.equal(group.column("k"), k)).to_pydict()
            kept, gone = [_unpack(x) for x in rows["kept"]], [_unpack(x) for x in rows["deleted"]]
            if not kept:
                continue
            distinct, place = np.unique(np.concatenate([_numbers(x, k) for x in rows["grams"]]), return_inverse=True)
            left = np.bincount(place, np.concatenate(kept), len(distinct)).astype(np.int64)
            every = left + np.bincount(place, np.concatenate(gone), len(distinct)).astype(np.int64)
            at = 0
            for block, own in zip(rows["block"], gone, strict=True):
                here = place[at : (at := at + len(own))]
                out.append((block, k, shard, ALL, _pack(every[here]), None))
                if own.any():
                    out.append((block, k, shard, KEPT, _pack(left[here[own > 0]]), None))
            if k == 0:
                out.append((-1, 0, shard, SIZES, None, [int(every.sum()), int((every > 0).sum()), int(left.sum()), int((left > 0).sum())]))
        names, types = zip(*(f.split() for f in _ANSWER.split(", ")), strict=True)
        kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        return pa.table([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))

    return rows.select("text", "train", "deleted").mapInArrow(send, _SENT).groupBy("shard").applyInArrow(add_up, _ANSWER)


def _looked_up(block: Block, answers: pa.Table, k: int) -> np.ndarray:
    """The count of each token's n-gram of order k + 1."""
    mine = answers.filter(pc.equal(answers.column("k"), k)).sort_by("shard")
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(x) for x in mine.column("counts").to_pylist())])
    if len(counts) != len(block.grams[k]):
        raise RuntimeError("the documents changed between two readings; write them to a table first")
    return counts[block.place[k]]


def _levels(block: Block, answers: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order: counts of each token's n-gram and of its context (empty for the first order)."""
    counts = [_looked_up(block, answers, k) for k in range(order)]
    texts = counts[0][block.ends[0]]  # each text has one end, and one start
    return [(c, np.zeros(0) if k == 0 else block.before(counts[k - 1], texts)) for k, c in enumerate(counts)]


def _bucket(context: np.ndarray) -> np.ndarray:
    """Floor of the binary logarithm; -1 for a context that never occurred."""
    return np.frexp(context.astype(float))[1] - 1


# ── weights ──────────────────────────────────────────────────────────────────


def deleted_counts(texts: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """(c0, c1, x1, b1, ..., n): n tokens of deleted texts whose n-grams and contexts have these counts elsewhere."""
    names = ["c0", *(f"{c}{k}" for k in range(1, order) for c in "cxb")]

    def tally(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts.column("text").combine_chunks(), order) if texts.num_rows else None
        levels = _levels(block, answers, order) if block else [(np.zeros(0), np.zeros(0))] * order
        columns = [levels[0][0], *(v for c, x in levels[1:] for v in (c, x, _bucket(x)))]
        rows = pa.table([pa.array(c.astype(np.int64)) for c in columns], names)
        return rows.group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "n"])

    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    parts = texts.groupBy("block").cogroup(answers.select("block", "k", "shard", "counts").groupBy("block")).applyInArrow(tally, schema)
    return parts.groupBy(*names).agg(F.sum("n").alias("n"))


def fit_weights(held: DataFrame, order: int, tokens: int, types: int) -> list[list[float]]:
    """Weights by order and bucket, by expectation-maximisation over ``deleted_counts``.

    A weak prior keeps weights between 0 and 1; buckets without data stay at a half.
    """
    weights = [[0.5] * (1 if k == 0 else BUCKETS) for k in range(order)]
    if not tokens:
        return weights
    for _ in range(ROUNDS):
        p, steps = F.lit(1.0 / (types + 1)), []
        rows = held
        for k in range(order):
            bucket = F.lit(0) if k == 0 else F.col(f"b{k}")
            weight = F.lit(weights[0][0]) if k == 0 else F.coalesce(F.get(F.array(*map(F.lit, weights[k])), bucket), F.lit(0.0))
            own = weight * F.col("c0") / float(tokens) if k == 0 else F.coalesce(weight * F.try_divide(f"c{k}", f"x{k}"), F.lit(0.0))
            rows = rows.withColumns({f"own{k}": own, f"p{k}": own + (1 - weight) * p})
            p = F.col(f"p{k}")
        reach = F.col("n").cast("double")
        for k in reversed(range(order)):  # how many tokens come down to an order, and how many of them it explains
            used = reach * F.col(f"own{k}") / F.col(f"p{k}")
            steps.append(F.struct(F.lit(k).alias("k"), (F.lit(0).cast("long") if k == 0 else F.col(f"b{k}")).alias("bucket"), used.alias("used"), reach.alias("reached")))
            reach = reach - used
        sums = rows.select(F.inline(F.array(*steps))).where("bucket >= 0").groupBy("k", "bucket").agg(F.sum("used").alias("used"), F.sum("reached").alias("reached")).collect()
        moved = 0.0
        for r in sums:
            new = (r["used"] + 1) / (r["reached"] + 2)
            moved = max(moved, abs(new - weights[r["k"]][r["bucket"]]))
            weights[r["k"]][r["bucket"]] = new
        if moved < STILL:
            break
    return weights


# ── scores ───────────────────────────────────────────────────────────────────


def score_texts(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    The model learns from the rows for which ``held_out`` isn't true (null:
    learns). score is the log10 probability of the whole text, its end
    included; base_score that of an add-one unigram model; n_known counts
    tokens that training has. Null and empty texts are an end only. Repeated
    rows count and are scored each. Without training text every token has
    probability 1.

    ``docs`` is read more than once and must give the same rows each time, as
    a table does.
    """
    train = ~F.coalesce(held_out, F.lit(False))
    gone = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(DELETED)) == 0  # copies share their part
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), train.alias("train"), gone.alias("deleted"))
    schema = f"block long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, train boolean, deleted boolean"

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number)), *batch.columns], ["block", *batch.schema.names])

    with scratch(keep := []):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        answers = written(_answers(rows, order, math.ceil(size / SHARD_BYTES) or 1), "counts")
        sizes = [r[0] or 0 for r in zip(answers.where(F.col("part") == SIZES).agg(*[F.sum(F.get("sizes", F.lit(i))) for i in range(4)]).first(), strict=True)]
        tokens, types, kept_tokens, kept_types = sizes
        texts = rows.mapInArrow(in_blocks, schema)
        held = written(deleted_counts(texts.where("train and deleted").select("block", "text"), answers.where(F.col("part") == KEPT), order), "deleted")
        weights = [np.array(w) for w in fit_weights(held, order, kept_tokens, kept_types)]

        def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
            block = Block(texts.column("text").combine_chunks(), order)
            levels = _levels(block, answers, order)
            p = np.full(len(block.doc), 1.0 / (types + 1))
            for k, (c, x) in enumerate(levels):
                if k == 0:
                    p = weights[0][0] * c / tokens + (1 - weights[0][0]) * p if tokens else p
                else:
                    weight = np.where(x > 0, weights[k][np.maximum(_bucket(x), 0)], 0.0)
                    p = weight * c / np.maximum(x, 1) + (1 - weight) * p
            n, c = texts.num_rows, levels[0][0]
            base = np.log10((c + 1) / (tokens + types + 1))
            columns = [
                texts.column("doc_id").combine_chunks(),
                pc.invert(texts.column("train")).combine_chunks(),
                pa.array(block.n_tokens, pa.int64()),
                pa.array(np.bincount(block.doc[c > 0], minlength=n), pa.int64()),
                pa.array(np.full(n, tokens), pa.int64()),
                pa.array(np.bincount(block.doc, base, n)),
                pa.array(np.bincount(block.doc, np.log10(p), n)),
            ]
            return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        asked = answers.where(F.col("part") == ALL).select("block", "k", "shard", "counts")
        scored = texts.drop("deleted").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, out)
        keep.append(scored := written(scored, "scores"))
    return scored
