"""Grouping of spelling variants by asymmetric q-chunks.

One word of a pair is cut into two disjoint chunks, of length q = L // 2 and
L - q; the other gives its positional grams of these lengths. One inserted,
deleted or replaced sign leaves one chunk whole: the first stays in its place,
the second moves by the difference of the lengths, one at most. So a word of
L signs gives two keys, and grams are given for words of L - 1, L and L + 1
signs at the places that one edit leaves. Words meet in equal keys, and each
pair is verified.

What is left of the two words around a common chunk is a pair of the same
kind. So where many words share a chunk, what is left of them is cut and
joined in turn (``refined``), until few share all of it or a single sign is
left, and no group is paired as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, scratch, written

RUN = r"[A-Za-zÀ-ÿ]"
#: One (document, run) in so many loses a sign.
SLIPS = 199
#: Words that may share a chunk before what is left of them is cut again.
SHARED = 64
#: Distinct words that a task gathers before it hands their counts on.
GATHERED = 200_000


def corpus_words(docs: DataFrame, least_length: int = 6, slips: int = SLIPS) -> DataFrame:
    """(word, n): lower-cased runs of letters and how often they occur, by task; sum them.

    The run of a document whose CRC of ``<doc_id>:<run>`` the number of slips
    divides loses one sign, everywhere in that document. A null doc_id counts
    as an empty one, a null text as none.
    """
    find = re.compile(f"{RUN}{{{least_length},}}").findall  # shorter runs give no word

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in source:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter(find(text.lower().decode()))  # bytes.lower touches A to Z only
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % slips == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
                if len(total) >= GATHERED:
                    yield out()
        yield out()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batches, "word string, n long")


def _part(text: str, start: Column, length: Column) -> Column:
    return F.substring(F.col(text), start + 1, length)


def _keys(parts: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Rows (key, rest) of (length of the chunked word, number of the chunk, chunk, what is left)."""
    return F.inline(F.array(*[F.struct(F.xxhash64("key", size, no, chunk).alias("key"), rest.alias("rest")) for size, no, chunk, rest in parts]))


def chunked(rows: DataFrame) -> DataFrame:
    """(word, key, rest) -> the same, a row for each of the two chunks of the rest."""
    size = F.char_length("rest")
    q = F.floor(size / 2).cast("int")
    parts = [(size, F.lit(0), _part("rest", F.lit(0), q), _part("rest", q, size - q)), (size, F.lit(1), _part("rest", q, size - q), _part("rest", F.lit(0), q))]
    return rows.select("word", _keys(parts))


def grams(rows: DataFrame) -> DataFrame:
    """(word, n, shift, key, rest) -> the same, a row for each gram that may be a chunk of a word shorter by ``shift``."""
    length = F.char_length("rest")
    size = length - F.col("shift")
    q = F.floor(size / 2).cast("int")
    second = q + F.col("shift")  # the place of the second chunk
    parts = [(size, F.lit(0), _part("rest", F.lit(0), q), _part("rest", q, length - q)), (size, F.lit(1), _part("rest", second, length - second), _part("rest", F.lit(0), second))]
    return rows.where(size > 0).select("word", "n", "shift", _keys(parts))


def refined(left: DataFrame, right: DataFrame, shared: int = SHARED) -> DataFrame:
    """(word, other, n): candidate pairs; n is that of ``other``. A pair may come twice."""
    found = None
    while True:
        left = written(left, "chunks")
        # A rest of one sign or none can't be cut: such words differ in that sign only.
        crowded = left.where(F.char_length("rest") > 1).groupBy("key").count().where(F.col("count") > shared).select("key")
        crowded = few(written(crowded, "crowded"))
        last = crowded.isEmpty()
        here, there = (left, right) if last else (left.join(crowded, "key", "left_anti"), right.join(crowded, "key", "left_anti"))
        pairs = here.select("word", "key").join(there.select(F.col("word").alias("other"), "n", "key"), "key").select("word", "other", "n")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        left = chunked(left.join(crowded, "key", "left_semi"))
        right = written(grams(right.join(crowded, "key", "left_semi")), "grams")


def near_words(words: DataFrame, shared: int = SHARED) -> DataFrame:
    """(word, other, n): pairs of words (word, n) that one edit makes equal, in both directions; n is that of ``other``."""
    start = words.select("word", F.lit(0).cast("long").alias("key"), F.col("word").alias("rest"))
    left = chunked(start)
    right = grams(words.select("word", "n", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"), F.lit(0).cast("long").alias("key"), F.col("word").alias("rest")))
    pairs = refined(left, right, shared).where(F.levenshtein("word", "other", 1) == 1)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends.

    A form is more frequent than its word by a factor, so chains end, and
    doubling the steps reaches their ends in a few rounds.
    """
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("from"), F.col("root").alias("to"))
        if known.join(further, known["root"] == further["from"], "left_semi").isEmpty():
            return known
        known = written(known.join(further, known["root"] == further["from"], "left").select("word", F.coalesce("to", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, factor: int = 5, shared: int = SHARED) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text).

    Words have ``least_length`` code points and ``least_n`` occurrences or
    more. n_near counts the words one edit away; form is the most frequent of
    them (of equals the smallest in code-point order) if it is at least
    ``factor`` times as frequent, else null; root is where forms end. Empty
    tables, null and empty texts give no words; repeated rows count each.
    """
    with scratch(keep := []):
        words = corpus_words(docs, least_length).groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_n) & (F.char_length("word") >= least_length))
        words = written(words, "words")
        near = near_words(words, shared).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("by"), "other")).alias("best"))
        strong = -F.col("best.by") >= factor * F.col("n")
        linked = words.join(near, "word", "left").select(
            "word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.by")).alias("form_n")
        )
        linked = written(linked, "linked")
        ends = roots(linked.where("form is not null"))
        out = linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        keep.append(out := written(out, "variants"))
    return out
