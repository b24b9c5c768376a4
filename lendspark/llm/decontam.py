"""Benchmark decontamination by templates.

Documents and benchmark items are reduced to templates: numbers, names and
units become typed placeholders. Windows of template words are hash-joined, so
a question whose numbers or names were changed still meets its original. A pair
counts if enough of the item's windows lie in the document at one offset or at close ones, and
its slots are consistent: each value of the item stands for one value in the
document wherever it occurs. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

#: Placeholders and the end of a slot's value, from characters that texts are stripped of first.
NAME, NUMBER, UNIT, END = "\x01", "\x02", "\x03", "\x04"

#: Units of measure that may follow a number.
UNITS = "kg|g|mg|km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|l|ml|liters?|hours?|h|minutes?|min|seconds?|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|kw|w|v|hz"

#: Rows of the benchmark's window table up to which it is broadcast (40 bytes a row).
BROADCAST_ROWS = 500_000

#: A run of capitalised words, or of numbers, is one slot: "New York" may stand for "Paris", "1 000" for "900".
_NAME = r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}[\p{L}\p{M}]*+(?: \p{Lu}\p{Ll}[\p{L}\p{M}]*+)*+"
_NUMBER = r"\p{N}+(?:[., ]\p{N}+)*+"


def _marked(text: Column) -> Column:
    """The text with a placeholder before each slot's value, and its end marked."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x04]", " ")
    text = F.regexp_replace(text, _NAME, " \x01$0\x04 ")
    text = F.lower(F.regexp_replace(text, _NUMBER, " \x02$0\x04 "))
    return F.regexp_replace(text, rf"(?<=\p{{N}}\x04 )\s{{0,2}}({UNITS})(?![\p{{L}}\p{{M}}])", " \x03$1\x04 ")


def raw_tokens(text: Column) -> Column:
    """Words; the values of slots with their placeholder before them."""
    return F.regexp_extract_all(_marked(text), F.lit(r"[\x01-\x03][^\x04]*+|[\p{L}\p{M}]+"), F.lit(0))


def template(text: Column) -> Column:
    """Words, and placeholders alone in the slots."""
    return F.regexp_extract_all(F.regexp_replace(_marked(text), r"([\x01-\x03])[^\x04]*+\x04", "$1"), F.lit(r"[\x01-\x03]|[\p{L}\p{M}]+"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Words and numbers as they are, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{N}+(?:[.,]\p{N}+)*+|[\p{L}\p{M}]+"), F.lit(0))


def _windows(words: Column, lengths: list[int], salt: int = 0) -> Column:
    """(pos, w): hashes of all windows of so many words, by position from 0."""

    def of(h: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - n, F.lit(0)) + 1)
        windows = F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(h, i, n), F.lit(salt)).alias("w")))
        return F.when(F.size(h) >= n, windows).otherwise(F.expr("cast(array() as array<struct<pos: int, w: bigint>>)"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, n) for n in lengths]))


def _value(slot: Column, theirs: Column) -> Column:
    """The document's value in a slot; what the document has before the item's
    first word or behind its last one may have run together with it."""
    mine, all_ = F.substr(slot["r"], F.lit(2)), F.substr(theirs, F.lit(2))
    joined = (slot["first"] & F.endswith(all_, F.concat(F.lit(" "), mine))) | (slot["last"] & F.startswith(all_, F.concat(mine, F.lit(" "))))
    return F.when(joined, slot["r"]).otherwise(theirs)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 8, least: float = 0.5, shortest: int = 4) -> DataFrame:
    """Pairs doc_id, item_id, n_windows, coverage, n_slots, exact.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. coverage is
    the share of the item's windows of ``n`` template words that stand in the
    document in the same order and about the same distance (shifts of up to
    ``n`` words between neighbours), at least ``least``. n_slots counts
    the matched slots; exact tells that all have the item's own values. Pairs
    with inconsistent slots are left out. An item of under ``n`` template words
    would say too little as a template: it is compared word by word, values as
    they are, in windows of ``n`` words or as one window; one of under
    ``shortest`` words could come from anywhere and matches nothing.
    Items of equal templates are joined once, as one class, and told apart at
    the end. Null or empty texts match nothing. Rows equal in doc_id and text
    count as one document; a null doc_id is a doc_id like any other. A pair of
    ids has one row, its best match.
    """
    items = benchmark.select("item_id", template(F.col("text")).alias("words"), plain_words(F.col("text")).alias("plain"), raw_tokens(F.col("text")).alias("raw"))
    short = F.size("words") < n
    items = items.select("item_id", short.alias("short"), F.when(short, F.col("plain")).otherwise(F.col("words")).alias("words"), F.when(short, F.slice("raw", 1, 0)).otherwise(F.col("raw")).alias("raw"))
    items = written(items.where(F.size("words") >= shortest).withColumn("cls", F.xxhash64("short", "words")), "items")
    classes = items.groupBy("cls").agg(F.first("short").alias("short"), F.min_by("words", "item_id").alias("words"))
    classes = classes.withColumn("len", F.least(F.size("words"), F.lit(n))).withColumn("n_all", F.size("words") - F.col("len") + 1)
    # At most n different lengths.
    lengths = sorted(r["len"] for r in classes.where("short").select("len").distinct().collect())
    # A window of placeholders only says nothing.
    telling = lambda x: F.col("short") | F.exists(F.slice("words", x["pos"] + 1, n), lambda w: ~w.isin(NAME, NUMBER, UNIT))
    own = F.when(~F.col("short"), _windows(F.col("words"), [n]))
    for k in lengths:
        own = own.when(F.col("len") == k, _windows(F.col("words"), [k], 1))
    index = classes.select("cls", "n_all", F.inline(F.filter(own, telling)).alias("ipos", "w"))
    index = written(index, "item-windows")
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    key = ["doc_id", "h"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    windows = _windows(template(F.col("text")), [n])
    if lengths:
        windows = F.concat(windows, _windows(plain_words(F.col("text")), lengths, 1))
    windows = docs.select(*key, F.inline(windows))
    hits = windows.join(index, "w")
    pairs = hits.groupBy(*key, "cls", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"), F.first("n_all").alias("n_all"))
    # Shifts of one document that lie close together, as after inserted or dropped words, are one match.
    order = Window.partitionBy(*key, "cls").orderBy("shift")
    pairs = pairs.withColumn("far", F.coalesce((F.col("shift") - F.lag("shift").over(order) > n).cast("int"), F.lit(0)))
    pairs = pairs.withColumn("match", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The shifts with the most windows come first.
    part = F.struct((-F.size("at")).alias("rank"), "shift", "at")
    pairs = pairs.groupBy(*key, "cls", "match").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.first("n_all").alias("n_all"))
    pairs = pairs.withColumn("n_windows", F.size(F.array_distinct(F.flatten("parts.at"))).cast("long")).withColumn("coverage", F.col("n_windows") / F.col("n_all")).where(F.col("coverage") >= least)
    pairs = written(pairs, "pairs").join(items.select("cls", "item_id", "raw"), "cls")
    slots = F.filter(F.transform("raw", lambda r, i: F.struct(r.alias("r"), i.cast("int").alias("i"), (i == 0).alias("first"), (i == F.size("raw") - 1).alias("last"))), lambda x: F.substr(x["r"], F.lit(1), F.lit(1)).isin(NAME, NUMBER, UNIT))
    # Only slots in a matched window are compared, each at its first shift.
    holds = lambda x: lambda part: F.exists(part["at"], lambda p: (p <= x["i"]) & (x["i"] < p + n))
    placed = let(F.col("parts"), lambda parts: F.transform(slots, lambda x: F.struct(x["r"].alias("r"), (x["i"] + F.get(F.filter(parts, holds(x)), F.lit(0))["shift"]).alias("i"), x["first"].alias("first"), x["last"].alias("last"))))
    pairs = written(pairs.withColumn("slots", F.filter(placed, lambda x: x["i"].isNotNull())).drop("raw", "parts"), "pairs-slots")
    found = ["doc_id", "item_id", "n_windows", "coverage"]
    out = pairs.where(F.size("slots") == 0).select(*found, F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact"))
    slotted = pairs.where(F.size("slots") > 0)
    if not slotted.isEmpty():
        asked = slotted.select(F.col("doc_id").alias("d"), F.col("h").alias("k")).distinct()
        same = lambda d, k: F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("h") == F.col(k))
        texts = docs.join(asked, same("d", "k"), "left_semi").dropDuplicates(key).select(F.col("doc_id").alias("d"), F.col("h").alias("k"), raw_tokens(F.col("text")).alias("theirs"))
        both = slotted.join(texts, same("d", "k"))
        both = both.withColumn("both", let(F.col("theirs"), lambda t: F.transform("slots", lambda s: F.struct(s["r"].alias("a"), _value(s, F.get(t, s["i"])).alias("b")))))
        both = both.withColumn("both", F.filter("both", lambda x: x["b"].isNotNull()))
        values = F.size(F.array_distinct(F.transform("both", lambda x: x["a"])))
        exact = F.forall("both", lambda x: x["a"] == x["b"])
        both = both.where(values == F.size(F.array_distinct("both")))
        out = out.unionByName(both.select(*found, F.size("both").cast("long").alias("n_slots"), exact.alias("exact")))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("exact"), F.desc("n_windows"), "n_slots")
    return out.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
