"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame. ``run`` applies them to the documents table; the
stages may also be run one by one with a written table between them.

Stages decide about rows, not ids: doc_ids may be null or repeat. ``docs`` may
have further columns of any names; all stages but the last return its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.llm import decontam, minhash, mixing, sharding, toxicity
from lendspark.llm.common import columns, discard, few, free_name, scratch, table, uniform, written

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the toxicity model, fitted on the labels, doesn't reject.

    Null texts have no matches and stay. Columns as in ``docs``.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of the smallest doc_id, null last.

    Sets of five-word shingles, similarity of at least 0.8. Of repeated rows
    one stays. Texts without words are their own components and all stay.
    """
    row, copy = free_name("row", docs), free_name("copy", docs)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keep: list[DataFrame] = []
    with scratch(keep):
        found = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80)
        linked = found.where("doc_id != component_id").select(F.col("doc_id").alias("id"), F.col("component_id").alias("comp"))
        linked = written(linked.unionByName(linked.select(F.col("comp").alias("id"), "comp").distinct()), "linked")
        ids = rows.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col(row).alias("id")).alias("order"))
        linked = linked.join(ids, F.col("id") == F.col("r")).select("id", "comp", "order")
        best = linked.groupBy(F.col("comp").alias("c")).agg(F.min("order")["id"].alias("best"))
        copies = written(linked.join(best, F.col("comp") == F.col("c")).where("id != best").select(F.col("id").alias(copy)), "copies")
        keep.append(copies)
    return rows.join(few(copies), F.col(row) == F.col(copy), "left_anti").select(*columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item, exact or with other slot values.

    Equal texts share one decision, whatever their ids.
    """
    name, leak = free_name("text_digest", docs), free_name("leak", docs)
    texts = docs.select(F.md5("text").alias("doc_id"), "text").where("text is not null")
    keep: list[DataFrame] = []
    with scratch(keep):
        found = decontam.contaminated(texts, table(spark, sf_dir, "benchmark").select("item_id", "text"))
        leaks = written(found.select(F.col("doc_id").alias(leak)).distinct(), "leaks")
        keep.append(leaks)
    return docs.withColumn(name, F.md5("text")).join(few(leaks), F.col(name) == F.col(leak), "left_anti").select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document that it takes twice has two rows.

    Each row is taken or left on its own, also where doc_ids repeat. Words that
    are taken come to 150 % of those of ``docs``; documents without words have
    none to take and go.
    """
    row, drawn, copies, copy = (free_name(n, docs) for n in ("row", "drawn", "copies", "copy"))
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "to-mix")
    texts = rows.select(F.col(row).alias("doc_id"), "source", "text", uniform(F.lit("mix"), F.col("doc_id"), F.xxhash64("text")).alias("luck"))
    taken = mixing.mix(texts, luck=F.col("luck")).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias(drawn), F.sequence(F.lit(1), F.try_divide("taken", "size").cast("int")).alias(copies))
    both = rows.join(taken, F.col(row) == F.col(drawn)).select(*columns(docs), F.explode(copies).alias(copy))
    return both.select(*columns(docs))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard, by jump hash of doc_id, and slot, the row's place in it.

    Columns of these names that ``docs`` already has are called
    source_shard and source_slot then.
    """
    for name in [c for c in docs.columns if c.lower() in ("shard", "slot")]:
        docs = docs.withColumnRenamed(name, free_name(f"source_{name}", docs))
    placed = sharding.assign_shards(docs, "doc_id", SHARDS)
    slots = sharding.number_slots(placed, "doc_id")
    return slots.withColumn("slot", F.col("slot").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The first two stages can't be said in SQL; the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over documents. A stage's table goes when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return docs
