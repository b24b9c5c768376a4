"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, interpolation, licenses, minhash, mixing, sharding, suffix_dedup, toxicity, variants, warc, whitening
from .common import table

SHARDS = 8


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, and conversation -1 with control strings in it."""
    sample = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(sample).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chats(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: weights 5, 2, 1 over the sources, 150% of all words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts all documents into 8 shards by doc_id, and shows where 9 would put them."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign_shards(docs, "doc_id", SHARDS, "shard", "grown_shard")
    placed = sharding.number_slots(placed, "doc_id", ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op5_mixing": op5_mixing,
    "op8_sharding": op8_sharding,
}


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, with header and block digests."""
    rows = warc.derive(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return rows.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", F.sha2("header", 256).alias("header_sha256")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or with other slot values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES |= {"op2_warc": op2_warc, "op3_decontamination": op3_decontamination, "op7_licenses": op7_licenses}


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every 50th embedding, among all rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k=5)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingle sets are 0.8 alike."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


QUERIES |= {"op9_ann": op9_ann, "op10_minhash": op10_minhash}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; labels of held-out rows aren't used."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from all documents what a 100-byte string repeats."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES |= {"op4_toxicity": op4_toxicity, "op6_suffix_dedup": op6_suffix_dedup}


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the 4 widest directions, in standard deviations."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)


def op11_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a bigram model of those whose crc32(doc_id) mod 7 isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return interpolation.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the words one edit away, and the forms they are variants of."""
    return variants.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES |= {"op11_interpolation": op11_interpolation, "op12_variants": op12_variants, "op13_whitening": op13_whitening}
