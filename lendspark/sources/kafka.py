"""Kafka source and sink. Decoding and encoding are apart, so any frame of Kafka shape will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..streaming.schemas import APPLICATION

#: The fields of a scored message.
SCORED = ("SK_ID_CURR", "AMT_CREDIT", "pd_score", "risk_tier", "decision", "expected_loss", "scored_at")


def decode(messages: DataFrame) -> DataFrame:
    """kafka_key, kafka_timestamp, kafka_partition, kafka_offset, the
    application's fields, and the text of a message that isn't JSON. A bad
    field becomes null; a frame without keys has null ones."""
    schema = StructType([*APPLICATION.fields, StructField("_corrupt_record", StringType())])
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    key = F.col("key").cast("string") if "key" in messages.columns else F.lit(None).cast("string")
    rows = messages.select(key.alias("kafka_key"), F.col("timestamp").alias("kafka_timestamp"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), parsed.alias("data"))
    return rows.select("kafka_key", "kafka_timestamp", "kafka_partition", "kafka_offset", "data.*")


def encode(scored: DataFrame) -> DataFrame:
    """key (the id as text) and value (JSON of the scored fields)."""
    return scored.select(F.col("SK_ID_CURR").cast("string").alias("key"), F.to_json(F.struct(*SCORED)).alias("value"))


def read_stream(spark: SparkSession, servers: str, topic: str, most_offsets: int = 1000) -> DataFrame:
    """Decoded applications of a topic, from its end on."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    source = source.option("startingOffsets", "latest").option("failOnDataLoss", "false").option("maxOffsetsPerTrigger", most_offsets)
    return decode(source.load())


def write_stream(scored: DataFrame, servers: str, topic: str, checkpoint: str, seconds: int = 5) -> StreamingQuery:
    """Scored applications to a topic, at least once."""
    sink = encode(scored).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return sink.option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{seconds} seconds").start()


def decision_counts(scored_messages: DataFrame) -> DataFrame:
    """decision, n of scored messages (value), of a table or a stream; "?" if a message has none."""
    data = F.from_json(F.col("value").cast("string"), "SK_ID_CURR long, decision string")
    return scored_messages.groupBy(F.coalesce(data["decision"], F.lit("?")).alias("decision")).agg(F.count("*").alias("n"))


def with_shares(counts: DataFrame) -> DataFrame:
    """decision, n, share_pct of a table of counts."""
    total = counts.agg(F.sum("n").alias("__all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("decision", "n", F.round(F.col("n") * 100.0 / F.col("__all"), 2).alias("share_pct"))


def decision_tally(scored_messages: DataFrame) -> DataFrame:
    """decision, n, share_pct of a topic of scored messages (value)."""
    return with_shares(decision_counts(scored_messages))


def tally_stream(scored_messages: DataFrame, path: str, checkpoint: str, seconds: int | None = 10) -> StreamingQuery:
    """The tally of a stream so far, rewritten at ``path`` after each micro-batch (complete mode).

    ``seconds=None`` takes what is there and ends."""
    writer = decision_counts(scored_messages).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.foreachBatch(lambda counts, _: with_shares(counts).coalesce(1).write.mode("overwrite").parquet(path)).start()
