"""Streams over files give what the batch gives; messages decode leniently."""

from pyspark.sql import functions as F

from lendspark.plans import loanbook
from lendspark.sources import kafka, tables
from lendspark.streaming import jobs

DIR = "/root/testdata/sf0.001"


def test_streamed_windows_equal_batch(spark, tmp_path):
    apps = loanbook.applications(spark, DIR)
    apps.repartition(3).write.parquet(str(tmp_path / "apps"))
    stream = jobs.replay(spark, str(tmp_path / "apps"), apps.schema)
    q = jobs.to_memory(jobs.windowed_stats(jobs.score_stream(stream, "event_time"), "1 day", "40 days"), "windows")
    q.awaitTermination(120)
    want = {tuple(r) for r in jobs.windowed_stats(jobs.score_stream(apps, "event_time"), "1 day", None).collect()}
    last = spark.table("windows").groupBy("window_start").agg(F.max_by(F.struct("*"), "total_applications").alias("r")).select("r.*")
    assert {tuple(r) for r in last.collect()} == want


def test_sinks_and_recovery(spark, tmp_path):
    apps = loanbook.applications(spark, DIR)
    apps.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        scored = jobs.score_stream(jobs.replay(spark, str(tmp_path / "in"), apps.schema))
        jobs.to_parquet(scored, str(tmp_path / "out"), str(tmp_path / "cp"), seconds=None).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == apps.count()
    scored = jobs.score_stream(jobs.replay(spark, str(tmp_path / "in"), apps.schema))
    jobs.to_many(scored, str(tmp_path / "rows"), str(tmp_path / "tally"), str(tmp_path / "cp2"), seconds=None).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "tally")).agg(F.sum("count")).first()[0] == apps.count()
    # A crash after a batch was written and before it was committed: the batch comes again and replaces itself.
    for marker in (tmp_path / "cp2" / "commits").iterdir():
        marker.unlink()
    scored = jobs.score_stream(jobs.replay(spark, str(tmp_path / "in"), apps.schema))
    jobs.to_many(scored, str(tmp_path / "rows"), str(tmp_path / "tally"), str(tmp_path / "cp2"), seconds=None).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == apps.count()


def test_late_rows_are_dropped(spark, tmp_path):
    """A row from before the watermark, which the first batch moved on, changes no window."""
    schema = "SK_ID_CURR int, AMT_CREDIT double, AMT_INCOME_TOTAL double, DAYS_EMPLOYED int, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double, at string"
    row = lambda k, at: (k, 100.0, 50.0, -400, 0.5, 0.5, 0.5, at)
    folder, want = str(tmp_path / "in"), {}
    for k, times in enumerate([["2024-01-01 00:00:30", "2024-01-01 00:10:00"], ["2024-01-01 00:00:40", "2024-01-01 00:09:30"], ["2024-01-01 00:20:00"]]):
        spark.createDataFrame([row(10 * k + i, at) for i, at in enumerate(times)], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.score_stream(jobs.replay(spark, folder, spark.read.parquet(folder).schema), "at")
        windows = jobs.windowed_stats(stream, "1 minute", "2 minutes")
        query = windows.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    want = {"00:00": 1, "00:09": 1, "00:10": 1}
    got = spark.read.parquet(str(tmp_path / "out")).select(F.date_format("window_start", "HH:mm").alias("w"), "total_applications").collect()
    assert {r["w"]: r["total_applications"] for r in got} == want


def test_console_and_csv_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0, ""), (2, None, "nan"), (3, 7.5, "x")], "SK_ID_CURR int, AMT_CREDIT double, NAME_CONTRACT_TYPE string")
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    stream = jobs.replay(spark, str(tmp_path / "csv"), rows.schema, "csv")
    query = jobs.to_memory(stream.drop("timestamp"), "replayed", "append")
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("replayed").collect()} == {(1, 5.0, None), (2, None, None), (3, 7.5, "x")}
    query = jobs.to_console(stream, seconds=None)  # the JVM prints; what it took is known here
    query.awaitTermination(120)
    assert query.exception() is None and sum(p["numInputRows"] for p in query.recentProgress) == 3


def test_tally_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in (['{"decision": "APPROVE"}', '{"decision": "REVIEW"}'], ['{"decision": "APPROVE"}', "{}"]):
        spark.createDataFrame([(v.encode(),) for v in part], "value binary").write.mode("append").parquet(folder)
        kafka.tally_stream(spark.readStream.schema("value binary").parquet(folder), str(tmp_path / "out"), str(tmp_path / "cp"), seconds=None).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("APPROVE", 2, 50.0), ("REVIEW", 1, 25.0), ("?", 1, 25.0)}


def test_decode_is_permissive(spark):
    rows = [(b'{"SK_ID_CURR": 1, "AMT_CREDIT": 5.5}',), (b'{"SK_ID_CURR": "x", "AMT_CREDIT": 2.0}',), (b"not json",), (None,)]
    df = spark.createDataFrame(rows, "value binary").select("value", F.current_timestamp().alias("timestamp"), F.lit(0).alias("partition"), F.lit(1).alias("offset"))
    assert kafka.decode(df).columns[:4] == ["kafka_key", "kafka_timestamp", "kafka_partition", "kafka_offset"]
    assert kafka.decode(df.withColumn("key", F.lit(b"k1"))).first()["kafka_key"] == "k1"
    got = kafka.decode(df).select("SK_ID_CURR", "AMT_CREDIT").collect()
    assert [tuple(r) for r in got][:2] == [(1, 5.5), (None, 2.0)] and got[2]["SK_ID_CURR"] is None


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    df.write.option("header", True).csv(str(tmp_path / "c"))
    catalog = {"c": {"path": str(tmp_path / "c"), "schema": df.schema}, "gone": {"path": str(tmp_path / "no")}, "must": {"path": str(tmp_path / "no"), "required": True}}
    assert tables.load_table(spark, catalog, "c").count() == 2
    assert tables.load_table(spark, catalog, "unknown") is None and tables.load_table(spark, catalog, "gone") is None
    try:
        tables.load_table(spark, catalog, "must")
        raise AssertionError
    except FileNotFoundError:
        pass
    tables.write_parquet(df, str(tmp_path / "p"), "id")
    tables.write_report(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 2


def test_any_uri(spark, tmp_path):
    """Tables and reports take URIs of any Hadoop file system, here file:."""
    uri = (tmp_path / "t").as_uri()
    tables.write_parquet(spark.range(5), f"{uri}/rows")
    tables.write_report(spark.range(1), f"{uri}/report")
    assert tables.load_table(spark, {"rows": {"path": f"{uri}/rows", "format": "parquet", "required": True}}, "rows").count() == 5
    assert tables.load_table(spark, {"gone": {"path": f"{uri}/gone", "format": "parquet"}}, "gone") is None
    assert spark.read.json(f"{uri}/report").first()["id"] == 0
