"""Batch sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; with a schema it is read in one pass, else types are inferred."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_table(spark: SparkSession, catalog: Mapping[str, Mapping], key: str) -> DataFrame | None:
    """The table of a catalogue entry (path, and format, schema, required if wanted).

    An unknown key or a missing optional path gives None, a missing required
    path FileNotFoundError. Any Hadoop file-system path will do.
    """
    entry = catalog.get(key)
    if entry is None:
        return None
    try:
        if entry.get("format", "csv") == "csv":
            return read_csv(spark, entry["path"], entry.get("schema"))
        return spark.read.format(entry["format"]).load(entry["path"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if entry.get("required", False):
            raise FileNotFoundError(entry["path"]) from e
        return None


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Overwrites ``path``; snappy is Spark's default codec."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file of one object a row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def table_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns of each table."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
