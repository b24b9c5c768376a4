"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine (tests) has none a local folder is
    set; on a cluster that would lose data, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what is computed once survives the loss of executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append(table)
    return table


#: The tables that ``scratch`` knows of; None outside of it.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Deletes, at its end, all tables written within but those appended to ``keep``."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
    discard(*[t for t in made if not any(t is k for k in keep)])


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of ids or pairs (up to 40 bytes each) that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def few(df: DataFrame) -> DataFrame:
    """``df``, narrow rows, to be broadcast if a count shows that it has few."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        spark, folder = df.sparkSession, shared_dir(df.sparkSession)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if folder.rsplit("/", 1)[-1] in path.split("/"):
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once.

    Projections are merged, so a column that a lambda refers to may be worked
    out anew for each element; the variable of a lambda isn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the given values only."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
