"""What the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves while Spark runs in one process; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders that ``materialize`` wrote within the innermost ``scratch``, if any.
_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{uuid.uuid4().hex}"
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` returned, once no frame that is still to be evaluated reads it."""
    for df in tables:
        delete(df.sparkSession, df._materialized)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone; by itself it does so every half hour."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that are materialized within; the caller deletes them once the frames made from them are evaluated."""
    token = _scratch.set([])
    try:
        yield _scratch.get()
    finally:
        _scratch.reset(token)


def materialize_bucketed(df: DataFrame, column: str) -> DataFrame:
    """As ``materialize``, as a table bucketed by ``column``: joins on it later do not shuffle it again.

    ``df`` should come from a shuffle by that column, so that every task writes few buckets.
    """
    spark = df.sparkSession
    name = f"tidemill_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_tidemill_{name}"
    while name in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))
