"""Structured Streaming: new file versions, an appended audit log, and debouncing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.functions.text import cache_key


def file_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text); the file source sees new files, so a changed file comes under a new name."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def on_each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append what ``work`` makes of each batch; a batch that is run again overwrites its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced_stream(events: DataFrame, key: str, ts: str, seconds: float = 2.0) -> DataFrame:
    """(key, ts) of the events of a key that come ``seconds`` after its last accepted one; the state is one number a key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for f in frames for t in f[ts].tolist()):
            now = pd.Timestamp(t).value // 1000
            if last is None or now - last >= seconds * 1e6:
                last = now
                kept.append(t)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), ts: kept})

    schema = f"{key} {dict(events.dtypes)[key]}, {ts} timestamp"
    return events.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def changed_files(files: DataFrame, backend: str = "") -> DataFrame:
    """Of a stream of file versions (path, at, text) those whose content differs from the last one of the path, before or in the same batch.

    The state of a path is the key of its last content and the number ``at`` that it came with, so it outlives a restart.
    A version with a number that is not above the state's comes late or again and is skipped.
    """
    keyed = files.select("path", F.col("at").cast("long").alias("at"), "text", cache_key(F.coalesce("text", F.lit("")), F.lit(backend)).alias("hash"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, None)
        versions = pd.concat(list(frames)).sort_values("at", kind="stable")
        new = []
        for at, hash_ in zip(versions["at"], versions["hash"], strict=True):
            fresh = seen is None or at > seen
            new.append(fresh and hash_ != last)
            last, seen = (hash_, int(at)) if fresh else (last, seen)
        state.update((last, seen))
        yield versions.loc[new, ["path", "at", "text"]]

    schema = f"path {dict(files.dtypes)['path']}, at long, text string"
    return keyed.groupBy("path").applyInPandasWithState(step, schema, "hash string, at long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what has come since the last run to the table in ``out``; a run that broke off is taken up where it was."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def append_changed(files: DataFrame, out: str, checkpoint: str, backend: str = "") -> None:
    """What ``run_to_end`` appends of ``changed_files``, by joins and windows over a batch, so that no path costs a call of its own.

    The last content and number of every path are a table beside the stream's checkpoint, in two copies by turns: a batch reads
    the one of the batch before it and writes the other, so a batch that is run again finds what it found.  Of versions with one
    number the least key counts; a version without a number has no place and is skipped.
    """
    kind = dict(files.dtypes)["path"]

    def sink(batch: DataFrame, number: int) -> None:
        key = cache_key(F.coalesce("text", F.lit("")), F.lit(backend))
        rows = batch.filter("at is not null").select("path", F.col("at").cast("long").alias("at"), "text", key.alias("hash"))
        spark, schema = batch.sparkSession, f"path {kind}, seen long, had string"
        known = spark.read.schema(schema).parquet(f"{checkpoint}-known/{(number - 1) % 2}") if number else spark.createDataFrame([], schema)
        fresh = rows.join(known.withColumnRenamed("path", "_path"), F.col("path").eqNullSafe(F.col("_path")), "left").filter("seen is null or at > seen")
        once = fresh.withColumn("_n", F.row_number().over(W.partitionBy("path", "at").orderBy("hash"))).filter("_n = 1")
        before = F.coalesce(F.lag("hash").over(W.partitionBy("path").orderBy("at")), F.col("had"))
        changed = once.withColumn("_before", before).filter("_before is null or _before <> hash")
        changed.select("path", "at", "text").write.mode("overwrite").parquet(f"{out}/batch={number}")
        every = rows.select("path", (-F.col("at")).alias("_at"), F.lit(1).alias("_new"), "hash").unionByName(known.select("path", (-F.col("seen")).alias("_at"), F.lit(0).alias("_new"), F.col("had").alias("hash")))
        last = every.groupBy("path").agg(F.min(F.struct("_at", "_new", "hash")).alias("l")).select("path", (-F.col("l._at")).alias("seen"), F.col("l.hash").alias("had"))
        last.write.mode("overwrite").parquet(f"{checkpoint}-known/{number % 2}")

    files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
