"""A cache of results as a table: segments of Parquet that never change, and snapshots that list them.

A put writes a segment and then the next snapshot, a small file whose name is its number and which is created only if it
is not there: of two writers one finds it there, reads it and tries the number after it, so no put is lost.  Readers take
the last complete snapshot.  The last put of a key holds.  An entry whose checksum does not fit, and a segment that can't
be read, are misses.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import cache_key

ENTRY = "kind string, path string, key string, backend string, result string, applied string, remaining string, put long, checksum string"


def plan_key(text: Column, issues: Column) -> Column:
    """The key of a plan: of the text and its open issues, as JSON with sorted names."""
    return cache_key(text, issues)


def result_hash(text: Column) -> Column:
    """The first 16 digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


class ResultCache:
    """A cache under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- snapshots

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _snapshot(self) -> tuple[int, list[str]]:
        """The number and the segments of the last complete snapshot."""
        at, fs = self._path("snapshots")
        names = sorted((f.getPath().getName() for f in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
        for name in names:
            if name.endswith(".json") and not name.startswith("."):
                stream = fs.open(self._path(f"snapshots/{name}")[0])
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                if text.endswith("\n"):
                    return int(name[:-5]), json.loads(text)
        return 0, []

    def _commit(self, change) -> list[str]:
        """Make the next snapshot of ``change(segments)``; the segments before are returned."""
        while True:
            number, segments = self._snapshot()
            at, fs = self._path(f"snapshots/{number + 1:012}.json")
            try:
                stream = fs.create(at, False)
            except Exception as e:  # another writer was first
                if "FileAlreadyExists" not in str(e):
                    raise
                time.sleep(0.05)
                continue
            stream.write(bytearray((json.dumps(change(segments)) + "\n").encode()))
            stream.close()
            return segments

    # -- entries

    def _put(self, rows: DataFrame) -> None:
        name = f"segments/{uuid.uuid4().hex}"
        names = [x.split()[0] for x in ENTRY.split(", ")][:-1]
        full = rows.withColumn("put", F.lit(time.time_ns())).withColumns({n: F.lit(None).cast("string") for n in names if n not in (*rows.columns, "put")})
        full.select(*names, _checksum().alias("checksum")).write.parquet(f"{self.root}/{name}")
        self._commit(lambda segments: [*segments, name])

    def put(self, results: DataFrame, backend: str) -> None:
        """Keep the results (path, text, result, applied, remaining: the last two as JSON) of files."""
        key = cache_key(F.coalesce("text", F.lit("")), F.lit(backend))
        self._put(results.select(F.lit("migration").alias("kind"), F.col("path").cast("string").alias("path"), key.alias("key"), F.lit(backend).alias("backend"), "result", "applied", "remaining"))

    def put_plans(self, plans: DataFrame) -> None:
        """Keep plans (text, issues, plan)."""
        self._put(plans.select(F.lit("plan").alias("kind"), plan_key(F.coalesce("text", F.lit("")), F.col("issues")).alias("key"), F.col("plan").alias("result")))

    def _rows(self) -> DataFrame:
        _, segments = self._snapshot()
        if not segments:
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*[f"{self.root}/{s}" for s in segments])
        return rows.filter(F.col("checksum") == _checksum())

    def _last(self, kind: str, by: str) -> DataFrame:
        rest = [x.split()[0] for x in ENTRY.split(", ") if x.split()[0] != by]
        last = F.max_by(F.struct(*rest), F.struct("put", "checksum"))
        return self._rows().filter(F.col("kind") == kind).groupBy(by).agg(last.alias("e")).select(by, "e.*")

    def get(self, files: DataFrame, backend: str) -> DataFrame:
        """``files`` (path, text) with result, applied, remaining and ``hit``."""
        key = cache_key(F.coalesce("text", F.lit("")), F.lit(backend))
        held = self._last("migration", "key").select(F.col("key").alias("_key"), "result", "applied", "remaining", F.lit(True).alias("hit"))
        return files.withColumn("_key", key).join(held, "_key", "left").drop("_key").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def get_plans(self, asked: DataFrame) -> DataFrame:
        """``asked`` (text, issues) with ``plan``, null where there is none."""
        held = self._last("plan", "key").select(F.col("key").alias("_key"), F.col("result").alias("plan"))
        return asked.withColumn("_key", plan_key(F.coalesce("text", F.lit("")), F.col("issues"))).join(held, "_key", "left").drop("_key")

    def manifest(self) -> DataFrame:
        """(path, source_hash, result_hash, backend, put): the last put of each path."""
        return self._last("migration", "path").select("path", F.col("key").alias("source_hash"), result_hash(F.col("result")).alias("result_hash"), "backend", "put")

    def changed(self, files: DataFrame, backend: str) -> DataFrame:
        """Files whose last put had another text or backend, or that were never put."""
        key = cache_key(F.coalesce("text", F.lit("")), F.lit(backend))
        known = self.manifest().select(F.col("path").alias("_path"), F.col("source_hash").alias("_key"))
        return files.join(known, (F.col("path").cast("string") == F.col("_path")) & (key == F.col("_key")), "left_anti")

    def stats(self) -> DataFrame:
        """One row: tracked_files, cached_migrations, cached_plans."""
        of = lambda kind, c: F.countDistinct(F.when(F.col("kind") == kind, F.col(c)))
        return self._rows().agg(of("migration", "path").alias("tracked_files"), of("migration", "key").alias("cached_migrations"), of("plan", "key").alias("cached_plans"))

    # -- upkeep

    def compact(self) -> None:
        """Rewrite what holds as one segment; what was put meanwhile stays beside it."""
        _, before = self._snapshot()
        if len(before) < 2:
            return
        name = f"segments/{uuid.uuid4().hex}"
        names = [x.split()[0] for x in ENTRY.split(", ")]
        by_key = self._last("migration", "key").unionByName(self._last("migration", "path")).dropDuplicates(["kind", "key", "path"])
        by_key.unionByName(self._last("plan", "key")).select(*names).write.parquet(f"{self.root}/{name}")
        gone = self._commit(lambda segments: [name, *[s for s in segments if s not in before]])
        self._delete([s for s in gone if s in before])

    def clear(self) -> int:
        """Forget all; the number of segments that were deleted."""
        gone = self._commit(lambda _: [])
        self._delete(gone)
        return len(gone)

    def _delete(self, segments: list[str]) -> None:
        for s in segments:
            at, fs = self._path(s)
            fs.delete(at, True)


def _checksum() -> Column:
    """Of all that an entry holds; nulls count as such."""
    names = [x.split()[0] for x in ENTRY.split(", ")][:-1]
    return F.md5(F.to_json(F.struct(*names)))
