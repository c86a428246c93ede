"""Skipping what has not changed, and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import cache_key
from tidemill.operators import greedy


def changed(files: DataFrame, manifest: DataFrame, backend: str, rules: str = "") -> DataFrame:
    """Files whose path, content, backend and rule set are not in the manifest."""
    now = files.withColumn("source_hash", cache_key(F.col("text"), F.lit(f"{backend}|{rules}")))
    return now.join(manifest.select("path", "source_hash"), ["path", "source_hash"], "left_anti")


def upserted(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest with the rows of ``done`` in place of older ones of the same path."""
    return manifest.join(done.select("path"), "path", "left_anti").unionByName(done.select(*manifest.columns))


def audit_rows(results: DataFrame) -> DataFrame:
    """One audit entry a file: counts and mean confidence to three digits, half to even."""
    return results.groupBy("path").agg(
        F.bround(F.coalesce(F.avg("confidence"), F.lit(1.0)), 3).alias("overall_confidence"),
        F.count_if(F.col("reason").isNull()).alias("applied_count"),
        F.count_if(F.col("reason").isNotNull()).alias("remaining_count"),
    )


def debounced(events: DataFrame, group: list[str], ts: str, key: str, seconds: float = 2.0) -> DataFrame:
    """Of the events of a group those that come ``seconds`` after the last accepted one."""
    return greedy.debounced(events, [*group, key], ts, key, seconds, group)
