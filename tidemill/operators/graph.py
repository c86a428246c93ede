"""Dependency graphs as tables of edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dependents(edges: DataFrame) -> DataFrame:
    """Of each module the modules that import it, in order."""
    return edges.groupBy("dst").agg(F.concat_ws(",", F.array_sort(F.collect_set("src"))).alias("dependents"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting one of this machine, while Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; unlike a checkpoint it is computed once."""
    path = f"{shared_folder(df.sparkSession)}/tidemill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Modules of a block.  What happens within a block takes one round, however long its ways are: cost only.
BLOCK = 1 << 15
#: Bits of a number below its block.
LOW = 33


def _block(c: str) -> Column:
    return F.shiftright(c, LOW)


def _numbered(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(module, id): numbers in the order of the modules, whose high bits are their block; and the edges (s, d) between two of them, once each."""
    rows = vertices.select("module").filter(F.col("module").isNotNull()).distinct()
    blocks = -(-rows.count() // BLOCK)
    # a range for each partition, and monotonic numbers have the partition above LOW bits
    rows = _kept(rows.repartitionByRange(max(blocks, 1), "module").sortWithinPartitions("module").withColumn("id", F.monotonically_increasing_id()))
    at = lambda end, c: rows.select(F.col("module").alias(end), F.col("id").alias(c))
    return rows, _kept(edges.select("src", "dst").join(at("src", "s"), "src").join(at("dst", "d"), "dst").filter("s <> d").select("s", "d").distinct())


def _indexed(rows: pa.Table, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows of a block in order, and places among them of both ends of its edges."""
    ids = rows["id"].to_numpy()
    return ids, *(np.searchsorted(ids, edges[c].to_numpy()) for c in "sd")


def _rounds(rows: DataFrame, edges: DataFrame, within: Callable[[pa.Table, pa.Table], pa.Table], sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (id, new and more) once nothing is new.

    A round brings each block by itself to its end (``within``, of its rows and its edges, marks what is new); what is new goes
    along the edges between blocks, and ``sent`` gives the rows of the next round.  A way takes a round for each change of its block.
    """
    blocked = lambda df, c: df.withColumn("block", _block(c)).groupBy("block")
    inner, crossing = edges.filter(_block("s") == _block("d")), edges.filter(_block("s") != _block("d"))
    schema, one_block = rows.schema, crossing.isEmpty()
    while True:
        rows = _kept(blocked(rows, "id").cogroup(blocked(inner, "s")).applyInArrow(lambda x, e: within(x.drop(["block"]).sort_by("id"), e), schema))
        if one_block or rows.filter("new").isEmpty():
            return rows
        rows = sent(rows)


def _placed(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level, waits): 0 without edges from it, else one above the highest that it points to; ``waits`` is 0 for those that have a level."""

    def within(rows: pa.Table, inner: pa.Table) -> pa.Table:
        ids, s, d = _indexed(rows, inner)
        level, waits, done = rows["level"].to_numpy().copy(), rows["waits"].to_numpy().copy(), rows["done"].to_numpy(zero_copy_only=False).copy()
        order = np.argsort(d, kind="stable")
        s, begins = s[order], np.searchsorted(d[order], np.arange(len(ids) + 1))
        new, front = np.zeros(len(ids), bool), np.flatnonzero((waits == 0) & ~done)
        while len(front):
            new[front] = True
            n = begins[front + 1] - begins[front]
            at = np.repeat(begins[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.subtract.at(waits, s[at], 1)
            np.maximum.at(level, s[at], np.repeat(level[front] + 1, n))
            front = np.unique(s[at])
            front = front[waits[front] == 0]
        return pa.table({"id": ids, "level": level, "waits": waits, "done": done | new, "new": new})

    def sent(rows: DataFrame) -> DataFrame:
        news = rows.filter("new").select(F.col("id").alias("d"), (F.col("level") + 1).alias("_level"))
        news = edges.filter(_block("s") != _block("d")).join(news, "d").groupBy(F.col("s").alias("id")).agg(F.max("_level").alias("_level"), F.count("*").alias("_n"))
        return rows.join(news, "id", "left").select("id", F.greatest("level", "_level").alias("level"), (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"), "done", F.lit(False).alias("new"))

    zero, no = F.lit(0).cast("long"), F.lit(False)
    waits = edges.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("waits"))
    rows = ids.join(waits, "id", "left").select("id", zero.alias("level"), F.coalesce("waits", zero).alias("waits"), no.alias("done"), no.alias("new"))
    return _rounds(rows, edges, within, sent).select("id", "level", "waits")


def _spread(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value) with the greatest value of ``rows`` (id, value; -1 for none) that reaches a number along the edges."""

    def within(rows: pa.Table, inner: pa.Table) -> pa.Table:
        ids, s, d = _indexed(rows, inner)
        value, new = rows["value"].to_numpy().copy(), rows["new"].to_numpy(zero_copy_only=False).copy()
        order = np.argsort(s, kind="stable")
        d, begins = d[order], np.searchsorted(s[order], np.arange(len(ids) + 1))
        front = np.flatnonzero(new)
        while len(front):
            n = begins[front + 1] - begins[front]
            at = d[np.repeat(begins[front] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            to = np.unique(at)
            had = value[to]
            np.maximum.at(value, at, np.repeat(value[front], n))
            front = to[value[to] > had]
            new[front] = True
        return pa.table({"id": ids, "value": value, "new": new})

    def sent(rows: DataFrame) -> DataFrame:
        news = rows.filter("new").select(F.col("id").alias("s"), F.col("value").alias("_value"))
        news = edges.filter(_block("s") != _block("d")).join(news, "s").groupBy(F.col("d").alias("id")).agg(F.max("_value").alias("_value"))
        return rows.join(news, "id", "left").select("id", F.greatest("value", "_value").alias("value"), F.coalesce(F.col("_value") > F.col("value"), F.lit(False)).alias("new"))

    return _rounds(rows.select("id", "value", (F.col("value") >= 0).alias("new")), edges, within, sent).select("id", "value")


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, level): 0 without dependencies, else one above the highest dependency; -1 in or above a cycle.

    Modules all of whose dependencies are placed are placed, block by block (``_rounds``), until nothing can be placed.
    """
    numbers, between = _numbered(vertices, edges)
    placed = numbers.join(_placed(numbers.select("id"), between).filter("waits = 0"), "id").select("module", F.col("level").cast("int").alias("level"))
    return vertices.join(placed, "module", "left").select("module", F.coalesce("level", F.lit(-1)).alias("level"))


def cycles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, component): the least module of those that a module reaches and that reach it, itself included.

    What no cycle reaches or what reaches no cycle is alone, which two passes of ``_placed`` tell.  In the rest the greatest
    module is spread along the edges as a colour; those of a colour from which its module can be reached are one component and
    leave, and so on until none are left.
    """
    numbers, inner = _numbered(vertices, edges)
    within = lambda e, v: e.join(v.select(F.col("id").alias("s")), "s", "left_semi").join(v.select(F.col("id").alias("d")), "d", "left_semi").select("s", "d")
    turned = lambda e: e.select(F.col("d").alias("s"), F.col("s").alias("d"))
    left, found = numbers.select("id"), []
    while True:
        for turn in (lambda e: e, turned):
            left = _placed(left, turn(inner)).filter("waits > 0").select("id")
            inner = _kept(within(inner, left))
        if left.isEmpty():
            break
        colour = _spread(left.select("id", F.col("id").alias("value")), inner)
        at = lambda end: colour.select(F.col("id").alias(end), F.col("value").alias(f"_{end}"))  # noqa: E731, B023
        same = _kept(turned(inner.join(at("s"), "s").join(at("d"), "d").filter("_s = _d")))
        reach = _spread(colour.select("id", F.when(F.col("id") == F.col("value"), F.col("id")).otherwise(-1).alias("value")), same).filter("value >= 0")
        least = reach.groupBy("value").agg(F.min("id").alias("component"))
        found.append(_kept(reach.join(least, "value").select("id", "component")))
        left = _kept(left.join(reach, "id", "left_anti"))
        inner = _kept(within(inner, left))
    if not found:
        return numbers.select("module", F.col("module").alias("component"))
    of = numbers.join(reduce(DataFrame.unionByName, found), "id", "left").select("module", F.coalesce("component", "id").alias("id"))
    return _kept(of.join(numbers.select("id", F.col("module").alias("component")), "id").select("module", "component"))


def order(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, component, level): sorted by level, component and module, all that a module depends on stands before it, but for its own cycle."""
    component = cycles(vertices, edges)
    at = lambda end: component.select(F.col("module").alias(end), F.col("component").alias(f"_{end}"))
    between = edges.join(at("src"), "src").join(at("dst"), "dst").filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    placed = levels(component.select(F.col("component").alias("module")).distinct(), between)
    return component.join(placed.select(F.col("module").alias("component"), "level"), "component").select("module", "component", "level")
