"""Evaluation of predictions, and ordered scans of training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(preds: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """Counts for every pair of classes, zeros included; the grid is classes by classes, not rows by rows."""
    n = preds.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    classes = n.select(F.col(truth).alias("c")).union(n.select(F.col(pred).alias("c"))).distinct()
    every = classes.agg(F.array_sort(F.collect_list("c")).alias("cs"))
    grid = every.select(F.explode("cs").alias(truth), "cs").select(truth, F.explode("cs").alias(pred))
    return grid.join(n, [truth, pred], "left").select(truth, pred, F.coalesce("n", F.lit(0)).alias("n"))


def class_report(preds: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """Precision, recall, F1 and support of every class seen; a division by zero is 0."""
    both = preds.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col(truth) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    s = both.groupBy("c").agg(F.sum("t").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", part(F.col("hits"), F.col("predicted"))).withColumn("recall", part(F.col("hits"), F.col("support")))
    return s.select(F.col("c").alias("label"), "precision", "recall", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def summary(preds: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """Accuracy, macro-F1 and weighted F1."""
    r = class_report(preds, truth, pred)
    f = r.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return preds.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy")).join(F.broadcast(f))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean of each place of the vectors of a key."""
    return rows.select(key, F.posexplode(vector).alias("pos", "_v")).groupBy(key, "pos").agg(F.avg(F.col("_v").cast("double")).alias("mean"))


def top_k(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The places of the ``k`` greatest values of each vector, sorted within the row."""
    items = F.transform(vector, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("pos")))
    best = F.slice(F.array_sort(items), 1, k)
    return rows.select(key, F.posexplode(best).alias("_r", "_x")).select(key, (F.col("_r") + 1).alias("rank"), F.col("_x.pos").alias("pos"), (-F.col("_x.v")).alias("value"))


def early_stopping(history: DataFrame, run: str, epoch: str, metric: str, patience: int = 5) -> DataFrame:
    """Add best so far, whether an epoch improves on it (strictly), epochs since, and whether training still ran."""
    w = W.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = history.withColumn("improved", before.isNull() | (F.col(metric) > before))
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_n", F.row_number().over(w)).withColumn("stale", F.col("_n") - last)
    stopped = F.max((F.col("stale") >= patience).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("ran", F.coalesce(stopped, F.lit(0)) == 0).drop("_n")


def close_vectors(a: DataFrame, b: DataFrame, key: str, vector: str, rtol: float = 1e-3, atol: float = 1e-5) -> DataFrame:
    """(key, same_shape, furthest, passed) of the vectors that both tables have: of one length, and each value within the tolerance."""
    rows = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    same = F.size("_a") == F.size("_b")
    gaps = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    near = F.forall(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= F.lit(atol) + F.lit(rtol) * F.abs(y.cast("double"))), lambda ok: F.coalesce(ok, F.lit(False)))
    return rows.select(key, same.alias("same_shape"), F.when(same, F.array_max(gaps)).alias("furthest"), (same & near).alias("passed"))
