"""Running sums against plain loops, in ranges of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import running


@pytest.mark.parametrize("n, parts, seed", [(0, 3, 0), (1, 3, 1), (7, 20, 2), (600, 20, 3), (600, 1, 4), (300, 40, 5), (900, 9, 6)])
def test_running(spark, n, parts, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "a", "b", "c", "", None]), i, rng.choice([0, 1, 5, 40, None])) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if seed % 2 else "10000")
    try:
        df = spark.createDataFrame(rows, "g string, before int, v int").withColumnRenamed("before", "i").repartition(5)
        for group in ([], ["g"]):
            sums = {(r.g, r.i): r.s for r in running.running(df, ["g", "i"], group, ["i"], F.col("v"), "s").collect()}
            places = {r.i: r.before for r in running.running(df, ["i"], group, [F.col("i")]).collect()}
            whole = {r.i: r.s for r in running.running(df, ["i"], group, ["i"], F.col("v") / 4, "s").collect()}
            held, count = {}, {}
            assert len(sums) == len(places) == n
            for g, i, v in rows:
                k = g if group else 0
                assert (sums[g, i], places[i], whole[i]) == (held.get(k, 0), count.get(k, 0), held.get(k, 0) / 4)
                held[k], count[k] = held.get(k, 0) + (v or 0), count.get(k, 0) + 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
