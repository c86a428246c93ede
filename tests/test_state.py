"""Streams that keep state over restarts, and rows mixed by a permutation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import dataset
from tidemill.streaming import watch

SCHEMA = "path string, at int, text string"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_unchanged_versions_are_skipped_over_restarts(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    stream = lambda: watch.changed_files(spark.readStream.schema(SCHEMA).parquet(folder), "b")
    read = lambda: sorted((r.path, r.at) for r in spark.read.parquet(out).collect())
    # two versions of one path in one batch, in any order; a null text
    _write(spark, folder, [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("c", 1, None), ("a", 3, "y")])
    watch.run_to_end(stream(), out, state)
    assert read() == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    _write(spark, folder, [("a", 4, "y"), ("b", 2, "z"), ("b", 1, "late"), ("c", 2, ""), ("d", 1, "x")])
    watch.run_to_end(stream(), out, state)
    assert read() == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1)]
    watch.run_to_end(stream(), out, state)
    assert len(read()) == 6


def test_a_run_that_breaks_off_is_taken_up(spark, tmp_path):
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    seen, broken = [], []

    def sink(batch, number):
        rows = [(r.path, r.at) for r in batch.collect()]
        if not broken:
            broken.append(number)
            raise RuntimeError("lost")
        seen.extend(rows)

    def run():
        stream = watch.changed_files(spark.readStream.schema(SCHEMA).parquet(folder))
        stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    _write(spark, folder, [("a", 1, "x"), ("b", 1, "x")])
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert sorted(seen) == [("a", 1), ("b", 1)]
    _write(spark, folder, [("a", 2, "x"), ("b", 2, "y")])
    run()
    assert sorted(seen) == [("a", 1), ("b", 1), ("b", 2)]


def test_changed_versions_by_batch(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))

    def run():
        watch.append_changed(spark.readStream.schema(SCHEMA).parquet(folder), out, state, "b")
        return sorted((r.path or "", r.at, r.text) for r in spark.read.parquet(out).collect())

    _write(spark, folder, [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("c", 1, None), ("a", 3, "y"), (None, 1, "n"), ("e", None, "x")])
    first = [("", 1, "n"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, None)]
    assert run() == first
    _write(spark, folder, [("a", 4, "y"), ("a", 5, "x"), ("b", 2, "z"), ("b", 2, "z"), ("b", 1, "late"), ("c", 2, ""), (None, 2, "n"), ("d", 1, "x")])
    second = sorted([*first, ("a", 5, "x"), ("b", 2, "z"), ("d", 1, "x")], key=lambda r: r[:2])
    assert run() == second and run() == second
    # the second batch once more, as after a run that broke off before its commit
    (tmp_path / "state" / "commits" / "1").unlink()
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run() == second
    _write(spark, folder, [("a", 5, "w"), ("b", 3, "z"), ("d", 2, "y")])
    assert run() == sorted([*second, ("d", 2, "y")], key=lambda r: r[:2])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 37, 100, 1000, 1025, 3001])
def test_permuted_places(spark, n):
    places = [r.p for r in spark.range(n).select(dataset.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(places) == list(range(n))
    if n > 100:
        assert sum(p == i for i, p in enumerate(places)) < 10


def test_beta_draws(spark):
    u = spark.range(0, 2001).select((F.col("id") / 2000.0).alias("u"))
    for alpha in (0.2, 0.5, 1.0, 2.0):
        x = np.array([r.x for r in u.select(dataset.beta_draw(F.col("u"), alpha).alias("x")).collect()])
        assert (np.diff(x) >= 0).all() and x[0] >= 0 and x[-1] <= 1 and abs(x + x[::-1] - 1).max() < 0.01
        assert abs(np.var(x) - 1 / (4 * (2 * alpha + 1))) < 0.01


def test_mixed_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random(), float(i)], rng.choice(["a", "b", None])) for i in range(97)]
    df = spark.createDataFrame(rows, "k long, v array<double>, label string").repartition(3)
    weights = spark.createDataFrame([("a", 3.0), (None, 5.0)], "label string, weight double")
    out = dataset.mixed_rows(df, "k", "v", "label", 0.2, 9, weights).collect()
    assert Counter(r.partner for r in out) == Counter(range(97)) and sorted(r.k for r in out) == list(range(97))
    for r in out:
        (_, v, label), (_, w, other) = rows[r.k], rows[r.partner]
        assert r.v == pytest.approx([r.share * x + (1 - r.share) * y for x, y in zip(v, w, strict=True)])
        of = {"a": 3.0, None: 5.0}
        assert r.weight == pytest.approx(r.share * of.get(label, 1.0) + (1 - r.share) * of.get(other, 1.0))
        assert sum(x.share for x in r.labels) == pytest.approx(1) and {x.label for x in r.labels} == {label, other}
    again = dataset.mixed_rows(df.repartition(5), "k", "v", "label", 0.2, 9, weights).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert dataset.mixed_rows(df.limit(0), "k", "v", "label", 0.2, 9).collect() == []
