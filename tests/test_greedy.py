"""Greedy sequences against plain loops, in ranges of all sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import greedy


@pytest.fixture
def ranges(spark):
    """Sets the number of ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _debounced(rows, width, by_group):
    last, out = {}, set()
    for g, t, k in sorted(rows, key=lambda r: (r[1], r[2])):
        g = g if by_group else 0
        if g not in last or t - last[g] >= width:
            last[g] = t
            out.add(k)
    return out


def _merged(rows, most):
    out = []
    for g in {r[0] for r in rows}:
        held, tokens = [], 0
        for i, n in sorted((i, n or 0) for h, i, n in rows if h == g):
            if n < most // 4 and tokens + n < most:
                held.append(i)
                tokens += n
                continue
            out.append(held)
            held, tokens = ([i], n) if n < most // 4 else ([], 0)
            if n >= most // 4:
                out.append([i])
        out.append(held)
    return sorted(x for x in out if x)


@pytest.mark.parametrize("n, parts, width, seed", [(0, 4, 5, 0), (1, 4, 5, 1), (5, 20, 3, 2), (700, 20, 7, 3), (700, 9, 5000, 4), (400, 30, 1, 5), (900, 13, 300, 6)])
def test_debounce(spark, ranges, n, parts, width, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 400) * rng.choice([1, 1, 30]), i) for i in range(n)]
    ranges(parts)
    df = spark.createDataFrame(rows, "g string, t long, start int").withColumnRenamed("start", "k")
    for group in ([], ["g"]):
        out = greedy.chosen(df, ["g", "t", "k"], group, ["t", "k"], width, at=F.col("t")).collect()
        assert {r.k for r in out if r.start} == _debounced(rows, width, bool(group)) and len(out) == n
    even = spark.createDataFrame([("a", i, i) for i in range(n)], "g string, t long, k int")  # orbits that never meet
    out = greedy.chosen(even, ["k"], [], ["t"], width, at=F.col("t")).filter("start").collect()
    assert sorted(r.k for r in out) == list(range(0, n, width))


@pytest.mark.parametrize("n, parts, seed", [(0, 4, 0), (2, 4, 1), (6, 20, 2), (900, 20, 3), (900, 3, 4), (500, 40, 5)])
def test_merge(spark, ranges, n, parts, seed):
    rng = random.Random(seed)
    sizes = [0, 1, 3, 10, 24, 25, 60, None] if seed % 2 else [0, 0, 1, 2, 3]
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice(sizes)) for i in range(n)]
    ranges(parts)
    out = greedy.merged_small(spark.createDataFrame(rows, "g string, i int, tokens int"), ["g", "i"], ["g"], ["i"], 100).collect()
    found = {}
    for r in out:
        found.setdefault(r.segment, []).append(r.i)
    assert sorted(sorted(x) for x in found.values()) == _merged(rows, 100)
    assert sorted(min(x) for x in found.values()) == sorted(r.i for r in out if r.start)


def test_pointers():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        fixed = rng.random(n) < 0.2
        value = np.cumsum(rng.integers(0, 4, n))
        value[np.flatnonzero(fixed)[:1]] = 0
        for i in range(1, n):  # values fall at fixed rows only
            if value[i] < value[i - 1] and not fixed[i]:
                value[i] = value[i - 1]
        width = int(rng.integers(1, 9))
        got = greedy._pointers(value, value, fixed, width)
        for i in range(n):
            assert got[i] == next((j for j in range(i + 1, n) if fixed[j] or value[j] >= value[i] + width), n)
        assert greedy._last_of(got, n).tolist() == [_follow(got, i) for i in range(n)]


def _follow(next_, i):
    while next_[i] < len(next_):
        i = int(next_[i])
    return i
