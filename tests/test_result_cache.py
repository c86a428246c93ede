"""The cache: hits and misses, the last put, corrupt entries, two writers, clearing."""

import threading
from pathlib import Path

import pytest

from tidemill.operators.result_cache import ResultCache


@pytest.fixture
def cache(spark, tmp_path):
    return ResultCache(spark, f"file://{tmp_path}/cache")


def _put(spark, cache, rows, backend="rocm"):
    cache.put(spark.createDataFrame(rows, "path string, text string, result string, applied string, remaining string").coalesce(1), backend)


def _get(spark, cache, texts, backend="rocm"):
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    return [(r.hit, r.result) for r in cache.get(files, backend).orderBy("path").collect()]


def test_get_put_clear(spark, cache):
    assert _get(spark, cache, ["a"]) == [(False, None)] and cache.clear() == 0
    assert tuple(cache.stats().first()) == (0, 0, 0)
    _put(spark, cache, [("p", "a", "A", "[]", None), ("q", None, "N", None, None), ("r", "a", "A", "[]", None)])
    assert _get(spark, cache, ["a", None, "", "b"]) == [(True, "A"), (True, "N"), (True, "N"), (False, None)]
    assert _get(spark, cache, ["a"], "other") == [(False, None)]
    _put(spark, cache, [("p", "a", "A2", "[]", "[1]"), ("p", "c", "C", None, None)])
    assert _get(spark, cache, ["a", "c"]) == [(True, "A2"), (True, "C")]
    assert tuple(cache.stats().first()) == (3, 3, 0)
    files = spark.createDataFrame([("r", "a"), ("q", "x"), ("s", "a")], "path string, text string")
    assert sorted(r.path for r in cache.changed(files, "rocm").collect()) == ["q", "s"]
    assert {r.path: len(r.result_hash) for r in cache.manifest().collect()} == {"p": 16, "q": 16, "r": 16}
    cache.put_plans(spark.createDataFrame([("a", "[]", "plan")], "text string, issues string, plan string"))
    asked = spark.createDataFrame([("a", "[]"), ("a", "[2]")], "text string, issues string")
    assert {r.issues: r.plan for r in cache.get_plans(asked).collect()} == {"[]": "plan", "[2]": None}
    before = sorted(map(str, cache.manifest().drop("put").collect()))
    cache.compact()
    assert len(cache._snapshot()[1]) == 1 and sorted(map(str, cache.manifest().drop("put").collect())) == before
    assert _get(spark, cache, ["a", "c", "b"]) == [(True, "A2"), (True, "C"), (False, None)]
    assert cache.clear() == 1 and _get(spark, cache, ["a"]) == [(False, None)]


def test_two_writers_lose_nothing(spark, cache):
    threads = [threading.Thread(target=_put, args=(spark, cache, [(f"p{i}", f"t{i}", f"r{i}", None, None)])) for i in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert _get(spark, cache, [f"t{i}" for i in range(6)]) == [(True, f"r{i}") for i in range(6)]
    assert cache._snapshot()[0] == 6


def test_corrupt_entries_are_misses(spark, cache, tmp_path):
    _put(spark, cache, [("p", "a", "A", None, None)])
    _put(spark, cache, [("q", "b", "B", None, None)])
    first = cache._snapshot()[1][0]
    for part in Path(f"{tmp_path}/cache/{first}").glob("*.parquet"):
        part.write_bytes(b"no parquet")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert _get(spark, cache, ["a", "b"]) == [(False, None), (True, "B")]
    bad = spark.read.parquet(f"{cache.root}/{cache._snapshot()[1][1]}").selectExpr("*").replace("B", "X", "result")
    bad.write.parquet(f"{cache.root}/segments/bad")
    cache._commit(lambda segments: ["segments/bad"])
    assert _get(spark, cache, ["b"]) == [(False, None)]
    # a snapshot that is not complete is not read
    (tmp_path / "cache/snapshots/000000000099.json").write_text('["segm')
    assert cache._snapshot()[0] == 3
