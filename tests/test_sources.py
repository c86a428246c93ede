"""Readers, writers and reports, by round trips and by hand."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.functions import reports
from tidemill.operators import code, dataset, metrics
from tidemill.sources import files

RECORD = "path string, label string, idx int"


@pytest.fixture
def records(spark):
    rows = [("train", "a.jpg", "x", 0), ("val", "b.jpg", "y", 1), ("train", "c.jpg", "y", None), ("test", "d,\"é\".jpg", "x", 0)]
    return spark.createDataFrame(rows, f"split string, {RECORD}")


def test_manifest_and_splits(spark, records, tmp_path):
    files.write_whole_manifest(records, f"{tmp_path}/m")
    part = next(Path(f"{tmp_path}/m").glob("part-*"))
    assert list(json.loads(part.read_text())) == ["test", "train", "val"]
    got = files.read_manifest(spark, f"{tmp_path}/m", RECORD)
    assert sorted(map(str, got.collect())) == sorted(map(str, records.collect()))
    for _ in range(2):  # in place of what was there
        files.write_splits(records, f"{tmp_path}/s")
    again = files.read_records(spark, f"{tmp_path}/s/split=train", RECORD)
    assert sorted(r.path for r in again.collect()) == ["a.jpg", "c.jpg"]
    (tmp_path / "bad.jsonl").write_text('{"path": "a"}\nno json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_records(spark, f"{tmp_path}/bad.jsonl", RECORD).collect()


def test_dimension(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"title": "A", "n": 1},\n "b": {"title": null}}')
    assert sorted(map(tuple, files.read_dimension(spark, f"{tmp_path}/d.json", "title string, n int").collect())) == [("a", "A", 1), ("b", None, None)]


def test_confusion_and_metrics(spark, tmp_path):
    counts = spark.createDataFrame([(0, 0, 5), (2, 1, 3), (2, 2, 1)], "true long, predicted long, n long")
    files.write_confusion(counts, f"{tmp_path}/c", 3)
    assert next(Path(f"{tmp_path}/c").glob("part-*")).read_text() == "5,0,0\n0,0,0\n0,3,1\n"
    files.write_metrics(spark.createDataFrame([(0.5, 3)], "accuracy double, n int"), f"{tmp_path}/m")
    assert json.loads(next(Path(f"{tmp_path}/m").glob("part-*")).read_text()) == {"accuracy": 0.5, "n": 3}


def test_layouts(spark):
    flat = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = files.in_class_folders(flat(["/d/leaf/a.b.jpg", "/d/rust/x"])).collect()
    assert [tuple(r) for r in got] == [("/d/leaf/a.b.jpg", "leaf", "a.b"), ("/d/rust/x", "rust", "x")]
    images = flat(["i/a.png", "i/a.JPG", "i/b.jpeg", "i/c.txt", "i/d.png"])
    both, counts = files.images_with_labels(images, flat(["l/a.txt", "l/b.txt", "l/z.txt"]))
    assert sorted(map(tuple, both.collect())) == [("a", "i/a.JPG", "l/a.txt"), ("b", "i/b.jpeg", "l/b.txt")]
    assert tuple(counts.first()) == (2, 1, 1)


def test_reports(spark):
    row = spark.sql("select 'f.py' as path, '-a\n+b' as diff, array(named_struct('line', 3, 'original', 'a', 'replacement', 'b', 'rule', 'r')) as applied, array(named_struct('line', 4, 'symbol', 's', 'reason', 'why')) as remaining")
    out = lambda kind: row.select(reports.rendered(kind, *[F.col(c) for c in ("path", "diff", "applied", "remaining")]).alias("x")).first().x
    assert out("diff") == out("patch") == "-a\n+b" and json.loads(out("json"))["applied"][0]["line"] == 3
    assert out("markdown") == "# f.py\n\n## Applied\n\n- Line 3: `a` → `b` (r)\n\n## Remaining\n\n- Line 4: `s` — why\n\n```diff\n-a\n+b\n```\n"
    with pytest.raises(ValueError, match="unsupported"):
        out("html")


def test_close_vectors(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0]), (4, []), (5, [None])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [1.0005, 2.0]), (2, [1.0, 1.0]), (3, [1.0]), (4, []), (5, [1.0]), (6, [1.0])], "k int, v array<double>")
    got = {r.k: (r.same_shape, r.passed) for r in metrics.close_vectors(a, b, "k", "v").collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, False), 4: (True, True), 5: (True, False)}


def test_split_by_size(spark):
    texts = ["short", "", "x" * 50, "\n".join(["0123456789"] * 9), "\n" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in code.split_by_size(rows, 25).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append((r.part, r.start_line, r.end_line, r.source))
    assert got[0] == [(1, 1, 1, "short")] and got[1] == [(1, 1, 1, "")] and got[2] == [(1, 1, 1, "x" * 50)]
    assert [x[1:3] for x in got[3]] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 9)]
    assert all("\n".join(x[3] for x in got[i]) == texts[i] for i in range(5))


def test_labels_in_splits(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "val"), ("a", "test"), ("b", "train"), ("b", "train"), (None, "val")], "label string, split string")
    assert [r.label for r in dataset.in_all_splits(rows, "label").collect()] == ["a"]
    assert {tuple(r) for r in dataset.missing_labels(rows, "label").collect()} == {("b", "val"), ("b", "test"), (None, "train"), (None, "test")}


def test_history(spark):
    rows = [("2024-01-02T03:04:05.678", "a.py", "rocm", 3, 0, 0.985, True), (None, "x/" * 20 + "end.py", "a long backend", None, 12, None, None), ("t", None, None, 1, 1, 0.005, False)]
    df = spark.createDataFrame(rows, "ts string, f string, b string, a int, r int, c double, v boolean")
    got = [r.x for r in df.select(reports.history_row(*[F.col(c) for c in "ts f b a r c v".split()]).alias("x")).collect()]
    want = []
    for ts, f, b, a, r, c, v in rows:
        ts, f, b, a, r, c = (ts or "?")[:19], f or "?", b or "?", a or 0, r or 0, c or 0.0
        f = "..." + f[-25:] if len(f) > 28 else f
        want.append(f"{ts:<22} {f:<30} {b:<10} {a:>7} {r:>7} {c:>5.0%} { {True: 'pass', False: 'fail', None: '-'}[v]:>6}")
    assert got == want
    assert reports.history_head().split("\n")[0].startswith("Timestamp              File ") and reports.history_head().endswith("-" * 90)
