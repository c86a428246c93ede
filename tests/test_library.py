"""The library's operators on small fixtures, and its queries against DuckDB."""

import json
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.functions import vectors as vx
from tidemill.operators import code, dataset, graph, incremental, metrics, syntax
from tidemill.plans import queries as plans
from tidemill.plans import rules
from tidemill.sources import files
from tidemill.streaming import watch

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_duckdb(spark, duck, name):
    run, sql = plans.QUERIES[name]
    got = run(spark, str(DATA))
    columns = sorted(got.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=str)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_text_functions(spark):
    assert one(spark, tx.normalize_text(F.lit("  Leaf   Spot-_x_ "))) == "leaf_spot_x"
    assert one(spark, tx.normalize_condition(F.lit("Leaf  spot3"))) == "leaf_spot"
    assert one(spark, tx.group_id(F.lit("R/Train_set/Leaf/a_rot90_2.JPG"))) == "r/train_set/leaf/a"
    assert one(spark, tx.split_lines(F.lit("a\r\nb\rc\n"))) == ["a", "b", "c"]
    assert one(spark, tx.split_lines(F.lit(""))) == []
    assert one(spark, tx.token_estimate(F.lit("abc"))) == 1 and one(spark, tx.token_estimate(F.lit("a" * 41))) == 10
    assert one(spark, tx.module_name(F.lit("a/b/__init__.py"))) == "a.b" and one(spark, tx.module_name(F.lit("__init__.py"))) is None
    assert one(spark, tx.last_code_fence(F.lit("x\n```python\na\n```\ny\n```\n b \n```\n```open"))) == "b"
    assert one(spark, tx.last_code_fence(F.lit("```\nopen"))) is None
    assert one(spark, tx.retry_delay(F.lit("Retry in 2.5s"))) == 2.5
    assert one(spark, tx.shortened(F.lit("a" * 40))) == "..." + "a" * 25


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["_flip", "_rot90_2", "_copy", "_12", " (3)", "x", "_aug1", "_"]), max_size=6))
def test_copy_suffixes_equal_the_loop(spark_session_holder, parts):
    stem = "leaf" + "".join(parts)
    want = stem
    while True:
        cut = want
        for p in tx.COPY_SUFFIXES:
            cut = re.sub(f"{p}$", "", cut)
        if cut == want:
            break
        want = cut
    assert re.sub(tx.COPY_SUFFIX, "", stem) == want


@pytest.fixture(scope="module")
def spark_session_holder():
    return None


def test_vector_functions(spark):
    v = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    assert one(spark, vx.argmax(v)) == 1 and abs(sum(one(spark, vx.softmax(v))) - 1) < 1e-12
    assert one(spark, vx.boosted(F.lit(0.6), F.lit(True), F.lit(True))) == pytest.approx(0.85)
    assert one(spark, F.array(*vx.padded_box(F.lit(0.0), F.lit(0.5), F.lit(0.2), F.lit(0.2), F.lit(100.0), F.lit(100.0)))) == [0, 39, 11, 61]


CODE = {
    "a/x.py": "import torch\ntorch.backends.cudnn.enabled = True\nx = 'CUDA_VISIBLE_DEVICES'\n# import cupy\n",
    "a/y.py": "from a import x\nimport pycuda.driver as cuda, cupy\n\ndef f():\n    cudaMalloc(1)\n",
    "a/bad.py": "def broken(:\n    <<<\n",
    "k.cu": "#include <cuda_runtime.h>\n__global__ void k() {}\ncudaStream_t s; cub::A; cub::B;\nk<<<1, 2>>>();\n",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(list(CODE.items()), "path string, text string").cache()


def test_tags_of_lines(sources):
    got = {(r.path, r.line, r.symbol, r.category) for r in code.tag_lines(code.explode_lines(sources)).collect()}
    assert got == {
        ("k.cu", 1, "#include <cuda_runtime.h>", "cuda_c_header"),
        ("k.cu", 2, "__global__", "cuda_c_qualifier"),
        ("k.cu", 3, "cudaStream_t", "cuda_c_type"),
        ("k.cu", 3, "cub::A", "api_call"),
        ("k.cu", 3, "cub::B", "api_call"),
        ("k.cu", 4, "<<<...>>>", "api_call"),
    }


def test_usages_of_syntax_trees(sources):
    got = sorted((r.path, r.line, r.category, r.symbol) for r in syntax.usages(sources).collect())
    assert got == [
        ("a/x.py", 2, "backend", "torch.backends.cudnn"),
        ("a/x.py", 2, "backend", "torch.backends.cudnn.enabled"),
        ("a/x.py", 3, "env_var", "CUDA_VISIBLE_DEVICES"),
        ("a/y.py", 2, "import", "cupy"),
        ("a/y.py", 2, "import", "pycuda.driver"),
        ("a/y.py", 5, "api_call", "cudaMalloc"),
    ]


def test_rewrite_takes_one_edit_a_line_and_is_idempotent(spark, sources):
    statements = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rules.STATEMENTS)], "ord int, key string, replacement string")

    def rewritten(source):
        lines = code.explode_lines(source)
        hits = code.first_contained(lines, statements).withColumn("phase", F.lit(1)).withColumn("ord", F.lit(0)).withColumn("new_text", F.col("replacement"))
        variables = lines.withColumn("new_text", code.replace_in_order(F.col("line_text"), list(rules.VARIABLES))).filter("new_text <> line_text").withColumn("phase", F.lit(3)).withColumn("ord", F.lit(0))
        edits = code.one_edit_a_line(hits.select("path", "line", "phase", "ord", "new_text").unionByName(variables.select("path", "line", "phase", "ord", "new_text")), ["path", "line"])
        return code.rebuilt(lines, edits, "path")

    first = rewritten(sources)
    got = {r.path: r.text for r in first.collect()}
    assert got["a/x.py"].split("\n") == ["import torch", "torch.backends.miopen.enabled = True", "x = 'HIP_VISIBLE_DEVICES'", "# import cupy"]
    assert {r.path: r.text for r in rewritten(first).collect()} == got


def test_rules_and_versions(spark):
    table = rules.rules(spark)
    names = {r.symbol: r for r in table.collect()}
    assert names["cudaMalloc"].replacement == "hipMalloc" and names["cudaErrorMemoryAllocation"].replacement == "hipErrorOutOfMemory" and names["cudaCreateSurfaceObject"].confidence == 0.6
    assert table.count() == len(names) and all(0 < r.confidence <= 1 for r in names.values())
    notes = spark.createDataFrame([("a", ""), ("b", "ROCm 6.0+"), ("c", "ROCm 5.5+")], "symbol string, notes string")
    assert {r.symbol for r in rules.for_version(notes, "5.10").collect()} == {"a", "c"} and rules.for_version(notes, "x").count() == 3
    status = {r.symbol: (r.reason, r.confidence) for r in code.lookup(spark.createDataFrame([("cudaMalloc",), ("cudaCreateSurfaceObject",), ("<<<...>>>",), ("nope",)], "symbol string"), table).collect()}
    assert status == {"cudaMalloc": (None, 1.0), "cudaCreateSurfaceObject": ("Low confidence mapping", 0.6), "<<<...>>>": ("Kernel launch", 0.3), "nope": ("Unknown API", 0.4)}


def test_chunks_rebuild_their_text(spark, sources):
    parts = syntax.chunks(sources, 30)
    assert {r.path: r.text for r in syntax.reassembled(parts).collect()} == CODE
    got = {(r.path, r.name, r.kind) for r in parts.collect()}
    assert ("a/y.py", "f", "function") in got


def test_diff(sources):
    r = {x.path: x.d for x in sources.select("path", syntax.unified_diff(F.col("text"), F.replace("text", F.lit("cudnn"), F.lit("miopen")), F.col("path")).alias("d")).collect()}
    assert "-torch.backends.cudnn.enabled = True\n+torch.backends.miopen.enabled = True" in r["a/x.py"] and r["k.cu"] == ""


def test_imports_and_levels(spark):
    rows = [("p/__init__.py", "p", "from . import a\n"), ("p/a.py", "p.a", "from .b import f\nimport os\n"), ("p/b.py", "p.b", ""), ("p/bad.py", "p.bad", "x(")]
    table = spark.createDataFrame(rows, "path string, module string, text string")
    edges = syntax.imports(table)
    assert {("p.a", "p.b"), ("p", "p.a")} <= {tuple(r) for r in edges.collect()}
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/tidemill-tests")
    got = dict(tuple(r) for r in graph.levels(table.select("module"), edges).collect())
    assert got == {"p.b": 0, "p.bad": 0, "p.a": 1, "p": -1} or got == {"p.b": 0, "p.bad": 0, "p.a": 1, "p": 2}


def test_scores_checklist_and_audit(spark):
    rows = [("a", 3, "x", 0.4, "Unknown API"), ("a", 1, "y", 1.0, None), ("b", 2, "z", 0.6, "r")]
    scored = spark.createDataFrame(rows, "path string, line int, original string, confidence double, reason string")
    s = {r.path: r for r in code.scores(scored, "path").collect()}
    assert (s["a"].high, s["a"].low, s["a"].total, s["a"].score) == (1, 1, 2, 0.7) and s["b"].needs_review == 1
    assert {r.path: r.checklist for r in code.checklist(scored, "path").collect()}["a"] == "- [ ] line 3: x (0.40)"
    assert {r.path: (r.applied_count, r.remaining_count) for r in incremental.audit_rows(scored).collect()} == {"a": (1, 1), "b": (0, 1)}
    assert [one(spark, code.reason_confidence(F.lit(x))) for x in ("Kernel launch low confidence", "Needs LLM review", "?")] == [0.3, 0.6, 0.5]


def test_incremental(spark, sources):
    manifest = sources.filter("path <> 'k.cu'").select("path", tx.cache_key(F.col("text"), F.lit("b|r1")).alias("source_hash"))
    assert [r.path for r in incremental.changed(sources, manifest, "b", "r1").collect()] == ["k.cu"]
    assert incremental.changed(sources, manifest, "b", "r2").count() == len(CODE)
    done = incremental.changed(sources, manifest, "b", "r1")
    assert incremental.upserted(manifest, done).count() == len(CODE)


def test_splits_do_not_leak(spark):
    rows = spark.createDataFrame([(i, f"g{i % 40}", f"c{i % 3}") for i in range(600)], "id int, g string, label string")
    split = dataset.stratified_split(rows, "id", "label", 1)
    assert {tuple(r) for r in split.groupBy("label", "split").count().collect()} == {(f"c{c}", s, n) for c in range(3) for s, n in (("train", 160), ("val", 20), ("test", 20))}
    assert dataset.leaks(dataset.hashed_split(rows, "g", 1), "g").isEmpty() and dataset.leaks(dataset.entity_split(rows, "g", "label", 1), "g").isEmpty()
    assert sorted(map(str, split.collect())) == sorted(map(str, dataset.stratified_split(rows, "id", "label", 1).collect()))


def test_metrics_by_hand(spark):
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    r = {x.label: x for x in metrics.class_report(preds).collect()}
    assert r[0].precision == 1 and r[0].recall == 0.5 and r[1].precision == pytest.approx(1 / 3) and r[2].f1 == 0
    s = metrics.summary(preds).first()
    assert s.accuracy == 0.5 and s.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert metrics.confusion(preds).count() == 9


def test_sources(spark, tmp_path):
    for name, text in CODE.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    (tmp_path / "src" / "note.txt").write_text("no")
    read = files.source_files(spark, str(tmp_path / "src"))
    assert read.count() == len(CODE) and {r.suffix for r in read.collect()} == {".py", ".cu"}
    assert files.selected(read, "*.py", "bad*").count() == 3
    with pytest.raises(ValueError):
        files.source_files(spark, "x.txt")
    log = tmp_path / "audit.json"
    log.write_text(json.dumps({"file": "a", "epoch": 1.0}) + "\n\nnot json\n" + json.dumps({"file": "b"}) + "\n")
    assert {r.file for r in files.audit_log(spark, str(log)).collect()} == {"a", "b"}
    box = [one(spark, files.yolo_box(F.lit(x))) for x in ("1 0.5 0.5 0.1 0.2", "1 0.5 0.5 0.1", "1 a 0.5 0.1 0.2")]
    assert box[0].h == 0.2 and box[1] is None and box[2] is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_v1.py").write_text("one\n")

    def step():
        stream = watch.file_versions(spark, str(tmp_path / "in"))
        watch.on_each_batch(stream, lambda b: b.select("path", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert step() == 1
    (tmp_path / "in" / "a_v2.py").write_text("two\n")
    assert step() == 2


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:0{s}") for s in (0, 1, 2, 3)] + [(2, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:05")]
    events = spark.createDataFrame(rows, "k long, s string").select("k", F.col("s").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "ev"))
    q = watch.debounced_stream(stream, "k", "ts").writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.k, str(r.ts)[-2:]) for r in spark.table("debounced").collect())
    assert got == [(1, "00"), (1, "02"), (1, "05"), (2, "01")]
    batch = incremental.debounced(events, ["k"], "ts", "id") if "id" in events.columns else None
    assert batch is None


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert out.returncode == 0 and int(out.stdout.split()[0]) >= 60, out.stderr


def test_folds_hold_no_group(spark):
    import random

    from tidemill.operators import code, incremental

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, *range(1, 60)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, t long").repartition(5)
    want, kept = {}, set()
    last = {}
    for g, o, t in rows:
        used, taken = want.get(g, (0, 0))
        want[g] = (used + t, taken + 1) if t is not None and used + t <= 500 else (used, taken)
        if g not in last or o * 7 - last[g] >= 20:
            last[g] = o * 7
            kept.add((g, o))
    budget = code.greedy_budget(df, ["g"], "o", "t", 500)
    events = incremental.debounced(df.selectExpr("g", "o", "timestamp_seconds(o * 7) ts"), ["g"], "ts", "o", 20)
    assert {x.g: (x.used, x.taken) for x in budget.collect()} == want
    got = [tuple(x) for x in events.collect()]
    assert set(got) == kept and len(got) == len(kept)
    for df in (budget, events):
        assert "collect_list" not in df._jdf.queryExecution().toString()


def test_levels_have_no_limit():
    import inspect

    from tidemill.operators import graph

    # a chain of a thousand modules takes a thousand rounds, so only the cap's absence is tested
    assert list(inspect.signature(graph.levels).parameters) == ["vertices", "edges"] and "range(" not in inspect.getsource(graph.levels)
