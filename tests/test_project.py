"""Guards, reports, the order of files and the rewrite of whole files."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import checks, reports
from tidemill.functions import text as tx
from tidemill.operators import code, dataset, migrate, project
from tidemill.plans import rules


def test_guards():
    assert checks.require_version("6.0") == "6.0" and checks.require_version("6.0.1") == "6.0.1" and checks.require_output("json") == "json"
    assert checks.require_shares(0.8, 0.1, 0.1) == pytest.approx(0.5)
    for f, x in ((checks.require_version, ("six",)), (checks.require_output, ("pdf",)), (checks.require_shares, (0.8, 0.1, 0.2))):
        with pytest.raises(ValueError):
            f(*x)


def test_labels_and_profiles(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), (None, None)], "label string, tags array<string>")
    known = spark.createDataFrame([("a",), ("c",)], "label string")
    with pytest.raises(ValueError, match="unknown label: b"):
        dataset.require_known(rows.filter("label is not null"), known, "label")
    assert [r.label for r in dataset.without_samples(known, rows, "label").collect()] == ["c"]
    assert {(r.label, r.label_idx) for r in dataset.with_label_index(rows, "label").collect()} == {("a", 0), ("b", 1), (None, None)}
    assert [r.label for r in project.with_profile(rows, "tags", ["y", "q"]).collect()] == ["a"]
    with pytest.raises(ValueError):
        project.with_profile(rows, "tags", ["q"])


def test_places_number_rows_over_many_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 501).alias("k"), "id").repartition(7)
    got = project.places(rows, "k", "id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501)) and [r.k for r in got] == sorted(r.k for r in got)
    assert project.places(rows.limit(0), "k").collect() == []


def test_text_and_report_expressions(spark):
    one = spark.createDataFrame([("a the b\nthe the", "x{\n{\"k\": 2}\n{bad\nend", "dir/file.tar")], "t string, j string, p string")
    r = one.select(
        tx.match_starts(F.col("t"), "the").alias("m"), tx.line_of(F.col("j"), F.lit("end")).alias("l"), tx.last_json_line(F.col("j")).alias("j"),
        tx.stem(F.col("p")).alias("s"), reports.first_lines(F.col("j"), 2).alias("f"), reports.last_lines(F.col("j"), 3).alias("e"),
        reports.change_prompt("Do:", F.array(F.struct(F.lit("a'b").alias("old"), F.lit("c").alias("new")))).alias("q"),
        F.array(*reports.padded(F.lit(10), F.lit(20), 0.5, 0, 22)).alias("b"), reports.backoff(F.lit(2), F.lit(100)).alias("w"),
    ).first()
    assert r.m == [2, 8, 12] and r.l == 4 and r.j == '{"k": 2}' and r.s == "file" and r.f == 'x{\n{"k": 2}\n... 2 more lines omitted'
    assert r.e == '{"k": 2}\n{bad\nend' and r.q == "Do:\n- 'a\\'b' -> 'c'" and r.b == [5, 22] and r.w == 101


def test_files_are_rewritten_by_phases(spark):
    text = "import pycuda.driver\nx = 1\n    torch.backends.cudnn.enabled = True\nenv = 'CUDA_VISIBLE_DEVICES'\ncudaMalloc(cudaFoo)\nk<<<1>>>()\ncudnn\ntorch.cuda.nvtx\ncudaCreateTextureObject()"
    lines = code.explode_lines(spark.createDataFrame([("f.py", text)], "path string, text string"))
    found = [
        (1, 0, "import", "pycuda.driver", False), (3, 1, "backend", "torch.backends.cudnn", False), (4, 2, "env_var", "CUDA_VISIBLE_DEVICES", False),
        (5, 3, "api_call", "cudaFoo", False), (5, 4, "api_call", "cudaMalloc", False), (5, 5, "attribute", "x", False), (6, 6, "api_call", "<<<...>>>", False),
        (7, 7, "backend", "cudnn", False), (8, 8, "attribute", "torch.cuda.nvtx", False), (9, 9, "api_call", "cudaCreateTextureObject", False),
        (2, 10, "api_call", "cudaFree", True), (99, 11, "attribute", "y", False),
    ]
    usages = spark.createDataFrame([("f.py", *u) for u in found], "path string, line int, ord int, category string, symbol string, false_positive boolean")
    texts, applied, remaining = migrate.migrated(lines, usages, rules.rules(spark), rules.STATEMENTS, rules.IMPORTS, rules.VARIABLES)
    new = {r.line: r.line_text for r in texts.collect()}
    assert new[1] == "import hip.driver  # pycuda has no direct ROCm port; use hip-python" and new[2] == "x = 1"
    assert new[3] == "    torch.backends.miopen.enabled = True" and new[4] == "env = 'HIP_VISIBLE_DEVICES'" and new[5] == "hipMalloc(cudaFoo)"
    assert {(r.line, r.confidence) for r in applied.collect()} == {(1, 0.95), (3, 1.0), (4, 1.0), (5, 1.0)}
    left = {(r.line, r.symbol): (r.reason, r.confidence) for r in remaining.collect()}
    assert set(left) == {(5, "cudaFoo"), (6, "<<<...>>>"), (7, "cudnn"), (8, "torch.cuda.nvtx"), (9, "cudaCreateTextureObject")}
    assert left[(9, "cudaCreateTextureObject")] == ("Low confidence (0.8) — needs LLM review", 0.8) and left[(6, "<<<...>>>")][1] == 0.3
    again, applied, _ = migrate.migrated(texts, usages.filter("category = 'import'"), rules.rules(spark), rules.STATEMENTS, rules.IMPORTS, rules.VARIABLES)
    assert applied.count() == 0
    said = code.decided(spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "line int, line_text string, new_text string"), spark.createDataFrame([(1, "reject")], "line int, decision string"), ["line"])
    assert {(r.line, r.final) for r in said.collect()} == {(1, "a"), (2, "b")}


def test_scores_of_files_without_changes(spark):
    scored = spark.createDataFrame([("a", 0.4), ("a", 1.0)], "path string, confidence double")
    got = {r.path: (r.total, r.score) for r in code.scores(scored, "path", spark.createDataFrame([("a",), ("b",)], "path string")).collect()}
    assert got == {"a": (2, pytest.approx(0.7)), "b": (0, 1.0)}


def test_budget_stops_at_the_first_misfit(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1), ("h", 1, 2), ("h", 2, None)], "g string, o int, t int")
    assert {tuple(r) for r in code.budget_until_misfit(rows, ["g"], "o", "t", 10).collect()} == {("g", 5, 1), ("h", 2, 1)}
