"""Validators and the quality report by hand."""

from pyspark.sql import functions as F

from tidemill.operators import ccode, syntax, validators
from tidemill.plans import rules as rl


def test_line_issues(spark):
    lines = ["x.cudnn = 1", "# cudnn", "  # hipCtxCreate", "y  # cudnn CUDA_VISIBLE_DEVICES", "mycudnnx", 'a.to( "hip")  # torch.device("rocm")', "os.environ['CUDA_DEVICE_ORDER'], CUDA_LAUNCH_BLOCKING", "hipCtxCreatex hipCtxDestroy", "", None]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "path string, line int, line_text string")
    got = sorted((r.line, r.severity, r.message.split(" still")[0]) for r in validators.line_issues(rows).collect())
    assert got == [
        (0, "ERROR", "cuDNN reference found: x.cudnn = 1"), (5, "ERROR", 'Wrong device string "hip"'), (5, "ERROR", 'Wrong device string "rocm"'),
        (6, "ERROR", "CUDA env var 'CUDA_DEVICE_ORDER'"), (6, "ERROR", "CUDA env var 'CUDA_LAUNCH_BLOCKING'"),
        (7, "WARNING", "hipCtxDestroy is deprecated in ROCm 6.0+ — contexts are implicit"),
    ]


def test_import_issues(spark):
    files = [("a", "import os, pycuda.driver, PyCUDA\nfrom tensorrt.x import y\nfrom . import z\n"), ("b", "def ("), ("c", None), ("d", "(" * 3000)]
    out = validators.import_issues(*syntax.imported(spark.createDataFrame(files, "path string, text string"))).collect()
    assert sorted((r.path, r.line, r.message[:40]) for r in out) == [
        ("a", 1, "CUDA-only import 'PyCUDA' still present"), ("a", 1, "CUDA-only import 'pycuda.driver' still p"), ("a", 2, "CUDA-only import 'from tensorrt.x' still"),
        ("b", 0, "Code has syntax errors — cannot validate"), ("d", 0, "Code has syntax errors — cannot validate"),
    ]


def test_quality_report(spark):
    each = ccode.steps(rl.HEADERS, rl.CUB_HEADERS, rl.TYPES, rl.C_SYMBOLS)
    files = ccode.migrated_files(spark.createDataFrame([(i, "cudaMalloc(x)\ncudaNew()\nk<<<g>>>(x);" if i < 4 else "") for i in range(5)], "id int, text string"), each)
    files = files.withColumn("new_text", F.when(F.col("id") == 3, F.replace("new_text", F.lit("cudaNew"), F.lit("hipNew"))).otherwise(F.col("new_text")))
    out = validators.quality_report(files, agent=F.col("id") > 0, validated=F.col("id") > 1)
    rows = {r.id: r for r in out.select("id", "changes", *[c.alias(n) for n, c in validators.levels_of(F.col("changes")).items()]).collect()}
    assert [(c.confidence, c.source, c.replacement) for c in rows[0].changes] == [(1.0, "rule", "hipMalloc(x)"), (0.5, "unfixed", validators.OPEN), (0.3, "unfixed", validators.OPEN)]
    assert [round(c.confidence, 3) for c in rows[1].changes] == [1.0, 0.65, 0.45] and rows[1].changes[1].replacement == validators.HANDLED
    assert [round(c.confidence, 3) for c in rows[2].changes] == [1.0, 0.75, 1.0]  # no text holds the sign of a launch itself
    assert [c.confidence for c in rows[3].changes] == [1.0, 1.0, 1.0] and rows[3].changes[1].replacement == validators.RESOLVED
    assert (rows[4].score, rows[4].total) == (1.0, 0) and (rows[0].high, rows[0].needs_review, rows[0].low) == (1, 1, 1)
