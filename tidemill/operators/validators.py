"""Validators of rewritten source, and the quality report of a file; both work in the row of a line or of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.code import reason_confidence

#: Fixed values: (validator, severity, pattern, message, suggestion, whether only the part before a ``#`` counts).
LINE_RULES = (
    ("No cuDNN references", "ERROR", r"\bcudnn\b", "cuDNN reference found", "Replace torch.backends.cudnn with torch.backends.miopen", True),
    ("Device string validation", "ERROR", r"""torch\.device\(\s*["']rocm""", 'Wrong device string "rocm"', 'Use "cuda" on ROCm — PyTorch HIP backend uses "cuda" as the device string', False),
    ("Device string validation", "ERROR", r"""torch\.device\(\s*["']hip""", 'Wrong device string "hip"', 'Use "cuda" on ROCm — PyTorch HIP backend uses "cuda" as the device string', False),
    ("Device string validation", "ERROR", r"""\.to\(\s*["']rocm""", 'Wrong device string "rocm"', 'Use "cuda" on ROCm — PyTorch HIP backend uses "cuda" as the device string', False),
    ("Device string validation", "ERROR", r"""\.to\(\s*["']hip""", 'Wrong device string "hip"', 'Use "cuda" on ROCm — PyTorch HIP backend uses "cuda" as the device string', False),
    ("Environment variable validation", "ERROR", "CUDA_VISIBLE_DEVICES", "CUDA env var 'CUDA_VISIBLE_DEVICES' still present", "Replace with HIP_VISIBLE_DEVICES", True),
    ("Environment variable validation", "ERROR", "CUDA_LAUNCH_BLOCKING", "CUDA env var 'CUDA_LAUNCH_BLOCKING' still present", "Replace with HIP_LAUNCH_BLOCKING", True),
    ("Environment variable validation", "ERROR", "CUDA_DEVICE_ORDER", "CUDA env var 'CUDA_DEVICE_ORDER' still present", "Replace with HIP_DEVICE_ORDER", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipCtxCreate\b", "hipCtxCreate is deprecated in ROCm 6.0+ — use hipSetDevice instead", "Update to the recommended API", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipCtxDestroy\b", "hipCtxDestroy is deprecated in ROCm 6.0+ — contexts are implicit", "Update to the recommended API", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipCtxSetCurrent\b", "hipCtxSetCurrent is deprecated — use hipSetDevice", "Update to the recommended API", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipCtxGetCurrent\b", "hipCtxGetCurrent is deprecated — use hipGetDevice", "Update to the recommended API", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipCtxSynchronize\b", "hipCtxSynchronize is deprecated — use hipDeviceSynchronize", "Update to the recommended API", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipMemcpyHtoD\b", "hipMemcpyHtoD is driver API — prefer hipMemcpy with hipMemcpyHostToDevice", "Update to the recommended API", True),
    ("Deprecated ROCm API check", "WARNING", r"\bhipMemcpyDtoH\b", "hipMemcpyDtoH is driver API — prefer hipMemcpy with hipMemcpyDeviceToHost", "Update to the recommended API", True),
)
#: Parts of module names that must not be imported.
VENDOR_MODULES = ("pycuda", "tensorrt")
#: What an agent's attempt and a passed validation add to the confidence of an issue, and how far.
ATTEMPTED, VALIDATED, AT_MOST = 0.15, 0.1, 0.95
RESOLVED, HANDLED, OPEN = "(resolved by LLM agent)", "(handled by LLM agent)", "(needs manual review)"


def line_issues(lines: DataFrame, text: str = "line_text") -> DataFrame:
    """A row (validator, severity, message, suggestion) for each rule that a line breaks; comment lines break none."""
    line = F.col(text)
    code = F.substring_index(line, "#", 1)
    found = []
    for validator, severity, pattern, message, suggestion, before in LINE_RULES:
        told = F.concat(F.lit(f"{message}: "), F.btrim(line, F.lit(" \t\r\n\f\x0b"))) if validator.startswith("No cuDNN") else F.lit(message)
        issue = F.struct(F.lit(validator).alias("validator"), F.lit(severity).alias("severity"), told.alias("message"), F.lit(suggestion).alias("suggestion"))
        found.append(F.when((code if before else line).rlike(pattern), issue))
    hits = F.when(line.rlike(r"^\s*#"), F.array().cast("array<struct<validator:string,severity:string,message:string,suggestion:string>>")).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return lines.withColumn("_i", F.explode(hits)).select(*lines.columns, "_i.*")


def import_issues(imported: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Issues of imports (path, line, module, whole: whether the statement is ``import``) and of files that have no syntax tree (path)."""
    bad = F.array(*[F.lit(m) for m in VENDOR_MODULES])
    rows = imported.withColumn("_bad", F.explode(F.filter(bad, lambda m: F.contains(F.lower("module"), m))))
    quoted = F.when(F.col("whole"), F.col("module")).otherwise(F.concat(F.lit("from "), F.col("module")))
    advice = F.when(F.col("whole"), "Replace with ROCm equivalent (e.g., hip, migraphx)").otherwise("Replace with ROCm equivalent")
    found = rows.select("path", "line", F.concat(F.lit("CUDA-only import '"), quoted, F.lit("' still present")).alias("message"), advice.alias("suggestion"))
    broken = unparsed.select("path", F.lit(0).alias("line"), F.lit("Code has syntax errors — cannot validate imports").alias("message"), F.lit("").alias("suggestion"))
    return found.unionByName(broken).withColumns({"validator": F.lit("Import validation"), "severity": F.lit("ERROR")})


def quality_report(files: DataFrame, text: str = "new_text", agent: Column | bool = False, validated: Column | bool = False) -> DataFrame:
    """Add ``changes``: what was applied, and what was left with the confidence that it is settled by now.

    ``files`` has ``applied`` and ``remaining`` as ``migrated_files`` gives them.  An issue whose symbol is gone from the text after
    a passed validation of an agent's work is resolved.
    """
    agent, validated = (x if isinstance(x, Column) else F.lit(x) for x in (agent, validated))
    kept = F.transform("applied", lambda x: F.struct(x["line"].alias("line"), x["original"].alias("original"), x["replacement"].alias("replacement"), x["rule"].alias("rule"), x["confidence"].alias("confidence"), F.lit("rule").alias("source")))

    def left(x: Column) -> Column:
        base = reason_confidence(x["reason"])
        base = F.when(agent, F.least(base + ATTEMPTED, F.lit(AT_MOST))).otherwise(base)
        base = F.when(validated, F.least(base + VALIDATED, F.lit(AT_MOST))).otherwise(base)
        gone = agent & validated & (F.length(F.coalesce(text, F.lit(""))) > 0) & (x["symbol"] != "") & ~F.contains(F.col(text), x["symbol"])
        said = F.when(gone, RESOLVED).when(agent, HANDLED).otherwise(OPEN)
        return F.struct(x["line"].alias("line"), x["symbol"].alias("original"), said.alias("replacement"), x["reason"].alias("rule"), F.when(gone, 1.0).otherwise(base).alias("confidence"), F.when(agent, "agent").otherwise("unfixed").alias("source"))

    return files.withColumn("changes", F.concat(kept, F.transform("remaining", left)))


def levels_of(changes: Column) -> dict[str, Column]:
    """Counts by level and the mean confidence, 1 without changes."""
    sure = lambda low, high: F.size(F.filter(changes, lambda x: (x["confidence"] >= low) & (x["confidence"] < high)))
    total = F.aggregate(changes, F.lit(0.0), lambda s, x: s + x["confidence"])
    return {"high": sure(0.9, 9.0), "needs_review": sure(0.5, 0.9), "low": sure(-1.0, 0.5), "total": F.size(changes), "score": F.when(F.size(changes) > 0, total / F.size(changes)).otherwise(1.0)}
