"""Operators that need a syntax tree: imports, chunks and diffs of Python files, one file at a time inside Spark tasks."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.patterns import slices

#: Parts of module names that mark an import, in ``import`` and in ``from`` statements.
VENDOR_IMPORTS, VENDOR_FROM = ("pycuda", "cupy", "tensorrt", "cuda"), ("pycuda", "cupy", "tensorrt", "apex")
#: Environment variables that are tagged as whole strings.
VARIABLES = ("CUDA_VISIBLE_DEVICES", "CUDA_LAUNCH_BLOCKING", "CUDA_DEVICE_ORDER")

#: What a file that has no syntax tree raises; the last two come from deep nesting.
UNPARSABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) and parts else ""


def _usages(node: ast.AST) -> Iterator[tuple[str, str]]:
    if isinstance(node, ast.Import):
        yield from (("import", a.name) for a in node.names if any(v in a.name.lower() for v in VENDOR_IMPORTS))
    elif isinstance(node, ast.ImportFrom) and any(v in (node.module or "") for v in VENDOR_FROM):
        yield "import", node.module
    elif isinstance(node, ast.Attribute) and (name := _dotted(node)):
        if "cudnn" in name:
            yield "backend", name
        elif "torch.cuda.nvtx" in name or "torch.cuda.nccl" in name:
            yield "attribute", name
    elif isinstance(node, ast.Constant) and node.value in VARIABLES:
        yield "env_var", node.value
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id.startswith("cuda"):
        yield "api_call", node.func.id


def usages(files: DataFrame) -> DataFrame:
    """(path, line, col, category, symbol) of ``files`` (path, text); a file that does not parse has none."""

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f.path, f.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except UNPARSABLE:
                    continue
                out += [(path, n.lineno, n.col_offset, c, s) for n in ast.walk(tree) for c, s in _usages(n)]
            yield pd.DataFrame(out, columns=["path", "line", "col", "category", "symbol"])

    return files.select("path", "text").mapInPandas(tasks, "path string, line int, col int, category string, symbol string")


def imports(files: DataFrame) -> DataFrame:
    """(src, dst) between modules; relative imports are resolved against the package."""

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for module, package, text in zip(f.module, f.package, f.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except UNPARSABLE:
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.Import):
                        out += [(module, a.name) for a in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        root = package.split(".")[: len(package.split(".")) - n.level + 1] if n.level and package else []
                        base = ".".join([*root, *([n.module] if n.module else [])])
                        out += [(module, base)] if base else []
                        out += [(module, f"{base}.{a.name}".lstrip(".")) for a in n.names]
            yield pd.DataFrame(out, columns=["src", "dst"])

    package = F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), F.col("module")).otherwise(F.regexp_replace("module", r"\.?[^.]*$", ""))
    return files.select("module", package.alias("package"), "text").mapInPandas(tasks, "src string, dst string").distinct()


def _chunked(path: str, text: str, most: int) -> Iterator[tuple]:
    lines = text.split("\n")
    try:
        body = ast.parse(text).body
    except UNPARSABLE:
        body = []
    spans, at = [], 1
    for n in body:
        kind = {"FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class"}.get(type(n).__name__, "module")
        spans.append((getattr(n, "name", "module"), kind, at, n.end_lineno))
        at = n.end_lineno + 1
    if at <= len(lines):
        spans.append(("module", "module", at, len(lines)))
    for name, kind, a, b in spans:
        size = len("\n".join(lines[a - 1 : b]))
        step = max(1, most // max(1, size // max(1, b - a + 1))) if size > most else b - a + 1
        for i in range(a, b + 1, step):
            yield path, name, kind, i, min(i + step - 1, b), "\n".join(lines[i - 1 : min(i + step - 1, b)])


CHUNK = {"path": pa.string(), "name": pa.string(), "kind": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "source": pa.string()}


def _chunk_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Files by bounded bytes, so a task holds the texts and chunks of a slice, however many files a batch has."""
    for b in batches:
        for part in slices(b, "text"):
            rows = [r for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist(), strict=True) for r in _chunked(path, text or "", most)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), CHUNK.values(), strict=True)], list(CHUNK))


def chunks(files: DataFrame, most: int = 4000) -> DataFrame:
    """(path, name, kind, start_line, end_line, source): top-level nodes, too long ones cut by lines; gap lines belong to the node after them."""
    schema = "path string, name string, kind string, start_line int, end_line int, source string"
    return files.select("path", "text").mapInArrow(lambda batches: _chunk_batches(batches, most), schema)


def reassembled(parts: DataFrame) -> DataFrame:
    """The text of each path from its chunks, keyed by their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "source")))
    return parts.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: p["source"]), "\n").alias("text"))


def unified_diff(old: Column, new: Column, path: Column) -> Column:
    """The unified diff of two texts."""

    def diff(old: pd.Series, new: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for a, b, p in zip(old, new, path, strict=True)])

    return F.pandas_udf(diff, "string")(old, new, path)


def imported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, line, module, whole) of the import statements of ``files`` (path, text), and the paths of files without a syntax tree."""

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in zip(f.path, f.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except UNPARSABLE:
                    out.append((path, 0, None, None))
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.Import):
                        out += [(path, n.lineno, a.name, True) for a in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        out.append((path, n.lineno, n.module or "", False))
            yield pd.DataFrame(out, columns=["path", "line", "module", "whole"])

    rows = files.select("path", "text").mapInPandas(tasks, "path string, line int, module string, whole boolean")
    return rows.filter("module is not null"), rows.filter("module is null").select("path")
