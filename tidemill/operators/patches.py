"""Differences of texts by lines, as hunks, and texts from hunks.

Lines that stand once in both texts are anchors; the longest run of anchors in one order cuts the texts into pieces that
are compared in the same way, after the lines that they share at both ends.  One text pair is compared in its row; hunks are
rows, and texts are put together from hunks by column functions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNK = "hunk int, old_start int, old_count int, new_start int, new_count int, lines array<string>"


def _anchors(a: list[str], b: list[str], al: int, ah: int, bl: int, bh: int) -> list[tuple[int, int]]:
    once = lambda x, lo, hi: {k for k, n in Counter(x[lo:hi]).items() if n == 1}
    both = once(a, al, ah) & once(b, bl, bh)
    at = {b[j]: j for j in range(bl, bh) if b[j] in both}
    pairs = [(i, at[a[i]]) for i in range(al, ah) if a[i] in both]
    tops: list[int] = []  # least last place in b of a run of each length
    index: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = index[p - 1] if p else -1
        tops[p : p + 1], index[p : p + 1] = [j], [k]
    out, k = [], index[-1] if index else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, in the order of both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al < ah and bl < bh:
            cuts = _anchors(a, b, al, ah, bl, bh)
            out += cuts
            for (i, j), (k, m) in zip([(al - 1, bl - 1), *cuts], [*cuts, (ah, bh)], strict=True):
                if cuts:
                    todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def _hunks(a: list[str], b: list[str], context: int) -> Iterator[tuple[int, int, int, int, list[str]]]:
    steps, at = [], (0, 0)  # changes (old from, old to, new from, new to)
    for i, j in [*matches(a, b), (len(a), len(b))]:
        if (i, j) != at:
            steps.append((at[0], i, at[1], j))
        at = i + 1, j + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for s in steps:
        if groups and s[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(s)
        else:
            groups.append([s])
    for g in groups:
        lo, lines, at = max(0, g[0][0] - context), [], max(0, g[0][0] - context)
        for al, ah, bl, bh in g:
            lines += [f" {x}" for x in a[at:al]] + [f"-{x}" for x in a[al:ah]] + [f"+{x}" for x in b[bl:bh]]
            at = ah
        hi = min(len(a), at + context)
        lines += [f" {x}" for x in a[at:hi]]
        new = g[0][2] - (g[0][0] - lo)
        yield lo, hi - lo, new, sum(not x.startswith("-") for x in lines), lines


def hunks(texts: DataFrame, key: list[str], old: str, new: str, context: int = 3) -> DataFrame:
    """(key, hunk, old_start, old_count, new_start, new_count, lines): what turns ``old`` into ``new``, lines counted from 0; equal texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (x, y) in enumerate(zip(b.column("_old").to_pylist(), b.column("_new").to_pylist(), strict=True)):
                if x != y:
                    found = [(n, *h) for n, h in enumerate(_hunks((x or "").split("\n"), (y or "").split("\n"), context))]
                    at += [i] * len(found)
                    rows += found
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32()] * 5 + [pa.list_(pa.string())], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in key), *columns], [*key, *(x.split()[0] for x in HUNK.split(", "))])

    fields = [T.StructField(f.name, f.dataType) for f in texts.select(*key).schema.fields]
    rows = texts.select(*key, F.col(old).alias("_old"), F.col(new).alias("_new"))
    return rows.mapInArrow(run, T.StructType([*fields, *T._parse_datatype_string(HUNK).fields]))


def patched(texts: DataFrame, found: DataFrame, key: list[str], old: str) -> DataFrame:
    """``texts`` with ``patched``: the old text after its hunks."""
    names = [x.split()[0] for x in HUNK.split(", ")]
    rows = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_hunks"))
    lines = F.split(F.coalesce(old, F.lit("")), "\n", -1)

    def apply(s: Column, h: Column) -> Column:
        new = F.transform(F.filter(h["lines"], lambda x: ~F.startswith(x, F.lit("-"))), lambda x: F.substring(x, 2, 2**31 - 1))
        return F.struct((h["old_start"] + h["old_count"]).alias("at"), F.concat(s["out"], F.slice(F.col("_lines"), s["at"] + 1, h["old_start"] - s["at"]), new).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda s: F.concat(s["out"], F.slice(F.col("_lines"), s["at"] + 1, F.size("_lines")))
    out = texts.join(rows, key, "left").withColumn("_lines", lines)
    whole = F.when(F.col("_hunks").isNull(), F.col(old)).otherwise(F.array_join(F.aggregate("_hunks", start, apply, end), "\n"))
    return out.withColumn("patched", whole).drop("_lines", "_hunks")


def rendered(found: DataFrame, key: list[str], name: Column) -> DataFrame:
    """(key, diff): the hunks of a text as a unified diff, under the names ``a/name`` and ``b/name``."""
    span = lambda at, n: F.concat(F.when(F.col(n) == 0, F.col(at)).otherwise(F.col(at) + 1).cast("string"), F.when(F.col(n) == 1, "").otherwise(F.concat(F.lit(","), F.col(n).cast("string"))))
    head = F.concat(F.lit("@@ -"), span("old_start", "old_count"), F.lit(" +"), span("new_start", "new_count"), F.lit(" @@"))
    body = F.struct("hunk", F.concat(head, F.lit("\n"), F.array_join("lines", "\n")).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["text"]), "\n")
    return found.groupBy(*key).agg(whole.alias("_text")).select(*key, F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), "_text").alias("diff"))
