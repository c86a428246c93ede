"""Column expressions for reports, previews and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.checks import require_output


def first_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines, and how many more there are."""
    lines = F.split(text, "\n")
    more = F.when(F.size(lines) > n, F.concat(F.lit("\n... "), (F.size(lines) - n).cast("string"), F.lit(" more lines omitted"))).otherwise("")
    return F.concat(F.array_join(F.slice(lines, 1, n), "\n"), more)


def last_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), F.lit(n)), "\n")


def furthest(a: Column, b: Column) -> Column:
    """The greatest absolute difference of a group."""
    return F.max(F.abs(a - b))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low).cast("long"), F.least(x.cast("long"), F.lit(high).cast("long")))


def padded(lo: Column, hi: Column, share: float, low: int, high: int) -> tuple[Column, Column]:
    """An interval widened by a share of its length on both sides, within bounds."""
    pad = F.floor((hi - lo) * F.lit(share))
    return clamp(lo - pad, low, high), clamp(hi + pad, low, high)


def backoff(attempt: Column, asked: Column, base: float = 15.0) -> Column:
    """Seconds to wait: doubled with each attempt, and one more than what was asked for at least."""
    return F.greatest(asked + F.lit(1.0), F.lit(base) * F.pow(F.lit(2.0), attempt))


def from_map(key: Column, values: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def labels_by_index(index: Column) -> Column:
    """The keys of a map label -> number, in order of their numbers."""
    pairs = F.transform(F.map_entries(index), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))
    return F.transform(F.sort_array(pairs), lambda p: p["k"])


def change_prompt(head: str, changes: Column) -> Column:
    """An instruction with one quoted line a change; ``changes`` has structs old and new."""
    quoted = lambda x: F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    lines = F.transform(changes, lambda c: F.concat(F.lit("- "), quoted(c["old"]), F.lit(" -> "), quoted(c["new"])))
    return F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n"))


def rendered(kind: str, path: Column, diff: Column, applied: Column, remaining: Column) -> Column:
    """A report of one file: its ``diff`` or ``patch``, all as ``json``, or lists as ``markdown``."""
    if require_output(kind) in ("diff", "patch"):
        return diff
    if kind == "json":
        return F.to_json(F.struct(path.alias("file"), diff.alias("diff"), applied.alias("applied"), remaining.alias("remaining")))
    done = F.transform(applied, lambda x: F.format_string("- Line %d: `%s` → `%s` (%s)", x["line"], x["original"], x["replacement"], x["rule"]))
    left = F.transform(remaining, lambda x: F.format_string("- Line %d: `%s` — %s", x["line"], x["symbol"], x["reason"]))
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {head}\n\n"), F.array_join(items, "\n"))).otherwise("")
    return F.concat(F.lit("# "), path, part("Applied", done), part("Remaining", left), F.lit("\n\n```diff\n"), diff, F.lit("\n```\n"))


def left_aligned(c: Column, width: int) -> Column:
    """Filled up with spaces behind; a longer text stays whole."""
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def right_aligned(c: Column, width: int) -> Column:
    """Filled up with spaces before; a longer text stays whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, " ")).otherwise(c)


def percent(share: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


#: The columns of the history and their widths; the first three stand left.
HISTORY = (("Timestamp", 22), ("File", 30), ("Backend", 10), ("Applied", 7), ("Remain", 7), ("Conf", 6), ("Valid", 6))


def history_head() -> str:
    """The two lines above the rows of a history."""
    cells = [f"{name:<{width}}" if i < 3 else f"{name:>{width}}" for i, (name, width) in enumerate(HISTORY)]
    return " ".join(cells) + "\n" + "-" * 90


def history_row(stamp: Column, file: Column, backend: Column, applied: Column, remaining: Column, confidence: Column, valid: Column) -> Column:
    """One entry of the audit log as a line of the history: time to the second, the end of a long path."""
    unknown = lambda c: F.coalesce(c, F.lit("?"))
    path = F.when(F.length(file) > 28, F.concat(F.lit("..."), F.right(file, F.lit(25)))).otherwise(file)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    said = F.when(valid, "pass").when(~valid, "fail").otherwise("-")
    left = [left_aligned(unknown(c), w) for c, w in ((F.substring(stamp, 1, 19), 22), (path, 30), (backend, 10))]
    right = [right_aligned(c, w) for c, w in ((number(applied), 7), (number(remaining), 7), (percent(F.coalesce(confidence, F.lit(0.0))), 5), (said, 6))]
    return F.concat_ws(" ", *left, *right)
