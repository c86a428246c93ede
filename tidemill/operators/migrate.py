"""Rewriting files by rules: edits by phase, at most one a line, and what is left for review.

Everything joins on (path, line): usages are exploded rows, rules are in-row lookups
or a broadcast dimension, and a file is put together again from its lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.code import first_of_each, replace_in_order

#: The order in which kinds of usage are handled.
PHASES = {"backend": 1, "import": 2, "env_var": 3, "api_call": 4, "attribute": 5}
#: Names of the rules and the confidence of their edits.
RULES = {"backend": ("torch.backends.cudnn → miopen", 1.0), "import": ("Import replacement", 0.95), "env_var": ("Environment variable CUDA → HIP", 1.0)}
#: Why a usage is left, and how sure its replacement would be.
LEFT = {
    "backend": ("cudnn backend reference needs manual review", 0.5),
    "import": ("Import may need manual migration", 0.5),
    "launch": ("CUDA kernel launch syntax — needs LLM migration", 0.3),
    "api_call": ("Unknown CUDA API — needs LLM review", 0.4),
    "attribute": ("CUDA attribute reference — needs LLM review", 0.6),
}


def _indent(line: Column) -> Column:
    return F.regexp_extract(line, r"^(\s*)", 1)


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), default)


def statement_replaced(line: Column, statements: Sequence[tuple[str, str]]) -> Column:
    """The first statement that the line holds stands for all of it; the indent stays."""
    return _first([(F.contains(line, F.lit(k)), F.concat(_indent(line), F.lit(v))) for k, v in statements], line)


def import_replaced(line: Column, imports: Sequence[tuple[str, str, str]]) -> Column:
    """An import (pattern, replacement, note) as a whole, or its module as a prefix before a point or a space; once only."""
    bare = F.trim(line)
    cases = []
    for pattern, replacement, note in imports:
        new = F.lit(not note) if not note else ~F.contains(bare, F.lit(note))
        tail = F.lit(f"  # {note}")
        module = replacement.split("  #")[0].rstrip()
        cases.append((new & (bare == pattern), F.concat(_indent(line), F.lit(replacement), tail)))
        longer = F.startswith(bare, F.lit(pattern + ".")) | F.startswith(bare, F.lit(pattern + " "))
        cases.append((new & longer, F.concat(_indent(line), F.lit(module), F.substr(bare, F.lit(len(pattern) + 1)), tail)))
    return _first(cases, line)


def migrated(
    lines: DataFrame,
    usages: DataFrame,
    api: DataFrame,
    statements: Sequence[tuple[str, str]] = (),
    imports: Sequence[tuple[str, str, str]] = (),
    variables: Sequence[tuple[str, str]] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new lines, applied, remaining).

    ``lines`` has path, line and line_text; ``usages`` path, line, ord, category, symbol and false_positive;
    ``api`` (symbol, replacement, confidence) is a dimension.  A false positive is neither applied nor left; a usage
    on a line that an earlier one has changed is not looked at; a usage on no line of the file is dropped.
    Of the rules only those of confidence 1 are applied.
    """
    known = api.select(F.col("symbol").alias("_s"), "replacement", F.col("confidence").alias("_c"))
    phase = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    rows = usages.filter(~F.coalesce("false_positive", F.lit(False))).withColumn("phase", F.try_element_at(phase, "category"))
    rows = rows.filter("phase is not null").join(lines, ["path", "line"]).join(known, F.col("symbol") == F.col("_s"), "left")
    text, of = F.col("line_text"), lambda kind: F.col("category") == kind
    sure = F.coalesce(F.col("_c") >= 1.0, F.lit(False))
    new = (
        F.when(of("backend"), statement_replaced(text, statements))
        .when(of("import"), import_replaced(text, imports))
        .when(of("env_var"), replace_in_order(text, list(variables)))
        .when(of("api_call") & sure, F.replace(text, F.col("symbol"), F.col("replacement")))
        .otherwise(text)
    )
    rule = F.when(of("api_call"), F.concat_ws(" → ", "symbol", "replacement"))
    confidence = F.when(of("api_call"), F.col("_c"))
    for kind, (name, value) in RULES.items():
        rule, confidence = F.when(of(kind), F.lit(name)).otherwise(rule), F.when(of(kind), F.lit(value)).otherwise(confidence)
    rows = rows.withColumns({"new_text": new, "rule": rule, "confidence": confidence})
    applied = first_of_each(rows.filter(F.col("new_text") != text), ["path", "line"], ["phase", "ord"])
    applied = applied.select("path", "line", "phase", "ord", F.rtrim("line_text").alias("original"), F.rtrim("new_text").alias("replacement"), "rule", "confidence", "new_text")

    done = applied.select("path", "line", F.struct("phase", "ord").alias("_done"))
    open_ = rows.join(done, ["path", "line"], "left").filter(F.col("_done").isNull() | (F.struct("phase", "ord") < F.col("_done")))
    value = lambda kind, i: F.lit(LEFT[kind][i])
    unsure = of("api_call") & F.col("_c").isNotNull()
    said = F.concat(F.lit("Low confidence ("), F.col("_c").cast("string"), F.lit(") — needs LLM review"))

    def left(i: int, own: Column) -> Column:
        out = F.when(unsure & ~sure, own).when(of("api_call") & (F.col("symbol") == "<<<...>>>"), value("launch", i))
        return out.when(of("api_call") & F.col("_c").isNull(), value("api_call", i)).when(of("backend"), value("backend", i)).when(of("import"), value("import", i)).when(of("attribute"), value("attribute", i))

    remaining = open_.select("path", "line", "phase", "ord", "symbol", left(0, said).alias("reason"), left(1, F.col("_c")).alias("confidence")).filter("reason is not null")
    texts = lines.join(applied.select("path", "line", "new_text"), ["path", "line"], "left").select("path", "line", F.coalesce("new_text", "line_text").alias("line_text"))
    return texts, applied.drop("new_text"), remaining
