"""Rewriting C-like source: headers, types, calls, launches and a namespace, line by line, in whole files or in quoted blocks of others.

Each step is a function of columns from a line's state to its next state: the text so far, the changes applied, and what
is left for review.  A file is an array of lines, so it is rewritten in its row, without a join or a shuffle.

Launches are read with brackets: a configuration is split at the commas that stand in no bracket, template list or
string, and the arguments end at the bracket that closes them.  Only the first launch of a line is rewritten.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import AFTER_LINE, once, replace_first

CHANGE = "struct<original:string,replacement:string,rule:string,confidence:double>"
ISSUE = "struct<symbol:string,reason:string,confidence:double>"

#: What marks a line that can change, and a block that holds such source.
MARKS = r"cuda|cub|<<<|#\s*include|dim3"
INDICATORS = ("__global__", "__device__", "__shared__", "<<<", "cudaMalloc", "cudaMemcpy", "cudaFree", "#include", "threadIdx", "blockIdx", "blockDim")
INCLUDE = r'#\s*include\s*[<"]([^>"]+)[>"]'
SYMBOL = r"(?U)\b(cuda[A-Z]\w+)\b"
#: Launch forms by the number of parts of their configuration, with the confidence of the rewrite.
LAUNCHES = {2: ("<<<grid,block>>>", 0.5), 3: ("<<<grid,block,shared>>>", 0.6), 4: ("<<<grid,block,shared,stream>>>", 0.7)}
#: Confidence of a type and of a call from which they are replaced, of an unknown call, and of a launch that is left.
SURE_TYPE, SURE_CALL, UNKNOWN_CALL, LEFT_LAUNCH = 0.8, 0.9, 0.4, 0.3
UNKNOWN = "CUDA API not in mapping (may need newer ROCm version or manual review)"
COMPLEX = "Complex kernel launch syntax — needs manual conversion to hipLaunchKernelGGL"


def _listed(rows: Sequence[tuple], names: str, types: str) -> Column:
    keys = names.split()
    return F.from_json(F.lit(json.dumps([dict(zip(keys, r, strict=True)) for r in rows])), f"array<struct<{types}>>")


def _map(pairs: dict, value: str) -> Column:
    return F.from_json(F.lit(json.dumps(pairs)), f"map<string,{value}>")


def _state(text: Column, applied: Column | None = None, remaining: Column | None = None) -> Column:
    none = F.array().cast
    return F.struct(text.alias("text"), (none(f"array<{CHANGE}>") if applied is None else applied).alias("applied"), (none(f"array<{ISSUE}>") if remaining is None else remaining).alias("remaining"))


def _change(old: Column, new: Column, rule: Column, confidence: Column | float) -> Column:
    bare = lambda x: F.regexp_replace(x, r"\s+$", "")
    return F.struct(bare(old).alias("original"), bare(new).alias("replacement"), rule.alias("rule"), F.lit(confidence).cast("double").alias("confidence"))


def _issue(symbol: Column, reason: Column, confidence: Column | float) -> Column:
    return F.struct(symbol.alias("symbol"), reason.alias("reason"), F.lit(confidence).cast("double").alias("confidence"))


def _applied(s: Column, new: Column, rule: Column, confidence: Column | float = 1.0, old: Column | None = None) -> Column:
    old = s["text"] if old is None else old
    return _state(new, F.concat(s["applied"], F.array(_change(old, new, rule, confidence))), s["remaining"])


def _left(s: Column, symbol: Column, reason: Column, confidence: Column | float) -> Column:
    return _state(s["text"], s["applied"], F.concat(s["remaining"], F.array(_issue(symbol, reason, confidence))))


def headers(known: Sequence[tuple[str, str]], special: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """Headers by name, then those of ``cub/`` by ``special`` names, else by rule."""

    def step(s: Column) -> Column:
        def named(old: Column) -> Column:
            by_rule = F.replace(F.replace(old, F.lit("cub/"), F.lit("hipcub/")), F.lit(".cuh"), F.lit(".hpp"))
            cub = F.when(F.startswith(old, F.lit("cub/")), F.coalesce(F.try_element_at(_map(dict(special), "string"), old), by_rule))
            new = F.coalesce(F.try_element_at(_map(dict(known), "string"), old), cub)
            line = F.concat(F.regexp_extract(s["text"], f"(?s)^(.*?){INCLUDE}", 1), F.lit("#include <"), new, F.lit(">"), F.regexp_extract(s["text"], f"(?s){INCLUDE}(.*)$", 2))
            return F.when(new.isNotNull(), _applied(s, line, F.concat(F.lit("Header: "), old, F.lit(" → "), new))).otherwise(s)

        return once(F.regexp_extract(s["text"], INCLUDE, 1), named)

    return step


def types(rows: Sequence[tuple[str, str, str, float]]) -> Callable[[Column], Column]:
    """Every type that the text holds, in order, each looked for in what the ones before have left."""

    def each(s: Column, r: Column) -> Column:
        new = F.replace(s["text"], r["old"], r["new"])
        sure = _applied(s, new, F.concat(F.lit("Type: "), r["old"], F.lit(" → "), r["new"]), r["sure"])
        reason = F.concat(F.lit("Low-confidence type mapping ("), r["sure"].cast("string"), F.lit(") — "), r["notes"])
        return F.when(~F.contains(s["text"], r["old"]), s).when(r["sure"] >= SURE_TYPE, sure).otherwise(_left(s, r["old"], reason, r["sure"]))

    listed = [r for r in rows if r[0] != r[1]]
    return lambda s: F.aggregate(_listed(listed, "old new notes sure", "old string, new string, notes string, sure double"), s, each)


def calls(rows: Sequence[tuple[str, str, str, float]]) -> Callable[[Column], Column]:
    """Calls of the line in order: sure ones replace their first occurrence, others are left."""
    known = {r[0]: {"new": r[1], "notes": r[2], "sure": r[3]} for r in rows}

    def step(s: Column) -> Column:
        line = s["text"]

        def each(a: Column, symbol: Column) -> Column:
            def looked_up(r: Column) -> Column:
                new = replace_first(a["text"], symbol, r["new"])
                notes = F.when(r["notes"] == "", "").otherwise(F.concat(F.lit(" — "), r["notes"]))
                reason = F.concat(F.lit("Low-confidence API ("), F.round(r["sure"] * 100).cast("int").cast("string"), F.lit("%)"), notes)
                sure = _applied(a, new, F.concat(symbol, F.lit(" → "), r["new"]), r["sure"], line)
                return F.when(r.isNull(), _left(a, symbol, F.lit(UNKNOWN), UNKNOWN_CALL)).when(r["sure"] >= SURE_CALL, sure).otherwise(_left(a, symbol, reason, r["sure"]))

            return once(F.try_element_at(_map(known, "struct<new:string,notes:string,sure:double>"), symbol), looked_up)

        return F.aggregate(F.regexp_extract_all(line, F.lit(SYMBOL), F.lit(1)), s, each)

    return step


def _read(a: Column, c: Column) -> tuple[Column, Column, Column]:
    """Quote, bracket depth and template depth after character ``c``; the state has the character before in ``last``."""
    opens = F.when((a["quote"] == "") & c.isin('"', "'"), c)
    closes = (a["quote"] == c) & (a["last"] != "\\")
    quote = F.coalesce(opens, F.when(closes, "").otherwise(a["quote"]))
    plain = (a["quote"] == "") & (quote == "")
    depth = a["depth"] + F.when(plain & c.isin("(", "[", "{"), 1).when(plain & c.isin(")", "]", "}"), -1).otherwise(0)
    angle = a["angle"] + F.when(plain & (c == "<") & a["last"].rlike("[A-Za-z0-9_]"), 1).when(plain & (c == ">") & (a["angle"] > 0), -1).otherwise(0)
    return quote, depth, angle


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


_OPEN = {"quote": "", "last": "", "depth": 0, "angle": 0}


def _start(**more: Column) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in _OPEN.items()], *[c.alias(n) for n, c in more.items()])


def split_top(text: Column) -> Column:
    """The parts of a text between commas that stand in no bracket, template list or string, trimmed."""

    def step(a: Column, c: Column) -> Column:
        quote, depth, angle = _read(a, c)
        cut = (c == ",") & (a["depth"] == 0) & (a["angle"] == 0) & (a["quote"] == "")
        part = F.when(cut, "").otherwise(F.concat(a["part"], c))
        parts = F.when(cut, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"])
        return F.struct(quote.alias("quote"), c.alias("last"), depth.alias("depth"), angle.alias("angle"), part.alias("part"), parts.alias("parts"))

    out = F.aggregate(_characters(text), _start(part=F.lit(""), parts=F.array().cast("array<string>")), step, lambda a: F.concat(a["parts"], F.array(a["part"])))
    return F.transform(out, lambda x: F.trim(x))


def closing(text: Column) -> Column:
    """The number of characters of a text up to the bracket that closes its first one, 0 if none does."""

    def step(a: Column, c: Column) -> Column:
        quote, depth, angle = _read(a, c)
        end = F.when((a["end"] == 0) & (depth == 0) & (a["depth"] > 0), a["at"] + 1).otherwise(a["end"])
        return F.struct(quote.alias("quote"), c.alias("last"), depth.alias("depth"), angle.alias("angle"), (a["at"] + 1).alias("at"), end.alias("end"))

    return F.aggregate(_characters(text), _start(at=F.lit(0), end=F.lit(0)), step, lambda a: a["end"])


def launches(s: Column) -> Column:
    """The first launch of a line, ``k<<<grid, block[, shared[, stream]]>>>(args)``, as a call."""
    pattern = r"(?Us)^(.*?)(\w+)\s*<<<(.*?)>>>(.*)$"
    group = lambda i: F.regexp_extract(s["text"], pattern, i)

    def rewritten(parts: Column) -> Column:
        def with_tail(tail: Column) -> Column:
            called = tail.rlike(r"^\s*\(")
            gap = F.length(tail) - F.length(F.regexp_replace(tail, r"^\s+", ""))
            end = F.when(called, once(F.substring(tail, gap + 1, F.length(tail)), closing)).otherwise(0)

            def call(end: Column) -> Column:
                args = F.when(end > 0, F.trim(F.substring(tail, gap + 2, end - 2))).otherwise("")
                rest = F.when(end > 0, F.substring(tail, gap + end + 1, F.length(tail))).otherwise(tail)
                at = lambda i, default: F.coalesce(F.get(parts, F.lit(i)), F.lit(default))
                stream = F.when(F.size(parts) > 4, F.array_join(F.slice(parts, 4, F.size(parts)), ", ")).otherwise(at(3, "0"))
                values = F.concat_ws(", ", group(2), at(0, ""), at(1, ""), at(2, "0"), stream, F.when(args != "", args))
                new = F.concat(group(1), F.lit("hipLaunchKernelGGL("), values, F.lit(")"), rest)
                n = F.least(F.size(parts), F.lit(4))
                rule, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
                for k, (form, confidence) in LAUNCHES.items():
                    rule, sure = F.when(n == k, F.lit(f"Kernel launch {form} → hipLaunchKernelGGL")).otherwise(rule), F.when(n == k, F.lit(confidence)).otherwise(sure)
                return _applied(s, new, rule, sure)

            return once(end, call)

        whole = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: p == "")
        return F.when(whole, once(group(4), with_tail)).otherwise(_left(s, F.lit("<<<...>>>"), F.lit(COMPLEX), LEFT_LAUNCH))

    parsed = F.when(s["text"].rlike(pattern), split_top(group(3))).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(s["text"], F.lit("<<<")), once(parsed, rewritten)).otherwise(s)


def namespace(s: Column) -> Column:
    new = F.regexp_replace(s["text"], r"(?U)\bcub::", "hipcub::")
    return F.when(new != s["text"], _applied(s, new, F.lit("Namespace: cub:: → hipcub::"))).otherwise(s)


def steps(known: Sequence[tuple[str, str]], special: Sequence[tuple[str, str]], type_rows: Sequence[tuple], symbols: Sequence[tuple]) -> list[Callable[[Column], Column]]:
    """The five steps of a line, in order."""
    return [headers(known, special), types(type_rows), calls(symbols), launches, namespace]


def rewritten_line(line: Column, each: Sequence[Callable[[Column], Column]]) -> Column:
    """A struct of text, applied and remaining."""

    def run(s: Column, rest: Sequence[Callable[[Column], Column]]) -> Column:
        return once(rest[0](s), lambda n: run(n, rest[1:])) if rest else s

    return F.when(line.rlike(MARKS), once(_state(line), lambda s: run(s, each))).otherwise(_state(line))


def _numbered(states: Column, first: Column, between: str) -> Column:
    """Struct of text (lines joined by ``between``), applied and remaining with the number of their line, of an array of states."""
    fields = {"applied": ("original", "replacement", "rule", "confidence"), "remaining": ("symbol", "reason", "confidence")}
    of = lambda kind: F.flatten(F.transform(states, lambda s, i: F.transform(s[kind], lambda x: F.struct((first + i).alias("line"), *[x[f].alias(f) for f in fields[kind]]))))
    return F.struct(F.array_join(F.transform(states, lambda s: s["text"]), between).alias("text"), of("applied").alias("applied"), of("remaining").alias("remaining"))


def migrated_files(files: DataFrame, each: Sequence[Callable[[Column], Column]], text: str = "text") -> DataFrame:
    """Add ``new_text``, ``applied`` and ``remaining`` (arrays with line numbers) for whole files; line ends stay as they are."""
    lines = F.split(F.coalesce(text, F.lit("")), AFTER_LINE, -1)
    out = files.withColumn("_m", once(F.transform(lines, lambda x: rewritten_line(x, each)), lambda states: _numbered(states, F.lit(1), "")))
    return out.withColumns({"new_text": F.col("_m.text"), "applied": F.col("_m.applied"), "remaining": F.col("_m.remaining")}).drop("_m")


def listed(migrated: DataFrame, kind: str, *keep: str) -> DataFrame:
    """A row for each of ``applied`` or ``remaining``, with the columns ``keep``.

    The outer form, as Spark puts a filter on the array before the plain one and would rewrite each file there again.
    """
    return migrated.select(*keep, F.inline_outer(kind)).filter(F.col("line").isNotNull())


def in_blocks(text: Column, quote: str, fits: Callable[[Column], Column], rewrite: Callable[[Column, Column], Column]) -> Column:
    """Rewrite the blocks of a text between two ``quote`` signs, and nothing else.

    ``rewrite`` gets a block that ``fits`` and the number of the line on which it begins, and returns a struct of text, applied
    and remaining.  What follows a sign without a partner is no block.  Returns such a struct for the whole text.
    """
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def whole(parts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            plain = F.struct(x.alias("text"), F.array().cast(f"array<{LINED_CHANGE}>").alias("applied"), F.array().cast(f"array<{LINED_ISSUE}>").alias("remaining"))
            before = F.aggregate(F.slice(parts, 1, i), F.lit(1), lambda n, p: n + lines(p))
            return F.when((i % 2 == 1) & (i < F.size(parts) - 1) & fits(x), rewrite(x, before)).otherwise(plain)

        def joined(states: Column) -> Column:
            of = lambda kind: F.flatten(F.transform(states, lambda s: s[kind])).alias(kind)
            return F.struct(F.array_join(F.transform(states, lambda s: s["text"]), quote).alias("text"), of("applied"), of("remaining"))

        return once(F.transform(parts, one), joined)

    return once(F.split(text, quote, -1), whole)


LINED_CHANGE, LINED_ISSUE = (x.replace("struct<", "struct<line:int,") for x in (CHANGE, ISSUE))


def migrated_blocks(files: DataFrame, each: Sequence[Callable[[Column], Column]], text: str = "text") -> DataFrame:
    """As ``migrated_files``, only inside triple-quoted blocks that hold such source, first of one quote sign, then of the other."""
    fits = lambda x: F.exists(F.array(*[F.lit(i) for i in INDICATORS]), lambda i: F.contains(x, i))

    def rewrite(x: Column, first: Column) -> Column:
        return once(F.transform(F.split(x, "\n", -1), lambda line: rewritten_line(line, each)), lambda states: _numbered(states, first, "\n"))

    out = files.withColumn("_a", in_blocks(F.coalesce(text, F.lit("")), '"""', fits, rewrite))
    out = out.withColumn("_b", in_blocks(F.col("_a.text"), "'''", fits, rewrite))
    both = {k: F.concat(f"_a.{k}", f"_b.{k}") for k in ("applied", "remaining")}
    return out.withColumns({"new_text": F.col("_b.text"), **both}).drop("_a", "_b")
