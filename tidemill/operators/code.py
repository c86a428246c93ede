"""Tagging, rewriting and validating lines of source text by rule tables.

Texts are exploded into lines; rules are small dimensions with an order, so
every "first match wins" is a window over that order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.text import split_lines, uncommented
from tidemill.operators.graph import checkpointed
from tidemill.operators.running import running

#: Rules that are looked up in the row.
FEW = 500
#: Fixed values: (category, pattern, once a line, symbol of such a line).
TAGS = (
    ("api_call", r"<<<.*?>>>", True, "<<<...>>>"),
    ("api_call", r"\bcub::\w+", False, None),
    ("api_call", r"\bthrust::\w+", False, None),
    ("api_call", r"\bcooperative_groups::\w+", False, None),
    ("api_call", r"\b(?:__shfl(?:_up|_down|_xor)?_sync|__ballot_sync|__all_sync|__any_sync|__activemask|__syncwarp|warpSize)\b", False, None),
    ("api_call", r"\b(?:cudaGraph\w+|cudaStreamBeginCapture|cudaStreamEndCapture|cudaStreamIsCapturing)\b", False, None),
    ("api_call", r"\b(?:trt\.Builder|trt\.Runtime|trt\.Logger|ICudaEngine|IExecutionContext)\b", False, None),
    ("cuda_c_qualifier", r"\b(?:__global__|__device__|__host__|__shared__|__constant__|__managed__|__launch_bounds__|__forceinline__)\b", False, None),
    ("cuda_c_type", r"\b(?:cudaStream_t|cudaEvent_t|cudaError_t|cudaDeviceProp|cudaMemcpyKind|cudaFuncAttributes|cudaPointerAttributes|cudaGraph_t|cudaGraphExec_t|cudaGraphNode_t|cudaArray_t|cudaTextureObject_t|cudaSurfaceObject_t|cudaPitchedPtr|cudaExtent|cudaPos|cudaChannelFormatDesc|cudaGraphicsResource_t)\b", False, None),
    ("inline_cuda_c", r"SourceModule\s*\(", True, "SourceModule"),
    ("cuda_c_header", r"#\s*include\s*[<\"][^>\"]*(?:cuda|cub/|thrust/)[^>\"]*[>\"]", False, None),
)


def explode_lines(files: DataFrame, text: str = "text", lines: Column | None = None) -> DataFrame:
    """One row a line, numbered from 1; all columns but the text stay."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(split_lines(F.col(text)) if lines is None else lines).alias("_at", "line_text")).select(*rest, (F.col("_at") + 1).alias("line"), "line_text")


def tag_lines(lines: DataFrame, tags=TAGS) -> DataFrame:
    """Add category, symbol and ord for every match of every tag on every line."""
    found = []
    for i, (category, pattern, once, symbol) in enumerate(tags):
        every = F.regexp_extract_all("line_text", F.lit(pattern), F.lit(0))
        hits = F.when(F.col("line_text").rlike(pattern), F.array(F.lit(symbol))).otherwise(F.array().cast("array<string>")) if once else every
        found.append(_struct(hits, category, i))
    return lines.withColumn("_hit", F.explode(F.flatten(F.array(*found)))).select(*lines.columns, "_hit.*")


def _struct(hits: Column, category: str, ord_: int) -> Column:
    return F.transform(hits, lambda s: F.struct(F.lit(category).alias("category"), s.alias("symbol"), F.lit(ord_).alias("ord")))


def first_of_each(usages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*key).orderBy(*order)
    return usages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def false_positive(line: Column, category: Column) -> Column:
    """A hit on a comment line, or of some categories on a line that opens a docstring."""
    return line.rlike(r"^\s*#") | (category.isin("env_var", "api_call") & line.rlike(r"""^\s*(?:\"\"\"|''')"""))


def lookup(usages: DataFrame, rules: DataFrame) -> DataFrame:
    """Status of each symbol: replaced at confidence 1, else remaining with a reason and a confidence."""
    known = rules.select(F.col("symbol").alias("_s"), "replacement", F.col("confidence").alias("_c"))
    out = usages.join(known, F.col("symbol") == F.col("_s"), "left")
    launch = F.col("symbol") == "<<<...>>>"
    reason = F.when(F.col("_c") >= 1.0, F.lit(None).cast("string")).when(F.col("_c").isNotNull(), F.lit("Low confidence mapping")).when(launch, F.lit("Kernel launch")).otherwise(F.lit("Unknown API"))
    confidence = F.coalesce("_c", F.when(launch, 0.3).otherwise(0.4))
    return out.withColumn("reason", reason).withColumn("confidence", confidence).drop("_s", "_c")


def first_contained(lines: DataFrame, rules: DataFrame, line: str = "line_text", prefix: bool = False) -> DataFrame:
    """Of each line the first rule (by ord) whose key it holds, or begins with; lines that fit none are dropped.

    ``rules`` (ord, key, replacement) is a dimension of at most ``FEW`` rows; it is looked up in the row, so lines are neither joined nor
    shuffled.  More rules are an error: ``patterns.first_rule`` looks for any number.
    """
    few = sorted((r.ord, r.key, r.replacement) for r in rules.select("ord", "key", "replacement").limit(FEW + 1).collect())
    if len(few) > FEW:
        raise ValueError(f"more than {FEW} rules")
    listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("replacement")) for _, k, v in few])
    fits = F.startswith if prefix else F.contains
    best = F.get(F.filter(listed, lambda r: fits(F.col(line), r["key"])), F.lit(0))
    return lines.withColumn("_r", best).filter("_r is not null").select(*lines.columns, "_r.key", "_r.replacement")


def replace_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def one_edit_a_line(edits: DataFrame, key: list[str]) -> DataFrame:
    """Of the edits of a line the first by phase and order."""
    return first_of_each(edits, key, ["phase", "ord"])


def rebuilt(lines: DataFrame, edits: DataFrame, key: str, new: str = "new_text") -> DataFrame:
    """The texts after the edits: lines joined in order by newlines."""
    out = lines.join(edits.select(key, "line", new), [key, "line"], "left")
    parts = F.array_sort(F.collect_list(F.struct("line", F.coalesce(new, "line_text").alias("t"))))
    return out.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def issues(lines: DataFrame, rules: DataFrame, comments: bool = False) -> DataFrame:
    """Lines that match a validator's pattern; ``rules`` has validator, pattern, severity."""
    text = F.col("line_text") if comments else uncommented(F.col("line_text"))
    return lines.withColumn("_t", text).join(F.broadcast(rules), F.regexp_like("_t", F.col("pattern"))).drop("_t", "pattern")


def verdicts(files: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A file passes when no issue of it is an error."""
    bad = found.groupBy(key).agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count(F.lit(1)).alias("issues"))
    out = files.select(key).join(bad, key, "left")
    return out.select(key, F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("issues", F.lit(0)).alias("issues"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.5, "needs_review").otherwise("low")


def reason_confidence(reason: Column) -> Column:
    """Fixed values, the first that fits wins."""
    r = F.lower(reason)
    return (
        F.when(r.contains("kernel launch"), 0.3)
        .when(r.contains("unknown cuda api"), 0.4)
        .when(r.contains("low confidence"), 0.5)
        .when(r.contains("manual review"), 0.5)
        .when(r.contains("needs llm review"), 0.6)
        .otherwise(0.5)
    )


def scores(scored: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """Counts by bucket and the mean confidence of each key; a key of ``files`` without changes has the mean 1."""
    b = bucket(F.col("confidence"))
    out = scored.groupBy(key).agg(
        F.count_if(b == "high").alias("high"),
        F.count_if(b == "needs_review").alias("needs_review"),
        F.count_if(b == "low").alias("low"),
        F.count(F.lit(1)).alias("total"),
        F.avg("confidence").alias("score"),
    )
    if files is not None:
        out = files.select(key).distinct().join(out, key, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("high", "needs_review", "low", "total")}
    return out.withColumns({**zero, "score": F.coalesce("score", F.lit(1.0))})


def checklist(scored: DataFrame, key: str) -> DataFrame:
    """A markdown list of what is to be reviewed, the least confident first."""
    item = F.struct("confidence", "line", F.format_string("- [ ] line %d: %s (%.2f)", "line", "original", "confidence").alias("t"))
    parts = F.array_sort(F.collect_list(item))
    return scored.filter(F.col("confidence") < 0.9).groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("checklist"))


def within_budget(chunks: DataFrame, group: list[str], order: list[str], budget: int, tokens: str = "tokens") -> DataFrame:
    """Chunks whose running sum of tokens fits the budget; a group may have any size."""
    out = running(chunks, chunks.columns, group, order, F.col(tokens), "used")
    return out.withColumn("used", F.col("used") + F.coalesce(tokens, F.lit(0))).withColumn("selected", F.col("used") <= budget)


def _one_filling(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, taken, used, misfit) of rows with ``_left``: what fits it in order, and the first row that does not."""
    keep = [*group, "_at", "_t", "_left"]
    sums = running(rows, keep, group, ["_at"], F.col("_t"), "_used")
    over = F.when(F.col("_used") + F.col("_t") > F.col("_left"), F.col("_at"))
    first = sums.withColumn("_over", over).groupBy(*group).agg(F.min("_over").alias("_misfit"))
    return checkpointed(_with_nulls(sums, first, group).filter("_misfit is null or _at <= _misfit").groupBy(*group).agg(F.count_if(F.col("_misfit").isNull() | (F.col("_at") < F.col("_misfit"))).alias("_n"), F.sum(F.when(F.col("_misfit").isNull() | (F.col("_at") < F.col("_misfit")), F.col("_t")).otherwise(0)).alias("_sum"), F.first("_misfit").alias("_misfit")))


def _with_nulls(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join by columns in which null equals null."""
    named = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return left.join(named, reduce(lambda x, y: x & y, same)).drop(*[f"_on{i}" for i in range(len(on))])


def _placed_chunks(chunks: DataFrame, group: list[str], order: str, tokens: str) -> DataFrame:
    at = F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t"), F.monotonically_increasing_id().alias("i"))
    return checkpointed(chunks.select(*group, at.alias("_at"), F.col(tokens).cast("long").alias("_t")))


def greedy_budget(chunks: DataFrame, group: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """(group, used, taken): take what still fits in order, skip what does not, and go on; chunks without a number are skipped.

    Of what is no larger than what is left, all is taken up to the first chunk that does not fit; then what is left is less than that
    chunk, and the rest is searched again.  A group may have any size.
    """
    rows = _placed_chunks(chunks, group, order, tokens)
    total = checkpointed(rows.select(*group).distinct().select(*group, F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken")))
    left = rows.filter(F.col("_t") <= budget).withColumn("_left", F.lit(budget).cast("long"))
    while True:
        round_ = _one_filling(left, group)
        added = round_.select(*group, F.col("_sum").alias("used"), F.col("_n").alias("taken"))
        total = checkpointed(total.unionByName(added).groupBy(*group).agg(F.sum("used").alias("used"), F.sum("taken").alias("taken")))
        open_ = round_.filter("_misfit is not null").select(*group, "_sum", "_misfit")
        if open_.isEmpty():
            return total
        left = _with_nulls(left, open_, group).filter("_at > _misfit and _t <= _left - _sum").select(*group, "_at", "_t", (F.col("_left") - F.col("_sum")).alias("_left"))
        left = checkpointed(left)


def budget_until_misfit(chunks: DataFrame, group: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """(group, used, taken): take chunks in order up to the first that does not fit; chunks without a number are skipped."""
    rows = _placed_chunks(chunks, group, order, tokens)
    filled = _one_filling(rows.filter("_t is not null").withColumn("_left", F.lit(budget).cast("long")), group)
    every = rows.select(*group).distinct().select(*group, F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("taken"))
    return every.unionByName(filled.select(*group, F.col("_sum").alias("used"), F.col("_n").alias("taken"))).groupBy(*group).agg(F.sum("used").alias("used"), F.sum("taken").alias("taken"))


def rule_confidence(rule: Column, known: dict[str, float], sign: str) -> Column:
    """The confidence of a rule by its name: what the table says, 1 with the sign of a replacement, else 0.9."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, rule), F.when(F.contains(rule, F.lit(sign)), 1.0), F.lit(0.9))


def decided(edits: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """``edits`` with ``final``: a rejected edit keeps its line; without a decision an edit is accepted."""
    out = edits.join(decisions, key, "left").withColumn("decision", F.coalesce("decision", F.lit("accept")))
    return out.withColumn("final", F.when(F.col("decision") == "reject", F.col("line_text")).otherwise(F.col("new_text")))


def split_by_size(texts: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Texts of more than ``most`` characters cut into parts of as many lines as fit by their mean length: part, start_line, end_line, source.

    A text that is not longer is one part, whatever its lines.
    """
    rest = [c for c in texts.columns if c != text]
    lines = F.split(text, "\n", -1)
    each = F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.lit(1), F.floor(F.length(text) / F.size(lines))))).cast("int")
    step = F.when(F.length(text) > most, each).otherwise(F.size(lines))
    rows = texts.select(*rest, lines.alias("_lines"), step.alias("_step"), F.explode(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / step).cast("int"))).alias("_i"))
    first = F.col("_i") * F.col("_step")
    return rows.select(*rest, (F.col("_i") + 1).alias("part"), (first + 1).alias("start_line"), F.least(first + F.col("_step"), F.size("_lines")).alias("end_line"), F.array_join(F.slice("_lines", first + 1, F.col("_step")), "\n").alias("source"))
