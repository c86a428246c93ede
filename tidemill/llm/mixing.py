"""Mixing overlapping sources to target weights by min-cost flow.

Documents are first aggregated by membership pattern (the set of sources that
may claim them), so what the flow sees grows with the number of patterns and
sources, never with the number of documents.  Flow is routed from each pattern
to the quotas of its sources; repeating a pattern once more costs more each
time, so the cheapest flow repeats text as little and as evenly as it can.
Then documents are selected by a seeded order within each pattern, as far as they
fit, and what is missing is made up by the largest documents that fit it; what a
pattern misses at the end is less than its smallest document that could be taken
once more.

Defined results: a null text has size 0; a null source (or a null or empty list
of sources) is the source ``null``; empty tables give empty results; rows that
are repeated are mixed as documents of their own; columns of the input that are
not used are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import WORD, discard, materialize, table

#: Slices of the seeded order within a pattern; only one of them is ever sorted.
SLICES = 4096
#: A document with more than this part of what its pattern needs beyond whole repetitions is large.
LARGE = 4
#: Where a document stands within the seeded order of its pattern; decisions are made for these.
PLACE = ["key", "size", "slice"]


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; shares stop at ``most`` times the size and the excess is shared again by weight."""
    target = [0.0] * len(sizes)
    open_, rest = [i for i in range(len(sizes))], float(total)
    while open_ and rest > 0:
        all_w = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / all_w >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / all_w
            break
        for i in full:
            target[i] = float(most * sizes[i])
        rest -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def min_cost_flow(supply: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], most: int) -> dict[tuple[int, int], float]:
    """Tokens that each pattern gives to each of its sources.

    ``supply[p]`` tokens can be used up to ``most`` times; the r-th use costs r.
    Successive cheapest paths over the graph pattern - source; every path fills
    an arc, so the number of paths is bounded by the number of arcs.
    """
    n, m = len(supply), len(quota)
    S, E = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, cap: float, cost: float) -> list:
        there, back = [b, cap, cost, None], [a, 0.0, -cost, None]
        there[3], back[3] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    used = {}
    for p in range(n):
        for r in range(most):
            arc(S, p, float(supply[p]), float(r))
        for s in members[p]:
            used[p, s] = arc(p, n + s, float("inf"), 0.0)
    for s in range(m):
        arc(n + s, E, float(quota[s]), 0.0)
    height = [0.0] * len(graph)
    while True:
        dist = [float("inf")] * len(graph)
        via: list = [None] * len(graph)
        dist[S] = 0.0
        heap = [(0.0, S)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for x in graph[a]:
                if x[1] > 1e-6 and (e := d + x[2] + height[a] - height[x[0]]) < dist[x[0]] - 1e-9:
                    dist[x[0]], via[x[0]] = e, x
                    heapq.heappush(heap, (e, x[0]))
        if dist[E] == float("inf"):
            break
        height = [h + (d if d < float("inf") else 0.0) for h, d in zip(height, dist, strict=True)]
        path, at = [], E
        while at != S:
            path.append(via[at])
            at = via[at][3][0]
        amount = min(x[1] for x in path)
        for x in path:
            x[1] -= amount
            x[3][1] += amount
    return {k: x[3][1] for k, x in used.items() if x[3][1] > 0}


def routed(supply: Sequence[float], members: Sequence[Sequence[int]], quota: Sequence[float], most: int) -> dict[tuple[int, int], float]:
    """``min_cost_flow``, solved for each group of patterns and sources that hang together; a pattern alone with its source needs no search."""
    up = list(range(len(quota)))

    def top(s: int) -> int:
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        return s

    for p in members:
        for s in p[1:]:
            up[top(s)] = top(p[0])
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(members):
        groups.setdefault(top(p[0]), []).append(i)
    out = {}
    for held in groups.values():
        sources = sorted({s for i in held for s in members[i]})
        if len(held) == len(sources) == 1:
            out[held[0], sources[0]] = min(quota[sources[0]], float(most * supply[held[0]]))
            continue
        at = {s: k for k, s in enumerate(sources)}
        found = min_cost_flow([supply[i] for i in held], [[at[s] for s in members[i]] for i in held], [quota[s] for s in sources], most)
        out |= {(held[i], sources[s]): n for (i, s), n in found.items()}
    return out


def columns_of(kept: Sequence[str]) -> dict[str, str]:
    """The names of the columns that ``mix`` adds: their own, with underscores behind where a kept column has that name."""
    held = {c.lower() for c in kept}
    out = {}
    for name in ("membership", "size", "source_size", "target", "taken"):
        out[name] = name
        while out[name] in held:
            out[name] += "_"
    return out


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    share: float = 1.0,
    seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Decide how many words of each document a mix takes.

    ``sources`` is a column with an array of the source names that may claim a
    document.  Returns the columns ``keep`` and, under the names of
    ``columns_of``, ``membership``, ``size``, ``source_size``, ``target`` (of the
    document's first source) and ``taken`` (a multiple of the size, at most
    ``most`` times).
    """
    spark = docs.sparkSession
    named = F.array_sort(F.array_distinct(sources))
    rows = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).alias("kept"),
        F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(F.array(F.lit(None).cast("string"))).alias("membership"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), *[F.col(c) for c in keep]).alias("order"),
        F.monotonically_increasing_id().alias("id"),
    ).withColumn("slice", F.pmod(F.col("order"), F.lit(SLICES)).cast("int"))
    rows = materialize(rows)  # texts are read once; what follows needs sizes only
    # A few rows: patterns, not documents.
    patterns = [(r.membership, int(r.size or 0)) for r in rows.groupBy("membership").agg(F.sum("size").alias("size")).collect()]
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    of_source = [0] * len(names)
    for p, n in patterns:
        for s in p:
            of_source[place[s]] += n
    quota = water_fill(of_source, [weights[i % len(weights)] for i in range(len(names))], share * sum(n for _, n in patterns), most)
    flow = routed([n for _, n in patterns], [[place[s] for s in p] for p, _ in patterns], quota, most)
    plan = []
    for i, (p, n) in enumerate(patterns):
        got = min(sum(flow.get((i, place[s]), 0.0) for s in p), float(most * n))
        whole = min(int(got // n), most) if n else 0
        plan.append((p, float(of_source[place[p[0]]]), quota[place[p[0]]], whole, round(got - whole * n)))
    schema = T.StructType([T.StructField("membership", T.ArrayType(T.StringType())), T.StructField("source_size", T.DoubleType()), T.StructField("target", T.DoubleType()), T.StructField("times", T.IntegerType()), T.StructField("need", T.LongType())])
    key = F.to_json("membership", {"ignoreNullFields": "false"}).alias("key")
    decided = materialize(spark.createDataFrame(plan, schema).select(key, "source_size", "target", "times", "need"))
    left = decided.filter("need > 0").select("key", F.col("need").alias("left"))
    # What is decided is kept in small tables, and what a row takes so far in narrow ones: no step joins what an earlier one did.
    narrow = rows.select(key, "size", "slice", "order", "id").join(F.broadcast(decided), "key")
    narrow = materialize(narrow.select("key", "size", "slice", "order", "id", "times", "need", F.lit(0).alias("more")))
    # Whole repetitions for all.  Of what is left over, first documents so large that the order would leave a hole beside them ...
    large = F.col("size") * LARGE > F.col("need")
    steps = [large & (F.col("times") < most)]
    bounds, left = _filled(narrow, left, steps[0])
    found = [bounds]
    # ... then the others in seeded order up to the slice that would exceed it ...
    small = ~large & (F.col("times") < most)
    cuts = materialize(_cuts(narrow.filter(small).groupBy("key", "slice").agg(F.sum("size").alias("sum")), left))
    decided = materialize(decided.join(cuts.select("key", "cut"), "key", "left"))
    left = materialize(left.join(cuts.select("key", "gap"), "key", "left").select("key", F.coalesce("gap", "left").alias("left")))
    cut = small & (F.col("slice") < F.coalesce("cut", F.lit(-1)))
    narrow, old = materialize(_taken(narrow.join(bounds, PLACE, "left"), steps[0]).join(F.broadcast(decided.select("key", "cut")), "key").withColumn("more", F.col("more") + cut.cast("int")).drop("cut")), narrow
    discard(old)
    # ... and last the largest that still fit, first of those not taken so far, then of all that may be taken once more.
    for again in [False] + [True] * (most - 1):
        open_ = (F.col("times") + F.col("more") < most) & (F.lit(again) | (F.col("more") == 0)) & (F.col("size") > 0)
        bounds, left = _filled(narrow, left, open_)
        steps.append(open_)
        found.append(bounds)
        if len(steps) <= most:
            narrow, old = materialize(_taken(narrow.join(bounds, PLACE, "left"), open_)), narrow
        else:
            old = narrow
        discard(old)
    # The documents with their columns are read once more, beside all that was decided.
    names_of = [f"bound{i}" for i in range(len(steps))]
    every = reduce(DataFrame.unionByName, [b.select(*PLACE, F.lit(i).alias("step"), "bound") for i, b in enumerate(found)])
    every = materialize(every.groupBy(*PLACE).agg(*[F.max(F.when(F.col("step") == i, F.col("bound"))).alias(c) for i, c in enumerate(names_of)]))
    rows = rows.withColumn("key", key).join(F.broadcast(decided), "key").withColumn("more", F.lit(0)).join(every, PLACE, "left")
    for i, open_ in enumerate(steps):
        rows = _taken(rows, open_, names_of[i])
        if i == 0:
            rows = rows.withColumn("more", F.col("more") + cut.cast("int"))
    out = columns_of(keep)
    taken = ((F.col("times") + F.col("more")) * F.col("size")).cast("long")
    return rows.select(*([F.col(f"kept.{c}") for c in keep]), F.col("membership").alias(out["membership"]), F.col("size").alias(out["size"]), F.col("source_size").cast("long").alias(out["source_size"]), F.col("target").alias(out["target"]), taken.alias(out["taken"]))


def _taken(rows: DataFrame, open_: Column, bound: str = "bound") -> DataFrame:
    """``rows`` with ``more`` one higher for those that are ``open_`` and stand in the seeded order up to the ``bound`` of their place."""
    first = F.coalesce(F.struct("order", "id") <= F.col(bound), F.lit(False))
    return rows.withColumn("more", F.col("more") + F.when(open_ & first, 1).otherwise(0)).drop(bound)


def _cuts(sums: DataFrame, left: DataFrame) -> DataFrame:
    """(key, cut, gap): the slice in which the seeded order would exceed what is left of a pattern, and what is missing before it.

    Prefix sums over at most ``SLICES`` rows a pattern, whatever its number of documents.
    """
    w = W.partitionBy("key").orderBy("slice")
    upto = F.sum("sum").over(w.rowsBetween(W.unboundedPreceding, 0))
    s = sums.join(F.broadcast(left), "key").select("key", "slice", "left", upto.alias("upto"))
    over = F.col("upto") > F.col("left")
    first, before = F.min(F.when(over, F.col("slice"))), F.max(F.when(~over, F.col("upto")))
    return s.groupBy("key").agg(F.coalesce(first, F.lit(SLICES)).alias("cut"), (F.first("left") - F.coalesce(before, F.lit(0))).alias("gap"))


def _filled(rows: DataFrame, left: DataFrame, open_: Column) -> tuple[DataFrame, DataFrame]:
    """(bounds, what is left): take one more time, of the rows of each pattern that are ``open_``, the largest that fit what is ``left``, and on with smaller ones.

    Sizes are counted, so the search goes over the sizes of a pattern, of which there are no more than the longest text has
    words.  Of one size the first in seeded order are taken; only the slices that they stand in are sorted.
    What is decided is a small table, a row for each size and slice with a document to take, so all rows are judged by
    their own columns and are not moved.
    """
    sizes = rows.filter(open_).groupBy("key", "size").agg(F.count("*").alias("n")).join(F.broadcast(left), "key").filter("size <= left")
    each = F.expr("transform(array_sort(collect_list(struct(-size as size, n))), x -> struct(-x.size as size, x.n as n))")

    def take(a: Column, x: Column) -> Column:
        m = F.least(x["n"], F.floor(a["left"] / x["size"]).cast("long"))
        taken = F.when(m > 0, F.concat(a["taken"], F.array(F.struct(x["size"].alias("size"), m.alias("m"))))).otherwise(a["taken"])
        return F.struct((a["left"] - m * x["size"]).alias("left"), taken.alias("taken"))

    start = F.struct(F.col("left"), F.array().cast("array<struct<size:bigint,m:bigint>>").alias("taken"))
    chosen = materialize(sizes.groupBy("key").agg(F.first("left").alias("left"), each.alias("sizes")).select("key", F.aggregate("sizes", start, take).alias("a")).select("key", "a.left", "a.taken"))
    wanted = chosen.select("key", F.inline("taken")).select("key", "size", "m")
    held = rows.filter(open_).select("key", "size", "slice", "order", "id").join(F.broadcast(wanted), ["key", "size"])
    w = W.partitionBy("key", "size").orderBy("slice")
    upto = held.groupBy("key", "size", "slice").agg(F.count("*").alias("n"), F.first("m").alias("m")).withColumn("before", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    limit = upto.filter("before < m").select("key", "size", "slice", (F.col("m") - F.col("before")).alias("room"))  # slices with a document to take
    place = F.row_number().over(W.partitionBy("key", "size", "slice").orderBy("order", "id"))
    taken = held.join(limit, ["key", "size", "slice"]).withColumn("place", place).filter("place <= room")
    bounds = materialize(taken.groupBy("key", "size", "slice").agg(F.max(F.struct("order", "id")).alias("bound")))
    rest = left.join(chosen.select("key", F.col("left").alias("_left")), "key", "left").select("key", F.coalesce("_left", "left").alias("left"))
    return bounds, materialize(rest)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents of ``documents``; contract in the README."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.array("source"), n_words(F.col("text")), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


