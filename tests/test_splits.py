"""Splits, draws and the order of modules with cycles, against plain programs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators import code, dataset, graph
from tidemill.plans import rules


def _md5(*x):
    return hashlib.md5("".join(str(v) for v in x).encode()).hexdigest()


def _rows(spark, labels):
    rows, rng = [], random.Random(2)
    for g, label in labels:
        rows += [(len(rows) + i, g, label) for i in range(rng.choice([1, 2, 30]))]
    return rows, spark.createDataFrame(rows, "id long, g string, label string").repartition(4)


def test_groups_stay_whole_and_labels_are_everywhere(spark):
    rows, df = _rows(spark, [(f"g{i}", f"l{i % 3}") for i in range(40)] + [("x", "rare"), ("y", "rare"), ("z", "rare")] + [(None, "l1")])
    out = dataset.grouped_split(df, "id", "g", "label", 5).collect()
    assert len(out) == len(rows) and all(r.grouped for r in out)
    assert all(len({r.split for r in out if r.g == g}) == 1 for g in {r.g for r in out})
    assert all({r.split for r in out if r.label == label} == {"train", "val", "test"} for label in ("l0", "l1", "l2", "rare"))
    share = Counter(r.split for r in out if r.label != "rare")
    assert 0.6 < share["train"] / sum(share.values()) < 0.9


@pytest.mark.parametrize("extra", [[("g1", "other")], [("a", "two"), ("b", "two")], [("a", "one")], [("g1", None)]])
def test_fallback(spark, extra):
    rows, df = _rows(spark, [(f"g{i}", f"l{i % 3}") for i in range(30)] + extra)
    out = dataset.grouped_split(df, "id", "g", "label", 5).collect()
    assert len(out) == len(rows) and not any(r.grouped for r in out)
    want = {}
    for label in {r[2] for r in rows}:
        of = sorted((r[0] for r in rows if r[2] == label), key=lambda i: (_md5(i, "|5"), i))
        n = len(of)
        want |= {i: "train" if p < int(n * 0.8) else "val" if p < int(n * 0.9) else "test" for p, i in enumerate(of)}
    assert {r.id: r.split for r in out} == want


def test_empty_split(spark):
    df = spark.createDataFrame([], "id long, g string, label string")
    assert dataset.grouped_split(df, "id", "g", "label", 5).collect() == [] and dataset.weighted_draws(df.selectExpr("id", "1 w"), "id", "w", 3, 1).collect() == []


def test_weighted_draws(spark):
    weights = [(i, w) for i, w in enumerate([3, 0, 1, 50, None, 1, 1, 200, 2, -4] + [1] * 40)]
    df = spark.createDataFrame(weights, "id long, w int").repartition(3)
    got = {r.draw: r.id for r in dataset.weighted_draws(df, "id", "w", 300, 4).collect()}
    held = [i for i, w in weights for _ in range(max(w or 0, 0))]
    assert got == {d: held[int(_md5(d, "|4")[:15], 16) % len(held)] for d in range(1, 301)}
    sample = [r.id for r in dataset.weighted_sample(df, "id", "w", 30, 4).collect()]
    assert len(set(sample)) == 30 and not {1, 4, 9} & set(sample) and {3, 7} <= set(sample)


def test_budget_over_large_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([1, 5, 9, None])) for i in range(500)]
    out = code.within_budget(spark.createDataFrame(rows, "g string, i int, tokens int"), ["g"], ["i"], 200).collect()
    used = Counter()
    want = {}
    for g, i, n in rows:
        used[g] += n or 0
        want[i] = (used[g], used[g] <= 200)
    assert {r.i: (r.used, r.selected) for r in out} == want


@pytest.mark.parametrize("seed", range(3))
def test_order_with_cycles(spark, seed):
    rng = random.Random(seed)
    n = 25
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([15, 30, 50]))] + [(0, 99), (3, 3)]
    vertices = spark.createDataFrame([(i,) for i in range(n)], "module long")
    got = {r.module: r for r in graph.order(vertices, spark.createDataFrame(edges, "src long, dst long")).collect()}
    out = defaultdict(set)
    for a, b in edges:
        if b < n:
            out[a].add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    all_ = {i: reach(i) for i in range(n)}
    component = {i: min(j for j in all_[i] if i in all_[j]) for i in range(n)}
    assert {i: got[i].component for i in range(n)} == component

    def level(c):
        below = {component[b] for a in range(n) if component[a] == c for b in out[a]} - {c}
        return 1 + max(map(level, below)) if below else 0

    assert {i: got[i].level for i in range(n)} == {i: level(component[i]) for i in range(n)}


@pytest.mark.parametrize("seed, budget", [(1, 200), (2, 37), (3, 0), (4, 100_000), (5, 60)])
def test_greedy_budgets_over_large_groups(spark, seed, budget):
    rng = random.Random(seed)
    sizes = [[1, 5, 9, None, 0], list(range(1, 60)), [3], [1, 100, 99, 98], [60, 41, 40, 20, 2, 1]][seed - 1]
    rows = [(rng.choice(["a", "a", "b", None]), rng.randint(0, 150), rng.choice(sizes)) for _ in range(300)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, i int, tokens int").repartition(3)
    for run, stops in ((code.greedy_budget, False), (code.budget_until_misfit, True)):
        want = {}
        for g in {r[0] for r in rows}:
            used = taken = 0
            for _, n in sorted((i, n) for h, i, n in rows if h == g and n is not None):
                if used + n <= budget:
                    used, taken = used + n, taken + 1
                elif stops:
                    break
            want[g] = (used, taken)
        assert {r.g: (r.used, r.taken) for r in run(df, ["g"], "i", "tokens", budget).collect()} == want


def test_many_rules_are_not_looked_up_in_the_row(spark):
    rules = spark.range(code.FEW + 1).selectExpr("id as ord", "cast(id as string) as key", "'x' as replacement")
    lines = spark.createDataFrame([("a 7 b",)], "line_text string")
    with pytest.raises(ValueError, match="more than"):
        code.first_contained(lines, rules)
    assert code.first_contained(lines, rules.limit(code.FEW)).first().key == "7"


def test_a_literal_table_is_the_side_that_is_broadcast(spark):
    dim = rules.literal_table(spark, [("A", "Spot", None), ("N", "None", "Nothing.")], "label string, title string, advice string")
    assert dim.schema.simpleString() == "struct<label:string,title:string,advice:string>"
    assert [tuple(r) for r in dim.collect()] == [("A", "Spot", None), ("N", "None", "Nothing.")]
    rows = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("label"))
    plan = dataset.conversations(rows, dim, "label", "key", 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
    empty = rules.literal_table(spark, [], "ord long, key string")
    assert empty.schema.simpleString() == "struct<ord:bigint,key:string>" and empty.count() == 0


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    """Levels and components of a chain of 300 modules in blocks, some of it closed to a cycle; a round for each module would take 300."""
    n, rounds = 300, []
    vertices = spark.createDataFrame([(f"m{i:03d}",) for i in range(n)], "module string")
    chain = [(f"m{i:03d}", f"m{i - 1:03d}") for i in range(1, n)]
    kept = graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df: rounds.append(1) or kept(df))
    for size in (graph.BLOCK, 64):
        monkeypatch.setattr(graph, "BLOCK", size)
        rounds.clear()
        got = dict(tuple(r) for r in graph.levels(vertices, spark.createDataFrame(chain, "src string, dst string")).collect())
        assert got == {f"m{i:03d}": i for i in range(n)} and len(rounds) < 12
        rounds.clear()
        closed = spark.createDataFrame([*chain, ("m050", "m250"), ("m260", "m270")], "src string, dst string")
        got = {r.module: (r.component, r.level) for r in graph.order(vertices, closed).collect()}
        want = {i: (i, i) if i < 50 else (50, 50) if i <= 250 else (i, i - 200) if i < 260 else (260, 60) if i <= 270 else (i, i - 210) for i in range(n)}
        assert got == {f"m{i:03d}": (f"m{c:03d}", v) for i, (c, v) in want.items()} and len(rounds) < 80
