"""Labelled-dataset preparation: groups, filters, leakage-free splits, weights and sampling.

Shuffles are replaced by orders of a keyed digest, so every result depends on
the rows and the seed alone.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.graph import checkpointed
from tidemill.operators.running import running


def seeded(c: Column, seed: int | str) -> Column:
    """A digest that orders rows as a shuffle would."""
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))


def seeded_number(c: Column, seed: int | str, below: Column | int) -> Column:
    """A number from 0, below a bound."""
    n = F.conv(F.substring(seeded(c, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(n, F.lit(below) if isinstance(below, int) else below)


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def drop_small_classes(rows: DataFrame, label: str, least: int) -> DataFrame:
    keep = label_counts(rows, label).filter(F.col("n") >= least).select(label)
    return rows.join(keep, label, "left_semi")


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """Labels in alphabetical order, numbered from 0; one row a class."""
    return rows.select(label).distinct().withColumn("label_idx", F.row_number().over(W.orderBy(label)) - 1)


def first_label(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(label, order).alias("label"), F.count(F.lit(1)).alias("n"))


def majority_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of a group, the lesser one of equals."""
    n = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b")
    return n.groupBy(group).agg(best).select(group, F.col("b.l").alias("label"), (-F.col("b.m")).alias("n"))


def mixed_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups that hold more than one label."""
    return rows.groupBy(group).agg(F.countDistinct(label).alias("labels")).filter("labels > 1")


def _placed(rows: DataFrame, keep: list[str], label: str, order: list[Column | str]) -> DataFrame:
    """``keep`` with ``_at``, the place among the rows of the label from 0, and ``_n``, how many these are."""
    n = rows.groupBy(F.col(label).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    return running(rows, keep, [label], order, name="_at").join(n, F.col(label).eqNullSafe(F.col("_of"))).drop("_of")


def stratified_split(rows: DataFrame, key: str, label: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Add ``split``: of each label the first shares in seeded order."""
    placed = _placed(rows, rows.columns, label, [seeded(F.col(key), seed), key])
    cut1, cut2 = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    return placed.withColumn("split", F.when(F.col("_at") < cut1, "train").when(F.col("_at") < cut2, "val").otherwise("test")).drop("_at", "_n")


def hashed_split(rows: DataFrame, group: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Add ``split`` such that no group is in two: a group's digest decides, so no order over all groups is needed."""
    u = seeded_number(F.col(group), seed, 10_000) / 10_000.0
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def groups_by_label(rows: DataFrame, group: str, label: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(group, label, rows, split): of each label the groups in seeded order, each where the middle of its rows falls among the label's.

    The last group of a label is for the test and the one before it for the validation, so that a label with three groups is in all splits.
    """
    least, most = F.min(label), F.max(label)
    groups = rows.groupBy(group).agg(least.alias("_label"), F.count(F.lit(1)).alias("_rows"), (~least.eqNullSafe(most) | ((F.count(label) < F.count(F.lit(1))) & least.isNotNull())).alias("_mixed"))
    by = [seeded(F.col(group), seed), group]
    placed = _placed(groups, groups.columns, "_label", by)
    before = running(placed, placed.columns, ["_label"], by, F.col("_rows"), "_before")
    whole = groups.groupBy(F.col("_label").alias("_l")).agg(F.sum("_rows").alias("_all"))
    before = before.join(whole, F.col("_label").eqNullSafe(F.col("_l")))
    middle = F.col("_before") + F.col("_rows") / 2
    share = F.when(middle < F.col("_all") * train, "train").when(middle < F.col("_all") * (train + val), "val").otherwise("test")
    last = F.col("_n") - F.col("_at")
    split = F.when(last == 1, "test").when(last == 2, "val").when(F.col("_at") == 0, "train").otherwise(share)
    return before.select(group, F.col("_label").alias("label"), F.col("_rows").alias("rows"), "_mixed", split.alias("split"))


def grouped_split(rows: DataFrame, key: str, group: str, label: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Add ``split`` and ``grouped``: by whole groups, or, where that can't be, stratified by label without regard to groups.

    It can't be where a group has two labels, or a label is not in all three splits, as one with fewer than three groups.
    """
    groups = checkpointed(groups_by_label(rows, group, label, seed, train, val))
    labels = groups.groupBy("label").agg(F.countDistinct("split").alias("splits"), F.max("_mixed").alias("mixed"))
    bad = labels.agg(F.max(F.col("mixed") | (F.col("splits") < 3)).alias("bad")).first().bad
    if bad:
        return stratified_split(rows, key, label, seed, train, val).withColumn("grouped", F.lit(False))
    placed = groups.select(F.col(group).alias("_group"), "split")
    return rows.join(placed, F.col(group).eqNullSafe(F.col("_group"))).drop("_group").withColumn("grouped", F.lit(True))


def entity_split(rows: DataFrame, entity: str, label: str, seed: int) -> DataFrame:
    """Stratify entities by their majority label; all rows of one follow it."""
    major = majority_label(rows, entity, label).select(entity, F.col("label").alias("_major"))
    placed = stratified_split(major, entity, "_major", seed).select(entity, "split")
    return rows.join(placed, entity)


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split; empty when nothing leaks."""
    return rows.groupBy(key).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def coverage(rows: DataFrame, label: str) -> DataFrame:
    """Of each label the number of splits that hold it."""
    return rows.groupBy(label).agg(F.countDistinct("split").alias("splits"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """N / (classes * n) of each class."""
    n = label_counts(rows, label)
    total = n.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return n.join(F.broadcast(total)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def inverse_weights(rows: DataFrame, label: str) -> DataFrame:
    """1 / n, made to sum to 1 over the classes."""
    n = label_counts(rows, label).withColumn("_w", 1 / (F.col("n") + 1e-6))
    return n.join(F.broadcast(n.agg(F.sum("_w").alias("_s")))).select(label, "n", (F.col("_w") / F.col("_s")).alias("weight"))


def sample_with_replacement(rows: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` draws of each class: a digest picks a place in the class's order."""
    placed = _placed(rows.select(label, key), [label, key], label, [key])
    draws = placed.groupBy(label).agg(F.first("_n").alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k))))
    draws = draws.withColumn("_at", seeded_number(F.concat_ws("|", F.col(label), F.col("draw").cast("string")), seed, F.col("_n")))
    return draws.select(label, "draw", "_at").join(placed.drop("_n"), [label, "_at"]).select(label, "draw", key)


def weighted_draws(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """(draw, key): ``n`` draws with replacement, each row with a chance in proportion to its weight, a whole number.

    A draw is a point below the sum of all weights; the row is the last one whose weights before it do not exceed the point.
    Points and rows are put in one order, and counting the rows before a point gives its row's place.
    """
    rows = rows.filter(F.col(weight) > 0).select(key, weight)
    placed = checkpointed(running(rows, [key], [], [key], F.col(weight).cast("long"), "_point").withColumn("_draw", F.lit(0).cast("long")))
    whole = rows.agg(F.sum(F.col(weight).cast("long")).alias("n")).first().n
    if not whole:
        return placed.select(F.col("_draw").alias("draw"), key).limit(0)
    digest = F.conv(F.substring(seeded(F.col("id"), seed), 1, 15), 16, 10).cast("long")
    draws = rows.sparkSession.range(1, n + 1).select(F.lit(None).cast(placed.schema[key].dataType).alias(key), F.pmod(digest, F.lit(whole)).alias("_point"), F.col("id").alias("_draw"))
    both = placed.select(key, "_point", "_draw").unionByName(draws)
    is_row = F.when(F.col("_draw") == 0, 1).otherwise(0).cast("long")
    counted = checkpointed(running(both, [key, "_draw"], [], ["_point", "_draw", key], is_row, "_at"))
    at = counted.filter("_draw = 0").select(key, (F.col("_at") + 1).alias("_at"))
    return counted.filter("_draw > 0").select("_draw", "_at").join(at, "_at").select(F.col("_draw").alias("draw"), key)


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, each next one with a chance in proportion to its weight: those with the least exponential numbers."""
    u = (F.conv(F.substring(seeded(F.col(key), seed), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return rows.filter(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(n)


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """The union of dimensions in which a later one overrides an earlier one."""
    union = None
    for i, t in enumerate(tables):
        t = t.withColumn("_o", F.lit(i))
        union = t if union is None else union.unionByName(t)
    w = W.partitionBy(key).orderBy(F.col("_o").desc())
    return union.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_o")


def conversations(rows: DataFrame, dimension: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Question-answer turns of each row from its label's entry: an array of (role, content)."""
    asks = F.array(F.lit("What is shown here?"), F.lit("Which disease is this?"), F.lit("How should this be treated?"))
    ask = F.element_at(asks, (seeded_number(F.col(key), seed, 3) + 1).cast("int"))
    answer = F.concat(F.lit("This looks like "), F.col("title"), F.lit(". "), F.col("advice"))
    turns = F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return rows.join(dimension, label).select(key, label, turns.alias("conversations"))


def unknown_labels(rows: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """(label, n): labels that the dimension lacks, and how many rows have them."""
    return rows.join(known.select(label).distinct(), label, "left_anti").groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def require_known(rows: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """``rows``, or an error that names an unknown label."""
    bad = unknown_labels(rows, known, label).limit(1).collect()
    if bad:
        raise ValueError(f"unknown label: {bad[0][label]}")
    return rows


def without_samples(known: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """The classes of the dimension that no row has."""
    return known.join(rows.select(label).distinct(), label, "left_anti")


def with_label_index(rows: DataFrame, label: str) -> DataFrame:
    """Add ``label_idx``, the place of the label among all labels in order, from 0; labels are a dimension."""
    names = rows.select(label).filter(F.col(label).isNotNull()).distinct()
    index = names.select(label, (F.row_number().over(W.orderBy(label)) - 1).alias("label_idx"))
    return rows.join(index, label, "left")


def _digits(seed: str, *parts: Column) -> Column:
    """A number of 48 bits from a seed and values."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def permuted(place: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """A place from 0, below ``n``, for each such place, no two alike.

    The places below ``a * b``, with a * b just above n, are pairs of digits; in turns one digit is moved by a digest of the other.
    A place that leaves the range is moved on until it is back, which is less than ``a`` times.
    """
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)

    def once_more(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, F.lit(b))
        for r in range(0, rounds, 2):
            left = F.pmod(left + _digits(f"{r}|{seed}", right), F.lit(a))
            right = F.pmod(right + _digits(f"{r + 1}|{seed}", left), F.lit(b))
        return left * b + right

    walk = F.sequence(F.lit(1), F.lit(max(1, min(64, a * b - n + 1))))
    return F.aggregate(walk, F.lit(-1).cast("long"), lambda x, i: F.when((x >= 0) & (x < n), x).otherwise(once_more(F.when(x < 0, place).otherwise(x))))


def beta_draw(u: Column, alpha: float, points: int = 1024) -> Column:
    """The value of a symmetric Beta distribution below which a share ``u`` lies, between the values at ``points`` even shares."""
    if alpha == 1.0:
        return u
    if alpha == 0.5:
        return F.pow(F.sin(u * (math.pi / 2)), F.lit(2.0))
    x = (1 - np.cos(np.linspace(0, math.pi, 200_001))) / 2  # finer at both ends
    middle, width = (x[1:] + x[:-1]) / 2, np.diff(x)
    share = np.concatenate(([0.0], np.cumsum((middle * (1 - middle)) ** (alpha - 1) * width)))
    value = np.interp(np.linspace(0, 1, points + 1), share / share[-1], x)
    table = F.lit([float(v) for v in value])
    at = F.least(F.floor(u * points), F.lit(points - 1)).cast("int")
    low, high = F.get(table, at), F.get(table, at + 1)
    return low + (high - low) * (u * points - at)


def mixed_rows(rows: DataFrame, key: str, vector: str, label: str, alpha: float, seed: int, weights: DataFrame | None = None) -> DataFrame:
    """(key, partner, share, vector, labels, weight): each row mixed with another one's vector and label, every row once as a partner.

    ``share`` is drawn from a symmetric Beta distribution; ``labels`` has the share of each label, which add up to 1;
    ``weights`` (label, weight) are mixed alike, a label without one counts 1.
    """
    rows = rows.select(key, vector, label)
    if weights is not None:
        named = weights.select(F.col(label).alias("_of"), F.col("weight").alias("_w"))
        rows = rows.join(named, F.col(label).eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    rows = rows.withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    placed = checkpointed(running(rows, rows.columns, [], [key], name="_at"))
    n = placed.count()
    share = beta_draw(_digits(f"share|{seed}", F.col(key)) / float(1 << 48), alpha)
    first = placed.withColumns({"share": share, "_to": permuted(F.col("_at"), max(n, 1), seed)})
    second = placed.select(F.col(key).alias("partner"), F.col(vector).alias("_v"), F.col(label).alias("_l"), F.col("_w").alias("_w2"), F.col("_at").alias("_to"))
    mix = lambda x, y: F.col("share") * x + (1 - F.col("share")) * y
    same = F.when(F.col(label).eqNullSafe(F.col("_l")), F.array(F.struct(F.col(label).alias("label"), F.lit(1.0).alias("share"))))
    both = F.array(F.struct(F.col(label).alias("label"), F.col("share").alias("share")), F.struct(F.col("_l").alias("label"), (1 - F.col("share")).alias("share")))
    mixed = F.zip_with(vector, "_v", lambda x, y: mix(x.cast("double"), y.cast("double")))
    return first.join(second, "_to").select(key, "partner", "share", mixed.alias(vector), F.coalesce(same, both).alias("labels"), mix(F.col("_w"), F.col("_w2")).alias("weight"))


def in_all_splits(rows: DataFrame, label: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Labels that every split has."""
    held = [rows.filter(F.col("split") == s).select(label).distinct() for s in splits]
    return reduce(DataFrame.intersect, held)


def missing_labels(rows: DataFrame, label: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(label, split): labels that a split has not."""
    every = rows.select(label).distinct().select(label, F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    return every.subtract(rows.select(label, "split"))
