"""How the filters of a corpus interact: what each removes, alone, after others and on average over all orders.

Every row of a table is tested by all filters and gets a mask with one bit for
each that it fails.  Masks are additive: a part of the table needs only its
number of rows (and of labelled rows) by mask, at most two to the power of the
filters, and every order of the filters is answered from these counters.

One filter fails the rows whose text a row with a smaller id has.  Copies are
found by sorting: rows are dealt by ranges of (fingerprint, id) and each range is
sorted by (fingerprint, text, id), so that equal texts are neighbours and a row
is compared with its predecessor, whole texts, not fingerprints.  A run of equal
texts that ranges cut is put together again by one row for each range: the texts
with its last fingerprint and their least id.  As the id is part of the bounds, a
text that a third of all rows have is cut into many ranges.  (Texts are not part
of the bounds: these are made from a sample on the driver.)

Orders are listed in full, so there should be no more than six filters or so.

Defined results: a null text is empty, a null part the empty string; a null id
is larger than all others and no smaller than another null; repeated rows (same
id, same text) are not copies of each other and each counts; a row's label is
the largest one that its id has, and a null id has none; empty tables give no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import WORD, materialize, table, word_array


def _predecessors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range with id, part, mask, key and text: rows (id, part, mask, copy, edge), and what its last key leaves behind.

    ``copy`` says that a row before it in the range has its text and another id.
    ``edge`` is the digest of the text where the key is the range's first one;
    rows without a mask at the end have in it the digests of the last key's texts, beside their least ids.
    """
    out = ("id", "part", "mask", "copy", "edge")
    first_key = last_key = held = None  # held: text and least id of the run that the last batch ended in
    tail: dict[bytes, pa.Scalar] = {}  # texts of the last key by digest
    for b in batches:
        if not b.num_rows:
            continue
        ids, texts, keys = b.column("id"), b.column("text"), b.column("key").to_numpy()
        if held:
            ids, texts = pa.concat_arrays([pa.array([held[1].as_py()], ids.type), ids]), pa.concat_arrays([pa.array([held[0]], texts.type), texts])
        skip = len(ids) - len(keys)
        new = np.ones(len(ids), bool)
        new[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        run = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        least = ids.take(pa.array(run))
        # nulls come last, so a run whose least id is null has no other
        copy = pc.and_(least.is_valid(), pc.fill_null(pc.not_equal(ids, least), True))
        first_key = int(keys[0]) if first_key is None else first_key
        edge: list[bytes | None] = [None] * len(keys)
        digest = b""
        for i in np.flatnonzero(keys == first_key) + skip:
            if new[i] or not digest:
                digest = hashlib.sha256(texts[int(i)].as_py().encode()).digest()
            edge[i - skip] = digest
        yield pa.RecordBatch.from_arrays([ids[skip:], b.column("part"), b.column("mask"), copy[skip:], pa.array(edge, pa.binary())], out)
        if keys[-1] != last_key:
            last_key, tail = int(keys[-1]), {}
        at = np.flatnonzero(keys == last_key) + skip
        for i in at[new[at] | (at == at[0])]:
            tail.setdefault(hashlib.sha256(texts[int(i)].as_py().encode()).digest(), least[int(i)])
        held = texts[-1].as_py(), least[-1]
        kinds = ids.type, b.column("part").type, b.column("mask").type
    if tail:
        n = len(tail)
        columns = [pa.array([x.as_py() for x in tail.values()], kinds[0]), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]), pa.nulls(n, pa.bool_()), pa.array(list(tail), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, out)


def failure_masks(docs: DataFrame, conditions: dict[str, Column], features: dict[str, Column] | None = None, *, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(id, part, mask) of each row: bit i for the i-th condition, the next bit for a text that a smaller id has.

    Conditions are on column ``text`` and on ``features``, columns made from it once a row.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    dealt = rows.repartitionByRange("key", F.col("id").asc_nulls_last()).sortWithinPartitions("key", "text", F.col("id").asc_nulls_last())
    for name, c in (features or {}).items():
        dealt = dealt.withColumn(name, c)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0)).cast("int")
    dealt = dealt.select("id", "part", mask.alias("mask"), "key", "text")
    kind = dealt.schema["id"].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in (("id", kind), ("part", T.StringType()), ("mask", T.IntegerType()), ("copy", T.BooleanType()), ("edge", T.BinaryType()))])
    seen = materialize(dealt.mapInArrow(_predecessors, schema))
    left = seen.filter("mask is null").groupBy("edge").agg(F.min("id").alias("least"))  # one row a range, but for texts with one fingerprint
    seen = seen.filter("mask is not null").join(F.broadcast(left), "edge", "left")
    copy = F.col("copy") | (F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least"))))
    return seen.select("id", "part", (F.col("mask") + F.when(copy, 1 << len(conditions)).otherwise(0)).alias("mask"))


def mask_counters(masks: DataFrame, labels: DataFrame, good: Column, toxic: Column, label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows by mask, and how many of them have a label for which the conditions hold."""
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    marks = labels.groupBy(F.col(label_id).alias("id")).agg(flag(good).alias("good"), flag(toxic).alias("toxic"))
    rows = masks.groupBy("id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "id", "left")
    marked = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def interactions(counters: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step of the order, from the counters of ``mask_counters``.

    ``names`` has a letter for each bit of the masks, lowest first.
    """
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, bit in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[i] for i in order), "step": step, "before": before, "bit": 1 << bit})
            before |= 1 << bit
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, bit int>>")
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # a part has at most 2 ** len(names)
    rows = counters.groupBy("part").agg(cells.alias("cells")).select("part", "cells", F.explode(listed).alias("s"))

    def total(condition, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("cells", lambda x: condition(x["mask"])), F.lit(0).cast("long"), lambda s, x: s + value(x))

    before, bit = F.col("s.before"), F.col("s.bit")
    earlier, fails = lambda m: m.bitwiseAND(before) != 0, lambda m: m.bitwiseAND(bit) != 0
    first = lambda m: ~earlier(m) & fails(m)
    # of all orders, a filter comes first among the c that a row fails in one of c
    share = lambda x: x["n"] * F.lit(factorial(len(names))) / F.bit_count(x["mask"])
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        total(lambda m: ~earlier(m) & ~fails(m)).alias("kept"),
        total(first).alias("removed"),
        total(lambda m: earlier(m) & fails(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(first, lambda x: x["good"]).alias("good_lost"),
        total(first, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: share(x).cast("long")).alias("shapley"),
    )


def features() -> dict[str, Column]:
    """What the filters of the registered query look at, each made from the ones before."""
    return {
        "words": word_array(F.col("text")),
        "n_words": F.size("words"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_chars": F.length("text").cast("long"),
        "n_upper": F.col("n_chars") - F.length(F.regexp_replace("text", "[A-Z]+", "")),
    }


def conditions() -> dict[str, Column]:
    """Four filters of the registered query; the fifth, E, is the one for copies."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 2 * F.col("n_chars"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source and over all 120 orders."""
    masks = failure_masks(table(spark, sf_dir, "documents"), conditions(), features())
    labels = table(spark, sf_dir, "labels")
    return interactions(mask_counters(masks, labels, F.col("quality") == 1, F.col("toxic") == 1), "ABCDE")


OP11_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
m AS (
    SELECT doc_id, part,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT chr(65 + i::INTEGER) AS name, (1 << i::INTEGER) AS bit FROM range(5) r(i)),
o AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
    SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
    FROM o, range(1, 6) r(step))
SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
