"""Ranked lexical search: the highest-scoring documents of each query item, by Fagin's threshold algorithm.

One pass over the texts makes a forward index: of each document the number of its
terms and those that items ask for, with their counts.  From it come the counts of
documents and terms and, for each term asked for, its weight.  A second pass takes the
forward index in blocks of documents.  A block's lists, one for each term, are sorted
by impact (what the term adds to the score of a document).  For each item the lists
of its terms are read round-robin; a document that a list shows for the first time is
looked up in the forward index and scored in full.  No unseen document can have more
than the sum of the impacts last read (the threshold), so reading stops when that
falls strictly below the k-th score known, of this block or of those that the task
read before.  As a document's score needs its own row and the weights only, the
highest of all blocks are the highest of all: no list is ever moved or sorted as a
whole, however many documents hold its term.

The items are taken in blocks of some ``ASKED`` terms (a longer item is a block of
its own); each block is a pass over all documents.  What is shipped to the tasks is
the terms of one block.  Terms are known by fingerprints of 128 bits.

Defined results: a null or empty text, or one without terms, counts as no document
and is found by no item; an item without terms has no rows; items with one id are one
item that has the terms of all; repeated documents count and are ranked each by
itself; equal scores are ordered by doc_id, a null one last; empty tables give no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import lower_ascii, materialize, table
from tidemill.llm.kernels import OTHER_VALUES, U, Words, slices, text_column

#: One term: a run of digits, ASCII letters and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

#: Terms of the items that one pass asks for, entries of the lists that a task holds at once, entries read first from each list.
ASKED, HELD, READ_FIRST = 1 << 20, 1 << 21, 8


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _fingerprints(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), 0, 1, space=_APART)
    return w.hashes(), w.hashes(OTHER_VALUES)


def _lists(owner: np.ndarray, rows: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _index(first: np.ndarray, second: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) to (doc_id, n, terms, counts): how many terms a text has, and which of the sorted fingerprints how often."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_column(b.column("text"))
            for lo, hi in slices(offsets):
                w = Words(data, offsets, lo, hi, lower=True, space=_APART)
                h = w.hashes()
                at = np.minimum(np.searchsorted(first, h), len(first) - 1)
                hit = np.flatnonzero(first[at] == h)
                hit = hit[second[at[hit]] == w.hashes(OTHER_VALUES)[hit]]
                held, counts = np.unique(w.doc_of_word()[hit] * len(first) + at[hit], return_counts=True)
                owner = held // len(first)
                columns = [b.column("doc_id")[lo:hi], pa.array(w.counts.astype(np.int64)), _lists(owner, w.docs, held % len(first)), _lists(owner, w.docs, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return index


class _Block:
    """Documents of a forward index, their lists by term sorted by impact, and the search in them."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, all_terms: int):
        t = pa.Table.from_batches(batches).combine_chunks()
        terms = t["terms"].combine_chunks()
        self.ids, self.term = t["doc_id"].combine_chunks(), terms.flatten().to_numpy()
        count = t["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False)))).astype(np.int64)
        sizes = np.diff(self.at)
        m = 10 + (90 * t["n"].to_numpy().astype(np.int64) * documents) // all_terms
        self.impact = weights[self.term] * ((1_000_000_000 * count) // (1000 * count + 8 * np.repeat(m, sizes)))
        self.place = np.argsort(pc.sort_indices(self.ids, null_placement="at_end").to_numpy())  # in the order of ids
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((-self.impact, self.term))
        self.doc, self.value = owner[order], self.impact[order]
        self.begin = np.searchsorted(self.term[order], np.arange(len(weights) + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The full scores of documents, from the forward index; ``asked`` marks the item's terms."""
        sizes = self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1]) + np.repeat(self.at[docs] - ends + sizes, sizes)
        return np.add.reduceat(np.where(asked[self.term[entry]], self.impact[entry], 0), ends - sizes)

    def top(self, terms: np.ndarray, asked: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest (document, score) above 0, but for those below the ``known`` k-th score of all blocks."""
        at, end = self.begin[terms], self.begin[terms + 1]
        seen = np.zeros(len(self.ids), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read = READ_FIRST
        while (open_ := at < end).any():
            at, end = at[open_], end[open_]
            upto = np.minimum(at + read, end)
            sizes = upto - at
            entry = np.arange(sizes.sum()) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)
            new = np.unique(self.doc[entry])
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                docs, scores = np.concatenate((docs, new)), np.concatenate((scores, self.scores(new, asked)))
                best = np.lexsort((self.place[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(scores) == k:
                    known = max(known, int(scores[-1]))
            # a list read to its end holds no unseen document
            if int(self.value[upto - 1][upto < end].sum()) < known:
                break
            at, read = upto, read * 2
        good = (scores > 0) & (scores >= known)
        return docs[good], scores[good]


def _search(items: list[np.ndarray], weights: np.ndarray, documents: int, all_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a forward index to (item, doc_id, score): what may be among the ``k`` highest of an item, given by its terms."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64) for _ in items]  # the k highest scores that the task has seen
        asked = np.zeros(len(weights), bool)
        for held in _blocks(batches):
            block = _Block(held, weights, documents, all_terms)
            found = []
            for i, terms in enumerate(items):
                asked[terms] = True
                docs, scores = block.top(terms, asked, k, int(best[i][-1]) if len(best[i]) == k else 0)
                asked[terms] = False
                best[i] = -np.sort(-np.concatenate((best[i], scores)))[:k]
                found.append((np.full(len(docs), i), docs, scores))
            item, docs, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), block.ids.take(pa.array(docs)), pa.array(scores)], ["item", "doc_id", "score"])

    return search


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, entries = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            entries += len(b.column("terms").flatten())
        if entries >= HELD:
            yield held
            held, entries = [], 0
    if held:
        yield held


def _one_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """The answers to items (item_id, terms), few enough to be shipped to all tasks."""
    spark = docs.sparkSession
    rows = items.toArrow()
    asked = rows["terms"].combine_chunks()
    vocabulary = pc.unique(asked.flatten()).to_pylist()
    if not vocabulary:
        return None
    first, second = _fingerprints(vocabulary)
    order = np.argsort(first)
    term = np.empty(len(order), np.int64)
    term[order] = np.arange(len(order))
    number = dict(zip(vocabulary, term.tolist(), strict=True))
    kind = docs.schema["doc_id"].dataType
    numbers = T.ArrayType(T.IntegerType())
    index = materialize(docs.mapInArrow(_index(first[order], second[order]), T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("terms", numbers), T.StructField("counts", numbers)])).filter("n > 0"))
    documents, all_terms = index.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = index.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents + 2) / (2 * F.col("count") + 1)))).cast("long")
    heard = df.select("term", weight.alias("weight")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    weights[heard["term"].to_numpy()] = heard["weight"].to_numpy()
    wanted = [np.array([number[x] for x in terms], np.int64) for terms in asked.to_pylist()]
    found = index.mapInArrow(_search(wanted, weights, documents, all_terms, k), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))
    for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):
        by = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    ids = rows.select(["item_id"]).append_column("item", pa.array(np.arange(len(wanted), dtype=np.int32)))
    names = spark.createDataFrame(ids, T.StructType([items.schema["item_id"], T.StructField("item", T.IntegerType())]))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of each item."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    each = items.select(F.col(item_id).alias("item_id"), F.explode(terms_of(F.col(item_text))).alias("term"))
    asked = materialize(each.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ASKED)
    parts = [_one_block(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, parts)


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring of all documents for each item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS w FROM d),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{TERM}')) AS w FROM benchmark),
p AS (SELECT r, doc_id, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY r, doc_id, w),
f AS (SELECT w, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT w, count(*) AS df FROM p GROUP BY w), s),
i AS (SELECT r, doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS impact
    FROM p JOIN n USING (r) JOIN f USING (w), s),
a AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (w) GROUP BY item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
