"""Substring dedup by level-wise doubling of repeated word windows.

A window repeated at a length holds repeated windows of half that length, so
only windows that are repeated at one length are extended to twice that length;
a level that leaves no candidates ends the search.  Levels are ``FIRST`` words,
twice that, and so on, the last one cut to the wanted length; longer windows
cover no other words, and of shorter ones nearly every text repeats some.

A window of the wanted length is followed through the levels by one sampled
window of each level's length, the one with the least fingerprint among those
that it holds: equal windows sample alike.  The last level looks at every
candidate window.  Each level is one counted shuffle of fingerprints of what the
level before left; texts without candidates leave at once, and exact copies of a
text are one text throughout.

Fingerprints are 64 bits wide where they choose candidates and 128 bits at the
last level, which decides.  Copies of a text are known by 64 bits: two different
texts of a corpus are one with a chance of the square of their number in 2^65.

Defined results: a null or empty text has no words and nothing removed; repeated
rows are copies of each other, all of whose windows are repeated; a text with
fewer words than a window keeps all; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, materialize, table
from tidemill.llm.kernels import OTHER_VALUES, U, Words, anchors, grams, mix, signed, slices, text_column
from tidemill.llm.repeats import ENTRIES, Batch, entries, frequent_in, frequent_table, once, repeated, repeated_anywhere

#: Words of the first level.
FIRST = 8
_EMPTY = hashlib.sha256(b"").hexdigest()


class Text(Words):
    """The words of a slice of texts, the ids of the texts, and their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        super().__init__(data, offsets, lo, hi)
        self.h = self.hashes()
        place = np.arange(len(self.h)) - np.repeat(self.at[:-1], self.counts)
        sums = np.concatenate(([U(0)], np.cumsum(mix(self.h + (place.astype(U) << U(1)) * U(0x9E3779B97F4A7C15)), dtype=U)))
        self.ids = signed(mix(sums[self.at[1:]] - sums[self.at[:-1]] + self.counts.astype(U)))

    def sampled(self, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled windows of ``size`` words: (key, text, first and last of the windows of ``length`` words that it stands for, place)."""
        g = grams(self.h, size)
        at, first, last = anchors(g, length - size + 1)
        doc = self.doc_of_word()[at]
        first = np.maximum(first, self.at[doc])
        last = np.minimum(last, self.at[doc + 1] - length)
        ok = first <= last
        return g[at[ok]], doc[ok], first[ok], last[ok], at[ok]

    def alive(self, keys: list[np.ndarray], size: int, length: int) -> np.ndarray:
        """At each word, whether the window from it on may be repeated: its sampled window is among ``keys`` of its text."""
        key, doc, first, last, _ = self.sampled(size, length)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        wanted = np.concatenate(keys) if len(keys) else np.zeros(0, np.int64)
        pair = lambda k, d: mix(k ^ mix(d.astype(U) + U(1)))
        hit = np.isin(pair(key, doc), pair(wanted.view(U), owner))
        edge = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(edge, first[hit], 1)
        np.add.at(edge, last[hit] + 1, -1)
        return np.cumsum(edge[:-1]) > 0


def levels(length: int) -> list[int]:
    """The lengths of the search: doubled from ``FIRST``, or from the half of a shorter length, up to ``length``."""
    out = [FIRST if length > FIRST else max(1, length // 2)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, int, Text]]:
    data, offsets = text_column(column)
    for lo, hi in slices(offsets):
        yield lo, hi, Text(data, offsets, lo, hi)


def _describe(docs: DataFrame, size: int, length: int) -> DataFrame:
    """Kind 0: (doc_id, n, id, sha) of each document; kind 1: (key, n) frequent sampled windows."""
    names = ["kind", "doc_id", "n", "key", "sha"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch, found = Batch(), []
            for lo, hi, t in _texts(b["text"]):
                raw = t.bytes.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[x:y].split())).hexdigest() for x, y in zip(t.byte_at[:-1].tolist(), t.byte_at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), b["doc_id"].slice(lo, hi - lo), pa.array(t.counts.astype(np.int64)), pa.array(t.ids), pa.array(sha)], names)
                key, doc, *_ = t.sampled(size, length)
                new = batch.first(t.ids)[doc]
                found.append(once(key[new], doc[new])[0])
            k, c = frequent_in(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), pa.nulls(len(k), b["doc_id"].type), pa.array(c), pa.array(signed(k)), pa.nulls(len(k), pa.string())], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tasks, f"kind int, doc_id {kind}, n long, key long, sha string")


def _first_level(docs: DataFrame, size: int, length: int, known) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = Batch()
            for _, _, t in _texts(b["text"]):
                key, doc, *_ = t.sampled(size, length)
                new = batch.first(t.ids)[doc]
                k, d, twice = once(key[new], doc[new])
                yield entries(k, t.ids[d], twice, known.value)

    return docs.select("text").mapInArrow(tasks, ENTRIES)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _matching(rows: DataFrame) -> DataFrame:
    """Only the rows whose text is the one meant, as a doc_id may stand for several."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b["id"].to_numpy()
            for lo, hi, t in _texts(b["text"]):
                yield b.slice(lo, hi - lo).filter(pa.array(t.ids == want[lo:hi]))

    return rows.select("id", "text", "keys").mapInArrow(tasks, "id long, text string, keys array<long>")


def _next_level(texts: DataFrame, before: int, size: int, length: int) -> DataFrame:
    """(key, other, id, twice): of each text the sampled windows of ``size`` words whose windows survived the level ``before``."""
    names = ["key", "other", "id", "twice"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, ids = _lists(b["keys"]), b["row"].to_numpy()
            for lo, hi, t in _texts(b["text"]):
                sums = np.concatenate(([0], np.cumsum(t.alive(lists[lo:hi], before, length))))
                key, doc, first, last, at = t.sampled(size, length)
                left = sums[last + 1] > sums[first]
                k, d, twice = once(key[left], doc[left])
                # the other half of the fingerprint, found again by the first
                other = grams(t.hashes(OTHER_VALUES), size, salt=1)[at[left]]
                order = np.lexsort((key[left], doc[left]))
                kk, dd = key[left][order], doc[left][order]
                new = np.ones(len(kk), bool)
                new[1:] = (kk[1:] != kk[:-1]) | (dd[1:] != dd[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(signed(other[order[new]])), pa.array(ids[lo:hi][d]), pa.array(twice)], names)

    return texts.select("row", "text", "keys").mapInArrow(tasks, "key long, other long, id long, twice boolean")


def _removed(texts: DataFrame, length: int) -> DataFrame:
    """(id, n_removed, sha) of texts with their repeated windows."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = _lists(b["keys"])
            for lo, hi, t in _texts(b["text"]):
                start = np.flatnonzero(t.alive(lists[lo:hi], length, length))
                edge = np.zeros(len(t.h) + 1, np.int64)
                edge[start] += 1
                edge[start + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                raw = t.bytes.tobytes()
                sha, n = [], []
                for d in range(hi - lo):
                    x, y = int(t.at[d]), int(t.at[d + 1])
                    g = gone[x:y]
                    words = raw[int(t.byte_at[d]) : int(t.byte_at[d + 1])].split()
                    n.append(int(g.sum()))
                    sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~g)])).hexdigest())
                yield pa.RecordBatch.from_arrays([b["id"].slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sha)], ["id", "n_removed", "sha"])

    return texts.select("id", "text", "keys").mapInArrow(tasks, "id long, n_removed long, sha string")


def remove_repeated_words(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sizes = levels(length)
    both = materialize(_describe(docs, sizes[0], length))
    base = both.filter("kind = 0").select("doc_id", F.col("n").alias("n_words"), F.col("key").alias("id"), "sha")
    one = base.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    known = spark.sparkContext.broadcast(frequent_table(both.filter("kind = 1").select("key", "n")))
    hits = repeated(_first_level(docs, sizes[0], length, known))
    want = hits.join(one, "id").select("id", F.col("doc_id").alias("_first"), "keys")
    rows = docs.select("doc_id", "text").join(want, F.col("doc_id").eqNullSafe(F.col("_first")))
    texts = materialize(_matching(rows).withColumn("row", F.monotonically_increasing_id()))
    for before, size in pairwise(sizes):
        if texts.isEmpty():  # no candidates survive
            break
        found = materialize(_next_level(texts, before, size, length))
        again = repeated_anywhere(found).withColumnRenamed("id", "row")
        texts, old = materialize(texts.drop("keys").join(again, "row")), texts
        discard(found, old)
    part = _removed(texts, length).groupBy("id").agg(F.max("n_removed").alias("n_removed"), F.max("sha").alias("sha"))
    out = base.join(one.select("id", "copies"), "id").join(part.select("id", F.col("n_removed").alias("_n"), F.col("sha").alias("_sha")), "id", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= length)
    return out.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(_EMPTY)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )


def op9_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of windows of 35 words that stand anywhere else from all documents."""
    return remove_repeated_words(table(spark, sf_dir, "documents"), 35)
