"""What the two substring operators share: finding sampled fingerprints that stand in more than one text.

Exact copies of a text are one text.  A fingerprint is repeated when two texts
hold it, or one text holds it twice.  The most frequent ones are known from a
bounded table (they are seen repeated while texts are described, so they need no
counting) and are spread over all tasks; the others are counted by key.  So no
key brings more rows into one task than the few that a batch may hold unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.kernels import U, signed

#: Entries of the table of frequent fingerprints, and in how many texts of one batch each must stand.
FREQUENT, SEEN = 1 << 18, 3


class Batch:
    """Distinct texts of one Arrow batch, by their ids."""

    def __init__(self) -> None:
        self.seen = np.zeros(0, np.int64)

    def first(self, ids: np.ndarray) -> np.ndarray:
        """Which of ``ids`` come for the first time."""
        new = np.zeros(len(ids), bool)
        new[np.unique(ids, return_index=True)[1]] = True
        new &= ~np.isin(ids, self.seen)
        self.seen = np.concatenate((self.seen, ids[new]))
        return new


def once(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (key, owner) once: keys, owners, and whether it came more than once."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return k[at], o[at], np.diff(np.concatenate((at, [len(k)]))) > 1


def frequent_in(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that stand in ``SEEN`` texts of a batch or more, and in how many; each array has a key once a text."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.unique(np.concatenate(keys), return_counts=True)
    return k[c >= SEEN], c[c >= SEEN].astype(np.int64)


def frequent_table(counts: DataFrame) -> np.ndarray:
    """The sorted keys that stand in the most texts, ``FREQUENT`` at most; ``counts`` has key and n."""
    top = counts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "key").limit(FREQUENT)
    return np.sort(top.select("key").toArrow()["key"].to_numpy().view(U))


def entries(keys: np.ndarray, ids: np.ndarray, twice: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    known = np.zeros(len(keys), bool)
    if len(table):
        known = table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys
    return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(ids), pa.array(twice), pa.array(known)], ["key", "id", "twice", "known"])


ENTRIES = "key long, id long, twice boolean, known boolean"


def repeated(rows: DataFrame) -> DataFrame:
    """(id, keys): of each text the repeated keys; ``rows`` are ``ENTRIES``.

    Whether a key is known is the same for all its rows, so the rows of any
    other key stay together.
    """
    spread = F.when(F.col("known"), F.pmod(F.xxhash64("id"), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int")
    w = W.partitionBy("key", "_spread")
    rows = rows.withColumn("_spread", spread)
    rows = rows.withColumn("_hit", F.col("known") | (F.min("id").over(w) != F.max("id").over(w)) | F.max("twice").over(w))
    return rows.filter("_hit").groupBy("id").agg(F.collect_set("key").alias("keys"))


def repeated_anywhere(rows: DataFrame) -> DataFrame:
    """(id, keys) as ``repeated``, of rows (key, other, id, twice) where (key, other) is the fingerprint, of 128 bits.

    Each task reduces what it holds of a fingerprint before the shuffle, so none is gathered.
    """
    held = rows.groupBy("key", "other").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("twice").alias("again"))
    return rows.join(held.filter("lo <> hi or again").select("key", "other"), ["key", "other"]).groupBy("id").agg(F.collect_set("key").alias("keys"))


#: Bits of a table of keys: one size for every input; it spares rows that have no partner, and changes no result.
BITS = 1 << 26


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """A table of ``BITS`` bits with that of each 64-bit key set."""
    at = F.pmod(F.col(column), F.lit(BITS))
    words = keys.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    t = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # BITS / 64 rows at most
    out = np.zeros(BITS >> 6, U)
    out[t["at"].to_numpy()] = t["bits"].to_numpy().view(U)
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = keys.view(np.int64) % BITS
    return (table[at >> 6] >> (at & 63).astype(U)) & U(1) > 0
