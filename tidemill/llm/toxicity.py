"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
text, are counted by Spark over all labelled training rows:

    P_c(w | v) = (max(n_c(v w) - D, 0) + (left_c(v) + STRENGTH) Q_c(w | v)) / (n_c(v) + STRENGTH)
    Q_c(w | v) = both(v w) + (1 - both(v)) P_c(w)
    P_c(w)     = (max(k_c(w) - D, 0) + left_c P(w)) / k_c

where n are counts of pairs, k counts of the contexts of a word, "left" what the
discounts free, both(v w) the lesser of both classes' discounted shares max(n_c(v w) - D, 0) / n_c(v)
and both(v) its sum.  P(w) is of both classes together: rare expressions are smoothed
through the pairs that both agree on and the continuation counts that they share.
STRENGTH says how often a class must have seen a context before its own pairs weigh
as much as the shared ones: in small corpora a class's own shares are mostly chance.

A document's score is the length-normalised difference of its two
log-likelihoods, calibrated on a sample of training rows.  The difference is a robust
mean: the median of its words is taken off, which is what all of them share (its
language, its register), and a word counts between ``-NEAR`` and ``FAR``.

Symbols are words; counts are of documents that hold them, so a text that repeats itself, or a copy of it, adds nothing; a word that fewer than ``MIN_COUNT`` documents hold is the class of its first five
bytes, so a rare expression is smoothed through what its kin have in common.  What neither class has seen tells nothing.

Counts are aggregated by key with partial sums and stay tables: every word and pair
that ``MIN_COUNT`` documents hold and every prefix class has its row, however many
there are; the mass of rarer pairs goes to the backoff, exactly.  For scoring, tasks have
a bounded table of the most frequent rows; batches of texts ask for the others that they need, by a join.  All labelled rows of folds 1 to 4 are counted.
Calibration fits three numbers on at most ``CALIBRATION`` of them, those of least hash; each of
these is scored without its own counts (a pair of it that has no row counts as its own alone).

Defined results: a null or empty text scores by its length alone;
labels that are null or belong to no document are ignored, a document labelled
more than once counts once, as toxic if any of its labels says so; with no
labels at all every score is 0; repeated documents are all scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.llm.common import discard, materialize, materialize_bucketed, sweep, table
from tidemill.llm.kernels import U, Words, mix, slices, text_column
from tidemill.llm.repeats import bit_table, may_hold

CALIBRATION = 10_000
#: Bytes of text whose questions to the model are asked together, and keys a task holds before it asks: cost only.
BATCH, QUESTIONS = 1 << 24, 1 << 22
#: Parts in which pairs are counted, and batches scored, one after the other, so that their shuffles need not be held at once: cost only.
PARTS, ROUNDS = 3, 2
#: Most rows of the model that every task has at hand, of those with counts alone (pairs, mostly) and of contexts: cost only.
HOT_COUNTS, HOT_CONTEXTS, TOP = 1 << 20, 1 << 18, 1 << 16
#: Kinds of rows of what is counted.
PAIR, WORD = 0, 1
#: Stands before the first word of a document.
START = U(0x9D5C_31F7_66B2_0E4B)
MIN_COUNT = 3
PREFIX = 5
#: Taken off every count of pairs and of contexts: small, as these are counts of documents and of contexts.  The strength of the shared pairs.
DISCOUNT, CONTINUATION, STRENGTH = 0.1, 0.03, 30_000.0
#: Log-ratios of one word beyond these count as these: that a word is missing from the smaller class says little.
NEAR, FAR = 0.35, 8.0
#: Letters, digits and all bytes of longer characters make words.
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: What a row of the model holds: counts by class of a pair or of a word's contexts; of a context, its pairs, what they keep after discounts, and the share that both classes agree on.
VALUES = ("n0", "n1", "t0", "t1", "s0", "s1", "s")


def _hashes(batch_text: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    data, offsets = text_column(batch_text)
    for lo, hi in slices(offsets):
        w = Words(data, offsets, lo, hi, lower=True, space=SEPARATOR)
        yield lo, hi, w, w.hashes()


def _slot(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return mix(k1.view(U) ^ mix(k2.view(U) + U(1)))


def _before(w: Words, h: np.ndarray) -> np.ndarray:
    """Of each word the one before it; ``START`` before the first of a document."""
    before = np.empty(len(h), U)
    before[1:] = h[:-1]
    before[w.at[:-1][w.counts > 0]] = START
    return before


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their keys, where in it each key begins, and the first place of each."""
    # an unstable sort is several times as fast as the one that np.unique takes for first places
    order = np.argsort(keys)
    k = keys[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1])))
    return order, begin, np.minimum.reduceat(order, begin) if len(k) else order


def _once(slot: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of the first of each (slot, document): a text that repeats itself says it once."""
    return _grouped(mix(slot ^ mix(docs.astype(U) + U(1))))[2]


def _by_class(keys: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first of each key, and how many of its rows are ordinary and toxic."""
    order, begin, first = _grouped(keys)
    bad = np.add.reduceat(toxic[order], begin) if len(begin) else np.zeros(0, np.int64)
    return first, np.diff(begin, append=len(keys)) - bad, bad


def count(rows: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(kind, k1, k2, c0, c1, t0, t1): documents of each class that hold a word (with its prefix) or a pair; for words also their pairs.

    Of ``parts`` parts only the pairs whose second word falls into ``part``; words in the first.
    """
    names = ["kind", "k1", "k2", "c0", "c1", "t0", "t1"]

    def rows_of(kind: int, k1: np.ndarray, k2: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k1), kind, np.int32)), *(pa.array(k.view(np.int64)) for k in (k1, k2)), *map(pa.array, counts)], names)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, w, h in _hashes(b["text"]):
                doc, before, is_toxic = w.doc_of_word(), _before(w, h), toxic[lo:hi]
                here = np.flatnonzero(h % U(parts) == part)
                pairs = here[_once(_slot(before[here], h[here]), doc[here])]
                first, c0, c1 = _by_class(_slot(before[pairs], h[pairs]), is_toxic[doc[pairs]])
                zero = np.zeros(len(first), np.int64)
                yield rows_of(PAIR, before[pairs][first], h[pairs][first], c0, c1, zero, zero)
                first, c0, c1 = _by_class(before[pairs], is_toxic[doc[pairs]])
                at = pairs[first]
                zero = np.zeros(len(first), np.int64)
                prefix = np.where(before[at] == START, U(0), w.prefix_hashes(PREFIX, at - 1))
                yield rows_of(WORD, before[at], prefix, zero, zero, c0, c1)
                if part == 0:
                    words = _once(h, doc)
                    first, c0, c1 = _by_class(h[words], is_toxic[doc[words]])
                    zero = np.zeros(len(first), np.int64)
                    yield rows_of(WORD, h[words][first], w.prefix_hashes(PREFIX, words[first]), c0, c1, zero, zero)

    counts = rows.select("text", "toxic").mapInArrow(tasks, "kind int, k1 long, k2 long, c0 long, c1 long, t0 long, t1 long")
    return counts.groupBy("kind", "k1", "k2").agg(*(F.sum(c).alias(c) for c in names[3:]))


def gather(rows: DataFrame) -> DataFrame:
    """(kind, k1, k2, docs, prefix and ``VALUES``): frequent pairs, and words with their contexts and pairs; ``rows`` has text and toxic."""
    types = {"docs": "long", "prefix": "long", **dict.fromkeys(VALUES[:4], "long"), **dict.fromkeys(VALUES[4:], "double")}

    def fact(kind: int, k1: Column, k2: Column, **values: Column) -> Column:
        given = [(values[c] if c in values else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        return F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"), *given)

    k1, k2, c0, c1 = (F.col(c) for c in ("k1", "k2", "c0", "c1"))
    word, none = F.col("kind") == WORD, F.lit(0).cast("long")
    frequent = ~word & (c0 + c1 >= MIN_COUNT)
    one = F.when(word, fact(WORD, k1, none, docs=c0 + c1, prefix=k2, t0=F.col("t0"), t1=F.col("t1"))).otherwise(fact(WORD, k2, none, n0=c0 > 0, n1=c1 > 0))
    more = (fact(WORD, k1, none, s0=_held(c0), s1=_held(c1)), fact(PAIR, k1, k2, n0=c0, n1=c1))
    # plain cases, as Spark compiles no function over the elements of an array
    each = F.when(frequent, F.array(one, *more)).otherwise(F.array(one))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in types if c != "prefix"]

    def summed(counted: DataFrame) -> DataFrame:
        return materialize(counted.groupBy("kind", "k1", "k2").agg(*sums, F.max("prefix").alias("prefix")))

    found = []
    for part in range(PARTS):
        found.append(summed(count(rows, part, PARTS).select(F.explode(each).alias("f")).select("f.*")))
        sweep(rows.sparkSession)
    out = summed(reduce(DataFrame.unionByName, found))
    discard(*found)
    return out


def _held(c: Column) -> Column:
    return F.greatest(c - F.lit(DISCOUNT), F.lit(0.0))


class Totals(NamedTuple):
    """Over all symbols: of each class the continuation counts and how many symbols have any; the symbols of both."""

    n0: float
    n1: float
    some0: float
    some1: float
    symbols: float

    def low(self, n: list[np.ndarray]) -> list[np.ndarray]:
        """P_c(w) of both classes, of words with ``n`` contexts; the same for both where neither has any."""
        shared = (n[0] + n[1] + 0.5) / (self.n0 + self.n1 + 0.5 * (self.symbols + 1))
        unseen = n[0] + n[1] <= 0
        out = []
        for x, total, some in ((n[0], self.n0, self.some0), (n[1], self.n1, self.some1)):
            own = (np.maximum(x - CONTINUATION, 0) + CONTINUATION * max(some, 1.0) * shared) / max(total, 1.0)
            out.append(np.where(unseen, shared, own))
        return out


def model(gathered: DataFrame) -> tuple[DataFrame, Totals]:
    """Rows (slot and ``VALUES``) of pairs (v, w), of words as (w, 0) and of prefix classes as (prefix, 1); and the totals."""
    words = gathered.filter(F.col("kind") == WORD)
    known = (F.col("docs") >= MIN_COUNT) | (F.col("k1") == F.lit(int(START.view(np.int64))))
    kin = words.filter(~known).groupBy(F.col("prefix").alias("k1")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    zero = [F.lit(0).cast(t).alias(c) for c, t in zip(VALUES[2:], ("long", "long", "double", "double", "double"), strict=True)]
    symbols = words.filter(known).select("k1", "k2", *VALUES).unionByName(kin.select("k1", F.lit(1).cast("long").alias("k2"), "n0", "n1", *zero))
    pairs = gathered.filter(F.col("kind") == PAIR).select("k1", "k2", *VALUES)
    contexts = words.filter("t0 > 0 and t1 > 0").select("k1", F.col("t0").alias("_t0"), F.col("t1").alias("_t1"))
    agreed = F.least(_held(F.col("n0")) / F.col("_t0"), _held(F.col("n1")) / F.col("_t1"))
    agreed = pairs.filter("n0 > 0 and n1 > 0").join(contexts, "k1").groupBy("k1").agg(F.sum(agreed).alias("_s"))
    symbols = symbols.join(agreed.withColumn("k2", F.lit(0).cast("long")), ["k1", "k2"], "left").withColumn("s", F.coalesce("_s", F.lit(0.0))).drop("_s")
    symbols = materialize(symbols)
    rows = pairs.unionByName(symbols)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b["k1"].to_numpy(), b["k2"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), *(b[c] for c in VALUES)], ["slot", *VALUES])

    kinds = ", ".join(f"{c} {t}" for c, t in dict(rows.dtypes).items() if c in VALUES)
    facts = materialize(rows.mapInArrow(tasks, f"slot long, {kinds}"))
    seen = symbols.filter("n0 + n1 > 0")
    sums = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (F.sum("n0"), F.sum("n1"), F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0), F.count(F.lit(1)))]
    return facts, Totals(*seen.agg(*sums).first())


def _columns(df: DataFrame) -> list[np.ndarray]:
    """A bounded frame of numbers on the driver."""
    t = df.toArrow()
    return [c.to_numpy() for c in t.columns]


def _packed(docs: DataFrame) -> DataFrame:
    """The rows with ``batch``, a number that neighbours of about ``BATCH`` bytes of text share."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            _, offsets = text_column(b["text"])
            ends = size + offsets[1:] - offsets[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number + ends // BATCH)], [*b.schema.names, "batch"])
            size = int(ends[-1]) if len(ends) else size

    return docs.mapInArrow(tasks, StructType([*docs.schema.fields, StructField("batch", LongType())]))


class Keys(NamedTuple):
    """Slots of the model's rows: of the pair of each word; of each distinct word, at last ``START``, itself and its prefix class; numbers of each word and of the one before it among these."""

    pair: np.ndarray
    word: np.ndarray
    kin: np.ndarray
    at: np.ndarray
    before: np.ndarray


def _keys(w: Words, h: np.ndarray) -> Keys:
    order, begin, first = _grouped(h)
    words, at = h[first], np.empty(len(h), np.int64)
    at[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(h)))
    symbols = np.append(words, START)
    before = np.empty(len(h), np.int64)
    before[1:] = at[:-1]
    before[w.at[:-1][w.counts > 0]] = len(words)
    none = np.zeros(len(symbols), U)
    kin = _slot(np.append(w.prefix_hashes(PREFIX, first), U(0)), none + U(1))
    return Keys(_slot(symbols[before], h), _slot(symbols, none), kin, at, before)


def _questions(packed: DataFrame, there: Broadcast) -> DataFrame:
    """(batch, slot): the keys of each batch once, as far as the model may have them."""

    def ask(batch: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        slot = np.unique(np.concatenate(keys))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), batch)), pa.array(slot.view(np.int64))], ["batch", "slot"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, keys, size = there.value, {}, 0
        for b in batches:
            number = b["batch"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                for _, _, w, h in _hashes(b["text"].slice(x, y - x)):
                    k = _keys(w, h)
                    slot = np.concatenate((k.pair, k.word, k.kin[:-1]))
                    slot = np.unique(slot[may_hold(bits, slot)])
                    keys.setdefault(int(number[x]), []).append(slot)
                    size += len(slot)
                if size > QUESTIONS:
                    yield from (ask(*x) for x in keys.items())
                    keys, size = {}, 0
        yield from (ask(*x) for x in keys.items())

    return packed.select("batch", "text").mapInArrow(tasks, "batch long, slot long")


def _within(keys: np.ndarray, docs: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """At each word the sum of ``amount`` over the words of its document that have its key."""
    _, inverse = np.unique(mix(keys ^ mix(docs.astype(U) + U(1))), return_inverse=True)
    return np.bincount(inverse, weights=amount)[inverse]


class Rows:
    """Rows of the model by slot; values that they do not have are 0."""

    def __init__(self, t: pa.Table):
        slot = t["slot"].to_numpy().view(U)
        first = _grouped(slot)[2]
        self.slot = slot[first]
        self.values = {c: t[c].to_numpy()[first] for c in VALUES if c in t.column_names}
        # slots are spread evenly: their highest bits say where to begin, one or two rows before them
        bits = max(len(first).bit_length() - 1, 1)
        self.shift = U(64 - bits)
        sizes = np.bincount((self.slot >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = (np.cumsum(sizes) - sizes).astype(np.int32)

    def find(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``slot`` are there, and their row numbers."""
        if not len(self.slot):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = len(self.slot) - 1
        at = np.minimum(self.begin[(slot >> self.shift).astype(np.int64)], last)
        low = np.flatnonzero((self.slot[at] < slot) & (at < last))
        while len(low):
            at[low] += 1
            low = low[(self.slot[at[low]] < slot[low]) & (at[low] < last)]
        here = np.flatnonzero(self.slot[at] == slot)
        return here, at[here]


class Answers:
    """The rows of the model that a batch asked for, after those that each task has at hand."""

    def __init__(self, t: pa.Table, totals: Totals, hot: Sequence[Rows] = ()):
        self.totals, self.tables = totals, [*hot, Rows(t)]

    def look_up(self, slot: np.ndarray, columns: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether the model has each slot, and its values."""
        found, values = np.zeros(len(slot), bool), {c: np.zeros(len(slot)) for c in columns}
        left = np.arange(len(slot))
        for rows in self.tables:
            here, at = rows.find(slot[left])
            for c in columns:
                if c in rows.values:
                    values[c][left[here]] = rows.values[c][at]
            found[left[here]] = True
            left = left[~found[left]]
        return found, values

    def log_ratios(self, w: Words, h: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """log P_1(w | v) / P_0(w | v) of each word.

        ``toxic`` is 0 or 1 for a document that is scored without its own counts, as one of that class, else -1.
        """
        keys = _keys(w, h)
        kept, pair = self.look_up(keys.pair, VALUES[:2])
        known, word = self.look_up(keys.word, VALUES)
        _, kin = self.look_up(keys.kin, VALUES[:2])
        n = [pair["n0"], pair["n1"]]
        t, s = ([word[x + c][keys.before] for c in "01"] for x in "ts")
        k, agreed = [np.where(known, word[c], kin[c])[keys.at] for c in VALUES[:2]], word["s"][keys.before]
        docs = w.doc_of_word()
        mine = toxic[docs] >= 0
        if mine.any():
            first = np.zeros(len(h))
            first[_once(keys.pair, docs)] = 1
            context_key, symbol_key = keys.word[keys.before], np.where(known, keys.word, keys.kin)[keys.at]
            started = _within(context_key, docs, first)
            for c in (0, 1):
                of = mine & (toxic[docs] == c)
                fewer = np.where(kept, np.maximum(n[c] - DISCOUNT, 0) - np.maximum(n[c] - 1 - DISCOUNT, 0), 0)
                s[c] = np.where(of, s[c] - _within(context_key, docs, first * fewer), s[c])
                t[c] = np.where(of, t[c] - started, t[c])
                k[c] = np.where(of, k[c] - _within(symbol_key, docs, first * ((n[c] == 1) | ~kept)), k[c])
            for c in (0, 1):
                n[c] = np.where(mine & (toxic[docs] == c) & kept, n[c] - 1, n[c])
            n, t, s, k = ([np.maximum(x, 0) for x in y] for y in (n, t, s, k))
        low = self.totals.low(k)
        share = [np.maximum(n[c] - DISCOUNT, 0) / np.maximum(t[c], 1) for c in (0, 1)]
        out = []
        for c in (0, 1):
            q = np.minimum(*share) + np.maximum(1 - agreed, 1e-9) * low[c]
            out.append((np.maximum(n[c] - DISCOUNT, 0) + (t[c] - s[c] + STRENGTH) * q) / (t[c] + STRENGTH))
        return np.log(out[1] / out[0])

    def ratios(self, w: Words, h: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the robust mean of its log-ratios and the number of its words; 0 without words."""
        r, n = self.log_ratios(w, h, toxic), w.counts
        middle = np.zeros(len(n))
        for d in np.flatnonzero(n).tolist():
            k = (n[d] - 1) // 2
            middle[d] = np.partition(r[w.at[d] : w.at[d + 1]], k)[k]
        r = np.clip(r - np.repeat(middle, n), -NEAR, FAR)
        sums = np.concatenate(([0.0], np.cumsum(r)))
        return (sums[w.at[1:]] - sums[w.at[:-1]]) / np.maximum(n, 1), n


def _hot(facts: DataFrame) -> tuple[Column, list[Rows]]:
    """Which rows tasks have at hand, and these: with counts alone, and of contexts; as many of the most frequent as surely fit."""
    counts, n = F.col("t0") + F.col("t1") == 0, F.col("n0") + F.col("n1") + F.col("t0") + F.col("t1")
    # TOP rows at most of either kind
    sizes = facts.groupBy(counts.alias("counts"), F.least(n, F.lit(TOP)).alias("n")).agg(F.count(F.lit(1)).alias("size")).toArrow().to_pandas()
    rows = []
    for kind, most in ((True, HOT_COUNTS), (False, HOT_CONTEXTS)):
        of = sizes[sizes.counts == kind].sort_values("n", ascending=False)
        fits = of.n[of["size"].cumsum() <= most]
        rows.append((counts == kind) & (n >= F.lit(int(fits.min()) if len(fits) else 1 << 62)))
    narrow = facts.filter(rows[0]).select("slot", *(F.col(c).cast("int").alias(c) for c in VALUES[:2]))
    return rows[0] | rows[1], [Rows(narrow.toArrow()), Rows(facts.filter(rows[1]).select("slot", *VALUES).toArrow())]


def ratios(docs: DataFrame, facts: DataFrame, totals: Totals) -> DataFrame:
    """doc_id, toxic, ratio and n_words of ``docs`` (doc_id, text, toxic); a document with ``toxic`` is scored without its own counts.

    Tasks have the most frequent rows of the model; batches of texts ask for the others that they need, and the answers are
    joined by key and brought to the batch.  The batches are scored in ``ROUNDS`` rounds.
    """
    spark = docs.sparkSession
    is_hot, rows = _hot(facts)
    hot, cold = spark.sparkContext.broadcast(rows), facts.filter(~is_hot)
    there = spark.sparkContext.broadcast(bit_table(cold, "slot"))
    packed = materialize_bucketed(_packed(docs.select("doc_id", "toxic", "text")), "batch")

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        m = Answers(right, totals, hot.value)
        toxic = left["toxic"].fill_null(-1).to_numpy().astype(np.int64)
        parts = [m.ratios(w, h, toxic[lo:hi]) for lo, hi, w, h in _hashes(left["text"])]
        r = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.table([left["doc_id"], left["toxic"], pa.array(r), pa.array(n.astype(np.int64))], names=["doc_id", "toxic", "ratio", "n_words"])

    out = docs.select("doc_id", "toxic").schema.add("ratio", "double").add("n_words", "long")
    found = []
    for k in range(ROUNDS):
        part = packed.filter(F.pmod(F.xxhash64("batch"), F.lit(ROUNDS)) == k)
        answers = _questions(part, there).join(cold, "slot")
        found.append(materialize(part.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(answered, out)))
        del answers
        sweep(spark)
    return reduce(DataFrame.unionByName, found)


def _features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(ratio)), ratio * np.sqrt(n), np.log1p(n)], 1)


def calibrate(ratio: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a slight ridge."""
    x, w = _features(ratio, n), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (label - p) - 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _sample(train: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that calibrate: a fifth of them, ``CALIBRATION`` at most and one at least, of least hash."""
    some = min(CALIBRATION, -(-train.count() // 5))
    return train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(some)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; learns from folds 1 to 4 of the labels."""
    spark = docs.sparkSession
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    one = one.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    mine = docs.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text")
    # one document for each text and label, found without moving texts
    same = mine.select("doc_id", F.xxhash64("text").alias("h")).join(one, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
    train = materialize(same.select("doc_id", "toxic"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    if train.isEmpty():
        return docs.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sample = materialize(_sample(train))  # CALIBRATION rows at most
    # Spark broadcasts the labels' side only while it is small
    gathered = gather(mine.join(train, "doc_id"))
    facts, totals = model(gathered)
    discard(gathered)
    sweep(spark)
    found = ratios(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left"), facts, totals)
    check = found.filter(F.col("toxic").isNotNull()).dropDuplicates(["doc_id"])
    ratio, n, toxic = _columns(check.select("ratio", "n_words", "toxic"))
    w0, w1, w2 = (float(x) for x in calibrate(ratio, n.astype(float), toxic.astype(float)))
    z = w0 + w1 * F.col("ratio") * F.sqrt("n_words") + w2 * F.log1p("n_words")
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return found.select("doc_id", held.alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents of ``documents``; labels of ``labels``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
