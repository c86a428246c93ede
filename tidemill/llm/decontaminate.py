"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Windows.  Every document is cut into windows that start every ``STEP`` words and
have the lengths of the items, rounded down to a class, and of their halves.  An
item is indexed by its windows of those two lengths from every word on, so
whatever the place of a passage in a document, windows of both stand for the same
words; and a changed word leaves a half without it.  Items of fewer than
``LEAST`` words are met by windows of their length, or of one word less, from
every word on.

Fingerprints.  A window's SimHash of 42 bits has the bits that most of its words'
hashes have.  The counts are bytes of six numbers, whose running sums give
each window by one subtraction a number, so no window is counted word by word.

Candidates.  A fingerprint is cut into one block more than ``RADIUS``; two fingerprints within the radius agree in a block, so the index of blocks
finds all of them, and nothing else chooses candidates.

Verification.  The passage of the item's length around a candidate is compared
exactly: the weight of the common five-word shingles over the weight of all, each
weighing its characters.

Everything is DataFrame functions.  The index is broadcast in parts of at most
``BROADCAST`` rows, each with a pass over the documents; texts are never shuffled.

Defined results: null and empty texts and items match nothing; an item of fewer
than five words has one shingle, all of it; a document shorter than an item is
one window; repeated rows match alike; a null doc_id is matched like any other,
and rows of the same doc_id are told apart by their text; of equally similar
windows the first counts; other columns are untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, let, materialize, table, word_array

SHINGLE, RADIUS, SIMILARITY = 5, 1, 0.8
#: Words between the starts of windows, and of the shortest item that these windows are sure to meet.
STEP, LEAST = 4, 11
#: Lengths of windows in steps.  Longer items are met by the longest.
CLASSES = (2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Steps of a text whose windows are fingerprinted together, and rows of the index that one pass looks up.
CHUNK, BROADCAST = 128, 1 << 20
#: Of each byte of a hash the bits that count, and how many bytes: seven, so that no sum overflows.
BITS, BYTES = (0, 1, 2, 4, 5, 6), 7
_ONES, _HIGH = 0x01010101010101, 0x80808080808080
_NIBBLES, _LOW = 0x11111111111111, 0x0F0F0F0F0F0F0F


def _words(text: Column) -> Column:
    return word_array(F.lower(F.coalesce(text, F.lit(""))))


def weighted_shingles(words: Column, k: Column) -> Column:
    """The distinct shingles of an array of words: structs of text and weight."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    each = F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.transform(F.array_distinct(F.when(n > 0, each).otherwise(F.array().cast("array<string>"))), lambda s: F.struct(s.alias("s"), F.length(s).cast("long").alias("w")))


def similarity(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y["w"])
    both = total(F.array_intersect(a, b))
    return both / (total(a) + total(b) - both)


def lane(h: Column, i: int) -> Column:
    """Each eighth bit of a hash from bit ``i`` on, as the bytes of a number."""
    return F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_ONES))


def simhash(lanes: list[Column], size: Column) -> Column:
    """The fingerprint of ``size`` hashes (255 at most) whose lanes sum to ``lanes``: bits that more than half of them have."""
    above = (F.lit(127) - F.shiftright(size, 1)).cast("long") * F.lit(_ONES)
    bits = [F.shiftrightunsigned((s + above).bitwiseAND(F.lit(_HIGH)), BYTES - i) for i, s in zip(BITS, lanes, strict=True)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def block_keys(fingerprint: Column, kind: Column) -> Column:
    """The keys of a fingerprint's blocks: kind of window, number and value of the block."""
    n = RADIUS + 1
    cut = [8 * (BYTES * i // n) for i in range(n + 1)]
    value = lambda i: F.shiftrightunsigned(fingerprint, cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1))
    return F.array(*[(kind.cast("long") * n + i) * (1 << 40) + value(i) for i in range(n)])


def _print_of(h: Column, start: Column, size: Column) -> Column:
    """The fingerprint of ``size`` hashes from ``start`` on."""
    add = lambda i: F.aggregate(F.slice(h, start + 1, size), F.lit(0).cast("long"), lambda a, x: a + lane(x, i))
    return simhash([add(i) for i in BITS], size)


def index(items: DataFrame) -> DataFrame:
    """(item_id, m, kind, off, q): fingerprints of the windows of each item; ``items`` has item_id, m and words.

    The kind of a window is its class, or its length in words below 0 for short items.
    """
    hashed = items.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    fit = lambda steps: F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, CLASSES)), lambda c: c <= steps)), F.lit(CLASSES[0]))
    whole = fit(F.floor((F.col("m") - (STEP - 1)) / STEP))
    short = F.when(F.col("m") > SHINGLE, F.array(-F.col("m"), 1 - F.col("m"))).otherwise(F.array(-F.col("m")))
    kinds = F.when(F.col("m") < LEAST, short).otherwise(F.array_distinct(F.array(whole, fit(F.floor(whole / 2)))))
    rows = hashed.select("item_id", "m", "h", F.explode(kinds).alias("kind")).withColumn("w", F.when(F.col("kind") < 0, -F.col("kind")).otherwise(F.col("kind") * STEP))
    rows = rows.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("w"))))
    return rows.select("item_id", "m", "kind", "off", _print_of(F.col("h"), F.col("off"), F.col("w")).alias("q"))


def windows(docs: DataFrame, kinds: list[int], longest: int) -> DataFrame:
    """(doc_id, h, n, base, near, kind, at, p): the fingerprint of every window; ``near`` are the words around, from ``base`` on."""
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), _words(F.col("text")).alias("words"))
    words = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    classes, short = [k for k in kinds if k > 0], [k for k in kinds if k < 0]
    out = []
    if classes:
        steps = F.floor(F.col("n") / STEP).cast("int")
        least, most = min(classes), max(classes)
        rows = words.filter(steps >= least).withColumn("c", F.explode(F.sequence(F.lit(0), steps - least, F.lit(CHUNK))))
        size = F.least(F.lit(CHUNK + most), steps - F.col("c"))
        base = F.greatest(F.col("c") * STEP - longest, F.lit(0))
        near = F.slice("words", base + 1, F.lit((CHUNK + most) * STEP + 2 * longest))

        def nibbles(i: int) -> Column:
            """Of each step its counts of every fourth bit from ``i`` on."""
            every = lambda j, q: F.shiftrightunsigned(F.get(F.col("hashes"), j * STEP + q), i).bitwiseAND(F.lit(_NIBBLES))
            return F.transform(F.sequence(F.col("c"), F.col("c") + size - 1), lambda j: reduce(lambda a, b: a + b, [every(j, q) for q in range(STEP)]))

        def sums(i: int) -> Column:
            count = lambda x: (x if i < 4 else F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(_LOW))
            return F.aggregate(F.col(f"n{i % 4}"), F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + count(x)))

        around = ["doc_id", "h", "n", "c", "size", "base", "near"]
        rows = rows.select("doc_id", "h", "n", "c", size.alias("size"), base.alias("base"), near.alias("near"), *[nibbles(i).alias(f"n{i}") for i in BITS if i < 4])
        rows = rows.select(*around, *[sums(i).alias(f"s{i}") for i in BITS])
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK - 1), F.col("size") - least))))
        rows = rows.withColumn("kind", F.explode(F.array(*map(F.lit, classes)))).filter(F.col("j") + F.col("kind") <= F.col("size"))
        part = [F.get(f"s{i}", F.col("j") + F.col("kind")) - F.get(f"s{i}", F.col("j")) for i in BITS]
        out.append(rows.select("doc_id", "h", "n", "base", "near", "kind", ((F.col("c") + F.col("j")) * STEP).alias("at"), simhash(part, F.col("kind") * STEP).alias("p")))
    if short:
        rows = words.filter("n > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("kind", F.explode(F.array(*map(F.lit, short))))
        rows = rows.filter(F.col("at") - F.col("kind") <= F.col("n")).withColumn("base", F.greatest(F.col("at") - LEAST, F.lit(0)))
        rows = rows.withColumn("near", F.slice("words", F.col("base") + 1, F.lit(3 * LEAST)))
        out.append(rows.select("doc_id", "h", "n", "base", "near", "kind", "at", _print_of(F.col("hashes"), F.col("at"), -F.col("kind")).alias("p")))
    return reduce(DataFrame.unionByName, out)


def matches(docs: DataFrame, items: DataFrame, t: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (in words), hamming, similarity: the best window of each document and item that match.

    A row for each different text of a doc_id.  ``radius`` may be less than that of the index, not more.
    """
    return _matches(docs, items, t, radius).drop("h")


def _matches(docs: DataFrame, items: DataFrame, t: float, radius: int) -> DataFrame:
    if radius > RADIUS:
        raise ValueError(f"the index of blocks reaches a radius of {RADIUS}")
    words = items.select("item_id", _words(F.col("text")).alias("words")).withColumn("m", F.size("words")).filter("m > 0")
    words = materialize(words)
    index_of = materialize(index(words))
    rows, longest = index_of.agg(F.count(F.lit(1)), F.coalesce(F.max("m"), F.lit(0))).first()
    shingles = words.select("item_id", weighted_shingles(F.col("words"), F.least(F.col("m"), F.lit(SHINGLE))).alias("theirs"))
    found = None
    parts = -(-rows * (RADIUS + 1) // BROADCAST)
    for part in range(parts):
        of = index_of.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        kinds = [r.kind for r in of.select("kind").distinct().collect()]  # CLASSES and LEAST values at most
        if not kinds:
            continue
        keyed = of.select("item_id", "m", "off", "q", F.explode(block_keys(F.col("q"), F.col("kind"))).alias("key"))
        seen = windows(docs, kinds, longest).withColumn("key", F.explode(block_keys(F.col("p"), F.col("kind"))))
        hamming = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
        near = seen.join(F.broadcast(keyed), "key").withColumn("hamming", hamming).filter(F.col("hamming") <= radius)
        start = F.greatest(F.least(F.col("at") - F.col("off"), F.col("n") - F.col("m")), F.lit(0))
        near = near.select("doc_id", "h", "item_id", "m", "hamming", start.alias("start"), F.slice("near", start - F.col("base") + 1, F.col("m")).alias("ours"))
        found = near if found is None else found.unionByName(near)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, h long, item_id {dict(items.dtypes)['item_id']}, start int, hamming int, similarity double")
    found = found.groupBy("doc_id", "h", "item_id", "m", "start").agg(F.min("hamming").alias("hamming"), F.first("ours").alias("ours"))
    same = found.withColumn("ours", weighted_shingles(F.col("ours"), F.least(F.col("m"), F.lit(SHINGLE)))).join(shingles, "item_id")
    same = same.withColumn("similarity", similarity(F.col("ours"), F.col("theirs"))).filter(F.col("similarity") >= t)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("d"))).alias("b")
    return same.groupBy("doc_id", "h", "item_id").agg(best).select("doc_id", "h", "item_id", (-F.col("b.s")).alias("start"), (-F.col("b.d")).alias("hamming"), "b.similarity")


def decontaminated(docs: DataFrame, items: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """The rows without a match; columns as they came."""
    key, h = fresh(docs, "id"), fresh(docs, "h")
    bad = _matches(docs, items, t, RADIUS).select(F.col("doc_id").alias(key), F.col("h").alias(h)).distinct()
    here = F.xxhash64(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[key]) & (here == bad[h]), "left_anti")


def op7_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``benchmark`` in all documents of ``documents``."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
