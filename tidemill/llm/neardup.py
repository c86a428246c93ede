"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word-shingle fingerprints.  All sets order their tokens
alike: rare ones first (by fingerprint), then the frequent ones by frequency.
Let x and y be sets with Jaccard similarity t or more, C what they share, and
d = |x| - ceil(t |x|) the most tokens of x that can be missing from y.

* If C holds a rare token, the first token of C is rare and lies among the first
  d + 1 tokens of both: rare tokens of that prefix are indexed singly.
* If all of C is frequent, x has at most d rare tokens.  Tokens of x or y that
  are not shared break at most e = floor((1 - t) |x| / t) of the gaps between
  consecutive tokens of C, so one of the first e + 1 gaps is whole, and its two
  tokens are neighbours in both sets: pairs of frequent neighbours are indexed
  over a prefix that is extended to d + e + 2.

So every link shares an indexed key, whatever tokens count as frequent, and no
frequent token is indexed alone.  The rare prefix is extended by k(x) =
``EXTRA`` + |x| / ``SHARE`` tokens: a set whose extended prefix is all rare
shares at least k(t |x|) + 1 keys with each partner, so sets that share fewer
with all others together are peeled off before anything is compared.  The table of frequent tokens is bounded; it
changes cost, never results.

Equal sets are one class.  A key of at most ``SMALL`` classes has all its pairs
compared.  The classes of a larger key are compared with a reference, the class
that shares most around it; verified links join them into components.  What is
left of such a key are pairs of different components, and they are found by what
they have *unlike* the reference.  Let r be the reference, D(x) the symmetric
difference of x and r, and x, y a link that is not inside a component.  As
|x ^ y| <= (1 - t) / (1 + t) (|x| + |y|) for links and more for all else,
|D(x) & D(y)| >= (|D(x)| + |D(y)| - |x ^ y|) / 2 > 0, and

* D(y) lacks at most floor((1 - t) |y| / t) tokens of D(x) & D(y) before its first;
* if x is linked with r, y is not, and |D(x) & D(y)| > t / (1 + t) |D(x)|.

So x and y share a token of those prefixes of D(x) and D(y), ordered alike: first
what r lacks, then what it has.  What r lacks is ordered by how many differences hold
it; tokens of one difference, or of one component, come first and are never indexed.
(reference, token) is the next round's key.  Of two classes that share it, sizes tell how many tokens of each
difference the other may lack, and the first shared one can't stand behind more of
them than that.  What near copies of
one text share cancels out, so the keys are rare ones; after ``ROUNDS`` rounds all
that share a key are compared.  Hubs with many candidates are salted, and no step
gathers a group in a task.

Sets and tokens are 64-bit fingerprints: two different sets of a corpus are one
class with a chance of about the square of their number in 2^65.

Defined results: null and empty texts have an empty set and are linked with
nothing; a null doc_id takes part in links, and a component of such documents
alone has no id; repeated rows are equal sets; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemill.llm.common import discard, fresh, materialize, table
from tidemill.llm.components import components
from tidemill.llm.kernels import U, Words, grams, mix, signed, slices, text_column
from tidemill.llm.repeats import bit_table, may_hold

#: Tokens in the table of frequent ones, and in how many documents of one Arrow batch a token must occur to be counted.
FREQUENT, SEEN = 1 << 19, 2
#: Tokens by which rare prefixes are extended, and rounds in which sets with too few shared keys are peeled off.
EXTRA, SHARE, PEELS = 3, 40, 2
#: Candidates of a hub that one task compares.
SALT = 512
#: Classes of a key that are all compared with each other, and rounds in which larger keys give way to keys of differences: cost only.
SMALL, ROUNDS = 8, 2


class Sets:
    """The shingle sets of a slice of documents, as tokens sorted by (document, token)."""

    def __init__(self, w: Words, n: int):
        h, counts = w.hashes(), w.counts
        g = grams(h, n)
        ok = np.flatnonzero(w.room()[: len(g)] >= n)
        tok, doc = [g[ok]], [w.doc_of_word()[ok]]
        for d in np.flatnonzero((counts > 0) & (counts < n)):
            tok.append(grams(h[w.at[d] : w.at[d + 1]], int(counts[d])))
            doc.append(np.array([d]))
        tok, doc = np.concatenate(tok), np.concatenate(doc)
        order = np.lexsort((tok, doc))
        tok, doc = tok[order], doc[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
        self.tok, self.doc = tok[new], doc[new]
        self.at = np.searchsorted(self.doc, np.arange(w.docs + 1))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def ids(self) -> np.ndarray:
        """A fingerprint of each whole set; that of an empty one means nothing."""
        sums = np.concatenate(([U(0)], np.cumsum(mix(self.tok ^ U(0x5DEECE66D)), dtype=U)))
        return signed(mix(sums[self.at[1:]] - sums[self.at[:-1]] + self.sizes.astype(U)))


def _sets(text: pa.Array, n: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = text_column(text)
    for lo, hi in slices(offsets):
        yield lo, hi, Sets(Words(data, offsets, lo, hi, lower=True), n)


def prefix_keys(s: Sets, hot: np.ndarray, rank: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The indexed keys of each set: (set number, key), and how many keys each set must share to have a partner."""
    num, den = t
    at = np.minimum(np.searchsorted(hot, s.tok), max(len(hot) - 1, 0))
    frequent = hot[at] == s.tok if len(hot) else np.zeros(len(s.tok), bool)
    level = np.where(frequent, rank[at] + 1 if len(hot) else 0, 0)
    order = np.lexsort((s.tok, level, s.doc)) if frequent.any() else np.arange(len(s.tok))
    tok, level = s.tok[order], level[order]
    place = np.arange(len(tok)) - np.repeat(s.at[:-1], s.sizes)
    n = s.sizes
    d = n - (-(-num * n // den))
    e = (den - num) * n // num
    extra = EXTRA + n // SHARE
    single = (level == 0) & (place <= np.repeat(d + extra, n))
    rare = np.bincount(s.doc[level == 0], minlength=len(n))
    paired = np.repeat((rare <= d), n) & (level > 0) & (place + 1 < np.repeat(np.minimum(n, d + e + 2), n))
    first = np.flatnonzero(paired)
    keys = np.concatenate((mix(tok[single]), mix(tok[first] * U(0x9E3779B97F4A7C15) + tok[np.minimum(first + 1, len(tok) - 1)] + U(1))))
    # a set of one frequent token has no neighbour; equal sets are one class already
    return np.concatenate((s.doc[single], s.doc[first])), keys, np.where(rare > d + extra, EXTRA + (num * n // den) // SHARE + 1, 1)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """In one scan: of each document (doc_id, size, id of its set), and token counts of each batch (kind 1)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = []
            for lo, hi, s in _sets(b["text"], n):
                ids = b["doc_id"].slice(lo, hi - lo)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), ids, pa.array(s.sizes.astype(np.int64)), pa.array(s.ids()), none], names)
                tokens.append(s.tok)
            if not tokens:
                continue
            u, c = np.unique(np.concatenate(tokens), return_counts=True)
            u, c = u[c >= SEEN], c[c >= SEEN]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), b["doc_id"].type), pa.nulls(len(u), pa.int64()), pa.array(signed(u)), pa.array(c.astype(np.int64))], names)

    names = ["kind", "doc_id", "size", "v", "count"]
    return docs.select("doc_id", "text").mapInArrow(tasks, f"kind int, doc_id {id_type}, size long, v long, count long")


def index(docs: DataFrame, n: int, t: tuple[int, int], frequent: Broadcast, wanted: Broadcast | None = None) -> DataFrame:
    """(key, v, size, need) of all sets; each class once for each batch; only keys whose bit is set, if ``wanted`` is given."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = frequent.value
        for b in batches:
            seen = np.zeros(0, np.int64)
            for _, _, s in _sets(b["text"], n):
                ids = s.ids()
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                first &= ~np.isin(ids, seen) & (s.sizes > 0)
                seen = np.concatenate((seen, ids[first]))
                doc, keys, need = prefix_keys(s, hot, rank, t)
                keep = first[doc]
                if wanted is not None:
                    keep &= may_hold(wanted.value, keys)
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[keep])), pa.array(ids[doc]), pa.array(s.sizes[doc].astype(np.int32)), pa.array(need[doc].astype(np.int32))], ["key", "v", "size", "need"])

    return docs.select("text").mapInArrow(tasks, "key long, v long, size int, need int")


def token_sets(docs: DataFrame, n: int) -> DataFrame:
    """(v, tokens as sorted 64-bit numbers) of documents that come with the ``v`` expected of them."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b["v"].to_numpy(zero_copy_only=False)
            for lo, hi, s in _sets(b["text"], n):
                ids = s.ids()
                ok = np.flatnonzero(ids == want[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array([s.tok[s.at[i] : s.at[i + 1]].tobytes() for i in ok], pa.binary())], ["v", "tokens"])

    return docs.select("v", "text").mapInArrow(tasks, "v long, tokens binary")


def compared(pairs: DataFrame, sets: DataFrame, t: tuple[int, int], differences: bool = False) -> DataFrame:
    """(hub, v, linked) of ``pairs`` (hub, v): whether their similarity is ``t`` or more; only links, unless with ``differences``.

    With ``differences`` also the size of v, ``d``, how many tokens one of both lacks, ``length``, how many of them may be indexed,
    ``more``, those that the hub lacks, and ``less``, as many of those that it has as ``length`` leaves room for, in order.
    Every task holds one hub's set and streams what is compared with it.  A hub
    with many candidates is copied to as many tasks as it needs.
    """
    num, den = t
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "hub").select("hub", "v", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("own"))
    hubs = salts.select("hub", F.col("hub").alias("v"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("own"))
    rows = members.unionByName(hubs).join(sets, "v").select("hub", "salt", "own", "v", "tokens")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "own")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, U)
        for b in batches:
            hubs, vs, links, sizes, ds, lengths, more, less = [], [], [], [], [], [], [], []
            for hub, own, v, tokens in zip(b["hub"].to_pylist(), b["own"].to_pylist(), b["v"].to_pylist(), b["tokens"], strict=True):
                theirs = np.frombuffer(tokens.as_buffer(), U)
                if own == 0:
                    at, mine = hub, theirs.copy()
                elif hub == at:
                    if not differences and min(len(mine), len(theirs)) * den < num * max(len(mine), len(theirs)):
                        continue
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    d = len(mine) + len(theirs) - 2 * both
                    linked = den * both >= num * (len(mine) + len(theirs) - both)
                    if linked or differences:
                        hubs.append(hub)
                        vs.append(v)
                        links.append(linked)
                        if differences:
                            length = d - d * num // (num + den) if linked else len(theirs) * (den - num) // num + 1
                            only = np.setdiff1d(theirs, mine, assume_unique=True)
                            room = max(length - len(only), 0)
                            sizes.append(len(theirs))
                            ds.append(d)
                            lengths.append(length)
                            more.append(only.view(np.int64))
                            less.append(np.setdiff1d(mine, theirs, assume_unique=True)[:room].view(np.int64))
            out = [pa.array(hubs, pa.int64()), pa.array(vs, pa.int64()), pa.array(links, pa.bool_())]
            if differences:
                out += [pa.array(sizes, pa.int32()), pa.array(ds, pa.int32()), pa.array(lengths, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (more, less))]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["hub", "v", "linked", "size", "d", "length", "more", "less"] if differences else ["hub", "v", "linked"]
    return rows.mapInArrow(tasks, "hub long, v long, linked boolean" + (", size int, d int, length int, more array<long>, less array<long>" if differences else ""))


def _like(a, b, t: tuple[int, int]) -> Column:
    """Whether sets of these sizes can link."""
    return F.least(a, b) * t[1] >= F.greatest(a, b) * t[0]


def peeled(groups: DataFrame, t: tuple[int, int]) -> DataFrame:
    """``groups`` without entries that can have no partner in their key, and without classes that have too few entries left.

    Sizes fall into bands; two that can link are in the same band or in neighbouring ones.
    """
    step = math.log(t[1] / t[0]) if t[0] < t[1] else 1e-6
    banded = groups.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / step + F.lit(1e-9)).cast("int"))
    near = F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band")
    full = banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("m")).select("key", near, "m").groupBy("key", "band").agg(F.sum("m").alias("m")).filter("m > 1").select("key", "band")
    left = banded.join(full, ["key", "band"]).drop("band")
    enough = left.groupBy("v").agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("want")).filter("have >= want").select("v")
    return left.join(enough, "v")


def _may_link(a: Column, b: Column, t: tuple[int, int]) -> Column:
    """Whether two entries of a key may be a link that joins two components and shares this key before any other of its reference.

    A difference of d tokens lacks floor((d - e + h) / 2) of another's e tokens at most, where h is the most that links are apart.
    """
    num, den = t
    h = F.floor((a["size"] + b["size"]) * (den - num) / (den + num))
    room = lambda x, y: x["place"] <= F.floor((x["d"] - y["d"] + h) / 2) + 1
    return (a["v"] < b["v"]) & (a["root"] != b["root"]) & _like(a["size"], b["size"], t) & (a["place"].isNull() | (room(a, b) & room(b, a)))


def pairs_within(groups: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(hub, v): pairs of different components in small keys that share as many of them as a link that shares no large key must."""
    listed = groups.groupBy("key").agg(F.collect_list(F.struct("v", "size", "need", "root", "place", "d")).alias("g")).filter(F.size("g") > 1)  # SMALL entries at most
    pairs = listed.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).filter(_may_link(F.col("a"), F.col("b"), t))
    pairs = pairs.groupBy(F.col("a.v").alias("hub"), F.col("b.v").alias("v")).agg(F.count(F.lit(1)).alias("have"), F.max(F.greatest("a.need", "b.need")).alias("want"))
    return pairs.filter("have >= want").select("hub", "v")


def with_references(groups: DataFrame) -> DataFrame:
    """(hub, v): each class of ``groups`` with the references of its keys.

    The score of a class is how many entries its keys have.  A key's hub is its
    class of highest score, and the key's reference is the best hub that its hub has.
    """
    weight = groups.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    score = groups.join(weight, "key").groupBy("v").agg(F.sum("m").alias("score"))
    hubs = groups.join(score, "v").groupBy("key").agg(F.max(F.struct("score", "v")).alias("hub"))
    up = groups.join(hubs, "key").groupBy("v").agg(F.max("hub").alias("up"))
    references = hubs.join(up, hubs["hub.v"] == up["v"]).select("key", F.col("up.v").alias("hub"))
    return groups.join(references, "key").select("hub", "v").filter("hub <> v").distinct()


def difference_keys(seen: DataFrame, roots: DataFrame) -> DataFrame:
    """The next (key, v, size, need, root, place, d) of what ``compared`` says of references and classes."""
    rows = seen.join(roots, seen["v"] == roots["node"], "left").select("hub", "v", "size", F.coalesce("root", "v").alias("root"), "d", "length", "more", "less")
    each = rows.select("hub", "v", "size", "root", "d", "length", F.size("more").alias("n"), F.explode("more").alias("token"))
    held = each.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("hub", "token", "c")
    own = W.partitionBy("hub", "v")  # the tokens of one class
    each = each.join(held, ["hub", "token"])
    before = F.col("n") - F.count(F.lit(1)).over(own)  # tokens that are never indexed
    each = each.withColumn("place", (before + F.row_number().over(own.orderBy("c", "token"))).cast("int")).filter("place <= length")
    last = rows.select("hub", "v", "size", "root", "d", F.size("more").alias("n"), F.posexplode("less").alias("i", "token")).withColumn("place", F.col("n") + F.col("i") + 1)
    columns = ["hub", "v", "size", "root", "d", "token", "place"]
    both = each.select(*columns).unionByName(last.select(*columns))
    return both.select(F.xxhash64("hub", "token").alias("key"), "v", "size", F.lit(1).alias("need"), "root", "place", "d")


def _mixed(groups: DataFrame) -> DataFrame:
    """``groups`` with ``m``, the entries of a key, where these are of different components."""
    m = groups.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "m")
    return groups.join(m, "key")


def classes(docs: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    """doc_id, n_shingles, v (the class of its set) and root (the class that names its component) for every row of ``docs``."""
    spark = docs.sparkSession
    both = materialize(describe(docs, n))
    base = both.filter("kind = 0").select("doc_id", F.col("size").alias("n_shingles"), "v")
    top = both.filter("kind = 1").groupBy("v").agg(F.sum("count").alias("c")).orderBy(F.col("c").desc(), "v").limit(FREQUENT)
    top = top.toArrow()  # at most FREQUENT rows
    hot, count = top["v"].to_numpy().view(U), top["c"].to_numpy()
    order = np.argsort(hot)
    hot, count = hot[order], count[order]
    rank = np.empty(len(hot), np.int64)
    rank[np.lexsort((hot, count))] = np.arange(len(hot))
    frequent = spark.sparkContext.broadcast((hot, rank))
    # a class may come from several batches, so this may hold more keys than have two classes
    shared = index(docs, n, t, frequent).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    wanted = spark.sparkContext.broadcast(bit_table(shared, "key"))
    groups = materialize(index(docs, n, t, frequent, wanted).distinct())
    frequent.destroy()
    wanted.destroy()
    for _ in range(PEELS):
        groups, old = materialize(peeled(groups, t)), groups
        discard(old)
    names = base.filter("n_shingles > 0").groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    want = groups.select("v").distinct().join(names, "v")
    sets = token_sets(docs.select("doc_id", "text").join(want, docs["doc_id"].eqNullSafe(want["doc_id"])).select("v", "text"), n)
    sets = materialize(sets.dropDuplicates(["v"]))
    links = roots = None
    rest = []
    old, groups = groups, materialize(_mixed(groups.select("*", F.col("v").alias("root"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("d"))))
    discard(old)
    for last in (*[False] * ROUNDS, True):
        rest.append(materialize(_all_pairs(groups, t) if last else pairs_within(groups.filter(F.col("m") <= SMALL), t)))
        large = groups.filter(F.col("m") > SMALL).select("key", "v")
        if last or large.isEmpty():
            break
        pairs = materialize(with_references(large))
        seen = materialize(compared(pairs, sets, t, differences=True))
        discard(pairs, groups)
        found = seen.filter("linked").select(F.col("hub").alias("a"), F.col("v").alias("b"))
        links = found if links is None else links.unionByName(found)
        roots = materialize(components(links))
        groups = materialize(_mixed(difference_keys(seen, roots)))
    pairs = rest[0]
    for more in rest[1:]:
        pairs = pairs.unionByName(more)
    if roots is not None:
        mine, theirs = roots.toDF("v", "root"), roots.toDF("hub", "hub_root")
        pairs = pairs.join(mine, "v", "left").join(theirs, "hub", "left").filter(F.coalesce("root", "v") != F.coalesce("hub_root", "hub")).select("hub", "v")
    found = materialize(compared(materialize(pairs.distinct()), sets, t)).select(F.col("hub").alias("a"), F.col("v").alias("b"))
    roots = components(found if links is None else links.unionByName(found))
    return base.join(roots, (base["v"] == roots["node"]) & (base["n_shingles"] > 0), "left").select("doc_id", "n_shingles", "v", F.coalesce("root", "v").alias("root"))


def _all_pairs(groups: DataFrame, t: tuple[int, int]) -> DataFrame:
    entry = F.struct("v", "size", "root", "place", "d")
    pairs = groups.select("key", entry.alias("a")).join(groups.select("key", entry.alias("b")), "key").filter(_may_link(F.col("a"), F.col("b"), t))
    return pairs.select(F.col("a.v").alias("hub"), F.col("b.v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, t: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) for every row of ``docs``."""
    return _named(materialize(classes(docs, n, t))).select("doc_id", "n_shingles", "component_id")


def _named(found: DataFrame) -> DataFrame:
    """With ``component_id``; a document without shingles is its own."""
    some = found.filter("n_shingles > 0")
    least = some.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return some.join(least, "root").select("doc_id", "n_shingles", "v", "root", "component_id").unionByName(found.filter("n_shingles = 0").select("doc_id", "n_shingles", "v", "root", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, t: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each component, one with the least doc_id; columns as they came.

    Where several rows have that doc_id, one of those in the component stays, so
    rows that repeat a doc_id with another text are judged by their text.
    A row without a doc_id names no document and always stays.
    """
    found = materialize(_named(materialize(classes(docs, n, t))))
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("doc_id") == F.col("component_id")).alias("first"))
    ids = [fresh(docs, x) for x in ("id", "v", "empty", "want", "none")]
    single = rows.filter("rows = 1 and first").select(F.col("doc_id").alias(ids[0]))
    several = rows.filter("rows > 1").select(F.col("doc_id").alias(ids[0]))
    out = docs.join(single, docs["doc_id"] == single[ids[0]], "left_semi")
    # of the rows that repeat a doc_id: of each component the least set, once
    kept = found.filter(F.col("doc_id") == F.col("component_id")).join(several, F.col("doc_id") == F.col(ids[0]), "left_semi")
    kept = kept.groupBy(F.col("doc_id").alias(ids[0]), "root", (F.col("n_shingles") == 0).alias(ids[4])).agg(F.min("v").alias(ids[3])).drop("root")
    again = with_class(docs.join(several, docs["doc_id"] == several[ids[0]], "left_semi"), n, ids[1], ids[2])
    same = (F.col("doc_id") == F.col(ids[0])) & (F.col(ids[2]) == F.col(ids[4])) & (F.col(ids[2]) | (F.col(ids[1]) == F.col(ids[3])))
    again = again.join(kept, same, "left_semi").dropDuplicates(["doc_id", ids[1], ids[2]]).select(*docs.columns)
    return out.unionByName(again).unionByName(docs.filter(F.col("doc_id").isNull()))


def with_class(docs: DataFrame, n: int, v: str, empty: str) -> DataFrame:
    """``docs`` with the class of each row's set (0 for an empty one), and whether the set is empty."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, s in _sets(b["text"], n):
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(np.where(s.sizes > 0, s.ids(), 0)), pa.array(s.sizes == 0)], [*b.schema.names, v, empty])

    return docs.mapInArrow(tasks, StructType([*docs.schema.fields, StructField(v, LongType()), StructField(empty, BooleanType())]))


def op4_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all documents of ``documents`` by 3-word shingles at 0.9."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (90, 100))
