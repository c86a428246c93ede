"""Suffix-array dedup by two-stage sorting.

Which strings of ``length`` bytes stand twice is read off sorted suffixes whose
adjacent common prefixes reach that length.  Sorting is two-stage: only suffixes
that are smaller than their successors are sorted directly; the others are
induced from them by one scan over the buckets of first bytes.

One suffix array of a corpus fits in no task, so the corpus is cut such that
equal strings always meet.  Each string of ``length`` bytes samples one gram of
24 bytes (the one with the least fingerprint); runs of strings that sample the
same gram form a segment, and segments are dealt by their gram.  A gram that
stands in one place only cannot be part of a repeat, and its segments are never
sent.  Equal segments are one segment, owned by the first document that holds
it; they are combined before they are shuffled.  Strings of one segment sample its
gram at different offsets, so no two of them are equal: a gram with one distinct
segment needs no sorting, its owner's strings are all the first of their kind.  A gram with more than ``HOT``
bytes of segments fits in no task either: its strings meet by digest instead.  Each owner is told which of its
strings start earlier elsewhere; who owns no segment of that content knows
without being told that all of it starts earlier.

Defined results: a null text is empty; exact copies of an earlier document lose
everything that a string of ``length`` bytes covers; rows with the same doc_id
and text are the same document and share its result; a null doc_id comes after
all others; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, materialize_bucketed, table
from tidemill.llm.kernels import U, anchors, byte_grams, mix, signed, slices, text_column
from tidemill.llm.repeats import ENTRIES, Batch, entries, frequent_in, frequent_table, once, repeated

GRAM = 24
#: Bytes of segments that are sorted at once; a gram with more of them is sorted alone.
BLOCK = 1 << 20
#: A gram with more bytes of segments than this is not sorted in one task: its strings are dealt by content.
HOT = 1 << 22
#: Owners that are told at once: cost only.
ALONE = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_LAST = (1 << 63) - 1


def words_at(t: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    b = np.concatenate((t, np.zeros(pad + 8, np.uint8))).astype(U)
    two = (b[:-1] << U(8)) | b[1:]
    four = (two[:-2] << U(16)) | two[2:]
    return (four[:-4] << U(32)) | four[4:]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``t`` in order of their first ``depth`` bytes at least."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    key = words_at(t, depth)
    # smaller than the successor: the next byte that differs is greater; the last suffix is greater than the empty one
    step = np.diff(t.astype(np.int16), append=-1)
    differs = step != 0
    small = (step[differs] > 0)[np.cumsum(differs) - differs]
    direct = np.flatnonzero(small)
    # sort by eight bytes, then what ties by the next eight
    direct = direct[np.argsort(key[direct], kind="stable")]
    k = key[direct]
    new = np.ones(len(direct), bool)
    new[1:] = k[1:] != k[:-1]
    for d in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        group = np.cumsum(new)[open_]
        k = key[direct[open_] + d]
        order = np.lexsort((k, group))
        direct[open_] = direct[open_][order]
        k = k[order]
        same = np.zeros(len(open_), bool)
        same[1:] = (group[1:] == group[:-1]) & (k[1:] == k[:-1])
        new[open_] = ~same
    # the others, bucket by bucket
    first = t[direct]
    begins = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        chain = [part]
        while len(part):
            part = part[part > 0] - 1
            part = part[t[part] == c]
            chain.append(part)
        full = np.concatenate((*chain, direct[begins[c] : begins[c + 1]]))
        out.append(full)
        before = full[full > 0] - 1
        before = before[t[before] > c]
        byte = t[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for v in np.unique(byte):
            lo, hi = np.searchsorted(byte, [v, v + 1] if v < 255 else [v, 256])
            waiting[int(v)].append(before[lo:hi])
    return np.concatenate(out)


def adjacent_common(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix of ``order`` with the one before it, up to ``length`` bytes."""
    key = words_at(t, length)
    common = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for d in range(0, length, 8):
        if not len(alive):
            break
        x = key[order[alive] + d] ^ key[order[alive - 1] + d]
        equal = np.full(len(alive), 8)
        bad = np.flatnonzero(x)
        # whole equal bytes before the highest differing bit
        equal[bad] = 7 - (np.floor(np.log2(x[bad].astype(np.float64))).astype(np.int64) >> 3)
        common[alive] += equal
        alive = alive[x == 0]
    return np.minimum(common, length)


class Bytes:
    """The bytes of a slice of texts and the segments of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, length: int):
        base = int(offsets[lo])
        self.b = data[base : int(offsets[hi])]
        self.at = offsets[lo : hi + 1] - base
        g = byte_grams(self.b, GRAM)
        place, first, last = anchors(g, length - GRAM + 1)
        doc = np.searchsorted(self.at, place, side="right") - 1
        first = np.maximum(first, self.at[doc])
        last = np.minimum(last, self.at[doc + 1] - length)
        ok = first <= last
        self.key, self.doc, self.first, self.last = g[place[ok]], doc[ok], first[ok], last[ok]

    def hits(self, wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the segments whose gram is among the repeated keys of their text, ``wanted`` from one of ``ends`` to the next."""
        owner, wanted = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), wanted[ends[0] : ends[-1]]
        pair = lambda k, d: mix(k ^ mix(d.astype(U) + U(1)))
        return np.flatnonzero(np.isin(pair(self.key, self.doc), pair(wanted.view(U), owner)))


def _describe(docs: DataFrame, length: int) -> DataFrame:
    names = ["kind", "doc_id", "n", "key", "sha"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch, found = Batch(), []
            data, offsets = text_column(b["text"])
            for lo, hi in slices(offsets):
                t = Bytes(data, offsets, lo, hi, length)
                sha = [hashlib.sha256(t.b[x:y]).digest() for x, y in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
                ids = np.array([int.from_bytes(s[:8], "big", signed=True) for s in sha], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), b["doc_id"].slice(lo, hi - lo), pa.array(np.diff(t.at)), pa.array(ids), pa.array([s.hex() for s in sha])], names)
                new = batch.first(ids)[t.doc]
                found.append(once(t.key[new], t.doc[new])[0])
            k, c = frequent_in(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), pa.nulls(len(k), b["doc_id"].type), pa.array(c), pa.array(signed(k)), pa.nulls(len(k), pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(tasks, f"kind int, doc_id {dict(docs.dtypes)['doc_id']}, n long, key long, sha string")


def _ids(t: Bytes) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(t.b[x:y]).digest()[:8], "big", signed=True) for x, y in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)], np.int64)


def _sampled(docs: DataFrame, length: int, known) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = Batch()
            data, offsets = text_column(b["text"])
            for lo, hi in slices(offsets):
                t = Bytes(data, offsets, lo, hi, length)
                ids = _ids(t)
                new = batch.first(ids)[t.doc]
                k, d, twice = once(t.key[new], t.doc[new])
                yield entries(k, ids[d], twice, known.value)

    return docs.select("text").mapInArrow(tasks, ENTRIES)


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists in a row, and where each list ends, after a 0; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _values(column: pa.Array) -> list[bytes]:
    data, offsets = text_column(column)
    raw, at = data[offsets[0] : offsets[-1]].tobytes(), (offsets - offsets[0]).tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _candidates(rows: DataFrame) -> DataFrame:
    """Only the rows whose text is the one meant, as a doc_id may stand for several."""
    sha = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16), 16, -10).cast("long")
    return rows.filter(sha == F.col("id")).select("id", "doc", "text", "keys")


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """(key, seg, doc, off, row): each distinct segment of a batch once, with its first owner there."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted, ends = _lists(b["keys"])
            wanted = wanted.to_numpy()
            order, rows = b["doc"].to_numpy(), b["row"].to_numpy()
            mine: dict[bytes, int] = {}
            who: list[tuple[int, int, int]] = []
            keys: list[int] = []
            data, offsets = text_column(b["text"])
            size = 0
            for lo, hi in slices(offsets):
                t = Bytes(data, offsets, lo, hi, length)
                raw = t.b.tobytes()
                i = t.hits(wanted, ends[lo : hi + 1])
                d, first = t.doc[i], t.first[i]
                owners = zip(order[lo + d].tolist(), (first - t.at[d]).tolist(), rows[lo + d].tolist(), strict=True)
                for key, x, y, owner in zip(signed(t.key[i]).tolist(), first.tolist(), (t.last[i] + length).tolist(), owners, strict=True):
                    seg = raw[x:y]
                    at = mine.setdefault(seg, len(who))
                    if at == len(who):
                        who.append(owner)
                        keys.append(key)
                        size += y - x
                    elif owner < who[at]:
                        who[at] = owner
                if size > 16 * BLOCK:
                    yield _segment_rows(mine, who, keys)
                    mine, who, keys, size = {}, [], [], 0
            yield _segment_rows(mine, who, keys)

    return texts.select("row", "doc", "text", "keys").mapInArrow(tasks, "key long, seg binary, doc long, off int, row long")


def _segment_rows(mine: dict[bytes, int], who: list[tuple[int, int, int]], keys: list[int]) -> pa.RecordBatch:
    doc, off, row = zip(*who, strict=True) if who else ((), (), ())
    columns = [pa.array(keys, pa.int64()), pa.array(list(mine), pa.binary()), pa.array(doc, pa.int64()), pa.array(off, pa.int32()), pa.array(row, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["key", "seg", "doc", "off", "row"])


def earlier_elsewhere(segs: list[bytes], who: np.ndarray, length: int) -> np.ndarray:
    """Of all strings of the segments, in a row, whether an equal one starts earlier; ``who`` has (doc, off) of each."""
    t = np.frombuffer(b"".join(segs), np.uint8)
    sizes = np.array([len(s) for s in segs])
    at = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    begin = np.cumsum(n) - n
    seg = np.repeat(np.arange(len(segs)), n)
    place = np.arange(n.sum()) - begin[seg]
    number = np.full(len(t), -1)
    number[at[seg] + place] = np.arange(len(seg))
    order = suffix_order(t, length)
    order = order[number[order] >= 0]
    equal = adjacent_common(t, order, length) >= length
    group = np.cumsum(~equal)
    some = equal.copy()
    some[:-1] |= equal[1:]
    group, mine = group[some], number[order[some]]
    s = seg[mine]
    ranked = np.lexsort((who[s, 1] + place[mine], who[s, 0], group))
    g = group[ranked]
    later = np.zeros(len(ranked), bool)
    later[1:] = g[1:] == g[:-1]
    out = np.zeros(len(seg), bool)
    out[mine[ranked]] = later
    return out


def _answers(segments: DataFrame, length: int) -> DataFrame:
    """(doc, row, off, gone): to the owner of each segment, packed bits of the strings that start earlier elsewhere; empty where none does."""
    rows = segments.repartition("key").sortWithinPartitions("key", "seg", "doc", "off")

    def told(who: list[tuple[int, int, int]], bits: list[bytes]) -> pa.RecordBatch:
        doc, off, row = zip(*who, strict=True) if who else ((), (), ())
        columns = [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(off, pa.int32()), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc", "row", "off", "gone"])

    def answer(segs: list[bytes], who: list[tuple[int, int, int]]) -> pa.RecordBatch:
        gone = earlier_elsewhere(segs, np.array(who, np.int64), length)
        n = np.array([len(s) - length + 1 for s in segs])
        ends = np.cumsum(n)
        some = np.add.reduceat(gone, ends - n, dtype=np.int64) > 0
        return told(who, [np.packbits(gone[e - k : e]).tobytes() if any_ else b"" for any_, k, e in zip(some.tolist(), n.tolist(), ends.tolist(), strict=True)])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the segments of the present gram, those to sort with their bytes, and owners of the only segment of a gram
        group, owners, segs, who, size, alone = [], [], [], [], 0, []
        at, last = None, None
        for b in batches:
            columns = (b[c].to_numpy().tolist() for c in ("key", "doc", "off", "row"))
            for key, doc, off, row, seg in zip(*columns, _values(b["seg"]), strict=True):
                if key != at:
                    if len(group) > 1:
                        segs += group
                        who += owners
                        size += sum(map(len, group))
                    else:
                        alone += owners
                    if size >= BLOCK:
                        yield answer(segs, who)
                        segs, who, size = [], [], 0
                    if len(alone) >= ALONE:
                        yield told(alone, [b""] * len(alone))
                        alone = []
                    group, owners, at, last = [], [], key, None
                if seg != last:
                    group.append(seg)
                    owners.append((doc, off, row))
                    last = seg
        if len(group) > 1:
            segs += group
            who += owners
        else:
            alone += owners
        if segs:
            yield answer(segs, who)
        yield told(alone, [b""] * len(alone))

    return rows.mapInArrow(tasks, "doc long, row long, off int, gone binary")


def _strings(segments: DataFrame, length: int) -> DataFrame:
    """(digest, doc, at, row, off): all strings of the segments."""
    names = ["digest", "doc", "at", "row", "off"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                segs = part["seg"].to_pylist()
                n = np.array([len(s) - length + 1 for s in segs])
                digests = [hashlib.blake2b(s[i : i + length], digest_size=16).digest() for s, k in zip(segs, n.tolist(), strict=True) for i in range(k)]
                doc, off, row = (np.repeat(part[c].to_numpy().astype(np.int64), n) for c in ("doc", "off", "row"))
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *map(pa.array, (doc, off + i, row, off))], names)

    return segments.select("seg", "doc", "off", "row").mapInArrow(tasks, "digest binary, doc long, at long, row long, off long")


def _answers_by_content(segments: DataFrame, length: int) -> DataFrame:
    """As ``_answers``, for grams of any size: equal strings meet by their digest of 128 bits, and no task holds a gram."""
    owners = segments.groupBy("key", "seg").agg(F.min(F.struct("doc", "off", "row")).alias("o")).select("seg", "o.*")
    owners = materialize(owners)
    strings = _strings(owners, length)
    least = strings.groupBy("digest").agg(F.min(F.struct("doc", "at", "row")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = strings.join(least, "digest").filter(F.struct("doc", "at", "row") > F.col("least"))
    later = later.groupBy("doc", "row", "off").agg(F.collect_list((F.col("at") - F.col("off")).cast("int")).alias("gone"))
    told = owners.select("doc", "row", F.col("off").cast("long").alias("off"), (F.octet_length("seg") - length + 1).alias("n")).join(later, ["doc", "row", "off"], "left")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            places, ends = _lists(b["gone"])
            for n, at in zip(b["n"].to_pylist(), np.split(places.to_numpy(), ends[1:-1]), strict=True):
                gone = np.zeros(n, bool)
                gone[at.astype(np.int64)] = True
                bits.append(np.packbits(gone).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc"], b["row"], b["off"].cast(pa.int32()), pa.array(bits, pa.binary())], ["doc", "row", "off", "gone"])

    return told.select("doc", "row", "off", "n", "gone").mapInArrow(tasks, "doc long, row long, off int, gone binary")


def _all_answers(segments: DataFrame, length: int) -> DataFrame:
    hot = segments.groupBy("key").agg(F.sum(F.octet_length("seg").cast("long")).alias("size")).filter(F.col("size") > HOT).select("key")
    hot = materialize(hot)
    if hot.isEmpty():
        return _answers(segments, length)
    # at most one for each HOT bytes of segments
    few = F.broadcast(hot)
    return _answers(segments.join(few, "key", "left_anti"), length).unionByName(_answers_by_content(segments.join(few, "key", "left_semi"), length))


def _removed(texts: DataFrame, length: int) -> DataFrame:
    """(id, n_removed, n_spans, sha) of texts with candidates and the answers to them."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted, ends = _lists(b["keys"])
            wanted = wanted.to_numpy()
            answers, told = _lists(b["answers"])
            owner = np.repeat(np.arange(len(b)), np.diff(told))
            row, off, bits = (answers.field(c) for c in ("row", "off", "gone"))
            # of answers to another row with that doc_id nothing is looked up
            off = np.where(row.to_numpy() == b["row"].to_numpy()[owner], off.to_numpy().astype(np.int64), -1)
            bits, bits_at = text_column(bits)
            data, offsets = text_column(b["text"])
            for lo, hi in slices(offsets):
                t = Bytes(data, offsets, lo, hi, length)
                i = t.hits(wanted, ends[lo : hi + 1])
                first, last = t.first[i], t.last[i]
                x, y = int(told[lo]), int(told[hi])
                place = np.where(off[x:y] < 0, -1, t.at[owner[x:y] - lo] + off[x:y])
                # what no answer came for is gone as a whole, else the strings that the answer names
                whole = ~np.isin(first, place)
                one = np.flatnonzero(np.unpackbits(bits[bits_at[x] : bits_at[y]]))
                begins = (bits_at[x:y] - bits_at[x]) * 8
                of = np.searchsorted(begins, one, side="right") - 1
                one = (place[of] + one - begins[of])[np.isin(place, first)[of]]
                edge = np.bincount(np.concatenate((first[whole], one)), minlength=len(t.b) + 1)
                edge -= np.bincount(np.concatenate((last[whole], one)) + length, minlength=len(t.b) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                starts = t.at[:-1][np.diff(t.at) > 0]
                begin[starts] = gone[starts]
                removed, spans = (np.concatenate(([0], np.cumsum(z)))[t.at] for z in (gone, begin))
                left, cuts = t.b[~gone].tobytes(), (t.at - removed).tolist()
                sha = [hashlib.sha256(left[v:w]).hexdigest() for v, w in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b["id"].slice(lo, hi - lo), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array(sha)], ["id", "n_removed", "n_spans", "sha"])

    return texts.select("id", "row", "text", "keys", "answers").mapInArrow(tasks, "id long, n_removed long, n_spans long, sha string")


def remove_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    both = materialize(_describe(docs, length))
    base = both.filter("kind = 0").select("doc_id", F.col("n").alias("n_bytes"), F.col("key").alias("id"), "sha")
    one = base.groupBy("id").agg(F.min("doc_id").alias("first"))
    known = spark.sparkContext.broadcast(frequent_table(both.filter("kind = 1").select("key", "n")))
    want = repeated(_sampled(docs, length, known)).join(one, "id")
    doc = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_LAST))
    rows = docs.select(doc("doc_id").alias("doc"), "text").join(want.withColumn("doc", doc("first")), "doc")
    texts = materialize_bucketed(_candidates(rows).withColumn("row", F.monotonically_increasing_id()), "doc")
    if texts.isEmpty():
        part = spark.createDataFrame([], "id long, _n long, _s long, _sha string")
    else:
        answers = _all_answers(materialize(_segments(texts, length)), length)
        answers = answers.groupBy("doc").agg(F.collect_list(F.struct("row", "off", "gone")).alias("answers"))
        part = _removed(texts.join(answers, "doc", "left"), length)
        part = part.groupBy("id").agg(F.min(F.struct("n_removed", "n_spans", "sha")).alias("p")).select("id", F.col("p.n_removed").alias("_n"), F.col("p.n_spans").alias("_s"), F.col("p.sha").alias("_sha"))
    out = base.join(one, "id").join(part, "id", "left")
    copy = ~F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("_s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )


def op3_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated strings of 100 bytes from all documents."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), 100)
