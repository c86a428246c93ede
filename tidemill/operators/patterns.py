"""Looking for many keys at once: an Aho-Corasick automaton over blocks of keys, run over all texts of a batch in step.

The automaton is a table of states by classes of bytes, made once from the keys.  A batch's texts are cut into segments
of one length, each with the longest key's length of context before it; all segments take a step at a time, so the work is
one table lookup for a byte, however many keys there are.  Keys are taken in blocks whose bytes are bounded
(``KEY_BYTES``); each block is a pass over the texts.

Every place where a key stands is found, overlapping ones too.  Places are counted in characters from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the keys of one automaton, bytes of text taken at once, bytes of a segment.
KEY_BYTES, SLICE, SEGMENT = 1 << 15, 1 << 20, 256


class Automaton:
    """All places of ``keys`` (byte strings, none empty) in byte arrays."""

    def __init__(self, keys: list[bytes]):
        used = sorted({c for k in keys for c in k})
        self.kind = np.zeros(256, np.int32)  # 0 for bytes that no key has
        self.kind[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        depth, parent, by, self.lengths = [0], [0], [0], np.array([len(k) for k in keys])
        ends: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            at = 0
            for c in key:
                c = int(self.kind[c])
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    by.append(c)
                at = children[at][c]
            ends.setdefault(at, []).append(i)
        depth, parent, by = np.array(depth), np.array(parent), np.array(by)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        fail = np.zeros(len(children), np.int32)
        self.longest = int(depth.max())
        for d in range(self.longest + 1):
            at = np.flatnonzero(depth == d)
            if d > 1:
                fail[at] = self.next[fail[parent[at]], by[at]]
            self.next[at] = self.next[fail[at]] if d else 0
            kids = [(s, c, t) for s in at.tolist() for c, t in children[s].items()]
            if kids:
                s, c, t = np.array(kids).T
                self.next[s, c] = t
        # keys that end in a state, and the nearest shorter suffix in which another ends
        self.first = np.array([ends[s][0] if s in ends else -1 for s in range(len(children))])
        self.same = ends
        self.more = np.zeros(len(children), np.int32)
        for s in np.argsort(depth, kind="stable")[1:].tolist():
            f = int(fail[s])
            self.more[s] = f if self.first[f] >= 0 else self.more[f]
        self.stops = (self.first >= 0) | (self.more > 0)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, first byte) of every place."""
        before = self.longest - 1
        n = -(-len(text) // SEGMENT)
        kinds = np.zeros(before + n * SEGMENT, np.int32)
        kinds[before : before + len(text)] = self.kind[text]
        columns = np.lib.stride_tricks.sliding_window_view(kinds, before + SEGMENT)[::SEGMENT].T
        state = np.zeros(n, np.int32)
        states = np.empty((SEGMENT, n), np.int32)
        for i in range(before + SEGMENT):
            state = self.next[state, columns[i]]
            if i >= before:
                states[i - before] = state
        row, segment = np.nonzero(self.stops[states])
        state, end = states[row, segment], segment * SEGMENT + row + 1
        keys, starts = [], []
        while len(state):
            key = self.first[state]
            has = key >= 0
            keys.append(key[has])
            starts.append(end[has] - self.lengths[key[has]])
            state = self.more[state]
            end, state = end[state > 0], state[state > 0]
        key, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, starts))
        twins = [(np.flatnonzero(key == same[0]), other) for same in self.same.values() for other in same[1:]]
        if twins:  # one key under several numbers
            key, start = np.concatenate([key, *(np.full(len(at), other) for at, other in twins)]), np.concatenate([start, *(start[at] for at, _ in twins)])
        return key, start


def _places(keys: list[bytes], numbers: pa.Array, id_: list[str], text: str, leftmost: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(keys)
        for b in batches:
            for part in slices(b, text):
                column = part.column(text)
                parts = [x.encode() for x in column.fill_null("").to_pylist()]
                # a byte that is no UTF-8 keeps texts apart
                joined = np.frombuffer(b"\xff".join(parts), np.uint8)
                begin = np.cumsum([0, *(len(x) + 1 for x in parts)])
                key, start = automaton.find(joined)
                row = np.searchsorted(begin, start, side="right") - 1
                if leftmost:
                    keep = _leftmost(row, start, automaton.lengths[key])
                    key, start, row = key[keep], start[keep], row[keep]
                chars = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
                at = chars[start] - chars[begin[row]]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in id_), numbers.take(pa.array(key)), pa.array(at.astype(np.int32))], [*id_, "ord", "start"])

    return run


def slices(b: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by some ``SLICE`` bytes of text, a longer text alone."""
    import pyarrow.compute as pc

    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SLICE, side="right")) - 1)
        yield b.slice(lo, hi - lo)
        lo = hi


def _leftmost(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of places in one text the first, the longest of those that begin there, and on from its end."""
    order = np.lexsort((-length, start, row))
    keep, free = [], -1
    for i, s, n in zip(order.tolist(), start[order].tolist(), length[order].tolist(), strict=True):  # starts count over all texts
        if s >= free:
            keep.append(i)
            free = s + n
    return np.array(keep, np.int64)


def places(texts: DataFrame, keys: DataFrame, id_: list[str], text: str = "text", leftmost: bool = False) -> DataFrame:
    """(id, ord, start) of every place in ``texts`` where a key of ``keys`` (ord, key) stands.

    With ``leftmost`` places do not overlap: the first, then the first from its end on, of those that begin together the
    longest; all keys must then fit one block.  Null and empty keys are nowhere; a null text is empty; keys that are equal
    are all found.
    """
    rows = keys.select("ord", "key").filter("key <> ''").distinct()
    size = rows.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    blocks = max(1, -(-size // KEY_BYTES))
    if leftmost and blocks > 1:
        raise ValueError(f"keys of {size} bytes are too many for places without overlap")
    schema = T.StructType([*(texts.schema[c] for c in id_), keys.schema["ord"], T.StructField("start", T.IntegerType())])
    found = []
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).orderBy("ord", "key").toArrow()
        if part.num_rows:
            listed = [k.encode() for k in part["key"].to_pylist()]
            found.append(texts.select(*id_, text).mapInArrow(_places(listed, part["ord"].combine_chunks(), id_, text, leftmost), schema))
    return reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], schema)


def first_rule(texts: DataFrame, rules: DataFrame, id_: list[str], text: str = "text") -> DataFrame:
    """(id, ord) of the first rule, by ord, whose key the text holds; texts that hold none have no row."""
    return places(texts, rules, id_, text).groupBy(*id_).agg(F.min("ord").alias("ord"))


def in_rule_order(texts: DataFrame, rules: DataFrame, id_: list[str], text: str = "text") -> DataFrame:
    """(id, ord, start, n): each rule that the text holds, once, by ord, with its first place; n counts from 1."""
    once = places(texts, rules, id_, text).groupBy(*id_, "ord").agg(F.min("start").alias("start"))
    return once.withColumn("n", F.row_number().over(W.partitionBy(*id_).orderBy("ord")))


def hints(texts: DataFrame, rules: DataFrame, id_: list[str], text: str = "text") -> DataFrame:
    """(id, n, columns of the rule) of the rules (ord, key, priority and more) whose key a text holds, the least priority first, then by ord."""
    named = rules.withColumnRenamed("key", "trigger")
    once = places(texts, rules, id_, text).select(*id_, "ord").distinct().join(named, "ord")
    return once.withColumn("n", F.row_number().over(W.partitionBy(*id_).orderBy("priority", "ord"))).select(*id_, "n", *[c for c in named.columns if c != "ord"])
