"""Greedy choices along one ordered sequence of any length, such as a debounce or the merging of small neighbours.

A chosen row fixes the next one: the first later row whose value reaches the chosen row's base plus a width, or that must
be chosen whatever stands before it.  So what a range of the sequence does is a function: from the threshold that comes
in, to the threshold that goes out.  Thresholds that come in are less than one width above the range's first value, so
the function is a short table, which one task makes for its range; ranges are then strung together by applying the tables
one after the other, in blocks of the square root of their number, and last each range marks its own rows.

The sequence is dealt by ranges of (group, order), so neither a group with most of the rows nor a single sequence of all
rows comes to one task.  A task holds the rows of one range, with the columns that are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.graph import checkpointed

LEAST, MOST = np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4
_SHAPE = "_from array<long>, _to array<long>, _last array<long>, _passes boolean, _total long, _first_group string, _last_group string, _closed boolean"
_ROW = "_part int, _pos long, _next long, _value long"


def _pointers(value: np.ndarray, base: np.ndarray, fixed: np.ndarray, width: int) -> np.ndarray:
    """For each row the next chosen one if it is chosen; values must not fall but where a row is fixed."""
    n = len(value)
    # values of groups one after the other, so that one search does for all
    run = np.maximum.accumulate(np.where(fixed | (np.arange(n) == 0), np.arange(n), 0))
    starts = np.unique(run)
    ends = np.concatenate((starts[1:], [n])) - 1
    spans = value[ends] - np.minimum(value[starts], base[starts])
    shift = np.concatenate(([0], np.cumsum(spans)[:-1])) - np.minimum(value[starts], base[starts])
    each = np.searchsorted(starts, run)
    level = value + shift[each]
    reach = np.searchsorted(level, base + shift[each] + width, side="left")
    later = np.concatenate((np.where(fixed, np.arange(n), n)[::-1], [n]))
    stop = np.minimum.accumulate(later[:-1])[::-1]  # the first fixed row from here on
    stop = np.concatenate((stop[1:], [n]))
    return np.minimum(np.maximum(reach, np.arange(n) + 1), stop)


def _last_of(next_: np.ndarray, heads: int) -> np.ndarray:
    """For each of the first rows the last row chosen in the range if it is chosen."""
    n = len(next_)
    jump = np.append(next_, n)
    last = np.arange(heads)
    while True:  # doubling
        further = jump[last]
        go = further < n
        if not go.any():
            break
        hops, at = jump, last
        # the largest power of two that stays in the range, found by doubling and halving
        powers = [hops]
        while True:
            twice = powers[-1][powers[-1]]
            if (twice[at] >= n).all():
                break
            powers.append(twice)
        for p in reversed(powers):
            at = np.where(p[at] < n, p[at], at)
        last = at
    return last


@dataclass
class Range:
    """What a range does with a threshold: up to ``start[i]`` it is answered by ``to[i]`` and ``last[i]``; beyond the last it passes, if it may."""

    start: np.ndarray
    to: np.ndarray
    last: np.ndarray
    passes: bool
    total: int
    first_group: str
    last_group: str
    closed: bool

    def __call__(self, threshold: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds and last chosen rows behind the range, in the measure of the range after it."""
        at = np.searchsorted(self.start, threshold, side="left")
        inside = at < len(self.start)
        k = np.minimum(at, max(len(self.start) - 1, 0))
        return np.where(inside, self.to[k], threshold) - self.total, np.where(inside, self.last[k], last)

    def parted(self, after: Range) -> bool:
        """Whether the range after this one begins anew."""
        return self.closed or self.last_group != after.first_group

    def then(self, after: Range) -> Range:
        if self.parted(after):
            to, last = after(np.array([LEAST]), np.array([-1]))
            ends = np.full(len(self.start), to[0] + after.total + self.total), np.full(len(self.start), last[0])
            if self.passes:  # whatever comes in, the range after begins anew
                return Range(np.append(self.start, MOST), np.append(ends[0], to[0] + after.total + self.total), np.append(ends[1], last[0]), False, self.total + after.total, self.first_group, after.last_group, after.closed)
            return Range(self.start, *ends, False, self.total + after.total, self.first_group, after.last_group, after.closed)
        to, last = after(self.to - self.total, self.last)
        start, to = self.start, to + after.total + self.total
        passes = False
        if self.passes:
            more = np.flatnonzero(after.start + self.total > (start[-1] if len(start) else LEAST))
            start, to, last = np.append(start, after.start[more] + self.total), np.append(to, after.to[more] + self.total), np.append(last, after.last[more])
            passes = after.passes
        return Range(start, to, last, passes, self.total + after.total, self.first_group, after.last_group, after.closed)


def _ranges(width: int, kept: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = TaskContext.get().partitionId()
        t = pa.Table.from_batches(held).combine_chunks()
        group, step, value, alone = (t[c].to_numpy() for c in ("_group", "_step", "_at", "_alone"))
        n = t.num_rows
        total = 0
        base = value
        if step.any():  # measured by what came before
            value = np.cumsum(step)
            base, total = value - step, int(value[-1])
        new = np.concatenate(([False], group[1:] != group[:-1]))
        fixed = new | alone
        fixed[1:] |= alone[:-1]
        fixed_first = bool(alone[0])
        fixed[0] = False
        next_ = _pointers(value, base, fixed, width)
        far = np.flatnonzero(fixed | (value >= value[0] + width))
        heads = int(far[0]) + 1 if len(far) else n
        last = _last_of(next_, heads)
        start, to = np.where(fixed[:heads], MOST, value[:heads]), base[last] + width
        if fixed_first:
            start, to, last, heads = np.array([MOST]), to[:1], last[:1], 1
            passes = False
        else:
            passes = not len(far)
        first = np.append(to[1:] != to[:-1], True) if heads > 1 else np.array([True])  # the last of equal answers
        cut = np.flatnonzero(first)
        names = [*t.column_names[:kept], *(x.split()[0] for x in f"{_ROW}, {_SHAPE}".split(", "))]
        kinds = [t.schema.field(i).type for i in range(kept)]
        shape = [pa.list_(pa.int64())] * 3 + [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        fixed[0] = fixed_first
        own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(n)), pa.array(next_.astype(np.int64)), pa.array(np.where(fixed, MOST, value).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks() if isinstance(t.column(i), pa.ChunkedArray) else t.column(i) for i in range(kept)), *own, *(pa.nulls(n, s) for s in shape)], names)
        said = [start[cut], to[cut], last[cut] + (part << 40)]
        one = [*(pa.array([x.astype(np.int64).tolist()], shape[0]) for x in said), pa.array([passes]), pa.array([total]), pa.array([str(group[0])]), pa.array([str(group[-1])]), pa.array([bool(alone[-1])])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([part], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), *one], names)

    return run


def _read(t: pa.Table) -> list[tuple[int, Range]]:
    rows = sorted(t.to_pylist(), key=lambda r: r["_part"])
    array = lambda x: np.array(x, np.int64)
    return [(r["_part"], Range(array(r["_from"]), array(r["_to"]), array(r["_last"]), r["_passes"], r["_total"], r["_first_group"], r["_last_group"], r["_closed"])) for r in rows]


def _composed(t: pa.Table) -> pa.Table:
    """One range for a block of neighbours."""
    (part, whole), *rest = _read(t)
    for _, r in rest:
        whole = whole.then(r)
    fields = [whole.start.tolist(), whole.to.tolist(), whole.last.tolist(), whole.passes, whole.total, whole.first_group, whole.last_group, whole.closed]
    return pa.table([pa.array([part], pa.int32()), *(pa.array([x], k) for x, k in zip(fields, [pa.list_(pa.int64())] * 3 + [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.bool_()], strict=True))], ["_part", *(x.split()[0] for x in _SHAPE.split(", "))])


def _entries(t: pa.Table) -> pa.Table:
    """(part, threshold, last, begins): what comes into each range of neighbours, from what comes into the first."""
    came = {r["_part"]: (r["_threshold"], r["_came_last"]) for r in t.select(["_part", "_threshold", "_came_last"]).to_pylist() if r["_threshold"] is not None}
    out, before, state = [], None, (LEAST, -1)
    for part, r in _read(t):
        if part in came:
            state = came[part]
        elif before is not None and before.parted(r):
            state = (LEAST, -1)
        out.append((part, *state))
        to, last = r(np.array([state[0]]), np.array([state[1]]))
        state, before = (int(to[0]), int(last[0])), r
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])], ["_part", "_threshold", "_came_last"])


def _marked(kept: int) -> object:
    def mark(t: pa.Table) -> pa.Table:
        t = t.sort_by("_pos")
        next_, value = t["_next"].to_numpy(), t["_value"].to_numpy()
        threshold, last, part = t["_threshold"][0].as_py(), t["_came_last"][0].as_py(), t["_part"][0].as_py()
        n = len(next_)
        reached = np.flatnonzero(value >= threshold)
        start = np.zeros(n, bool)
        at = int(reached[0]) if len(reached) else n
        hops = next_.tolist()
        while at < n:
            start[at] = True
            at = hops[at]
        owner = np.maximum.accumulate(np.where(start, np.arange(n), -1))
        segment = np.where(owner < 0, last, owner + (part << 40))
        return t.select(range(kept)).append_column("start", pa.array(start)).append_column("segment", pa.array(segment))

    return mark


def chosen(rows: DataFrame, keep: list[str], group: list[str], order: list[str], width: int, at: Column | None = None, step: Column | None = None, alone: Column | None = None) -> DataFrame:
    """The ``keep`` columns with ``start``, whether the row is chosen, and ``segment``, the same for a chosen row and those up to the next.

    The first row of each group (nulls are a group) is chosen.  Then it is the first whose ``at`` (whole numbers that do not fall in
    the order) is ``width`` or more above the chosen row's; or, with ``step`` in place of ``at``, the first with which the sum of steps from
    the chosen row on is ``width`` or more.  A row that is ``alone`` is chosen, and so is the one after it.  ``order`` should leave no ties.
    """
    key = F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)])) if group else F.lit("")
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0)) if c is not None else F.lit(0).cast("long")
    own = {"_group": key, "_step": number(step), "_at": number(at), "_alone": F.coalesce(alone, F.lit(False)) if alone is not None else F.lit(False)}
    by = [*group, *order]
    order_by = {f"_o{i}": F.col(c) for i, c in enumerate(by)}
    dealt = rows.select(*keep, *[c.alias(n) for n, c in {**own, **order_by}.items()]).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    kept = [T.StructField(f.name, f.dataType) for f in rows.select(*keep).schema.fields]
    schema = T.StructType([*kept, *T._parse_datatype_string(f"{_ROW}, {_SHAPE}").fields])
    held = checkpointed(dealt.mapInArrow(_ranges(width, len(keep)), schema))

    shape = held.filter("_from is not null").select("_part", *(x.split()[0] for x in _SHAPE.split(", ")))
    count = shape.count()
    block = max(1, math.isqrt(count))
    blocks = shape.withColumn("_block", F.floor(F.col("_part") / block))  # parts without rows have no range
    whole = blocks.groupBy("_block").applyInArrow(_composed, f"_part int, {_SHAPE}")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("_threshold", "_came_last")]
    found = "_part int, _threshold long, _came_last long"
    into = whole.select("*", *nothing).withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(_entries, found)
    into = blocks.join(into, "_part", "left").groupBy("_block").applyInArrow(_entries, found)  # one row a range
    marked = held.filter("_from is null").join(F.broadcast(checkpointed(into)), "_part").select(*keep, *(x.split()[0] for x in _ROW.split(", ")), "_threshold", "_came_last")
    return marked.groupBy("_part").applyInArrow(_marked(len(keep)), T.StructType([*kept, T.StructField("start", T.BooleanType()), T.StructField("segment", T.LongType())]))


def debounced(events: DataFrame, keep: list[str], ts: str, key: str, seconds: float, group: list[str] | None = None) -> DataFrame:
    """Events that come ``seconds`` or more after the last accepted one of their group, or of all."""
    out = chosen(events.filter(F.col(ts).isNotNull()), keep, group or [], [ts, key], int(seconds * 1e6), at=F.unix_micros(F.col(ts).cast("timestamp")))
    return out.filter("start").drop("start", "segment")


def merged_small(chunks: DataFrame, keep: list[str], group: list[str], order: list[str], most: int, tokens: str = "tokens") -> DataFrame:
    """Neighbours of less than a quarter of ``most`` tokens together as long as they stay below ``most``: ``keep`` with start and segment."""
    return chosen(chunks, keep, group, order, most, step=F.col(tokens), alone=F.coalesce(F.col(tokens), F.lit(0)) >= most // 4)
