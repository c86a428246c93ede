"""Running sums within groups of any size, dealt by ranges of (group, order).

Each range sums its own rows; only its first group can have rows in the ranges before it, so one row a range tells what is
to be added.  No task holds a group, and rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.graph import checkpointed


def _summed(kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (kept columns, group, value) to kept columns, part, before, first; at the end one row with what the range holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None  # groups of the first row and of the last one
        total = 0  # of the last group
        for b in batches:
            if not b.num_rows:
                continue
            value, group = b.column("_value").to_numpy(), b.column("_group")
            names = b.schema.names[:kept]
            kinds, number = [b.schema.field(i).type for i in range(kept)], b.column("_value").type
            first = group[0].as_py() if first is None else first
            new = np.concatenate(([group[0].as_py() != last], pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)))
            upto = np.cumsum(value)
            starts = np.flatnonzero(new)
            # what is to be taken off in each run: the sum before it, or, for the run that goes on, what came in
            off = np.concatenate(([-total if not new[0] else 0], (upto - value)[starts]))
            before = upto - value - off[np.cumsum(new)]
            total = (total if not len(starts) else 0) + (upto[-1] - (off[-1] if len(starts) else 0))
            last = group[-1].as_py()
            mine = pc.equal(group, first)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(np.full(len(value), part, np.int32)), pa.array(before, number), mine, pa.nulls(len(value), pa.string()), pa.nulls(len(value), pa.string())], [*names, "_part", "_before", "_mine", "_from", "_to"])
        if first is not None:
            one = [pa.array([part], pa.int32()), pa.array([total], number), pa.array([first == last]), pa.array([first]), pa.array([last])]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *one], [*names, "_part", "_before", "_mine", "_from", "_to"])

    return run


def running(rows: DataFrame, keep: list[str], group: list[str], order: list[Column | str], value: Column | None = None, name: str = "before") -> DataFrame:
    """The ``keep`` columns and the sum of ``value`` (1 by default: the place from 0) over the rows of the group that stand before; a null value is 0.

    Nulls are a group of their own.  ``order`` should leave no ties.
    """
    key = F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)])) if group else F.lit("")
    value = F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0))
    by = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate([*group, *order])}
    own = rows.select(*keep, key.alias("_group"), value.alias("_value"), *[c.alias(n) for n, c in by.items()])
    number = T.DoubleType() if isinstance(own.schema["_value"].dataType, T.FractionalType) else T.LongType()
    dealt = own.withColumn("_value", F.col("_value").cast(number)).repartitionByRange(*by).sortWithinPartitions(*by)
    kept = [T.StructField(f.name, f.dataType) for f in rows.select(*keep).schema.fields]
    fields = [("_part", T.IntegerType()), ("_before", number), ("_mine", T.BooleanType()), ("_from", T.StringType()), ("_to", T.StringType())]
    held = checkpointed(dealt.mapInArrow(_summed(len(keep)), T.StructType([*kept, *(T.StructField(n, k) for n, k in fields)])))
    ends = held.filter("_from is not null").select("_part", F.col("_before").alias("_sum"), "_mine", "_from", "_to")  # one row a range
    before = W.orderBy("_part")
    # a group that goes on: ranges since the one that it began in
    begins = F.when(~F.col("_mine") | (F.coalesce(F.lag("_to").over(before), F.lit("")) != F.col("_from")), F.col("_part"))
    ends = ends.withColumn("_new", F.last(begins, ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, 0)))
    since = ends.withColumn("_run", F.sum("_sum").over(W.partitionBy("_new").orderBy("_part")))
    carried = F.lag(F.struct("_to", F.col("_run").alias("_run"))).over(before)
    offsets = since.withColumn("_c", carried).select("_part", F.when(F.col("_c._to") == F.col("_from"), F.col("_c._run")).otherwise(F.lit(0)).alias("_add"))
    out = held.filter("_from is null").join(F.broadcast(checkpointed(offsets)), "_part")
    return out.select(*keep, (F.col("_before") + F.when(F.col("_mine"), F.col("_add")).otherwise(F.lit(0))).alias(name))
