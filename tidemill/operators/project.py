"""Operators over the files and labels of a whole project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAST = 999


def has_any(text: Column, keys: list[str]) -> Column:
    """Whether a text holds one of a few keys."""
    out = F.lit(False)
    for k in keys:
        out = out | F.contains(text, F.lit(k))
    return out


def first_fitting(text: Column, rules: list[tuple[int, str, str]]) -> Column:
    """The value of the first rule (ord, key, value) whose key the text holds, in the row: no join, no shuffle."""
    out = F.lit(None).cast("string")
    for _, key, value in sorted(rules, reverse=True):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


def with_profile(rows: DataFrame, tags: str, wanted: list[str], require: bool = True) -> DataFrame:
    """Rows that have one of the wanted tags; an error when there is none."""
    out = rows.filter(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))))
    if require and out.isEmpty():
        raise ValueError(f"nothing has one of the tags {', '.join(wanted)}")
    return out


def places(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``place``, the row's number in the order, without one task that holds all rows.

    Rows are sorted into ranges; a range adds what the ranges before it hold.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn("place", F.col("_id").bitwiseAND((1 << 33) - 1) + 1 + F.coalesce("_before", F.lit(0))).drop("_id", "_part", "_before")


def in_dependency_order(files: DataFrame, order: DataFrame, name: str) -> DataFrame:
    """Files by their position (``pos`` of ``order``, a dimension); those without one last, by name."""
    out = files.join(order, name, "left").withColumn("pos", F.coalesce("pos", F.lit(LAST)))
    return places(out, "pos", name)


def appended(first: DataFrame, rest: DataFrame, name: str, pos: str) -> DataFrame:
    """Names of ``first`` in their order, then those only ``rest`` has, by name; with ``place``."""
    both = first.select(name, pos).unionByName(rest.select(name, F.lit(None).cast(dict(first.dtypes)[pos]).alias(pos)))
    one = both.groupBy(name).agg(F.min(pos).alias(pos))
    return places(one.withColumn("_late", F.col(pos).isNull()), "_late", pos, name).drop("_late")


def resolved(final: Column, symbol: Column, checked: Column) -> Column:
    """A symbol is resolved when the final text lacks it and was checked."""
    return F.coalesce(~F.contains(final, symbol) & checked, F.lit(False))


def mixed(lines: DataFrame, file: str, a: Column, b: Column) -> DataFrame:
    """A warning for each file that has lines of both kinds."""
    counts = lines.groupBy(file).agg(F.count_if(a).alias("a"), F.count_if(b).alias("b")).filter("a > 0 and b > 0")
    return counts.select(file, F.lit("WARNING").alias("severity"), "a", "b")


def totals(files: DataFrame) -> DataFrame:
    """One row: files, files with usage, usages, applied and remaining; ``files`` has usages and applied."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("usages") > 0).alias("files_with_usage"),
        F.sum("usages").alias("usages"),
        F.sum("applied").alias("applied"),
        (F.sum("usages") - F.sum("applied")).alias("remaining"),
    )


def change_map(changes: DataFrame, order: str) -> DataFrame:
    """(original, replacement): of each original its last replacement."""
    return changes.groupBy("original").agg(F.max_by("replacement", order).alias("replacement"))
