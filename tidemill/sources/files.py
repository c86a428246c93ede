"""Readers and writers."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".py", ".cu", ".cuh")
AUDIT = "timestamp string, epoch double, file string, backend string, agent_used boolean, validation_passed boolean, overall_confidence double, applied_count int, remaining_count int, warnings array<string>"
BOXES = "Image_ID string, ImagePath string, class string, xmin double, ymin double, xmax double, ymax double"


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, text) of all source files below a folder, or of one file; another suffix is an error."""
    if not path.endswith(SUFFIXES) and "." in path.rstrip("/").rsplit("/", 1)[-1]:
        raise ValueError(f"not a source file: {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,cu,cuh}").load(path)
    # Spark's file index lists empty files, its scan leaves them out
    listed = [(unquote(f).replace("file:///", "file:/", 1),) for f in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    files = files.select("path", "content").unionByName(empty.withColumn("content", F.lit(b"")))
    return files.select("path", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"), F.decode("content", "UTF-8").alias("text"))


def selected(files: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Files whose name fits one glob and not the other."""
    name = F.element_at(F.split("path", "/"), -1)
    if include:
        files = files.filter(name.rlike(glob(include)))
    return files.filter(~name.rlike(glob(exclude))) if exclude else files


def glob(pattern: str) -> str:
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".^$+{}()|\\[]" else c) for c in pattern)
    return f"^{out}$"


def boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOXES).csv(path, header=True).withColumnRenamed("class", "class_name")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON; blank and malformed ones are skipped."""
    return spark.read.schema(AUDIT).json(path, mode="DROPMALFORMED").filter(F.col("file").isNotNull())


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def yolo_box(line: Column) -> Column:
    """A struct (class_id, cx, cy, w, h); null with fewer than five fields or a field that is no number."""
    p = F.split(F.trim(line), r"\s+")
    v = [F.get(p, F.lit(i)).try_cast("double") for i in range(1, 5)]
    ok = (F.size(p) >= 5) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull()
    return F.when(ok, F.struct(p[0].alias("class_id"), *[x.alias(n) for x, n in zip(v, ("cx", "cy", "w", "h"), strict=True)]))


def path_labels(path: Column) -> Column:
    """A struct (crop, split, condition, file) of a path ``<crop>/<split>/<condition>/<file>``; null when it is shorter."""
    p = F.split(path, "/")
    return F.when(F.size(p) >= 4, F.struct(*[F.element_at(p, i).alias(n) for i, n in ((-4, "crop"), (-3, "split"), (-2, "condition"), (-1, "file"))]))


def write_manifest(rows: DataFrame, path: str) -> None:
    """Records by split, as JSON lines."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that does not fit is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_manifest(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(split, record columns) of one JSON document whose keys are splits and whose values are lists of records (a struct type without its name)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,array<struct<{record}>>>").alias("m"))
    return whole.select(F.explode("m").alias("split", "rows")).select("split", F.inline("rows"))


def write_whole_manifest(rows: DataFrame, path: str, split: str = "split") -> None:
    """One JSON document, splits to lists of records in order: for sets of labels that fit one file, as such a document is read whole."""
    record = F.struct(*[c for c in rows.columns if c != split])
    lists = rows.groupBy(split).agg(F.array_sort(F.collect_list(record)).alias("r"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "r"))))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split, in place of what was there."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def read_dimension(spark: SparkSession, path: str, value: str, key: str = "label") -> DataFrame:
    """(key, value columns) of one JSON document that maps names to objects (a struct type without its name)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{value}>>").alias("m"))
    return whole.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def write_confusion(counts: DataFrame, path: str, classes: int) -> None:
    """The matrix of (true, predicted, n), classes numbered from 0, as a CSV of whole numbers without a header, a row for each true class."""
    every = counts.sparkSession.range(classes).select(F.col("id").alias("true"))
    wide = counts.groupBy("true").pivot("predicted", list(range(classes))).agg(F.sum("n"))
    rows = every.join(wide, "true", "left").na.fill(0).orderBy("true").drop("true")
    rows.coalesce(1).write.mode("overwrite").csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row of metrics as one JSON object."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def in_class_folders(files: DataFrame) -> DataFrame:
    """(path, label, stem) of images in folders named by their class."""
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("label"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))


#: Suffixes of images, the first that is there counts.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def images_with_labels(images: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and label files (path each) of a flat layout matched by stem, and counts of what has no partner.

    Returns (stem, image, label_file) and one row (matched, images_without_label, labels_without_image).  Of images with one stem
    the first by suffix counts; other suffixes are no images.
    """
    stem, suffix = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rank = F.array_position(F.array(*[F.lit(s) for s in IMAGE_SUFFIXES]), suffix)
    first = images.withColumns({"stem": stem, "rank": rank}).filter("rank > 0").groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("image"))
    named = labels.withColumn("stem", stem).groupBy("stem").agg(F.min("path").alias("label_file"))
    both = first.join(named, "stem", "full")
    counts = both.agg(*[F.count_if(c).alias(n) for n, c in (("matched", F.col("image").isNotNull() & F.col("label_file").isNotNull()), ("images_without_label", F.col("label_file").isNull()), ("labels_without_image", F.col("image").isNull()))])
    return both.filter("image is not null and label_file is not null").select("stem", "image", "label_file"), counts
