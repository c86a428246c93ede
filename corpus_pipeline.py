"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

A stage's result must be a table before the next stage is called, as ``run`` makes it:
each stage first deletes what the one before it wrote beside its result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import delete, discard, materialize, scratch, table
from tidemill.llm.decontaminate import decontaminated
from tidemill.llm.mixing import columns_of, mix, n_words
from tidemill.llm.neardup import one_of_each
from tidemill.llm.pii import key_of, pseudonymise
from tidemill.llm.quality import quality_filter

_left: list[str] = []


def _stage(function: Callable) -> Callable:
    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, *_left)
        _left.clear()
        with scratch() as paths:
            out = function(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the least doc_id stays."""
    return one_of_each(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms; n_chars follows the text."""
    out = pseudonymise(docs, key_of(spark))
    return out.withColumn("n_chars", F.when(docs["n_chars"].isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: its columns, and size, source_size, target and taken (see ``columns_of`` for clashing names)."""
    return mix(docs, F.array("source"), n_words(F.col("text")), keep=docs.columns).drop(columns_of(docs.columns)["membership"])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("mixing sources to target weights", mixture),
]

#: Not expressible in SQL: near-duplicate components, keyed permutations and the min-cost mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        docs, old = materialize(stage(spark, docs, sf_dir)), docs
        if at:
            discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
