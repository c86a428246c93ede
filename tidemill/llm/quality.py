"""Quality rules: base counts, then distribution divergence from language references.

A document is kept when it passes the base rules and its histograms are near
those of its language: the Jensen-Shannon distance between the document's
character classes and the language's, and likewise for the language's common
words.  The references are the mean histograms of all documents of the language
that pass the base rules; documents with too few words for a histogram to mean
anything are not judged by it (minimum-length guards).

Everything is DataFrame functions.  One scan computes the counts and
histograms; the references are a partial aggregation to one row a language.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; a null or unlisted language is compared with the pool of all unlisted
ones; a language whose documents all fail the base rules has no reference and
its documents are judged by the base rules alone; empty tables give empty
results; repeated rows are judged alike and all kept or all dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, materialize, table, word_array

#: The most common function words of each language, fixed values.  Languages not listed share the bins of all.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"),
}
POOL = tuple(sorted({w for ws in COMMON.values() for w in ws[:6]}))
BINS = 17
#: Character classes: upper case, digits, symbols, other marks, and letters (the rest).
CLASSES = (r"[^\p{Lu}]+", r"[^0-9]+", r"[^#*$%&|<>]+", r"[\p{L}\p{M}0-9#*$%&|<>\x20\x09-\x0D]+")

#: Words from which the class and the common-word histograms are judged.
MIN_CLASS_WORDS, MIN_COMMON_WORDS = 50, 50
MAX_CLASS_DISTANCE, MAX_COMMON_DISTANCE = 0.3, 0.13
#: A histogram of n words strays by about 1 / sqrt(n) from its reference by chance alone.
CHANCE = 1.5


def language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit("other"))


def _words_of(lang: Column) -> Column:
    out = F.array(*map(F.lit, POOL[: BINS - 1]))
    for name, words in COMMON.items():
        out = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def _share(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0]).cast("double")
    return F.array(*[F.when(total > 0, c / total).otherwise(F.lit(0.0)) for c in counts])


def repeated_words(words: Column, n: Column) -> Column:
    """Words in windows of three that the array holds twice or more.

    The windows' fingerprints are sorted with their places; equal neighbours
    give the places, and their sorted gaps the words that they cover.
    """
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    def twice(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
        return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

    places = F.sort_array(F.transform(F.array(F.sort_array(windows)), twice)[0])
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])


def with_features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the counts and histograms, in columns whose names begin with ``q_``."""
    t = F.coalesce(F.col(text), F.lit(""))
    q = docs.withColumn("q_lang", language(F.col(lang))).withColumn("q_words", word_array(F.col(text)))
    q = q.withColumn("q_n_words", F.size("q_words").cast("long"))
    q = q.withColumn("q_word_chars", F.length(F.regexp_replace(t, SPACES, "")).cast("long"))
    for name, rest in zip(("q_upper", "q_digits", "q_n_symbols", "q_marks"), CLASSES, strict=True):
        q = q.withColumn(name, F.length(F.regexp_replace(t, rest, "")).cast("long"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    q = q.withColumn("q_lines", lines)
    q = q.withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines")
    q = q.withColumn("q_n_repeat_words", repeated_words(F.col("q_words"), F.col("q_n_words").cast("int")))
    q = q.withColumn("q_list", _words_of(F.col("q_lang")))
    q = q.withColumn("q_common", F.filter(F.transform("q_words", F.lower), lambda w: F.array_contains(F.col("q_list"), w)))
    counts = F.transform("q_list", lambda c: F.size(F.filter("q_common", lambda w: w == c)))
    q = q.withColumn("q_counts", counts)
    bins = [F.get("q_counts", F.lit(i)).cast("long") for i in range(BINS - 1)]
    letters = F.greatest(F.col("q_word_chars") - F.col("q_upper") - F.col("q_digits") - F.col("q_n_symbols") - F.col("q_marks"), F.lit(0))
    q = q.withColumn("q_class_hist", _share([F.col("q_upper"), F.col("q_digits"), F.col("q_n_symbols"), F.col("q_marks"), letters]))
    q = q.withColumn("q_common_hist", _share([*bins, F.col("q_n_words") - F.size("q_common")]))
    q = q.withColumn("q_base_failed", (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words")))
    return q.drop("q_words", "q_list", "q_common", "q_counts", "q_upper", "q_digits", "q_marks")


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, from 0 to 1, of two histograms that each sum to 1."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def references(features: DataFrame) -> DataFrame:
    """One row for each listed language and one for all others: the mean histograms of what passes the base rules."""
    ok = features.filter(~F.col("q_base_failed"))
    mean = lambda c, n: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(n)])
    return ok.groupBy("q_lang").agg(mean("q_class_hist", 5).alias("r_class"), mean("q_common_hist", BINS).alias("r_common"))


def judged(features: DataFrame) -> DataFrame:
    """Add class_distance, common_distance and kept."""
    refs = references(features)  # at most len(COMMON) + 1 rows
    out = features.join(F.broadcast(refs), "q_lang", "left")
    out = out.withColumn("class_distance", F.when(F.col("q_n_words") >= MIN_CLASS_WORDS, divergence(F.col("q_class_hist"), F.col("r_class"))))
    out = out.withColumn("common_distance", F.when(F.col("q_n_words") >= MIN_COMMON_WORDS, divergence(F.col("q_common_hist"), F.col("r_common"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE + CHANCE / F.sqrt("q_n_words"))
    return out.withColumn("kept", ~F.col("q_base_failed") & ~far).drop("r_class", "r_common")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns they came with, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("q_row"), "text", "lang")
    return judged(materialize(with_features(rows).drop("text", "lang"))).filter("kept").select("q_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents of ``documents``."""
    docs = with_features(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")
    return judged(materialize(docs)).select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        "kept",
        "class_distance",
        "common_distance",
    )
