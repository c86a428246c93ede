"""License scan: ordered signature rules over the words of a text.

A text is brought to lower-cased words (A-Z to a-z; runs of digits, letters and all that is not ASCII).  Rules are
regular expressions over the words, see ``license_rules``.  A rule is tried only where its keyword is in the text,
which one search for each keyword tells.  What the rules find are detections: a rule, its first word and its number of
words.  Detections that overlap are resolved by rank: one is suppressed where the words of a detection of a higher
level, or of the same level and longer, or of the same words and an earlier rule, contain all of its own.  So ``gpl-3.0``
of "general public license version 3" suppresses ``gpl`` of its first three words.  Detections that overlap in part
both stay.  As whatever a suppressed detection would suppress is also inside the one that suppressed it, one pass in
the order of first words is enough, with the furthest end so far of each level.

Beside the rules, the places of fixed phrases are counted; their labels stay whatever is suppressed.

The score is the confidence of the best level that is left (``CONFIDENCE``), 0 without detections.

Everything is DataFrame functions on one row at a time: one scan, no shuffle.

Defined results: a null or empty text, or one without words, has no detections, empty labels and a score of 0;
repeated rows are scanned alike; texts are searched whole, however long; empty tables give empty results; columns of the
input keep their names and values, the added ones have the names that the caller gives.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import let, lower_ascii, table
from tidemill.llm.license_rules import RULES

#: What separates words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: How sure a detection of each level is.
CONFIDENCE = {1: 0.3, 2: 0.7, 3: 0.9, 4: 1.0}

_MARK = "\x01"
DETECTION = "struct<first:bigint,negative_end:bigint,negative_level:int,rule:int,label:string,words:bigint>"


def spaced(pattern: str) -> str:
    """A rule's pattern for texts in which each word has a space of its own on both sides."""
    return " " + pattern.replace(" ?", _MARK).replace(" ", "  ").replace(_MARK, "(?:  )?") + " "


def spaced_words(text: Column) -> Column:
    """The words of a text, each with a space on both sides, so that what follows a match can match too."""
    words = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), APART, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(spaced_text: Column) -> Column:
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("long")


def _rules_by_keyword(rules) -> Column:
    groups: dict[str, list] = {}
    for i, (label, level, keyword, pattern) in enumerate(rules):
        groups.setdefault(keyword, []).append({"rule": i, "label": label, "level": level, "pattern": spaced(pattern)})
    listed = [{"keyword": k, "rules": v} for k, v in groups.items()]
    return F.from_json(F.lit(json.dumps(listed)), "array<struct<keyword string, rules array<struct<rule int, label string, level int, pattern string>>>>")


def _found(text: Column, rule: Column) -> Column:
    """The detections of one rule in spaced words: matches are marked off, and the words between the marks counted."""
    pieces = F.split(F.regexp_replace(text, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit(f"{_MARK}$1{_MARK}")), _MARK, -1)
    none = F.array().cast(f"array<{DETECTION}>")

    def add(state: Column, piece: Column) -> Column:
        def after(n: Column) -> Column:
            one = F.struct(state["at"].alias("first"), (-(state["at"] + n)).alias("negative_end"), (-rule["level"]).alias("negative_level"), rule["rule"].alias("rule"), rule["label"].alias("label"), n.alias("words"))
            found = F.when(state["inside"], F.concat(state["found"], F.array(one))).otherwise(state["found"])
            return F.struct((state["at"] + n).alias("at"), (~state["inside"]).alias("inside"), found.alias("found"))

        return let(count_words(piece), after)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), none.alias("found"))
    return let(pieces, lambda p: F.when(F.size(p) == 1, none).otherwise(F.aggregate(p, start, add, lambda s: s["found"])))


def _unsuppressed(found: Column) -> Column:
    """Detections without those that one of higher rank contains, in the order of their first words, longest first."""
    levels = max(CONFIDENCE)

    def step(state: Column, x: Column) -> Column:
        level, end = -x["negative_level"], -x["negative_end"]
        hidden = F.exists(F.slice(state["ends"], level, levels), lambda e: e >= end)
        ends = F.transform(state["ends"], lambda e, i: F.when(i + 1 == level, F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(hidden, state["left"]).otherwise(F.concat(state["left"], F.array(x))).alias("left"))

    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("ends"), F.array().cast(f"array<{DETECTION}>").alias("left"))
    return F.aggregate(F.array_sort(found), start, step, lambda s: s["left"])


def detections(text: Column, rules=RULES) -> Column:
    """The detections that stay in spaced words: structs of rule (its number), label, level, first word and number of words."""
    tried = F.flatten(F.transform(F.filter(_rules_by_keyword(rules), lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    found = F.flatten(F.transform(tried, lambda r: _found(text, r)))
    return F.transform(_unsuppressed(found), lambda x: F.struct(x["rule"].alias("rule"), x["label"].alias("label"), (-x["negative_level"]).alias("level"), x["first"].alias("first"), x["words"].alias("words")))


def scan(docs: DataFrame, text: str = "text", rules=RULES, spaced_as: str = "spaced_words", found_as: str = "detections") -> DataFrame:
    """Add the spaced words of a text and its detections, both under names of the caller's choice."""
    out = docs.withColumn(spaced_as, spaced_words(F.col(text)))
    return out.withColumn(found_as, detections(F.col(spaced_as), rules))


def score(found: Column) -> Column:
    """The confidence of the best detection, 0 without any."""
    best = F.array_max(F.transform(found, lambda x: x["level"]))
    out = F.lit(0.0)
    for level, sure in CONFIDENCE.items():
        out = F.when(best == level, F.lit(sure)).otherwise(out)
    return out


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op12_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that all documents name."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text, labels = F.col("spaced_words"), []
    places, first, last = F.lit(0).cast("long"), [], []
    for phrase, label in PHRASES.items():
        held = spaced(phrase)
        there = F.contains(text, F.lit(held))
        places += F.when(there, F.size(F.split(text, held, -1)) - 1).otherwise(0)
        first.append(F.when(there, count_words(F.substring_index(text, held, 1))))
        last.append(F.when(there, count_words(text) - count_words(F.substring_index(text, held, -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    base = F.filter(F.array(*labels), lambda x: x.isNotNull())
    return rows.select(
        "doc_id",
        count_words(text).alias("n_words"),
        places.alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, F.transform("detections", lambda x: x["label"]))).alias("labels"),
        score(F.col("detections")).alias("score"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULE_ROWS = ", ".join(f"({i}, {_sql_text(label)}, {level}, {_sql_text(keyword)}, {_sql_text('(' + spaced(pattern) + ')')})" for i, (label, level, keyword, pattern) in enumerate(RULES))
_PHRASE_ROWS = ", ".join(f"({_sql_text(spaced(p))}, {len(p.split())}, {_sql_text(label)})" for p, label in PHRASES.items())
_LEVELS = " ".join(f"WHEN {level} THEN {sure}" for level, sure in CONFIDENCE.items())

OP12_SQL = rf"""
WITH rules(rule, label, level, keyword, pattern) AS (VALUES {_RULE_ROWS}),
phrases(phrase, n, label) AS (VALUES {_PHRASE_ROWS}),
w AS (
    SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{APART}', '  ', 'g'), ' ') AS s
    FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN s = '' THEN '' ELSE ' ' || s || ' ' END AS s FROM w),
p AS (
    SELECT r, label, n, string_split(s, phrase) AS parts, length(s) - length(replace(s, ' ', '')) AS spaces
    FROM d JOIN phrases ON contains(s, phrase)),
b AS (
    SELECT r, sum(len(parts) - 1) AS n_base,
        min((length(parts[1]) - length(replace(parts[1], ' ', ''))) // 2) AS first_word,
        max((spaces - length(parts[-1]) + length(replace(parts[-1], ' ', ''))) // 2 - n) AS last_word,
        list(label) AS labels
    FROM p GROUP BY r),
m AS (
    SELECT r, rule, label, level, string_split(regexp_replace(s, pattern, chr(1) || '\1' || chr(1), 'g'), chr(1)) AS pieces
    FROM d JOIN rules ON contains(s, keyword)),
u AS (
    SELECT r, rule, label, level, i, (length(pieces[i]) - length(replace(pieces[i], ' ', ''))) // 2 AS n
    FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM m WHERE len(pieces) > 1)),
v AS (SELECT *, sum(n) OVER (PARTITION BY r, rule ORDER BY i) AS stop FROM u),
x AS (SELECT r, rule, label, level, stop - n AS start, stop FROM v WHERE i % 2 = 0),
k AS (
    SELECT * FROM x a WHERE NOT EXISTS (
        SELECT 1 FROM x b WHERE a.r = b.r AND b.start <= a.start AND b.stop >= a.stop AND (b.level > a.level
            OR (b.level = a.level AND (b.stop - b.start > a.stop - a.start OR (b.stop - b.start = a.stop - a.start AND b.rule < a.rule)))))),
l AS (SELECT r, list(label) AS labels, max(level) AS level FROM k GROUP BY r)
SELECT doc_id, ((length(s) - length(replace(s, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
    first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, l.labels))), ','), '') AS labels,
    (CASE level {_LEVELS} ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r)
"""
