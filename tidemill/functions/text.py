"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes that augmented copies of a file carry.
COPY_SUFFIXES = (
    r"_aug\d*", r"_copy\d*", r"_flip(?:ped)?", r"_[hv]flip",
    r"_rot(?:at(?:e|ion))?[_-]?\d*", r"_zoom\d*", r"_shear\d*",
    r"_shift\d*", r"_bright(?:ness)?\d*", r"_contrast\d*",
    r"_blur\d*", r"_noise\d*", r"_crop\d*", r"_enhanced?\d*",
    r"_mirror(?:ed)?", r"_distort(?:ed)?\d*", r"_warp(?:ed)?\d*",
    r"_jitter\d*", r"_transform(?:ed)?\d*",
    r"[\s_]\(\d+\)", r"_\d{1,4}",
)
COPY_SUFFIX = f"(?:{'|'.join(COPY_SUFFIXES)})+$"
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"

#: The place behind a line end.
AFTER_LINE = r"(?<=[\n\u000B\u000C\u001C-\u001E\u0085\u2028\u2029])|(?<=\r)(?!\n)"


def normalize_text(c: Column) -> Column:
    """Trimmed, lower case, words joined by single underscores."""
    c = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    return F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def normalize_condition(c: Column) -> Column:
    """As ``normalize_text``, without trailing digits."""
    c = F.regexp_replace(normalize_text(c), r"[0-9]+$", "")
    return F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("_"))


def normalize_label(c: Column) -> Column:
    """Trimmed, lower case, every space and hyphen an underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")


def strip_copy_suffixes(stem: Column) -> Column:
    """Without all suffixes of augmented copies; one expression equals stripping them one by one until none is left."""
    return F.regexp_replace(F.lower(stem), COPY_SUFFIX, "")


def group_id(path: Column) -> Column:
    """The three parent folders and the stem without copy suffixes."""
    parts = F.split(path, "/")
    n = F.size(parts)
    parents = F.lower(F.array_join(F.slice(parts, F.greatest(n - 3, F.lit(1)), F.least(n - 1, F.lit(3))), "/"))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.concat_ws("/", parents, strip_copy_suffixes(stem))


def split_lines(text: Column) -> Column:
    """The lines of a text under every line end; no line follows a last line end."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def uncommented(line: Column) -> Column:
    """Up to the first ``#``, wherever it stands."""
    return F.substring_index(line, "#", 1)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def title(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def cache_key(text: Column, backend: Column) -> Column:
    """SHA-256 of the text, a NUL and the backend."""
    return F.sha2(F.concat(text, F.lit("\x00"), backend), 256)


def module_name(path: Column) -> Column:
    """``a/b/__init__.py`` is ``a.b``, ``a/c.py`` is ``a.c``; an empty name is null."""
    name = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.nullif(F.replace(name, F.lit("/"), F.lit(".")), F.lit(""))


def last_code_fence(text: Column) -> Column:
    """The body of the last closed code fence, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:[Pp]ython)?[^\n]*\n(.*?)```"), F.lit(1))
    return F.when(F.size(found) > 0, F.btrim(F.element_at(found, -1), F.lit(" \t\r\n")))


def shortened(text: Column, width: int = 28) -> Column:
    return F.when(F.length(text) > width, F.concat(F.lit("..."), F.right(text, F.lit(width - 3)))).otherwise(text)


def version_array(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.cast("int"))


def retry_delay(message: Column) -> Column:
    """Seconds named by ``retry in <n>s``, else null."""
    return F.nullif(F.regexp_extract(message, r"(?i)retry in (\d+(?:\.\d+)?)s", 1), F.lit("")).cast("double")


def line_of(text: Column, what: Column) -> Column:
    """The number of the line on which ``what`` first stands."""
    before = F.split_part(text, what, F.lit(1))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def without_prefix(text: Column, pattern: str) -> Column:
    """``text`` without what fits the pattern at its beginning, once."""
    return F.regexp_replace(text, f"^(?:{pattern})", "")


def last_json_line(text: Column) -> Column:
    """The last line that is a JSON object; null if none is."""
    good = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull())
    return F.try_element_at(good, F.lit(-1))


def match_starts(text: Column, literal: str) -> Column:
    """Where each match of a literal begins, from 0."""
    parts = F.split(text, "\\Q" + literal + "\\E", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + len(literal)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), zero, step, lambda a: a["out"])


def stem(path: Column) -> Column:
    """The name of a file without folder and suffix."""
    return F.regexp_extract(path, "([^/.]+)(?:[.][a-z]+)?/?$", 1)


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first occurrence of ``old`` replaced."""
    at = F.position(old, text)
    return F.when(at == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))
