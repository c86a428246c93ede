"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``### <role>: <text>\\n</turn>\\n``.  The
rendered text is parsed again by a deterministic grammar and the recovered turns
are compared with the source.  Where they differ, the texts hold something that
the grammar takes for its own; they are escaped and rendered again, until the
round trip is the identity.

Escapes.  Level 0 changes nothing.  Level 1 puts a backslash before every
control string (``###`` or ``</turn>``), after any backslashes that stand there.
The parser always takes one backslash from a run of them before a control
string, so level 1 is the identity for every text: a run of n backslashes
becomes n + 1 and comes back as n, and a body always ends with a newline before
its ``</turn>``, so no body can reach into the terminator.

Defined results: a null text or role is empty; rows of a conversation are
ordered by turn, then role, then text, nulls first, so ties and repeated rows
have one order and are all kept; a null conv_id is a conversation; an empty
table gives an empty result; other columns are dropped.  A conversation is one
training example and becomes one row, so it must fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

HEAD, TAIL = "### ", "\n</turn>\n"
CONTROL = r"(?:###|</turn>)"
#: A terminator that no backslash takes away: what the parser splits at.
_END = r"\n</turn>\n"
_ROLE_CODES = (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("#", "%23"), ("<", "%3C"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def _role(role: Column) -> Column:
    """A role must not end its own header or hold a control string: the characters that could are written as % and two digits."""
    for c, code in _ROLE_CODES:
        role = F.replace(role, F.lit(c), F.lit(code))
    return role


def _unrole(role: Column) -> Column:
    for c, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(c))
    return role


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of (role, text)."""
    body = (lambda c: escape(c)) if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), _role(t["role"]), F.lit(": "), body(t["text"]), F.lit(TAIL))), "")


def parse(text: Column) -> Column:
    """The turns that the grammar reads: an array of (role, text).

    A turn ends at the first newline, ``</turn>``, newline; the last piece must
    be empty.  Its head must be there, and neither its role nor its text may
    hold a control string that is not escaped; else the turn is read as null,
    which equals no source.
    """
    pieces = F.split(text, _END, -1)
    bodies = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    cut = lambda p: F.instr(p, ": ")
    ok = lambda p: p.startswith(HEAD) & (cut(p) > 0) & ~F.substring(p, len(HEAD) + 1, 1 << 30).rlike(rf"(?<!\\){CONTROL}")
    turn = lambda p: F.when(
        ok(p),
        F.struct(
            _unrole(F.substr(p, F.lit(len(HEAD) + 1), cut(p) - (len(HEAD) + 1))).alias("role"),
            unescape(F.substr(p, cut(p) + 2)).alias("text"),
        ),
    )
    return F.when(F.element_at(pieces, -1) == "", F.transform(bodies, turn))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted (text), level (escapes used), turns (read back from the text).

    ``rows`` has conv_id, turn, role, text.
    """
    item = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    chats = chats.select("conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_source"))
    for level in (0, 1):
        if level == 0:
            chats = chats.withColumn("formatted", render(F.col("_source"), False)).withColumn("level", F.lit(0))
        else:
            again = ~F.col("_same")
            chats = chats.withColumn("formatted", F.when(again, render(F.col("_source"), True)).otherwise(F.col("formatted")))
            chats = chats.withColumn("level", F.when(again, F.lit(1)).otherwise(F.col("level"))).drop("_back", "_same")
        chats = chats.withColumn("_back", parse(F.col("formatted")))
        chats = chats.withColumn("_same", F.coalesce(F.col("_back") == F.col("_source"), F.lit(False)))
    checked = F.when(F.col("_same"), F.col("_back")).otherwise(F.raise_error(F.lit("the round trip of a conversation is not the identity")))
    return chats.select("conv_id", "formatted", "level", checked.alias("turns"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """The text under the loss mask: that of the role's turns, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


EXTRA = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with conflicting content."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], rows.schema)
    chats = format_chats(rows.unionByName(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace(t, '(\\*(?:###|</turn>))', '\\\1', 'g')"
#: formatted_chars depends on which conversations need escapes: those that hold a control string at all,
#: or the terminator across the end of a text.  Only a text that holds a control string can differ.
OP10_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'
), e AS (
  SELECT *, {_ESC} AS esc,
    replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A'), '#', '%23'), '<', '%3C') AS head,
    max(CASE WHEN t LIKE '%###%' OR t LIKE '%</turn>%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS hard FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(length(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(CASE WHEN hard = 1 THEN esc ELSE t END) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
