"""Format-preserving pseudonyms by keyed Feistel permutations.

Personal data is found by shape and then validated (Luhn and mod-97 check
digits, calendar, octets, social-security ranges).  A validated number or date
is permuted within its own format by a ten-round Feistel network whose round
function is a keyed SHA-256: a card becomes another valid card, a date another
date, an address another address; separators stay.  The permutation depends on
the value and the key alone, so equal values stay linked across documents, and
different values stay different.  Dates are of three formats, each permuted within
itself: year first; day first; month first, where the day is above 12 (else it
reads as day first).  A 29th of February becomes one of another leap year.
E-mail names and secrets have no numeric format; they become keyed digests of the same look.

The key has no default: whoever has it can invert the permutations.

Everything is DataFrame functions: the text is split at the matches and joined
again, and only matches are ever permuted.

Defined results: a null text stays null; what fails its validation stays as it
is, and so does a date of the year 0; other columns are untouched, whatever their
names; rows are neither added nor dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fresh, let, table

#: The Spark setting that names the key of the registered query and of the pipeline, and the public one they take without it.
KEY_SETTING, EXAMPLE_KEY = "spark.tidemill.pii.key", "an example that hides nothing"
ROUNDS = 10
#: Dates are permuted within the years 1 to 9999, of which LEAP have a 29th of February.
YEARS, LEAP = 9999, 2424
#: Month * 100 + day of the days of a common year that can't be read as a month.
LATE_DAYS = tuple(m * 100 + d for m, n in enumerate((31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(13, n + 1))

#: Kinds in the order in which they are tried at a place; the first that fits takes it.
SHAPES = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|token|secret|api_key|apikey)\b\s?[=:]\s?\"?[0-9A-Za-z_\-]{12,64}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.\-])(?:\d{4}([/.\-])\d{2}\1\d{2}|\d{2}([/.\-])\d{2}\2\d{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])\d{3}-\d{2}-\d{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?![0-9])|(?<![0-9])\(\d{3}\) ?\d{3}-\d{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?![0-9])",
}
KINDS = tuple(SHAPES)
#: Groups are numbered across the alternatives: one each in ``date``.
PATTERN = "|".join(SHAPES.values())
#: Every match of every shape holds one of these, so a text without them is not searched.
HINT = r"[0-9@]|AKIA|pass|token|secret|api"


def _digest(key: str, kind: str | Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), *parts), 256)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str | Column) -> Column:
    """Permute the pair (a, b) of [0, size_a) x [0, size_b); a struct of the new pair."""
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b).cast("long")
        f = F.conv(F.substring(_digest(key, kind, i.cast("string"), size_a.cast("string"), size_b.cast("string"), s["b"].cast("string")), 1, 14), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f % size, size).alias("b"))

    return F.aggregate(rounds, start, step)


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (two at least; no shape has more than 34, two halves of 17; others stay)."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    number = lambda s: F.coalesce(s.try_cast("long"), F.lit(0))
    pair = feistel(number(F.substr(d, F.lit(1), u)), number(F.substr(d, u + 1)), power(u), power(v), key, kind)
    text = let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, F.lit("0")), F.lpad(p["b"].cast("string"), v, F.lit("0"))))
    return F.when((n >= 2) & (n <= 34), text).otherwise(d)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _in_place(m: Column, digits: Column) -> Column:
    """Put ``digits`` in the places of the digits of ``m``, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))
    return F.aggregate(
        F.split(m, ""),
        start,
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substr(digits, a["i"] + 1, F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
        lambda a: a["s"],
    )


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    n = F.length(d)
    return F.aggregate(
        F.transform(F.filter(F.split(d, ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0),
        lambda s, x: s + x,
    )


def mod97(s: Column) -> Column:
    """The remainder by 97 of digits and letters (A is 10) read as one number."""
    code = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + code(c)) % 97)


def _card(m: Column, key: str) -> Column:
    def change(d: Column) -> Column:
        payload = F.concat(F.substring(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return let(payload, lambda p: F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, _in_place(m, change(d))).otherwise(m))


def _iban(m: Column, key: str) -> Column:
    def change(s: Column) -> Column:
        body = F.substr(s, F.lit(5))
        new = let(permute_digits(_digits(body), key, "iban"), lambda d: _in_place(body, d))
        checked = let(new, lambda b: F.concat(F.lpad((98 - mod97(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = let(checked, lambda c: F.aggregate(F.split(F.substr(m, F.lit(3)), ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), lambda a, ch: F.when(ch == " ", F.struct(F.concat(a["s"], ch).alias("s"), a["i"].alias("i"))).otherwise(F.struct(F.concat(a["s"], F.substr(c, a["i"] + 1, F.length(ch))).alias("s"), (a["i"] + F.length(ch)).alias("i"))), lambda a: a["s"]))
        return F.concat(F.substring(m, 1, 2), spaced)

    ok = lambda s: F.length(s).between(15, 34) & (mod97(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))) == 1)
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when(ok(s), change(s)).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    def change(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
        return let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return let(octets, lambda o: F.when(F.array_max(o) <= 255, change(o)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    """Year first, or day (else month) first; the order and the separator stay."""
    sep = F.regexp_extract(m, r"[/.\-]", 0)
    part = lambda i: F.split_part(m, sep, F.lit(i))
    date = lambda y, mo, d: F.concat_ws("-", y, mo, d).try_cast("date")
    order = lambda o, d: F.struct(F.lit(o).alias("o"), d.alias("d"))
    first_is_year = F.length(part(1)) == 4
    dmy = date(part(3), part(2), part(1))
    read = F.when(first_is_year, order("y", date(part(1), part(2), part(3)))).when(dmy.isNotNull(), order("d", dmy)).otherwise(order("m", date(part(3), part(1), part(2))))

    def change(r: Column) -> Column:
        year, month, day = F.year(r["d"]), F.month(r["d"]), F.dayofmonth(r["d"])
        late = F.array(*map(F.lit, LATE_DAYS))
        # places in the common year 2001, or among the days above 12
        place = F.when(r["o"] == "m", F.array_position(late, month * 100 + day) - 1).otherwise(F.dayofyear(F.make_date(F.lit(2001), month, day)) - 1)
        days = F.when(r["o"] == "m", F.lit(len(LATE_DAYS))).otherwise(F.lit(365))
        kind = F.when(r["o"] == "m", F.lit("late")).otherwise(F.lit("date"))

        def common(p: Column) -> Column:
            new = F.date_add(F.lit("2001-01-01").cast("date"), p["b"].cast("int"))
            code = F.when(r["o"] == "m", F.get(late, p["b"].cast("int"))).otherwise(F.month(new) * 100 + F.dayofmonth(new))
            return F.struct((p["a"] + 1).alias("y"), code.alias("md"))

        # leap years of the calendar by number: 97 in each 400 years, here counted by the 29ths of February before
        nth = F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) - 1
        leap = feistel(F.floor(nth / 101), nth % 101, F.lit(LEAP // 101), F.lit(101), key, kind=F.concat(kind, F.lit("-leap")))

        def leap_year(p: Column) -> Column:
            i = p["a"] * 101 + p["b"]
            within = i % 97  # of the 400 years from 1 on: 24 in each of three centuries, then 25
            century = F.least(F.floor(within / 24), F.lit(3))
            return F.struct((F.floor(i / 97) * 400 + century * 100 + (within - century * 24 + 1) * 4).alias("y"), F.lit(229).alias("md"))

        new = F.when((month == 2) & (day == 29), let(leap, leap_year)).otherwise(let(feistel(year - 1, place, F.lit(YEARS), days, key, kind), common))

        def text(n: Column) -> Column:
            y, mo, d = F.lpad(n["y"].cast("string"), 4, "0"), F.lpad(F.floor(n["md"] / 100).cast("string"), 2, "0"), F.lpad((n["md"] % 100).cast("string"), 2, "0")
            return F.when(r["o"] == "y", F.concat(y, sep, mo, sep, d)).when(r["o"] == "d", F.concat(d, sep, mo, sep, y)).otherwise(F.concat(mo, sep, d, sep, y))

        return let(new, text)

    return let(read, lambda r: F.when(r["d"].isNotNull() & (F.year(r["d"]) > 0), change(r)).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def text(p: Column) -> Column:
        new = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(ok, let(pair, text)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code and the first digit after it stay."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])", 0)
    head = F.length(F.regexp_extract(F.concat(code, F.substr(m, F.length(code) + 1)), r"^(\+\d{1,3}(?=[ .\-(]))?[^0-9]*\d", 0))
    rest = F.substr(m, head + 1)
    return F.concat(F.substr(m, F.lit(1), head), let(permute_digits(_digits(rest), key, "phone"), lambda d: _in_place(rest, d)))


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    return F.concat(F.lit("user."), F.substring(_digest(key, "email", low), 1, 12), F.lit("@mail.example"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[0-9A-Za-z_\-]+$", 0)
    hexed = F.substr(_digest(key, "secret", value), F.lit(1), F.length(value))
    upper = F.translate(F.substring(_digest(key, "secret", m), 1, 16), "0123456789abcdef", "ABCDEFGHJKLMNPQR")
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), upper)).otherwise(F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), hexed))


_CHANGE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    out = F.lit("card")
    for kind in reversed(KINDS[:-1]):
        out = F.when(m.rlike(f"^(?:{SHAPES[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """A struct (kind, text) for one match."""

    def by_kind(k: Column) -> Column:
        text = _card(m, key)
        for kind in reversed(KINDS[:-1]):
            text = F.when(k == kind, _CHANGE[kind](m, key)).otherwise(text)
        return F.struct(k.alias("kind"), text.alias("text"))

    return let(kind_of(m), by_kind)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced.

    ``counts`` names a column to add: the kinds of the values that were changed.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    t = F.col(text)
    found, new = fresh(docs, "found"), fresh(docs, "new")
    none = F.array().cast("array<string>")
    out = docs.withColumn(found, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(none))
    out = out.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    parts = F.split(t, PATTERN, -1)
    joined = let(parts, lambda p: F.array_join(F.flatten(F.zip_with(p, F.col(new)["text"], lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))
    out = out.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(t))
    if counts:
        changed = F.filter(F.arrays_zip(F.col(found).alias("old"), F.col(new).alias("new")), lambda x: x["old"] != x["new"]["text"])
        out = out.withColumn(counts, F.transform(changed, lambda x: x["new"]["kind"]))
    return out.drop(found, new)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, EXAMPLE_KEY)


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymise all documents of ``documents``: doc_id, text and the number of values changed, by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, key_of(spark), counts="_kinds")
    n = [F.size(F.array_remove("_kinds", kind)) for kind in KINDS]
    n = [(F.size("_kinds") - rest).cast("long").alias(f"n_{kind}") for kind, rest in zip(KINDS, n, strict=True)]
    return out.select("doc_id", "text", *n)
