"""The filter audit, the license scan and the ranked search, each against a plain program over awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemill.llm import audit, licenses, search
from tidemill.llm.license_rules import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- filter audit


def _audit_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdEFé$") for _ in range(rng.randint(1, 5)))
    texts = [None, "", "  ", "A" * 300, "# " * 250, "wort " * 300] + [" ".join(word() for _ in range(rng.randint(150, 260))) for _ in range(20)]
    texts += [" ".join(f"w{i}" for i in range(60_000))]
    rows = [(rng.randint(0, 70), t, rng.choice(["a", "b", None, "", "c"]), "x") for t in texts * 4]
    rows += [(5, texts[7], "hot", "x")] * 3 + [(None, texts[8], "n", "x")] * 2 + [(None, "only without an id", "n", "x")] * 2
    rows += [(i, "one text of a third of all rows", "hot", "x") for i in range(60)]
    return rows


def _plain_audit(rows, labels):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    cells = defaultdict(lambda: [0, 0, 0])
    for i, t, part, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), t in least and (i is None or i > least[t])]
        cell = cells[part or "", frozenset("ABCDE"[k] for k in range(5) if fails[k])]
        cell[0] += 1
        cell[1] += marks[i][0] if i is not None else 0
        cell[2] += marks[i][1] if i is not None else 0
    out = set()
    for part in {p for p, _ in cells}:
        of = {m: c for (p, m), c in cells.items() if p == part}
        shapley = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [c for m, c in of.items() if name in m and not m & before]
                shapley[name] += sum(c[0] for c in removed)
                kept = sum(c[0] for m, c in of.items() if not m & (before | {name}))
                redundant = sum(c[0] for m, c in of.items() if name in m and m & before)
                unique = sum(c[0] for m, c in of.items() if m == {name})
                lines.append((part, "".join(order), step, kept, sum(c[0] for c in removed), redundant, unique, sum(c[1] for c in removed), sum(c[2] for c in removed)))
        out |= {(*x, shapley[x[1][x[2] - 1]]) for x in lines}
    return out


def _audited(docs, labels):
    masks = audit.failure_masks(docs, audit.conditions(), audit.features())
    return audit.interactions(audit.mask_counters(masks, labels, F.col("quality") == 1, F.col("toxic") == 1), "ABCDE")


def test_audit(spark):
    rows = _audit_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(5)
    got = _audited(docs, marks).collect()
    assert len(got) == 600 * len({r.part for r in got})
    assert {tuple(r) for r in got} == _plain_audit(rows, labels)
    # ids of another type, ranges of one or two rows each
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        texts = spark.createDataFrame([(None if i is None else f"{i:03}", t, p, k) for i, t, p, k in rows], "doc_id string, text string, source string, mask string")
        named = spark.createDataFrame([(None if i is None else f"{i:03}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
        assert {tuple(r) for r in _audited(texts, named).collect()} == _plain_audit(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert _audited(docs.limit(0), marks).collect() == []
    assert len(_audited(docs, marks.limit(0)).collect()) == len(got)


# ---------------------------------------------------------------- license scan


def _sample(pattern: str, rng: random.Random) -> str:
    """A string that a rule's pattern matches."""
    from re import _parser

    def of(parsed) -> str:
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "BRANCH":
                out += of(rng.choice(arg[1]))
            elif op == "SUBPATTERN":
                out += of(arg[-1])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(of(inner) for _ in range(rng.randint(low, min(int(high), low + 2))))
            elif op == "IN":
                kind, value = rng.choice(arg)
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: "7" if "DIGIT" in str(value) else "x"}[str(kind)]()
            else:
                raise AssertionError(op)
        return out

    return of(_parser.parse(pattern))


def _plain_detections(words):
    text = "".join(f" {w} " for w in words)
    found = []
    for i, (label, level, _, pattern) in enumerate(RULES):
        for m in re.finditer(licenses.spaced(pattern), text):
            first = text[: m.start()].count(" ") // 2
            found.append((level, len(m[0].split()), -i, first, label))
    rank = lambda x: x[:3]
    inside = lambda x, y: y[3] <= x[3] and x[3] + x[1] <= y[3] + y[1]
    return [x for x in found if not any(inside(x, y) and rank(y) > rank(x) for y in found)]


def _plain_licenses(doc_id, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    kept = _plain_detections(words)
    starts = [i for i, _ in places]
    labels = base | {x[4] for x in kept}
    score = max((licenses.CONFIDENCE[x[0]] for x in kept), default=0.0)
    return doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


LICENSED = [
    None, "", " .,- ", "No word of any", "MIT License", "mit license MIT LICENSE, mit license", "(the MIT-License!)", "the übermit license",
    "This work is licensed under the GNU General Public License, version 3.", "GPL license. Apache License; general public license",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Released under the MIT license.",
    "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0 and apache license", "either version 2 of the GNU General Public License or mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted\nprovided that: redistributions of source code must retain the above copyright notice",
    "Copyright (c) 2019 2020 Someone. All rights reserved. All rights reserved.", "general public license, version 3, or (at your option) any later version",
    "kein mit, nur mit lizenz", "noncommercial and non commercial, attribution noncommercial sharealike 4.0 international license",
]


def test_every_rule_has_its_keyword_and_matches():
    rng = random.Random(1)
    for label, level, keyword, pattern in RULES:
        assert re.fullmatch(r"[a-z0-9.-]+", label) and level in licenses.CONFIDENCE
        for _ in range(25):
            text = "".join(f" {w} " for w in _sample(pattern, rng).split(" ") if w)
            assert keyword in text, (label, keyword, text)
            assert re.search(licenses.spaced(pattern), text), (label, pattern, text)


def test_licenses(spark):
    rng = random.Random(2)
    texts = list(LICENSED)
    for _ in range(60):  # rules' own words, run together in all ways
        parts = [_sample(rng.choice(RULES)[3], rng) for _ in range(rng.randint(1, 8))]
        texts.append(rng.choice([" ", ", ", " und ", ". The "]).join(parts))
    texts.append("mit license apache license " * 300 + "wort " * 50_000 + "general public license version 2")
    rows = [(i, t, "kept") for i, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, detections string")
    with_text = docs.drop("detections")
    with_text.createOrReplaceTempView("documents")
    got = {}

    def read(frame):
        out = licenses.scan(frame, spaced_as="w", found_as="d")
        return {r.doc_id: sorted((x.level, x.words, -x.rule, x.first, x.label) for x in r.d) for r in out.collect()}

    found = read(docs)  # a column of the name that the query uses stays as it is
    assert licenses.scan(docs, spaced_as="w", found_as="d").filter("detections = 'kept'").count() == len(rows)
    for i, t, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        assert found[i] == sorted(_plain_detections(words)), t
    got = found
    assert got[8][0][4] == "gpl-3.0" and got[0] == []


def test_license_query(spark, tmp_path):
    texts = LICENSED + ["mit license apache license " * 40]
    rows = [(i // 2, t) for i, t in enumerate(texts + texts[:4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in licenses.op12_license_signatures(spark, str(tmp_path)).collect())
    assert got == Counter(_plain_licenses(*r) for r in rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert licenses.op12_license_signatures(spark, f"{tmp_path}/none").collect() == []


# ---------------------------------------------------------------- ranked search


def _plain_search(docs, items, k=10):
    terms = lambda t: re.findall(search.TERM, (t or "").translate(LOWER))
    rows = [(d, Counter(terms(t))) for d, t in docs]
    rows = [(d, c) for d, c in rows if c]
    n, all_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for w, f in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, ws in asked.items():
        scored = []
        for d, c in rows:
            m = 100 - 90 + (90 * sum(c.values()) * n) // all_terms
            s = sum(weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in ws if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß7", "日本"]
    draw = lambda n: " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=n))
    docs = [(i, draw(rng.randint(1, 90))) for i in range(400)]
    docs += [(1000 + i, "W5, w40; w41-w42") for i in range(30)]  # ties
    docs += [docs[0], docs[0], (None, "w5 w40 w41 w42"), (None, None), (7000, None), (7001, ""), (7002, " .,! "), (7003, draw(30_000))]
    items = [(i, draw(rng.randint(1, 40))) for i in range(25)] + [(100, "w40 w41"), (100, "w42"), (101, None), (102, "unheard of"), (103, "w0"), (None, "w7 É")]
    return docs, items


@pytest.mark.parametrize("held, read", [(search.HELD, search.READ_FIRST), (500, 1)])
def test_search(spark, corpus, monkeypatch, held, read):
    docs, items = corpus
    monkeypatch.setattr(search, "ASKED", 150)
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, score int, n string").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = search.search(frame, asked).collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain_search(docs, items)
    small = search.search(frame.filter("doc_id < 300"), asked, k=3).collect()
    assert sorted((tuple(r) for r in small), key=str) == _plain_search([d for d in docs if d[0] is not None and d[0] < 300], items, 3)


def test_search_in_blocks(corpus):
    """The search in small blocks, whose lists are read from one entry on, stops early and finds the same."""
    import numpy as np
    import pyarrow as pa

    docs, items = corpus
    docs = [(d, t) for d, t in docs if d is not None and d < 7000]
    rows = [(d, Counter(re.findall(search.TERM, (t or "").translate(LOWER)))) for d, t in docs]
    names = sorted({w for _, c in rows for w in c})
    at = {w: i for i, w in enumerate(names)}
    total = sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[w] + 1))) for w in names], np.int64)
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [d for d, _ in rows], "n": [sum(c.values()) for _, c in rows],
        "terms": pa.array([[at[w] for w in c] for _, c in rows], pa.list_(pa.int32())), "counts": pa.array([list(c.values()) for _, c in rows], pa.list_(pa.int32())),
    })
    want = _plain_search(docs, items)
    short = {i for i, t in items if t and len(t.split()) < 4}
    for i, t in items:
        wanted = sorted({at[w] for w in re.findall(search.TERM, (t or "").translate(LOWER)) if w in at})
        if not wanted or i == 100:
            continue
        looked = []
        block = search._Block([batch], weights, len(rows), total)
        scores = block.scores
        block.scores = lambda docs, asked, scores=scores, looked=looked: (looked.append(len(docs)), scores(docs, asked))[1]
        asked = np.zeros(len(names), bool)
        asked[wanted] = True
        found, values = block.top(np.array(wanted), asked, 10, 0)
        assert sorted((i, r, block.ids[int(d)].as_py(), int(s)) for r, (d, s) in enumerate(zip(found, values, strict=True), 1)) == sorted(x for x in want if x[0] == i)
        assert sum(looked) <= len(rows)
        if i in short:
            assert sum(looked) < len(rows)


def test_search_of_nothing(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text is null"), items)):
        out = search.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
