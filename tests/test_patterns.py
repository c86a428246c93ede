"""Many-pattern search against a plain scan."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemill.operators import patterns, syntax

TEXTS = [None, "", "a", "aaaa", "abcabcab", "été à l'été", "日本語日本", "x" * 700 + "needle" + "y" * 300, "needl", "e needle", "ab\nab", "aab" * 500]
KEYS = ["a", "aa", "aaa", "abc", "bca", "cab", "été", "é", "本語", "needle", "need", "b\na", "zz", "", None, "x" * 300, "aa"]


def _plain(text, key):
    return [i for i in range(len(text) - len(key) + 1) if text[i : i + len(key)] == key]


def test_automaton_finds_all_places():
    rng = random.Random(4)
    for _ in range(40):
        keys = list({"".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        text = "".join(rng.choices("abc", k=rng.randint(0, 700)))
        key, start = patterns.Automaton([k.encode() for k in keys]).find(np.frombuffer(text.encode(), np.uint8))
        assert sorted(zip(key.tolist(), start.tolist(), strict=True)) == sorted((i, s) for i, k in enumerate(keys) for s in _plain(text, k))


@pytest.mark.parametrize("block, cut", [(patterns.KEY_BYTES, patterns.SLICE), (12, 20)])
def test_places(spark, monkeypatch, block, cut):
    monkeypatch.setattr(patterns, "KEY_BYTES", block)
    monkeypatch.setattr(patterns, "SLICE", cut)
    texts = spark.createDataFrame([(f"t{i}", i, t) for i, t in enumerate(TEXTS + TEXTS[4:6])], "name string, id int, text string").repartition(3)
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS)], "ord long, key string")
    want = sorted((i, o, s) for i, t in enumerate(TEXTS + TEXTS[4:6]) for o, k in enumerate(KEYS) if k for s in _plain(t or "", k))
    got = sorted((r.id, r.ord, r.start) for r in patterns.places(texts, keys, ["id"]).collect())
    assert got == want
    first = {(r.name, r.ord) for r in patterns.first_rule(texts, keys, ["name", "id"]).collect()}
    assert first == {(f"t{i}", min(o for j, o, _ in want if j == i)) for i, _, _ in want}
    ordered = patterns.in_rule_order(texts, keys, ["id"]).filter("id = 4").orderBy("n").collect()
    assert [(r.ord, r.start) for r in ordered] == sorted((o, min(s for j, p, s in want if (j, p) == (4, o))) for o in {o for j, o, _ in want if j == 4})
    assert patterns.places(texts, keys.limit(0), ["id"]).collect() == [] and patterns.places(texts.limit(0), keys, ["id"]).collect() == []


def test_leftmost(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    keys = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS[:14])], "ord int, key string")
    pattern = re.compile("|".join(re.escape(k) for k in sorted(filter(None, KEYS[:14]), key=lambda k: -len(k))))
    want = sorted((i, KEYS.index(m[0]), m.start()) for i, t in enumerate(TEXTS) for m in pattern.finditer(t or ""))
    assert sorted(tuple(r) for r in patterns.places(texts, keys, ["id"], leftmost=True).collect()) == want
    monkeypatch.setattr(patterns, "KEY_BYTES", 8)
    with pytest.raises(ValueError, match="too many"):
        patterns.places(texts, keys, ["id"], leftmost=True)


def test_chunks_of_a_large_batch_come_in_slices():
    texts = [None, "def f(:\n", *(f"x = {i}\n# " + "y" * 2000 + "\n" for i in range(3000))]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(texts))], "text": texts})
    out = list(syntax._chunk_batches(iter([batch]), 400))
    assert len(out) > 4 and max(b.nbytes for b in out) < 2 << 20
    whole = {}
    for b in out:
        for r in b.to_pylist():
            whole.setdefault(r["path"], []).append((r["start_line"], r["source"]))
    assert {p: "\n".join(t for _, t in sorted(parts)) for p, parts in whole.items()} == {str(i): x or "" for i, x in enumerate(texts)}
