"""Hunks of text pairs, and texts from hunks."""

import random
import re

from pyspark.sql import functions as F

from tidemill.operators import patches


def _pairs():
    rng = random.Random(6)
    pairs = [(None, None), ("", ""), (None, "a"), ("a", None), ("a", ""), ("a\n", "a"), ("x\n" * 500, "x\n" * 499), ("a\nb\nc", "c\nb\na"), ("-a\n+b\n c", "+b\n-a"), ("é\r\nb", "é\nb")]
    for _ in range(80):
        old = [rng.choice(["a", "b", "{", "}", "", f"u{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 40))]
        new = [x for x in old if rng.random() > 0.1]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice(["a", "new", ""]))
        pairs.append(("\n".join(old), "\n".join(new)))
    big = [f"line {i % 700}" for i in range(20_000)]
    return [*pairs, ("\n".join(big), "\n".join(x for i, x in enumerate(big) if i % 900))]


def test_patched_texts_are_the_new_ones(spark):
    pairs = _pairs()
    rows = spark.createDataFrame([(i, a, b, 0) for i, (a, b) in enumerate(pairs)], "id int, old string, new string, hunk int").repartition(4)
    for context in (0, 3):
        found = patches.hunks(rows, ["id"], "old", "new", context)
        out = {r.id: r.patched for r in patches.patched(rows.select("id", "old"), found, ["id"], "old").collect()}
        assert len(out) == len(pairs)
        for i, (a, b) in enumerate(pairs):
            assert (out[i] or "") == (b or ""), pairs[i]
    held = {r.id for r in patches.hunks(rows, ["id"], "old", "new").select("id").collect()}
    assert held == {i for i, (a, b) in enumerate(pairs) if a != b}


def test_common_lines_are_kept():
    old = [f"l{i}" for i in range(100)]
    new = [*old[:20], "added", *old[20:50], *old[60:]]
    assert len(patches.matches(old, new)) == 90
    pairs = patches.matches(["a", "x", "b", "x", "c"], ["x", "a", "x", "c"])
    assert all(p < q for p, q in zip(pairs, pairs[1:], strict=False)) and len(pairs) >= 2


def test_rendered(spark):
    old, new = "\n".join("abcdefghijklmnopqrstuvwxyz"), "\n".join("abXdefghijklmnopqrstvwxyz")
    rows = spark.createDataFrame([("f.py", old, new)], "path string, old string, new string")
    found = patches.hunks(rows, ["path"], "old", "new")
    diff = patches.rendered(found, ["path"], F.col("path")).first().diff
    assert diff.split("\n")[:3] == ["--- a/f.py", "+++ b/f.py", "@@ -1,6 +1,6 @@"]
    assert re.findall(r"(?m)^[-+][a-zA-Z]$", diff) == ["-c", "+X", "-u"] and "@@ -18,7 +18,6 @@" in diff
