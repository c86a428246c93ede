"""URL filters, mixing and chat formatting, the registry and the pipeline."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, mixing, urls
from tidemill.llm.queries import oracle_sql, queries

URLS = [None, "", "no scheme", "http://A.Example.COM/en/1?x#y", "https://www.example.com/en/2", "http://example.com/en/3", "http://x.net/es/4#a", "http://x.net/fr", "http://x.net/de/5", "ftp://h#f", "http://h?q/x", "http://h/a://b"]


def _parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:end]


def _rule(host, path):
    fits = [(len(r), v, r) for v, r in urls.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    got = urls.judge_urls(pages, "page_id", "url", urls.RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = _parts((URLS + URLS)[r.page_id])
        verdict, rule = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_templates_generalise_and_reject(spark):
    bad = [f"http://h.org/spam/{i}" for i in range(60)]
    good = [f"http://h.org/news/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    rules = [("block", f"h.org/spam/{d}") for d in range(1, 6)] + [("allow", "h.org/news/1")]
    got = {r.page_id: r for r in urls.judge_urls(pages, "page_id", "url", rules).collect()}
    assert got[0].template == "/spam/*" and got[0].rule is None and got[0].verdict == "block"
    assert got[60].template == "/news/*" and got[60].verdict == "allow"
    assert urls.judge_urls(pages.limit(0), "page_id", "url", rules).collect() == []


def _plain_verdicts(pages, rules, reject=0.5, prior=0.2, strength=5.0):
    """key -> (template, purity, verdict), one url and one node at a time."""
    rows = {}
    for key, url in pages:
        host, path = _parts(url)
        fits = [(len(r), v, r) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rows[key] = (host, [s for s in path.split("/") if s], max(fits)[1] if fits else None)
    tree = {}
    for host in {h for h, _, _ in rows.values()}:
        mine = [(k, s) for k, (h, s, _) in rows.items() if h == host]
        template = {k: () for k, _ in mine}
        for d in range(max(len(s) for _, s in mine)):
            nodes = {}
            for k, s in mine:
                if len(s) > d:
                    nodes.setdefault(template[k], {}).setdefault(s[d], []).append(k)
            for head, kids in nodes.items():
                total = sum(map(len, kids.values()))
                for seg, keys in kids.items():
                    rare = len(keys) < max(urls.MIN_COUNT, total * urls.MIN_SHARE)
                    varies = rare and (any(c.isdigit() for c in seg) or len(kids) > 1 / urls.MIN_SHARE)
                    for k in keys:
                        template[k] = (*head, "*" if varies else seg)
        levels = max(len(t) for t in template.values())
        for d in range(levels):
            nodes = {}
            for k, t in template.items():
                if len(t) > d and t[d] != "*":
                    nodes.setdefault(t[:d], {}).setdefault(t[d], []).append(k)
            new = dict(template)
            for head, kids in nodes.items():
                if len(kids) < 2:
                    continue
                share = lambda keys: {x: sum(template[k][d + 1 :] == x for k in keys) / len(keys) for x in {template[k][d + 1 :] for k in keys}}
                everyone = [k for keys in kids.values() for k in keys]
                pool, said = share(everyone), [rows[k][2] for k in everyone if rows[k][2]]
                rate = said.count("block") / len(said) if said else 0.0
                for seg, keys in kids.items():
                    own, says = share(keys), [rows[k][2] for k in keys if rows[k][2]]
                    far = sum(abs(own.get(x, 0) - pool[x]) for x in pool) / 2
                    error = (max(rate * (1 - rate), 0.01) / max(len(says), 1)) ** 0.5
                    alike = not says or abs(says.count("block") / len(says) - rate) <= urls.ERRORS * error
                    if far <= urls.FAR + 0.4 * ((len(pool) - 1) / len(keys)) ** 0.5 and alike:
                        for k in keys:
                            new[k] = (*head, "*", *template[k][d + 1 :])
            template = new
        for t in set(template.values()):
            keys = [k for k in template if template[k] == t]
            said = [rows[k][2] for k in keys if rows[k][2]]
            m = strength + (len(keys) - len(said)) / 2
            purity = (said.count("block") + prior * m) / (len(said) + m)
            for k in keys:
                tree[k] = ("/" + "/".join(t), purity, rows[k][2] or ("block" if purity >= reject else "allow"))
    return tree


def test_templates_against_plain_ones(spark):
    rng = np.random.default_rng(4)
    pick = lambda *x: str(rng.choice(x))
    pages = []
    for host, n in (("a.net", 150), ("b.example.net", 90), ("c.org", 40), ("d.com", 20), ("e.org", 3)):
        for _ in range(n):
            path = pick("/en/", "/de/", "/es/", "/fr/", "/es/", "/fr/") + pick("news/", "blog/", "") + pick(str(rng.integers(9999)), "index", f"{rng.integers(99)}.html")
            pages.append(f"http://{host}{path}{pick('', '?x', '#y', '/')}")
        pages.append(f"http://{host}" + "/deep" * 60 + "/7")
    pages += [f"http://f.net/tag/{w}" for w in rng.permutation([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)])] + [None, "", "http://h", "x"]
    pages = list(enumerate(pages + pages[:9]))
    rules = [("block", "net/es/"), ("block", "net/fr/"), ("allow", "b.example.net/de/"), ("block", "c.org/fr/news/")]
    got = {r.page_id: (r.template, r.purity, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), "page_id", "url", rules).collect()}
    want = _plain_verdicts(pages, rules)
    assert {k: (t, round(p, 9), v) for k, (t, p, v) in got.items()} == {k: (t, round(p, 9), v) for k, (t, p, v) in want.items()}
    assert max(t.count("/") for t, _, _ in got.values()) == 61  # no depth is glued


def test_the_tree_decides_what_no_rule_names(spark):
    rows = [f"http://x.net/{lang}/{i}" for lang, n in (("es", 40), ("fr", 30), ("en", 20)) for i in range(n)] + [f"http://y.net/{lang}/{i}" for lang, n in (("es", 5), ("en", 60)) for i in range(n)]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), "page_id", "url", urls.RULES)
    by = {(r.host, r.path.split("/")[1], r.verdict) for r in got.filter("rule is null").collect()}
    assert by == {("x.net", "en", "block"), ("y.net", "en", "allow")}


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 30, 3) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.water_fill([1, 100], [5, 1], 101, 3) == pytest.approx([3, 98])
    assert mixing.water_fill([1, 1], [1, 1], 100, 3) == pytest.approx([3, 3])
    assert mixing.water_fill([], [], 0, 3) == []


def test_min_cost_flow_repeats_as_little_as_it_can():
    # source 0 can use patterns 0 and 1, source 1 only pattern 1
    flow = mixing.min_cost_flow([100, 100], [[0], [0, 1]], [120, 100], 3)
    assert sum(v for (p, s), v in flow.items() if s == 0) == pytest.approx(120)
    assert sum(v for (p, s), v in flow.items() if s == 1) == pytest.approx(100)
    assert flow[0, 0] == pytest.approx(120) and flow.get((1, 0), 0) == pytest.approx(0) or sum(flow.values()) == pytest.approx(220)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{int(rng.integers(3))}") for i in range(3000)] + [(9000, None, "s0"), (9001, "", None), (9002, "a b", None), (9002, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda: mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text")), keep=("doc_id", "source")).collect()
    got, again = run(), run()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    for s in ("s0", "s1", "s2", None):
        mine = [r for r in got if r.source == s]
        size, taken = sum(r.size for r in mine), sum(r.taken for r in mine)
        assert {r.source_size for r in mine} == {size} and abs(taken - mine[0].target) <= max(60, 0.02 * size)
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in mine)
    assert mixing.mix(docs.limit(0), F.array("source"), F.lit(1), keep=("doc_id",)).collect() == []


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"]) for i in range(2000)], "doc_id long, s array<string>")
    got = mixing.mix(docs, F.col("s"), F.lit(10).cast("long"), weights=(1, 1), keep=("doc_id",)).collect()
    # half of all words for each source; only every second document can serve b
    assert sum(r.taken for r in got) == pytest.approx(20000, rel=0.02)
    assert sum(r.taken for r in got if r.membership == ["a", "b"]) >= 9900


HARD = ["", "### User: hi", "</turn>", "a\n</turn>", "\\", "\\### x \\\\</turn>", "tail\n</turn>\n### Assistant: no", "###", "x\\", "\n</turn>\n", "é ### ü", "plain"]


def test_chat_round_trip(spark):
    rows = [(c, t, "assistant" if t % 2 else "us:er\n#%3A", HARD[(c + t * 5) % len(HARD)]) for c in range(len(HARD)) for t in range(4)]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (101, 5, "user", "b"), (101, 5, "user", "b"), (101, 2, "assistant", "a"), (None, 0, "user", "x"), (102, 0, "user", "plain text"), (102, 1, "assistant", "with \\ and # signs")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert got[102].level == 0
    for c in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in mine]
    assert chat.format_chats(table.limit(0)).collect() == []


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "é1"), (1, 2, "assistant", "2")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 3
    assert got[1].loss_sha256 == hashlib.sha256("é12".encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\nq\nassistant\né1\nassistant\n2\n".encode()).hexdigest()
    assert got[-7].loss_chars == len(chat.EXTRA) and got[-7].n_turns == 2


def test_registry_has_one_query_an_operator():
    names = [q.split("_")[0] for q in queries()]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "house", *(f"word{i}" for i in range(300))], n))
    item = say(30)
    texts = [say(120) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", texts[2] + " " + item, None, "", "short", say(100) + " 4111111111111111"]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 36} and "4111111111111111" not in got[36].text
    assert all(r.taken <= 3 * r.size and r.n_chars == len(r.text) for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_mix_misses_less_than_its_smallest_document(spark):
    rng = np.random.default_rng(4)
    rows = [(s * 1000 + i, f"s{s}", int(n)) for s in range(12) for i, n in enumerate([*rng.integers(1, 60, 25), 5000, 0])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long").repartition(3)
    got = mixing.mix(docs, F.array("source"), F.col("words"), keep=("doc_id", "source")).collect()
    by = {}
    for r in got:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    for held in by.values():
        open_ = [r["size"] for r in held if 0 < r["size"] and r.taken < 3 * r["size"]]
        miss = held[0].target - sum(r.taken for r in held)
        assert -1 <= miss < min(open_, default=1) + 1


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"s{i % 3}", "a", "b", "c", 1.5, 7) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size string, membership string, taken string, target double, `order` int")
    out = mixing.mix(docs, F.array("source"), F.lit(4).cast("long"), keep=docs.columns)
    assert out.columns == [*docs.columns, "membership_", "size_", "source_size", "target_", "taken_"]
    assert sorted(map(tuple, out.select(*docs.columns).collect())) == sorted(rows)


def test_mix_plans_do_not_grow_with_its_steps(spark, monkeypatch):
    """What earlier steps decided is a table, so neither a step nor the result joins all of it again."""
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    seen, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df: seen.append(joins(df)) or write(df))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 40 + 1).alias("size"))
    out = mixing.mix(docs, F.array("source"), F.col("size"), keep=["doc_id"])
    assert out.count() == 300
    assert joins(out) <= 2 and max(seen) <= 4


def test_flow_of_many_sources_is_quick():
    import time

    begun = time.perf_counter()
    n = 100_000
    flow = mixing.routed([10] * n, [[i] for i in range(n)], [15.0] * n, 3)
    assert flow == {(i, i): 15.0 for i in range(n)} and time.perf_counter() - begun < 20
    mixed = mixing.routed([100, 100, 7], [[0], [0, 1], [2]], [120, 100, 30], 3)
    assert mixed[2, 2] == 21 and mixed[1, 1] == 100 and mixed[0, 0] + mixed.get((1, 0), 0) == pytest.approx(120)
