"""Queries over ordered sequences, splits, draws and graphs with cycles, each beside its SQL; ``queries`` imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import code, dataset, graph, greedy, metrics
from tidemill.plans.queries import LINES, query, t


@query("""WITH e AS (SELECT list(epoch_us(ts) ORDER BY epoch_us(ts), event_id) AS ts FROM events),
k AS (SELECT unnest(list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 7200000000 THEN list_concat(a, x) ELSE a END)) AS us FROM e)
SELECT us FROM k""")
def global_debounce(spark, d):
    events = t(spark, d, "events").select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return greedy.debounced(events, ["us"], "ts", "event_id", 7200)


#: Numbers of segments, one for each chunk, by a fold over the tokens of a group in order.
SEGMENTS = """list_reduce(list_prepend([0, 0]::BIGINT[], list_transform(tokens, lambda x: [x])), lambda a, x: CASE
 WHEN x[1] < {quarter} AND a[1] + x[1] < {most} THEN list_concat([a[1] + x[1]], a[2:], [a[2]])
 WHEN x[1] < {quarter} THEN list_concat([x[1], a[2] + 1], a[3:], [a[2] + 1]) ELSE list_concat([0, a[2] + 2], a[3:], [a[2] + 1]) END)[3:]"""


@query(f"""WITH c AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids, list((n_chars // 4)::BIGINT ORDER BY doc_id) AS tokens FROM documents GROUP BY source),
s AS (SELECT source, unnest(ids) AS doc_id, unnest(tokens) AS tokens, unnest({SEGMENTS.format(quarter=1000, most=4000)}) AS segment FROM c)
SELECT source, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM s GROUP BY source, segment""")
def merged_documents(spark, d):
    chunks = t(spark, d, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).alias("tokens"))
    out = greedy.merged_small(chunks, ["source", "doc_id", "tokens"], ["source"], ["doc_id"], 4000)
    return out.groupBy("source", "segment").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.sum("tokens").alias("tokens")).drop("segment")


@query(f"""WITH l AS ({LINES}), c AS (SELECT doc_id, list(line ORDER BY line) AS ids, list((length(line_text) // 4)::BIGINT ORDER BY line) AS tokens FROM l GROUP BY doc_id),
s AS (SELECT doc_id, unnest(ids) AS line, unnest(tokens) AS tokens, unnest({SEGMENTS.format(quarter=100, most=400)}) AS segment FROM c)
SELECT doc_id, min(line) AS first, max(line) AS last, sum(tokens)::BIGINT AS tokens FROM s GROUP BY doc_id, segment""")
def merged_lines(spark, d):
    lines = code.explode_lines(t(spark, d, "documents").select("doc_id", "text"), lines=F.split("text", "\n"))
    chunks = lines.select("doc_id", "line", F.floor(F.length("line_text") / 4).alias("tokens"))
    out = greedy.merged_small(chunks, ["doc_id", "line", "tokens"], ["doc_id"], ["line"], 400)
    return out.groupBy("doc_id", "segment").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("tokens").alias("tokens")).drop("segment")


#: Suppliers as modules: trees, and cycles of two, three and more modules, some of them joined.
CYCLIC = """e AS (SELECT DISTINCT src, dst FROM (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier UNION ALL SELECT s_suppkey // 2, s_suppkey FROM supplier WHERE s_suppkey % 20 = 19
 UNION ALL SELECT s_suppkey // 8, s_suppkey FROM supplier WHERE s_suppkey % 30 = 17 UNION ALL SELECT s_suppkey - 1, s_suppkey FROM supplier WHERE s_suppkey % 7 = 3)
 WHERE src <> dst AND dst IN (SELECT s_suppkey FROM supplier) AND src IN (SELECT s_suppkey FROM supplier))"""


def cyclic_edges(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey")
    part = lambda n: F.floor(F.col("s_suppkey") / n).cast("long")
    key = F.col("s_suppkey")
    e = s.select(key.alias("src"), part(2).alias("dst")).unionByName(s.filter(key % 20 == 19).select(part(2).alias("src"), key.alias("dst")))
    e = e.unionByName(s.filter(key % 30 == 17).select(part(8).alias("src"), key.alias("dst"))).unionByName(s.filter(key % 7 == 3).select((key - 1).alias("src"), key.alias("dst")))
    known = s.select(key.alias("k"))
    return e.join(known, F.col("dst") == F.col("k"), "left_semi").join(known, F.col("src") == F.col("k"), "left_semi")


@query(f"""WITH RECURSIVE {CYCLIC}, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src),
p AS (SELECT s_suppkey AS module, least(s_suppkey, coalesce((SELECT min(x.b) FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a = s_suppkey), s_suppkey)) AS component FROM supplier),
f AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN p a ON a.module = src JOIN p b ON b.module = dst WHERE a.component <> b.component),
r AS (SELECT DISTINCT component, 0 AS level FROM p UNION SELECT f.src, r.level + 1 FROM r JOIN f ON f.dst = r.component)
SELECT module, component, (SELECT max(level) FROM r WHERE r.component = p.component)::BIGINT AS level FROM p""")
def module_order(spark, d):
    return graph.order(t(spark, d, "supplier").select(F.col("s_suppkey").alias("module")), cyclic_edges(spark, d))


#: Parts of an order's lines by supplier: the labels of a supplier are all one, so whole suppliers are dealt out.
GROUPED = """g AS (SELECT l_suppkey AS g, l_suppkey % 2 AS label, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT *, row_number() OVER o - 1 AS place, count(*) OVER (PARTITION BY label) AS k, sum(n) OVER o - n AS before, sum(n) OVER (PARTITION BY label) AS whole
 FROM g WINDOW o AS (PARTITION BY label ORDER BY md5(g::VARCHAR || '|11'), g)),
s AS (SELECT g, CASE WHEN k - place = 1 THEN 'test' WHEN k - place = 2 THEN 'val' WHEN place = 0 THEN 'train' WHEN before + n / 2 < whole * 0.8::DOUBLE THEN 'train' WHEN before + n / 2 < whole * 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM w)"""


@query(f"WITH {GROUPED} SELECT l_orderkey, l_linenumber, split, true AS grouped FROM lineitem JOIN s ON g = l_suppkey")
def split_by_groups(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 2).alias("label"), F.concat_ws("|", F.lpad("l_orderkey", 12, "0"), "l_linenumber").alias("key"))
    return dataset.grouped_split(rows, "key", "l_suppkey", "label", 11).select("l_orderkey", "l_linenumber", "split", "grouped")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, lpad(l_orderkey::VARCHAR, 12, '0') || '|' || l_linenumber AS key FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(key || '|11'), key) AS p, count(*) OVER (PARTITION BY l_returnflag) AS n FROM k)
SELECT l_orderkey, l_linenumber, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split, false AS grouped FROM p""")
def split_with_fallback(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.concat_ws("|", F.lpad("l_orderkey", 12, "0"), "l_linenumber").alias("key"))
    return dataset.grouped_split(rows, "key", "l_suppkey", "l_returnflag", 11).select("l_orderkey", "l_linenumber", "split", "grouped")


@query("""WITH w AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) - p_size AS low, sum(p_size) OVER (ORDER BY p_partkey) AS high FROM part WHERE p_size > 0),
n AS (SELECT sum(p_size)::BIGINT AS n FROM part WHERE p_size > 0), r AS (SELECT unnest(range(1, 5001)) AS draw),
u AS (SELECT draw, CAST('0x' || substr(md5(draw || '|9'), 1, 15) AS BIGINT) % n AS point FROM r, n)
SELECT draw, p_partkey FROM u JOIN w ON point >= low AND point < high""")
def weighted_draws(spark, d):
    return dataset.weighted_draws(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 5000, 9)


@query("""SELECT p_partkey FROM part WHERE p_size > 0
ORDER BY -ln((CAST('0x' || substr(md5(p_partkey::VARCHAR || '|9'), 1, 12) AS BIGINT)::DOUBLE + 1) / 281474976710656.0) / p_size, p_partkey LIMIT 200""")
def weighted_sample(spark, d):
    return dataset.weighted_sample(t(spark, d, "part"), "p_partkey", "p_size", 200, 9).select("p_partkey")


def _sql_digits(value: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5({value} || '|{seed}'), 1, 12) AS BIGINT)"


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM embeddings), s AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
d AS (SELECT x, x // b AS l, x % b AS r, a, b, n FROM s, range((SELECT a * b FROM s)) AS t(x)),
r1 AS (SELECT *, (l + {_sql_digits("r", "0|21")}) % a AS l1 FROM d), r2 AS (SELECT *, (r + {_sql_digits("l1", "1|21")}) % b AS r1 FROM r1),
r3 AS (SELECT *, (l1 + {_sql_digits("r1", "2|21")}) % a AS l2 FROM r2), p AS (SELECT x, l2 * b + (r1 + {_sql_digits("l2", "3|21")}) % b AS y, n FROM r3),
w AS (SELECT x, y FROM p WHERE x < n UNION ALL SELECT w.x, p.y FROM w JOIN p ON p.x = w.y WHERE w.y >= p.n),
e AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS at, pow(sin({_sql_digits("vec_id", "share|21")} / 281474976710656.0 * (pi() / 2)), 2) AS share FROM embeddings),
k AS (SELECT label, 1.0::DOUBLE / count(*) AS weight FROM embeddings WHERE label % 2 = 0 GROUP BY label)
SELECT e.vec_id, f.vec_id AS partner, round(e.share, 9) AS share, round(e.share * e.embedding[1]::DOUBLE + (1 - e.share) * f.embedding[1]::DOUBLE, 6) AS first,
 round(CASE WHEN e.label = f.label THEN 1.0 ELSE e.share END, 9) AS own, round(e.share * coalesce(k.weight, 1) + (1 - e.share) * coalesce(m.weight, 1), 9) AS weight
FROM w JOIN e ON e.at = w.x JOIN f_ f ON f.at = w.y LEFT JOIN k ON k.label = e.label LEFT JOIN k m ON m.label = f.label WHERE w.y < (SELECT n FROM n)""".replace("JOIN f_ f", "JOIN e f"))
def mixed_embeddings(spark, d):
    rows = t(spark, d, "embeddings")
    weights = rows.filter("label % 2 = 0").groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    out = dataset.mixed_rows(rows, "vec_id", "embedding", "label", 0.5, 21, weights)
    return out.select("vec_id", "partner", F.round("share", 9).alias("share"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("labels", F.lit(0))["share"], 9).alias("own"), F.round("weight", 9).alias("weight"))


@query("""SELECT vec_id, vec_id % 5 <> 0 AS same_shape, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 0.5 WHEN vec_id % 3 = 1 THEN 0.000005 ELSE 0 END::DOUBLE AS furthest, vec_id % 5 <> 0 AND vec_id % 3 <> 0 AS passed
FROM embeddings WHERE vec_id % 7 <> 0""")
def close_embeddings(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    off = F.when(F.col("vec_id") % 3 == 0, 0.5).when(F.col("vec_id") % 3 == 1, 0.000005).otherwise(0.0)
    moved = F.transform("embedding", lambda x, i: F.when(i == 0, x + off).otherwise(x))
    other = rows.filter("vec_id % 7 <> 0").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.slice(moved, 1, 10)).otherwise(moved).alias("embedding"))
    return metrics.close_vectors(rows, other, "vec_id", "embedding").withColumn("furthest", F.round("furthest", 9))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, length(text) AS n FROM documents),
k AS (SELECT *, CASE WHEN n > 600 THEN greatest(1, 600 // greatest(1, n // len(l))) ELSE len(l) END AS step FROM s),
p AS (SELECT *, unnest(range(0, (len(l) - 1) // step + 1)) AS i FROM k)
SELECT doc_id, i + 1 AS part, i * step + 1 AS start_line, least(i * step + step, len(l)) AS end_line, md5(array_to_string(l[i * step + 1:i * step + step], chr(10))) AS digest FROM p""")
def parts_by_size(spark, d):
    out = code.split_by_size(t(spark, d, "documents").select("doc_id", "text"), 600)
    return out.select("doc_id", "part", "start_line", "end_line", F.md5("source").alias("digest"))


SPLIT_KINDS = """b AS (SELECT doc_id, source || '/' || lang AS kind, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|123'), doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT kind, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM b)"""


def split_kinds(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.concat_ws("/", "source", "lang").alias("kind"))
    return dataset.stratified_split(docs, "doc_id", "lang", 123)


@query(f"WITH {SPLIT_KINDS} SELECT kind FROM s WHERE split = 'train' INTERSECT SELECT kind FROM s WHERE split = 'val' INTERSECT SELECT kind FROM s WHERE split = 'test'")
def kinds_in_all_splits(spark, d):
    return dataset.in_all_splits(split_kinds(spark, d), "kind")


@query(f"WITH {SPLIT_KINDS} SELECT DISTINCT kind, x.split FROM s, (VALUES ('train'), ('val'), ('test')) AS x(split) EXCEPT SELECT kind, split FROM s")
def missing_kinds(spark, d):
    return dataset.missing_labels(split_kinds(spark, d), "kind")
