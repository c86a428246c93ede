"""More of the library's queries over the driver's tables, each beside its SQL; ``queries`` imports them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions import checks, reports
from tidemill.functions import text as tx
from tidemill.operators import code, dataset, migrate, project
from tidemill.plans import rules as rl
from tidemill.plans.queries import LINES, VALUES, WORD_RULES, doc_lines, query, t, word_rules

KEYS = [k for _, k, _, _ in WORD_RULES]


@query("""WITH c AS (SELECT lang, doc_id, sum(n_chars // 4) OVER (PARTITION BY lang ORDER BY doc_id) AS used, n_chars // 4 AS tokens FROM documents)
SELECT lang, count_if(used <= 20000) AS taken, coalesce(max(used) FILTER (used <= 20000), 0)::BIGINT AS used FROM c GROUP BY lang""")
def budget_break(spark, d):
    chunks = t(spark, d, "documents").select("lang", "doc_id", F.floor(F.col("n_chars") / 4).alias("tokens"))
    return code.budget_until_misfit(chunks, ["lang"], "doc_id", "tokens", 20000).select("lang", "taken", "used")


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'ring']) AS fits FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring'])")
def tag_profile(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return project.with_profile(rows, "tags", ["red", "ring"]).select("p_partkey", F.lit(True).alias("fits"))


@query("""WITH c AS (SELECT l_suppkey AS entity, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT entity, label FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS r FROM c) WHERE r = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(entity::VARCHAR || '|3'), entity) AS p, count(*) OVER (PARTITION BY label) AS n FROM m),
s AS (SELECT entity, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM p)
SELECT l_returnflag AS label, split, count(*) AS n_rows, count(DISTINCT l_suppkey) AS entities FROM lineitem JOIN s ON l_suppkey = entity GROUP BY ALL""")
def entity_split(spark, d):
    out = dataset.entity_split(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("label")), "entity", "label", 3)
    return out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("entities"))


@query(f"SELECT source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM {VALUES} WHERE contains(d.text, key)) GROUP BY source")
def has_usage(spark, d):
    return t(spark, d, "documents").filter(project.has_any(F.col("text"), KEYS)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS confidence FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, l_linenumber) AS rank FROM s)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, rank FROM r WHERE rank > 1 AND confidence > 0.05""")
def alternatives(spark, d):
    lines = t(spark, d, "lineitem")
    share = F.col("l_quantity") / F.sum("l_quantity").over(W.partitionBy("l_orderkey"))
    rows = lines.select("l_orderkey", "l_linenumber", share.alias("confidence"))
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.col("confidence").desc(), "l_linenumber"))
    return rows.withColumn("rank", rank).filter("rank > 1 and confidence > 0.05").select("l_orderkey", "l_linenumber", "rank")


@query("SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY ALL")
def unknown_classes(spark, d):
    known = rl.literal_table(spark, [("A",), ("N",)], "label string")
    return dataset.unknown_labels(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("label")), known, "label")


@query("SELECT p_partkey, p_brand || '_' || p_type AS label FROM part")
def joined_labels(spark, d):
    return t(spark, d, "part").select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("label"))


@query("SELECT c_custkey, c_name AS path, c_mktsegment AS label, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label_idx FROM customer")
def label_records(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("path"), F.col("c_mktsegment").alias("label"))
    return dataset.with_label_index(rows, "label").select("c_custkey", "path", "label", "label_idx")


@query(f"WITH l AS ({LINES}) SELECT doc_id, line, rtrim(line_text) AS context FROM l WHERE contains(line_text, 'the')")
def hit_context(spark, d):
    return doc_lines(spark, d).filter(F.contains("line_text", F.lit("the"))).select("doc_id", "line", F.rtrim("line_text").alias("context"))


@query("SELECT string_agg(label, ',' ORDER BY label) AS labels, count(*) AS n FROM (SELECT DISTINCT c_mktsegment AS label FROM customer)")
def label_list(spark, d):
    index = dataset.with_label_index(t(spark, d, "customer").select(F.col("c_mktsegment").alias("label")).distinct(), "label")
    return index.agg(F.map_from_entries(F.collect_list(F.struct("label", "label_idx"))).alias("m")).select(F.array_join(reports.labels_by_index(F.col("m")), ",").alias("labels"), F.size("m").alias("n"))


LIBRARIES = [(0, "blog", "journal"), (1, "example.com", "shop"), (2, "org", "club")]


@query("SELECT page_id, arg_min(v, ord) AS library FROM pages JOIN (VALUES (0,'blog','journal'),(1,'example.com','shop'),(2,'org','club')) AS r(ord, k, v) ON contains(lower(url), k) GROUP BY page_id")
def library_lookup(spark, d):
    return t(spark, d, "pages").select("page_id", project.first_fitting(F.lower("url"), LIBRARIES).alias("library")).filter("library is not null")


CLASS_NAMES = [("n", 0, "none"), ("n", 1, "some"), ("m", 2, "many")]


@query("SELECT vec_id, v AS name FROM embeddings JOIN (VALUES ('n',0,'none'),('n',1,'some'),('m',2,'many')) AS r(s, k, v) ON label = k AND s = CASE WHEN label < 2 THEN 'n' ELSE 'm' END")
def class_names(spark, d):
    dim = rl.literal_table(spark, CLASS_NAMES, "source string, label int, name string")
    rows = t(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("label") < 2, "n").otherwise("m").alias("source"))
    return rows.join(F.broadcast(dim), ["source", "label"]).select("vec_id", "name")


@query("""WITH p AS (SELECT * FROM (VALUES ('Customer#000000009', 0), ('Customer#000000002', 1), ('Customer#000000040', 2)) AS r(name, pos))
SELECT c_name, coalesce(pos, 999)::BIGINT AS pos, row_number() OVER (ORDER BY coalesce(pos, 999), c_name) AS place FROM customer LEFT JOIN p ON c_name = name""")
def dependency_order(spark, d):
    order = rl.literal_table(spark, [("Customer#000000009", 0), ("Customer#000000002", 1), ("Customer#000000040", 2)], "c_name string, pos int")
    return project.in_dependency_order(t(spark, d, "customer").select("c_name"), order, "c_name")


@query(f"SELECT doc_id, key AS symbol, NOT contains(replace(text, 'the', ''), key) AND lang = 'en' AS resolved FROM documents JOIN {VALUES} ON contains(text, key)")
def resolved_symbols(spark, d):
    hits = t(spark, d, "documents").join(F.broadcast(word_rules(spark)), F.contains("text", F.col("key")))
    return hits.select("doc_id", F.col("key").alias("symbol"), project.resolved(F.replace("text", F.lit("the"), F.lit("")), F.col("key"), F.col("lang") == "en").alias("resolved"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, 'WARNING' AS severity, count_if(contains(line_text, 'the')) AS a, count_if(contains(line_text, '0')) AS b FROM l GROUP BY doc_id HAVING a > 0 AND b > 0")
def mixed_vendors(spark, d):
    return project.mixed(doc_lines(spark, d), "doc_id", F.contains("line_text", F.lit("the")), F.contains("line_text", F.lit("0")))


@query(f"""WITH h AS (SELECT doc_id, count_if(contains(text, key)) AS usages, count_if(contains(text, key) AND confidence >= 1) AS applied FROM documents, {VALUES} GROUP BY doc_id)
SELECT count(*) AS files, count_if(usages > 0) AS files_with_usage, sum(usages)::BIGINT AS usages, sum(applied)::BIGINT AS applied, (sum(usages) - sum(applied))::BIGINT AS remaining FROM h""")
def project_totals(spark, d):
    holds = lambda least: sum((F.contains("text", F.lit(k)).cast("int") for _, k, _, c in WORD_RULES if c >= least), F.lit(0))
    return project.totals(t(spark, d, "documents").select(F.coalesce(holds(0), F.lit(0)).alias("usages"), F.coalesce(holds(1), F.lit(0)).alias("applied")))


@query("SELECT count(DISTINCT l_returnflag) AS classes, count(*) AS images, count(DISTINCT l_suppkey) AS groups FROM lineitem")
def distinct_counts(spark, d):
    return t(spark, d, "lineitem").agg(F.countDistinct("l_returnflag").alias("classes"), F.count(F.lit(1)).alias("images"), F.countDistinct("l_suppkey").alias("groups"))


@query("SELECT user_id, count(*) AS n, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 9) AS per_second FROM events GROUP BY user_id")
def throughput(spark, d):
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / F.lit(1e6)
    rows = t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / F.nullif(seconds, F.lit(0.0)), 9).alias("per_second"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS symbols FROM orders GROUP BY o_custkey")
def module_symbols(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("symbols"))


@query("SELECT l_returnflag, round(max(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 6) AS furthest FROM lineitem GROUP BY l_returnflag")
def max_abs_difference(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(reports.furthest(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")), 6).alias("furthest"))


@query("SELECT source, count_if(n_chars < 50) AS too_small, count_if(n_chars >= 50 AND lang IS NULL) AS unreadable, count_if(n_chars >= 50 AND lang IS NOT NULL) AS kept FROM documents GROUP BY source")
def skip_counters(spark, d):
    small, unreadable = F.col("n_chars") < 50, F.col("lang").isNull()
    return t(spark, d, "documents").groupBy("source").agg(F.count_if(small).alias("too_small"), F.count_if(~small & unreadable).alias("unreadable"), F.count_if(~small & ~unreadable).alias("kept"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def empty_classes(spark, d):
    sold = t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return dataset.without_samples(t(spark, d, "part").select("p_partkey", "p_name"), sold, "p_partkey").select("p_partkey", "p_name")


@query("SELECT doc_id, length(p) - length(replace(p, chr(10), '')) + 1 AS line FROM (SELECT doc_id, split_part(text, 'the', 1) AS p FROM documents WHERE contains(text, 'the'))")
def block_line(spark, d):
    return t(spark, d, "documents").filter(F.contains("text", F.lit("the"))).select("doc_id", tx.line_of(F.col("text"), F.lit("the")).alias("line"))


@query("SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS place FROM pages")
def sorted_paths(spark, d):
    return project.places(t(spark, d, "pages").select("page_id", "url"), "url", "page_id").select("page_id", "place")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)
SELECT doc_id, array_to_string(x[1:20], chr(10)) || CASE WHEN len(x) > 20 THEN chr(10) || '... ' || (len(x) - 20) || ' more lines omitted' ELSE '' END AS head FROM l WHERE x IS NOT NULL""")
def analysis_head(spark, d):
    return t(spark, d, "documents").filter("text is not null").select("doc_id", reports.first_lines(F.col("text"), 20).alias("head"))


@query("SELECT doc_id, left(text, 200) AS preview, array_to_string(string_split(text, chr(10))[-3:], chr(10)) AS tail FROM documents WHERE text IS NOT NULL")
def previews(spark, d):
    return t(spark, d, "documents").filter("text is not null").select("doc_id", F.left("text", F.lit(200)).alias("preview"), reports.last_lines(F.col("text"), 3).alias("tail"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS a, round(embedding[2]::DOUBLE, 6) AS b, round(embedding[3]::DOUBLE, 6) AS c FROM embeddings")
def sample_values(spark, d):
    first = F.slice("embedding", 1, 3)
    return t(spark, d, "embeddings").select("vec_id", *[F.round(F.get(first, F.lit(i)).cast("double"), 6).alias(n) for i, n in enumerate("abc")])


@query(f"WITH l AS ({LINES}) SELECT doc_id, count(*) AS shared FROM (SELECT doc_id, line FROM l WHERE contains(line_text, 'the') UNION SELECT doc_id, line FROM l WHERE line <= 3) GROUP BY doc_id")
def shared_context(spark, d):
    lines = doc_lines(spark, d)
    both = lines.filter(F.contains("line_text", F.lit("the"))).select("doc_id", "line").unionByName(lines.filter("line <= 3").select("doc_id", "line"))
    return both.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


@query("""WITH g AS (SELECT * FROM (VALUES ('Customer#000000007', 1), ('Customer#000000003', 2)) AS r(name, pos))
SELECT c_name, row_number() OVER (ORDER BY coalesce(pos, 1000), c_name) AS place FROM customer LEFT JOIN g ON c_name = name""")
def ordered_append(spark, d):
    graph = rl.literal_table(spark, [("Customer#000000007", 1), ("Customer#000000003", 2)], "c_name string, pos int")
    return project.appended(graph, t(spark, d, "customer").select("c_name"), "c_name", "pos").select("c_name", "place")


@query("SELECT c_custkey, 'Apply these changes:' || chr(10) || '- ''' || c_name || ''' -> ''' || lower(c_name) || '''' AS prompt FROM customer")
def prompts(spark, d):
    change = F.array(F.struct(F.col("c_name").alias("old"), F.lower("c_name").alias("new")))
    return t(spark, d, "customer").select("c_custkey", reports.change_prompt("Apply these changes:", change).alias("prompt"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS bare FROM pages")
def stripped_prefix(spark, d):
    return t(spark, d, "pages").select("page_id", tx.without_prefix(F.col("url"), "https?://").alias("bare"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(floor(l_quantity)::BIGINT - 5, 40)) AS lo, greatest(0, least(floor(l_quantity)::BIGINT + 5, 40)) AS hi FROM lineitem""")
def clamped_boxes(spark, d):
    q = F.floor("l_quantity")
    return t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber"), reports.clamp(q - 5, 0, 40).alias("lo"), reports.clamp(q + 5, 0, 40).alias("hi"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 1.0::DOUBLE WHEN p_brand = 'Brand#2' THEN 0.95::DOUBLE WHEN contains(p_brand, '#1') THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM part")
def rule_confidence(spark, d):
    return t(spark, d, "part").select("p_partkey", code.rule_confidence(F.col("p_brand"), {"Brand#1": 1.0, "Brand#2": 0.95}, "#1").alias("confidence"))


@query("SELECT o_orderkey, greatest(CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 + 1.0::DOUBLE END, 15.0::DOUBLE * pow(2, o_orderkey % 5)) AS delay FROM orders")
def backoff_delays(spark, d):
    asked = F.col("o_custkey") % 4
    return t(spark, d, "orders").select("o_orderkey", reports.backoff(F.col("o_orderkey") % 5, F.when(asked > 0, asked)).alias("delay"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, epoch_us(ts) // 1000000 AS epoch FROM events")
def utc_stamps(spark, d):
    at = F.col("ts")
    return t(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.floor(F.unix_micros(at.cast("timestamp")) / 1_000_000).alias("epoch"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'seen' WHEN 'error' THEN 'fault' ELSE 'other' END AS v FROM events")
def map_lookup(spark, d):
    base = {"click": "tap", "view": "seen"}
    return t(spark, d, "events").select("event_id", reports.from_map(F.col("event_type"), base | {"click": "press", "error": "fault"}, "other").alias("v"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def last_json_line(spark, d):
    log = F.concat_ws("\n", F.lit("started {"), F.lit('{"k": 1, "x"'), F.col("props"), F.lit("{broken"), F.lit("done"))
    return t(spark, d, "events").select("event_id", F.get_json_object(tx.last_json_line(log), "$.k").cast("long").alias("k"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i:anhe)|The|[0-9]{5}')")
def chunk_prefilter(spark, d):
    return t(spark, d, "documents").filter(F.col("text").rlike("(?i:anhe)|The|[0-9]{5}")).select("doc_id")


@query(f"WITH l AS ({LINES}) SELECT doc_id, line, col::BIGINT AS col FROM (SELECT doc_id, line, line_text, unnest(generate_series(1, length(line_text) - 2)) AS col FROM l WHERE contains(line_text, 'the')) WHERE substr(line_text, col, 3) = 'the'")
def match_columns(spark, d):
    hits = doc_lines(spark, d).filter(F.contains("line_text", F.lit("the"))).select("doc_id", "line", F.explode(tx.match_starts(F.col("line_text"), "the")).alias("col"))
    return hits.select("doc_id", "line", (F.col("col") + 1).alias("col"))


@query(f"""WITH l AS ({LINES}), n AS (SELECT *, replace(line_text, 'the', 'THE') AS new_text, CASE line % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'accept' END AS decision FROM l WHERE contains(line_text, 'the'))
SELECT doc_id, line, CASE WHEN decision = 'reject' THEN line_text ELSE new_text END AS final, coalesce(decision, 'accept') AS decision FROM n""")
def reviewed_edits(spark, d):
    edits = doc_lines(spark, d).filter(F.contains("line_text", F.lit("the"))).withColumn("new_text", F.replace("line_text", F.lit("the"), F.lit("THE")))
    said = edits.filter("line % 3 < 2").select("doc_id", "line", F.when(F.col("line") % 3 == 0, "reject").otherwise("accept").alias("decision"))
    return code.decided(edits, said, ["doc_id", "line"]).select("doc_id", "line", "final", "decision")


@query(f"WITH l AS ({LINES}) SELECT doc_id, line, 'ERROR' AS severity, 'reference' AS validator FROM l WHERE contains(split_part(line_text, '#', 1), 'anhe')")
def reference_issues(spark, d):
    return checks.pattern_issues(doc_lines(spark, d), "reference", "anhe", "ERROR").select("doc_id", "line", "severity", "validator")


@query("SELECT c_nationkey::BIGINT AS original, arg_max(c_name, c_custkey) AS replacement FROM customer GROUP BY c_nationkey")
def change_map(spark, d):
    return project.change_map(t(spark, d, "customer").select(F.col("c_nationkey").alias("original"), F.col("c_name").alias("replacement"), F.col("c_custkey").alias("at")), "at")


@query("""WITH f AS (SELECT page_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/.]+)(?:[.][a-z]+)?/?$', 1) AS stem FROM pages)
SELECT stem, min(page_id) AS first, count(*) AS n FROM f GROUP BY stem""")
def file_stems(spark, d):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    rows = t(spark, d, "pages").select("page_id", tx.stem(path).alias("stem"))
    return rows.groupBy("stem").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS ({LINES}), h AS (SELECT doc_id, line, ord, confidence FROM l JOIN {VALUES} ON contains(line_text, key)),
a AS (SELECT doc_id, line, min(ord) FILTER (confidence >= 1) AS done FROM h GROUP BY ALL)
SELECT doc_id, count(DISTINCT CASE WHEN done IS NOT NULL THEN line END) AS applied, count_if(confidence < 1 AND (done IS NULL OR ord < done)) AS remaining FROM h JOIN a USING (doc_id, line) GROUP BY doc_id""")
def migrated_documents(spark, d):
    lines = doc_lines(spark, d).withColumnRenamed("doc_id", "path")
    hits = lines.join(F.broadcast(word_rules(spark)), F.contains("line_text", F.col("key")))
    usages = hits.select("path", "line", "ord", F.lit("api_call").alias("category"), F.col("key").alias("symbol"), F.lit(False).alias("false_positive"))
    _, applied, remaining = migrate.migrated(lines, usages, word_rules(spark).withColumnRenamed("key", "symbol"))
    counts = applied.select("path", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(remaining.select("path", F.lit(0).alias("a"), F.lit(1).alias("r")))
    return counts.groupBy(F.col("path").alias("doc_id")).agg(F.sum("a").alias("applied"), F.sum("r").alias("remaining"))
