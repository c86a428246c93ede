"""The library's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.functions import vectors as vx
from tidemill.operators import code, dataset, graph, incremental, metrics
from tidemill.plans import rules as rl
from tidemill.sources import files

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        QUERIES[f.__name__] = (run, sql)
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_lines(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", *keep, "text")
    return code.explode_lines(docs, lines=F.split("text", "\n"))


LINES = "SELECT doc_id, source, lang, i AS line, string_split(text, chr(10))[i] AS line_text FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i)"
WORD_RULES = [(0, "anhe", "A1", 1.0), (1, "the", "T1", 0.9), (2, "and", "N1", 1.0), (3, "und", "U1", 0.5), (4, "que", "Q1", 0.3), (5, "les", "L1", 1.0)]
VALUES = "(VALUES " + ", ".join(f"({o}, '{k}', '{r}', CAST({c} AS DOUBLE))" for o, k, r, c in WORD_RULES) + ") AS r(ord, key, replacement, confidence)"


def word_rules(spark: SparkSession) -> DataFrame:
    return rl.literal_table(spark, WORD_RULES, "ord int, key string, replacement string, confidence double")


TAG_RULES = (("upper", r"[A-Z]{4,}", False, None), ("digits", r"[0-9]{4,}", False, None), ("mail", r"[a-z0-9.]+@[a-z0-9.]+", False, None), ("pipe", r" \| ", True, "|"))


@query(f"""WITH l AS ({LINES}), h AS (
 SELECT source, 'upper' AS category, unnest(regexp_extract_all(line_text, '[A-Z]{{4,}}')) AS s FROM l
 UNION ALL SELECT source, 'digits', unnest(regexp_extract_all(line_text, '[0-9]{{4,}}')) FROM l
 UNION ALL SELECT source, 'mail', unnest(regexp_extract_all(line_text, '[a-z0-9.]+@[a-z0-9.]+')) FROM l
 UNION ALL SELECT source, 'pipe', '|' FROM l WHERE regexp_matches(line_text, ' \\| '))
SELECT source, category, count(*) AS n FROM h GROUP BY ALL""")
def rule_hits_by_category(spark, d):
    hits = code.tag_lines(doc_lines(spark, d, "source"), TAG_RULES)
    return hits.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH l AS ({LINES}) SELECT doc_id, count(*) AS n_lines, max(length(line_text)) AS longest FROM l GROUP BY doc_id")
def line_stats(spark, d):
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line_text")).alias("longest"))


@query(f"""WITH l AS ({LINES}), h AS (SELECT doc_id, line, ord, key FROM l JOIN {VALUES} ON contains(line_text, key))
SELECT doc_id, key AS symbol, CAST(line AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY line, ord) n FROM h) WHERE n = 1""")
def first_hit_dedupe(spark, d):
    hits = doc_lines(spark, d).join(F.broadcast(word_rules(spark)), F.contains("line_text", F.col("key"))).select("doc_id", "line", "ord", F.col("key").alias("symbol"))
    return code.first_of_each(hits, ["doc_id", "symbol"], ["line", "ord"]).select("doc_id", "symbol", "line")


@query(f"WITH l AS ({LINES}) SELECT lang, regexp_matches(line_text, '^\\s*#') AS is_comment, count(*) AS n, sum(length(split_part(line_text, '#', 1)))::BIGINT AS kept FROM l GROUP BY ALL")
def comment_line_flags(spark, d):
    x = doc_lines(spark, d, "lang").select("lang", code.false_positive(F.col("line_text"), F.lit("import")).alias("is_comment"), F.length(tx.uncommented(F.col("line_text"))).alias("k"))
    return x.groupBy("lang", "is_comment").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("kept"))


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS symbol FROM documents), u AS (SELECT symbol, count(*) AS n FROM w GROUP BY symbol)
SELECT u.symbol, n, replacement, CASE WHEN confidence >= 1 THEN NULL WHEN confidence IS NOT NULL THEN 'Low confidence mapping' ELSE 'Unknown API' END AS reason, coalesce(confidence, 0.4) AS confidence
FROM u LEFT JOIN {VALUES} ON u.symbol = r.key""")
def token_lookup_status(spark, d):
    w = t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return code.lookup(w, word_rules(spark).withColumnRenamed("key", "symbol")).select("symbol", "n", "replacement", "reason", "confidence")


@query(f"""WITH l AS ({LINES}), h AS (SELECT doc_id, line, arg_min(key, ord) AS key, arg_min(replacement, ord) AS replacement FROM l JOIN {VALUES} ON contains(line_text, key) GROUP BY doc_id, line)
SELECT doc_id, CAST(line AS BIGINT) AS line, key, replacement FROM h""")
def first_contained_rule(spark, d):
    return code.first_contained(doc_lines(spark, d), word_rules(spark)).select("doc_id", "line", "key", "replacement")


PREFIXES = [(0, "https://m.", "mobile"), (1, "https://", "secure"), (2, "http://blog.", "blog"), (3, "http://", "plain")]


@query("""SELECT page_id, arg_min(replacement, ord) AS replacement FROM pages JOIN (VALUES (0,'https://m.','mobile'),(1,'https://','secure'),(2,'http://blog.','blog'),(3,'http://','plain')) AS p(ord, key, replacement) ON starts_with(url, key) GROUP BY page_id""")
def prefix_rule(spark, d):
    r = rl.literal_table(spark, PREFIXES, "ord int, key string, replacement string")
    return code.first_contained(t(spark, d, "pages").select("page_id", "url"), r, "url", prefix=True).select("page_id", "replacement")


@query("SELECT doc_id, md5(replace(replace(replace(text, 'the', 'THE_'), 'THE_n', 'x'), 'and', '&')) AS digest FROM documents")
def sequential_replace(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(code.replace_in_order(F.col("text"), [("the", "THE_"), ("THE_n", "x"), ("and", "&")])).alias("digest"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, coalesce(a.v, b.v, 'other') AS kind FROM h LEFT JOIN (VALUES ('tionsh.example.net', 'known')) AS a(k, v) ON host = a.k
LEFT JOIN (VALUES ('net', 'network'), ('org', 'organisation')) AS b(k, v) ON regexp_extract(host, '([a-z]+)$', 1) = b.k""")
def host_fallback_lookup(spark, d):
    h = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    a = rl.literal_table(spark, [("tionsh.example.net", "known")], "host string, v1 string")
    b = rl.literal_table(spark, [("net", "network"), ("org", "organisation")], "tld string, v2 string")
    h = h.withColumn("tld", F.regexp_extract("host", "([a-z]+)$", 1)).join(F.broadcast(a), "host", "left").join(F.broadcast(b), "tld", "left")
    return h.select("page_id", F.coalesce("v1", "v2", F.lit("other")).alias("kind"))


@query(f"SELECT doc_id, string_agg(replacement, ',' ORDER BY confidence, ord) AS suggestions FROM documents JOIN {VALUES} ON contains(text, key) GROUP BY doc_id")
def trigger_suggestions(spark, d):
    hits = t(spark, d, "documents").join(F.broadcast(word_rules(spark)), F.contains("text", F.col("key")))
    parts = F.array_sort(F.collect_list(F.struct("confidence", "ord", "replacement")))
    return hits.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["replacement"]), ",").alias("suggestions"))


EDITS = f"""WITH l AS ({LINES}), e AS (SELECT doc_id, line, line_text, ord % 2 AS phase, ord, key, replacement FROM l JOIN {VALUES} ON contains(line_text, key)),
 w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY phase, ord) AS n FROM e)"""


def edits(spark, d):
    e = doc_lines(spark, d).join(F.broadcast(word_rules(spark)), F.contains("line_text", F.col("key"))).withColumn("phase", F.col("ord") % 2)
    return code.one_edit_a_line(e, ["doc_id", "line"])


@query(f"{EDITS} SELECT doc_id, CAST(line AS BIGINT) AS line, key, replacement FROM w WHERE n = 1")
def one_edit_per_line(spark, d):
    return edits(spark, d).select("doc_id", "line", "key", "replacement")


@query(f"""{EDITS} SELECT l.doc_id, md5(string_agg(CASE WHEN w.key IS NULL THEN l.line_text ELSE replace(l.line_text, w.key, w.replacement) END, chr(10) ORDER BY l.line)) AS digest
FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.line = w.line AND w.n = 1 GROUP BY l.doc_id""")
def rewrite_reassemble(spark, d):
    e = edits(spark, d).select("doc_id", "line", F.replace("line_text", F.col("key"), F.col("replacement")).alias("new_text"))
    return code.rebuilt(doc_lines(spark, d), e, "doc_id").select("doc_id", F.md5("text").alias("digest"))


VALIDATORS = [("mail", "[a-z0-9.]+@[a-z0-9.]+", "ERROR"), ("digits", "[0-9]{6,}", "WARNING"), ("shout", "[A-Z]{8,}", "INFO")]
VSQL = "(VALUES " + ", ".join(f"('{v}', '{p}', '{s}')" for v, p, s in VALIDATORS) + ") AS v(validator, pattern, severity)"
ISSUES = f"WITH l AS ({LINES}), i AS (SELECT doc_id, line, validator, severity FROM l JOIN {VSQL} ON regexp_matches(split_part(line_text, '#', 1), pattern))"


def found_issues(spark, d):
    v = rl.literal_table(spark, VALIDATORS, "validator string, pattern string, severity string")
    return code.issues(doc_lines(spark, d), v).select("doc_id", "line", "validator", "severity")


@query(f"{ISSUES} SELECT validator, severity, count(*) AS n, count(DISTINCT doc_id) AS docs, min(line)::BIGINT AS first_line FROM i GROUP BY ALL")
def validator_issues(spark, d):
    return found_issues(spark, d).groupBy("validator", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("line").alias("first_line"))


@query(f"{ISSUES} SELECT d.doc_id, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(severity) AS issues, count(*) FILTER (WHERE severity = 'ERROR') = 0 AS passed FROM documents d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id")
def validator_pass(spark, d):
    return code.verdicts(t(spark, d, "documents").select("doc_id"), found_issues(spark, d), "doc_id")


@query(f"""WITH l AS ({LINES}), h AS (SELECT doc_id, line, key FROM l JOIN {VALUES} ON contains(line_text, key))
SELECT doc_id, key AS symbol, CAST(min(line) AS BIGINT) AS line FROM h GROUP BY doc_id, key HAVING count(DISTINCT line) = 1""")
def orphan_terms(spark, d):
    hits = doc_lines(spark, d).join(F.broadcast(word_rules(spark)), F.contains("line_text", F.col("key")))
    return hits.groupBy("doc_id", F.col("key").alias("symbol")).agg(F.min("line").alias("line"), F.countDistinct("line").alias("n")).filter("n = 1").drop("n")


@query("""SELECT doc_id, a, b FROM documents JOIN (VALUES ('the', 'und'), ('les', 'que'), ('and', 'der')) AS p(a, b) ON contains(text, a) AND contains(text, b)""")
def conflicting_pairs(spark, d):
    p = rl.literal_table(spark, [("the", "und"), ("les", "que"), ("and", "der")], "a string, b string")
    return t(spark, d, "documents").join(F.broadcast(p), F.contains("text", F.col("a")) & F.contains("text", F.col("b"))).select("doc_id", "a", "b")


SCORED = f"WITH s AS (SELECT doc_id, key, ord, confidence FROM documents JOIN {VALUES} ON contains(text, key))"


def scored(spark, d):
    return t(spark, d, "documents").select("doc_id", "text").join(F.broadcast(word_rules(spark)), F.contains("text", F.col("key"))).drop("text")


@query(f"""{SCORED} SELECT doc_id, count(*) FILTER (WHERE confidence >= 0.9) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.9) AS needs_review,
count(*) FILTER (WHERE confidence < 0.5) AS low, count(*) AS total, round(avg(confidence), 6) AS score FROM s GROUP BY doc_id""")
def quality_scores(spark, d):
    return code.scores(scored(spark, d), "doc_id").withColumn("score", F.round("score", 6))


@query(f"{SCORED} SELECT doc_id, string_agg(key, ',' ORDER BY confidence, ord) AS items FROM s WHERE confidence < 0.95 GROUP BY doc_id")
def review_items(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("confidence", "ord", "key")))
    return scored(spark, d).filter("confidence < 0.95").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["key"]), ",").alias("items"))


@query(f"""{SCORED}, p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE confidence < 0.9) AS r FROM s GROUP BY doc_id)
SELECT CASE WHEN n > 5 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS complexity, count(*) AS docs, sum(n)::BIGINT AS changes, sum(r)::BIGINT AS review FROM p GROUP BY 1""")
def dry_run_summary(spark, d):
    p = scored(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < 0.9).alias("r"))
    kind = F.when(F.col("n") > 5, "high").when(F.col("n") > 0, "medium").otherwise("low")
    return p.groupBy(kind.alias("complexity")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("changes"), F.sum("r").alias("review"))


TOKENS = "WITH k AS (SELECT doc_id, source, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents)"


def tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", "source", tx.token_estimate(F.col("text")).alias("tokens"))


@query(f"{TOKENS} SELECT source, sum(tokens)::BIGINT AS tokens, max(tokens) AS largest FROM k GROUP BY source")
def chunk_tokens(spark, d):
    return tokens(spark, d).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


@query(f"{TOKENS}, c AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY tokens, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM k) SELECT doc_id, used FROM c WHERE used <= 2000")
def budget_prefix(spark, d):
    return code.within_budget(tokens(spark, d), ["source"], ["tokens", "doc_id"], 2000).filter("selected").select("doc_id", "used")


@query(f"""{TOKENS}, c AS (SELECT source, list(tokens ORDER BY doc_id) AS ts FROM k GROUP BY source)
SELECT source, list_reduce(ts, lambda a, x: CASE WHEN a + x <= 3000 THEN a + x ELSE a END, 0::BIGINT) AS used FROM c""")
def budget_skip_greedy(spark, d):
    return code.greedy_budget(tokens(spark, d), ["source"], "doc_id", "tokens", 3000).select("source", "used")


@query(f"WITH l AS ({LINES}) SELECT doc_id, ((line - 1) // 5 + 1)::BIGINT AS part, min(line)::BIGINT AS start_line, max(line)::BIGINT AS end_line, sum(length(line_text))::BIGINT AS chars FROM l GROUP BY ALL")
def split_oversized(spark, d):
    part = (F.floor((F.col("line") - 1) / 5) + 1).alias("part")
    return doc_lines(spark, d).groupBy("doc_id", part).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum(F.length("line_text")).alias("chars"))


@query(f"""WITH l AS ({LINES}) SELECT h.doc_id, h.line::BIGINT AS line, count(*) AS n, sum(length(c.line_text))::BIGINT AS chars FROM l h JOIN l c ON h.doc_id = c.doc_id AND abs(h.line - c.line) <= 3
WHERE contains(h.line_text, '@') GROUP BY ALL""")
def context_band(spark, d):
    lines = doc_lines(spark, d)
    hits = lines.filter(F.contains("line_text", F.lit("@"))).select("doc_id", "line", F.explode(F.sequence(F.col("line") - 3, F.col("line") + 3)).alias("near"))
    around = lines.select("doc_id", F.col("line").alias("near"), F.length("line_text").alias("k"))
    return hits.join(around, ["doc_id", "near"]).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("chars"))


@query("SELECT doc_id, sha256(text || chr(0) || source) AS k FROM documents")
def cache_keys(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.cache_key(F.col("text"), F.col("source")).alias("k"))


@query("SELECT count(*) AS todo, min(doc_id) AS first_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0")
def incremental_skip(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    known = docs.filter("path % 3 = 0").select("path", tx.cache_key(F.when(F.col("path") % 5 == 0, F.lit("old")).otherwise(F.col("text")), F.lit("b|")).alias("source_hash"))
    return incremental.changed(docs, known, "b").agg(F.count(F.lit(1)).alias("todo"), F.min("path").alias("first_id"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top_k FROM events WHERE contains(event_type, 'c') GROUP BY event_type""")
def audit_rollup(spark, d):
    e = t(spark, d, "events").filter(F.contains("event_type", F.lit("c")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("top_k"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant_turn(spark, d):
    c = t(spark, d, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("said"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE turn > 0 GROUP BY conv_id")
def conversation_pack(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))))
    return t(spark, d, "conversations").filter("turn > 0").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("digest"))


NORM = "trim(regexp_replace(regexp_replace(lower(trim({c})), '[ -]', '_', 'g'), '_+', '_', 'g'), '_')"


@query(f"SELECT p_partkey, {NORM.format(c='p_name')} AS name, trim(regexp_replace(regexp_replace({NORM.format(c='p_brand')}, '[0-9]+$', ''), '_+', '_', 'g'), '_') AS brand, regexp_replace(lower(trim(p_type)), '[ -]', '_', 'g') AS label FROM part")
def normalized_names(spark, d):
    return t(spark, d, "part").select("p_partkey", tx.normalize_text(F.col("p_name")).alias("name"), tx.normalize_condition(F.col("p_brand")).alias("brand"), tx.normalize_label(F.col("p_type")).alias("label"))


SUFFIX_SQL = tx.COPY_SUFFIX.replace("'", "''")


@query(f"SELECT c_custkey, regexp_replace(lower(replace(c_name, '#', '_') || ['', '_flip', '_rot90_2', '_copy1_aug', ' (3)'][(c_custkey % 5 + 1)::INT]), '{SUFFIX_SQL}', '') AS stem FROM customer")
def group_ids(spark, d):
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("_")), F.element_at(F.array(*map(F.lit, ("", "_flip", "_rot90_2", "_copy1_aug", " (3)"))), (F.col("c_custkey") % 5 + 1).cast("int")))
    return t(spark, d, "customer").select("c_custkey", tx.strip_copy_suffixes(name).alias("stem"))


@query("""SELECT page_id, string_split(url, '/')[-4] AS crop, string_split(url, '/')[-2] AS condition FROM pages WHERE len(string_split(url, '/')) >= 4""")
def path_labels(spark, d):
    p = t(spark, d, "pages").select("page_id", files.path_labels(F.col("url")).alias("p")).filter("p is not null")
    return p.select("page_id", "p.crop", "p.condition")


@query("SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 12)")
def small_class_filter(spark, d):
    return dataset.drop_small_classes(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", 12)


@query("""WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) r FROM n) WHERE r = 1""")
def majority_label(spark, d):
    return dataset.majority_label(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def mixed_groups(spark, d):
    return dataset.mixed_groups(t(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT l_orderkey, arg_min(l_returnflag, l_linenumber) AS label, count(*) AS n FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag) GROUP BY l_orderkey")
def first_label(spark, d):
    rows = dataset.keep_first(t(spark, d, "lineitem").withColumn("k", F.concat_ws("|", "l_orderkey", "l_linenumber")), "k", "l_returnflag")
    return dataset.first_label(rows, "l_orderkey", "l_returnflag", "l_linenumber")


SPLIT = """WITH b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|123'), doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT doc_id, lang, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM b)"""


def split_docs(spark, d):
    return dataset.stratified_split(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 123)


@query(f"{SPLIT} SELECT doc_id, lang, split FROM s")
def stratified_split(spark, d):
    return split_docs(spark, d)


@query(f"{SPLIT} SELECT lang, count(DISTINCT split) AS splits FROM s GROUP BY lang")
def class_coverage(spark, d):
    return dataset.coverage(split_docs(spark, d), "lang")


GROUPED = "WITH u AS (SELECT doc_id, source, (CAST('0x' || substr(md5(source || '|7'), 1, 8) AS BIGINT) % 10000) / 10000.0 AS u FROM documents), s AS (SELECT doc_id, source, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM u)"


@query(f"{GROUPED} SELECT doc_id, source, split FROM s")
def grouped_split(spark, d):
    return dataset.hashed_split(t(spark, d, "documents").select("doc_id", "source"), "source", 7)


@query(f"{SPLIT} SELECT source, count(DISTINCT split) AS splits FROM s JOIN documents USING (doc_id) GROUP BY source HAVING count(DISTINCT split) > 1")
def leak_guard(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    return dataset.leaks(dataset.stratified_split(docs, "doc_id", "lang", 123), "source")


@query("SELECT p_brand, count(*) AS n, round((SELECT count(*) FROM part) / ((SELECT count(DISTINCT p_brand) FROM part) * count(*)), 9) AS weight FROM part GROUP BY p_brand")
def class_weights(spark, d):
    return dataset.balanced_weights(t(spark, d, "part"), "p_brand").withColumn("weight", F.round("weight", 9))


@query("WITH n AS (SELECT label, count(*) AS n, CAST(1 AS DOUBLE) / (count(*) + CAST(1e-6 AS DOUBLE)) AS w FROM embeddings GROUP BY label) SELECT CAST(label AS BIGINT) AS label, n, round(w / sum(w) OVER (), 9) AS weight FROM n")
def inverse_freq_weights(spark, d):
    return dataset.inverse_weights(t(spark, d, "embeddings"), "label").withColumn("weight", F.round("weight", 9))


@query("SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS label_idx FROM (SELECT DISTINCT p_brand FROM part)")
def label_index(spark, d):
    return dataset.label_index(t(spark, d, "part"), "p_brand")


PREDS = "WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"


def predictions(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"))


@query(f"{PREDS}, c AS (SELECT y AS c FROM p UNION SELECT p FROM p) SELECT a.c::BIGINT AS y, b.c::BIGINT AS p, count(p.y) AS n FROM c a CROSS JOIN c b LEFT JOIN p ON p.y = a.c AND p.p = b.c GROUP BY ALL")
def confusion_matrix(spark, d):
    return metrics.confusion(predictions(spark, d))


REPORT = f"""{PREDS}, c AS (SELECT y AS c FROM p UNION SELECT p FROM p), s AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS support, (SELECT count(*) FROM p WHERE p = c) AS predicted, (SELECT count(*) FROM p WHERE y = c AND p = c) AS hits FROM c),
r AS (SELECT c, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM s),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)"""


@query(f"{REPORT} SELECT c::BIGINT AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def class_report(spark, d):
    r = metrics.class_report(predictions(spark, d))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"{REPORT} SELECT round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM p), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def f1_scores(spark, d):
    s = metrics.summary(predictions(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, rank, pos::BIGINT AS pos, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, pos) AS rank FROM e) WHERE rank <= 3""")
def argmax_topk(spark, d):
    return metrics.top_k(t(spark, d, "embeddings"), "vec_id", "embedding", 3).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(v), 6) AS mean FROM e GROUP BY ALL""")
def vector_mean(spark, d):
    return metrics.mean_vectors(t(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def argmax_class(spark, d):
    return t(spark, d, "embeddings").select("vec_id", vx.argmax(F.col("embedding")).alias("best"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / greatest(1, sum(l_quantity)), 6) AS loss FROM lineitem GROUP BY l_returnflag")
def weighted_mean_loss(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.greatest(F.lit(1.0), F.sum("l_quantity")), 6).alias("loss"))


@query("""WITH h AS (SELECT event_type, CAST(ts AS DATE) AS epoch, round(avg(value), 6) AS m FROM events GROUP BY ALL),
a AS (SELECT *, row_number() OVER w AS n, max(m) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h WINDOW w AS (PARTITION BY event_type ORDER BY epoch)),
b AS (SELECT *, before IS NULL OR m > before AS improved FROM a),
c AS (SELECT *, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY event_type ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stale FROM b)
SELECT event_type, epoch, improved, stale, coalesce(max(CASE WHEN stale >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM c""")
def early_stopping(spark, d):
    h = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("m"))
    return metrics.early_stopping(h, "event_type", "epoch", "m").select("event_type", "epoch", "improved", "stale", "ran")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_tax * 10 AS cx, l_discount * 10 AS cy, l_quantity / 100 AS w, l_quantity / 50 AS h FROM lineitem),
p AS (SELECT *, (cx - w/2)*640 AS x1, (cy - h/2)*480 AS y1, (cx + w/2)*640 AS x2, (cy + h/2)*480 AS y2 FROM b),
q AS (SELECT l_orderkey, l_linenumber, greatest(0, trunc(x1 - (x2-x1)*0.05))::BIGINT AS x1, greatest(0, trunc(y1 - (y2-y1)*0.05))::BIGINT AS y1, least(640, trunc(x2 + (x2-x1)*0.05))::BIGINT AS x2, least(480, trunc(y2 + (y2-y1)*0.05))::BIGINT AS y2 FROM p)
SELECT count(*) AS n, sum(x2 - x1)::BIGINT AS wide, sum(y2 - y1)::BIGINT AS high FROM q WHERE x2 - x1 >= 15 AND y2 - y1 >= 15 AND (x2 - x1) * (y2 - y1) >= 400""")
def box_geometry(spark, d):
    li = t(spark, d, "lineitem")
    x1, y1, x2, y2 = vx.padded_box(F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") / 100, F.col("l_quantity") / 50, F.lit(640.0), F.lit(480.0))
    b = li.select(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).filter("x2 - x1 >= 15 and y2 - y1 >= 15 and (x2 - x1) * (y2 - y1) >= 400")
    return b.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x2") - F.col("x1")).alias("wide"), F.sum(F.col("y2") - F.col("y1")).alias("high"))


@query("SELECT kind, nationkey::BIGINT AS nationkey, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY ALL")
def union_sources(spark, d):
    a = t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nationkey"))
    b = t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nationkey"))
    return a.unionByName(b).groupBy("kind", "nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_keep_first(spark, d):
    return dataset.keep_first(t(spark, d, "documents").select(F.md5("text").alias("text_key"), "doc_id"), "text_key", "doc_id")


@query("""SELECT k, arg_max(v, src) AS v FROM (SELECT l_partkey AS k, 0 AS src, 'old' AS v FROM lineitem UNION ALL SELECT p_partkey, 1, 'new' FROM part WHERE p_size % 2 = 0) GROUP BY k""")
def last_wins_merge(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.lit("old").alias("v")).distinct()
    b = t(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), F.lit("new").alias("v"))
    return dataset.last_wins([a, b], "k")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'needs ROCm ' || (p_size % 7) || '.' || (p_size % 13) || '+' END AS notes FROM part),
v AS (SELECT *, try_cast(regexp_extract(notes, 'ROCm ([0-9]+)', 1) AS INT) AS major, try_cast(regexp_extract(notes, 'ROCm [0-9]+[.]([0-9]+)', 1) AS INT) AS minor FROM n)
SELECT p_partkey FROM v WHERE notes = '' OR major < 5 OR (major = 5 AND minor <= 10)""")
def version_filter(spark, d):
    size = F.col("p_size")
    notes = F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("needs ROCm "), (size % 7).cast("string"), F.lit("."), (size % 13).cast("string"), F.lit("+")))
    return rl.for_version(t(spark, d, "part").select("p_partkey", notes.alias("notes")), "5.10").select("p_partkey")


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS at, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
g AS (SELECT DISTINCT p_brand, n FROM n), s AS (SELECT p_brand, unnest(generate_series(1, 20)) AS draw, n FROM g)
SELECT s.p_brand, s.draw, p_partkey FROM s JOIN n ON n.p_brand = s.p_brand AND n.at = CAST('0x' || substr(md5(s.p_brand || '|' || s.draw || '|5'), 1, 8) AS BIGINT) % s.n""")
def sample_with_replacement(spark, d):
    return dataset.sample_with_replacement(t(spark, d, "part"), "p_brand", "p_partkey", 20, 5)


DISEASES = [("A", "Leaf spot", "Remove leaves."), ("N", "Healthy plant", "Nothing to do."), ("R", "Stem rust", "Use a fungicide.")]


@query("""SELECT l_orderkey, count(*) AS n, min('This looks like ' || title || '. ' || advice) AS answer FROM lineitem JOIN (VALUES ('A','Leaf spot','Remove leaves.'),('N','Healthy plant','Nothing to do.'),('R','Stem rust','Use a fungicide.')) AS x(k, title, advice) ON l_returnflag = k GROUP BY l_orderkey""")
def qa_generate(spark, d):
    dim = rl.literal_table(spark, DISEASES, "l_returnflag string, title string, advice string")
    # dealt while rows are narrow: the least text of an order takes a sort, which would hold a whole file split of texts
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_returnflag").repartition("l_orderkey")
    q = dataset.conversations(rows, dim, "l_returnflag", "l_orderkey", 3)
    return q.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.get("conversations", F.lit(1))["content"]).alias("answer"))


#: Each supplier depends on those of half and of a third of its number; one in twenty also on itself plus one, which closes a cycle.
EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier
 UNION ALL SELECT s_suppkey // 2, s_suppkey FROM supplier WHERE s_suppkey % 20 = 19) WHERE src <> dst AND dst IN (SELECT s_suppkey FROM supplier) AND src IN (SELECT s_suppkey FROM supplier))"""


def supplier_edges(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey")
    to = lambda n: F.floor(F.col("s_suppkey") / n).cast("long")
    e = s.select(F.col("s_suppkey").alias("src"), to(2).alias("dst")).unionByName(s.select(F.col("s_suppkey").alias("src"), to(3).alias("dst")))
    e = e.unionByName(s.filter("s_suppkey % 20 = 19").select(to(2).alias("src"), F.col("s_suppkey").alias("dst"))).distinct().filter("src <> dst")
    known = s.select(F.col("s_suppkey").alias("k"))
    return e.join(known, F.col("dst") == F.col("k"), "left_semi").join(known, F.col("src") == F.col("k"), "left_semi")


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src),
bad AS (SELECT DISTINCT a AS module FROM c WHERE b IN (SELECT a FROM c AS x WHERE x.a = x.b) UNION SELECT a FROM c WHERE a = b),
r AS (SELECT s_suppkey AS module, 0 AS level FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.module WHERE e.src NOT IN (SELECT module FROM bad))
SELECT s_suppkey AS module, CASE WHEN s_suppkey IN (SELECT module FROM bad) THEN -1 ELSE (SELECT max(level) FROM r WHERE module = s_suppkey) END::BIGINT AS level FROM supplier""")
def topo_levels(spark, d):
    return graph.levels(t(spark, d, "supplier").select(F.col("s_suppkey").alias("module")), supplier_edges(spark, d))


@query(f"WITH {EDGES} SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src::VARCHAR) AS dependents FROM e GROUP BY dst")
def dependents(spark, d):
    return graph.dependents(supplier_edges(spark, d).select("dst", F.col("src").cast("string").alias("src")))


@query("""WITH e AS (SELECT user_id, list(epoch_us(ts) ORDER BY epoch_us(ts), event_id) AS ts FROM events GROUP BY user_id)
SELECT user_id, len(list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 3600000000 THEN list_concat(a, x) ELSE a END)) AS kept FROM e""")
def debounced_events(spark, d):
    return incremental.debounced(t(spark, d, "events"), ["user_id"], "ts", "event_id", 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


from tidemill.plans import order_queries, state_queries, table_queries, text_queries  # noqa: E402, F401  add to QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
