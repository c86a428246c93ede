"""Queries that keep state between runs: the cache, and streams that skip what they know; each beside its SQL; ``queries`` imports them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.functions import reports
from tidemill.operators.graph import shared_folder
from tidemill.operators.result_cache import ResultCache
from tidemill.plans.queries import query, t
from tidemill.streaming import watch


def filled_cache(spark, d) -> ResultCache:
    """A cache with a result for each document, a second one for a third of them, and a plan for a half, in a new folder."""
    cache = ResultCache(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    result = lambda tail: docs.select("path", "text", F.concat("text", F.lit("?" + tail)).alias("result"), F.lit("[]").alias("applied"), F.lit("[]").alias("remaining"))
    cache.put(result(""), "rocm")
    cache.put(result("!").filter("path % 3 = 0"), "rocm")
    cache.put_plans(docs.filter("path % 2 = 0").select("text", F.lit("[]").alias("issues"), F.lit("a plan").alias("plan")))
    return cache


@query("SELECT count(*) AS tracked_files, count(DISTINCT text) AS cached_migrations, count(DISTINCT text) FILTER (doc_id % 2 = 0) AS cached_plans FROM documents")
def cache_stats(spark, d):
    return filled_cache(spark, d).stats()


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text FROM documents),
k AS (SELECT text, bool_or(doc_id % 3 = 0) AS second FROM documents GROUP BY text)
SELECT doc_id, second IS NOT NULL AS hit, md5(text || '?' || CASE WHEN second THEN '!' ELSE '' END) AS digest FROM (SELECT a.doc_id, k.second, k.text FROM a LEFT JOIN k USING (text))""")
def cached_results(spark, d):
    cache = filled_cache(spark, d)
    cache.compact()
    asked = t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return cache.get(asked, "rocm").select("doc_id", "hit", F.md5("result").alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def changed_since_cached(spark, d):
    cache = filled_cache(spark, d)
    docs = t(spark, d, "documents").select("doc_id", F.concat("doc_id", F.when(F.col("doc_id") % 7 == 0, "new").otherwise("")).alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("text"))
    return cache.changed(docs, "rocm").select("doc_id")


@query("""WITH v AS (SELECT doc_id, 1 AS version, text FROM documents UNION ALL SELECT doc_id, 2, text || ' changed' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0)
SELECT doc_id, version, md5(text) AS digest FROM v""")
def stream_skips(spark, d):
    """Two runs of a stream over versions of all documents; the second run and a third without new files start from the state of the ones before."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    second = docs.filter("path % 2 = 0").select("path", F.lit(2).alias("at"), F.concat("text", F.when(F.col("path") % 3 == 0, " changed").otherwise("")).alias("text"))
    late = docs.filter("path % 4 = 0").select("path", F.lit(0).alias("at"), F.lit("late").alias("text"))
    for versions in (docs.select("path", F.lit(1).alias("at"), "text"), second.unionByName(late), None):
        if versions is not None:
            versions.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("path long, at int, text string").parquet(f"{root}/in")
        watch.append_changed(stream, f"{root}/out", f"{root}/state", "rocm")
    return spark.read.parquet(f"{root}/out").select(F.col("path").alias("doc_id"), F.col("at").alias("version"), F.md5("text").alias("digest"))


PADDED = "rpad({c}, greatest(length({c}), {w})::INTEGER, ' ')"


@query(f"""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, 'src/' || repeat(event_type, (1 + user_id % 5)::INTEGER) || '/f' || event_id || '.py' AS f, event_type, event_id % 50 AS applied, user_id % 7 AS remaining,
 round_even((event_id % 1001)::DOUBLE / 1000 * 100, 0)::BIGINT || '%' AS c, CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE '-' END AS v FROM events),
g AS (SELECT *, CASE WHEN length(f) > 28 THEN '...' || right(f, 25) ELSE f END AS p FROM e)
SELECT event_id, {PADDED.format(c="stamp", w=22)} || ' ' || {PADDED.format(c="p", w=30)} || ' ' || {PADDED.format(c="event_type", w=10)} || ' ' || lpad(applied::VARCHAR, 7, ' ') || ' ' || lpad(remaining::VARCHAR, 7, ' ') || ' ' || lpad(c, 5, ' ') || ' ' || lpad(v, 6, ' ') AS entry FROM g""")
def history_lines(spark, d):
    e = t(spark, d, "events")
    file = F.concat(F.lit("src/"), F.repeat("event_type", (1 + F.col("user_id") % 5).cast("int")), F.lit("/f"), F.col("event_id").cast("string"), F.lit(".py"))
    valid = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    share = (F.col("event_id") % 1001).cast("double") / 1000
    row = reports.history_row(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), file, F.col("event_type"), F.col("event_id") % 50, F.col("user_id") % 7, share, valid)
    return e.select("event_id", row.alias("entry"))
