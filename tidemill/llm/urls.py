"""URL filters: explicit host rules, then a tree of path templates judged by labelled purity.

Rules.  A rule is a verdict and ``host/path``; it fits its host and all
subdomains when the url's path starts with the rule's; the longest fitting rule
wins.

Templates.  For each host, the segments of all paths form a tree.  Level by
level a segment stays literal when it is frequent among its siblings and is
generalised to ``*`` when it varies (rare and numeric, or one of very many rare
siblings).  Below a node of fewer than ``MIN_COUNT`` urls every segment is rare, so
the rest of their paths needs no further level.  Literal branches under one node
that lead to the same templates in like proportions, and whose labelled rates do
not differ significantly, are merged into ``*``; a branch without labels is judged
by where it leads alone.  A template is rejected when its smoothed labelled purity
``(bad + prior * m) / (labelled + m)`` reaches a threshold, where m is a constant and
half the unlabelled urls: what no label speaks for smooths it towards the prior.

All counts are sums over (host, template) with partial aggregation, so a host
with a third of all rows is aggregated in every task that reads it, and joins
back to the urls are plain equi-joins that Spark can split when a key is hot.

Defined results: a null url or one without ``://`` has empty host and path and
no rule; its template is the empty one of the empty host, judged like others.
Empty tables give empty results, repeated rows are judged alike and all kept;
columns other than the key and the url are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import discard, lower_ascii, materialize, table

#: A segment of fewer urls, or of a smaller share of its node's, is rare.
MIN_COUNT, MIN_SHARE = 5, 0.02
#: Total variation distance up to which branches lead alike, beside chance, and standard errors up to which their rates do.
FAR, ERRORS = 0.3, 2.0
_ALL = 1 << 30


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/?#`` or end, A-Z lower-cased; path: then up to ``?#`` or end."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (verdict, rule) of the longest fitting rule, else null.  ``rules`` is a parameter list, compared in the row."""
    listed = F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for v, r in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["rule"].alias("rule")))


def templates(paths: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> tuple[DataFrame, int]:
    """(host, path, template, n, labelled, bad) of ``paths`` (host, path, segs, n, labelled, bad), and how many levels were built."""
    out = ["host", "path", "template", "n", "labelled", "bad"]
    numeric = lambda s: s.rlike("[0-9]")
    rows = paths.withColumn("template", F.array().cast("array<string>"))
    done, level = [], 0
    while True:
        done.append(rows.filter(F.size("segs") <= level).select(*out))
        here = rows.filter(F.size("segs") > level).withColumn("_seg", F.element_at("segs", level + 1))
        kids = here.groupBy("host", "template", "_seg").agg(F.sum("n").alias("_n"))
        kids = materialize(kids)
        if kids.isEmpty():
            break
        node = kids.groupBy("host", "template").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kids"))
        rare = F.col("_n") < F.greatest(F.lit(min_count), F.col("_all") * min_share)
        varies = rare & (numeric(F.col("_seg")) | (F.col("_kids") > 1 / min_share))
        kids = kids.join(node, ["host", "template"]).select("host", "template", "_seg", F.when(varies, F.lit("*")).otherwise(F.col("_seg")).alias("_as"), (F.col("_all") < min_count).alias("_few"))
        rows = materialize(here.join(kids, ["host", "template", "_seg"]))
        rest = F.transform(F.slice("segs", level + 1, _ALL), lambda s: F.when(numeric(s), F.lit("*")).otherwise(s))
        done.append(rows.filter("_few").withColumn("template", F.concat("template", rest)).select(*out))
        rows = rows.filter("not _few").withColumn("template", F.array_append("template", F.col("_as"))).drop("_seg", "_as", "_few")
        level += 1
    return reduce(DataFrame.unionByName, done), level


def merged(stats: DataFrame, levels: int, far: float = FAR, z: float = ERRORS) -> DataFrame:
    """Add ``branch`` to ``stats`` (host, template, n, labelled, bad): the template after similar branches are merged.

    At each level, a literal branch is compared with the pool of its siblings:
    the total variation distance of where they lead, less what chance brings
    about, and, if it has labels, a two-sided test of the labelled rate.
    """
    out = stats.withColumn("branch", F.col("template"))
    for d in range(levels):
        out = out.withColumn("_seg", F.when(F.size("branch") > d, F.element_at("branch", d + 1)))
        out = out.withColumn("_head", F.slice("branch", 1, d)).withColumn("_tail", F.slice("branch", d + 2, _ALL))
        literal = out.filter(F.col("_seg").isNotNull() & (F.col("_seg") != "*"))
        key = ["host", "_head"]
        by_tail = literal.groupBy(*key, "_seg", "_tail").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        pool_tail = by_tail.groupBy(*key, "_tail").agg(F.sum("n").alias("_tn"))
        branch = by_tail.groupBy(*key, "_seg").agg(F.sum("n").alias("_bn"), F.sum("labelled").alias("_bl"), F.sum("bad").alias("_bb"))
        pool = branch.groupBy(*key).agg(F.sum("_bn").alias("_pn"), F.sum("_bl").alias("_pl"), F.sum("_bb").alias("_pb"), F.count(F.lit(1)).alias("_kids"))
        pool = pool.filter("_kids > 1").join(pool_tail.groupBy(*key).agg(F.count(F.lit(1)).alias("_tails")), key)
        # distance over the tails a branch has; tails it lacks count with the pool's share
        dist = by_tail.join(pool_tail, [*key, "_tail"]).join(branch, [*key, "_seg"]).join(pool, key)
        dist = dist.groupBy(*key, "_seg").agg(
            F.sum(F.abs(F.col("n") / F.col("_bn") - F.col("_tn") / F.col("_pn"))).alias("_in"),
            F.sum(F.col("_tn") / F.col("_pn")).alias("_covered"),
            *[F.first(c).alias(c) for c in ("_bn", "_bl", "_bb", "_pl", "_pb", "_tails")],
        )
        rate = F.when(F.col("_pl") > 0, F.col("_pb") / F.col("_pl")).otherwise(0.0)
        error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.01)) / F.greatest(F.col("_bl"), F.lit(1)))
        alike = (F.col("_bl") == 0) | (F.abs(F.col("_bb") / F.greatest(F.col("_bl"), F.lit(1)) - rate) <= z * error)
        chance = 0.4 * F.sqrt((F.col("_tails") - 1) / F.col("_bn"))
        similar = dist.filter(((F.col("_in") + 1 - F.col("_covered")) / 2 <= far + chance) & alike).select(*key, "_seg", F.lit(True).alias("_like"))
        out = out.join(similar, [*key, "_seg"], "left")
        out = out.withColumn("branch", F.when(F.col("_like"), F.concat("_head", F.array(F.lit("*")), "_tail")).otherwise(F.col("branch"))).drop("_seg", "_head", "_tail", "_like")
        out = materialize(out)
    return out


def judge_urls(
    pages: DataFrame,
    key: str,
    url: str,
    rules: Sequence[tuple[str, str]],
    reject: float = 0.5,
    prior: float = 0.2,
    strength: float = 5.0,
    unlabelled: float = 0.5,
) -> DataFrame:
    """A verdict for every url: ``key``, host, path, rule, verdict, template, purity.

    Urls that a rule decides are the labelled ones of the template tree.  The
    prior is a parameter: rules name what is known to be bad, so their own rate
    says nothing about urls that no rule names.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    # written once, as the rules are compared in every row
    rows = materialize(rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)))
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("fit").alias("labelled"),
        F.count_if(F.col("fit.verdict") == "block").alias("bad"),
    )
    paths = materialize(paths.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")))
    tree, levels = templates(paths)
    tree = materialize(tree)
    discard(paths)
    stats = tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    stats = merged(materialize(stats), levels)
    pure = stats.groupBy("host", "branch").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    m = strength + unlabelled * (F.col("n") - F.col("labelled"))
    purity = (F.col("bad") + prior * m) / (F.col("labelled") + m)
    pure = stats.select("host", "template", "branch").join(pure.select("host", "branch", purity.alias("purity")), ["host", "branch"])
    known = materialize(tree.select("host", "path", "template").join(pure, ["host", "template"]).select("host", "path", F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"), "purity"))
    # equi-join on the distinct (host, path): no key of it holds more rows than its urls
    out = rows.join(known, ["host", "path"], "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


#: The rules of the query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url of ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", RULES)
