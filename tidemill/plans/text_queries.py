"""Queries that look for many keys, rewrite launches and regions, and compare texts, each beside its SQL; ``queries`` imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import ccode, code, migrate, patches, patterns, syntax, validators
from tidemill.plans import rules as rl
from tidemill.plans.queries import LINES, VALUES, doc_lines, query, t, word_rules

#: The words of the benchmark items, numbered in order, as a table of keys.
SQL_KEYS = "k AS (SELECT key, row_number() OVER (ORDER BY key) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s.,]+')) AS key FROM benchmark) WHERE length(key) >= {least})"


def item_words(spark, d, least: int):
    words = t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\s.,]+"), F.lit(0))).alias("key")).distinct()
    words = words.filter(F.length("key") >= least).toPandas().sort_values("key")  # a table of rules
    return rl.literal_table(spark, list(enumerate(words.key.tolist(), 1)), "ord long, key string")


@query(f"""WITH {SQL_KEYS.format(least=4)}
SELECT doc_id, ord, strpos(text, key) - 1 AS start FROM documents JOIN k ON contains(text, key)""")
def first_places(spark, d):
    found = patterns.places(t(spark, d, "documents"), item_words(spark, d, 4), ["doc_id"])
    return found.groupBy("doc_id", "ord").agg(F.min("start").alias("start"))


#: Keys that do not begin as they end, so two places of one never overlap and a split by the key finds all of them.
@query(f"""WITH {SQL_KEYS.format(least=5)}, b AS (SELECT * FROM k WHERE len(list_filter(range(1, length(key)), lambda j: left(key, j) = right(key, j))) = 0),
p AS (SELECT doc_id, ord, key, text, string_split(text, key) AS parts FROM documents JOIN b ON contains(text, key))
SELECT doc_id, ord, len(parts) - 1 AS n, length(text) - length(parts[-1]) - length(key) AS last FROM p""")
def all_places(spark, d):
    length = F.length("key")
    keys = item_words(spark, d, 5).filter(~F.exists(F.sequence(F.lit(1), length - 1), lambda j: F.left("key", j) == F.right("key", j)))
    found = patterns.places(t(spark, d, "documents"), keys, ["doc_id"])
    return found.groupBy("doc_id", "ord").agg(F.count("*").alias("n"), F.max("start").alias("last"))


@query(f"""WITH {SQL_KEYS.format(least=4)}, a AS (SELECT string_agg(key, '|' ORDER BY length(key) DESC, key) AS pattern FROM k),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, (SELECT pattern FROM a))) AS key FROM documents)
SELECT doc_id, ord, count(*) AS n FROM m JOIN k USING (key) GROUP BY ALL""")
def leftmost_places(spark, d):
    found = patterns.places(t(spark, d, "documents"), item_words(spark, d, 4), ["doc_id"], leftmost=True)
    return found.groupBy("doc_id", "ord").agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_KEYS.format(least=4)}
SELECT doc_id, min(ord) AS ord FROM documents JOIN k ON contains(text, key) GROUP BY doc_id""")
def first_of_many_rules(spark, d):
    return patterns.first_rule(t(spark, d, "documents"), item_words(spark, d, 4), ["doc_id"])


#: A file for each document: three lines of C made from its first words, then its text.  SQL makes the rewritten file from the same words.
W = "w AS (SELECT doc_id, text, regexp_extract_all(text, '[a-z]+') AS w FROM documents WHERE len(regexp_extract_all(text, '[a-z]+')) >= 6)"
ARGUMENTS = ["w[1] || '<<<' || w[2] || ', ' || w[3] || '>>>(' || w[4] || ', ' || w[5] || ');'", "w[1] || ' <<<' || w[2] || ',' || w[3] || ', 16>>> ();'", "'  ' || w[1] || '<<<' || w[2] || ', ' || w[3] || ', 0, ' || w[4] || '>>>(' || w[5] || '); ' || w[6] || '();'", "w[1] || '<<<' || w[2] || '>>>(' || w[3] || ');'", "w[1] || '<<<dim3(' || w[2] || ', ' || w[3] || '), f<' || w[4] || ', 2>(' || w[5] || ')>>>(g(' || w[1] || ', [' || w[2] || ', 3]), ' || w[6] || ');'"]
CALLS = ["'hipLaunchKernelGGL(' || w[1] || ', ' || w[2] || ', ' || w[3] || ', 0, 0, ' || w[4] || ', ' || w[5] || ');'", "'hipLaunchKernelGGL(' || w[1] || ', ' || w[2] || ', ' || w[3] || ', 16, 0);'", "'  hipLaunchKernelGGL(' || w[1] || ', ' || w[2] || ', ' || w[3] || ', 0, ' || w[4] || ', ' || w[5] || '); ' || w[6] || '();'", "w[1] || '<<<' || w[2] || '>>>(' || w[3] || ');'", "'hipLaunchKernelGGL(' || w[1] || ', dim3(' || w[2] || ', ' || w[3] || '), f<' || w[4] || ', 2>(' || w[5] || '), 0, 0, g(' || w[1] || ', [' || w[2] || ', 3]), ' || w[6] || ');'"]


def _case(values: list[str]) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


HEADER = _case(["'#include <cuda_runtime.h>'", "'#  include \"cub/block/' || w[1] || '.cuh\" // ' || w[2]", "'#include <' || w[2] || '.h>'"])
NEW_HEADER = _case(["'#include <hip/hip_runtime.h>'", "'#include <hipcub/block/' || w[1] || '.hpp> // ' || w[2]", "'#include <' || w[2] || '.h>'"])
BODY = "'cudaStream_t ' || w[3] || '; cudaMalloc(&' || w[4] || '); cudaFoo' || w[5] || '(); cudaMalloc(' || w[1] || '); cudaSurfaceObject_t ' || w[2] || '; cub::' || w[6]"
NEW_BODY = "'hipStream_t ' || w[3] || '; hipMalloc(&' || w[4] || '); cudaFoo' || w[5] || '(); hipMalloc(' || w[1] || '); cudaSurfaceObject_t ' || w[2] || '; hipcub::' || w[6]"


def c_files(spark, d):
    """(doc_id, text), made by the expressions above."""
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    docs = t(spark, d, "documents").select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 6)
    parts = [F.expr(_zero_based(x)) for x in (HEADER, BODY, _case(ARGUMENTS))]
    return docs.select("doc_id", F.concat_ws("\n", *parts, "text").alias("text"))


def _zero_based(sql: str) -> str:
    for i in range(1, 7):
        sql = sql.replace(f"w[{i}]", f"get(w, {i - 1})")
    return sql


def c_steps():
    return ccode.steps(rl.HEADERS, rl.CUB_HEADERS, rl.TYPES, rl.C_SYMBOLS)


@query(f"""WITH {W}
SELECT doc_id, {NEW_HEADER} || chr(10) || {NEW_BODY} || chr(10) || {_case(CALLS)} || chr(10) || text AS new_text,
 CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END + 4 + CASE WHEN doc_id % 5 = 3 THEN 0 ELSE 1 END AS applied, 3 + CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END AS remaining,
 CASE doc_id % 5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 WHEN 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS least, CASE WHEN doc_id % 5 = 3 THEN 0.3 ELSE 0.4 END::DOUBLE AS least_left FROM w""")
def migrated_c_files(spark, d):
    out = ccode.migrated_files(c_files(spark, d), c_steps())
    least = lambda c: F.array_min(F.transform(c, lambda x: x["confidence"]))
    return out.select("doc_id", "new_text", F.size("applied").alias("applied"), F.size("remaining").alias("remaining"), least("applied").alias("least"), least("remaining").alias("least_left"))


@query(f"""WITH {W}, c AS (SELECT doc_id, {HEADER} AS header, {NEW_HEADER} AS new_header, {BODY} AS body, {NEW_BODY} AS new_body, {_case(ARGUMENTS)} AS launch, {_case(CALLS)} AS call FROM w),
r AS (SELECT doc_id, 1 AS line, header AS original, new_header AS replacement, 1 AS sort FROM c WHERE doc_id % 3 < 2
 UNION ALL SELECT doc_id, 3, launch, call, 9 FROM c WHERE doc_id % 5 <> 3)
SELECT doc_id, line, rtrim(original) AS original, rtrim(replacement) AS replacement FROM r""")
def c_file_changes(spark, d):
    out = ccode.listed(ccode.migrated_files(c_files(spark, d), c_steps()), "applied", "doc_id")
    return out.filter(F.startswith("rule", F.lit("Header")) | F.startswith("rule", F.lit("Kernel"))).select("doc_id", "line", "original", "replacement")


QUOTED = "'s = \"\"\"' || chr(10) || '#include <cuda.h>' || chr(10) || {launch} || chr(10) || '\"\"\"' || chr(10) || 'cudaFree(' || w[5] || ')' || chr(10) || 't = ' || repeat(chr(39), 3) || 'cuda' || w[1] || repeat(chr(39), 3) || ' + \"\"\"cudaFree(' || w[2]"
NEW_QUOTED = QUOTED.replace("<cuda.h>", "<hip/hip_runtime.h>")


@query(f"""WITH {W}
SELECT doc_id, text || chr(10) || {NEW_QUOTED.format(launch=_case(CALLS))} AS new_text, length(text) - length(replace(text, chr(10), '')) + 3 AS first_line,
 CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 2 END AS applied FROM w""")
def migrated_blocks(spark, d):
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    docs = t(spark, d, "documents").select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 6)
    planted = F.expr(_zero_based(QUOTED.format(launch=_case(ARGUMENTS))))
    out = ccode.migrated_blocks(docs.select("doc_id", F.concat_ws("\n", "text", planted).alias("text")), c_steps())
    return out.select("doc_id", "new_text", F.get("applied", F.lit(0))["line"].alias("first_line"), F.size("applied").alias("applied"))


TAGGED = "f AS (SELECT doc_id, " + " || chr(10) || ".join([HEADER, BODY, _case(ARGUMENTS), "text"]) + " AS text FROM w), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM f)"


@query(f"""WITH {W}, {TAGGED},
u AS (SELECT 'api_call' AS category, '<<<...>>>' AS symbol FROM l WHERE regexp_matches(s, '<<<.*?>>>')
 UNION ALL SELECT 'api_call', unnest(regexp_extract_all(s, '\\bcub::\\w+')) FROM l
 UNION ALL SELECT 'cuda_c_type', unnest(regexp_extract_all(s, '\\b(?:cudaStream_t|cudaSurfaceObject_t)\\b')) FROM l
 UNION ALL SELECT 'cuda_c_header', unnest(regexp_extract_all(s, '#\\s*include\\s*[<\"][^>\"]*(?:cuda|cub/|thrust/)[^>\"]*[>\"]')) FROM l)
SELECT category, symbol, count(*) AS n FROM u GROUP BY ALL""")
def tagged_usages(spark, d):
    lines = code.explode_lines(c_files(spark, d), lines=F.split("text", "\n"))
    return code.tag_lines(lines).groupBy("category", "symbol").agg(F.count("*").alias("n"))


#: A Python file for each document: imports, a call and a string made from its first words, then its lines as comments; one of ten has no syntax.
PYTHON = " || chr(10) || ".join([
    "'import os, mod_' || w[1]",
    _case(["'import pycuda.driver as ' || 'd_' || w[2]", "'from tensorrt import x_' || w[2]", "'import x_' || w[2] || ', cupy'", "'from apex.amp import x_' || w[2]"]),
    "CASE doc_id % 3 WHEN 0 THEN 'torch.backends.cudnn.enabled = True' WHEN 1 THEN 'x = torch.cuda.nccl.version()' ELSE 'x = ' || chr(39) || 'CUDA_VISIBLE_DEVICES' || chr(39) END",
    "'def f_' || w[3] || '(a):'",
    "'    return cudaMalloc(a) + g_' || w[4] || '(a)'",
    "CASE doc_id % 10 WHEN 9 THEN 'def broken(:' ELSE 'y = 1' END",
    "'# ' || replace(translate(text, chr(13) || chr(12) || chr(11) || chr(28) || chr(29) || chr(30), '      '), chr(10), chr(10) || '# ')",
])
FILES = f"f AS (SELECT doc_id, {PYTHON} AS text FROM w)"


def python_files(spark, d):
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    docs = t(spark, d, "documents").select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 6)
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.expr(_zero_based(PYTHON)).alias("text"))


@query(f"""WITH {W}, u AS (SELECT doc_id, 2 AS line, 'import' AS category, CASE doc_id % 4 WHEN 0 THEN 'pycuda.driver' WHEN 1 THEN 'tensorrt' WHEN 2 THEN 'cupy' ELSE 'apex.amp' END AS symbol FROM w
 UNION ALL SELECT doc_id, 3, CASE doc_id % 3 WHEN 0 THEN 'backend' WHEN 1 THEN 'attribute' ELSE 'env_var' END, CASE doc_id % 3 WHEN 0 THEN 'torch.backends.cudnn.enabled' WHEN 1 THEN 'torch.cuda.nccl.version' ELSE 'CUDA_VISIBLE_DEVICES' END FROM w
 UNION ALL SELECT doc_id, 3, CASE doc_id % 3 WHEN 0 THEN 'backend' ELSE 'attribute' END, CASE doc_id % 3 WHEN 0 THEN 'torch.backends.cudnn' ELSE 'torch.cuda.nccl' END FROM w WHERE doc_id % 3 < 2
 UNION ALL SELECT doc_id, 5, 'api_call', 'cudaMalloc' FROM w)
SELECT doc_id::VARCHAR AS path, line, category, symbol FROM u WHERE doc_id % 10 <> 9""")
def ast_usages(spark, d):
    return syntax.usages(python_files(spark, d)).select("path", "line", "category", "symbol")


@query(f"WITH {W}, {FILES} SELECT doc_id::VARCHAR AS path, md5(text) AS digest FROM f")
def reassembled_chunks(spark, d):
    return syntax.reassembled(syntax.chunks(python_files(spark, d), 400)).select("path", F.md5("text").alias("digest"))


REPLACED = [*rl.VARIABLES, ("cudnn", "miopen")]


@query(f"WITH {W}, {FILES} SELECT doc_id::VARCHAR AS path, 1 AS removed, 1 AS added, '--- a/' || doc_id AS head FROM f WHERE doc_id % 3 <> 1")
def unified_diffs(spark, d):
    files = python_files(spark, d).withColumn("new", code.replace_in_order(F.col("text"), REPLACED))
    out = patches.rendered(patches.hunks(files, ["path"], "text", "new"), ["path"], F.col("path")).withColumn("lines", F.split("diff", "\n"))
    signs = lambda s: F.size(F.filter("lines", lambda x: F.startswith(x, F.lit(s)))) - 1
    return out.select("path", signs("-").alias("removed"), signs("+").alias("added"), F.get("lines", F.lit(0)).alias("head"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
n AS (SELECT doc_id, string_agg(CASE WHEN i % 5 = 0 THEN 'line ' || i || chr(10) ELSE '' END || replace(s, 'the', 'THE'), chr(10) ORDER BY i) AS new FROM l WHERE i % 7 <> 3 GROUP BY doc_id)
SELECT doc_id, md5(new) AS digest, (length(text) - length(replace(text, chr(10), ''))) - (length(new) - length(replace(new, chr(10), ''))) AS fewer FROM documents JOIN n USING (doc_id)""")
def document_patches(spark, d):
    lines = code.explode_lines(t(spark, d, "documents").select("doc_id", "text"), lines=F.split("text", "\n")).filter("line % 7 <> 3")
    line = F.concat(F.when(F.col("line") % 5 == 0, F.concat(F.lit("line "), F.col("line").cast("string"), F.lit("\n"))).otherwise(""), F.replace("line_text", F.lit("the"), F.lit("THE")))
    parts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("s")))).alias("p"))
    new = parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["s"]), "\n").alias("new"))
    texts = t(spark, d, "documents").select("doc_id", "text").join(new, "doc_id")
    found = patches.hunks(texts, ["doc_id"], "text", "new")
    less = found.groupBy("doc_id").agg(F.sum(F.col("old_count") - F.col("new_count")).alias("fewer"))
    out = patches.patched(texts.select("doc_id", "text"), found, ["doc_id"], "text").join(less, "doc_id", "left")
    return out.select("doc_id", F.md5("patched").alias("digest"), F.coalesce("fewer", F.lit(0)).cast("long").alias("fewer"))


BROKEN = _case(["'x.to(' || chr(39) || 'hip' || chr(39) || ')'", "'torch.device(\"rocm:0\")  # torch.device(\"hip\")'", "'hipCtxCreate(); hipMemcpyHtoD()'", "'# hipCtxCreate()'", "'y = 1  # cudnn'"])


@query(f"""WITH {W}, {FILES}, g AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 2 AS last FROM f),
i AS (SELECT doc_id, 3 AS line, 'No cuDNN references' AS validator, 'cuDNN reference found: torch.backends.cudnn.enabled = True' AS message FROM g WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 3, 'Environment variable validation', 'CUDA env var ''CUDA_VISIBLE_DEVICES'' still present' FROM g WHERE doc_id % 3 = 2
 UNION ALL SELECT doc_id, last, 'Device string validation', 'Wrong device string "hip"' FROM g WHERE doc_id % 5 < 2
 UNION ALL SELECT doc_id, last, 'Device string validation', 'Wrong device string "rocm"' FROM g WHERE doc_id % 5 = 1
 UNION ALL SELECT doc_id, last, 'Deprecated ROCm API check', 'hipCtxCreate is deprecated in ROCm 6.0+ — use hipSetDevice instead' FROM g WHERE doc_id % 5 = 2
 UNION ALL SELECT doc_id, last, 'Deprecated ROCm API check', 'hipMemcpyHtoD is driver API — prefer hipMemcpy with hipMemcpyHostToDevice' FROM g WHERE doc_id % 5 = 2)
SELECT doc_id, line, validator, message FROM i""")
def python_line_issues(spark, d):
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    docs = t(spark, d, "documents").select("doc_id", "text", words.alias("w")).filter(F.size("w") >= 6)
    files = docs.select("doc_id", F.concat(F.expr(_zero_based(PYTHON)), F.lit("\n"), F.expr(_zero_based(BROKEN))).alias("text"))
    return validators.line_issues(code.explode_lines(files, lines=F.split("text", "\n"))).select("doc_id", "line", "validator", "message")


@query(f"""WITH {W} SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 9 THEN 0 ELSE 2 END AS line,
 CASE WHEN doc_id % 10 = 9 THEN 'Code has syntax errors — cannot validate imports' WHEN doc_id % 4 = 0 THEN 'CUDA-only import ''pycuda.driver'' still present' ELSE 'CUDA-only import ''from tensorrt'' still present' END AS message
FROM w WHERE doc_id % 10 = 9 OR doc_id % 4 < 2""")
def python_import_issues(spark, d):
    imported, unparsed = syntax.imported(python_files(spark, d))
    return validators.import_issues(imported, unparsed).select("path", "line", "message")


@query(f"""WITH {W}, a AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 5 ELSE 4 END AS sure, CASE doc_id % 5 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 WHEN 3 THEN NULL ELSE 0.5 END AS launch,
 CASE WHEN doc_id % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 0.1 ELSE 0 END AS more FROM w),
b AS (SELECT doc_id, sure, launch, CASE WHEN doc_id % 8 = 0 THEN 1.0 ELSE 0.5 + more END AS type_left, 0.5 + more AS call_left, CASE WHEN doc_id % 5 = 3 THEN CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE 0.3 + more END END AS launch_left FROM a)
SELECT doc_id, sure + CASE WHEN type_left = 1 THEN 2 ELSE 0 END + CASE WHEN launch_left = 1 THEN 1 ELSE 0 END AS high, CASE WHEN launch IS NULL THEN 0 ELSE 1 END + CASE WHEN type_left = 1 THEN 1 ELSE 3 END + CASE WHEN launch_left >= 0.5 AND launch_left < 1 THEN 1 ELSE 0 END AS needs_review,
 CASE WHEN launch_left < 0.5 THEN 1 ELSE 0 END AS low, sure + 4 AS total, round((sure + coalesce(launch, 0) + 2 * type_left + call_left + coalesce(launch_left, 0))::DOUBLE / (sure + 4), 6) AS score FROM b""")
def quality_reports(spark, d):
    files = ccode.migrated_files(c_files(spark, d), c_steps())
    files = files.withColumn("new_text", F.when(F.col("doc_id") % 8 == 0, F.replace("new_text", F.lit("cudaSurfaceObject_t"), F.lit("hipSurfaceObject_t"))).otherwise(F.col("new_text")))
    out = validators.quality_report(files, agent=F.col("doc_id") % 2 == 0, validated=F.col("doc_id") % 4 == 0)
    found = validators.levels_of(F.col("changes"))
    return out.select("doc_id", *[(F.round(c, 6) if n == "score" else c).alias(n) for n, c in found.items()])


@query(f"""WITH l AS ({LINES}), h AS (SELECT doc_id, line, arg_min(key, ord) AS key, arg_min(replacement, ord) AS replacement FROM l JOIN {VALUES} ON contains(line_text, key) WHERE confidence >= 1 GROUP BY ALL),
n AS (SELECT l.doc_id, l.line, coalesce(replace(line_text, key, replacement), line_text) AS s, key || ' → ' || replacement AS rule FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.line = l.line)
SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY line)) AS digest, string_agg(rule, ',' ORDER BY line) AS rules FROM n GROUP BY doc_id""")
def migrated_texts(spark, d):
    lines = doc_lines(spark, d).withColumnRenamed("doc_id", "path")
    rules = word_rules(spark)
    usages = patterns.in_rule_order(lines, rules, ["path", "line"], "line_text").join(F.broadcast(rules.select("ord", F.col("key").alias("symbol"))), "ord")
    usages = usages.select("path", "line", "ord", F.lit("api_call").alias("category"), "symbol", F.lit(False).alias("false_positive"))
    new, applied, _ = migrate.migrated(lines, usages, rules.withColumnRenamed("key", "symbol"))
    text = new.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "line_text"))).alias("p")).select("path", F.md5(F.array_join(F.transform("p", lambda x: x["line_text"]), "\n")).alias("digest"))
    named = applied.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "rule"))).alias("p")).select("path", F.array_join(F.transform("p", lambda x: x["rule"]), ",").alias("rules"))
    return text.join(named, "path", "left").select(F.col("path").alias("doc_id"), "digest", "rules")


SQL_HINTS = "(VALUES " + ", ".join(f"({i}, '{k}', '{c}', {p})" for i, (k, c, p) in enumerate(rl.HINTS)) + ") AS h(ord, trigger, category, priority)"


@query(f"""WITH f AS (SELECT doc_id, text || a.trigger || ' ' || b.trigger AS text FROM documents JOIN {SQL_HINTS.replace("AS h(", "AS a(")} ON a.ord = doc_id % 16 JOIN {SQL_HINTS.replace("AS h(", "AS b(")} ON b.ord = (doc_id * 7 + 3) % 16)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY priority, ord) AS n, trigger, category, priority FROM f JOIN {SQL_HINTS} ON contains(text, trigger)""")
def optimization_hints(spark, d):
    triggers = F.array(*[F.lit(k) for k, _, _ in rl.HINTS])
    at = lambda i: F.get(triggers, i.cast("int"))
    files = t(spark, d, "documents").select("doc_id", F.concat("text", at(F.col("doc_id") % 16), F.lit(" "), at((F.col("doc_id") * 7 + 3) % 16)).alias("text"))
    rules = rl.literal_table(spark, [(i, *r) for i, r in enumerate(rl.HINTS)], "ord int, key string, category string, priority int")
    return patterns.hints(files, rules, ["doc_id"])
