"""A query for each operator over the derived tables, with the same result in SQL for DuckDB."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.functions import scalars as S
from reviewlake.operators import citations, defs, findings, hints, intervals, ranks, score, select, summary, train
from reviewlake.plans import evaluations, jobs
from reviewlake.sources.storage import shared_dir
from reviewlake.plans.views import load, quoted, view, with_views
from reviewlake.sources import files
from reviewlake.streaming import answers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CODE, FOUND, CITED = with_views("code_lines"), with_views("findings"), with_views("evidence")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lexicon_sql(source: str) -> str:
    """hits(repo, path, line, text, ord, class, cwe) over the lines of source."""
    arms = " UNION ALL ".join(f"SELECT repo, path, line, text, {i} AS ord, {quoted(c)} AS class, {quoted(w)} AS cwe FROM {source} WHERE length(text) <= 500 AND regexp_matches(text, {quoted(rx)})" for i, (c, w, rx) in enumerate(hints.LEXICON))
    return f"hits AS ({arms})"


EXT = "CASE WHEN strpos(path, '.') > 0 THEN lower('.' || split_part(path, '.', -1)) END"
IN_CODE = f"{EXT} IN ({', '.join(map(quoted, hints.CODE_EXTENSIONS))})"
FAMILY_SQL = "CASE " + " ".join(f"WHEN {EXT} IN ({', '.join(map(quoted, v))}) THEN '{k}'" for k, v in S.FAMILIES.items()) + " END"


# A: files and lines


@query(r"""SELECT doc_id, unnest(range(1, n + 1))::INT AS line, unnest(CASE WHEN n < len(p) THEN p[:-2] ELSE p END) AS text
    FROM (SELECT *, CASE WHEN len(content) = 0 THEN 0 WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS n
          FROM (SELECT doc_id, text AS content, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents)) WHERE n > 0""")
def a2_file_lines(spark, sf):
    return hints.file_lines(load(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


@query(f"{CODE} SELECT DISTINCT repo, path FROM code_lines WHERE path LIKE 'svc3/%' AND regexp_matches(path, '/f[^/]*[.]py$')")
def a3_select_files(spark, sf):
    return hints.select_files(view(spark, sf, "code_lines").select("repo", "path").distinct(), "svc3", "f*.py")


@query(f"""{CODE}, w AS (SELECT *, length(max(line) OVER (PARTITION BY repo, path)::VARCHAR) AS n FROM code_lines WHERE line BETWEEN 8 AND 12)
    SELECT repo, path, string_agg(lpad(line::VARCHAR, n::INT, ' ') || '| ' || text, chr(10) ORDER BY line) AS body FROM w GROUP BY repo, path""")
def a4_read_numbered(spark, sf):
    return hints.read_numbered(view(spark, sf, "code_lines"), 8, 12)


@query(rf"""{CODE}, t AS (SELECT repo, path, line, replace(text, '    ', chr(9)) || chr(9) || chr(10) AS text FROM code_lines), h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line) AS n FROM t WHERE regexp_matches(text, 'open\(|eval'))
    SELECT repo, path, line, substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 240) AS text FROM h WHERE n <= 60""")
def a5_grep(spark, sf):
    lines = view(spark, sf, "code_lines").withColumn("text", F.concat(F.replace("text", F.lit("    "), F.lit("\t")), F.lit("\t\n")))
    return hints.grep(lines, r"open\(|eval")


def folder(spark, name):
    """A new folder in the shared one, for what a query writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""{CODE} SELECT repo, split_part(path, '/', 1) AS dir, md5(string_agg(text || chr(10), '' ORDER BY path, line)) AS digest FROM code_lines GROUP BY ALL HAVING sum(length(text) + 1) <= {files.LARGEST_FILE}""")
def a1_read_tree(spark, sf):
    """A tree with a file for each folder of each repository, written from the lines and read as a checkout is."""
    root = folder(spark, "tree+c++")
    rows = view(spark, sf, "code_lines").select("repo", F.substring_index("path", "/", 1).alias("dir"), "path", "line", "text")
    rows.repartition("repo", "dir").sortWithinPartitions("repo", "dir", "path", "line").select("repo", "dir", "text").write.partitionBy("repo", "dir").text(root)
    tree = files.read_tree(spark, root, "r").where(F.col("path").endswith(".txt"))
    return tree.select(F.regexp_extract("path", "^repo=([^/]*)/", 1).alias("repo"), F.regexp_extract("path", "/dir=([^/]*)/", 1).alias("dir"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""{with_views('scanner', 'code_lines')}, s AS (SELECT DISTINCT repo, path, start_line, start_line + 1 AS end_line, split_part(check_id, '.', -1) AS title, cwe FROM scanner)
    SELECT s.repo, s.path, s.start_line, s.end_line, s.title, s.cwe, repeat('m', 400) AS summary, coalesce(string_agg(c.text, chr(10) ORDER BY c.line), '') AS quote FROM s LEFT JOIN code_lines c ON c.repo = s.repo AND c.path = s.path AND c.line BETWEEN s.start_line AND s.end_line GROUP BY ALL""")
def a6_read_scanner(spark, sf):
    """Scanner files, a folder for each repository; a class is given as a list or, in every other result, as a plain text."""
    out = folder(spark, "scanner")
    cwe = F.concat(F.col("cwe"), F.lit(": Name"))
    meta = lambda kind: F.to_json(F.struct(kind.alias("cwe")))
    result = F.struct("check_id", "path", F.struct(F.col("start_line").alias("line")).alias("start"), F.struct((F.col("start_line") + 1).alias("line")).alias("end"), F.struct(F.lit("m" * 500).alias("message"), F.from_json(F.when(F.col("start_line") % 2 == 0, meta(F.array(cwe))).otherwise(meta(cwe)), "struct<cwe:string>").alias("metadata")).alias("extra"))
    rows = view(spark, sf, "scanner").distinct().groupBy("repo", F.substring_index("path", "/", 1).alias("dir")).agg(F.to_json(F.struct(F.collect_list(result).alias("results"))).alias("value"))
    rows.repartition("repo", "dir").write.partitionBy("repo", "dir").text(out)
    return files.read_scanner(spark, out, view(spark, sf, "code_lines")).select("repo", "path", "start_line", "end_line", "title", "cwe", "summary", "quote")


@query(f"{with_views('cases')} SELECT name, 'c' || cat AS category, real, (pk % 900)::INT AS cwe FROM cases")
def a7_read_cases(spark, sf):
    """An answer key with comment rows and padded cells."""
    out = folder(spark, "key")
    row = F.concat("name", F.lit(" , c"), F.col("cat").cast("string"), F.lit(", "), F.col("real").cast("string"), F.lit(" ,"), (F.col("pk") % 900).cast("string"))
    view(spark, sf, "cases").select(F.explode(F.array(F.lit("# name, category, real, cwe"), row)).alias("value")).write.text(out)
    return files.read_cases(spark, out)


RUN_FILES_SQL = """r AS (SELECT config, substring(config, 4)::INT AS c, run, substring(run, 4)::INT AS seed, item, max(value) AS value, count(*) AS n FROM runs GROUP BY ALL),
    i AS (SELECT config, c, seed, 'i' || item AS item, value > 50 AS found, value > 80 AS correct, n FROM r)"""


def run_files(spark, sf):
    """Saved results, a file for each configuration: two of seeded weaknesses, two of file pairs, one of real fixes."""
    out = folder(spark, "runs")
    r = view(spark, sf, "runs").groupBy("config", "run", "item").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    c, item = F.substring("config", 4, 9).cast("int"), F.concat(F.lit("i"), F.col("item").cast("string"))
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, item)))
    v = F.col("value")
    runs = r.groupBy("config", F.substring("run", 4, 9).cast("int").alias("seed")).agg(some(v > 50).alias("found"), some(v <= 50).alias("missed"), some((v > 50) & (v <= 80)).alias("still"), some(v > 80).alias("right"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(item.alias("id"), (v > 50).alias("detected"), (v > 50).alias("detected_at_change"), (v <= 10).alias("fixed_flagged"), (v > 80).alias("pair_correct"), F.col("n").alias("other_findings_vulnerable")))).alias("items"))
    stats = F.struct(F.array(F.lit("e")).alias("errors"), F.lit(1.5).alias("seconds"))
    seeded = F.struct("seed", F.struct("found", F.array().cast("array<string>").alias("decoys_flagged"), F.array(F.lit("e")).alias("errors"), (F.col("n") * 1.0).alias("seconds")).alias("vulnerable"), F.struct(F.col("still").alias("patched_still_flagged"), F.array().cast("array<string>").alias("errors"), F.lit(0.5).alias("seconds")).alias("patched"))
    pairs = F.struct("seed", F.col("found").alias("detected"), "missed", F.array("config").alias("secure_flagged"), F.col("right").alias("pair_correct"), stats.alias("stats_vulnerable"), stats.alias("stats_secure"))
    real = F.struct("seed", F.transform("items", lambda i: i.withField("stats_vulnerable", stats).withField("stats_fixed", stats)).alias("items"))
    said = F.when(c < 2, F.to_json(seeded)).when(c < 4, F.to_json(pairs)).otherwise(F.to_json(real))
    target = F.when(c < 2, F.lit(None).cast("string")).when(c < 4, "pairs").otherwise("real")
    head = F.to_json(F.struct(target.alias("target"), F.col("config").alias("model"), F.lit("judge").alias("mode"), F.lit(0.0).alias("temperature")))
    body = F.concat(F.lit('{"summary":'), F.first(head), F.lit(',"runs":['), F.array_join(F.sort_array(F.collect_list(said)), ","), F.lit("]}"))
    runs.groupBy("config").agg(body.alias("value")).repartition("config").write.partitionBy("config").text(out)
    return files.read_runs(spark, out)


@query(f"{with_views('runs')}, {RUN_FILES_SQL} SELECT CASE WHEN c < 2 THEN 'seeded' WHEN c < 4 THEN 'pairs' ELSE 'real' END AS target, config AS model, 'judge' AS mode, '' AS prompt, 'none' AS context, seed, count(*) FILTER (WHERE found OR c >= 4) AS n FROM i GROUP BY config, c, seed")
def a8_read_runs(spark, sf):
    n = F.coalesce(F.size("run.vulnerable.found"), F.size("run.detected"), F.size("run.items")).cast("long")
    return run_files(spark, sf).select("target", "model", "mode", "prompt", "context", "seed", n.alias("n"))


@query(f"""{FOUND}, s AS (SELECT repo, severity <> 'low' AS shown FROM findings) SELECT repo, count(*) AS findings, count(*) FILTER (WHERE shown) * 11 + 7 AS report_lines, count(*) FILTER (WHERE NOT shown) AS rejected, 1::BIGINT AS stats FROM s GROUP BY repo""")
def a9_write_findings(spark, sf):
    """Findings, statistics and reports, written and read back: numbers of rows and lines."""
    out = folder(spark, "report")
    f = view(spark, sf, "findings")
    e = F.array(F.struct("path", "start_line", F.col("start_line").alias("end_line"), F.lit("q").alias("quote"), F.lit("sink").alias("role")))
    finding = F.struct(F.col("fid").alias("id"), "title", F.when(F.col("severity") == "low", "rejected").otherwise("suspected").alias("tier"), "severity", "cwe", "summary", F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("remediation"), e.alias("evidence"))
    rows = f.select("repo", F.col("line").alias("rank"), finding.alias("finding"))
    files.write_findings(f, f"{out}/findings")
    files.write_report(rows, f"{out}/report", "m")
    files.write_stats(f.groupBy("repo").agg(F.count("*").alias("leads")), f"{out}/stats")
    report = spark.read.text(f"{out}/report")
    rejected = F.max(F.regexp_extract("value", r"was found: (\d+)[.]", 1).try_cast("int")).cast("long")
    lines = report.groupBy("repo").agg(F.count("*").alias("report_lines"), rejected.alias("rejected"))
    return spark.read.json(f"{out}/findings").groupBy("repo").agg(F.count("*").alias("findings")).join(lines, "repo").join(spark.read.json(f"{out}/stats").groupBy("repo").agg(F.count("*").alias("stats")), "repo")


@query("""SELECT CASE WHEN doc_id % 10 = 0 THEN 'valid' ELSE 'train' END AS side, '{"messages":[{"role":"system","content":"Review."},{"role":"user","content":' || to_json(source) || '},{"role":"assistant","content":' || to_json(lang) || '}]}' AS value FROM documents""")
def a10_write_chat_jsonl(spark, sf):
    out = folder(spark, "chat")
    files.write_chat_jsonl(load(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 0, "valid").otherwise("train").alias("side"), S.to_chat_record(F.lit("Review."), F.col("source"), F.col("lang")).alias("record")), out)
    return spark.read.text(out).select("side", "value")


@query(f"{with_views('changes')} SELECT replace(replace(item, ':', '-'), '/', '-') AS item, path, start_line, end_line FROM changes")
def a11_read_changes(spark, sf):
    """A file of changed ranges in a folder for each item."""
    out = folder(spark, "changes")
    per = view(spark, sf, "changes").groupBy("item", "path").agg(F.sort_array(F.collect_list(F.array("start_line", "end_line"))).alias("spans"))
    one = per.groupBy(F.translate("item", ":/", "--").alias("item")).agg(F.to_json(F.struct(F.lit("f").alias("fix"), F.lit("p").alias("parent"), F.map_from_entries(F.collect_list(F.struct("path", "spans"))).alias("ranges"))).alias("value"))
    files.write_changes(one, out)
    return files.read_changes(spark, out).withColumn("item", F.regexp_replace("item", "^item=", ""))


# B: filters and extraction


@query(f"{CODE} SELECT DISTINCT repo, path FROM code_lines WHERE {IN_CODE}")
def b1_relevant_files(spark, sf):
    return hints.relevant_files(view(spark, sf, "code_lines").select("repo", "path").distinct())


@query(f"{CODE}, {lexicon_sql('code_lines')} SELECT repo, path, line, ord, class, cwe FROM hits")
def b2_match_lexicon(spark, sf):
    return hints.match_lexicon(view(spark, sf, "code_lines")).select("repo", "path", "line", "ord", "class", "cwe")


@query(f"""WITH d AS (SELECT 'r' AS repo, doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS text, 1 AS line FROM documents), {lexicon_sql('d')}
    SELECT path::BIGINT AS doc_id, class, count(*) AS n FROM hits GROUP BY ALL""")
def b2_match_lexicon_prose(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return hints.match_lexicon(d).groupBy("doc_id", "class").agg(F.count("*").alias("n"))


@query(f"{CODE}, {lexicon_sql('code_lines')} SELECT repo, path, class AS title, nullif(cwe, '') AS cwe, 'pattern match for ' || class AS summary, line AS start_line, line AS end_line, text AS quote, 'sink' AS role, ord FROM hits WHERE class <> 'request handler'")
def b3_pattern_findings(spark, sf):
    return hints.pattern_findings(view(spark, sf, "code_lines"))


@query(rf"{CODE} SELECT repo, path, line, CASE WHEN regexp_matches(text, '^\s*(#|//)') AND NOT starts_with(text, '#!') THEN '' ELSE text END AS text FROM code_lines")
def b4_blank_comments(spark, sf):
    return hints.blank_comments(view(spark, sf, "code_lines")).select("repo", "path", "line", "text")


WINDOWS = f"""{CODE}, n AS (SELECT repo, path, max(line) AS n FROM code_lines GROUP BY repo, path),
    w AS (SELECT *, unnest(range(CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 16.0)::INT + 1 END))::INT AS i FROM n)"""


@query(f"{WINDOWS} SELECT repo, path, n AS n_lines, i + 1 AS part, i * 16 + 1 AS first, least(i * 16 + 20, n) AS last FROM w")
def b5_review_windows(spark, sf):
    return hints.review_windows(view(spark, sf, "code_lines"), 20, 4)


DEFS_SQL = "defs AS (" + " UNION ALL ".join(f"SELECT repo, path, line, '{k}' AS family, regexp_extract(text, {quoted(p)}, 1) AS name FROM code_lines WHERE {FAMILY_SQL} = '{k}' AND regexp_matches(text, {quoted(p)})" for k, ps in defs.DEFINITIONS.items() for p in ps) + ")"


@query(f"{CODE}, {DEFS_SQL} SELECT * FROM defs")
def b6_extract_definitions(spark, sf):
    return defs.extract_definitions(view(spark, sf, "code_lines"))


IMPORTS_SQL = r"""imported AS (SELECT repo, path, name, row_number() OVER (PARTITION BY repo, path ORDER BY first) AS ord FROM (
        SELECT repo, path, trim(split_part(regexp_extract(text, '^\s*from\s+[\w.]+\s+import\s+(.+)$', 1), ' as ', 1), ' ()') AS name, min(line) AS first
        FROM code_lines WHERE regexp_matches(text, '^\s*from\s+[\w.]+\s+import\s+(.+)$') GROUP BY ALL) x WHERE regexp_matches(name, '^[A-Za-z_]\w*$'))"""


@query(f"{CODE}, {IMPORTS_SQL} SELECT repo, path, name, ord::INT AS ord FROM imported")
def b7_imported_names(spark, sf):
    return defs.imported_names(view(spark, sf, "code_lines"))


CALLS_SQL = rf"""calls AS (SELECT repo, path, line, unnest(c) AS full_name, unnest(range(len(c))) AS pos FROM (SELECT *, regexp_extract_all(replace(text, '(', '( '), '(^|[^\w$.])([A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*)\s*\(', 2) AS c FROM code_lines) x),
    called AS (SELECT repo, path, split_part(full_name, '.', -1) AS name, min(line * 1000 + pos) AS first FROM calls WHERE split_part(full_name, '.', -1) NOT IN ({', '.join(map(quoted, defs.NOT_CALLS))}) GROUP BY ALL)"""


@query(f"{CODE}, {CALLS_SQL} SELECT repo, path, name, first // 1000 AS line FROM called")
def b8_called_names(spark, sf):
    return defs.called_names(view(spark, sf, "code_lines")).select("repo", "path", "name", F.col("first.line").alias("line"))


JS_ROUTES = r"regexp_matches(text, '\b\w+\.(get|post|put|patch|delete|all)\(\s*''([^'']+)''\s*,(.*)$') OR regexp_matches(text, '\b\w+\.(get|post|put|patch|delete|all)\(\s*\"([^\"]+)\"\s*,(.*)$')"
GUARDS_SQL = f"""guards AS (SELECT repo, path, line, pos, full_name || '()' AS guard FROM calls WHERE regexp_matches(split_part(full_name, '.', -1), {quoted(defs.GUARD_WORD)})
    UNION ALL SELECT repo, path, line, NULL, '{defs.COMPARES_IDENTITY}' FROM code_lines WHERE regexp_matches(text, {quoted(defs.IDENTITY)}) AND regexp_matches(text, {quoted(defs.COMPARISON)}))"""
JS_SQL = rf"""{GUARDS_SQL}, js AS (SELECT *, {JS_ROUTES} AS route FROM code_lines WHERE {FAMILY_SQL} = 'js'),
    body AS (SELECT *, max(CASE WHEN route THEN line END) OVER (PARTITION BY repo, path ORDER BY line) AS start, max(CASE WHEN route THEN line END) OVER (PARTITION BY repo, path) AS final FROM js),
    inside AS (SELECT b.repo, b.path, b.start, g.guard FROM body b JOIN guards g USING (repo, path, line) WHERE NOT b.route AND b.start IS NOT NULL AND NOT (b.start = b.final AND b.line >= b.start + 80)),
    own AS (SELECT repo, path, line AS start, unnest(regexp_extract_all(split_part(split_part(regexp_extract(text, '\(\s*[''"][^''"]+[''"]\s*,(.*)$', 1), '=>', 1), 'function', 1), '([A-Za-z_$][\w$.]*)\s*,', 1)) AS guard FROM body WHERE route),
    js_guards AS (SELECT DISTINCT repo, path, start, guard FROM (SELECT * FROM inside UNION ALL SELECT * FROM own) x WHERE guard NOT IN ('req', 'res', 'next', 'async')),
    js_entries AS (SELECT b.repo, b.path, b.line, upper(regexp_extract(text, '\b\w+\.(get|post|put|patch|delete|all)\(', 1)) || ' ' || regexp_extract(text, '\(\s*[''"]([^''"]+)[''"]', 1) AS route, coalesce(g, '') AS guards
        FROM body b LEFT JOIN (SELECT repo, path, start, string_agg(guard, ',' ORDER BY guard) AS g FROM js_guards GROUP BY ALL) x ON b.repo = x.repo AND b.path = x.path AND b.line = x.start WHERE b.route)"""


def sorted_guards(df):
    return df.withColumn("guards", F.array_join(F.array_sort("guards"), ","))


@query(f"{CODE}, {CALLS_SQL}, {JS_SQL} SELECT * FROM js_entries")
def b9_js_entries(spark, sf):
    return sorted_guards(defs.js_entries(view(spark, sf, "code_lines"))).drop("name")


@query(rf"""{with_views("code_lines")}, php AS (SELECT repo, path, line, replace(text, 'request.args', '$_GET') AS text FROM code_lines WHERE {FAMILY_SQL} = 'php')
    SELECT repo, path, min(line) AS line, 'reads request input' AS route FROM php WHERE regexp_matches(text, '\$_(GET|POST|REQUEST|COOKIE|FILES)\b') GROUP BY ALL""")
def b9_php_entries(spark, sf):
    lines = view(spark, sf, "code_lines").withColumn("text", F.replace("text", F.lit("request.args"), F.lit("$_GET")))
    return defs.php_entries(lines).select("repo", "path", "line", "route")


PYTHON_SQL = rf"""{GUARDS_SQL}, py AS (SELECT repo, path, line, text, CASE WHEN regexp_matches(text, '^\s*@([\w.]+)') THEN 'd' WHEN regexp_matches(text, '^(\s*)(?:async\s+)?def\s+(\w+)\s*\(') THEN 'f' WHEN trim(text) = '' OR starts_with(trim(text), '#') THEN 'b' ELSE 'c' END AS kind, length(regexp_extract(text, '^(\s*)', 1)) AS indent FROM code_lines WHERE {FAMILY_SQL} = 'python'),
    since AS (SELECT *, coalesce(max(CASE WHEN kind IN ('f', 'c') THEN line END) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM py),
    routes AS (SELECT repo, path, s, arg_min(trim(upper(regexp_extract(text, {quoted(defs.PY_ROUTE)}, 1)) || ' ' || regexp_extract(text, {quoted(defs.PY_ROUTE)}, 2)), line) AS route FROM since WHERE kind = 'd' AND regexp_matches(text, {quoted(defs.PY_ROUTE)}) GROUP BY ALL),
    fs AS (SELECT c.repo, c.path, c.line, c.s, c.indent, r.route, regexp_extract(c.text, '^(\s*)(?:async\s+)?def\s+(\w+)\s*\(', 2) AS name FROM since c JOIN routes r USING (repo, path, s) WHERE c.kind = 'f'),
    ends AS (SELECT f.*, (SELECT min(p.line) FROM py p WHERE p.repo = f.repo AND p.path = f.path AND p.line > f.line AND p.kind <> 'b' AND p.indent <= f.indent) AS stop FROM fs f),
    used AS (SELECT e.repo, e.path, e.line, g.guard FROM ends e JOIN guards g ON g.repo = e.repo AND g.path = e.path AND g.line > e.line AND g.line < coalesce(e.stop, 1000000)
        UNION SELECT f.repo, f.path, f.line, regexp_extract(d.text, '^\s*@([\w.]+)', 1) FROM fs f JOIN since d ON d.repo = f.repo AND d.path = f.path AND d.s = f.s AND d.kind = 'd' WHERE NOT regexp_matches(d.text, {quoted(defs.PY_ROUTE)}) AND regexp_matches(regexp_extract(d.text, '^\s*@([\w.]+)', 1), {quoted(defs.GUARD_WORD)}))"""


@query(f"{CODE}, {CALLS_SQL}, {PYTHON_SQL} SELECT e.repo, e.path, e.line, e.name, e.route, coalesce(string_agg(DISTINCT u.guard, ',' ORDER BY u.guard), '') AS guards FROM ends e LEFT JOIN used u USING (repo, path, line) GROUP BY e.repo, e.path, e.line, e.name, e.route")
def b9_python_entries(spark, sf):
    return sorted_guards(defs.python_entries(view(spark, sf, "code_lines")))


@query(f"{CODE}, {CALLS_SQL}, {GUARDS_SQL} SELECT repo, path, line, guard, count(*) AS n FROM guards GROUP BY ALL")
def b10_guard_calls(spark, sf):
    return defs.guard_calls(view(spark, sf, "code_lines")).groupBy("repo", "path", "line", "guard").agg(F.count("*").alias("n"))


CASE_SOURCE = "concat('''''''\nOWASP ', name, '\n''''''\n@app.route(\"/benchmark/sqli-00/', name, '\")\nrender(\"web/xss-01/a.html\")\nprint(\"OWASP: executing cmdi\")\n')"


@query(rf"""{with_views("cases")} SELECT name, replace(regexp_replace(regexp_replace(src, '\A\s*''''''(?s:.*?)''''''\s*\n', ''), '(/benchmark/|web/)[a-z]+-\d+/', '\1cases/', 'g'), 'executing cmdi', 'executing command') AS src
    FROM (SELECT name, {CASE_SOURCE} AS src FROM cases) x""")
def b11_neutralise(spark, sf):
    cases = view(spark, sf, "cases").withColumn("src", F.concat(F.lit("'''\nOWASP "), "name", F.lit("\n'''\n@app.route(\"/benchmark/sqli-00/"), "name", F.lit("\")\nrender(\"web/xss-01/a.html\")\nprint(\"OWASP: executing cmdi\")\n")))
    return cases.select("name", train.neutralise(F.col("src")).alias("src"))


@query(rf"""{with_views("code_lines", "truth")}, files AS (SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS content FROM code_lines GROUP BY ALL),
    weak AS (SELECT DISTINCT repo, path FROM truth WHERE NOT is_decoy)
    SELECT f.repo, f.path, CASE WHEN w.path IS NULL THEN content WHEN {EXT.replace('path', 'f.path')} IN ('.py', '.sh', '.yml', '.yaml', '.tf') THEN '# note' || chr(10) || content ELSE '// note' || chr(10) || content END AS content
    FROM files f LEFT JOIN weak w ON f.repo = w.repo AND f.path = w.path""")
def b12_plant_note(spark, sf):
    return train.plant_note(train.file_texts(view(spark, sf, "code_lines")), view(spark, sf, "truth"), "note")


EITHER = f"({', '.join(map(str, select.INJECTION + select.MISSING_CHECK))})"
INJECTED = f"({', '.join(map(str, select.INJECTION))})"


@query(f"""{with_views("advisories")} SELECT id, lower(repo) AS repo, cwe FROM advisories WHERE published BETWEEN '1993-01-01' AND '1997-12-31' AND NOT withdrawn AND ecosystem IN ('PIP', 'NPM')
    AND (cwe IN {EITHER} OR cwe2 IN {EITHER}) AND url2 = 'https://example.org/note'""")
def b14_filter_advisories(spark, sf):
    return kept_advisories(spark, sf).select("id", F.lower("repo").alias("repo"), "cwe")


def advisory_rows(spark, sf):
    return view(spark, sf, "advisories").withColumns({"references": F.array("url1", "url2"), "ecosystems": F.array("ecosystem"), "cwes": F.array("cwe2", "cwe")})


def kept_advisories(spark, sf):
    return select.filter_advisories(advisory_rows(spark, sf), "1993-01-01", "1997-12-31")


SOURCE_SQL = r"regexp_matches(filename, '(?i)\.(py|js|mjs|cjs|ts|tsx|jsx|vue|svelte|html?|jinja2?|j2|ejs|hbs)$') AND NOT regexp_matches(filename, '(?i)(^|/)tests?(/|$)|(^|/)test_[^/]*$')"


@query(f"""{with_views("commit_files")} SELECT sha, count(*) FILTER (WHERE {SOURCE_SQL}) AS n_source, count(*) FILTER (WHERE {SOURCE_SQL} AND status = 'modified') AS n_modified, coalesce(sum(changes) FILTER (WHERE {SOURCE_SQL}), 0)::BIGINT AS changes, string_agg(filename, ',' ORDER BY filename) FILTER (WHERE {SOURCE_SQL} AND status = 'modified') AS files
    FROM commit_files GROUP BY sha HAVING bool_and(one_parent) AND n_source BETWEEN 1 AND 3 AND n_modified > 0 AND changes <= 80""")
def b15_usable_commits(spark, sf):
    return select.usable_commits(view(spark, sf, "commit_files")).withColumn("files", F.array_join("files", ","))


@query(f"{FOUND} SELECT fid, regexp_extract(summary || ' ' || reasoning, {quoted(S.HEDGE)}, 0) AS hedge, regexp_matches(summary || ' ' || reasoning, {quoted(S.HEDGE)}) AS hedged FROM findings")
def b16_hedged(spark, sf):
    return findings.wording(view(spark, sf, "findings")).select("fid", "hedge", "hedged")


BOTH_SQL = "flow AS (SELECT repo, fid, bool_or(role = 'config') OR (bool_or(role = 'sink') AND bool_or(role IN ('source', 'missing_check'))) AS both_ends FROM evidence GROUP BY ALL)"


@query(f"{CITED}, {BOTH_SQL} SELECT * FROM flow")
def b17_cites_both_ends(spark, sf):
    return findings.dataflow(view(spark, sf, "evidence"))


SITES_SQL = rf"""sites AS (SELECT repo, path, line, CASE WHEN regexp_matches(text, {quoted(defs.ANY_DEFINITION[0])}) THEN regexp_extract(text, {quoted(defs.ANY_DEFINITION[0])}, 1) ELSE regexp_extract(text, {quoted(defs.ANY_DEFINITION[1])}, 1) END AS name
    FROM code_lines WHERE regexp_matches(text, {quoted(defs.ANY_DEFINITION[0])}) OR regexp_matches(text, {quoted(defs.ANY_DEFINITION[1])})),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY path, line) AS site FROM sites) x WHERE site <= 3)"""


@query(f"{CODE}, {SITES_SQL} SELECT repo, path, line, name FROM sites")
def b18_definition_sites(spark, sf):
    return defs.definition_sites(view(spark, sf, "code_lines"))


# C: joins

HELPERS_SQL = f"""{CODE}, {IMPORTS_SQL}, {SITES_SQL}, helpers AS (SELECT repo, path, name, row_number() OVER (PARTITION BY repo, path ORDER BY ord) AS ord, "where", "at" FROM (
        SELECT i.repo, i.path, i.name, i.ord, f.path AS "where", f.line AS "at", row_number() OVER (PARTITION BY i.repo, i.path, i.name ORDER BY f.site) AS n FROM imported i JOIN firsts f ON i.repo = f.repo AND i.name = f.name AND f.path <> i.path) x WHERE n = 1)"""


@query(f"""{HELPERS_SQL}, size AS (SELECT repo, path, max(line) AS n FROM code_lines GROUP BY ALL)
    SELECT h.repo, h.path, h.name, h.ord::INT AS ord, h."where", h."at", string_agg(lpad(c.line::VARCHAR, length(least(h."at" + 23, s.n)::VARCHAR)::INT, ' ') || '| ' || c.text, chr(10) ORDER BY c.line) AS body
    FROM helpers h JOIN code_lines c ON c.repo = h.repo AND c.path = h."where" AND c.line BETWEEN h."at" AND h."at" + 23 JOIN size s ON s.repo = h.repo AND s.path = h."where" WHERE h.ord <= 6 GROUP BY h.repo, h.path, h.name, h.ord, h."where", h."at" """)
def c1_helper_definitions(spark, sf):
    lines = view(spark, sf, "code_lines")
    return defs.with_bodies(defs.helper_definitions(lines), lines)


#: The code with names told apart further, so that some are defined once in a repository.
NAMED = f"{CODE.replace('code_lines AS', 'plain_lines AS')}, code_lines AS (SELECT * REPLACE (replace(text, 'clean_', 'clean_' || (ok % 50) || '_') AS text) FROM plain_lines)"


@query(f"""{NAMED}, {CALLS_SQL}, {IMPORTS_SQL}, {DEFS_SQL}, once AS (SELECT repo, family, name, min(path) AS "where", min(line) AS "at" FROM defs GROUP BY ALL HAVING count(*) = 1),
    met AS (SELECT c.repo, c.path, c.name, c.first, o."where", o."at" FROM (SELECT *, {FAMILY_SQL} AS family FROM called) c JOIN once o ON c.repo = o.repo AND c.family = o.family AND c.name = o.name AND o."where" <> c.path ANTI JOIN imported i ON i.repo = c.repo AND i.path = c.path AND i.name = c.name)
    SELECT repo, path, name, ord::INT AS ord, "where", "at" FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY NOT regexp_matches(name, {quoted(defs.GUARD_WORD)}), first) AS ord FROM met) x WHERE ord <= 6""")
def c2_called_definitions(spark, sf):
    return defs.called_definitions(called_code(spark, sf))


def called_code(spark, sf):
    return view(spark, sf, "code_lines").withColumn("text", F.replace("text", F.lit("clean_"), F.concat(F.lit("clean_"), (F.col("ok") % 50).cast("string"), F.lit("_"))))


CHECKED_SQL = rf"""dense AS (SELECT repo, path, line, norm, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS pos FROM (SELECT repo, path, line, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM code_lines) x WHERE norm <> ''),
    wanted AS (SELECT repo, fid, ev_ord, path, trim(regexp_replace(regexp_replace(quote, '^\s*\d+\|\s?', ''), '\s+', ' ', 'g')) AS w FROM evidence),
    places AS (SELECT w.repo, w.fid, w.ev_ord, min(d.line) AS s FROM wanted w JOIN dense d ON w.repo = d.repo AND w.path = d.path AND contains(d.norm, w.w) WHERE w.w <> '' GROUP BY ALL),
    checked AS (SELECT e.repo, e.fid, e.ev_ord, e.path, e.role, coalesce(s, e.start_line) AS start_line, coalesce(s, e.end_line) AS end_line, s IS NOT NULL AS passed, CASE WHEN s IS NULL THEN 'quote not found in ' || e.path WHEN s = e.start_line AND s = e.end_line THEN 'exact' ELSE 'lines corrected from ' || e.start_line || '-' || e.end_line END AS detail FROM evidence e LEFT JOIN places p ON e.repo = p.repo AND e.fid = p.fid AND e.ev_ord = p.ev_ord)"""


@query(f"{with_views('code_lines', 'evidence')}, {CHECKED_SQL} SELECT * FROM checked")
def c3_check_citations(spark, sf):
    return checked(spark, sf).drop("quote")


def checked(spark, sf):
    return citations.check_citations(view(spark, sf, "evidence"), view(spark, sf, "code_lines"))


@query(r"""WITH lines AS (SELECT doc_id, unnest(p) AS text, unnest(range(1, len(p) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) x),
    dense AS (SELECT doc_id, line, norm, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM (SELECT doc_id, line, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM lines) x WHERE norm <> ''),
    q AS (SELECT item_id, unnest(w) AS w, unnest(range(len(w))) AS k, len(w) AS n FROM (SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS w FROM benchmark) x),
    met AS (SELECT item_id, doc_id, pos - k AS p, n FROM q JOIN dense ON contains(norm, w) GROUP BY item_id, doc_id, pos - k, n HAVING count(*) = n),
    best AS (SELECT item_id, doc_id, min(p) AS p, n FROM met GROUP BY ALL)
    SELECT item_id, b.doc_id, a.line AS start_line, z.line AS end_line FROM best b JOIN dense a ON a.doc_id = b.doc_id AND a.pos = p JOIN dense z ON z.doc_id = b.doc_id AND z.pos = p + n - 1""")
def c3_quotes_in_prose(spark, sf):
    """Benchmark passages located in the documents: an automaton of all their lines, one pass over the documents."""
    docs = load(spark, sf, "documents").select(F.lit("d").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = citations.find_passages(docs, load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return found.select(F.col("id").cast("long").alias("item_id"), F.col("path").cast("long").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


AGREED_SQL = "agreed AS (SELECT DISTINCT e.repo, e.fid FROM evidence e JOIN scanner s ON e.repo = s.repo AND e.path = s.path AND e.start_line - 3 <= s.end_line AND e.end_line + 3 >= s.start_line)"


@query(f"{with_views('evidence', 'scanner')}, {AGREED_SQL} SELECT * FROM agreed")
def c4_scanner_agreement(spark, sf):
    return intervals.scanner_agreement(view(spark, sf, "evidence"), view(spark, sf, "scanner"))


REGIONS_SQL = """regions AS (SELECT t.id, t.repo, t.path, t.cwe, t.cwe2, t.is_decoy, greatest(1, min(c.line) - t.radius) AS start_line, min(c.line) + t.radius AS end_line
    FROM truth t JOIN code_lines c ON t.repo = c.repo AND t.path = c.path AND contains(c.text, t.anchor) GROUP BY t.id, t.repo, t.path, t.cwe, t.cwe2, t.is_decoy, t.radius HAVING count(*) = 1)"""


@query(f"{with_views('code_lines', 'truth')}, {REGIONS_SQL} SELECT id, repo, path, start_line, end_line FROM regions")
def c5_anchor_regions(spark, sf):
    return intervals.anchor_regions(truth(spark, sf), view(spark, sf, "code_lines")).select("id", "repo", "path", "start_line", "end_line")


def truth(spark, sf):
    """Items with their list of classes, fix and patched anchor."""
    return view(spark, sf, "truth").withColumns({"cwes": F.array("cwe", "cwe2"), "old": F.col("anchor"), "patched_anchor": F.col("new")})


def regions(spark, sf):
    return intervals.truth_regions(truth(spark, sf), view(spark, sf, "code_lines"))


MATCH_SQL = f"""{REGIONS_SQL}, met AS (SELECT DISTINCT f.repo, f.fid, r.id, r.is_decoy, coalesce(f.cwe IN (r.cwe, r.cwe2), false) AS same FROM evidence e JOIN regions r ON e.repo = r.repo AND e.path = r.path AND e.start_line <= r.end_line AND e.end_line >= r.start_line JOIN findings f ON f.repo = e.repo AND f.fid = e.fid WHERE f.sk % 6 <> 0),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, fid ORDER BY same DESC, is_decoy, id) AS n FROM met) x WHERE n = 1),
    matches AS (SELECT f.repo, f.fid, f.cwe, b.id AS item, CASE WHEN b.is_decoy THEN 2 WHEN NOT b.is_decoy THEN 0 END AS kind FROM findings f LEFT JOIN best b ON f.repo = b.repo AND f.fid = b.fid WHERE f.sk % 6 <> 0)"""


@query(f"{with_views('code_lines', 'truth', 'evidence')}, {MATCH_SQL} SELECT * FROM matches")
def c6_match_truth(spark, sf):
    return matches(spark, sf)


@query(f"{with_views('code_lines', 'truth', 'evidence')}, {MATCH_SQL} SELECT repo, fid, id AS item, same FROM best")
def e3_best_match(spark, sf):
    met = intervals.touching(view(spark, sf, "evidence"), regions(spark, sf), ["repo", "path"]).join(judged_findings(spark, sf).where("tier <> 'rejected'").select("repo", "fid", "cwe"), ["repo", "fid"])
    rows = met.select("repo", "fid", F.coalesce(F.array_contains("s_cwes", F.col("cwe")), F.lit(False)).alias("same_cwe"), "s_kind", "s_id")
    return intervals.best_match(rows).select("repo", "fid", F.col("s_id").alias("item"), F.col("same_cwe").alias("same"))


def judged_findings(spark, sf):
    """Findings of which a sixth were rejected."""
    return view(spark, sf, "findings").withColumn("tier", F.when(F.col("sk") % 6 == 0, "rejected").otherwise("suspected"))


def matches(spark, sf):
    return intervals.match_truth(view(spark, sf, "evidence"), judged_findings(spark, sf), regions(spark, sf))


@query(f"{with_views('evidence', 'changes')} SELECT DISTINCT c.item, e.repo, e.fid FROM evidence e JOIN changes c ON e.repo = c.repo AND e.path = c.path AND e.start_line - 3 <= c.end_line AND e.end_line + 3 >= c.start_line")
def c7_hits_at_change(spark, sf):
    return intervals.hits_at_change(view(spark, sf, "evidence"), view(spark, sf, "changes"))


MODULES_SQL = "flags AS (SELECT f.repo, f.fid, split_part(f.path, '/', 1) AS module, coalesce(f.cwe IN (m.cwe1, m.cwe2), false) AS flagged FROM findings f JOIN modules m ON m.id = split_part(f.path, '/', 1))"


@query(f"{with_views('findings', 'modules')}, {MODULES_SQL} SELECT * FROM flags")
def c8_flag_modules(spark, sf):
    return module_flags(spark, sf)


def module_flags(spark, sf):
    modules = view(spark, sf, "modules").select("id", F.array("cwe1", "cwe2").alias("cwes"))
    return score.flag_modules(view(spark, sf, "evidence"), view(spark, sf, "findings"), modules)


def citations_of(spark, sf, where="true"):
    """A row for each citation, with the class of its finding and whether it was rejected."""
    f = view(spark, sf, "findings").where(where).select("repo", "fid", "cwe", (F.col("severity") == "low").alias("rejected"), "sk")
    return view(spark, sf, "evidence").select("repo", "fid", "path", "start_line", "end_line").join(f, ["repo", "fid"])


def file_cases(spark, sf):
    """A labelled case for each file."""
    files = view(spark, sf, "code_lines").select("repo", "path").distinct().withColumn("name", F.regexp_extract("path", r"/f(\d+)\.", 1))
    n = F.col("name").cast("int")
    classes = F.array(F.lit("CWE-89"), F.lit("CWE-564"), F.concat(F.lit("CWE-"), (20 + n % 80).cast("string")))
    return files.withColumns({"classes": classes, "category": F.substring_index("path", "/", 1), "real": n % 3 > 0, "error": F.when(n % 11 == 0, "no answer")})


CASES_SQL = r"""c AS (SELECT repo, path, name, n, split_part(path, '/', 1) AS category, n % 3 > 0 AS real, n % 11 = 0 AS failed FROM (SELECT DISTINCT repo, path, regexp_extract(path, '/f(\d+)\.', 1) AS name, regexp_extract(path, '/f(\d+)\.', 1)::INT AS n FROM code_lines) x),
    flagged AS (SELECT c.repo, c.name, c.category, c.real, c.failed, coalesce(bool_or(f.cwe IN ('CWE-89', 'CWE-564', 'CWE-' || (20 + n % 80)) AND f.severity <> 'low'), false) AS flagged FROM c LEFT JOIN findings f ON f.repo = c.repo AND f.path = c.path GROUP BY ALL)"""


@query(f"{with_views('code_lines', 'findings')}, {CASES_SQL} SELECT repo, name, flagged FROM flagged")
def c9_flag_cases(spark, sf):
    return score.flag_cases(citations_of(spark, sf), file_cases(spark, sf))


@query(f"{with_views('findings', 'modules')}, {MODULES_SQL} SELECT m.id || '-' || r.repo AS id FROM modules m CROSS JOIN (SELECT DISTINCT repo FROM findings) r EXCEPT SELECT module || '-' || repo FROM flags WHERE flagged AND fid LIKE '%3'")
def c10_missed(spark, sf):
    flags = module_flags(spark, sf).where("flagged and fid like '%3'").select(F.concat("module", F.lit("-"), "repo").alias("id"))
    return score.missed(module_ids(spark, sf), flags)


@query(f"{with_views('cases')} SELECT name, real FROM cases SEMI JOIN (SELECT 'Case' || l_partkey AS name FROM lineitem WHERE l_quantity > 49) USING (name)")
def c11_holdout_cases(spark, sf):
    names = load(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("Case"), F.col("l_partkey").cast("string")).alias("name"))
    return score.holdout_cases(view(spark, sf, "cases"), names).select("name", "real")


SIDES_SQL = f"""{MODULES_SQL}, sides AS (SELECT m.id || '-' || r.repo AS id, coalesce(bool_or(flagged AND fid NOT LIKE '%7'), false) AS detected, coalesce(bool_or(flagged AND fid LIKE '%1'), false) AS still_flagged
    FROM modules m CROSS JOIN (SELECT DISTINCT repo FROM findings) r LEFT JOIN flags f ON f.module = m.id AND f.repo = r.repo GROUP BY m.id, r.repo)"""


def repo_modules(spark, sf):
    """The modules of each repository that has findings."""
    repos = F.sequence(F.lit(0), F.lit(19))
    each = view(spark, sf, "modules").select("id", F.array("cwe1", "cwe2").alias("cwes"), F.explode(F.transform(repos, lambda i: F.concat(F.lit("repo"), i.cast("string")))).alias("repo"))
    return each.join(view(spark, sf, "findings").select("repo").distinct(), "repo", "left_semi")


def module_ids(spark, sf):
    return repo_modules(spark, sf).select(F.concat("id", F.lit("-"), "repo").alias("id"))


def sides(spark, sf):
    flags = module_flags(spark, sf).where("flagged").withColumn("id", F.concat("module", F.lit("-"), "repo"))
    return score.pair_sides(module_ids(spark, sf), flags.where("fid not like '%7'"), flags.where("fid like '%1'"))


@query(f"{with_views('findings', 'modules')}, {SIDES_SQL} SELECT *, detected AND NOT still_flagged AS pair_correct FROM sides")
def c12_pair_sides(spark, sf):
    return sides(spark, sf)


@query(f"{with_views('code_lines', 'scanner')}, s AS (SELECT DISTINCT repo, path, start_line, start_line + 2 AS end_line FROM scanner) SELECT s.repo, s.path, s.start_line, s.end_line, coalesce(string_agg(c.text, chr(10) ORDER BY c.line), '') AS quote FROM s LEFT JOIN code_lines c ON c.repo = s.repo AND c.path = s.path AND c.line BETWEEN s.start_line AND s.end_line GROUP BY ALL")
def c13_quote_lines(spark, sf):
    spans = view(spark, sf, "scanner").select("repo", "path", "start_line", (F.col("start_line") + 2).alias("end_line")).distinct()
    return citations.quote_spans(spans, view(spark, sf, "code_lines"))


NEUTRAL_SQL = r"replace(regexp_replace(regexp_replace(content, '\A\s*''''''(?s:.*?)''''''\s*\n', ''), '(/benchmark/|web/)[a-z]+-\d+/', '\1cases/', 'g'), 'executing cmdi', 'executing command')"


@query(rf"""{CODE}, files AS (SELECT repo, path, {CASE_SOURCE.replace('name', 'path')} || string_agg(text, chr(10) ORDER BY line) AS content FROM code_lines GROUP BY repo, path)
    SELECT repo, path, {NEUTRAL_SQL} AS content FROM files WHERE split_part(path, '/', 1) IN ('svc1', 'svc2') AND NOT path LIKE '%.txt'
    UNION ALL SELECT repo, path, content FROM files WHERE path LIKE '%.txt' AND path NOT LIKE 'svc6/%'""")
def c14_case_tree(spark, sf):
    head = F.concat(F.lit("'''\nOWASP "), "path", F.lit("\n'''\n@app.route(\"/benchmark/sqli-00/"), "path", F.lit("\")\nrender(\"web/xss-01/a.html\")\nprint(\"OWASP: executing cmdi\")\n"))
    files = train.file_texts(view(spark, sf, "code_lines")).withColumn("content", F.concat(head, "content"))
    cases = files.where("split(path, '/')[0] in ('svc1', 'svc2') and path not like '%.txt'").select("repo", "path")
    return train.case_tree(files, cases, files.where("path like '%.txt'"), "svc6/")


PAIRS_SQL = r"""k AS (SELECT *, regexp_extract(path, '/f(\d+)\.', 1)::INT AS k FROM code_lines),
    files AS (SELECT repo, 'm' || (k // 2) || CASE k % 2 WHEN 0 THEN '/low.src' ELSE '/high.src' END AS path, string_agg(text, chr(10) ORDER BY line) AS content FROM k GROUP BY repo, k),
    wanted AS (SELECT repo, module, side, module || '/' || file AS path FROM (SELECT DISTINCT repo, split_part(path, '/', 1) AS module FROM files) m CROSS JOIN (VALUES ('vulnerable', 'low.src'), ('secure', 'high.src')) v(side, file))"""


@query(rf"""{CODE}, {PAIRS_SQL} SELECT w.repo, w.module, w.side, CASE WHEN f.path IS NULL THEN '' ELSE w.module || '/handler.src' END AS path, coalesce(md5(content), '') AS digest FROM wanted w LEFT JOIN files f ON f.repo = w.repo AND f.path = w.path""")
def b13_neutral_pairs(spark, sf):
    files, modules = module_files(spark, sf)
    found, missing = train.neutral_pairs(files, modules, "low.src", "high.src")
    return found.select("repo", "module", "side", "path", F.md5(F.col("content").cast("binary")).alias("digest")).unionByName(missing.select("repo", "module", "side", F.lit("").alias("path"), F.lit("").alias("digest")))


def module_files(spark, sf):
    """Files dealt to modules of a low and a high version, of which some lack one; and the modules."""
    k = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("int")
    name = F.concat(F.lit("m"), F.floor(k / 2).cast("string"), F.when(k % 2 == 0, "/low.src").otherwise("/high.src"))
    files = train.file_texts(view(spark, sf, "code_lines")).withColumn("path", name)
    return files, files.select("repo", F.substring_index("path", "/", 1).alias("id"), F.array(F.lit("CWE-89"), F.lit("CWE-94")).alias("cwes")).distinct()


# D: aggregations

LEADS_SQL = f"""{CODE}, src AS (SELECT * FROM code_lines WHERE {IN_CODE}), {lexicon_sql('src')},
    per AS (SELECT repo, path, class, string_agg(line::VARCHAR, ', ' ORDER BY line, ord) AS all_lines, array_to_string(list_slice(list(line::VARCHAR ORDER BY line, ord), 1, 8), ', ') AS lines FROM hits GROUP BY ALL),
    leads AS (SELECT f.repo, f.path, coalesce(p.score, 0)::INT AS score, coalesce(p.hints, '') AS hints, coalesce(c.cwes, '') AS cwes FROM (SELECT DISTINCT repo, path FROM src) f
        LEFT JOIN (SELECT repo, path, sum(CASE WHEN class = 'request handler' THEN 5 ELSE 10 END) AS score, string_agg('- ' || class || ': line ' || lines, '; ' ORDER BY class) AS hints FROM per GROUP BY ALL) p ON f.repo = p.repo AND f.path = p.path
        LEFT JOIN (SELECT repo, path, string_agg(cwe, ',' ORDER BY cwe) AS cwes FROM (SELECT DISTINCT repo, path, cwe FROM hits WHERE cwe <> '') x GROUP BY ALL) c ON f.repo = c.repo AND f.path = c.path)"""


@query(f"{LEADS_SQL} SELECT repo, path, class, all_lines AS lines FROM per")
def d1_lead_hints(spark, sf):
    one = hints.lead_hints(view(spark, sf, "code_lines")).select("repo", "path", F.explode("hints").alias("class", "n"))
    return one.select("repo", "path", "class", F.array_join(F.transform("n", lambda x: x.cast("string")), ", ").alias("lines"))


@query(f"""{FOUND}, r AS (SELECT repo, path, sum(pk) AS p, sum(sk) AS c, sum(ok % 7) / 2.0 AS s, count(*) AS n, count(*) FILTER (WHERE sk % 7 = 1) AS d, bool_or(sk % 29 = 0) AS e FROM findings GROUP BY repo, path)
    SELECT repo, count(*) AS leads, sum(n)::BIGINT AS findings, sum(d)::BIGINT AS discarded_bad_citation, round(sum(s), 1) AS seconds, sum(p)::BIGINT AS prompt_tokens, max(p)::BIGINT AS largest_prompt_tokens, sum(c)::BIGINT AS completion_tokens, coalesce(string_agg(path || ': no answer', ';' ORDER BY path || ': no answer') FILTER (WHERE e), '') AS errors FROM r GROUP BY repo""")
def d2_scan_stats(spark, sf):
    f = view(spark, sf, "findings").groupBy("repo", "path").agg(F.sum("pk").alias("prompt_tokens"), F.sum("sk").alias("completion_tokens"), (F.sum(F.col("ok") % 7) / 2.0).alias("seconds"), F.count("*").alias("n_findings"), F.count_if(F.col("sk") % 7 == 1).alias("discarded"), F.max(F.when(F.col("sk") % 29 == 0, "no answer")).alias("error"))
    return findings.scan_stats(f).withColumn("errors", F.array_join("errors", ";"))


IDS = "coalesce(string_agg(DISTINCT item, ',' ORDER BY item) FILTER (WHERE kind = {}), '')"
SUMMARY_SQL = f"""hit AS (SELECT repo, {IDS.format(0)} AS found, {IDS.format(2)} AS decoys_flagged, {IDS.format(1)} AS patched_still_flagged, count(DISTINCT item) FILTER (WHERE kind = 0) AS n, count(DISTINCT item) FILTER (WHERE kind > 0) AS wrong, count(*) FILTER (WHERE item IS NULL) AS unlisted FROM matches GROUP BY repo),
    total AS (SELECT repo, count(*) FILTER (WHERE NOT is_decoy) AS weak, count(*) FILTER (WHERE is_decoy) AS decoys FROM truth GROUP BY repo)"""
SCORE_SQL = "repo, {weak} AS weaknesses, decoys, {fixed} AS patched, coalesce(found, '') AS found, coalesce(decoys_flagged, '') AS decoys_flagged, coalesce(patched_still_flagged, '') AS patched_still_flagged, coalesce(unlisted, 0) AS unlisted, {weak} - coalesce(n, 0) AS missed_count, coalesce(n / nullif({weak}, 0), 0) AS recall, coalesce(n / nullif(n + wrong + unlisted, 0), 0) AS precision FROM total LEFT JOIN hit USING (repo)"


def flat_score(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("found", "decoys_flagged", "patched_still_flagged")})


@query(f"{with_views('code_lines', 'truth', 'evidence')}, {MATCH_SQL}, {SUMMARY_SQL} SELECT {SCORE_SQL.format(weak='weak', fixed='0')}")
def d3_score_summary(spark, sf):
    return flat_score(score.score_summary(matches(spark, sf), truth(spark, sf)))


@query(f"{with_views('findings', 'modules')}, {SIDES_SQL} SELECT count(*) AS pairs, count(*) FILTER (WHERE detected AND NOT still_flagged) AS correct, correct / pairs AS accuracy FROM sides")
def d4_pair_accuracy(spark, sf):
    return score.pair_accuracy(sides(spark, sf))


@query(f"{with_views('runs')}, r AS (SELECT config, run, count(*) AS n, max(value) AS value FROM runs GROUP BY ALL) SELECT config, count(*) AS runs, avg(value) AS value, avg(n) AS n, string_agg(n::VARCHAR, ',' ORDER BY run) AS n_per_run FROM r GROUP BY config")
def d5_run_averages(spark, sf):
    r = view(spark, sf, "runs").groupBy("config", "run").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    return summary.run_averages(r, ["value", "n"], ["n"]).withColumn("n_per_run", F.array_join(F.col("n_per_run").cast("array<string>"), ","))


ITEM_SQL = """item_findings AS (SELECT i.id, f.repo, f.fid, f.cwe IN ('CWE-89', 'CWE-22', 'CWE-94') AND f.severity <> 'low' AS own, f.sk FROM items i JOIN findings f ON i.repo = f.repo AND i.path = f.path),
    near AS (SELECT DISTINCT i.id FROM item_findings i JOIN evidence e ON e.repo = i.repo AND e.fid = i.fid JOIN changes c ON c.item = i.id AND c.repo = e.repo AND c.path = e.path AND e.start_line - 3 <= c.end_line AND e.end_line + 3 >= c.start_line WHERE own)"""


@query(f"""{with_views('findings', 'evidence', 'items', 'changes')}, {ITEM_SQL}, s AS (SELECT i.id, coalesce(bool_or(own), false) AS detected, coalesce(bool_or(own AND sk % 2 = 0), false) AS fixed_flagged, count(*) FILTER (WHERE NOT own) AS other_findings_vulnerable, count(*) FILTER (WHERE NOT own AND sk % 2 = 0) AS other_findings_fixed FROM items i LEFT JOIN item_findings f ON i.id = f.id GROUP BY i.id)
    SELECT s.id, detected, n.id IS NOT NULL AS detected_at_change, fixed_flagged, detected AND NOT fixed_flagged AS pair_correct, other_findings_vulnerable, other_findings_fixed FROM s LEFT JOIN near n ON s.id = n.id""")
def d6_score_items(spark, sf):
    return score.score_items(citations_of(spark, sf), citations_of(spark, sf, "sk % 2 = 0"), real_items(spark, sf), all_changes(spark, sf))


def all_changes(spark, sf):
    """The changes of the items, and for each item those that lie at all findings of the repository's next file, which isn't its own, so they must not count.

    Their number grows with the findings: every file's findings are changes of one item at most.
    """
    own = view(spark, sf, "changes")
    number = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("long")
    # A repository has every tenth number: customers 2k and 2k + 1 share the path of k, and a customer's repository is its number modulo 20.
    items = view(spark, sf, "items").select(F.col("id").alias("item"), "repo", (number + 10).alias("number"))
    others = view(spark, sf, "findings").select("repo", "path", number.alias("number"), "start_line", (F.col("start_line") + 1).alias("end_line"))
    return own.unionByName(items.join(others, ["repo", "number"]).select(own.columns))


def real_items(spark, sf):
    return view(spark, sf, "items").withColumn("cwes", F.array(F.lit("CWE-89"), F.lit("CWE-22"), F.lit("CWE-94")))


@query("""WITH f AS (SELECT source AS category, quality = 1 AS real, toxic = 1 AS flagged FROM labels JOIN documents USING (doc_id)),
    n AS (SELECT category, count(*) FILTER (WHERE real) AS n_real, count(*) FILTER (WHERE NOT real) AS n_fake, count(*) FILTER (WHERE real AND flagged) AS tp, count(*) FILTER (WHERE NOT real AND flagged) AS fp FROM f GROUP BY ROLLUP (category))
    SELECT *, coalesce(tp / nullif(n_real, 0), 0) AS tpr, coalesce(fp / nullif(n_fake, 0), 0) AS fpr, coalesce(tp / nullif(n_real, 0), 0) - coalesce(fp / nullif(n_fake, 0), 0) AS score FROM n""")
def d7_score_cases(spark, sf):
    flags = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id").select(F.col("source").alias("category"), (F.col("quality") == 1).alias("real"), (F.col("toxic") == 1).alias("flagged"))
    return score.score_cases(flags)


@query(f"{with_views('log')} SELECT status, count(*) AS n, count(*) FILTER (WHERE real) AS n_real FROM log GROUP BY status")
def d8_status_counts(spark, sf):
    return summary.status_counts(view(spark, sf, "log"))


RUN_SQL = "m AS (SELECT config, run, metric, max(value) AS value FROM runs GROUP BY ALL)"


@query(f"{with_views('runs')}, {RUN_SQL} SELECT config, metric, count(*) AS runs, avg(value) AS mean, min(value) AS low, max(value) AS high, arg_min(value, run) AS first_value, arg_max(value, run) AS last_value FROM m GROUP BY ALL")
def d9_metric_summary(spark, sf):
    m = summary.metric_summary(view(spark, sf, "runs").groupBy("config", "run", "metric").agg(F.max("value").alias("value")))
    return m.select("config", "metric", "runs", "mean", "low", "high", F.element_at("values", 1).alias("first_value"), F.element_at("values", -1).alias("last_value"))


@query(f"{with_views('runs')} SELECT config, item, count(DISTINCT run) AS runs, count(DISTINCT run) FILTER (WHERE value > 50) AS found, count(DISTINCT run) FILTER (WHERE value > 80) AS correct FROM runs GROUP BY ALL")
def d10_item_stability(spark, sf):
    return summary.item_stability(view(spark, sf, "runs").withColumn("found", F.col("value") > 50).withColumn("correct", F.col("value") > 80))


@query(f"{with_views('runs')} SELECT run, count(*) FILTER (WHERE item % 2 = 0 AND value > 50) AS injection, count(*) FILTER (WHERE item % 2 = 1 AND value > 50) AS missing_check FROM runs GROUP BY run")
def d11_group_counts(spark, sf):
    rows = view(spark, sf, "runs").select("run", F.when(F.col("item") % 2 == 0, "injection").otherwise("missing_check").alias("grp"), (F.col("value") > 50).alias("detected"))
    return summary.group_counts(rows, ["injection", "missing_check"])


SIGNALS = ["scanner agrees", "no hedging words", "cites both ends", "severity high or critical"]
SIGNAL_SQL = f"""{MATCH_SQL}, {AGREED_SQL}, {BOTH_SQL}, signals AS (SELECT coalesce(m.kind = 0, false) AS is_true, a.fid IS NOT NULL AS s0, NOT regexp_matches(summary || ' ' || reasoning, {quoted(S.HEDGE)}) AS s1, both_ends AS s2, severity IN ('high', 'critical') AS s3
    FROM findings f JOIN matches m USING (repo, fid) LEFT JOIN agreed a USING (repo, fid) JOIN flow USING (repo, fid))"""


SIGNALS_SQL = f"{with_views('code_lines', 'truth', 'evidence', 'scanner')}, {SIGNAL_SQL} " + " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) FILTER (WHERE s{i}) AS n_with, avg(is_true::INT) FILTER (WHERE s{i}) AS p_with, count(*) FILTER (WHERE NOT s{i}) AS n_without, avg(is_true::INT) FILTER (WHERE NOT s{i}) AS p_without, count(*) FILTER (WHERE s{i} AND is_true) / count(*) FILTER (WHERE is_true) AS true_kept FROM signals" for i, s in enumerate(SIGNALS))


@query(SIGNALS_SQL)
def d12_signal_precision(spark, sf):
    f = findings.wording(view(spark, sf, "findings")).drop("cwe")
    ev = view(spark, sf, "evidence")
    agreed = intervals.scanner_agreement(ev, view(spark, sf, "scanner")).withColumn("agrees", F.lit(True))
    rows = f.join(matches(spark, sf), ["repo", "fid"]).join(agreed, ["repo", "fid"], "left").join(findings.dataflow(ev), ["repo", "fid"])
    rows = rows.select(F.coalesce(F.col("kind") == 0, F.lit(False)).alias("is_true"), F.coalesce("agrees", F.lit(False)).alias(SIGNALS[0]), (~F.col("hedged")).alias(SIGNALS[1]), F.col("both_ends").alias(SIGNALS[2]), F.col("severity").isin("high", "critical").alias(SIGNALS[3]))
    return summary.signal_precision(rows, SIGNALS)


@query(f"""{CODE}, {CALLS_SQL}, {JS_SQL}, files AS (SELECT DISTINCT repo, path FROM code_lines WHERE {FAMILY_SQL} = 'js'),
    peers AS (SELECT f.repo, f.path, count(*) AS peers FROM files f JOIN js_entries e ON e.repo = f.repo AND e.path <> f.path GROUP BY ALL HAVING count(*) >= 2),
    used AS (SELECT f.repo, f.path, g.guard, count(*) AS uses, count(DISTINCT g.path) AS n_files FROM files f JOIN js_guards g ON g.repo = f.repo AND g.path <> f.path GROUP BY ALL)
    SELECT repo, path, guard, peers, uses, n_files, ord::INT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY uses DESC, guard) AS ord FROM used JOIN peers USING (repo, path)) x WHERE ord <= 10""")
def d13_peer_guards(spark, sf):
    lines = view(spark, sf, "code_lines")
    return defs.peer_guards(defs.js_entries(lines), lines.where(S.language_family(F.col("path")) == "js"))


@query("""SELECT role AS stop_reason, count(*) AS traces, sum(n)::BIGINT AS steps, sum(r)::BIGINT AS refused, sum(t)::BIGINT AS tokens, sum(t / 4.0) AS seconds
    FROM (SELECT role, conv_id, count(*) AS n, count(*) FILTER (WHERE length(text) > 300) AS r, sum(length(text)) AS t FROM conversations GROUP BY role, conv_id) x GROUP BY role""")
def d14_trace_stats(spark, sf):
    c = load(spark, sf, "conversations")
    step = F.struct(F.lit("read").alias("tool"), F.when(F.length("text") > 300, F.concat(F.lit("NOT recorded: "), "text")).otherwise(F.lit("recorded")).alias("output"))
    t = c.groupBy(F.col("role").alias("stop_reason"), "conv_id").agg(F.collect_list(step).alias("steps"), F.sum(F.length("text")).alias("tokens"), F.sum(F.length("text") / 4.0).alias("seconds"))
    return summary.trace_stats(t)


# E and F: windows and ranks

MERGED_SQL = "merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, start_line // 3, coalesce(cwe, '') ORDER BY line, fid) AS n FROM findings) x WHERE n = 1)"


def merged(spark, sf):
    coarse = view(spark, sf, "findings").withColumn("true_start", F.col("start_line")).withColumn("start_line", F.floor(F.col("start_line") / 3))
    return findings.dedupe_findings(coarse, ["line", "fid"])


@query(f"{FOUND}, {MERGED_SQL} SELECT repo, fid FROM merged")
def e1_dedupe_findings(spark, sf):
    return merged(spark, sf).select("repo", "fid")


NUMBERED_SQL = "numbered AS (SELECT *, printf('F%03d', row_number() OVER (PARTITION BY repo ORDER BY path, line, fid)) AS id FROM merged)"


@query(f"{FOUND}, {MERGED_SQL}, {NUMBERED_SQL} SELECT repo, fid, id FROM numbered")
def e2_number_findings(spark, sf):
    return findings.number_findings(merged(spark, sf), ["path", "line", "fid"]).select("repo", "fid", "id")


@query(f"{CODE}, {SITES_SQL} SELECT repo, name, path, line, site::INT AS site FROM firsts")
def e4_first_sites(spark, sf):
    return defs.first_sites(defs.definition_sites(view(spark, sf, "code_lines"))).select("repo", "name", "path", "line", "site")


@query(f"""{with_views('cases')}, r AS (SELECT name, cat, real, row_number() OVER (PARTITION BY cat, real ORDER BY md5('7' || name), name) AS n, least(3, count(*) OVER (PARTITION BY cat, real) // 3) AS held FROM cases)
    SELECT name, cat AS category, real, CASE WHEN n <= held THEN 'holdout' WHEN n <= held + 5 THEN 'train' END AS side FROM r""")
def e5_stratified_split(spark, sf):
    return select.stratified_split(view(spark, sf, "cases").select("name", F.col("cat").alias("category"), "real"), 5, 3, "7")


RANKED_SQL = f"""first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(repo) ORDER BY md5('s' || id), id) AS n FROM advisories) x WHERE n = 1),
    ranked AS (SELECT id, repo, grp, row_number() OVER (PARTITION BY grp ORDER BY md5('s' || id), id) AS rank FROM (SELECT *, CASE WHEN cwe IN {INJECTED} OR cwe2 IN {INJECTED} THEN 'injection' ELSE 'missing check' END AS grp FROM first) x)"""


@query(f"{with_views('advisories')}, {RANKED_SQL} SELECT * FROM ranked")
def e6_one_per_repo(spark, sf):
    return select.one_per_repo(advisory_rows(spark, sf), "s").select("id", "repo", "grp", "rank")


@query(r"""WITH hunks AS (SELECT o_orderkey AS diff, o_custkey AS c FROM orders)
    SELECT diff, 'x.py' AS path, c::INT AS start, (CASE diff % 3 WHEN 0 THEN c + 1 WHEN 1 THEN c ELSE c + 3 END)::INT AS "end" FROM hunks UNION ALL SELECT diff, 'x.py', (c + 40)::INT, (c + 41)::INT FROM hunks""")
def e7_diff_ranges(spark, sf):
    return select.diff_ranges(view(spark, sf, "diffs"))


@query(f"""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND n > 1 AND length(text) > 400 THEN {quoted(select.STUB)} ELSE text END AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS n FROM conversations) x""")
def e8_compact_history(spark, sf):
    return select.compact_history(load(spark, sf, "conversations"), "assistant", 1, 400).select("conv_id", "turn", "role", "text")


@query(f"""{with_views('cases')} SELECT name, CASE WHEN row_number() OVER (ORDER BY md5('v' || name), name) <= greatest(1, count(*) OVER () // 10) THEN 'valid' ELSE 'train' END AS side FROM cases""")
def e9_train_valid(spark, sf):
    return select.train_valid(view(spark, sf, "cases"), "v").select("name", "side")


@query(f"{with_views('code_lines', 'evidence')}, {CHECKED_SQL} SELECT repo, fid, min(ev_ord) AS ev_ord, path, start_line, end_line, 'sink' AS role FROM checked GROUP BY repo, fid, path, start_line, end_line")
def e10_dedupe_citations(spark, sf):
    return findings.dedupe_citations(checked(spark, sf).withColumn("role", F.lit("sink"))).select("repo", "fid", "ev_ord", "path", "start_line", "end_line", "role")


@query(f"{LEADS_SQL} SELECT repo, path, score, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path)::INT AS rank FROM leads QUALIFY rank <= 15")
def f1_rank_leads(spark, sf):
    return hints.rank_leads(hints.lead_hints(view(spark, sf, "code_lines")), 15).select("repo", "path", "score", "rank")


TIER_SQL = f"{AGREED_SQL}, tiered AS (SELECT f.*, CASE WHEN a.fid IS NULL THEN 'suspected' ELSE 'supported' END AS tier, regexp_matches(summary || ' ' || reasoning, {quoted(S.HEDGE)}) AS hedged FROM findings f LEFT JOIN agreed a ON f.repo = a.repo AND f.fid = a.fid)"


def tiered(spark, sf):
    return findings.wording(intervals.assign_tiers(view(spark, sf, "findings"), view(spark, sf, "evidence"), view(spark, sf, "scanner")))


@query(f"{with_views('evidence', 'scanner')}, {TIER_SQL} SELECT repo, fid, tier, row_number() OVER (PARTITION BY repo ORDER BY tier = 'suspected', hedged, list_position(['critical', 'high', 'medium', 'low'], severity), fid)::INT AS rank FROM tiered")
def f2_rank_findings(spark, sf):
    return findings.rank_findings(tiered(spark, sf).withColumn("id", F.col("fid"))).select("repo", "fid", "tier", "rank")


@query(f"{with_views('advisories')}, {RANKED_SQL} SELECT * FROM ranked WHERE rank <= 40")
def f3_top_per_group(spark, sf):
    return select.top_per_group(select.one_per_repo(advisory_rows(spark, sf), "s")).select("id", "repo", "grp", "rank")


@query(f"{CODE} SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS text FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS n FROM code_lines) x WHERE n <= 8 GROUP BY ALL")
def f4_cap_lists(spark, sf):
    return findings.cap_lists(view(spark, sf, "code_lines"), ["repo", "path"], "line", "text", 8).withColumn("text", F.array_join("text", "\n"))


# G: sets


@query(f"{with_views('findings', 'modules')}, {SIDES_SQL} SELECT id FROM sides WHERE detected EXCEPT SELECT id FROM sides WHERE still_flagged")
def g1_found_minus_still(spark, sf):
    return score.found_minus_still(sides(spark, sf))


@query(f"{with_views('findings', 'modules')}, {SIDES_SQL} SELECT id FROM sides WHERE detected UNION SELECT id FROM sides WHERE NOT detected")
def g2_all_modules(spark, sf):
    s = sides(spark, sf)
    return score.all_modules(s.where("detected"), s.where("not detected"))


@query(f"{with_views('advisories')} SELECT id, array_to_string(list_sort(list_distinct(list_filter([cwe2, cwe], lambda x: x IN {INJECTED}))), ',') AS common FROM advisories")
def g3_cwe_overlap(spark, sf):
    return view(spark, sf, "advisories").select("id", F.array_join(F.array_sort(select.cwe_overlap(F.array("cwe2", "cwe"))).cast("array<string>"), ",").alias("common"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def g4_repeated_ids(spark, sf):
    return score.repeated_ids(load(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_suppkey AS id FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity < 2")
def g4_in_both(spark, sf):
    rows = load(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "id")
    return score.in_both(rows.where("l_quantity > 49"), rows.where("l_quantity < 2"), "id")


TWIN_SQL = """anchor_hits AS (SELECT t.repo, t.id, count(c.line) AS n FROM truth t LEFT JOIN code_lines c ON t.repo = c.repo AND t.path = c.path AND contains(c.text, t.anchor) GROUP BY t.repo, t.id),
    usable AS (SELECT t.* FROM truth t JOIN anchor_hits USING (repo, id) WHERE n = 1),
    twin AS (SELECT c.repo, c.path, c.line, CASE WHEN u.id IS NULL THEN c.text ELSE u.new END AS text FROM code_lines c LEFT JOIN usable u ON NOT u.is_decoy AND u.repo = c.repo AND u.path = c.path AND u.anchor = c.text),
    later AS (SELECT t.repo, t.id, count(c.line) AS n FROM truth t LEFT JOIN twin c ON t.repo = c.repo AND t.path = c.path AND contains(c.text, CASE WHEN t.is_decoy THEN t.anchor ELSE t.new END) GROUP BY t.repo, t.id),
    still AS (SELECT DISTINCT t.repo, t.id FROM truth t JOIN twin c ON t.repo = c.repo AND t.path = c.path AND contains(c.text, t.anchor) WHERE NOT t.is_decoy AND NOT contains(t.new, t.anchor))"""


@query(f"""{with_views('code_lines', 'truth')}, {TWIN_SQL}
    SELECT repo, id, 'anchor does not resolve' AS violation FROM anchor_hits WHERE n <> 1 UNION ALL SELECT repo, id, 'fix does not apply' FROM truth JOIN anchor_hits USING (repo, id) WHERE NOT is_decoy AND n <> 1
    UNION ALL SELECT repo, id, 'old text is left' FROM still UNION ALL SELECT repo, id, CASE WHEN is_decoy THEN 'decoy does not survive' ELSE 'patched anchor does not resolve' END FROM truth JOIN later USING (repo, id) WHERE n <> 1""")
def g5_check_truth(spark, sf):
    items, lines = truth(spark, sf), view(spark, sf, "code_lines")
    usable = items.join(intervals.anchor_regions(items, lines).select("repo", "path", "id"), ["repo", "path", "id"], "left_semi")
    twin = score.patched_twin(train.file_texts(lines), usable)
    return score.check_truth(items, lines, twin, hints.file_lines(twin.drop("bad")))


# H: scalars


@query("SELECT event_id, CASE WHEN regexp_extract(x, '(\\d+)', 1) <> '' THEN 'CWE-' || CAST(regexp_extract(x, '(\\d+)', 1) AS INT) END AS cwe FROM (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'cwe-0' || user_id || ': x' WHEN 1 THEN 'none' WHEN 2 THEN user_id || ' or 7' ELSE '' END AS x FROM events) y")
def h1_normalise_cwe(spark, sf):
    u = F.col("user_id").cast("string")
    x = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("cwe-0"), u, F.lit(": x"))).when(F.col("user_id") % 4 == 1, "none").when(F.col("user_id") % 4 == 2, F.concat(u, F.lit(" or 7"))).otherwise("")
    return load(spark, sf, "events").select("event_id", S.normalise_cwe(x).alias("cwe"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def h2_norm_ws(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.norm_ws(F.col("text")).alias("text"))


@query(rf"{CITED} SELECT fid, ev_ord, regexp_replace(quote, '^\s*\d+\|\s?', '') AS quote FROM evidence")
def h3_strip_gutter(spark, sf):
    return view(spark, sf, "evidence").select("fid", "ev_ord", S.strip_gutter(F.col("quote")).alias("quote"))


@query(r"SELECT page_id, '<repo_data>' || chr(10) || replace(replace(html, '</p>', '</repo_data>'), '</repo_data>', '<\/repo_data>') || chr(10) || '</repo_data>' AS text FROM pages")
def h4_wrap_untrusted(spark, sf):
    return load(spark, sf, "pages").select("page_id", S.wrap_untrusted(F.replace("html", F.lit("</p>"), F.lit("</repo_data>"))).alias("text"))


@query(f"{CODE} SELECT DISTINCT path, {FAMILY_SQL} AS family FROM code_lines")
def h5_language_family(spark, sf):
    return view(spark, sf, "code_lines").select("path", S.language_family(F.col("path")).alias("family")).distinct()


@query(f"{CITED} SELECT repo, fid, coalesce(min(start_line) FILTER (WHERE role = 'sink'), arg_min(start_line, ev_ord)) AS line FROM evidence GROUP BY repo, fid")
def h6_primary_evidence(spark, sf):
    e = F.transform(F.array_sort(F.collect_list(F.struct("ev_ord", "path", "start_line", "role"))), lambda x: x)
    return view(spark, sf, "evidence").groupBy("repo", "fid").agg(S.primary_evidence(e)["start_line"].alias("line"))


@query(f"""{with_views('code_lines', 'truth')}, {TWIN_SQL}, n AS (SELECT t.repo, t.path, t.id, anchor_hits.n, row_number() OVER (PARTITION BY t.repo, t.path ORDER BY t.id) AS k FROM truth t JOIN anchor_hits USING (repo, id)),
    bad AS (SELECT repo, path, min(k) FILTER (WHERE n <> 1) AS bad FROM n GROUP BY ALL), done AS (SELECT t.* FROM truth t JOIN n ON n.repo = t.repo AND n.id = t.id JOIN bad b ON b.repo = t.repo AND b.path = t.path WHERE n.k < coalesce(b.bad, 1000000))
    SELECT c.repo, c.path, string_agg(CASE WHEN d.id IS NULL THEN c.text ELSE d.new END, chr(10) ORDER BY c.line) AS text, any_value(b.bad) AS bad FROM code_lines c LEFT JOIN done d ON d.repo = c.repo AND d.path = c.path AND d.anchor = c.text LEFT JOIN bad b ON b.repo = c.repo AND b.path = c.path GROUP BY c.repo, c.path""")
def h7_apply_fixes(spark, sf):
    return score.apply_truth(train.file_texts(view(spark, sf, "code_lines")), truth(spark, sf)).withColumn("bad", F.col("bad").cast("long"))


ANSWERS = with_views("answers")
LINE_SQL = r"coalesce(TRY_CAST(e->>'$.start_line' AS DOUBLE) >= 1 AND TRY_CAST(e->>'$.start_line' AS DOUBLE) = floor(TRY_CAST(e->>'$.start_line' AS DOUBLE)) AND (json_type(e, '$.start_line') <> 'VARCHAR' OR regexp_full_match(e->>'$.start_line', '[0-9]+')), false)"
VALID_SQL = f"""coalesce(json_type(f, '$.title') = 'VARCHAR', false) AND coalesce(json_type(f, '$.summary') = 'VARCHAR', false) AND (json_type(f, '$.severity') IS NULL OR f->>'$.severity' IN ('low', 'medium', 'high', 'critical'))
        AND (json_type(f, '$.reasoning') IS NULL OR json_type(f, '$.reasoning') = 'VARCHAR') AND (json_type(f, '$.evidence') IS NULL OR {LINE_SQL})"""
PARSED_SQL = rf"""extracted AS (SELECT *, CASE WHEN regexp_matches(content, '(?s)\{{.*\}}') THEN regexp_extract(content, '(?s)\{{.*\}}', 0) ELSE content END AS j FROM answers),
    parsed AS (SELECT *, CASE WHEN NOT coalesce(json_valid(j), false) THEN CASE WHEN truncated THEN {quoted(S.CUT_OFF)} ELSE {quoted(S.NOT_JSON)} END END AS error FROM extracted),
    each AS (SELECT fid, repo, path, k::INT AS ord, f, f->'$.evidence[0]' AS e FROM (SELECT fid, repo, path, unnest(json_extract(j, '$.findings[*]')) AS f, unnest(range(len(json_extract(j, '$.findings[*]')))) AS k FROM parsed WHERE error IS NULL) x),
    typed AS (SELECT *, {VALID_SQL} AS valid FROM each)"""


@query(f"{ANSWERS}, {PARSED_SQL} SELECT fid, j FROM parsed")
def h8_extract_json(spark, sf):
    return view(spark, sf, "answers").select("fid", S.extract_json(F.col("content")).alias("j"))


@query(f"{ANSWERS}, {PARSED_SQL} SELECT p.fid, p.error, CASE WHEN p.error IS NULL THEN 2 END AS n, t.f->>'$.title' AS title FROM parsed p LEFT JOIN typed t ON t.fid = p.fid AND t.repo = p.repo AND t.valid")
def h9_parse_answer(spark, sf):
    p = findings.parsed_answers(view(spark, sf, "answers").drop("title"))
    kept = F.filter("findings", S.valid_finding)
    return p.select("fid", "error", F.when(F.col("error").isNull(), F.size("findings")).alias("n"), F.get(kept, F.lit(0))["title"].alias("title"))


@query(rf"""{ANSWERS}, {PARSED_SQL} SELECT repo, fid, ord, valid, CASE WHEN valid THEN coalesce(f->>'$.severity', 'medium') END AS severity, CASE WHEN valid THEN 'CWE-' || CAST(regexp_extract(f->>'$.cwe', '(\d+)', 1) AS INT) END AS cwe,
    CASE WHEN valid THEN CAST(CAST(e->>'$.start_line' AS DOUBLE) AS INT) END AS start_line, CASE WHEN valid THEN coalesce(e->>'$.role', 'context') END AS role FROM typed""")
def h10_validate_finding(spark, sf):
    """Each finding of each answer: whether its fields have their types, and what it is then, defaults included."""
    f, e = F.col("finding"), F.get(F.col("finding.evidence"), F.lit(0))
    told = {"severity": f["severity"], "cwe": f["cwe"], "start_line": e["start_line"], "role": e["role"]}
    return findings.answer_findings(view(spark, sf, "answers")).select(F.col("in_repo").alias("repo"), F.col("in_fid").alias("fid"), "ord", "valid", *(F.when(F.col("valid"), c).alias(n) for n, c in told.items()))


@query(f"{FOUND} SELECT fid, length(title) * (pk % 12) <= 120 AND length(summary) * (sk % 40) <= 600 AS within FROM findings")
def h11_within_bounds(spark, sf):
    f = view(spark, sf, "findings")
    long = f.select("fid", F.struct(F.expr("repeat(title, cast(pk % 12 as int))").alias("title"), F.lit("CWE-1").alias("cwe"), F.lit("low").alias("severity"), F.expr("repeat(summary, cast(sk % 40 as int))").alias("summary"), F.lit("").alias("reasoning"), F.lit("").alias("remediation"), F.array(F.struct("path", F.lit("q").alias("quote"))).alias("evidence")).alias("f"))
    return long.select("fid", S.within_bounds(F.col("f")).alias("within"))


@query("""SELECT doc_id, '{"messages":[{"role":"system","content":"Review."},{"role":"user","content":' || to_json(source) || '},{"role":"assistant","content":' || to_json(lang) || '}]}' AS record FROM documents""")
def h12_to_chat_record(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.to_chat_record(F.lit("Review."), F.col("source"), F.col("lang")).alias("record"))


@query(r"""WITH a AS (SELECT o_orderkey AS id, 'own/Repo' || o_custkey AS r, 'abcdef' || (1000000 + o_orderkey) AS s1, 'beef' || (1000000 + o_orderkey) AS s2 FROM orders)
    SELECT 'GHSA-' || id AS id, CASE WHEN id % 5 = 0 THEN r || '@' || s1 || ',' || r || '@' || s2 ELSE r || '@' || s1 END AS commits FROM a""")
def h13_fix_commits(spark, sf):
    c = S.fix_commits(F.array("url2", "url1", "url1"))
    return view(spark, sf, "advisories").select("id", F.array_join(F.transform(c, lambda x: F.concat(x["repo"], F.lit("@"), x["sha"])), ",").alias("commits"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1994-03-01' AND '1995-06-30' AS inside FROM orders")
def h14_published_between(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.published_between(F.col("o_orderdate"), "1994-03-01", "1995-06-30").alias("inside"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 0.0 ELSE (o_orderkey % 7) / (o_custkey % 5) END::DOUBLE AS r, CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE round_even((o_orderkey % 16) / (16.0 * (o_custkey % 3)), 3) END::DOUBLE AS rounded FROM orders")
def h15_ratio(spark, sf):
    """Exact, and rounded half-even where sixteenths and thirty-seconds end in a five."""
    num, den = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, sf, "orders").select(num.alias("id"), S.ratio(num % 7, den % 5, None).alias("r"), S.ratio(num % 16, 16 * (den % 3)).alias("rounded"))


@query(f"{LEADS_SQL} SELECT repo, path, hints FROM leads")
def h16_hint_lines(spark, sf):
    return hints.lead_hints(view(spark, sf, "code_lines")).select("repo", "path", F.array_join(S.hint_lines(F.col("hints")), "; ").alias("hints"))


@query(f"SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 3 = 0 THEN ' is labeled' ELSE '' END, {quoted(S.MENTIONS_KEY)}) AS mentions FROM documents")
def h17_mentions_key(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.mentions_key(F.concat("text", F.when(F.col("doc_id") % 3 == 0, " is labeled").otherwise(""))).alias("mentions"))


CATEGORIES = list(S.CASE_LABELS)
LABEL_SQL = "CASE cat " + " ".join(f"WHEN {i} THEN {quoted(S.CASE_LABELS[c])}" for i, c in enumerate(CATEGORIES)) + " END"


@query(f"""{with_views('cases')} SELECT name, CASE WHEN real THEN 'Label, for you alone: vulnerable (' || {LABEL_SQL} || ', CWE-' || (pk % 900) || '). Cite the lines that make it so; leave everything else out and do not speak of this label.'
    ELSE 'Label, for you alone: safe (no ' || {LABEL_SQL} || ', CWE-' || (pk % 900) || '). Explain in the analysis which code prevents it; give no findings and do not speak of this label.' END AS hint FROM cases""")
def h18_case_hint(spark, sf):
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("cat") + 1)
    return view(spark, sf, "cases").select("name", S.case_hint(category, F.col("real"), F.col("pk") % 900).alias("hint"))


@query(f"""{with_views('findings')} SELECT fid, CASE WHEN severity <> 'low' THEN '## ' || fid || ': ' || title || chr(10) || chr(10) || severity || ' severity, suspected, ' || cwe || ', ' || path || ':' || start_line || chr(10) || chr(10) || summary || chr(10)
    || chr(10) || 'Reasoning: ' || reasoning || chr(10) || chr(10) || '`' || path || ':' || start_line || '` to line ' || start_line || ', sink' || chr(10) || '```' || chr(10) || rtrim(quote) || chr(10) || '```' || chr(10) || chr(10) || 'Verified:' || chr(10) || CASE WHEN sk % 3 = 0 THEN '- [ ] wording - could' ELSE '- [x] wording' END || chr(10) END AS section FROM findings""")
def h19_finding_markdown(spark, sf):
    f = view(spark, sf, "findings")
    e = F.array(F.struct("path", "start_line", F.col("start_line").alias("end_line"), "quote", F.lit("sink").alias("role")))
    s = F.struct(F.col("fid").alias("id"), "title", F.when(F.col("severity") == "low", "rejected").otherwise("suspected").alias("tier"), "severity", "cwe", "summary", "reasoning", F.lit(None).cast("string").alias("remediation"), e.alias("evidence"))
    check = F.array(F.struct(F.lit("wording").alias("name"), (F.col("sk") % 3 != 0).alias("passed"), F.when(F.col("sk") % 3 == 0, "could").otherwise("").alias("detail")))
    return f.select("fid", S.finding_markdown(s, check).alias("section"))


# I: the answer log

@query(f"{with_views('cases', 'log')} SELECT name, real FROM cases ANTI JOIN (SELECT replace(name, 'n', 'Case') AS name FROM log) USING (name)")
def i1_resume_todo(spark, sf):
    done = view(spark, sf, "log").withColumn("name", F.replace("name", F.lit("n"), F.lit("Case")))
    return select.resume_todo(view(spark, sf, "cases"), done).select("name", "real")


@query(f"{with_views('log')} SELECT name, attempt, status FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY attempt DESC) AS n FROM log) x WHERE n = 1")
def i1_last_rows(spark, sf):
    return select.last_rows(view(spark, sf, "log")).select("name", "attempt", "status")


@query(f"""{ANSWERS}, {with_views('code_lines').split('WITH ', 1)[1].split('code_lines AS', 1)[0]}{PARSED_SQL}, w AS (SELECT p.fid, p.repo, p.path, p.quote FROM parsed p JOIN typed t ON t.repo = p.repo AND t.fid = p.fid AND t.valid WHERE sk % 41 <> 0 AND sk % 7 <> 1),
    first AS (SELECT w.repo, w.fid, min(c.line) AS line FROM w JOIN code_lines c ON c.repo = w.repo AND c.path = w.path AND contains(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), trim(regexp_replace(w.quote, '\\s+', ' ', 'g'))) GROUP BY ALL)
    SELECT repo || '/' || fid AS key, line AS start_line FROM first""")
def i2_stream_citations(spark, sf):
    """The log arrives in three parts over a bucketed table of the code: a third of all keys late, others twice, some with older attempts."""
    log, out, code = folder(spark, "log"), folder(spark, "cited"), folder(spark, "code")
    answers.write_code(view(spark, sf, "code_lines"), code, 16)
    a = view(spark, sf, "answers").select(F.concat("repo", F.lit("/"), "fid").alias("key"), F.lit(2).alias("attempt"), "repo", "path", "content", "truncated", "sk")
    empty = {"content": F.lit("{}"), "truncated": F.lit(False)}
    again = a.where("sk % 41 = 0").withColumns(empty | {"attempt": F.lit(3)})
    older = a.where("sk % 3 = 1").withColumns(empty | {"attempt": F.lit(1)})
    for part in (a.where("sk % 3 <> 0"), again.unionByName(a.where("sk % 3 = 0")), older.unionByName(a.where("sk % 5 = 0 and sk % 41 <> 0"))):
        part.drop("sk").write.mode("append").json(log)
        answers.stream_citations(spark, log, code, out, f"{out}-checkpoint", 16).awaitTermination()
    return answers.read_citations(spark, out).where("passed").select("key", "start_line")


# K: jobs


@query(f"{LEADS_SQL} SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path)::INT AS rank FROM leads")
def k1_leads_job(spark, sf):
    return hints.leads_job(view(spark, sf, "code_lines"))


@query(f"""{LEADS_SQL} SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM leads QUALIFY rank <= 5""")
def k1_leads_of_paths(spark, sf):
    """The same leads, asked for by name."""
    lines = view(spark, sf, "code_lines")
    paths = hints.relevant_files(lines.select("repo", "path").distinct())
    return hints.leads_job(lines, paths, 5).withColumn("rank", F.col("rank").cast("long"))


#: The lines that the scripted reviewer reports: template, class.
REPORTED = {5: "CWE-78", 24: "CWE-94"}


def scripted_reviewer():
    """A client that reports each shown line that evaluates text or runs a command, and fails on prompts that show none."""

    def client(prompt):
        found = []
        for row in prompt.split("<repo_data>")[1].split("\n"):
            number, _, text = row.partition("| ")
            for code, cwe in (("os.system(", "CWE-78"), ("eval(", "CWE-94")):
                if code in text:
                    path = prompt.split("`")[1]
                    cite = {"path": path, "start_line": int(number), "end_line": int(number), "quote": text, "role": "sink"}
                    found.append({"title": "runs what it is given", "cwe": cwe, "severity": "high" if cwe == "CWE-94" else "medium", "summary": "An attacker could reach this." if cwe == "CWE-78" else "Input reaches it.", "reasoning": "r", "evidence": [cite]})
        if not found:
            raise ValueError("nothing to say")
        return json.dumps({"findings": found})

    return client


def judged_scan(spark, sf):
    return jobs.scan_job(view(spark, sf, "code_lines"), "judge", scripted_reviewer, view(spark, sf, "scanner"), size=20, overlap=4, helpers=False)


LEAD_RANK = "row_number() OVER (PARTITION BY repo ORDER BY score DESC, path)"
JUDGED_SQL = f"""{LEADS_SQL}, ranked AS (SELECT repo, path, {LEAD_RANK} AS lead_rank FROM leads),
    own AS (SELECT repo, path, min(line) AS line, CASE t WHEN 5 THEN 'CWE-78' ELSE 'CWE-94' END AS cwe FROM src WHERE t IN (5, 24) GROUP BY repo, path, t),
    kept AS (SELECT o.*, r.lead_rank, printf('F%03d', row_number() OVER (PARTITION BY o.repo ORDER BY r.lead_rank, o.line)) AS id FROM own o JOIN ranked r ON r.repo = o.repo AND r.path = o.path),
    tiers AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM scanner s WHERE s.repo = k.repo AND s.path = k.path AND k.line - 3 <= s.end_line AND k.line + 3 >= s.start_line) THEN 'supported' ELSE 'suspected' END AS tier FROM kept k)"""


@query(f"""{JUDGED_SQL.replace(CODE, with_views('code_lines', 'scanner'))} SELECT repo, id, path, line AS start_line, cwe, tier, cwe = 'CWE-78' AS hedged, row_number() OVER (PARTITION BY repo ORDER BY tier = 'suspected', cwe = 'CWE-78', id) AS rank FROM tiers""")
def k4_scan_job(spark, sf):
    found, _, _ = judged_scan(spark, sf)
    return found.select("repo", "id", "path", "start_line", "cwe", "tier", "hedged", F.col("rank").cast("long").alias("rank"))


@query(f"""{JUDGED_SQL.replace(CODE, with_views('code_lines', 'scanner'))}, n AS (SELECT repo, path, max(line) AS n FROM src GROUP BY repo, path),
    parts AS (SELECT repo, path, n, unnest(range(CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 16.0)::INT + 1 END))::INT AS i FROM n),
    quiet AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM src c WHERE c.repo = p.repo AND c.path = p.path AND c.t IN (5, 24) AND c.line BETWEEN p.i * 16 + 1 AND least(p.i * 16 + 20, p.n)) AS failed FROM parts p)
    SELECT repo, count(DISTINCT path) AS leads, (SELECT count(*) FROM kept k WHERE k.repo = q.repo) AS findings, 0::BIGINT AS discarded_bad_citation, count(DISTINCT path) FILTER (WHERE failed) AS n_errors FROM quiet q GROUP BY repo""")
def k4_scan_stats(spark, sf):
    _, _, stats = judged_scan(spark, sf)
    return stats.select("repo", "leads", "findings", "discarded_bad_citation", F.size("errors").cast("long").alias("n_errors"))


PATTERN_SQL = f"""own AS (SELECT repo, path, line, cwe, class, ord, class_first FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, line, cwe ORDER BY ord) AS n, min(line * 100 + ord) OVER (PARTITION BY repo, path, class) AS class_first FROM hits WHERE class <> 'request handler') x WHERE n = 1)"""


@query(f"""{LEADS_SQL}, {PATTERN_SQL}, ranked AS (SELECT repo, path, {LEAD_RANK} AS lead_rank FROM leads)
    SELECT o.repo, printf('F%03d', row_number() OVER (PARTITION BY o.repo ORDER BY lead_rank, class_first, line, ord)) AS id, o.path, line AS start_line, cwe, class AS title, 'suspected' AS tier FROM own o JOIN ranked r ON r.repo = o.repo AND r.path = o.path""")
def k4_scan_patterns(spark, sf):
    found, _, _ = jobs.scan_job(view(spark, sf, "code_lines"), "patterns")
    return found.select("repo", "id", "path", "start_line", "cwe", "title", "tier")


@query(f"""{with_views('scanner', 'code_lines')}, s AS (SELECT DISTINCT repo, path, start_line, cwe, min(check_id) AS title FROM scanner GROUP BY ALL)
    SELECT repo, count(*) AS n, 'suspected' AS tier FROM s GROUP BY repo""")
def k4_scan_scanner(spark, sf):
    scanner = citations.quote_spans(view(spark, sf, "scanner").select("repo", "path", "start_line", "end_line", F.col("check_id").alias("title"), "cwe", F.lit("s").alias("summary")).distinct(), view(spark, sf, "code_lines"))
    found, _, _ = jobs.scan_job(view(spark, sf, "code_lines"), "scanner", scanner=scanner)
    return found.groupBy("repo", "tier").agg(F.count("*").alias("n"))


@query(f"""{with_views('advisories', 'commit_files')}, keyed AS (SELECT 'own/repo' || o_custkey || '@' || substring('abcdef' || (1000000 + sha), 1, 12) AS key, c.* FROM commit_files c JOIN orders ON o_orderkey = sha),
    usable AS (SELECT key, files FROM (SELECT key, string_agg(filename, ',' ORDER BY filename) FILTER (WHERE {SOURCE_SQL} AND status = 'modified') AS files, bool_and(one_parent) AS p, count(*) FILTER (WHERE {SOURCE_SQL}) AS n, count(*) FILTER (WHERE {SOURCE_SQL} AND status = 'modified') AS m, coalesce(sum(changes) FILTER (WHERE {SOURCE_SQL}), 0) AS c FROM keyed GROUP BY key) x WHERE p AND n BETWEEN 1 AND 3 AND m > 0 AND c <= 80),
    kept AS (SELECT a.*, u.files FROM advisories a JOIN usable u ON u.key = lower(repo) || '@' || substring(split_part(url1, '/commit/', 2), 1, 12) WHERE published BETWEEN '1993-01-01' AND '1997-12-31' AND NOT withdrawn AND ecosystem IN ('PIP', 'NPM') AND (cwe IN {EITHER} OR cwe2 IN {EITHER}) AND url2 = 'https://example.org/note'),
    {RANKED_SQL.replace('FROM advisories', 'FROM kept')} SELECT r.*, k.files FROM ranked r JOIN kept k USING (id) WHERE rank <= 40""")
def k10_select_advisories(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), "o_custkey")
    commits = view(spark, sf, "commit_files").join(orders, "sha").withColumns({"repo": F.concat(F.lit("own/Repo"), F.col("o_custkey").cast("string")), "sha": F.concat(F.lit("abcdef"), (1000000 + F.col("sha")).cast("string"))})
    return select.select_advisories(advisory_rows(spark, sf), commits, "1993-01-01", "1997-12-31", "s").select("id", "repo", "grp", "rank", F.array_join("files", ",").alias("files"))


PROMPT_SQL = f"""{LEADS_SQL}, parts AS (SELECT repo, path, n, i + 1 AS part, i * 16 + 1 AS first, least(i * 16 + 20, n) AS last FROM (SELECT repo, path, max(line) AS n, unnest(range(CASE WHEN max(line) <= 20 THEN 1 ELSE ceil((max(line) - 20) / 16.0)::INT + 1 END))::INT AS i FROM src GROUP BY repo, path) x),
    shown AS (SELECT *, row_number() OVER (PARTITION BY repo, path, part, class ORDER BY line, ord) AS k FROM (SELECT p.repo, p.path, p.part, h.class, h.line, h.ord FROM parts p JOIN hits h ON h.repo = p.repo AND h.path = p.path AND h.line BETWEEN p.first AND p.last) x),
    pointers AS (SELECT repo, path, part, string_agg('- ' || class || ': line ' || l, chr(10) ORDER BY class) AS t FROM (SELECT repo, path, part, class, string_agg(line::VARCHAR, ', ' ORDER BY line, ord) AS l FROM shown WHERE k <= 8 GROUP BY ALL) x GROUP BY ALL),
    code AS (SELECT p.repo, p.path, p.part, string_agg(c.line || '| ' || CASE WHEN regexp_matches(c.text, '^\\s*(#|//)') AND NOT starts_with(c.text, '#!') THEN '' ELSE c.text END, chr(10) ORDER BY c.line) AS t FROM parts p JOIN src c ON c.repo = p.repo AND c.path = p.path AND c.line BETWEEN p.first AND p.last GROUP BY ALL)"""


@query(f"""{PROMPT_SQL} SELECT p.repo, p.path, p.part, p.first, p.last, 'File under review: `' || p.path || '`.' || CASE WHEN n <= 20 THEN '' ELSE ' Lines ' || p.first || '-' || p.last || ' of ' || n || '; the other lines have prompts of their own.' END
    || chr(10) || chr(10) || CASE WHEN x.t IS NULL THEN '' ELSE 'Lines that match known patterns (hints only; check them, and look beyond them):' || chr(10) || x.t || chr(10) || chr(10) END
    || '<repo_data>' || chr(10) || '--- ' || p.path || ' ---' || chr(10) || c.t || chr(10) || '</repo_data>' || chr(10) || chr(10) || {quoted(jobs.WALKTHROUGH)} AS prompt
    FROM parts p JOIN code c USING (repo, path, part) LEFT JOIN pointers x USING (repo, path, part)""")
def k2_build_prompts(spark, sf):
    return jobs.build_prompts(view(spark, sf, "code_lines"), "walkthrough", True, size=20, overlap=4, helpers=False).drop("lead_rank")


@query(f"""{PROMPT_SQL} SELECT repo, path, part, first, last, 'File under review: `' || path || '`.' || CASE WHEN n <= 20 THEN '' ELSE ' Lines ' || first || '-' || last || ' of ' || n || '; the other lines have prompts of their own.' END AS head FROM parts""")
def k2_prompt_heads(spark, sf):
    """The first paragraph of each prompt, helpers' definitions included in what follows it."""
    p = jobs.build_prompts(view(spark, sf, "code_lines"), size=20, overlap=4)
    return p.select("repo", "path", "part", "first", "last", F.substring_index("prompt", "\n\n", 1).alias("head"))


#: The map of a file, over code with names told apart; protections are listed in the order of their names.
MAP_SQL = rf"""{CALLS_SQL}, {JS_SQL}, {PYTHON_SQL.removeprefix(GUARDS_SQL + ", ")}, {IMPORTS_SQL}, {DEFS_SQL},
    php AS (SELECT repo, path, min(line) AS line FROM code_lines WHERE {FAMILY_SQL} = 'php' AND regexp_matches(text, '\$_(GET|POST|REQUEST|COOKIE|FILES)\b') GROUP BY ALL),
    entry_guards AS (SELECT repo, path, start AS line, guard FROM js_guards UNION SELECT repo, path, line, guard FROM used UNION SELECT p.repo, p.path, p.line, g.guard FROM php p JOIN guards g USING (repo, path)),
    entry_rows AS (SELECT repo, path, line, 'handler' AS name, route FROM js_entries UNION ALL SELECT repo, path, line, name, route FROM ends UNION ALL SELECT repo, path, line, 'file', 'reads request input' FROM php),
    listed AS (SELECT e.*, {FAMILY_SQL} AS family, coalesce((SELECT string_agg(guard, ', ' ORDER BY guard) FROM entry_guards g WHERE g.repo = e.repo AND g.path = e.path AND g.line = e.line), 'none found') AS shown FROM entry_rows e),
    mine AS (SELECT repo, path, 'Entry points here:' || chr(10) || string_agg('- line ' || line || ': ' || route || ' (' || name || '), protected by: ' || shown, chr(10) ORDER BY line) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS k FROM listed) x WHERE k <= 20 GROUP BY ALL),
    all_files AS (SELECT DISTINCT repo, path, {FAMILY_SQL} AS family FROM code_lines WHERE {FAMILY_SQL} IS NOT NULL),
    peer_count AS (SELECT f.repo, f.path, f.family, count(*) AS peers FROM all_files f JOIN listed e ON e.repo = f.repo AND e.family = f.family AND e.path <> f.path GROUP BY ALL HAVING count(*) >= 2),
    peer_used AS (SELECT f.repo, f.path, f.family, f.peers, g.guard, count(*) AS uses, count(DISTINCT g.path) AS n_files FROM peer_count f JOIN (SELECT *, {FAMILY_SQL} AS family FROM entry_guards) g ON g.repo = f.repo AND g.family = f.family AND g.path <> f.path GROUP BY ALL),
    once_at AS (SELECT repo, family, name, min(path || ':' || line) AS seen_at FROM defs GROUP BY ALL HAVING count(*) = 1),
    theirs AS (SELECT repo, path, 'Elsewhere ' || any_value(peers) || ' entry points of this kind use:' || chr(10) || string_agg('- ' || guard || ': ' || uses || ' uses in ' || n_files || ' files' || coalesce('; see ' || seen_at, ''), chr(10) ORDER BY uses DESC, guard) AS t
        FROM (SELECT u.*, o.seen_at, row_number() OVER (PARTITION BY u.repo, u.path ORDER BY uses DESC, guard) AS k FROM peer_used u LEFT JOIN once_at o ON o.repo = u.repo AND o.family = u.family AND o.name = split_part(regexp_replace(u.guard, '[()]+$', ''), '.', -1)) x WHERE k <= 10 GROUP BY repo, path),
    once_def AS (SELECT repo, family, name, min(path) AS "where", min(line) AS "at" FROM defs GROUP BY ALL HAVING count(*) = 1),
    called_defs AS (SELECT repo, path, name, ord, "where", "at" FROM (SELECT c.repo, c.path, c.name, o."where", o."at", row_number() OVER (PARTITION BY c.repo, c.path ORDER BY NOT regexp_matches(c.name, {quoted(defs.GUARD_WORD)}), c.first) AS ord FROM (SELECT *, {FAMILY_SQL} AS family FROM called) c
        JOIN once_def o ON c.repo = o.repo AND c.family = o.family AND c.name = o.name AND o."where" <> c.path ANTI JOIN imported i ON i.repo = c.repo AND i.path = c.path AND i.name = c.name) x WHERE ord <= 6),
    file_size AS (SELECT repo, path, max(line) AS n FROM code_lines GROUP BY ALL),
    called_bodies AS (SELECT h.repo, h.path, h.name, h.ord, h."where", string_agg(lpad(c.line::VARCHAR, length(least(h."at" + 23, s.n)::VARCHAR)::INT, ' ') || '| ' || c.text, chr(10) ORDER BY c.line) AS body
        FROM called_defs h JOIN code_lines c ON c.repo = h.repo AND c.path = h."where" AND c.line BETWEEN h."at" AND h."at" + 23 JOIN file_size s ON s.repo = h.repo AND s.path = h."where" GROUP BY h.repo, h.path, h.name, h.ord, h."where", h."at"),
    called_text AS (SELECT repo, path, 'Functions that it calls, defined elsewhere:' || chr(10) || string_agg('--- ' || name || ' in ' || "where" || ' ---' || chr(10) || body, chr(10) || chr(10) ORDER BY ord) AS t FROM called_bodies GROUP BY ALL),
    maps AS (SELECT repo, path, 'Map of the repository, made by pattern matching. Use it to compare; cite `' || path || '` alone. A missing protection counts only where this entry point needs it.' || chr(10) || '<repo_data>' || chr(10) || body || chr(10) || '</repo_data>' AS map
        FROM (SELECT f.repo, f.path, concat_ws(chr(10) || chr(10), m.t, p.t, c.t) AS body FROM all_files f LEFT JOIN mine m USING (repo, path) LEFT JOIN theirs p USING (repo, path) LEFT JOIN called_text c USING (repo, path)) x WHERE body <> '')"""


def named_map(spark, sf):
    lines = called_code(spark, sf)
    return jobs.render_map(lines, entries=defs.entry_points(lines).withColumn("guards", F.array_sort("guards")))


@query(f"{NAMED}, {MAP_SQL} SELECT repo, path, map FROM maps")
def k3_render_map(spark, sf):
    return named_map(spark, sf)


HELPER_BLOCKS = HELPERS_SQL.removeprefix(f"{CODE}, {IMPORTS_SQL}, ") + """, helper_bodies AS (SELECT h.repo, h.path, h.name, h.ord, h."where", string_agg(lpad(c.line::VARCHAR, length(least(h."at" + 23, s.n)::VARCHAR)::INT, ' ') || '| ' || c.text, chr(10) ORDER BY c.line) AS body
        FROM helpers h JOIN code_lines c ON c.repo = h.repo AND c.path = h."where" AND c.line BETWEEN h."at" AND h."at" + 23 JOIN file_size s ON s.repo = h.repo AND s.path = h."where" WHERE h.ord <= 6 GROUP BY h.repo, h.path, h.name, h.ord, h."where", h."at"),
    helper_text AS (SELECT repo, path, string_agg('--- ' || name || ' in ' || "where" || ' ---' || chr(10) || body, chr(10) || chr(10) ORDER BY ord) AS t FROM helper_bodies GROUP BY ALL)"""


@query(f"""{PROMPT_SQL.replace(CODE, NAMED, 1)}, {MAP_SQL}, {HELPER_BLOCKS} SELECT p.repo, p.path, r.rank AS lead_rank, p.part, p.first, p.last, concat_ws(chr(10) || chr(10), 'File under review: `' || p.path || '`.' || CASE WHEN n <= 20 THEN '' ELSE ' Lines ' || p.first || '-' || p.last || ' of ' || n || '; the other lines have prompts of their own.' END,
    'Lines that match known patterns (hints only; check them, and look beyond them):' || chr(10) || x.t, '<repo_data>' || chr(10) || '--- ' || p.path || ' ---' || chr(10) || c.t || chr(10) || '</repo_data>',
    'Helpers that it imports, as background (cite `' || p.path || '` only):' || chr(10) || '<repo_data>' || chr(10) || h.t || chr(10) || '</repo_data>', m.map, {quoted(jobs.WALKTHROUGH)}) AS prompt
    FROM parts p JOIN code c USING (repo, path, part) JOIN (SELECT repo, path, {LEAD_RANK}::INT AS rank FROM leads) r USING (repo, path) LEFT JOIN pointers x USING (repo, path, part) LEFT JOIN helper_text h USING (repo, path) LEFT JOIN maps m USING (repo, path)""")
def k2_prompts_with_context(spark, sf):
    """Prompts with everything: hints, stripped comments, helpers and the map."""
    return jobs.build_prompts(called_code(spark, sf), "walkthrough", True, named_map(spark, sf), 20, 4)


@query(f"""{CODE}, {CALLS_SQL}, {JS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS ord FROM js_entries)
    SELECT repo, path, 'Entry points here:' || chr(10) || string_agg('- line ' || line || ': ' || route || ' (handler), protected by: ' || CASE WHEN guards = '' THEN 'none found' ELSE replace(guards, ',', ', ') END, chr(10) ORDER BY ord) AS mine FROM e WHERE ord <= 20 GROUP BY ALL""")
def k3_own_entries(spark, sf):
    entries = defs.js_entries(view(spark, sf, "code_lines"))
    return jobs.own_entries(entries.withColumn("guards", F.array_sort("guards")))


@query(f"""{PROMPT_SQL}, said AS (SELECT repo, path, part, len(regexp_extract_all(t, 'eval\\(expr\\)')) AS n FROM code)
    SELECT repo, path, part, CASE WHEN n < 2 THEN n::VARCHAR END AS content, CASE WHEN n >= 2 THEN 'ValueError: too much' END AS error FROM said""")
def j1_review_prompts(spark, sf):
    """A scripted client counts the calls of eval in the code that it is shown; on two or more it fails, on its row alone."""
    prompts = jobs.build_prompts(view(spark, sf, "code_lines"), strip_comments=True, size=20, overlap=4, helpers=False)

    def factory():
        def client(prompt):
            n = prompt.count("eval(expr)")
            if n >= 2:
                raise ValueError("too much")
            return str(n)

        return client

    return jobs.review_prompts(prompts, factory).select("repo", "path", "part", "content", "error")


SEEDED_SQL = f"""{with_views('code_lines', 'truth')}, {TWIN_SQL}, fitting AS (SELECT t.* FROM truth t JOIN anchor_hits USING (repo, id) WHERE is_decoy OR n = 1), {lexicon_sql('code_lines')}, {{later}},
    {REGIONS_SQL}, later_regions AS (SELECT t.id, t.repo, t.path, t.cwe, t.cwe2, t.is_decoy, greatest(1, min(c.line) - t.radius) AS start_line, min(c.line) + t.radius AS end_line FROM truth t JOIN twin c ON t.repo = c.repo AND t.path = c.path AND contains(c.text, CASE WHEN t.is_decoy THEN t.anchor ELSE t.new END) GROUP BY t.id, t.repo, t.path, t.cwe, t.cwe2, t.is_decoy, t.radius HAVING count(*) = 1),
    found AS (SELECT 0 AS side, repo, path, line, cwe FROM hits WHERE class <> 'request handler' GROUP BY ALL UNION ALL SELECT 1, repo, path, line, cwe FROM hits_later WHERE class <> 'request handler' GROUP BY ALL),
    met AS (SELECT f.*, r.id, r.is_decoy, row_number() OVER (PARTITION BY f.side, f.repo, f.path, f.line, f.cwe ORDER BY coalesce(f.cwe IN (r.cwe, r.cwe2), false) DESC, r.is_decoy, r.id) AS n FROM found f LEFT JOIN (SELECT 0 AS side, * FROM regions UNION ALL SELECT 1, * FROM later_regions) r ON r.side = f.side AND r.repo = f.repo AND r.path = f.path AND f.line BETWEEN r.start_line AND r.end_line),
    both_matches AS (SELECT side, repo, id AS item, CASE WHEN is_decoy THEN 2 WHEN NOT is_decoy THEN side END AS kind FROM met WHERE n = 1)""".replace(
    "{later}", lexicon_sql("twin").replace("hits AS", "hits_later AS", 1)
)


FITTING_SUMMARY = SUMMARY_SQL.replace("FROM truth", "FROM fitting")


@query(f"""{SEEDED_SQL}, matches AS (SELECT repo, item, kind FROM both_matches WHERE side = 0), {SUMMARY_SQL} SELECT {SCORE_SQL.format(weak='weak', fixed='0')}""")
def k5_eval_seeded(spark, sf):
    return flat_score(jobs.eval_seeded(view(spark, sf, "code_lines"), truth(spark, sf), every=True)[0])


@query(f"""{SEEDED_SQL}, matches AS (SELECT repo, item, kind FROM both_matches WHERE side = 1), {FITTING_SUMMARY} SELECT {SCORE_SQL.format(weak='0', fixed='weak')}""")
def k5_eval_twin(spark, sf):
    return flat_score(jobs.eval_seeded(view(spark, sf, "code_lines"), truth(spark, sf))[1])


@query(f"""{SEEDED_SQL}, s AS (SELECT t.repo, EXISTS (SELECT 1 FROM both_matches m WHERE m.item = t.id AND m.side = 0 AND m.kind = 0) AS d, EXISTS (SELECT 1 FROM both_matches m WHERE m.item = t.id AND m.side = 1 AND m.kind = 1) AS s FROM truth t WHERE NOT t.is_decoy)
    SELECT repo, count(*) AS weaknesses, count(*) FILTER (WHERE d) AS found, count(*) FILTER (WHERE s) AS still, count(*) FILTER (WHERE d AND NOT s) AS correct, correct / weaknesses AS pair_accuracy FROM s GROUP BY repo""")
def k5_eval_pairs_of_trees(spark, sf):
    return jobs.eval_seeded(view(spark, sf, "code_lines"), truth(spark, sf), every=True)[2]


@query(f"{with_views('code_lines', 'truth')}, {TWIN_SQL} SELECT repo, t.id, 0 AS step, path FROM truth t JOIN anchor_hits USING (repo, id) WHERE NOT is_decoy AND n <> 1")
def k5_eval_errors(spark, sf):
    """Weaknesses whose fix doesn't apply."""
    return jobs.eval_seeded(view(spark, sf, "code_lines"), truth(spark, sf))[3]


@query(f"""{with_views('code_lines', 'truth')}, {TWIN_SQL}, weak AS (SELECT u.*, row_number() OVER (PARTITION BY u.repo ORDER BY u.id) % 5 AS m FROM usable u WHERE NOT is_decoy), done AS (SELECT * FROM weak WHERE m < 3),
    folded AS (SELECT c.repo, c.path, string_agg(CASE WHEN d.id IS NULL THEN c.text ELSE d.new || ' again' END, chr(10) ORDER BY c.line) AS content FROM code_lines c LEFT JOIN done d ON d.repo = c.repo AND d.path = c.path AND d.anchor = c.text GROUP BY ALL)
    SELECT repo, path, md5(content) AS digest, NULL AS id, NULL::INT AS step FROM folded UNION ALL SELECT repo, path, '', id, 2 FROM weak WHERE m >= 3 UNION ALL SELECT repo, 'none.py', '', id, 1 FROM weak WHERE m = 3""")
def h7_fix_steps(spark, sf):
    """Fixes of three steps, each on what the one before left; some name a file that isn't there or a text that is gone, and change nothing."""
    lines, items = view(spark, sf, "code_lines"), truth(spark, sf)
    weak = items.join(intervals.anchor_regions(items, lines).select("repo", "path", "id"), ["repo", "path", "id"], "left_semi").where("not is_decoy")
    weak = ranks.ranked_by_range(weak, ["repo"], ["id"], "k")
    kind = F.col("k") % 5
    gone, lost = F.col("m") == 3, F.col("m") == 4
    step = lambda file, old, new: F.struct(file.alias("file"), old.alias("old"), new.alias("new"))
    own, new = F.lit(None).cast("string"), F.col("new")
    last = step(own, F.concat(F.when(lost, "no such ").otherwise(""), new, F.lit(" more")), F.concat(new, F.lit(" again")))
    steps = F.array(step(own, F.col("old"), new), step(F.when(gone, "none.py"), new, F.concat(new, F.lit(" more"))), last)
    tree, errors = score.fixed_tree(train.file_texts(lines), score.fix_steps(weak.withColumn("m", kind).withColumn("fix", steps)))
    done = tree.select("repo", "path", F.md5(F.col("content").cast("binary")).alias("digest"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("step"))
    return done.unionByName(errors.select("repo", "path", F.lit("").alias("digest"), "id", "step"))


TEACHER_SQL = f"""{ANSWERS}, {PARSED_SQL}, last AS (SELECT p.repo || '/' || p.fid AS name, p.*, sk % 41 = 0 AS again, coalesce(t.valid, false) AS whole FROM parsed p LEFT JOIN typed t ON t.repo = p.repo AND t.fid = p.fid AND t.ord = 0),
    judged AS (SELECT *, CASE WHEN again THEN 'analysis missing' WHEN error IS NOT NULL THEN {quoted(train.INVALID)} WHEN sk % 37 = 0 THEN 'analysis missing' WHEN sk % 31 = 0 THEN 'key mentioned' WHEN pk % 3 = 0 THEN 'ok' WHEN NOT whole OR sk % 7 = 1 OR pk % 5 = 0 THEN {quoted(train.NOTHING_KEPT)} ELSE 'ok' END AS status, pk % 3 <> 0 AS real FROM last)"""


def teacher(spark, sf):
    """A log of answers with a second attempt for some names."""
    a = view(spark, sf, "answers")
    one = a.select("repo", F.concat("repo", F.lit("/"), "fid").alias("name"), F.lit(1).alias("attempt"), (F.col("pk") % 3 != 0).alias("real"), F.when(F.col("pk") % 5 == 0, F.array(F.lit("CWE-1"))).otherwise(F.array("cwe")).alias("classes"), F.lit("p").alias("prompt"), "content", "truncated", "sk")
    again = one.where("sk % 41 = 0").withColumns({"attempt": F.lit(2), "content": F.lit("{}"), "truncated": F.lit(False)})
    return one.unionByName(again).drop("sk")


@query(f"""{TEACHER_SQL} SELECT status, count(*) AS n, count(*) FILTER (WHERE real) AS n_real FROM judged GROUP BY status""")
def k9_training_statuses(spark, sf):
    return jobs.build_training(teacher(spark, sf), view(spark, sf, "code_lines"), "Review.", "v")[1]


@query(f"""{TEACHER_SQL}, ok AS (SELECT *, row_number() OVER (ORDER BY md5('v' || name), name) <= greatest(1, count(*) OVER () // 10) AS valid FROM judged WHERE status = 'ok')
    SELECT repo, name, CASE WHEN valid THEN 'valid' ELSE 'train' END AS side, real::INT AS n_kept, CASE WHEN real THEN quote ELSE '' END AS quote, 3 AS messages FROM ok""")
def k9_build_training(spark, sf):
    records = jobs.build_training(teacher(spark, sf), view(spark, sf, "code_lines"), "Review.", "v")[0]
    quote = F.get(F.get("kept", F.lit(0))["evidence"], F.lit(0))["quote"]
    said = F.from_json("record", "messages array<struct<role:string,content:string>>")["messages"]
    return records.select("repo", "name", "side", F.size("kept").alias("n_kept"), F.coalesce(quote, F.lit("")).alias("quote"), F.size(said).alias("messages"))


@query(f"""{TEACHER_SQL}, n AS (SELECT count(*) AS teacher_rows, count(*) FILTER (WHERE status = 'ok') AS accepted, count(*) FILTER (WHERE status = 'ok' AND real) AS accepted_real FROM judged) SELECT *, accepted - greatest(1, accepted // 10) AS train, greatest(1, accepted // 10) AS valid FROM n""")
def k9_dataset_summary(spark, sf):
    return jobs.build_training(teacher(spark, sf), view(spark, sf, "code_lines"), "Review.", "v")[2]


@query(f"""{TEACHER_SQL} SELECT repo, name, status, CASE WHEN status = 'ok' THEN real::INT END AS n_kept FROM judged""")
def b19_accept_answers(spark, sf):
    valid = train.parsed_teacher(teacher(spark, sf))
    checked_ = citations.check_citations(train.teacher_evidence(valid), view(spark, sf, "code_lines"))
    return train.accept_answers(train.with_verified(valid, checked_)).select("repo", "name", "status", F.size("kept").alias("n_kept"))


@query(f"""{with_views('findings', 'modules')}, {MODULES_SQL}, s AS (SELECT m.id, r.repo, coalesce(bool_or(flagged), false) AS v, coalesce(bool_or(flagged AND fid LIKE '%1'), false) AS s
        FROM modules m CROSS JOIN (SELECT DISTINCT repo FROM findings) r LEFT JOIN flags f ON f.module = m.id AND f.repo = r.repo GROUP BY m.id, r.repo),
    o AS (SELECT f.repo, count(*) FILTER (WHERE NOT coalesce(x.flagged, false)) AS ov, count(*) FILTER (WHERE NOT coalesce(x.flagged, false) AND f.fid LIKE '%1') AS os FROM findings f LEFT JOIN flags x ON f.repo = x.repo AND f.fid = x.fid GROUP BY f.repo)
    SELECT repo, count(*) AS modules, count(*) FILTER (WHERE v) AS detected, count(*) FILTER (WHERE s) AS secure_flagged, count(*) FILTER (WHERE v AND NOT s) / count(*) AS pair_accuracy, any_value(ov) AS other_findings_vulnerable, any_value(os) AS other_findings_secure FROM s JOIN o USING (repo) GROUP BY repo""")
def k6_eval_pairs(spark, sf):
    f, ev = view(spark, sf, "findings"), view(spark, sf, "evidence")
    later = "fid like '%1'"
    return jobs.eval_pairs((f, ev), (f.where(later), ev.where(later)), repo_modules(spark, sf))


@query(rf"""{CODE}, {PAIRS_SQL}, code AS (SELECT repo, k, 'm' || (k // 2) AS module, k % 2 = 0 AS low, line, text FROM k), c2 AS (SELECT repo, module AS path, line, text, low FROM code), {lexicon_sql('c2').replace('SELECT repo, path,', 'SELECT low, repo, path,')},
    f AS (SELECT DISTINCT low, repo, path AS module, line, cwe FROM hits WHERE class <> 'request handler'),
    per AS (SELECT repo, module, coalesce(bool_or(low AND cwe IN ('CWE-89', 'CWE-94')), false) AS v, coalesce(bool_or(NOT low AND cwe IN ('CWE-89', 'CWE-94')), false) AS s FROM (SELECT DISTINCT repo, module FROM code) m LEFT JOIN f USING (repo, module) GROUP BY ALL),
    o AS (SELECT repo, count(*) FILTER (WHERE low AND cwe NOT IN ('CWE-89', 'CWE-94')) AS ov, count(*) FILTER (WHERE NOT low AND cwe NOT IN ('CWE-89', 'CWE-94')) AS os FROM f GROUP BY repo)
    SELECT repo, count(*) AS modules, count(*) FILTER (WHERE v) AS detected, count(*) FILTER (WHERE s) AS secure_flagged, count(*) FILTER (WHERE v AND NOT s) / count(*) AS pair_accuracy, coalesce(any_value(ov), 0) AS other_findings_vulnerable, coalesce(any_value(os), 0) AS other_findings_secure FROM per LEFT JOIN o USING (repo) GROUP BY repo""")
def k6_review_pairs(spark, sf):
    """Both versions of each module under neutral names, reviewed by patterns."""
    files, modules = module_files(spark, sf)
    return jobs.review_pairs(files, modules, "low.src", "high.src")[0]


@query(f"""{with_views('findings', 'evidence', 'items', 'changes')}, {ITEM_SQL}, s AS (SELECT i.id, coalesce(bool_or(own), false) AS d, coalesce(bool_or(own AND sk % 2 = 0), false) AS f, count(*) FILTER (WHERE NOT own) AS ov, count(*) FILTER (WHERE NOT own AND sk % 2 = 0) AS os FROM items i LEFT JOIN item_findings f ON i.id = f.id GROUP BY i.id)
    SELECT count(*) AS items, count(*) FILTER (WHERE d) AS detected, count(n.id) AS detected_at_change, count(*) FILTER (WHERE f) AS fixed_flagged, count(*) FILTER (WHERE d AND NOT f) / count(*) AS pair_accuracy, sum(ov)::BIGINT AS other_findings_vulnerable, sum(os)::BIGINT AS other_findings_fixed FROM s LEFT JOIN near n ON s.id = n.id""")
def k7_eval_real(spark, sf):
    return jobs.eval_real(citations_of(spark, sf), citations_of(spark, sf, "sk % 2 = 0"), real_items(spark, sf), all_changes(spark, sf))


@query(r"""WITH d AS (SELECT o_orderkey AS item, 'repo' || o_custkey % 20 AS repo, o_custkey AS c FROM orders)
    SELECT item, repo, 'x.py' AS path, c::INT AS start_line, (CASE item % 3 WHEN 0 THEN c + 1 WHEN 1 THEN c ELSE c + 3 END)::INT AS end_line FROM d UNION ALL SELECT item, repo, 'x.py', (c + 40)::INT, (c + 41)::INT FROM d""")
def k7_changes_of_diffs(spark, sf):
    items = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("repo"), (F.col("o_custkey") % 20).cast("string")).alias("repo"))
    return jobs.changes_of_diffs(view(spark, sf, "diffs"), items)


CASE_SCORE_SQL = """n AS (SELECT category, count(*) FILTER (WHERE real) AS n_real, count(*) FILTER (WHERE NOT real) AS n_fake, count(*) FILTER (WHERE real AND flagged) AS tp, count(*) FILTER (WHERE NOT real AND flagged) AS fp FROM f GROUP BY ROLLUP (category))
    SELECT *, coalesce(tp / nullif(n_real, 0), 0) AS tpr, coalesce(fp / nullif(n_fake, 0), 0) AS fpr, coalesce(tp / nullif(n_real, 0), 0) - coalesce(fp / nullif(n_fake, 0), 0) AS score FROM n"""


@query(f"{with_views('code_lines', 'findings')}, {CASES_SQL}, f AS (SELECT * FROM flagged WHERE name::INT % 2 = 0), {CASE_SCORE_SQL}")
def k8_eval_cases(spark, sf):
    cases = file_cases(spark, sf)
    return jobs.eval_cases(citations_of(spark, sf), cases, cases.where(F.col("name").cast("int") % 2 == 0).select("name"))


@query(f"{with_views('code_lines', 'findings')}, {CASES_SQL}, f AS (SELECT * FROM flagged WHERE NOT failed), {CASE_SCORE_SQL}")
def k8_answered_only(spark, sf):
    return jobs.eval_cases(citations_of(spark, sf), file_cases(spark, sf), answered_only=True)


@query(f"""{with_views('runs')}, {RUN_FILES_SQL}, per AS (SELECT config, c, seed, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE found AND NOT correct) AS still, count(*) FILTER (WHERE correct) AS right_, sum(n) AS n, count(*) AS items FROM i GROUP BY ALL),
    m AS (SELECT config, seed, unnest(['found', 'decoys flagged', 'patched still flagged', 'errors', 'seconds']) AS metric, unnest([found::DOUBLE, 0, still, 1, n + 0.5]) AS value FROM per WHERE c < 2
        UNION ALL SELECT config, seed, unnest(['detected', 'secure flagged', 'pairs correct', 'errors', 'seconds']), unnest([found::DOUBLE, 1, right_, 2, 3]) FROM per WHERE c IN (2, 3)
        UNION ALL SELECT config, seed, unnest(['detected', 'detected at change', 'fixed flagged', 'pairs correct', 'other findings, vulnerable', 'other findings, fixed', 'errors', 'largest prompt (tokens)', 'seconds']), unnest([found::DOUBLE, found, (SELECT count(*) FROM r WHERE r.config = per.config AND r.seed = per.seed AND r.value <= 10), right_, n, 0, 2 * items, 0, 3.0 * items]) FROM per WHERE c = 4)
    SELECT config AS model, metric, count(*) AS runs, avg(value) AS mean, min(value) AS low, max(value) AS high FROM m GROUP BY ALL""")
def k11_summarise_runs(spark, sf):
    m = jobs.summarise_runs(run_files(spark, sf))[0]
    return m.select(F.get_json_object("config", "$.model").alias("model"), "metric", "runs", "mean", "low", "high")


@query(f"""{with_views('runs')}, {RUN_FILES_SQL}, ids AS (SELECT DISTINCT item FROM i WHERE c < 2 AND found), seeds AS (SELECT DISTINCT config, c, seed FROM i),
    every AS (SELECT s.config, s.seed, ids.item, coalesce(i.found, false) AS found, coalesce(i.correct, false) AS correct FROM seeds s CROSS JOIN ids LEFT JOIN i ON i.config = s.config AND i.seed = s.seed AND i.item = ids.item WHERE s.c < 2 UNION ALL SELECT config, seed, item, found, correct FROM i WHERE c >= 2)
    SELECT config AS model, item, count(*) AS runs, count(*) FILTER (WHERE found) AS found, count(*) FILTER (WHERE correct) AS correct FROM every GROUP BY ALL""")
def k11_item_stability(spark, sf):
    m = jobs.summarise_runs(run_files(spark, sf))[1]
    return m.select(F.get_json_object("config", "$.model").alias("model"), "item", "runs", "found", "correct")


@query(SIGNALS_SQL.replace("signals AS (SELECT", "first_side AS (SELECT f.sk, ", 1).replace("JOIN flow USING (repo, fid))", "JOIN flow USING (repo, fid)), signals AS (SELECT is_true, s0, s1, s2, s3 FROM first_side UNION ALL SELECT false, s0, s1, s2, s3 FROM first_side WHERE sk % 5 = 0)", 1))
def k12_signal_job(spark, sf):
    """The tree, and its twin, in which a fifth of the findings are still made and none is true."""
    f, ev, scanner = judged_findings(spark, sf).where("tier <> 'rejected'"), view(spark, sf, "evidence"), view(spark, sf, "scanner")
    twin = intervals.truth_regions(truth(spark, sf).withColumn("patched_anchor", F.col("anchor")), view(spark, sf, "code_lines"), True)
    return jobs.signal_job((f, ev, scanner, regions(spark, sf)), (f.where("sk % 5 = 0"), ev, scanner, twin))


# Jobs from sources to results, on a labelled case for each file of the code under svc1 and svc2; the rest are helpers.

CASE_ROWS_SQL = rf"""k AS (SELECT repo, path, min(regexp_extract(path, '/f(\d+)\.', 1)::INT) AS n, bool_or(t = 24) AS evals FROM code_lines GROUP BY ALL),
    cases AS (SELECT *, repo || ':' || path AS name, n % 14 AS cat, n % 3 > 0 AS real FROM k WHERE split_part(path, '/', 1) IN ('svc1', 'svc2'))"""


def case_rows(spark, sf):
    files = view(spark, sf, "code_lines").select("repo", "path").distinct().where("split(path, '/')[0] in ('svc1', 'svc2')")
    n = F.regexp_extract("path", r"/f(\d+)\.", 1).cast("int")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), n % 14 + 1)
    classes = F.when(n % 2 == 0, F.array(F.lit("CWE-94"), F.lit("CWE-1"))).otherwise(F.array(F.lit("CWE-2")))
    return files.withColumns({"name": F.concat_ws(":", "repo", "path"), "category": category, "real": n % 3 > 0, "cwe": n % 900, "classes": classes})


def folded_cases(lines):
    """Case files in a folder of their own, helpers in another."""
    return lines.withColumn("path", F.when(F.substring_index("path", "/", 1).isin("svc1", "svc2"), F.concat(F.lit("testcode/"), "path")).otherwise(F.concat(F.lit("helpers/"), "path")))


def scripted_teacher():
    """A teacher that reports each line that evaluates text, and is silent on a prompt that shows none."""

    def client(prompt):
        path, found = prompt.split("`")[1], []
        for row in prompt.split("<repo_data>")[1].split("\n"):
            number, _, text = row.partition("| ")
            if "eval(" in text:
                found.append({"title": "evaluates text", "cwe": 94, "summary": "s", "evidence": [{"path": path, "start_line": number, "end_line": int(number), "quote": row, "role": "sink"}]})
        return json.dumps({"analysis": ["the file is read"], "findings": found})

    return client


@query(f"""{CODE}, {CASE_ROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cat, real ORDER BY md5('7' || name), name) AS k, least(3, count(*) OVER (PARTITION BY cat, real) // 3) AS held FROM cases),
    judged AS (SELECT repo, name, CASE WHEN NOT real OR (evals AND n % 2 = 0) THEN 'ok' ELSE {quoted(train.NOTHING_KEPT)} END AS status FROM r WHERE k > held AND k <= held + 6), ok AS (SELECT *, row_number() OVER (ORDER BY md5('7' || name), name) <= greatest(1, count(*) OVER () // 10) AS first FROM judged WHERE status = 'ok')
    SELECT status, count(*) AS n, (SELECT count(*) FILTER (WHERE first) FROM ok) AS valid, (SELECT count(*) FROM ok) AS records FROM judged GROUP BY status""")
def k9_training_job(spark, sf):
    """From the key and the sources to the records: split, neutral tree, prompts with labels, logged answers, filter, sides."""
    lines = folded_cases(view(spark, sf, "code_lines").select("repo", "path", "line", "text"))
    cases = case_rows(spark, sf).withColumn("path", F.concat(F.lit("testcode/"), "path"))
    records, counts, _ = evaluations.training_job(lines, cases, scripted_teacher, folder(spark, "answers"), "Review.", "7", 6, 3)
    side = records.agg(F.count_if(F.col("side") == "valid").alias("valid"), F.count("*").alias("records"))
    return counts.select("status", "n").join(F.broadcast(side))  # one row


@query(f"""{CODE}, {CASE_ROWS_SQL}, f AS (SELECT cat, real, evals AND n % 2 = 0 AS flagged FROM cases WHERE n % 5 <> 0), {{n}} SELECT * FROM n""".replace("{n}", "n AS (SELECT cat, count(*) FILTER (WHERE real) AS n_real, count(*) FILTER (WHERE NOT real) AS n_fake, count(*) FILTER (WHERE real AND flagged) AS tp, count(*) FILTER (WHERE NOT real AND flagged) AS fp FROM f GROUP BY ROLLUP (cat))"))
def k8_cases_job(spark, sf):
    """The held-out cases reviewed in their neutral tree, and scored."""
    lines = folded_cases(view(spark, sf, "code_lines").select("repo", "path", "line", "text"))
    cases = case_rows(spark, sf).withColumn("path", F.concat(F.lit("testcode/"), "path"))
    names = cases.where(F.regexp_extract("path", r"/f(\d+)\.", 1).cast("int") % 5 != 0).select("name")
    rates = evaluations.cases_job(lines, cases, scripted_teacher, names)
    number = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")) - 1
    return rates.select(number.alias("cat"), "n_real", "n_fake", "tp", "fp")


@query(f"""{with_views('code_lines', 'items', 'changes')}, fixed_lines AS (SELECT * REPLACE (CASE WHEN t IN (24, 4) AND sk % 2 = 0 THEN 'safe()' ELSE text END AS text) FROM code_lines), {lexicon_sql('code_lines')}, {lexicon_sql('fixed_lines').replace('hits AS', 'hits_fixed AS', 1)},
    v AS (SELECT DISTINCT i.id, h.repo, h.path, line, cwe, cwe IN ('CWE-89', 'CWE-22', 'CWE-94') AS own FROM hits h JOIN items i ON i.repo = h.repo AND i.path = h.path WHERE class <> 'request handler'),
    w AS (SELECT DISTINCT i.id, line, cwe, cwe IN ('CWE-89', 'CWE-22', 'CWE-94') AS own FROM hits_fixed h JOIN items i ON i.repo = h.repo AND i.path = h.path WHERE class <> 'request handler'),
    near AS (SELECT DISTINCT v.id FROM v JOIN changes c ON c.item = v.id AND c.path = v.path AND v.line - 3 <= c.end_line AND v.line + 3 >= c.start_line WHERE own),
    s AS (SELECT i.id, EXISTS (SELECT 1 FROM v WHERE v.id = i.id AND own) AS d, EXISTS (SELECT 1 FROM w WHERE w.id = i.id AND own) AS f, (SELECT count(*) FROM v WHERE v.id = i.id AND NOT own) AS ov, (SELECT count(*) FROM w WHERE w.id = i.id AND NOT own) AS ow FROM items i)
    SELECT 2 AS runs, count(*) FILTER (WHERE d)::DOUBLE AS detected, (SELECT count(*) FROM near)::DOUBLE AS detected_at_change, count(*) FILTER (WHERE f)::DOUBLE AS fixed_flagged, count(*) FILTER (WHERE d AND NOT f) / count(*) AS pair_accuracy, sum(ov)::DOUBLE AS other_findings_vulnerable, sum(ow)::DOUBLE AS other_findings_fixed FROM s""")
def k7_real_job(spark, sf):
    """Both sides of the fixes reviewed by patterns, in two runs; the means."""
    lines = view(spark, sf, "code_lines")
    fixed = lines.withColumn("text", F.when(F.col("t").isin(24, 4) & (F.col("sk") % 2 == 0), "safe()").otherwise(F.col("text")))
    plain = lambda df: df.select("repo", "path", "line", "text")
    runs = [(seed, findings.pattern_review) for seed in (7, 8)]
    return evaluations.real_job(plain(lines), plain(fixed), real_items(spark, sf), all_changes(spark, sf), runs)[1].drop("pair_accuracy_per_run")
