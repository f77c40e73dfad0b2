"""Derived tables: source code, findings, truth and logs made from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reviewlake.sources.storage import stored

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: The text of a code line by l_partkey % 32; {a}, {b}, {s} are l_suppkey % 10, l_suppkey % 40, l_suppkey.
TEMPLATES = [
    "import os",
    "from .helpers import clean_{a}",
    "def clean_{a}(value):",
    "def handler_{b}(request):",
    '    rows = db.execute("SELECT * FROM t WHERE k = " + q)',
    '    os.system("ping " + host)',
    "    digest = hashlib.md5(body).hexdigest()",
    '    password = "hunter{s}secret"',
    "    return clean_{a}(value)",
    '@bp.get("/r{b}")',
    "@login_required",
    "router.get('/j{b}', requireUser, (req, res) => {",
    "    if record.owner_id == g.user.id:",
    "# reviewed {s}",
    "// note {s}",
    "",
    "    data = yaml.load(handle)",
    "    token = Math.random()",
    "const pick_{a} = (v) => v;",
    "    check_owner_{a}(thing, user)",
    "DEBUG = True",
    "    verify=False",
    '    return redirect(request.args["next"])',
    "    x{s} = {s}",
    "    eval(expr)",
    '    data = open(base + request.args["f"])',
    '    requests.get(request.args["u"])',
    "    node.innerHTML = value",
    "    env.from_string(body)",
    "    doc = etree.parse(handle)",
    "    Object.assign(req.user, req.body);",
    "    privileged: true",
]
#: The weakness that a template shows.
CWES = {4: 89, 5: 78, 6: 327, 7: 798, 16: 502, 17: 330, 20: 489, 21: 295, 22: 601, 24: 94, 25: 22, 26: 918, 27: 79, 28: 1336, 29: 611, 30: 915, 31: 250}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _text() -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(TEMPLATES))
    text = f"CASE l_partkey % 32 {cases} END"
    for mark, value in (("{a}", "l_suppkey % 10"), ("{b}", "l_suppkey % 40"), ("{s}", "l_suppkey")):
        text = f"replace({text}, '{mark}', cast({value} AS varchar(20)))"
    return text


def _cwe(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN 'CWE-{v}'" for k, v in CWES.items()) + " END"


V = "varchar(20)"


def _path(key: str) -> str:
    """A file for each customer; customers 2k and 2k + 1 share the path, in two repositories."""
    k = f"(({key} - {key} % 2) / 2)"
    k = f"cast({k} AS int)"
    return f"concat('svc', cast({k} % 7 AS {V}), '/app/f', cast({k} AS {V}), CASE {k} % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.php' WHEN 3 THEN '.py' ELSE '.txt' END)"


#: Name to SQL; a view may read the given tables and the views before it.
VIEWS = {
    "code_lines": f"""
        SELECT concat('repo', cast(o_custkey % 20 AS {V})) AS repo, {_path('o_custkey')} AS path,
               cast(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS int) AS line,
               {_text()} AS text, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, cast(l_partkey % 32 AS int) AS t
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "findings": f"""
        SELECT repo, path, concat(path, ':', cast(line AS {V})) AS fid, line, t, ok, pk, sk, {_cwe('t')} AS cwe,
               concat('weak point ', cast(t AS {V})) AS title,
               CASE pk % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
               CASE sk % 3 WHEN 0 THEN 'An attacker could reach this.' ELSE 'Input reaches the call.' END AS summary,
               CASE sk % 11 WHEN 0 THEN 'It is Possibly reachable.' ELSE 'The value is not checked.' END AS reasoning,
               CASE WHEN sk % 7 = 0 THEN line + 5 ELSE line END AS start_line,
               CASE WHEN sk % 7 = 1 THEN 'no such code anywhere' ELSE text END AS quote
        FROM code_lines WHERE ok % 3 = 0 AND {_cwe('t')} IS NOT NULL""",
    "evidence": """
        SELECT repo, fid, 0 AS ev_ord, path, start_line, start_line AS end_line, quote, CASE WHEN t = 31 THEN 'config' ELSE 'sink' END AS role FROM findings
        UNION ALL
        SELECT f.repo, f.fid, 1, f.path, l.line, l.line, concat('   7| ', l.text), CASE WHEN f.pk % 2 = 0 THEN 'source' ELSE 'context' END FROM findings f JOIN code_lines l ON f.repo = l.repo AND f.path = l.path AND l.line = f.line - 2""",
    "scanner": f"""
        SELECT repo, path, CASE WHEN line + (sk % 9) - 4 < 1 THEN 1 ELSE line + (sk % 9) - 4 END AS start_line, CASE WHEN line + (sk % 9) - 4 < 1 THEN 1 ELSE line + (sk % 9) - 4 END AS end_line, concat('rules.python.rule-', cast(t AS {V})) AS check_id, {_cwe('t')} AS cwe
        FROM code_lines WHERE ok % 2 = 0 AND {_cwe('t')} IS NOT NULL""",
    "truth": f"""
        SELECT concat('T', repo, '/', path, '-', cast(min(line) AS {V})) AS id, repo, path, text AS anchor, cast(1 + min(sk) % 4 AS int) AS radius, {_cwe('t')} AS cwe, CASE WHEN min(sk) % 2 = 0 THEN {_cwe('((t + 1) % 32)')} ELSE 'CWE-20' END AS cwe2,
               min(sk) % 5 = 0 AS is_decoy, CASE WHEN min(sk) % 3 = 0 THEN concat('    safe_', cast(min(line) AS {V}), '()') ELSE concat(text, '  # fixed') END AS new
        FROM code_lines WHERE {_cwe('t')} IS NOT NULL AND pk % 3 <> 1 GROUP BY repo, path, text, t""",
    "modules": f"""
        SELECT DISTINCT concat('svc', cast(c_custkey % 7 AS {V})) AS id, CASE c_custkey % 7 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-78' WHEN 2 THEN 'CWE-79' WHEN 3 THEN 'CWE-22' WHEN 4 THEN 'CWE-94' WHEN 5 THEN 'CWE-601' ELSE 'CWE-502' END AS cwe1, CASE c_custkey % 3 WHEN 0 THEN 'CWE-327' WHEN 1 THEN 'CWE-330' ELSE 'CWE-798' END AS cwe2
        FROM customer WHERE c_custkey % 21 < 7""",
    "items": "SELECT DISTINCT concat(repo, ':', path) AS id, repo, path FROM code_lines WHERE cast(pk % 97 AS int) = 3",
    "changes": "SELECT i.id AS item, c.repo, c.path, c.line AS start_line, c.line + 1 AS end_line FROM items i JOIN code_lines c ON i.repo = c.repo AND i.path = c.path WHERE c.line % 11 = 0",
    "cases": f"""
        SELECT concat('Case', cast(p_partkey AS {V})) AS name, cast(p_partkey % 14 AS int) AS cat, p_partkey % 3 <> 0 AS real, p_partkey AS pk FROM part""",
    "runs": f"SELECT concat('cfg', cast(user_id % 5 AS {V})) AS config, concat('run', cast(user_id % 3 AS {V})) AS run, event_type AS metric, user_id % 50 AS item, value, event_id FROM events",
    "answers": f"""
        SELECT fid, repo, path, title, cwe, severity, summary, start_line, quote, sk, pk, sk % 13 = 0 AS truncated,
               CASE WHEN sk % 17 = 0 THEN concat('```json\n', body, '\n```') WHEN sk % 19 = 0 THEN substring(body, 1, 30) WHEN sk % 97 = 0 THEN concat('[', body, ']') ELSE body END AS content
        FROM (SELECT *, concat('{{"analysis": ["', CASE WHEN sk % 37 = 0 THEN ' ' WHEN sk % 31 = 0 THEN 'According to the label it is safe.' ELSE 'the handler is read' END, '"], "findings": [{{"title": ',
            CASE WHEN sk % 53 = 0 THEN '""' WHEN sk % 59 = 0 THEN '7' ELSE concat('"', title, '"') END, ', "cwe": ', CASE WHEN sk % 61 = 0 THEN substring(cwe, 5, 9) WHEN sk % 67 = 0 THEN concat('["', cwe, '"]') ELSE concat('"', cwe, '"') END,
            CASE WHEN sk % 43 = 0 THEN '' ELSE concat(', "severity": "', CASE WHEN sk % 23 = 0 THEN 'huge' ELSE severity END, '"') END, ', "summary": "', summary, '", "tier": "confirmed"',
            CASE WHEN sk % 71 = 0 THEN ', "reasoning": null' ELSE '' END, ', "evidence": [{{"path": "', path, '", "start_line": ', CASE WHEN sk % 47 = 0 THEN concat('"', cast(start_line AS {V}), '"') WHEN sk % 73 = 0 THEN concat(cast(start_line AS {V}), '.0') WHEN sk % 79 = 0 THEN '0' WHEN sk % 83 = 0 THEN concat(cast(start_line AS {V}), '.5') ELSE cast(start_line AS {V}) END,
            ', "end_line": ', cast(start_line AS {V}), ', "quote": "12| ', replace(quote, '"', concat(chr(92), '"')), '"', CASE WHEN sk % 29 = 0 THEN '' ELSE ', "role": "sink"' END, '}}]}}, {{"title": "other"}}]}}') AS body FROM findings) x""",
    "log": f"""
        SELECT concat('n', cast(o_custkey AS {V})) AS name, o_orderkey AS attempt, CASE o_orderkey % 6 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'no analysis' ELSE 'ok' END AS status, o_custkey % 3 = 0 AS real FROM orders""",
    "advisories": f"""
        SELECT concat('GHSA-', cast(o_orderkey AS {V})) AS id, concat('own/Repo', cast(o_custkey AS {V})) AS repo, substring(cast(o_orderdate AS varchar(30)), 1, 10) AS published, o_orderkey % 9 = 0 AS withdrawn, CASE o_orderkey % 4 WHEN 0 THEN 'PIP' WHEN 1 THEN 'NPM' WHEN 2 THEN 'GO' ELSE 'PIP' END AS ecosystem,
               CASE o_custkey % 6 WHEN 0 THEN 89 WHEN 1 THEN 79 WHEN 2 THEN 862 WHEN 3 THEN 287 WHEN 4 THEN 400 ELSE 22 END AS cwe, CASE o_orderkey % 5 WHEN 0 THEN 89 WHEN 1 THEN 400 ELSE 862 END AS cwe2,
               concat('https://github.com/own/Repo', cast(o_custkey AS {V}), '/commit/abcdef', cast(1000000 + o_orderkey AS {V})) AS url1, CASE WHEN o_orderkey % 5 = 0 THEN concat('https://github.com/own/Repo', cast(o_custkey AS {V}), '/pull/7/commits/beef', cast(1000000 + o_orderkey AS {V})) ELSE 'https://example.org/note' END AS url2
        FROM orders""",
    "commit_files": f"""
        SELECT l_orderkey AS sha, CASE l_partkey % 5 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'tests/test_app.py' WHEN 2 THEN 'lib/view.js' WHEN 3 THEN 'README.md' ELSE 'pkg/mod.ts' END AS filename, CASE l_suppkey % 4 WHEN 0 THEN 'added' ELSE 'modified' END AS status, cast(l_quantity AS int) AS changes, l_orderkey % 10 <> 0 AS one_parent FROM lineitem""",
    "diffs": f"""
        SELECT o_orderkey AS diff, 1 AS n, '--- a/x.py' AS text FROM orders UNION ALL
        SELECT o_orderkey, 2, CASE WHEN o_orderkey % 6 = 0 THEN '+++ /dev/null' ELSE concat('+++ b/dir/f', cast(o_custkey AS {V}), '.py') END FROM orders UNION ALL
        SELECT o_orderkey, 3, CASE o_orderkey % 3 WHEN 0 THEN concat('@@ -', cast(o_custkey AS {V}), ',0 +3,2 @@') WHEN 1 THEN concat('@@ -', cast(o_custkey AS {V}), ' +4 @@ def f') ELSE concat('@@ -', cast(o_custkey AS {V}), ',4 +9,4 @@') END FROM orders UNION ALL
        SELECT o_orderkey, 4, '-- old line of SQL' FROM orders UNION ALL
        SELECT o_orderkey, 5, concat('@@ -', cast(o_custkey + 40 AS {V}), ',2 +60,1 @@') FROM orders""",
}
NEEDS = {"findings": ["code_lines"], "evidence": ["code_lines", "findings"], "scanner": ["code_lines"], "truth": ["code_lines"], "items": ["code_lines"], "changes": ["code_lines", "items"], "answers": ["code_lines", "findings"]}


def with_views(*names: str) -> str:
    """A WITH clause that defines the views and what they read; ends before the next common table."""
    wanted = {x for n in names for x in (*NEEDS.get(n, []), n)}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in VIEWS.items() if n in wanted)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Derived tables that other views read again and again: written once for each session and folder of tables.
STORED = ["code_lines", "findings", "evidence", "scanner", "truth"]
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def _written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _WRITTEN:
        _WRITTEN[key] = stored(_derived(spark, sf_dir, name), name)
    return _WRITTEN[key]


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """By the view's SQL over stored views, where it reads some, and the given tables."""
    text = VIEWS[name]
    for other in [*NEEDS.get(name, []), *TABLES]:
        if re.search(rf"\b{other}\b", text):
            if other in STORED:
                _written(spark, sf_dir, other).createOrReplaceTempView(other)
            elif other in VIEWS:
                _derived(spark, sf_dir, other).createOrReplaceTempView(other)
            else:
                load(spark, sf_dir, other).hint("merge").createOrReplaceTempView(other)  # as in stored
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table in Spark."""
    return _written(spark, sf_dir, name) if name in STORED else _derived(spark, sf_dir, name)
