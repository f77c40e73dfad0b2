"""Review operators on small inputs of the rules' own shapes."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import scalars as S
from reviewlake.operators import citations, defs, findings, hints, intervals, score, select, train
from reviewlake.plans import jobs
from reviewlake.sources import files
from reviewlake.streaming import answers


def lines_of(spark, texts):
    rows = [("r", path, n, t) for path, body in texts.items() for n, t in enumerate(body.split("\n"), 1)]
    return spark.createDataFrame(rows, "repo string, path string, line int, text string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\x0bc d\x85", "\n\n", "a\x1cb\x1d\x1e"])
def test_split_lines(spark, text):
    assert value(spark, hints.split_lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(("given", "want"), [("89", "CWE-89"), ("CWE-89", "CWE-89"), ("cwe-089: SQL Injection", "CWE-89"), ("", None), ("none", None)])
def test_cwe(spark, given, want):
    assert value(spark, S.normalise_cwe(F.lit(given))) == want


@pytest.mark.parametrize(("n", "want"), [(900, [(1, 400), (361, 760), (721, 900)]), (120, [(1, 120)]), (0, [(1, 1)]), (400, [(1, 400)]), (401, [(1, 400), (361, 401)])])
def test_windows(spark, n, want):
    assert [tuple(x) for x in value(spark, hints.window_spans(F.lit(n)))] == want


def test_tree(spark, tmp_path):
    for name, body in {"app/db.py": b"a = 1\nb = 2\n", "node_modules/x.js": b"no", "bin.dat": b"a\0b", "big.py": b"x" * 400_001, "bad.py": b"\xffok"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path: r.content for r in files.read_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"app/db.py": "a = 1\nb = 2\n", "bad.py": "�ok"}


def test_citations(spark):
    lines = lines_of(spark, {"a.py": "def f(x):\n\n    q = 'SELECT ' + x\n    run(q)", "b.py": "other"})
    ev = [("r", "f", 0, "a.py", 3, 3, "q = 'SELECT ' + x", "sink"), ("r", "f", 1, "a.py", 9, 9, "1| def f(x):\n3|     q =", "source"), ("r", "f", 2, "a.py", 3, 3, "invented", "sink"), ("r", "g", 0, "none.py", 1, 1, "x", "sink"), ("r", "g", 1, "a.py", 1, 1, "", "sink")]
    e = spark.createDataFrame(ev, "repo string, fid string, ev_ord int, path string, start_line int, end_line int, quote string, role string")
    got = {(r.fid, r.ev_ord): (r.passed, r.start_line, r.end_line, r.detail) for r in citations.check_citations(e, lines).collect()}
    assert got == {("f", 0): (True, 3, 3, "exact"), ("f", 1): (True, 1, 3, "lines corrected from 9-9"), ("f", 2): (False, 3, 3, "quote not found in a.py"), ("g", 0): (False, 1, 1, "quote not found in none.py"), ("g", 1): (False, 1, 1, "quote not found in a.py")}


def test_imports_and_helpers(spark):
    lines = lines_of(spark, {"a.py": "from .h import one as o, two\nimport os\nimport pkg.mod\nx = pkg.mod.three(1)", "h.py": "def one(v):\n    return v\nclass two:", "z.js": "const { four } = require('./h')\nfunction three() {"})
    got = {(r.path, r.ord): r.name for r in defs.imported_names(lines).collect()}
    assert got == {("a.py", 1): "one", ("a.py", 2): "two", ("a.py", 3): "three", ("z.js", 1): "four"}
    helpers = defs.with_bodies(defs.helper_definitions(lines), lines)
    assert {(r.path, r.name, r["where"], r["at"], r.body) for r in helpers.collect()} == {("a.py", "one", "h.py", 1, "1| def one(v):\n2|     return v\n3| class two:"), ("a.py", "two", "h.py", 3, "3| class two:"), ("a.py", "three", "z.js", 2, "2| function three() {")}


def test_entries_and_peers(spark):
    py = '@bp.get("/a")\n@login_required\n\n# note\ndef a(x):\n    check_owner(x)\n    return 1\n@bp.route("/b")\ndef b():\n    if o == g.user.id:\n        pass\n'
    lines = lines_of(spark, {"v.py": py, "w.py": '@bp.post("/c")\ndef c():\n    pass', "r.js": "router.get('/x', requireAuth, (req, res) => {\n  verifyToken(req)\n})\nrouter.post('/y', (req, res) => {", "p.php": "<?php\n$x = $_GET['a'];\nauthorize($x);"})
    got = {(r.path, r.line): (r.route, r.guards) for r in defs.entry_points(lines).collect()}
    assert got == {
        ("v.py", 5): ("GET /a", ["login_required", "check_owner()"]),
        ("v.py", 9): ("ROUTE /b", [defs.COMPARES_IDENTITY]),
        ("w.py", 2): ("POST /c", []),
        ("r.js", 1): ("GET /x", ["requireAuth", "verifyToken()"]),
        ("r.js", 4): ("POST /y", []),
        ("p.php", 2): ("reads request input", ["authorize()"]),
    }
    peers = defs.peer_guards(defs.entry_points(lines), lines).where("path = 'w.py'").collect()
    assert {(r.guard, r.uses, r.n_files, r.peers) for r in peers} == {("login_required", 1, 1, 2), ("check_owner()", 1, 1, 2), (defs.COMPARES_IDENTITY, 1, 1, 2)}


def test_answers(spark):
    good = '{"findings": [{"title": "t", "summary": "s", "severity": "low", "evidence": []}]}'
    got = [value(spark, S.parse_answer(F.lit(c), F.lit(t))) for c, t in ((good, False), (f"```json\n{good}\n```", False), ("no json", False), (good, True), ('{"findings": null}', False))]
    assert [(x.error, None if x.findings is None else len(x.findings)) for x in got] == [(None, 1), (None, 1), (S.NOT_JSON, None), (None, 1), (None, 0)]


def test_fixes(spark):
    steps = F.array(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new")), F.struct(F.lit("bx").alias("old"), F.lit("c").alias("new")))
    assert tuple(value(spark, S.apply_fixes(F.lit("ax"), steps))) == ("c", None)
    assert tuple(value(spark, S.apply_fixes(F.lit("aax"), steps))) == ("aax", 1)


def test_split_is_disjoint_and_repeatable(spark):
    cases = spark.createDataFrame([(f"n{i}", "sqli", i % 2 == 0) for i in range(60)] + [(f"m{i}", "xss", True) for i in range(5)], "name string, category string, real boolean")
    one, two = ({(r.name, r.side) for r in select.stratified_split(cases, 12, 4, "7").collect()} for _ in range(2))
    sides = {s: {n for n, x in one if x == s} for s in ("train", "holdout")}
    assert one == two and not sides["train"] & sides["holdout"]
    assert len(sides["holdout"]) == 4 + 4 + 1 and len(sides["train"]) == 12 + 12 + 4


def test_case_score(spark):
    flags = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("b", False, False)], "category string, real boolean, flagged boolean")
    got = {r.category: (r.tpr, r.fpr, r.score) for r in score.score_cases(flags).collect()}
    assert got == {None: (0.5, 0.5, 0.0), "a": (0.5, 1.0, -0.5), "b": (0.0, 0.0, 0.0)}


def test_failed_call_stays_on_its_row(spark):
    prompts = spark.createDataFrame([("r", "a", 1, "good"), ("r", "b", 1, "bad"), ("r", "c", 1, "long")], "repo string, path string, `part-no` int, prompt string")

    def factory():
        def client(p):
            if p == "bad":
                raise RuntimeError("down")
            return jobs.Reply("half", truncated=True, prompt_tokens=7) if p == "long" else p.upper()

        return client

    got = {(r.path, r.content, r.truncated, r.prompt_tokens, r.error) for r in jobs.review_prompts(prompts, factory).collect()}
    assert got == {("a", "GOOD", False, 0, None), ("b", None, False, 0, "RuntimeError: down"), ("c", "half", True, 7, None)}


def put_answer(folder, name, key, attempt=1, quote="eval(x)"):
    answer = {"findings": [{"title": "t", "summary": "s", "severity": "low", "evidence": [{"path": "a.py", "start_line": 1, "end_line": 1, "quote": quote, "role": "sink"}]}]}
    (folder / name).write_text(json.dumps({"key": key, "attempt": attempt, "repo": "r", "path": "a.py", "content": json.dumps(answer), "truncated": False}) + "\n")


def test_stream_takes_each_answer_once(spark, tmp_path):
    """A key that is logged again in a later batch is cited once, by its last attempt."""
    lines = lines_of(spark, {"a.py": "eval(x)\nrun(y)"})
    log, out = tmp_path / "in", str(tmp_path / "out")
    log.mkdir()
    for name, key, attempt, quote in (("1.json", "k1", 1, "eval(x)"), ("2.json", "k2", 1, "eval(x)"), ("3.json", "k1", 2, "run(y)"), ("4.json", "k2", 0, "run(y)")):
        put_answer(log, name, key, attempt, quote)
        answers.stream_citations(spark, str(log), lines, out, str(tmp_path / "ck")).awaitTermination()
    got = answers.read_citations(spark, out).where("passed").collect()
    assert sorted((r.fid, r.start_line) for r in got) == [("k1#0", 2), ("k2#0", 1)]


def test_scan(spark, tmp_path):
    """Two equal findings are one, an invented quote is discarded, wrong fields and a failed call are errors; the report has it all."""
    lines = lines_of(spark, {"a.py": "eval(x)\nsafe()", "b.py": "import os"})
    cite = lambda quote: [{"path": "a.py", "start_line": 1, "end_line": 1, "quote": quote, "role": "sink"}]
    one = {"title": "t", "cwe": "89", "severity": "high", "summary": "It could run.", "evidence": cite("1| eval(x)")}
    said = json.dumps({"findings": [one, one, {**one, "evidence": cite("invented()")}, {**one, "severity": "huge"}]})

    def factory():
        def client(prompt):
            if "`b.py`" in prompt:
                raise RuntimeError("down")
            return jobs.Reply(said, prompt_tokens=9, completion_tokens=2)

        return client

    scanner = spark.createDataFrame([("r", "a.py", 4, 4)], "repo string, path string, start_line int, end_line int")
    found, cited, stats = jobs.scan_job(lines, "judge", factory, scanner)
    got = found.collect()
    assert [(r.id, r.path, r.start_line, r.cwe, r.tier, r.hedged, r["rank"]) for r in got] == [("F001", "a.py", 1, "CWE-89", "supported", True, 1)]
    s = stats.first()
    assert (s.leads, s.findings, s.discarded_bad_citation, s.prompt_tokens, s.largest_prompt_tokens, s.completion_tokens) == (2, 1, 1, 9, 9, 2)
    assert s.errors == ["a.py: a finding has wrong fields", "b.py: RuntimeError: down"]
    files.write_report(jobs.report_rows(found, cited), str(tmp_path / "report"), "m")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "Reported: 1. Dropped" in text and "- [ ] wording - hedges with could" in text and "`a.py:1` to line 1, sink" in text
    suspected, _, _ = jobs.scan_job(lines, "judge", factory)
    assert [r.tier for r in suspected.collect()] == ["suspected"]


def test_listed_files_bypass_the_filter(spark):
    lines = lines_of(spark, {"notes.txt": "eval(x)", "a.py": "x"})
    paths = spark.createDataFrame([("r", "notes.txt")], "repo string, path string")
    assert [r.path for r in hints.leads_job(lines).collect()] == ["a.py"]
    assert [(r.path, r.score) for r in hints.leads_job(lines, paths).collect()] == [("notes.txt", 10)]


ITEM = "repo string, path string, id string, anchor string, patched_anchor string, old string, new string, radius int, cwes array<string>, is_decoy boolean"


def test_scoring(spark):
    """Two hits on one weakness, one decoy, one nowhere: precision a third; other repositories with the same paths don't count."""
    lines = lines_of(spark, {"a.py": "bad()\n" + "\n" * 20 + "fine()\n" + "\n" * 20 + "end"})
    lines = lines.union(lines.withColumn("repo", F.lit("other")))
    truth = spark.createDataFrame([("r", "a.py", "V1", "bad()", "good()", "bad()", "good()", 2, ["CWE-89", "CWE-564"], False), ("r", "a.py", "D1", "fine()", None, None, None, 2, ["CWE-89"], True)], ITEM)
    f = spark.createDataFrame([("r", "1", "CWE-564", "suspected"), ("r", "2", "CWE-1", "suspected"), ("r", "3", "CWE-89", "suspected"), ("r", "4", "CWE-0", "suspected"), ("r", "5", "CWE-89", "rejected"), ("other", "1", "CWE-89", "suspected")], "repo string, fid string, cwe string, tier string")
    ev = spark.createDataFrame([("r", "1", "a.py", 1, 1), ("r", "2", "a.py", 3, 3), ("r", "3", "a.py", 22, 22), ("r", "4", "a.py", 40, 40), ("r", "5", "a.py", 1, 1), ("other", "1", "a.py", 1, 1)], "repo string, fid string, path string, start_line int, end_line int")
    m = intervals.match_truth(ev, f, intervals.truth_regions(truth, lines))
    assert {(r.repo, r.fid): r.item for r in m.collect()} == {("r", "1"): "V1", ("r", "2"): "V1", ("r", "3"): "D1", ("r", "4"): None, ("other", "1"): None}
    s = score.score_summary(m, truth).collect()
    assert [(r.found, r.decoys_flagged, r.unlisted, r.recall, r.precision) for r in s] == [(["V1"], ["D1"], 1, 1.0, 1 / 3)]
    twin = hints.file_lines(score.patched_twin(spark.createDataFrame([("r", "a.py", "bad()\nx\nfine()")], "repo string, path string, content string"), truth).drop("bad"))
    late = intervals.match_truth(ev.where("fid = '1' and repo = 'r'"), f.where("fid = '1' and repo = 'r'"), intervals.truth_regions(truth, twin, patched=True))
    p = score.score_summary(late, truth, patched=True).first()
    assert (p.patched_still_flagged, p.found, p.patched, p.precision) == (["V1"], [], 1, 0.0)


def test_truth_checks(spark):
    truth = spark.createDataFrame([("r", "a.py", "V1", "bad(1)", "good()", "bad(1)", "good()", 2, ["CWE-89"], False), ("r", "a.py", "V2", "twice", "t2", "twice", "t2", 2, ["CWE-89"], False)], ITEM)
    content = "bad(1)\ntwice\ntwice"
    tree = spark.createDataFrame([("r", "a.py", content)], "repo string, path string, content string")
    twin = spark.createDataFrame([("r", "a.py", "good()\ntwice\ntwice")], "repo string, path string, content string")
    got = {(r.id, r.violation) for r in score.check_truth(truth, hints.file_lines(tree), twin, hints.file_lines(twin)).collect()}
    assert got == {("V2", "anchor does not resolve"), ("V2", "fix does not apply"), ("V2", "old text is left"), ("V2", "patched anchor does not resolve")}


def test_real_items(spark):
    """Only the item's own repository and files count; a hit is at the change within three lines."""
    items = spark.createDataFrame([("i", "r", "a.py", ["CWE-89"])], "id string, repo string, path string, cwes array<string>")
    changes = spark.createDataFrame([("i", "r", "a.py", 10, 11)], "item string, repo string, path string, start_line int, end_line int")
    cited = spark.createDataFrame([("r", "a.py", "1", "CWE-89", 14, 14, False), ("r", "a.py", "2", "CWE-1", 10, 10, False), ("r", "b.py", "3", "CWE-89", 10, 10, False), ("other", "a.py", "4", "CWE-89", 10, 10, False)], "repo string, path string, fid string, cwe string, start_line int, end_line int, rejected boolean")
    r = score.score_items(cited, cited.limit(0), items, changes).first()
    assert tuple(r) == ("i", True, True, False, True, 1, 0)


def test_readers(spark, tmp_path):
    lines = lines_of(spark, {"a.py": "one\ntwo\nthree"})
    hit = lambda cwe: {"check_id": "x.y.rule", "path": "a.py", "start": {"line": 2}, "end": {"line": 3}, "extra": {"message": "m", "metadata": {"cwe": cwe}}}
    (tmp_path / "scan.json").write_text(json.dumps({"results": [hit(["CWE-89: SQL", "CWE-1"]), hit("CWE-79: XSS"), {**hit("CWE-79"), "path": "none.py"}]}, indent=1))
    got = files.read_scanner(spark, str(tmp_path / "scan.json"), lines, "r").collect()
    assert sorted((r.title, r.cwe, r.quote) for r in got) == [("rule", "CWE-79", "two\nthree"), ("rule", "CWE-89", "two\nthree")]
    (tmp_path / "key.csv").write_text("# name, category, real vulnerability, cwe\nT1 , sqli, true, 89\nT2,xss,false,79\n")
    assert [tuple(r) for r in files.read_cases(spark, str(tmp_path / "key.csv")).collect()] == [("T1", "sqli", True, 89), ("T2", "xss", False, 79)]
    (tmp_path / "c++" / "item-1").mkdir(parents=True)
    (tmp_path / "c++" / "item-1" / "changes.json").write_text(json.dumps({"fix": "f", "parent": "p", "ranges": {"a.py": [[1, 2], [5, 5]]}}))
    assert sorted(tuple(r) for r in files.read_changes(spark, str(tmp_path / "c++")).collect()) == [("item-1", "a.py", 1, 2), ("item-1", "a.py", 5, 5)]
    assert [r.path for r in files.read_tree(spark, str(tmp_path / "c++"), "r").collect()] == ["item-1/changes.json"]


def test_saved_runs(spark, tmp_path):
    stats = {"errors": ["x"], "seconds": 2.0, "largest_prompt_tokens": 5}
    (tmp_path / "a.json").write_text(json.dumps({"summary": {"model": "m", "mode": "judge", "temperature": 0.5, "prompt": "plain"}, "runs": [{"seed": s, "vulnerable": {"recall": 0.5, "precision": 0.25 * s, "found": ["V1"], "decoys_flagged": [], "unlisted": 1, "seconds": 1.5, "errors": []}, "patched": {"patched_still_flagged": ["V1"] * (s == 2), "seconds": 0.5, "errors": ["e"]}, "pair_accuracy": 0.5} for s in (2, 1)]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"summary": {"target": "real", "model": "m", "mode": "judge", "temperature": 0.5}, "runs": [{"items": [{"id": "i", "detected": True, "detected_at_change": True, "fixed_flagged": False, "pair_correct": True, "other_findings_vulnerable": 2, "other_findings_fixed": 1, "stats_vulnerable": stats, "stats_fixed": stats}]}]}))
    groups = spark.createDataFrame([("i", "injection")], "id string, grp string")
    metrics, items = jobs.summarise_runs(files.read_runs(spark, str(tmp_path)), groups)
    got = {(json.loads(r.config)["target"], r.metric): (r.mean, r["values"]) for r in metrics.collect()}
    assert got["seeded", "precision"] == (0.375, [0.25, 0.5]) and got["seeded", "patched still flagged"] == (0.5, [0.0, 1.0]) and got["seeded", "seconds"] == (2.0, [2.0, 2.0])
    assert got["real", "pairs correct, injection"] == (1.0, [1.0]) and got["real", "errors"] == (2.0, [2.0]) and got["real", "largest prompt (tokens)"] == (5.0, [5.0])
    assert sorted((r.item, r.runs, r.found, r.correct) for r in items.collect()) == [("V1", 2, 2, 1), ("i", 1, 1, 1)]


def test_training(spark):
    lines = lines_of(spark, {"a.py": "eval(x)"})
    finding = {"title": "t", "cwe": "CWE-89", "severity": "low", "summary": "s", "evidence": [{"path": "a.py", "start_line": 1, "end_line": 1, "quote": "1| eval(x)", "role": "sink"}]}
    rows = [("r", "ok", 1, True, {"analysis": ["a", " "], "findings": [finding] * 3}), ("r", "blank", 1, True, {"analysis": ["\t"], "findings": []}), ("r", "leak", 1, True, {"analysis": ["as instructed"]}), ("r", "safe", 1, False, {"analysis": ["a"], "findings": [finding]}), ("r", "other", 1, True, {"analysis": ["a"], "findings": [{**finding, "cwe": "CWE-1"}]}), ("r", "ok", 0, True, {})]
    teacher = spark.createDataFrame([(*r[:4], ["CWE-89"], "p", json.dumps(r[4]), False) for r in rows], "repo string, name string, attempt int, real boolean, classes array<string>, prompt string, content string, truncated boolean")
    records, counts, whole = jobs.build_training(teacher, lines, "sys", "v")
    assert {r.status: r.n for r in counts.collect()} == {"ok": 2, "analysis missing": 1, "key mentioned": 1, train.NOTHING_KEPT: 1}
    got = {r.name: json.loads(r.record)["messages"] for r in records.collect()}
    target = json.loads(got["ok"][2]["content"])
    assert target["analysis"] == ["a"] and len(target["findings"]) == 2 and target["findings"][0]["evidence"][0]["quote"] == "eval(x)" and "verified" not in target["findings"][0]
    assert json.loads(got["safe"][2]["content"])["findings"] == []
    assert tuple(whole.first()) == (5, 2, 1, 1, 1)


def test_split_sides(spark):
    one = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert [tuple(r) for r in score.repeated_ids(one, "id").collect()] == [("b", 2)]
    assert score.in_both(one, one.where("id = 'a'"), "id").count() == 1


def test_dedupe_and_numbers(spark):
    rows = [("r", "a", 3, "CWE-89", "x", 1), ("r", "a", 3, "CWE-89", "y", 2), ("r", None, None, None, "t", 3), ("r", None, None, None, "t", 4), ("r", "a", 3, None, "z", 5)]
    f = spark.createDataFrame(rows, "repo string, path string, start_line int, cwe string, title string, n0 int")
    got = findings.number_findings(findings.dedupe_findings(f, ["n0"]), ["n0"]).collect()
    assert {(r.n0, r.id) for r in got} == {(1, "F001"), (3, "F002"), (5, "F003")}


def test_entry_works_without_the_training_data_operators(tmp_path):
    """On a copy of the repository from which the subpackage, its tests and the pipeline are deleted."""
    from conftest import ROOT

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'k1_leads_job' in q and not [x for x in q if x.startswith('op') or x == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
