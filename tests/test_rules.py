"""Rules of single operators on their own small cases: quotes, anchors, ranks, answers, fixes, trees, logs, streams."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.functions import scalars as S
from reviewlake.operators import citations, findings, intervals, matching, ranks, score, select, train
from reviewlake.plans import calls, jobs, queries
from reviewlake.plans.views import view
from reviewlake.sources import files, trees
from reviewlake.streaming import answers

EVIDENCE = "repo string, fid string, ev_ord int, path string, start_line int, end_line int, quote string, role string"
LINES = "repo string, path string, line int, text string"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Quotes and anchors


def first_run(texts, run):
    """By trying every place."""
    if not run or any(not w for w in run):
        return None
    return next((i for i in range(len(texts) - len(run) + 1) if all(w in texts[i + k] for k, w in enumerate(run))), None)


@given(st.lists(st.text("ab ", min_size=1, max_size=5), max_size=12), st.lists(st.lists(st.text("ab ", min_size=1, max_size=3), max_size=3), max_size=8))
@settings(max_examples=200, deadline=None)
def test_places_are_those_of_brute_force(texts, runs):
    places = matching.Places(texts, runs)
    assert [places.first(run) for run in runs] == [first_run(texts, run) for run in runs]
    at = matching.occurrences(texts, {w for run in runs for w in run})
    assert at == {w: found for w in {w for run in runs for w in run} if (found := [i for i, t in enumerate(texts) if w in t])}


def test_a_hot_file_is_met_in_parts(spark):
    """Quotes of one file over the bound, repeated ones among them; the file is there for each part."""
    lines = spark.createDataFrame([("r", "a.py", n, f"  call_{n}(  x )") for n in range(1, 300)] + [("r", "b.py", 1, None)], LINES)
    rows = [("r", str(k), 0, "a.py", 1, 1, f"12| call_{k % 350}( x )", "sink") for k in range(1, 700)] + [("r", "n", 0, None, 1, 1, "x", "sink"), ("r", "e", 0, "a.py", 7, 7, " \n", "sink"), ("r", "b", 0, "b.py", 1, 1, "x", "sink")]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    found = matching.asked_of_files(evidence, citations.quote_lines(F.col("quote")), lines, F.trim(F.regexp_replace("text", r"\s+", " ")), matching.run_spans, most=40)
    got = {r.row.fid: r.found and (r.found.first, r.found.last) for r in found.collect()}
    assert got == {str(k): (k % 350, k % 350) if 1 <= k % 350 < 300 else None for k in range(1, 700)} | {"n": None, "e": None, "b": None}


def test_ten_thousand_quotes_of_one_file():
    """The largest file that is read, each line quoted: one pass, well under the time of trying every place."""
    texts = [f"value_{n} = call_{n}(argument, other)" for n in range(10_000)]
    began = time.monotonic()
    places = matching.Places(texts, [texts[n : n + 3] for n in range(0, 9_997)])
    assert [places.first(texts[n : n + 3]) for n in range(0, 9_997)] == list(range(0, 9_997))
    assert time.monotonic() - began < 5


def test_anchors_on_one_line(spark):
    lines = spark.createDataFrame([("r", "a.py", n, t) for n, t in enumerate(["one", "two two", "x", "one more", "aab"], 1)], LINES)
    truth = spark.createDataFrame([("r", "a.py", i, a, 2) for i, a in (("1", "two"), ("2", "one"), ("3", "none"), ("4", "aab"), ("5", "ab"), ("6", ""), ("7", None))] + [("r", "z.py", "8", "x", 2)], "repo string, path string, id string, anchor string, radius int")
    got = {r.id: (r.start_line, r.end_line) for r in intervals.anchor_regions(truth, lines).collect()}
    assert got == {"1": (1, 4), "4": (3, 7), "5": (3, 7)}


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_passages_in_blocks(spark, block):
    docs = spark.createDataFrame([("d", "1", "a b\n\n  c   d\ne"), ("d", "2", "c d e\nx"), ("d", "3", None)], "repo string, path string, content string")
    runs = spark.createDataFrame([(1, ["a b", "c d"]), (2, ["c d"]), (3, ["d", "e"]), (4, []), (5, ["x"])], "id int, wanted array<string>")
    got = sorted((r.path, r.id, r.start_line, r.end_line) for r in matching.find_runs(docs, runs, block).collect())
    assert got == [("1", 1, 1, 3), ("1", 2, 3, 3), ("1", 3, 3, 4), ("2", 2, 1, 1), ("2", 5, 2, 2)]


# Ranks


def test_ranks_of_a_hot_group_by_ranges(spark):
    """One repository holds half of all rows: they lie in many ranges, and ranks are those of a plain sort."""
    chance = random.Random(3)
    rows = [("hot" if k % 2 else f"r{k % 7}", chance.randint(0, 50), f"p{k:05}") for k in range(6_000)]
    df = spark.createDataFrame(rows, "repo string, score int, path string")
    ranked = ranks.ranked_by_range(df, ["repo"], [F.desc("score"), F.col("path")], range_rows=200)
    want = {}
    for repo in {r[0] for r in rows}:
        for n, (_, _, path) in enumerate(sorted((r for r in rows if r[0] == repo), key=lambda r: (-r[1], r[2])), 1):
            want[repo, path] = n
    assert {(r.repo, r.path): r["rank"] for r in ranked.collect()} == want
    assert ranks.ranked_by_range(df.limit(0), ["repo"], ["path"]).collect() == []
    numbered = findings.number_findings(df.where("repo = 'r0'").limit(3), ["path"])
    assert sorted(r.id for r in numbered.collect()) == ["F001", "F002", "F003"]


# Answers


def answer(*fields, **more):
    base = {"title": "t", "summary": "s", "evidence": [{"path": "a.py", "start_line": 1, "end_line": 1, "quote": "q"}]}
    return json.dumps({"findings": [{**base, **f} for f in fields], **more})


def test_fields_of_findings(spark):
    """Defaults, coerced numbers, and what makes a finding invalid; one wrong finding costs itself alone."""
    cite = lambda **f: {"evidence": [{"path": "a.py", "start_line": 2, "end_line": 3, "quote": "q", **f}]}
    valid = [{}, {"title": ""}, {"severity": "critical"}, {"evidence": None}, {"evidence": []}, {"evidence": 0}, cite(start_line="2"), cite(start_line=2.0), cite(end_line=True), {"cwe": ["CWE-9"]}, {"tier": 5, "id": 3}]
    wrong = [{"title": 5}, {"title": None}, {"summary": None}, {"severity": "huge"}, {"severity": None}, {"reasoning": None}, {"remediation": 1}, {"evidence": "a"}, {"evidence": {"a": 1}}, {"evidence": [3]}, cite(path=None), cite(start_line=0), cite(start_line=1.5), cite(start_line="x"), cite(start_line=None), cite(role=1), cite(quote=7)]
    got = value(spark, S.parse_answer(F.lit(answer(*valid, *wrong)), F.lit(False)))
    assert got.error is None and [f.valid for f in got.findings] == [True] * len(valid) + [False] * len(wrong)
    first = got.findings[0]
    assert (first.severity, first.reasoning, first.remediation, first.cwe, first.evidence[0].role) == ("medium", "", "", None, "context")
    assert [got.findings[k].evidence[0].start_line for k in (6, 7)] == [2, 2] and got.findings[9].cwe == "CWE-9"


@pytest.mark.parametrize(("content", "truncated", "error", "n"), [
    ('{"findings": null}', False, None, 0), ('{"analysis": ["a", 3, null]}', False, None, 0), ("[1]", False, S.NOT_JSON, None), ('{"findings": "x"}', False, S.NOT_JSON, None),
    ('{"findings": [3, "x"]}', False, None, 2), ("{bad", True, S.CUT_OFF, None), ("{bad", False, S.NOT_JSON, None), ('{"findings": []}', True, None, 0), (None, False, S.NOT_JSON, None), ("", True, S.CUT_OFF, None),
])
def test_whole_answers(spark, content, truncated, error, n):
    got = value(spark, S.parse_answer(F.lit(content).cast("string"), F.lit(truncated)))
    assert (got.error, None if got.findings is None else len(got.findings)) == (error, n)
    assert not got.findings or not any(f.valid for f in got.findings)
    if content and "analysis" in content:
        assert got.analysis == ["a"]


# Sources, fixes, scores


def test_neutral_source(spark):
    src = "'''\nOWASP, a licence.\n'''\n\n@app.route('/benchmark/pathtraver-00/T1')\nsay('OWASP: error executing cmdi case')\nrender('web/xss-12/T1.html')\n"
    assert value(spark, train.neutralise(F.lit(src))) == "@app.route('/benchmark/cases/T1')\nsay('OWASP: error executing command case')\nrender('web/cases/T1.html')\n"


def test_fixes_in_several_files(spark):
    """Steps build on each other; an item with one step that doesn't fit changes nothing, and what was built on it fails too."""
    tree = spark.createDataFrame([("r", "a.py", "one\ntwo"), ("r", "b.py", "x x"), ("r", "c.py", "same")], "repo string, path string, content string")
    rows = [("V1", 0, "a.py", "one", "1"), ("V1", 1, "c.py", "same", "other"), ("V2", 0, "a.py", "two", "2"), ("V2", 1, "b.py", "x", "y"), ("V3", 0, "a.py", "2", "3"), ("V4", 0, "none.py", "a", "b"), ("V5", 0, "a.py", "1", "uno"), ("V6", 0, "a.py", "", "z")]
    steps = spark.createDataFrame([("r", *r) for r in rows], "repo string, id string, step int, path string, old string, new string")
    fixed, errors = score.fixed_tree(tree, steps)
    assert {r.path: r.content for r in fixed.collect()} == {"a.py": "uno\ntwo", "b.py": "x x", "c.py": "other"}
    assert sorted((r.id, r.step, r.path) for r in errors.collect()) == [("V2", 1, "b.py"), ("V3", 0, "a.py"), ("V4", 0, "none.py"), ("V6", 0, "a.py")]


TRUTH = "repo string, path string, id string, anchor string, patched_anchor string, old string, new string, radius int, cwes array<string>, is_decoy boolean"


def test_a_fix_that_fails_is_no_correct_pair(spark):
    lines = spark.createDataFrame([("r", "a.py", 1, "eval(x)"), ("r", "a.py", 5, "eval(y)")], LINES)
    good = ("r", "a.py", "V1", "eval(x)", "parse(x)", "eval(x)", "parse(x)", 0, ["CWE-94"], False)
    bad = ("r", "a.py", "V2", "eval(y)", "parse(y)", "eval(z)", "parse(y)", 0, ["CWE-94"], False)
    before, _, pairs, errors = jobs.eval_seeded(lines, spark.createDataFrame([good, bad], TRUTH))
    assert [(r.id, r.step) for r in errors.collect()] == [("V2", 0)]
    assert tuple(pairs.first()) == ("r", 1, 1, 0, 1, 1.0) and before.first().found == ["V1"]


def failing_fix(spark):
    """A tree and two weaknesses in it; the second one's fix doesn't apply."""
    lines = spark.createDataFrame([("r", "a.py", 1, "eval(x)"), ("r", "a.py", 5, "eval(y)")], LINES)
    good = ("r", "a.py", "V1", "eval(x)", "parse(x)", "eval(x)", "parse(x)", 0, ["CWE-94"], False)
    bad = ("r", "a.py", "V2", "eval(y)", "parse(y)", "eval(z)", "parse(y)", 0, ["CWE-94"], False)
    return lines, spark.createDataFrame([good, bad], TRUTH)


def test_the_tree_is_scored_on_every_weakness(spark):
    before, after, _, errors = jobs.eval_seeded(*failing_fix(spark), every=True)
    row = before.first()
    assert (row.weaknesses, row.found, row.unlisted, row.recall, row.precision) == (2, ["V1", "V2"], 0, 1.0, 1.0)
    assert after.first().patched == 1 and [r.id for r in errors.collect()] == ["V2"]


def test_totals_of_the_seeded_query_are_those_of_the_truth(spark, sf):
    """Weaknesses whose anchor isn't on one line, and whose fix fails for that, are among them."""
    items = view(spark, sf, "truth").where("not is_decoy").groupBy("repo").count()
    assert queries.k5_eval_errors(spark, sf).count() > 0
    assert {r.repo: r.weaknesses for r in queries.k5_eval_seeded(spark, sf).collect()} == {r.repo: r["count"] for r in items.collect()}


def test_pairs_count_every_weakness(spark, sf):
    """One whose fix fails is found in the tree, and no correct pair."""
    pairs = jobs.eval_seeded(*failing_fix(spark), every=True)[2]
    assert tuple(pairs.first()) == ("r", 2, 2, 0, 1, 0.5)
    items = view(spark, sf, "truth").where("not is_decoy").groupBy("repo").count()
    assert {r.repo: r.weaknesses for r in queries.k5_eval_pairs_of_trees(spark, sf).collect()} == {r.repo: r["count"] for r in items.collect()}


def test_pattern_findings_go_class_by_class(spark):
    lines = spark.createDataFrame([("r", "a.py", 1, "hashlib.md5(a)"), ("r", "a.py", 2, "eval(b)"), ("r", "a.py", 3, "hashlib.md5(c)")], LINES)
    found, _, _ = jobs.scan_job(lines, "patterns")
    assert {r.id: r.start_line for r in found.collect()} == {"F001": 1, "F002": 3, "F003": 2}


def test_changes_elsewhere_do_not_count(spark):
    items = spark.createDataFrame([("i", "r", "a.py", ["CWE-89"]), ("j", "r", "c.py", ["CWE-89"])], "id string, repo string, path string, cwes array<string>")
    changes = spark.createDataFrame([("i", "r", "b.py", 10, 10), ("j", "r", "c.py", 1, 1)], "item string, repo string, path string, start_line int, end_line int")
    cited = spark.createDataFrame([("r", "b.py", "1", "CWE-89", 10, 10, False), ("r", "c.py", "2", "CWE-89", 3, 3, False)], "repo string, path string, fid string, cwe string, start_line int, end_line int, rejected boolean")
    got = {r.id: (r.detected, r.detected_at_change) for r in score.score_items(cited, cited.limit(0), items, changes).collect()}
    assert got == {"i": (False, False), "j": (True, True)}


def test_any_class_makes_the_group(spark):
    rows = spark.createDataFrame([("1", "o/a", [862, 89]), ("2", "O/A", [89]), ("3", "o/b", [862])], "id string, repo string, cwes array<int>")
    got = {r.repo.lower(): r.grp for r in select.one_per_repo(rows, "s").collect()}
    assert got == {"o/a": "injection", "o/b": "missing check"}


def test_commits_keep_names_of_modified_files(spark):
    rows = [("s", True, "src/b.py", "modified", 3), ("s", True, "src/a.py", "modified", 3), ("s", True, "src/new.py", "added", 3), ("s", True, "tests/test_a.py", "modified", 99)]
    got = select.usable_commits(spark.createDataFrame(rows, "sha string, one_parent boolean, filename string, status string, changes int")).first()
    assert (got.n_source, got.n_modified, got.changes, got.files) == (3, 2, 9, ["src/a.py", "src/b.py"])


def test_checks_of_a_report(spark):
    """Corrected and dropped citations, hedged wording, the scanner's word; a scanner that failed is an error of the scan."""
    lines = spark.createDataFrame([("r", "a.py", 1, "eval(x)"), ("r", "a.py", 2, "safe()")], LINES)
    cites = [{"path": "a.py", "start_line": n, "end_line": n, "quote": q, "role": "sink"} for n, q in ((2, "eval(x)"), (1, "eval(x)"), (1, "invented()"))]
    said = json.dumps({"findings": [{"title": "t", "summary": "It could run.", "evidence": cites}]})
    scanner = spark.createDataFrame([("r", "a.py", 3, 3)], "repo string, path string, start_line int, end_line int")
    failed = spark.createDataFrame([("r", "scanner: exit 2"), ("q", "scanner: none")], "repo string, error string")
    found, cited, stats = jobs.scan_job(lines, "judge", lambda: lambda prompt: said, scanner, scanner_errors=failed)
    checks = {c.name: (c.passed, c.detail) for c in jobs.report_rows(found, cited).first().checks}
    assert checks == {"citations": (True, "a.py: lines corrected from 2-2; a.py: quote not found in a.py; 2 citations dropped"), "wording": (False, "hedges with could"), "scanner": (True, "reports the same lines")}
    assert {r.repo: (r.leads, r.findings, r.errors) for r in stats.collect()} == {"r": (1, 1, ["scanner: exit 2"]), "q": (0, 0, ["scanner: none"])}
    alone = scanner.select("*", F.lit("CWE-1").alias("cwe"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("q").alias("quote"))
    assert [(r.leads, r.findings) for r in jobs.scan_job(lines, "scanner", scanner=alone)[2].collect()] == [(0, 1)]


# Trees


def test_skipped_folders_are_not_listed_nor_opened(spark, tmp_path):
    from pyarrow import fs

    for name, content in (("a.py", b"x"), ("src/b.py", b"y\xff"), ("src/.git/c.py", b"n"), ("node_modules/deep/er/d.js", b"n"), ("big.txt", b"z" * (files.LARGEST_FILE + 1)), ("bin.dat", b"a\x00b"), ("dist", b"a file of that name")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path: r.content for r in files.read_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"a.py": "x", "src/b.py": "y�", "dist": "a file of that name"}
    listed = []

    class Watched:
        def get_file_info(self, selector):
            listed.append(selector.base_dir)
            return fs.LocalFileSystem().get_file_info(selector)

    found = list(trees.wanted_files(Watched(), str(tmp_path), frozenset(files.SKIPPED_FOLDERS), files.LARGEST_FILE))
    assert sorted(f[0] for f in found) == ["a.py", "bin.dat", "dist", "src/b.py"]
    assert sorted(listed) == [str(tmp_path), str(tmp_path / "src")]


def test_shares_of_bytes(spark, tmp_path):
    for k in range(9):
        (tmp_path / f"f{k}.py").write_text("x" * 1000)
    read = files.read_tree(spark, tmp_path.as_uri(), "r", partition_bytes=3 * (1000 + trees.OPEN_BYTES))
    assert read.rdd.getNumPartitions() == 3 and read.count() == 9
    (tmp_path / "empty").mkdir()
    assert files.read_tree(spark, str(tmp_path / "empty"), "r").count() == 0
    assert [len(s) for s in trees.dealt(iter([("a", "a", 10**9), ("b", "b", 1), ("c", "c", 1)]), 1 << 20)] == [1, 2]


# The log of answers


def counted(folder, most):
    """Makes clients that write down each call, and are gone after so many of their own."""
    unavailable = calls.Unavailable

    def factory():
        left = [most]

        def client(prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            if not left[0]:
                raise unavailable("no budget")
            left[0] -= 1
            with open(f"{folder}/{prompt}", "a") as f:
                f.write("x")
            return prompt.upper()

        return client

    return factory


@pytest.mark.parametrize("commit", [1000, 7])
def test_a_run_that_stops_goes_on(spark, tmp_path, commit):
    """Over two runs each prompt is called for once, equal ones together; the second one's answers are whole."""
    told, log = tmp_path / "told", str(tmp_path / "log")
    told.mkdir()
    rows = [("r", f"f{k}", 1, f"p{k % 25}") for k in range(40)] + [("r", "bad", 1, "bad")]
    prompts = spark.createDataFrame(rows, "repo string, path string, part int, prompt string")
    with pytest.raises(calls.CallsLeft):
        calls.logged_answers(prompts, counted(told, 3), log, commit, parts=2)
    first = {p.name for p in told.iterdir()}
    assert 0 < len(first) < 25
    got = calls.logged_answers(prompts, counted(told, 1000), log, commit, parts=2)
    assert sorted((r.path, r.content, r.error) for r in got.collect()) == sorted((p, None if t == "bad" else t.upper(), "RuntimeError: down" if t == "bad" else None) for _, p, _, t in rows)
    assert {p.name: p.read_text() for p in told.iterdir()} == {f"p{k}": "x" for k in range(25)}
    # A third run calls for nothing, unless failures are to be tried again.
    assert calls.logged_answers(prompts, counted(told, 0), log, commit).count() == 41
    again = calls.logged_answers(prompts.withColumn("prompt", F.replace("prompt", F.lit("bad"), F.lit("p1"))), counted(told, 0), log, commit, retry_errors=True)
    assert again.where("path = 'bad'").first().content == "P1"


# The stream


def put(folder, name, *rows):
    def line(key, attempt, quote, path="a.py"):
        said = {"findings": [{"title": "t", "summary": "s", "evidence": [{"path": path, "start_line": 1, "end_line": 1, "quote": quote}]}]}
        return json.dumps({"key": key, "attempt": attempt, "repo": "r", "path": path, "content": json.dumps(said), "truncated": False})

    (folder / name).write_text("\n".join(line(*r) for r in rows) + "\n")


def test_stream_is_a_compacted_table(spark, tmp_path):
    """Late, repeated and older attempts over batches; neither files nor folders grow with their number; only named files' code is read."""
    lines = spark.createDataFrame([("r", p, n, t) for p in ("a.py", "b.py") for n, t in enumerate(("one()", "two()", "three()"), 1)], LINES)
    log, out, code = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "code")
    log.mkdir()
    answers.write_code(lines, code, 4)

    def run(name, *rows):
        put(log, name, *rows)
        answers.stream_citations(spark, str(log), code, out, str(tmp_path / "ck"), 4).awaitTermination()
        return sorted((r.key, r.attempt, r.start_line) for r in answers.read_citations(spark, out).where("passed").collect())

    assert run("1.json", ("k1", 2, "one()"), ("k2", 1, "one()"), ("k1", 1, "two()")) == [("k1", 2, 1), ("k2", 1, 1)]
    assert run("2.json", ("k1", 1, "three()"), ("k2", 2, "two()", "b.py"), ("k3", 5, "gone()")) == [("k1", 2, 1), ("k2", 2, 2)]
    assert run("3.json", ("k1", 2, "two()"), ("k2", 1, "three()"), ("k3", 6, "three()")) == [("k1", 2, 2), ("k2", 2, 2), ("k3", 6, 3)]
    sizes = []
    for n in range(4, 8):
        run(f"{n}.json", *((f"k{k}", n + 3, "two()") for k in range(30)))
        sizes.append((len(answers.manifest(spark, out)[1]), sum(1 for _ in (tmp_path / "out").rglob("part-*.parquet"))))
    assert len({s[0] for s in sizes}) == 1 and max(s[1] for s in sizes[1:]) <= sizes[1][1]
    version, folders = answers.manifest(spark, out)
    # A batch that is run again does nothing.
    answers.upsert(spark.createDataFrame([("k1", 99, "r", "a.py", "{}", False)], answers.ANSWER), version, code, out, 4)
    assert answers.manifest(spark, out) == (version, folders)
    batch = spark.createDataFrame([("k", 1, "r", "a.py", json.dumps({"findings": [{"title": "t", "summary": "s", "evidence": [{"path": "a.py", "start_line": 1, "end_line": 1, "quote": "one()"}]}]}), False)], answers.ANSWER)
    assert {r.path for r in answers.code_of(code, batch, 4).select("path").distinct().collect()} == {"a.py"}  # b.py lies in another bucket
    assert answers.read_citations(spark, str(tmp_path / "nothing")).collect() == []


# Intervals


def spans_of(chance, n, longest):
    out = []
    for k in range(n):
        a = chance.randint(1, 300)
        out.append((f"f{k % 3}", str(k), a, a + chance.randint(0, chance.choice([0, 3, 40, longest]))))
    return out


@pytest.mark.parametrize("slack", [0, 3])
def test_touching_spans_are_those_of_brute_force(spark, slack):
    """Short spans and spans of 400,000 lines; each pair once, and existence alike."""
    chance = random.Random(slack)
    one, two = spans_of(chance, 60, 400_000), spans_of(chance, 50, 400_000)
    cited = spark.createDataFrame([("r", p, i, a, z) for p, i, a, z in one], "repo string, path string, fid string, start_line int, end_line int")
    spans = spark.createDataFrame([("r", p, i, a, z) for p, i, a, z in two], "repo string, path string, id string, start_line int, end_line int")
    want = sorted((i, j) for p, i, a, z in one for q, j, b, y in two if p == q and a - slack <= y and z + slack >= b)
    assert sorted((r.fid, r.s_id) for r in intervals.touching(cited, spans, ["repo", "path"], slack).collect()) == want
    assert {r.fid for r in intervals.scanner_agreement(cited, spans, slack).collect()} == {i for i, _ in want}
    assert intervals.touching(cited, spans.limit(0), ["repo", "path"]).collect() == []


def test_a_long_span_makes_few_rows(spark):
    blocks = [tuple(b) for b in value(spark, intervals.blocks_of(F.lit(3), F.lit(400_000), 18))]
    assert len(blocks) <= 40 and sum(1 << level for level, _ in blocks) == 399_998
    assert sorted(n for level, k in blocks for n in (k << level, ((k + 1) << level) - 1))[0] == 3


# First hits


def test_literals_never_miss_a_hit(spark):
    """Each alternative of each pattern in a line of its own: what a pattern hits, its literals let through."""
    from reviewlake.operators import hints

    words = "execute query raw prepare SELECT INSERT UPDATE DELETE os.system subprocess.run popen exec execSync spawn shell_exec passthru system Runtime.getRuntime eval Function compile open send_file sendFile readFileSync createReadStream file_get_contents include require_once requests.get requests.post urlopen fetch axios.post http.get curl_exec render_template_string Markup res.send redirect sendRedirect res.redirect Object.assign setattr jwt.decode Math.random random.random random.randint random.choice XMLParser parseString etree.parse etree.fromstring".split()
    others = ["pickle.loads", "yaml.load", "unserialize", "ObjectInputStream", "marshal.load", "node-serialize", "innerHTML", "dangerouslySetInnerHTML", "document.write", "x | safe", "echo $_GET", "Template(request)", "env.from_string", "md5", "sha1", "DES", "RC4", "ECB", "DocumentBuilderFactory", "libxml_disable_entity_loader"]
    others += ["secret = 'abcdefgh'", "PassWd: \"abcdefgh\"", "password=abcdefgh", "api-key = 'abcdefg'", "API_KEY=abcdefgh", "private-key: 'abcdefg'", "my_token = abcdefgh", "verify = False", "verify_signature x false", "algorithms: none", "algorithm = NONE", "rejectUnauthorized : false", "InsecureSkipVerify: true", "DEBUG = True", "Access-Control-Allow-Origin: *", "origins = '*'", "ALLOWED_HOSTS = ['*']"]
    others += ["**request.json", "x.update( req.body)", "USER root", "privileged: true", "--privileged", "/var/run/docker.sock", "network_mode: host", "image:latest", "@app.route(", "@get(", "router.all(", "@PostMapping", "@RequestMapping", "$_COOKIE", "http.HandleFunc"]
    texts = [f"{w}(request.args + url % \"' + \" params f' .format( req.body $_x" for w in words] + others + [t.upper() for t in others] + ["", "x" * 501]
    lines = spark.createDataFrame([("r", "a.py", n, t) for n, t in enumerate(texts)], LINES)
    plain = {(r.line, r.ord) for r in hints.match_lexicon(lines, list(hints.LEXICON)).collect()}
    assert {(r.line, r.ord) for r in hints.match_lexicon(lines).collect()} == plain
    assert {o for _, o in plain} == set(range(len(hints.LEXICON)))


def test_filter_of_names_loses_none(spark):
    from reviewlake.operators import defs

    rows = spark.createDataFrame([("r", f"n{k}", k) for k in range(2_000)], "repo string, name string, line int")
    wanted = rows.where("line % 50 = 0").select("repo", "name")
    kept = {r.line for r in defs.may_hold(rows, ["repo", "name"], wanted).collect()}
    assert set(range(0, 2_000, 50)) <= kept and len(kept) < 60
    assert defs.may_hold(rows, ["repo", "name"], wanted.limit(0)).collect() == []


def test_patterns_mean_the_same_beside_letters_outside_ascii(spark):
    """A word ends at a letter outside ASCII; (?i) takes the long s and the Kelvin sign; only white space of ASCII counts, and a dot any separator but a newline."""
    from reviewlake.operators import hints

    texts = {"éDESö": {9}, "eval (x)": set(), "eval\x0b(x)": set(), "eval\x0c(x)": {3}, "ſecret = 'abcdefgh'": {11}, "toKen = 'abcdefgh'": {11}, "open(a  + params)": {5}, "password=abcdefgh\r": {12}, "password=abc\x0bdefgh": {12}, "md5_": set()}
    lines = spark.createDataFrame([("r", "a.py", n, t) for n, t in enumerate(texts)], LINES)
    for lexicon in (hints.LEXICON, list(hints.LEXICON)):
        found = hints.match_lexicon(lines, lexicon).collect()
        assert {t: {r.ord for r in found if r.line == n} for n, t in enumerate(texts)} == texts


# Joins of tables that grow


def test_tables_that_grow_are_never_broadcast(spark, sf):
    """Compressed files say little of the rows' size in memory: stored tables and views are shuffled; what is broadcast is so by name."""
    from reviewlake.plans.queries import QUERIES
    from reviewlake.sources.storage import stored

    small = stored(spark.range(10), "small")
    for df in (spark.range(10).join(small, "id"), small.join(small.groupBy("id").count(), "id", "left"), QUERIES["d12_signal_precision"](spark, sf), QUERIES["k12_signal_job"](spark, sf), QUERIES["c7_hits_at_change"](spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "h_repo" not in x], plan


def test_changes_of_many_items_are_walked_not_listed_in_tasks(spark, tmp_path):
    """A folder for each item: written and read through the store, hidden files left out, broken ones without ranges."""
    from reviewlake.sources import files

    rows = [(f"i {k}%+", '{"fix": "f",\n "ranges": {"a.py": [[%d, 9]]}}' % k) for k in range(40)] + [("bad", "{")]
    out = str(tmp_path / "many changes")
    files.write_changes(spark.createDataFrame(rows, "item string, value string"), out)
    assert len(list(tmp_path.glob("many changes/*/changes.json"))) == 41
    (tmp_path / "many changes/_SUCCESS").write_text('{"ranges": {"b.py": [[1, 1]]}}')
    (tmp_path / "many changes/.x").mkdir()
    (tmp_path / "many changes/.x/changes.json").write_text('{"ranges": {"b.py": [[1, 1]]}}')
    read = files.read_changes(spark, out)
    assert "source_tree" in read._jdf.queryExecution().toString()
    assert {tuple(r) for r in read.collect()} == {(f"i {k}%+", "a.py", k, 9) for k in range(40)}


def test_changes_elsewhere_grow_with_the_findings(spark, sf):
    """Changes outside an item's files are there, in files with findings, and a file's are those of one item; not all pairs of a repository."""
    from reviewlake.plans.queries import all_changes, view

    away = all_changes(spark, sf).where("item <> concat(repo, ':', path)")
    counts = away.groupBy("repo", "path").agg(F.count_distinct("item").alias("items")).agg(F.max("items").alias("most"), F.count("*").alias("files")).first()
    assert counts.most == 1 and counts.files > 5
    assert away.join(view(spark, sf, "findings"), ["repo", "path"], "left_anti").count() == 0


# Work done once, or not at all


def written(spark, monkeypatch, *modules):
    """The names of tables that these modules store from now on."""
    import importlib

    names = []
    for m in modules:
        module = importlib.import_module(f"reviewlake.{m}")
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: names.append(name) or f(df, name))
    return names


def test_evaluation_does_what_is_asked_for(spark, monkeypatch):
    """The tree's score needs no fix, the errors no review, the twin's score no review of the tree."""
    from reviewlake.plans import jobs

    names = written(spark, monkeypatch, "plans.jobs", "operators.score")
    jobs.eval_seeded(*failing_fix(spark), every=True)[0]
    assert "folded" not in names and names.count("matches") == 1
    names.clear()
    jobs.eval_seeded(*failing_fix(spark))[3]
    assert set(names) == {"folded", "wrong_steps"}
    names.clear()
    jobs.eval_seeded(*failing_fix(spark))[1]
    assert names.count("twin") == 1 and names.count("matches") == 1
    names.clear()
    assert len([x.count() for x in jobs.eval_seeded(*failing_fix(spark))]) == 4 and names.count("matches") == 2


def test_answers_are_parsed_once(spark, sf):
    """What reads parsed answers doesn't hold the parser: it reads a table."""
    from reviewlake.operators import train
    from reviewlake.plans import queries
    from reviewlake.streaming import answers

    said = queries.teacher(spark, sf)
    valid = train.parsed_teacher(said)
    batch = queries.view(spark, sf, "answers").select(F.col("fid").alias("key"), F.lit(1).alias("attempt"), "repo", "path", "content", "truncated")
    rows = (train.teacher_evidence(valid), queries.b19_accept_answers(spark, sf), answers.cited(batch, answers.evidence_of(batch), queries.view(spark, sf, "code_lines")))
    for df in rows:
        assert "variant" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_fix_steps_rank_a_repository_by_ranges(spark, sf, monkeypatch):
    from reviewlake.operators import ranks
    from reviewlake.plans import queries

    monkeypatch.setattr(ranks.ranked_by_range, "__defaults__", ("rank", 200))  # several ranges at sf0.001
    plain = queries.h7_fix_steps(spark, sf).count()
    names = written(spark, monkeypatch, "operators.ranks")
    assert queries.h7_fix_steps(spark, sf).count() == plain and "ranges" in names
