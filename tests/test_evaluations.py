"""Training sets, labelled cases and real fixes from sources to results, on a tree of a few files."""

import json

from pyspark.sql import functions as F

from reviewlake.operators import findings
from reviewlake.plans import evaluations

LINES = "repo string, path string, line int, text string"
HEADER = "'''\nOWASP licence\n'''\n"


def tree(spark):
    texts = {f"testcode/T{k}.py": HEADER + f"# /benchmark/codeinj-00/T{k}\n" + ("eval(x)" if k % 2 else "safe(x)") for k in range(6)}
    texts |= {"helpers/utils.py": "def escape(v):\n    return v", "helpers/resources/x.txt": "data"}
    rows = [("r", p, n, t) for p, body in texts.items() for n, t in enumerate(body.split("\n"), 1)]
    return spark.createDataFrame(rows, LINES)


def cases(spark):
    rows = [("r", f"T{k}", "codeinj", k % 2 == 1, 94, f"testcode/T{k}.py", ["CWE-94", "CWE-95"]) for k in range(6)]
    return spark.createDataFrame(rows, "repo string, name string, category string, real boolean, cwe int, path string, classes array<string>")


def teacher_that_tells(folder, fails=()):
    def factory():
        def client(prompt):
            path = prompt.split("`")[1]
            with open(f"{folder}/calls", "a") as f:
                f.write(path + "\n")
            if path in fails:
                raise RuntimeError("down")
            (folder / path.replace("/", "_")).write_text(prompt)
            found = [{"title": "t", "cwe": "94", "summary": "s", "evidence": [{"path": path, "start_line": 9, "end_line": 9, "quote": "eval(x)"}]}] if "eval(x)" in prompt else []
            return json.dumps({"analysis": ["read"], "findings": found})

        return client

    return factory


def test_training_set_from_sources(spark, tmp_path):
    """The teacher is told the label, the student isn't; names of categories are gone; a second run calls nobody again."""
    told, log = tmp_path / "told", str(tmp_path / "log")
    told.mkdir()
    job = lambda fails=(): evaluations.training_job(tree(spark), cases(spark), teacher_that_tells(told, fails), log, "sys", "7", 10, 1)
    records, counts, _ = job(["testcode/T1.py"])
    got = {r.name: json.loads(r.record)["messages"] for r in records.collect()}
    called = (told / "calls").read_text().split()
    assert len(called) == len(set(called)) == 4  # one of three is held out on each side
    shown = "\n".join(p.read_text() for p in told.glob("testcode_*"))
    assert "codeinj" not in shown and "OWASP" not in shown and "/benchmark/cases/" in shown and "Label, for you alone" in shown
    for name, (_, asked, answer) in got.items():
        assert "Label" not in asked["content"]
        kept = json.loads(answer["content"])["findings"]
        assert len(kept) == int(name[1]) % 2 and all(f["evidence"][0]["start_line"] in (2, 9) and f["severity"] == "medium" and "valid" not in f for f in kept)
    assert {r.status: r.n for r in counts.collect()} == {"ok": len(got)} and len(got) == 4 - called.count("testcode/T1.py")
    job()
    assert len((told / "calls").read_text().split()) == 4


def test_labelled_cases_from_sources(spark, tmp_path):
    """Held-out cases alone are reviewed; an unanswered one counts unless only answered ones are asked for."""
    told = tmp_path / "told"
    told.mkdir()
    names = cases(spark).where("name <> 'T5'").select("name")
    rates = lambda only: {r.category: (r.n_real, r.n_fake, r.tp, r.fp) for r in evaluations.cases_job(tree(spark), cases(spark), teacher_that_tells(told, ["testcode/T3.py"]), names, answered_only=only).collect()}
    assert rates(False) == {None: (2, 3, 1, 0), "codeinj": (2, 3, 1, 0)}
    assert rates(True) == {None: (1, 3, 1, 0), "codeinj": (1, 3, 1, 0)}
    assert not any(p.name.startswith(("helpers_resources", "testcode_T5")) for p in told.iterdir())


def test_neutral_tree(spark):
    got = {r.path for r in evaluations.neutral_lines(tree(spark), cases(spark).where("name = 'T1'"), "testcode/", "helpers/resources/").collect()}
    assert got == {"testcode/T1.py", "helpers/utils.py"}


def test_real_fixes_over_runs(spark):
    """Only the items' files are reviewed; the means are those of the runs."""
    before = spark.createDataFrame([("r", "a.py", 1, "eval(x)"), ("r", "a.py", 2, "os.system(y)"), ("r", "b.py", 1, "eval(z)")], LINES)
    after = before.withColumn("text", F.replace("text", F.lit("eval(x)"), F.lit("parse(x)")))
    items = spark.createDataFrame([("i", "r", "a.py", ["CWE-94"])], "id string, repo string, path string, cwes array<string>")
    changes = spark.createDataFrame([("i", "r", "a.py", 1, 1)], "item string, repo string, path string, start_line int, end_line int")
    blind = lambda lines: tuple(df.where("false") for df in findings.pattern_review(lines))
    runs, means = evaluations.real_job(before, after, items, changes, [(1, findings.pattern_review), (2, blind)])
    assert sorted((r.run, r.detected, r.detected_at_change, r.fixed_flagged, r.pair_accuracy, r.other_findings_vulnerable) for r in runs.collect()) == [(1, 1, 1, 0, 1.0, 1), (2, 0, 0, 0, 0.0, 0)]
    m = means.first()
    assert (m.runs, m.detected, m.pair_accuracy, m.pair_accuracy_per_run) == (2, 0.5, 0.5, [1.0, 0.0])
