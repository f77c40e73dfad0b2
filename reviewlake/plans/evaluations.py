"""Jobs from sources to results: training sets from labelled cases, scores of labelled cases and of real fixes over repeated runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.scalars import case_hint
from reviewlake.operators import findings, hints, score, select, summary, train
from reviewlake.plans import calls, jobs
from reviewlake.sources.storage import stored

KEY = ["repo", "path"]


def neutral_lines(lines: DataFrame, cases: DataFrame, case_folder: str, without: str) -> DataFrame:
    """The tree of the chosen cases: their neutral sources, and the files outside case_folder and outside `without` as they are."""
    files = train.file_texts(lines)
    helpers = files.where(~F.col("path").startswith(case_folder))
    return stored(hints.file_lines(train.case_tree(files, cases, helpers, without)), "case_lines")


def training_job(
    lines: DataFrame,
    cases: DataFrame,
    client_factory: Callable,
    log: str,
    system: str,
    seed: str,
    n_train: int,
    n_holdout: int,
    case_folder: str = "testcode/",
    without: str = "helpers/resources/",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A training set from an answer key and its sources: what build_training returns.

    Cases (repo, name, category, real, cwe, path, classes) are split by group; those for training are reviewed in a neutral tree by a teacher who
    is told the label at the end of the prompt. The student's prompt goes without. Answers are logged by prompt, so a job that
    stops goes on where it was; failed calls are no answers.
    """
    chosen = stored(select.stratified_split(cases, n_train, n_holdout, seed).where("side = 'train'").drop("side"), "chosen")
    tree = neutral_lines(lines, chosen, case_folder, without)
    prompts = jobs.build_prompts(tree, "walkthrough", paths=chosen)
    known = prompts.join(chosen.select(*KEY, "name", "category", "real", "cwe", "classes"), KEY)
    hint = case_hint(F.col("category"), F.col("real"), F.col("cwe"))
    asked = known.select("repo", "name", "part", "real", "classes", F.col("prompt").alias("own_prompt"), F.concat_ws("\n\n", "prompt", hint).alias("prompt"))
    said = calls.logged_answers(asked, client_factory, log).where("error is null").drop("error")
    # A case is one file; of one cut into several windows the first answers.
    teacher = said.where("part = 1").withColumnRenamed("own_prompt", "prompt").withColumn("attempt", F.lit(1))
    return jobs.build_training(teacher, tree, system, seed)


def cases_job(lines: DataFrame, cases: DataFrame, client_factory: Callable, names: DataFrame | None = None, log: str | None = None, case_folder: str = "testcode/", without: str = "helpers/resources/", answered_only: bool = False) -> DataFrame:
    """eval_cases of the chosen cases after a review of their neutral tree. cases: repo, name, category, real, path, classes."""
    chosen = cases if names is None else score.holdout_cases(cases, names)
    tree = neutral_lines(lines, chosen, case_folder, without)
    found, cited, reviews = jobs.scan_parts(tree, client_factory, log, paths=chosen)
    rows = cited.join(found.select("repo", "fid", "cwe"), ["repo", "fid"]).select("repo", "path", "cwe", F.lit(False).alias("rejected"))
    told = chosen.join(reviews.select("repo", "path", "error"), KEY, "left")
    return jobs.eval_cases(rows, told, answered_only=answered_only)


def citations_in(review: Callable[[DataFrame], tuple[DataFrame, DataFrame]], lines: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each citation of a review of the items' own files, as score_items takes them."""
    found, cited = review(lines.join(items.select(*KEY).distinct(), KEY, "left_semi"))
    rejected = F.col("tier") == "rejected" if "tier" in found.columns else F.lit(False)
    facts = found.select("repo", "fid", "cwe", rejected.alias("rejected"))
    return stored(cited.select("repo", "fid", "path", "start_line", "end_line").join(facts, ["repo", "fid"]), "cited")


def real_job(vulnerable: DataFrame, fixed: DataFrame, items: DataFrame, changes: DataFrame, reviews: Iterable[tuple[int, Callable]] = ((0, findings.pattern_review),)) -> tuple[DataFrame, DataFrame]:
    """eval_real of each run (seed, review) on both sides of real fixes, only the items' files reviewed; and the means over the runs."""
    runs = None
    for seed, review in reviews:
        one = jobs.eval_real(citations_in(review, vulnerable, items), citations_in(review, fixed, items), items, changes)
        one = one.withColumns({"config": F.lit("real"), "run": F.lit(seed)})
        runs = one if runs is None else runs.unionByName(one)
    runs = stored(runs, "runs")
    metrics = [c for c in runs.columns if c not in ("config", "run", "items")]
    return runs.drop("config"), summary.run_averages(runs, metrics, ["pair_accuracy"]).drop("config")
