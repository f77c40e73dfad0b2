"""Findings: merging, numbering, tiers, wording, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.scalars import SEVERITIES, TIERS, hedge_word, parse_answer, valid_finding
from reviewlake.operators.ranks import ranked_by_range


def dedupe_findings(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first of each (primary path, start line, cwe) in a repository; without a citation the title tells findings apart."""
    cited = F.col("path").isNotNull()
    key = [F.col("repo"), F.coalesce("path", F.lit("")), F.when(cited, F.col("start_line")).otherwise(0), F.when(cited, F.coalesce("cwe", F.lit(""))).otherwise(F.col("title"))]
    return findings.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n = 1").drop("n")


def number_findings(findings: DataFrame, order: list[str]) -> DataFrame:
    """Adds id F001, F002 ... in each repository, of any size."""
    numbered = ranked_by_range(findings, ["repo"], order, "number")
    return numbered.withColumn("id", F.format_string("F%03d", "number")).drop("number")


def wording(findings: DataFrame) -> DataFrame:
    """Adds hedged and the word that hedges."""
    return findings.withColumn("hedge", hedge_word(F.col("summary"), F.col("reasoning"))).withColumn("hedged", F.col("hedge") != "")


def dataflow(evidence: DataFrame) -> DataFrame:
    """repo, fid, both_ends: a configuration cited, or a sink with a source or a missing check."""
    has = lambda *roles: F.bool_or(F.col("role").isin(*roles))
    return evidence.groupBy("repo", "fid").agg((has("config") | (has("sink") & has("source", "missing_check"))).alias("both_ends"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Adds rank in each repository: best tier, plain wording, highest severity, id."""
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    order = [F.desc(place("tier", TIERS)), F.col("hedged"), F.desc(place("severity", SEVERITIES)), F.col("id")]
    return ranked_by_range(findings, ["repo"], order)


def parsed_answers(answers: DataFrame) -> DataFrame:
    """The columns of answers, findings, analysis, error (null if the answer is JSON)."""
    # A row of its own for the parsed answer: what follows names its fields without parsing again.
    return answers.select("*", F.explode(F.array(parse_answer(F.col("content"), F.col("truncated")))).alias("parsed")).select("*", "parsed.*").drop("parsed")


def answer_findings(answers: DataFrame) -> DataFrame:
    """A row for each finding of an answer, with valid."""
    keep = [c for c in answers.columns if c not in ("content", "truncated")]
    return parsed_answers(answers).select(*(F.col(c).alias(f"in_{c}") for c in keep), F.posexplode("findings").alias("ord", "finding")).withColumn("valid", valid_finding(F.col("finding")))


def dedupe_citations(evidence: DataFrame) -> DataFrame:
    """The first of a finding's citations with the same path, span and role."""
    w = Window.partitionBy("repo", "fid", "path", "start_line", "end_line", "role").orderBy("ev_ord")
    return evidence.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def scan_stats(reviews: DataFrame, n_findings: DataFrame | None = None) -> DataFrame:
    """One row a repository: leads, findings, discarded_bad_citation, seconds, tokens, the largest prompt, errors.

    reviews: repo, path, error, discarded, prompt_tokens, completion_tokens, seconds, n_findings of each file; findings counts
    those that are left after merging (n_findings: repo, findings), or the files' own without it. errors is the sorted list of `path: error`.
    """
    said = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat("path", F.lit(": "), "error"))))
    total = lambda c: F.sum(c).cast("long")
    one = reviews.groupBy("repo").agg(
        F.count("*").alias("leads"), total("n_findings").alias("findings"), total("discarded").alias("discarded_bad_citation"), F.round(F.sum("seconds"), 1).alias("seconds"),
        total("prompt_tokens").alias("prompt_tokens"), F.max("prompt_tokens").cast("long").alias("largest_prompt_tokens"), total("completion_tokens").alias("completion_tokens"), said.alias("errors"),
    )
    return one if n_findings is None else one.drop("findings").join(n_findings, "repo", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def no_leads(n_findings: DataFrame) -> DataFrame:
    """scan_stats of a scan that reviewed nothing itself. n_findings: repo, findings."""
    zero = F.lit(0).cast("long")
    counts = {c: zero for c in ("leads", "discarded_bad_citation", "prompt_tokens", "largest_prompt_tokens", "completion_tokens")}
    return n_findings.withColumns(counts | {"seconds": F.lit(0.0), "errors": F.array().cast("array<string>")})


def with_errors(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """scan_stats with further errors (repo, error), behind those of the files; a repository with nothing else has a row too."""
    more = errors.groupBy("repo").agg(F.array_sort(F.collect_list("error")).alias("more"))
    rows = stats.join(more, "repo", "full")
    none = F.array().cast("array<string>")
    numbers = [c for c in stats.columns if c not in ("repo", "errors")]
    return rows.select("repo", *(F.coalesce(c, F.lit(0).cast(stats.schema[c].dataType)).alias(c) for c in numbers), F.concat(F.coalesce("errors", none), F.coalesce("more", none)).alias("errors"))


def pattern_review(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (repo, fid, path, start_line, cwe, title, summary) of the pattern baseline, merged, and their citations."""
    from reviewlake.operators.hints import pattern_findings

    every = pattern_findings(lines)
    # Class by class in the order of their first hits in the file, as the hints of a lead are listed.
    first = F.min(F.struct("start_line", "ord")).over(Window.partitionBy("repo", "path", "title"))
    found = dedupe_findings(every.withColumn("class_first", first), ["ord"])
    fid = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), F.coalesce("cwe", F.col("title")))
    found = found.withColumn("fid", fid)
    return found.drop("quote", "role", "end_line"), found.select("repo", "fid", F.lit(0).alias("ev_ord"), "path", "start_line", "end_line", "quote", "role")


def cap_lists(rows: DataFrame, group: list[str], order: str, value: str, n: int) -> DataFrame:
    """group and value: its first n values in order, as an array."""
    top = rows.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("k") <= n)
    return top.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias(value))
