"""Citations checked against the code: quoted lines must occur as consecutive non-blank lines of the cited file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.scalars import GUTTER, norm_ws
from reviewlake.operators.hints import split_lines
from reviewlake.operators.matching import asked_of_files, find_runs, run_spans


def quote_lines(quote: Column) -> Column:
    """The quote's lines without gutter, white space collapsed, blanks dropped."""
    return F.filter(F.transform(split_lines(quote), lambda x: norm_ws(F.regexp_replace(x, GUTTER, ""))), lambda x: x != "")


def check_citations(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """The columns of evidence with corrected lines, passed and detail. All quotes of a file are looked for in one pass over it."""
    found = asked_of_files(evidence, quote_lines(F.col("quote")), lines.withColumn("norm", norm_ws(F.col("text"))).where("norm <> ''"), F.col("norm"), run_spans)
    found = found.select("row.*", F.col("found.first").alias("found_first"), F.col("found.last").alias("found_last"))
    same = (F.col("found_first") == F.col("start_line")) & (F.col("found_last") == F.col("end_line"))
    cited = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    detail = F.when(F.col("found_first").isNull(), F.concat(F.lit("quote not found in "), "path")).when(same, "exact").otherwise(F.concat(F.lit("lines corrected from "), cited))
    others = [c for c in evidence.columns if c not in ("start_line", "end_line")]
    spans = F.coalesce("found_first", "start_line").alias("start_line"), F.coalesce("found_last", "end_line").alias("end_line")
    return found.select(*others, *spans, F.col("found_first").isNotNull().alias("passed"), detail.alias("detail"))


def find_passages(files: DataFrame, passages: DataFrame) -> DataFrame:
    """repo, path, id, start_line, end_line: where each passage (id, text) first stands in each file (repo, path, content)."""
    return find_runs(files, passages.select("id", quote_lines(F.col("text")).alias("wanted")))


def verified_findings(checked: DataFrame) -> DataFrame:
    """repo, fid, verified, kept: a finding rests on its distinct verified citations; without one it is rejected."""
    place = F.struct("path", "start_line", "end_line", "role")
    return checked.groupBy("repo", "fid").agg(F.bool_or("passed").alias("verified"), F.size(F.collect_set(F.when(F.col("passed"), place))).cast("long").alias("kept"), F.count("*").alias("cited"))


def quote_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds quote, the source text of start_line to end_line: the file's line array is sliced, no range join."""
    arrays = lines.join(spans.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("texts"))
    text = F.array_join(F.slice("texts", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return spans.join(arrays, ["repo", "path"], "left").withColumn("quote", F.coalesce(text, F.lit(""))).drop("texts")
