"""Interval matches under an equality on the file: scanner agreement, truth regions, changed lines.

Two spans touch if the first line of one lies in the other. A span of n lines is the union of about 2 log2(n) dyadic blocks (2^level
lines from a multiple of 2^level on), and a line lies in one block of each level; so "a line lies in a span" is an equality on
(file, level, block), met once for a pair. A span over a whole file makes a few rows, not one for each stretch of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.matching import anchor_counts, asked_of_files
from reviewlake.sources.storage import stored

def block_of(level: int):
    return lambda x: F.struct(F.lit(level).alias("level"), x.cast("long").alias("block"))


def blocks_of(start: Column, end: Column, levels: int) -> Column:
    """array<struct<level, block>>: the dyadic blocks of levels 0 to `levels` that make up start to end; disjoint."""
    parts = []
    for level in range(levels + 1):
        lo, hi = F.shiftright(start + ((1 << level) - 1), level), F.shiftright(end + 1, level) - 1
        block = block_of(level)
        if level == levels:  # no span is longer than twice these
            parts.append(F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), block)))
        else:
            odd, even = F.when((lo <= hi) & (lo % 2 != 0), block(lo)), F.when((lo <= hi) & (hi % 2 == 0), block(hi))
            parts.append(F.array_compact(F.array(odd, even)))
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    return F.flatten(F.array(*(F.coalesce(p, none) for p in parts)))


def blocks_around(line: Column, levels: int) -> Column:
    """array<struct<level, block>>: the block of each level that a line lies in."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(line, k).cast("long").alias("block")) for k in range(levels + 1)))


def level_of(*spans: DataFrame) -> int:
    """The largest level that spans (a, z: first and last line) need: that of the longest one, 19 for a whole file at the reader's limit."""
    longest = [r[0] for s in spans if (r := s.agg(F.max(F.col("z") - F.col("a") + 1)).first()) and r[0]]
    return max(longest, default=1).bit_length() - 1


def touching(cited: DataFrame, spans: DataFrame, on: list[str], slack: int = 0) -> DataFrame:
    """Rows of cited joined with every span (columns s_*) that they touch, within slack lines; a pair once. cited is read twice, spans are written once."""
    span_rows = spans.select(*on, *(F.col(c).alias(f"s_{c}") for c in spans.columns if c not in on))
    b = stored(span_rows.where("s_end_line >= s_start_line").withColumns({"b_a": F.col("s_start_line").cast("long"), "b_z": F.col("s_end_line").cast("long")}), "spans")
    a = cited.withColumns({"a_a": F.col("start_line").cast("long") - slack, "a_z": F.col("end_line").cast("long") + slack}).where("a_z >= a_a")
    levels = level_of(a.select(F.col("a_a").alias("a"), F.col("a_z").alias("z")), b.select(F.col("b_a").alias("a"), F.col("b_z").alias("z")))
    # Kind 0: the first cited line lies in the span. Kind 1: the span's first line lies in the other cited lines.
    met = met_in(a, blocks_around(F.col("a_a"), levels), blocks_of(F.col("a_a") + 1, F.col("a_z"), levels))
    held = met_in(b, blocks_of(F.col("b_a"), F.col("b_z"), levels), blocks_around(F.col("b_a"), levels))
    return met.join(held, [*on, "at"]).drop("at", "b_a", "b_z", "a_a", "a_z")


def met_in(rows: DataFrame, zero: Column, one: Column) -> DataFrame:
    """A row for each block, in column `at`, with the kind of the match that it stands for."""
    of = lambda blocks, kind: F.transform(blocks, lambda b: F.struct(F.lit(kind).alias("kind"), b["level"].alias("level"), b["block"].alias("block")))
    return rows.withColumn("at", F.explode(F.concat(of(zero, 0), of(one, 1))))


def scanner_agreement(evidence: DataFrame, scanner: DataFrame, slack: int = 3) -> DataFrame:
    """repo, fid of findings with a citation within slack lines of a scanner's.

    Whether there is one is a semi-join with the distinct blocks of the scanner's spans and of their first lines, so no pairs are made.
    """
    a = evidence.select("repo", "fid", "path", (F.col("start_line").cast("long") - slack).alias("a"), (F.col("end_line").cast("long") + slack).alias("z")).where("z >= a")
    b = scanner.select("repo", "path", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("z")).where("z >= a")
    levels, line = level_of(a, b), F.col("a")
    asked = met_in(a, blocks_around(line, levels), blocks_of(line + 1, F.col("z"), levels)).select("repo", "fid", "path", "at")
    held = met_in(b, blocks_of(line, F.col("z"), levels), blocks_around(line, levels)).select("repo", "path", "at").distinct()
    return asked.join(held, ["repo", "path", "at"], "left_semi").select("repo", "fid").distinct().hint("merge")  # as in stored


def assign_tiers(findings: DataFrame, evidence: DataFrame, scanner: DataFrame | None) -> DataFrame:
    """Adds tier: supported where the scanner agrees; suspected otherwise, and always without a scanner."""
    if scanner is None:
        return findings.withColumn("tier", F.lit("suspected"))
    agreed = scanner_agreement(evidence, scanner).withColumn("agrees", F.lit(True))
    return findings.join(agreed, ["repo", "fid"], "left").withColumn("tier", F.when(F.col("agrees"), "supported").otherwise("suspected")).drop("agrees")


def anchor_regions(truth: DataFrame, lines: DataFrame, anchor: str = "anchor") -> DataFrame:
    """The columns of truth, start_line, end_line of items whose anchor is on exactly one line of their file: one pass over a file for all its anchors."""
    found = asked_of_files(truth, F.col(anchor), lines, F.col("text"), anchor_counts).where("found.n = 1")
    at = F.col("found.first")
    return found.select("row.*", "found").select(*truth.columns, F.greatest(F.lit(1), at - F.col("radius")).alias("start_line"), (at + F.col("radius")).alias("end_line"))


#: Order in which a finding is credited: live weaknesses, fixed ones, decoys.
LIVE, FIXED, DECOY = 0, 1, 2


def truth_regions(truth: DataFrame, lines: DataFrame, patched: bool = False) -> DataFrame:
    """repo, path, id, kind, cwes, start_line, end_line of the items that one tree resolves.

    truth: repo, path, id, anchor, patched_anchor, radius, cwes (list), is_decoy. In the patched twin weaknesses lie at their patched anchor.
    """
    place = F.when(~F.col("is_decoy") & F.lit(patched), F.col("patched_anchor")).otherwise(F.col("anchor"))
    kind = F.when(F.col("is_decoy"), DECOY).otherwise(FIXED if patched else LIVE)
    found = anchor_regions(truth.withColumn("place", place), lines, "place")
    return found.select("repo", "path", "id", kind.alias("kind"), "cwes", "start_line", "end_line")


def best_match(candidates: DataFrame) -> DataFrame:
    """One item a finding: one that lists its CWE first, then no decoy, then by kind, then by id. Rows: repo, fid, same_cwe, s_kind, s_id."""
    # A minimum, which each task takes of its own rows before any is shuffled.
    best = F.min(F.struct((~F.col("same_cwe")).alias("other"), (F.col("s_kind") == DECOY).alias("decoy"), "s_kind", "s_id"))
    return candidates.groupBy("repo", "fid").agg(best.alias("b")).select("repo", "fid", (~F.col("b.other")).alias("same_cwe"), "b.s_kind", "b.s_id")


def match_truth(evidence: DataFrame, findings: DataFrame, regions: DataFrame) -> DataFrame:
    """repo, fid, cwe, item, kind (null: in no region) of every finding that isn't rejected; regions as truth_regions gives them."""
    if "tier" in findings.columns:
        findings = findings.where("tier <> 'rejected'")
    met = touching(evidence.select("repo", "fid", "path", "start_line", "end_line"), regions.select("repo", "path", "id", "kind", "cwes", "start_line", "end_line"), ["repo", "path"])
    met = met.join(findings.select("repo", "fid", "cwe"), ["repo", "fid"]).withColumn("same_cwe", F.coalesce(F.array_contains("s_cwes", F.col("cwe")), F.lit(False)))
    best = best_match(met)
    return findings.select("repo", "fid", "cwe").join(best.select("repo", "fid", F.col("s_id").alias("item"), F.col("s_kind").alias("kind")), ["repo", "fid"], "left")


def hits_at_change(evidence: DataFrame, changes: DataFrame, slack: int = 3) -> DataFrame:
    """item, repo, fid of citations within slack lines of changed lines (repo, path, item, start_line, end_line)."""
    return touching(evidence.select("repo", "fid", "path", "start_line", "end_line"), changes, ["repo", "path"], slack).select(F.col("s_item").alias("item"), "repo", "fid").distinct()
