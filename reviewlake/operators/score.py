"""Scores against ground truth: seeded weaknesses, file pairs, real fixes, labelled cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.scalars import apply_each, apply_fixes, ratio
from reviewlake.operators.intervals import DECOY, FIXED, LIVE, anchor_regions, touching
from reviewlake.sources.storage import stored

#: Categories of labelled cases and the CWE numbers that count for each.
CASE_CLASSES = {
    "pathtraver": [22, 23, 36, 73, 98],
    "cmdi": [78, 77, 88],
    "codeinj": [94, 95, 96],
    "deserialization": [502],
    "hash": [328, 327, 326, 916],
    "ldapi": [90],
    "redirect": [601],
    "securecookie": [614, 1004, 319, 311],
    "sqli": [89, 564],
    "trustbound": [501],
    "weakrand": [330, 331, 335, 336, 337, 338],
    "xpathi": [643, 91],
    "xss": [79, 80, 116],
    "xxe": [611, 776, 827],
}


def score_summary(matches: DataFrame, truth: DataFrame, patched: bool = False) -> DataFrame:
    """One row a repository of one tree: found, decoys_flagged and patched_still_flagged (sorted ids), unlisted (findings in no
    region), missed_count, totals, recall and precision (not rounded). Totals count every item; false positives are flagged decoys
    and fixed weaknesses and unlisted findings. In a patched tree all weaknesses are fixed ones.
    """
    ids = lambda kind, name: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item")))).alias(name)
    hit = matches.groupBy("repo").agg(ids(LIVE, "found"), ids(DECOY, "decoys_flagged"), ids(FIXED, "patched_still_flagged"), F.count_if(F.col("item").isNull()).alias("unlisted"))
    live, fixed = (F.lit(0), F.count_if(~F.col("is_decoy"))) if patched else (F.count_if(~F.col("is_decoy")), F.lit(0))
    total = truth.groupBy("repo").agg(live.cast("long").alias("weaknesses"), F.count_if("is_decoy").alias("decoys"), fixed.cast("long").alias("patched"))
    none = F.array().cast("array<string>")
    both = total.join(hit, "repo", "left").select("repo", "weaknesses", "decoys", "patched", *(F.coalesce(c, none).alias(c) for c in ("found", "decoys_flagged", "patched_still_flagged")), F.coalesce("unlisted", F.lit(0)).alias("unlisted"))
    n = F.size("found").cast("long")
    wrong = F.size("decoys_flagged") + F.size("patched_still_flagged") + F.col("unlisted")
    return both.withColumns({"missed_count": F.col("weaknesses") - n, "recall": ratio(n, F.col("weaknesses"), None), "precision": ratio(n, n + wrong, None)})


def pair_sides(ids: DataFrame, found: DataFrame, still: DataFrame) -> DataFrame:
    """id, detected, still_flagged, pair_correct."""
    a, b = found.select("id").distinct().withColumn("d", F.lit(True)), still.select("id").distinct().withColumn("s", F.lit(True))
    both = ids.select("id").distinct().join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("d", F.lit(False)).alias("detected"), F.coalesce("s", F.lit(False)).alias("still_flagged"))
    return both.withColumn("pair_correct", F.col("detected") & ~F.col("still_flagged"))


def pair_accuracy(sides: DataFrame) -> DataFrame:
    return sides.agg(F.count("*").alias("pairs"), F.count_if("pair_correct").alias("correct"), ratio(F.count_if("pair_correct"), F.count("*"), None).alias("accuracy"))


def flag_modules(evidence: DataFrame, findings: DataFrame, modules: DataFrame) -> DataFrame:
    """repo, fid, module (of the first citation in a known module, or null), flagged: the CWE is in the module's list.

    modules: id, cwes, and repo where modules differ by repository. Rejected findings are left out.
    """
    if "tier" in findings.columns:
        findings = findings.where("tier <> 'rejected'")
    on = [c for c in ("repo", "id") if c in modules.columns]
    top = evidence.withColumn("id", F.substring_index("path", "/", 1)).join(modules.select(*on, "cwes").distinct(), on).groupBy("repo", "fid").agg(F.min_by(F.struct("id", "cwes"), "ev_ord").alias("m"))
    return findings.select("repo", "fid", "cwe").join(top, ["repo", "fid"], "left").select("repo", "fid", F.col("m.id").alias("module"), F.coalesce(F.array_contains("m.cwes", F.col("cwe")), F.lit(False)).alias("flagged"))


def score_items(vulnerable: DataFrame, fixed: DataFrame, items: DataFrame, changes: DataFrame, slack: int = 3) -> DataFrame:
    """id, detected, detected_at_change, fixed_flagged, pair_correct, other findings of both sides.

    A side has a row for each citation: repo, path, fid, cwe, start_line, end_line, rejected. items: id, repo, path, cwes, a row
    for each file; changes: item, repo, path, start_line, end_line.
    """
    def side(citations, name):
        met = items.join(citations, ["repo", "path"]).withColumn("own", F.array_contains("cwes", F.col("cwe")) & ~F.col("rejected"))
        return met.groupBy("id", "fid").agg(F.bool_or("own").alias("own")).groupBy("id").agg(F.bool_or("own").alias(name), F.count_if(~F.col("own")).alias(f"other_{name}"))

    # Only changes in an item's own files, and only findings that count as detected there.
    own = changes.join(items.select(F.col("id").alias("item"), "repo", "path", "cwes"), ["item", "repo", "path"])
    hit = touching(vulnerable.where("not rejected"), own, ["repo", "path"], slack).where(F.array_contains("s_cwes", F.col("cwe")))
    near = hit.select(F.col("s_item").alias("id")).distinct().withColumn("near", F.lit(True))
    out = items.select("id").distinct().join(side(vulnerable, "v"), "id", "left").join(side(fixed, "f"), "id", "left").join(near, "id", "left")
    no, zero = F.lit(False), F.lit(0)
    return out.select("id", F.coalesce("v", no).alias("detected"), F.coalesce("near", no).alias("detected_at_change"), F.coalesce("f", no).alias("fixed_flagged"), (F.coalesce("v", no) & ~F.coalesce("f", no)).alias("pair_correct"), F.coalesce("other_v", zero).alias("other_findings_vulnerable"), F.coalesce("other_f", zero).alias("other_findings_fixed"))


def holdout_cases(cases: DataFrame, names: DataFrame) -> DataFrame:
    """The cases that are listed."""
    return cases.join(names.select("name").distinct(), "name", "left_semi")


def flag_cases(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """repo, name, flagged: a finding that isn't rejected, of the case's classes, cites the case's file.

    citations: a row for each citation of a finding (repo, path, cwe, rejected); cases: repo, name, path, classes.
    """
    own = F.col("rejected").isNotNull() & ~F.col("rejected") & F.array_contains("classes", F.col("f_cwe"))
    f = citations.select("repo", "path", F.col("cwe").alias("f_cwe"), "rejected")
    return cases.join(f, ["repo", "path"], "left").groupBy("repo", "name").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("flagged"))


def score_cases(flags: DataFrame, answered_only: bool = False) -> DataFrame:
    """category (null: all), real, fake, true and false positives, tpr, fpr, score; not rounded.

    flags: category, real, flagged, and error (null: answered) if only answered cases are to count.
    """
    flags = flags.where("error is null") if answered_only else flags
    n = flags.withColumn("real", F.col("real").cast("boolean")).withColumn("flagged", F.col("flagged").cast("boolean")).rollup("category").agg(F.count_if("real").alias("n_real"), F.count_if(~F.col("real")).alias("n_fake"), F.count_if(F.col("real") & F.col("flagged")).alias("tp"), F.count_if(~F.col("real") & F.col("flagged")).alias("fp"))
    return n.withColumn("tpr", ratio(F.col("tp"), F.col("n_real"), None)).withColumn("fpr", ratio(F.col("fp"), F.col("n_fake"), None)).withColumn("score", F.col("tpr") - F.col("fpr"))


def found_minus_still(sides: DataFrame) -> DataFrame:
    """Ids that are detected and not still flagged on the fixed side."""
    return sides.where("detected").select("id").subtract(sides.where("still_flagged").select("id"))


def all_modules(detected: DataFrame, missed_ids: DataFrame) -> DataFrame:
    """Every id of a run, detected or missed, once."""
    return detected.select("id").union(missed_ids.select("id")).distinct()


def missed(ids: DataFrame, detected: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(detected.select("id"), "id", "left_anti")


def apply_truth(files: DataFrame, truth: DataFrame) -> DataFrame:
    """repo, path, text, bad: each file after the ordered fixes of its truth items (id, old, new); bad is the first step that doesn't fit."""
    rows = F.array_sort(F.collect_list(F.struct("id", "old", "new")))
    steps = truth.groupBy("repo", "path").agg(F.transform(rows, lambda s: F.struct(s["old"].alias("old"), s["new"].alias("new"))).alias("steps"))
    same = F.struct(F.col("content").alias("text"), F.lit(None).cast("int").alias("bad"))
    done = F.when(F.col("steps").isNull(), same).otherwise(apply_fixes(F.col("content"), F.col("steps")))
    return files.join(steps, ["repo", "path"], "left").select("repo", "path", done.alias("x")).select("repo", "path", "x.text", "x.bad")


def fix_steps(truth: DataFrame) -> DataFrame:
    """repo, id, step, path, old, new of all weaknesses. truth has old and new, or fix: an array of (file, old, new), where no file means the item's."""
    weak = truth.where("not is_decoy")
    if "fix" not in truth.columns:
        return weak.select("repo", "id", F.lit(0).alias("step"), "path", "old", "new")
    each = weak.select("repo", "id", "path", F.posexplode("fix").alias("step", "f"))
    return each.select("repo", "id", "step", F.coalesce("f.file", "path").alias("path"), "f.old", "f.new")


def fixed_tree(files: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree after all steps (repo, path, content), and the items whose fix doesn't apply (repo, id, step, path).

    Steps (repo, id, step, path, old, new) are folded over each file in the order of id and step; each one's old text must stand in the
    file once at its turn. An item counts as a whole: with one step that doesn't fit, in whatever file, none of its steps is taken, and
    the fold is done again without it, until all that is left fits. Only files with steps are folded.
    """
    key, errors = ["repo", "path"], None
    while True:
        row = F.struct("id", "step", "old", "new")
        per_file = steps.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("steps"))
        touched = stored(files.join(per_file, key).withColumn("x", apply_each(F.col("content"), F.col("steps"))).select(*key, "x.text", "x.bad"), "folded")
        wrong = touched.select(*key, F.explode("bad").alias("s")).select("repo", "s.id", "s.step", "path")
        missing = steps.join(files.select(*key), key, "left_anti").select("repo", "id", "step", "path")
        wrong = stored(wrong.unionByName(missing), "wrong_steps")
        errors = wrong if errors is None else errors.unionByName(wrong)
        if not wrong.head(1):
            break
        steps = steps.join(wrong.select("repo", "id").distinct(), ["repo", "id"], "left_anti")
    tree = files.join(touched.select(*key, "text"), key, "left").select(*key, F.coalesce("text", "content").alias("content"))
    return tree, errors


def patched_twin(files: DataFrame, truth: DataFrame) -> DataFrame:
    """repo, path, content, bad: the tree with every weakness fixed. truth: id, old, new, is_decoy."""
    return apply_truth(files, truth.where("not is_decoy")).select("repo", "path", F.col("text").alias("content"), "bad")


def check_truth(truth: DataFrame, lines: DataFrame, twin: DataFrame, twin_lines: DataFrame) -> DataFrame:
    """repo, id, violation, one row for each rule that an item breaks.

    Every anchor is on one line; each fix applies alone (its old text occurs once); the twin holds no old text, unless the new
    one contains it; decoys and patched anchors are on one line of the twin. truth: repo, path, id, anchor, patched_anchor,
    old, new, radius, is_decoy; twin: repo, path, content.
    """
    def unresolved(rows, tree, anchor, violation):
        at = anchor_regions(rows, tree, anchor).select("repo", "id")
        return rows.select("repo", "id").join(at, ["repo", "id"], "left_anti").withColumn("violation", F.lit(violation))

    weak, decoys = truth.where("not is_decoy"), truth.where("is_decoy")
    content = lines.join(weak.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    times = lambda c: (F.length(c) - F.length(F.replace(F.col(c), F.col("old"), F.lit("")))) / F.length("old")
    alone = weak.join(content, ["repo", "path"], "left").where(F.coalesce(times("content"), F.lit(0.0)) != 1).select("repo", "id", F.lit("fix does not apply").alias("violation"))
    left = weak.join(twin.select("repo", "path", "content"), ["repo", "path"]).where(F.contains("content", "old") & ~F.contains("new", "old")).select("repo", "id", F.lit("old text is left").alias("violation"))
    checks = [unresolved(truth, lines, "anchor", "anchor does not resolve"), alone, left, unresolved(decoys, twin_lines, "anchor", "decoy does not survive"), unresolved(weak, twin_lines, "patched_anchor", "patched anchor does not resolve")]
    return reduce(DataFrame.unionByName, checks)


def repeated_ids(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that occur more than once, with n; ids are unique if there is none."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def in_both(one: DataFrame, other: DataFrame, *key: str) -> DataFrame:
    """The keys on both sides; splits are disjoint if there is none."""
    return one.select(*key).intersect(other.select(*key))
