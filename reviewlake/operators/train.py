"""Case sources, planted notes and filtered training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.scalars import extension, mentions_key, strip_gutter, valid_finding
from reviewlake.operators.findings import parsed_answers
from reviewlake.operators.select import last_rows
from reviewlake.sources.storage import stored

#: A case's licence header, and paths that spell out its category.
HEADER = r"\A\s*'''(?s:.*?)'''\s*\n"
CATEGORY_PATH = r"(/benchmark/|web/)[a-z]+-\d+/"
HASH_COMMENTS = [".py", ".sh", ".yml", ".yaml", ".tf"]


#: Why an answer isn't used for training.
INVALID, NOTHING_KEPT = "not JSON", "no finding of the label that holds"


def neutralise(src: Column) -> Column:
    """Without the first header and what names the category: in paths, and in a message that all cases of one category share."""
    bare = F.regexp_replace(F.regexp_replace(src, HEADER, ""), CATEGORY_PATH, "$1cases/")
    return F.replace(bare, F.lit("executing cmdi"), F.lit("executing command"))


def file_texts(lines: DataFrame) -> DataFrame:
    """repo, path, content."""
    return lines.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))


def plant_note(files: DataFrame, truth: DataFrame, note: str) -> DataFrame:
    """A comment before every file that holds a weakness."""
    weak = truth.where("not is_decoy").select("repo", "path").distinct().withColumn("weak", F.lit(True))
    mark = F.when(extension(F.col("path")).isin(HASH_COMMENTS), "# ").otherwise("// ")
    return files.join(weak, ["repo", "path"], "left").select("repo", "path", F.when(F.col("weak"), F.concat(mark, F.lit(note + "\n"), "content")).otherwise(F.col("content")).alias("content"))


def case_tree(files: DataFrame, cases: DataFrame, helpers: DataFrame, without: str) -> DataFrame:
    """Neutralised sources of the cases, and the shared helper files outside a folder."""
    own = files.join(cases.select("repo", "path").distinct(), ["repo", "path"], "left_semi").withColumn("content", neutralise(F.col("content")))
    return own.select("repo", "path", "content").unionByName(helpers.where(~F.col("path").startswith(without)).select("repo", "path", "content"))


def neutral_pairs(files: DataFrame, modules: DataFrame, vulnerable: str, secure: str) -> tuple[DataFrame, DataFrame]:
    """Both versions of each module (repo, id) as <module>/handler<ext> (repo, side, module, path, content), and the modules that lack one."""
    wanted = modules.select("repo", F.col("id").alias("module"), F.explode(F.create_map(F.lit("vulnerable"), F.lit(vulnerable), F.lit("secure"), F.lit(secure))).alias("side", "file"))
    wanted = wanted.withColumn("path", F.concat("module", F.lit("/"), "file"))
    found = wanted.join(files.select("repo", "path", "content"), ["repo", "path"]).select("repo", "side", "module", F.concat("module", F.lit("/handler."), F.substring_index("file", ".", -1)).alias("path"), "content")
    return found, wanted.join(files.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "module", "side")


def parsed_teacher(teacher: DataFrame) -> DataFrame:
    """Parsed answers of the last attempt of each name, with their valid findings. Written out: they are read again and again, and parsed once."""
    parsed = parsed_answers(last_rows(teacher, ["repo", "name"]))
    return stored(parsed.withColumn("findings", F.filter("findings", valid_finding)), "parsed")


def teacher_evidence(teacher: DataFrame) -> DataFrame:
    """repo, fid (case and number of the finding), ev_ord and the citation, for each citation of a teacher's parsed findings."""
    each = teacher.select("repo", "name", F.posexplode("findings").alias("n", "f")).select("repo", F.concat_ws("#", "name", F.col("n").cast("string")).alias("fid"), F.posexplode("f.evidence").alias("ev_ord", "e"))
    return each.select("repo", "fid", "ev_ord", "e.*")


def with_verified(teacher: DataFrame, checked: DataFrame) -> DataFrame:
    """Adds to each finding verified: one of its citations holds; checked as check_citations gives it for teacher_evidence."""
    good = checked.where("passed").select("repo", F.substring_index("fid", "#", -1).cast("int").alias("n"), F.regexp_replace("fid", "#[0-9]+$", "").alias("name")).groupBy("repo", "name").agg(F.collect_set("n").alias("good"))
    rows = teacher.join(good, ["repo", "name"], "left")
    found = F.transform("findings", lambda f, i: f.withField("verified", F.coalesce(F.array_contains("good", i), F.lit(False))))
    return rows.withColumn("findings", found).drop("good")


def accept_answers(teacher: DataFrame) -> DataFrame:
    """Adds status, kept (at most two findings, quotes without a copied gutter) and analysis without blank entries.

    teacher: error (null: parsed), analysis, real, classes, findings with verified.
    """
    analysis = F.filter("analysis", lambda a: F.regexp_replace(a, r"(?U)\s", "") != "")
    good = F.filter("findings", lambda f: F.array_contains("classes", f["cwe"]) & f["verified"] & ~mentions_key(F.concat_ws(" ", f["summary"], f["reasoning"])))
    rows = teacher.withColumns({"analysis": analysis, "good": good})
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    status = F.when(F.col("error").isNotNull(), INVALID).when(none("analysis"), "analysis missing").when(F.exists("analysis", mentions_key), "key mentioned").when(~F.col("real"), "ok").when(none("good"), NOTHING_KEPT).otherwise("ok")
    bare = F.transform(F.slice("good", 1, 2), lambda f: f.withField("evidence", F.transform(f["evidence"], lambda e: e.withField("quote", strip_gutter(e["quote"])))).dropFields("verified", "valid"))
    rows = rows.withColumn("status", status)
    return rows.withColumn("kept", F.when(F.col("status") == "ok", F.when(F.col("real"), bare).otherwise(F.slice(bare, 1, 0)))).drop("good")
