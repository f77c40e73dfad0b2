"""Readers and writers: repository trees, scanner results, answer keys, saved runs, changed ranges, reports, chat records."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.scalars import finding_markdown, normalise_cwe
from reviewlake.operators.citations import quote_spans
from reviewlake.sources import trees

#: Folders that are not read, the largest file, and how far a NUL byte marks a binary file.
SKIPPED_FOLDERS = [".git", "node_modules", ".venv", "venv", "vendor", "dist", "build", "__pycache__", ".idea", ".next", "target", ".tox", ".mypy_cache"]
LARGEST_FILE, BINARY_PROBE = 400_000, 8_192
SCANNER = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,metadata:struct<cwe:string>>>>"
STATS = "struct<errors:array<string>,seconds:double,largest_prompt_tokens:long>"
#: Files and folders that Spark's readers leave out.
HIDDEN = r"(^|/)(\.|_[^/=]*(/|$))|\._COPYING_$"
#: The layout of saved results: seeded runs, file pairs and real fixes keep different fields of a run.
RUNS = (
    "summary struct<target:string,model:string,mode:string,prompt:string,context:string,temperature:double>, runs array<struct<seed:int,pair_accuracy:double,"
    "vulnerable:struct<recall:double,precision:double,found:array<string>,decoys_flagged:array<string>,unlisted:long,seconds:double,errors:array<string>>,"
    "patched:struct<patched_still_flagged:array<string>,seconds:double,errors:array<string>>,"
    f"detected:array<string>,missed:array<string>,secure_flagged:array<string>,pair_correct:array<string>,stats_vulnerable:{STATS},stats_secure:{STATS},"
    "items:array<struct<id:string,detected:boolean,detected_at_change:boolean,fixed_flagged:boolean,pair_correct:boolean,other_findings_vulnerable:long,other_findings_fixed:long,"
    f"stats_vulnerable:{STATS},stats_fixed:{STATS}>>>>"
)
CONFIG = ["target", "model", "mode", "prompt", "context", "temperature"]


def read_tree(spark: SparkSession, root: str, repo: str, partition_bytes: int = trees.PARTITION_BYTES) -> DataFrame:
    """repo, path, content of a tree's text files.

    Skipped folders are not listed, files over the limit are not opened, and tasks get about partition_bytes each
    (trees). A store that only Spark opens is read by Spark's own file reader, which lists and filters the whole tree.
    """
    root = root if re.match("[a-z0-9]+:", root) else Path(root).absolute().as_uri()
    if trees.opens(root):
        kept = tree_files(spark, root, skipped="/".join(SKIPPED_FOLDERS), largest=LARGEST_FILE, partition_bytes=partition_bytes).withColumn("rel", F.col("path"))
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
        # The path without scheme and host, then without the root, cut by length.
        path = F.substring(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?/*", "/"), len(base) + 2, 1 << 20)
        folders = F.split(path, "/")
        above = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
        kept = raw.where(F.col("length") <= LARGEST_FILE).withColumn("rel", path).where(~F.arrays_overlap(above, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    text = kept.where(F.position(F.lit(b"\x00"), F.substring("content", 1, BINARY_PROBE)) == 0)
    return text.select(F.lit(repo).alias("repo"), F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_scanner(spark: SparkSession, path: str, lines: DataFrame, repo: str | None = None) -> DataFrame:
    """Scanner JSON as findings that cite the lines they name; results on other files are left out. Without repo the files lie in folders repo=<name>."""
    raw = spark.read.schema(SCANNER if repo else f"{SCANNER}, repo string").json(path, multiLine=True)
    r = raw.select(F.lit(repo).alias("repo") if repo else "repo", F.explode("results").alias("r")).select("repo", "r.*")
    rows = r.select("repo", "path", F.substring_index("check_id", ".", -1).alias("title"), F.col("start.line").alias("start_line"), F.col("end.line").alias("end_line"), normalise_cwe(F.col("extra.metadata.cwe")).alias("cwe"), F.substring(F.coalesce("extra.message", F.lit("")), 1, 400).alias("summary"))
    known = rows.join(lines.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return quote_spans(known, lines)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """name, category, real, cwe of an answer key; rows that begin with # are skipped."""
    return spark.read.csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema="name string, category string, real string, cwe int").withColumn("real", F.lower("real") == "true")


def read_runs(spark: SparkSession, path: str, target: str = "seeded") -> DataFrame:
    """One row a run of saved result files: CONFIG, seed and run (its fields). target names the runs whose file gives none."""
    r = spark.read.schema(RUNS).json(path, multiLine=True).select("summary.*", F.explode("runs").alias("run"))
    return r.select(F.coalesce("target", F.lit(target)).alias("target"), "model", "mode", F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("context", F.lit("none")).alias("context"), "temperature", F.coalesce("run.seed", F.lit(0)).alias("seed"), "run")


CHANGES = "fix string, parent string, ranges map<string,array<array<int>>>"
#: How many files a task reads at a time: as few bytes as they have, what costs is opening them.
CHANGES_BYTES = 32 << 20


def tree_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """path (below the root), length, content of a tree that Arrow opens."""
    trees.register(spark)
    return spark.read.format("source_tree").options(**options).load(root)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """item (the file's folder), path, start_line, end_line from {fix, parent, ranges: {path: [[start, end]]}}.

    There are as many folders as items, so they are walked by the tree reader; Spark's own lists each of them in a task. Names that
    Spark takes for hidden are left out.
    """
    root = path if re.match("[a-z0-9]+:", path) else Path(path).absolute().as_uri()
    if trees.opens(root):
        whole = F.concat(F.lit("/" + unquote(root.rstrip("/").rsplit("/", 1)[-1]) + "/"), "path")
        shown = tree_files(spark, root, partition_bytes=CHANGES_BYTES).where(~F.col("path").rlike(HIDDEN))
        raw = shown.select(F.element_at(F.split(whole, "/"), -2).alias("item"), F.from_json(F.col("content").cast("string"), CHANGES)["ranges"].alias("ranges"))
    else:
        raw = spark.read.schema(CHANGES).json(path, multiLine=True, recursiveFileLookup=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("item"), "ranges")
        raw = raw.withColumn("item", F.url_decode("item"))
    return raw.select("item", F.explode("ranges").alias("path", "spans")).select("item", "path", F.explode("spans").alias("s")).select("item", "path", F.col("s")[0].alias("start_line"), F.col("s")[1].alias("end_line"))


def write_changes(changes: DataFrame, path: str, tasks: int | None = None) -> None:
    """A file of changed ranges, as read_changes reads it, in a folder for each item. changes: item, value (the file's text), an item once.

    Dealt to tasks by item; where Arrow opens the store a task writes through it, since Spark's writer on a local disk starts a
    process for each file.
    """
    root = path if re.match("[a-z0-9]+:", path) else Path(path).absolute().as_uri()
    dealt = changes.select("item", "value").repartition(tasks or 4 * changes.sparkSession.sparkContext.defaultParallelism, "item")
    if not trees.opens(root):
        dealt.write.partitionBy("item").mode("overwrite").text(path)
        return

    def write(rows):
        store, top = fs.FileSystem.from_uri(root)
        for row in rows:
            folder = f"{top.rstrip('/')}/{row.item}"
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/changes.json") as f:
                f.write(row.value.encode())

    dealt.foreachPartition(write)


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON, a folder for each repository."""
    findings.write.partitionBy("repo").mode("overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON line a repository, as scan_stats gives it."""
    stats.write.partitionBy("repo").mode("overwrite").json(path)


def report_parts(findings: DataFrame, model: str) -> DataFrame:
    """repo, rank, value: a heading with counts (rank 0), then a section for each finding that isn't rejected.

    findings: repo, rank, finding (struct), and checks where there are any.
    """
    shown = F.count_if(F.col("finding.tier") != "rejected")
    counts = F.concat(F.lit("Reported: "), shown.cast("string"), F.lit(". Dropped, for nothing that they cite was found: "), (F.count("*") - shown).cast("string"), F.lit("."))
    tiers = "A finding is `supported` where a scanner points at the same lines, else `suspected`; hedged ones end their tier."
    title = F.concat(F.lit("# What the review of `"), "repo", F.lit(f"` found\n\nReviewer: `{model}`\n"))
    head = findings.groupBy("repo").agg(counts.alias("counts")).select("repo", F.lit(0).alias("rank"), F.concat(title, "counts", F.lit(f"\n\n{tiers}\n")).alias("value"))
    checks = F.col("checks") if "checks" in findings.columns else None
    section = findings.select("repo", "rank", finding_markdown(F.col("finding"), checks).alias("value")).where("value is not null")
    return head.unionByName(section)


def write_report(findings: DataFrame, path: str, model: str = "") -> None:
    """Markdown, a folder for each repository."""
    report_parts(findings, model).repartition("repo").sortWithinPartitions("repo", "rank").drop("rank").write.partitionBy("repo").mode("overwrite").text(path)


def write_chat_jsonl(records: DataFrame, path: str) -> None:
    """Chat records (side, record) as JSON lines, a folder for each side."""
    records.select("side", F.col("record").alias("value")).write.partitionBy("side").mode("overwrite").text(path)
