"""Selection: advisories and commits, stratified splits, one per repository, diffs, chat histories, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.scalars import fix_commits, published_between

#: CWE numbers of the two groups, paths of tests and documents, source extensions.
INJECTION = [22, 23, 36, 73, 77, 78, 79, 80, 88, 89, 94, 95, 116, 502, 601, 611, 918, 943, 1321, 1336]
MISSING_CHECK = [20, 284, 285, 287, 288, 290, 306, 346, 352, 639, 862, 863, 1284]
TEST_OR_DOC = r"(?i)(^|/)(tests?|spec|__tests__|e2e|docs?|examples?|fixtures?|\.github|\.changeset|changelog\.d|newsfragments)(/|$)|(_test|_spec|\.test|\.spec)\.[a-z]+$|(^|/)test_[^/]*$"
SOURCE = r"(?i)\.(py|js|mjs|cjs|ts|tsx|jsx|vue|svelte|html?|jinja2?|j2|ejs|hbs)$"
#: What stands for an old tool message.
STUB = "(an older result stood here; repeat the call to see it)"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"


def seeded(seed: str, name: Column) -> Column:
    """A repeatable order."""
    return F.md5(F.concat(F.lit(seed), name))


def filter_advisories(advisories: DataFrame, lo: str, hi: str) -> DataFrame:
    """Published in the window, not withdrawn, PIP or NPM, a CWE of either group, one distinct fix commit."""
    commits = fix_commits(F.col("references"))
    distinct = F.array_distinct(F.transform(commits, lambda c: F.struct(F.lower(c["repo"]), F.substring(c["sha"], 1, 12))))
    wanted = F.array(*map(F.lit, INJECTION + MISSING_CHECK))
    return advisories.where(published_between(F.col("published"), lo, hi) & ~F.col("withdrawn") & F.arrays_overlap("ecosystems", F.array(F.lit("PIP"), F.lit("NPM"))) & F.arrays_overlap("cwes", wanted) & (F.size(distinct) == 1)).withColumn("commit", commits[0])


def usable_commits(files: DataFrame) -> DataFrame:
    """sha, n_source, n_modified, changes, files (names of modified source files, sorted) of commits with one parent, 1-3 source files, one modified at least, 80 changed lines at most."""
    source = F.col("filename").rlike(SOURCE) & ~F.col("filename").rlike(TEST_OR_DOC)
    modified = source & (F.col("status") == "modified")
    one = files.groupBy("sha").agg(
        F.bool_and("one_parent").alias("one_parent"), F.count_if(source).alias("n_source"), F.count_if(modified).alias("n_modified"),
        F.coalesce(F.sum(F.when(source, F.col("changes"))), F.lit(0)).alias("changes"), F.array_sort(F.collect_list(F.when(modified, F.col("filename")))).alias("files"),
    )
    return one.where("one_parent and n_source between 1 and 3 and n_modified > 0 and changes <= 80").drop("one_parent")


def weakness_group(cwes: Column) -> Column:
    """Injection if any of the CWE numbers is one."""
    return F.when(F.arrays_overlap(cwes, F.array(*map(F.lit, INJECTION))), "injection").otherwise("missing check")


def hashed_rank(rows: DataFrame, group: list[str], h: str, ties: list[str]) -> DataFrame:
    """Adds rank (from 1) and total of each group in the order of a hex hash, then ties.

    Ranks come from counts of hash buckets and a rank inside each bucket, so no task orders a whole group.
    """
    rows = rows.withColumn("bucket", F.substring(h, 1, 3))
    per = rows.groupBy(*group, "bucket").agg(F.count("*").alias("size"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    every = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = per.select(*group, "bucket", (F.sum("size").over(w.orderBy("bucket")) - F.col("size")).alias("before"), F.sum("size").over(every).alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(h, *ties))
    return rows.join(before, [*group, "bucket"]).withColumn("rank", rank).drop("bucket", "before")


def one_per_repo(rows: DataFrame, seed: str) -> DataFrame:
    """The first row of each repository (case ignored) in seeded order, with its group by all its CWE numbers (cwes) and rank in the group."""
    rows = rows.withColumn("h", seeded(seed, F.col("id")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(F.lower("repo")).orderBy("h", "id"))).where("n = 1").drop("n").withColumn("grp", weakness_group(F.col("cwes")))
    return hashed_rank(first, ["grp"], "h", ["id"]).drop("h", "total")


def cwe_overlap(cwes: Column, family: list[int] = INJECTION) -> Column:
    """The CWE numbers of a list that belong to a family."""
    return F.array_intersect(cwes, F.array(*map(F.lit, family)))


def top_per_group(ranked: DataFrame, n: int = 40) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def stratified_split(cases: DataFrame, train: int, holdout: int, seed: str) -> DataFrame:
    """Adds side: per (category, real) in seeded order min(holdout, a third) are held out, the next `train` train, the rest has none."""
    ranked = hashed_rank(cases.withColumn("h", seeded(seed, F.col("name"))), ["category", "real"], "h", ["name"])
    held = F.least(F.lit(holdout), F.floor(F.col("total") / 3))
    side = F.when(F.col("rank") <= held, "holdout").when(F.col("rank") <= held + train, "train")
    return ranked.withColumn("side", side).select(*cases.columns, "side")


def diff_ranges(diffs: DataFrame) -> DataFrame:
    """diff, path, start, end: old-side line ranges; an insertion after a gives (a, a + 1). A header counts only before a `+++ ` line."""
    w = Window.partitionBy("diff").orderBy("n")
    head = F.col("text").startswith("--- ") & F.coalesce(F.lead("text").over(w).startswith("+++ "), F.lit(False))
    name = F.trim(F.substring(F.col("text"), 5, 1 << 20))
    rows = diffs.withColumn("head", F.when(head, F.when(name.startswith("a/"), F.substring(name, 3, 1 << 20)).otherwise(""))).withColumn("path", F.last("head", ignorenulls=True).over(w))
    hunks = rows.where(F.col("text").rlike(HUNK) & F.col("path").isNotNull() & (F.col("path") != ""))
    start, count = F.regexp_extract("text", HUNK, 1).cast("int"), F.regexp_extract("text", HUNK, 2)
    n = F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(text, '^@@ -[0-9]+,([0-9]+)', 1) as int)"))
    return hunks.select("diff", "path", start.alias("start"), F.when(n == 0, start + 1).otherwise(start + n - 1).alias("end"))


def compact_history(messages: DataFrame, role: str = "tool", keep_last: int = 6, limit: int = 400) -> DataFrame:
    """In each conversation, long bodies of the role's messages but the last ones become a stub."""
    stub = F.lit(STUB)
    back = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"), F.desc("text")))
    return messages.withColumn("back", back).withColumn("text", F.when((F.col("role") == role) & (F.col("back") > keep_last) & (F.length("text") > limit), stub).otherwise(F.col("text"))).drop("back")


def resume_todo(cases: DataFrame, log: DataFrame) -> DataFrame:
    """The cases that the log has no row of; by repository too, where both have one."""
    key = [c for c in ("repo", "name") if c in cases.columns and c in log.columns]
    return cases.join(log.select(*key), key, "left_anti")


def last_rows(log: DataFrame, key: list[str] = ("name",)) -> DataFrame:
    """The last attempt of each name."""
    return log.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("attempt")))).where("n = 1").drop("n")


def train_valid(accepted: DataFrame, seed: str) -> DataFrame:
    """Adds side: in seeded order the first max(1, a tenth) valid, the rest train."""
    ranked = hashed_rank(accepted.withColumn("h", seeded(seed, F.col("name"))), [], "h", ["name"])
    return ranked.withColumn("side", F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("total") / 10)), "valid").otherwise("train")).drop("h", "rank", "total")


def select_advisories(advisories: DataFrame, commits: DataFrame, lo: str, hi: str, seed: str, n: int = 40) -> DataFrame:
    """The first n advisories of each weakness group, one a repository, whose fix commit is usable; with the names of its modified files.

    commits: the files of each commit, as usable_commits takes them, with repo; a commit is that of the address whose
    lower-cased repository and first 12 characters of the hash are the same.
    """
    key = lambda repo, sha: F.concat(F.lower(repo), F.lit("@"), F.substring(sha, 1, 12))
    usable = usable_commits(commits.withColumn("sha", key(F.col("repo"), F.col("sha")))).select(F.col("sha").alias("key"), "files", "changes")
    kept = filter_advisories(advisories, lo, hi).withColumn("key", key(F.col("commit.repo"), F.col("commit.sha")))
    return top_per_group(one_per_repo(kept.join(usable, "key").drop("key"), seed), n)
