"""End-to-end jobs: prompts, project maps, scans, evaluations, training sets, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.scalars import hint_lines, language_family, primary_evidence, ratio, to_chat_record, valid_finding, wrap_untrusted
from reviewlake.operators import citations, defs, findings, hints, intervals, score, select, summary, train
from reviewlake.operators.train import file_texts, plant_note
from reviewlake.plans import calls
from reviewlake.plans.calls import Reply, review_prompts
from reviewlake.sources.storage import stored

WALKTHROUGH = "Answer in JSON: `analysis`, an entry for each function or handler, then `findings`, the weaknesses that follow from it."
PLAIN = "Answer in JSON with a list `findings`."


def block_texts(blocks: DataFrame) -> DataFrame:
    """repo, path, blocks: definitions with their bodies, in order."""
    text = F.concat(F.lit("--- "), "name", F.lit(" in "), "where", F.lit(" ---\n"), "body")
    return blocks.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("blocks"))


def build_prompts(
    lines: DataFrame,
    variant: str = "plain",
    strip_comments: bool = False,
    context: DataFrame | None = None,
    size: int = 400,
    overlap: int = 40,
    paths: DataFrame | None = None,
    limit: int | None = None,
    helpers: bool = True,
) -> DataFrame:
    """repo, path, lead_rank, part, first, last, prompt of each window of every lead. context: repo, path, map; paths and limit as in leads_job."""
    shown = hints.blank_comments(lines) if strip_comments else lines
    leads = hints.rank_leads(hints.lead_hints(lines, paths), limit).withColumnRenamed("rank", "lead_rank")
    texts = shown.groupBy("repo", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("texts"))
    rows = texts.withColumn("n", F.size("texts")).join(leads.select("repo", "path", "hints", "lead_rank"), ["repo", "path"])
    if helpers:
        rows = rows.join(block_texts(defs.with_bodies(defs.helper_definitions(lines), lines)), ["repo", "path"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("string"))
    rows = rows.join(context, ["repo", "path"], "left") if context is not None else rows.withColumn("map", F.lit(None).cast("string"))
    rows = rows.select("*", F.posexplode(hints.window_spans(F.col("n"), size, overlap)).alias("part", "span")).select("*", "span.first", "span.last")
    return rows.select("repo", "path", "lead_rank", (F.col("part") + 1).alias("part"), "first", "last", prompt_text(variant).alias("prompt"))


def prompt_text(variant: str) -> Column:
    """The prompt of a row with path, n, first, last, hints, texts, blocks and map."""
    number = lambda c: F.col(c).cast("string")
    whole = (F.col("first") == 1) & (F.col("last") == F.greatest(F.col("n"), F.lit(1)))
    span = F.concat(F.lit(" Lines "), number("first"), F.lit("-"), number("last"), F.lit(" of "), number("n"), F.lit("; the other lines have prompts of their own."))
    head = F.concat(F.lit("File under review: `"), "path", F.lit("`."), F.when(whole, "").otherwise(span))
    flagged = hint_lines(F.col("hints"), 8, F.col("first"), F.col("last"))
    pointers = F.when(F.size(flagged) > 0, F.concat(F.lit("Lines that match known patterns (hints only; check them, and look beyond them):\n"), F.array_join(flagged, "\n")))
    numbered = F.array_join(F.transform(F.slice("texts", F.col("first"), F.col("last") - F.col("first") + 1), lambda t, i: F.concat((F.col("first") + i).cast("string"), F.lit("| "), t)), "\n")
    code = wrap_untrusted(F.concat(F.lit("--- "), "path", F.lit(" ---\n"), numbered))
    known = F.when(F.col("blocks").isNotNull(), F.concat(F.lit("Helpers that it imports, as background (cite `"), "path", F.lit("` only):\n"), wrap_untrusted(F.col("blocks"))))
    return F.concat_ws("\n\n", head, pointers, code, known, F.col("map"), F.lit(WALKTHROUGH if variant == "walkthrough" else PLAIN))


def in_order(row: Column) -> Column:
    """Text rows of a group, in the order of ord, one a line."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("t")))), lambda x: x["t"]), "\n")


def own_entries(entries: DataFrame, most: int = 20) -> DataFrame:
    """repo, path, mine: the entry points of a file with their protections."""
    order = F.row_number().over(Window.partitionBy("repo", "path").orderBy("line"))
    guards = F.when(F.size("guards") > 0, F.array_join("guards", ", ")).otherwise("none found")
    row = F.concat(F.lit("- line "), F.col("line").cast("string"), F.lit(": "), "route", F.lit(" ("), "name", F.lit("), protected by: "), guards)
    return entries.withColumn("ord", order).where(F.col("ord") <= most).groupBy("repo", "path").agg(F.concat(F.lit("Entry points here:\n"), in_order(row)).alias("mine"))


def peer_protections(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """repo, path, theirs: what entry points of the same family in other files are protected by."""
    peers = defs.peer_guards(entries, lines)
    once = defs.extract_definitions(lines).groupBy("repo", "family", F.col("name").alias("bare")).agg(F.count("*").alias("n"), F.min(F.concat("path", F.lit(":"), F.col("line").cast("string"))).alias("at")).where("n = 1").drop("n")
    peers = peers.withColumn("family", language_family(F.col("path"))).withColumn("bare", F.substring_index(F.regexp_replace("guard", r"[()]+$", ""), ".", -1)).join(once, ["repo", "family", "bare"], "left")
    row = F.concat(F.lit("- "), "guard", F.lit(": "), F.col("uses").cast("string"), F.lit(" uses in "), F.col("n_files").cast("string"), F.lit(" files"), F.coalesce(F.concat(F.lit("; see "), "at"), F.lit("")))
    return peers.groupBy("repo", "path").agg(F.concat(F.lit("Elsewhere "), F.max("peers").cast("string"), F.lit(" entry points of this kind use:\n"), in_order(row)).alias("theirs"))


def render_map(lines: DataFrame, most: int = 20, entries: DataFrame | None = None) -> DataFrame:
    """repo, path, map: own entry points, protections of peers, definitions of called names. entries: those of the lines, if they are known."""
    entries = defs.entry_points(lines) if entries is None else entries
    called = block_texts(defs.with_bodies(defs.called_definitions(lines), lines)).select("repo", "path", F.concat(F.lit("Functions that it calls, defined elsewhere:\n"), "blocks").alias("called"))
    files = lines.select("repo", "path").distinct().where(language_family(F.col("path")).isNotNull())
    key = ["repo", "path"]
    full = files.join(own_entries(entries, most), key, "left").join(peer_protections(entries, lines), key, "left").join(called, key, "left")
    body = F.concat_ws("\n\n", "mine", "theirs", "called")
    note = F.concat(F.lit("Map of the repository, made by pattern matching. Use it to compare; cite `"), "path", F.lit("` alone. A missing protection counts only where this entry point needs it.\n"))
    return full.where(body != "").select(*key, F.concat(note, wrap_untrusted(body)).alias("map"))


def evidence_notes(checked: DataFrame) -> DataFrame:
    """repo, fid, notes (what the check says of each citation that isn't exact, in order), n_cited."""
    said = F.when(F.col("detail") != "exact", F.struct("ev_ord", F.concat("path", F.lit(": "), "detail").alias("t")))
    notes = F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"])
    return checked.groupBy("repo", "fid").agg(notes.alias("notes"), F.count("*").alias("n_cited"))


def removed_note(notes: Column, removed: Column) -> Column:
    """The notes as one text; citations that were dropped, as wrong or as repeated, are counted at its end."""
    count = F.when(removed > 0, F.concat(removed.cast("string"), F.lit(" citations dropped")))
    return F.concat_ws("; ", notes, count)


def answered(answers: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings whose citations hold (repo, fid, order columns and the finding's fields), their checked citations, and a row of statistics a file.

    answers: as review_prompts gives them for build_prompts. A finding whose fields are wrong is an error of its part, one without a
    citation that holds is discarded.
    """
    part_error = F.when(F.col("error").isNotNull(), F.col("error"))
    parsed = findings.parsed_answers(answers.withColumn("call_error", part_error).drop("error")).withColumn("error", F.coalesce("call_error", "error"))
    parsed = stored(parsed.drop("content", "prompt"), "parsed")  # read again and again, parsed once
    each = parsed.where("error is null").select("repo", "path", "lead_rank", "part", F.posexplode("findings").alias("ord", "f")).withColumn("valid", valid_finding(F.col("f")))
    fid = F.concat_ws("#", "path", F.col("part").cast("string"), F.col("ord").cast("string"))
    good = each.where("valid").select("repo", fid.alias("fid"), F.col("path").alias("file"), "lead_rank", "part", "ord", "f")
    ev = good.select("repo", "fid", F.posexplode("f.evidence").alias("ev_ord", "e")).select("repo", "fid", "ev_ord", "e.*")
    every = stored(citations.check_citations(ev, lines), "citations")
    checked = findings.dedupe_citations(every.where("passed"))
    first = checked.groupBy("repo", "fid").agg(F.array_sort(F.collect_list(F.struct("ev_ord", "path", "start_line", "end_line", "quote", "role"))).alias("evidence"))
    kept = good.join(first, ["repo", "fid"]).join(evidence_notes(every), ["repo", "fid"]).withColumn("at", primary_evidence(F.col("evidence")))
    fields = ["title", "severity", "summary", "reasoning", "remediation"]
    found = kept.select("repo", "fid", "file", "lead_rank", "part", "ord", "evidence", removed_note(F.col("notes"), F.col("n_cited") - F.size("evidence")).alias("evidence_note"), F.col("at.path").alias("path"), F.col("at.start_line").alias("start_line"), F.col("f.cwe").alias("cwe"), *(F.col(f"f.{c}").alias(c) for c in fields))
    key = ["repo", "path"]
    wrong = each.where(~F.col("valid")).select(*key, "part").distinct().withColumn("bad_field", F.lit("a finding has wrong fields"))
    per_part = parsed.select(*key, "part", "first", "last", "error", "prompt_tokens", "completion_tokens", "seconds").join(wrong, [*key, "part"], "left")
    several = F.max("part") > 1
    said = F.coalesce("error", "bad_field")
    listed = F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("part", said.alias("e"), F.concat(F.lit("lines "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(": "), said).alias("full")))))
    stats = per_part.groupBy(*key).agg(listed.alias("errors"), several.alias("several"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("seconds"))
    text = F.when(F.size("errors") > 0, F.array_join(F.transform("errors", lambda e: F.when(F.col("several"), e["full"]).otherwise(e["e"])), "; "))
    counts = each.where("valid").groupBy(*key).agg(F.count("*").alias("n_valid")).join(found.groupBy("repo", F.col("file").alias("path")).agg(F.count("*").alias("n_findings")), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    stats = stats.join(counts, key, "left").select(*key, text.alias("error"), (zero("n_valid") - zero("n_findings")).alias("discarded"), "prompt_tokens", "completion_tokens", "seconds", zero("n_findings").alias("n_findings"))
    return found, checked, stats


def scan_parts(lines: DataFrame, client_factory: Callable[[], Callable[[str], str | Reply]], log: str | None = None, **prompts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `answered` says of a client's answers to the prompts of all leads."""
    asked = build_prompts(lines, **prompts)
    said = review_prompts(asked, client_factory) if log is None else calls.logged_answers(asked, client_factory, log)
    return answered(stored(said, "answers"), lines)  # written out: an answer is paid for once


def scan_job(
    lines: DataFrame,
    mode: str = "judge",
    client_factory: Callable[[], Callable[[str], str | Reply]] | None = None,
    scanner: DataFrame | None = None,
    paths: DataFrame | None = None,
    limit: int | None = None,
    log: str | None = None,
    scanner_errors: DataFrame | None = None,
    **prompts,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged, numbered, tiered and ranked findings of every repository, their citations, and scan_stats.

    mode judge: each lead's windows go to a client; patterns: the lexicon's hits, without corroboration; scanner: the scanner's results
    as they are, without leads. scanner: repo, path, start_line, end_line, cwe, title, summary, quote, as read_scanner gives them.
    log: a folder of answers by prompt, from which a stopped scan goes on (calls.logged_answers). scanner_errors: repo, error of
    repositories whose scanner failed; they are among the errors of the statistics. Other arguments are those of build_prompts.
    """
    no = F.lit(None).cast("string")
    nothing = [no.alias("error"), *(F.lit(0).alias(c) for c in ("discarded", "prompt_tokens", "completion_tokens", "n_findings")), F.lit(0.0).alias("seconds")]
    ran = scanner is not None and mode == "judge"
    if mode == "judge":
        found, cited, reviews = scan_parts(lines, client_factory, log, paths=paths, limit=limit, **prompts)
        order = ["lead_rank", "part", "ord"]
    elif mode == "patterns":
        leads = hints.rank_leads(hints.lead_hints(lines, paths), limit)
        found, cited = findings.pattern_review(lines.join(leads.select("repo", "path"), ["repo", "path"], "left_semi"))
        ranks = leads.select("repo", "path", F.col("rank").alias("lead_rank"))
        found = found.join(ranks, ["repo", "path"]).withColumns({"severity": F.lit("medium"), "reasoning": no, "remediation": no})
        reviews = leads.select("repo", "path", *nothing)
        order, scanner = ["lead_rank", "class_first", "start_line", "ord"], None
    elif mode == "scanner":
        wanted = scanner if paths is None else scanner.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
        fid = F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "title", F.coalesce("cwe", F.lit("")))
        rows = wanted.withColumn("fid", fid)
        found = rows.select("repo", "fid", "path", "start_line", "cwe", "title", "summary", F.lit("medium").alias("severity"), no.alias("reasoning"), no.alias("remediation"))
        cited = rows.select("repo", "fid", F.lit(0).alias("ev_ord"), "path", "start_line", "end_line", "quote", F.lit("sink").alias("role")).distinct()
        reviews = None
        order, scanner = ["path", "start_line", "fid"], None
    else:
        raise ValueError(f"mode is judge, patterns or scanner, not {mode}")
    kept = findings.dedupe_findings(found, order)
    numbered = findings.number_findings(kept, order)
    tiered = intervals.assign_tiers(numbered, cited, scanner).withColumn("scanned", F.lit(ran))
    # Written out: results, citations and statistics all read it.
    ranked = stored(findings.rank_findings(findings.wording(tiered)), "ranked")
    per_repo = ranked.groupBy("repo").agg(F.count("*").alias("findings"))
    if reviews is None:  # a scanner's results come without leads
        stats = findings.no_leads(per_repo)
    else:
        stats = findings.scan_stats(reviews, per_repo)
    if scanner_errors is not None:
        stats = findings.with_errors(stats, scanner_errors)
    return ranked, cited.join(ranked.select("repo", "fid"), ["repo", "fid"], "left_semi"), stats


def report_rows(ranked: DataFrame, cited: DataFrame) -> DataFrame:
    """repo, rank, finding, checks (citations, wording, and the scanner where one ran) for write_report, from what scan_job returns."""
    ev = cited.groupBy("repo", "fid").agg(F.array_sort(F.collect_list(F.struct("ev_ord", "path", "start_line", "end_line", "quote", "role"))).alias("cites"))
    rows = ranked.join(ev, ["repo", "fid"], "left")
    finding = F.struct("id", "title", "tier", "severity", "cwe", "summary", "reasoning", "remediation", F.col("cites").alias("evidence"))
    return rows.select("repo", "rank", finding.alias("finding"), finding_checks(rows).alias("checks"))


def finding_checks(rows: DataFrame) -> Column:
    """array<struct<name, passed, detail>> of ranked findings."""
    check = lambda name, passed, detail: F.struct(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))
    nothing, some = F.lit(""), []
    if "evidence_note" in rows.columns:
        some.append(check("citations", F.lit(True), F.coalesce("evidence_note", nothing)))
    some.append(check("wording", ~F.col("hedged"), F.when(F.col("hedged"), F.concat(F.lit("hedges with "), "hedge")).otherwise("")))
    if "scanned" in rows.columns:
        agrees = F.col("tier") == "supported"
        some.append(check("scanner", agrees, F.when(~F.col("scanned"), "did not run").when(agrees, "reports the same lines").otherwise("")))
    return F.array(*some)


class Seeded(Sequence):
    """What eval_seeded returns. Each part does its own work when it is asked for, and what parts share is done once."""

    def __init__(self, lines: DataFrame, truth: DataFrame, review: Callable[[DataFrame], tuple[DataFrame, DataFrame]], note: str | None, every: bool):
        self._lines, self._truth, self._review, self._note, self._every = lines, truth, review, note, every

    def __len__(self) -> int:
        return 4

    def __getitem__(self, n: int) -> DataFrame:
        return (self._tree_score, self._twin_score, self._pairs, self._errors)[n]()

    @cached_property
    def _files(self) -> DataFrame:
        return file_texts(self._lines)

    @cached_property
    def _fixed(self) -> tuple[DataFrame, DataFrame]:
        return score.fixed_tree(self._files, score.fix_steps(self._truth))

    @cached_property
    def _failed(self) -> DataFrame:
        return self._fixed[1].select("repo", "id").distinct()

    @cached_property
    def _fitting(self) -> DataFrame:
        return self._truth.join(self._failed, ["repo", "id"], "left_anti")

    @cached_property
    def _counted(self) -> DataFrame:
        return self._truth if self._every else self._fitting

    def _side(self, tree: DataFrame, items: DataFrame, patched: bool) -> DataFrame:
        found, evidence = self._review(tree)
        # Of both only what is matched: their texts are most of them.
        facts = stored(found.select("repo", "fid", "cwe", *(c for c in ("tier",) if c in found.columns)), "found")
        places = stored(evidence.select("repo", "fid", "path", "start_line", "end_line"), "evidence")
        return stored(intervals.match_truth(places, facts, intervals.truth_regions(items, tree, patched)), "matches")

    @cached_property
    def _before(self) -> DataFrame:
        lines = self._lines
        if self._note is not None:
            lines = stored(hints.file_lines(plant_note(self._files, self._counted, self._note)), "planted")
        return self._side(lines, self._counted, False)

    @cached_property
    def _after(self) -> DataFrame:
        return self._side(stored(hints.file_lines(self._fixed[0]), "twin"), self._fitting, True)

    def _tree_score(self) -> DataFrame:
        return score.score_summary(self._before, self._counted)

    def _twin_score(self) -> DataFrame:
        return score.score_summary(self._after, self._fitting, patched=True)

    def _pairs(self) -> DataFrame:
        weak = self._counted.where("not is_decoy").select("repo", "id").join(self._failed.withColumn("failed", F.lit(True)), ["repo", "id"], "left")
        hit = lambda m, kind: m.where(F.col("kind") == kind).select(F.col("item").alias("id")).distinct()
        sides = score.pair_sides(weak, hit(self._before, intervals.LIVE), hit(self._after, intervals.FIXED)).join(weak, "id")
        right = F.count_if(F.col("pair_correct") & F.col("failed").isNull())
        counts = [F.count("*").alias("weaknesses"), F.count_if("detected").alias("found"), F.count_if("still_flagged").alias("still"), right.alias("correct")]
        return sides.groupBy("repo").agg(*counts, ratio(right, F.count("*"), None).alias("pair_accuracy"))

    def _errors(self) -> DataFrame:
        return self._fixed[1]


def eval_seeded(lines: DataFrame, truth: DataFrame, review: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = findings.pattern_review, note: str | None = None, every: bool = False) -> Seeded:
    """Scores of the tree and of its patched twin (score_summary); repo, weaknesses, found, still, correct, pair_accuracy; and the errors.

    The twin is the tree with every weakness fixed, step by step (score.fixed_tree). An item whose fix doesn't apply is an error
    (repo, id, step, path): its weakness would still be in the twin, so it counts in no score of the twin. With every it counts in the
    score of the tree, which no fix changes, and among the pairs, where it is never a correct one; else there neither. Both trees are
    reviewed by `review`, which turns lines into findings and citations. truth: repo, path, id, anchor, patched_anchor, radius, cwes,
    is_decoy, and old and new or fix. note is planted before files with a weakness.
    """
    return Seeded(lines, truth, review, note, every)


def build_training(teacher: DataFrame, lines: DataFrame, system: str, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of accepted answers (repo, name, side, kept, record), the counts of all statuses, and dataset_summary.

    teacher: the answer log (repo, name, attempt, real, classes, prompt, content, truncated); the last attempt of a name counts.
    """
    valid = train.parsed_teacher(teacher)
    checked = citations.check_citations(train.teacher_evidence(valid), lines)
    judged = stored(train.accept_answers(train.with_verified(valid, checked)), "judged")
    target = F.to_json(F.struct("analysis", F.col("kept").alias("findings")))
    sides = select.train_valid(judged.where("status = 'ok'"), seed)
    records = sides.select("repo", "name", "side", "kept", to_chat_record(F.lit(system), F.col("prompt"), target).alias("record"))
    return records, summary.status_counts(judged), summary.dataset_summary(judged, sides)


def eval_pairs(vulnerable: tuple[DataFrame, DataFrame], secure: tuple[DataFrame, DataFrame], modules: DataFrame) -> DataFrame:
    """repo, modules, detected, secure_flagged, pair_accuracy, other findings of both sides. A side is (findings, evidence).

    modules: repo, id, cwes. Findings in no module, or of a class that their module doesn't list, are others.
    """
    def side(pair, name):
        found, evidence = pair
        flags = score.flag_modules(evidence, found, modules)
        hit = flags.groupBy("repo", F.col("module").alias("id")).agg(F.bool_or("flagged").alias(name))
        other = flags.groupBy("repo").agg(F.count_if(~F.col("flagged")).alias(f"other_{name}"))
        return hit.where(F.col(name)), other

    (v, other_v), (s, other_s) = side(vulnerable, "v"), side(secure, "s")
    no, zero = F.lit(False), F.lit(0)
    rows = modules.select("repo", "id").join(v, ["repo", "id"], "left").join(s, ["repo", "id"], "left").select("repo", "id", F.coalesce("v", no).alias("v"), F.coalesce("s", no).alias("s"))
    right = F.count_if(F.col("v") & ~F.col("s"))
    out = rows.groupBy("repo").agg(F.count("*").alias("modules"), F.count_if("v").alias("detected"), F.count_if("s").alias("secure_flagged"), ratio(right, F.count("*"), None).alias("pair_accuracy"))
    out = out.join(other_v, "repo", "left").join(other_s, "repo", "left")
    return out.select("repo", "modules", "detected", "secure_flagged", "pair_accuracy", F.coalesce("other_v", zero).alias("other_findings_vulnerable"), F.coalesce("other_s", zero).alias("other_findings_secure"))


def review_pairs(files: DataFrame, modules: DataFrame, vulnerable: str, secure: str, review: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = findings.pattern_review) -> tuple[DataFrame, DataFrame]:
    """eval_pairs of both versions of each module under neutral names, and the modules that lack one."""
    pairs, missing = train.neutral_pairs(files, modules, vulnerable, secure)
    tree = lambda side: review(hints.file_lines(pairs.where(F.col("side") == side).select("repo", "path", "content")))
    return eval_pairs(tree("vulnerable"), tree("secure"), modules), missing


def eval_real(vulnerable: DataFrame, fixed: DataFrame, items: DataFrame, changes: DataFrame, slack: int = 3) -> DataFrame:
    """One row: items, detected, at the change, flagged after the fix, pair_accuracy, other findings. Only an item's own files count."""
    rows = score.score_items(vulnerable, fixed, items, changes, slack)
    count = lambda c: F.count_if(c).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("items"), count("detected"), count("detected_at_change"), count("fixed_flagged"), ratio(F.count_if("pair_correct"), F.count("*"), None).alias("pair_accuracy"), total("other_findings_vulnerable"), total("other_findings_fixed"))


def changes_of_diffs(diffs: DataFrame, items: DataFrame) -> DataFrame:
    """item, repo, path, start_line, end_line from diffs (diff is the item's id); items: id, repo."""
    ranges = select.diff_ranges(diffs).select(F.col("diff").alias("item"), "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    return ranges.join(items.select(F.col("id").alias("item"), "repo").distinct(), "item")


def eval_cases(found: DataFrame, cases: DataFrame, names: DataFrame | None = None, answered_only: bool = False) -> DataFrame:
    """Rates for each category and all. cases: repo, name, category, real, path, classes (and error); names keeps the cases that it lists."""
    chosen = cases if names is None else score.holdout_cases(cases, names)
    flags = score.flag_cases(found, chosen)
    error = [c for c in ("error",) if c in chosen.columns]
    return score.score_cases(chosen.select("repo", "name", "category", "real", *error).join(flags, ["repo", "name"]), answered_only)


def summarise_runs(runs: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each metric over the runs of a configuration, and each item's stability. runs: as read_runs gives them; groups: id, grp of real fixes."""
    config = [c for c in runs.columns if c not in ("seed", "run")]
    name = F.to_json(F.struct(*config))
    of = lambda df: df.select(name.alias("config"), F.col("seed").alias("run"), *(c for c in df.columns if c not in (*config, "seed")))
    return summary.metric_summary(of(summary.run_metrics(runs, groups))), summary.item_stability(of(summary.run_items(runs)))


#: Signs of a sound finding, in the order of a side's columns.
SIGNALS = ["scanner agrees", "no hedging words", "cites both ends", "severity high or critical"]


def signal_rows(found: DataFrame, evidence: DataFrame, scanner: DataFrame, regions: DataFrame) -> DataFrame:
    """is_true and the signs of each finding of one tree; in a patched tree no weakness is live, so nothing is true."""
    true = intervals.match_truth(evidence, found, regions).select("repo", "fid", F.coalesce(F.col("kind") == intervals.LIVE, F.lit(False)).alias("is_true"))
    agreed = intervals.scanner_agreement(evidence, scanner).withColumn("agrees", F.lit(True))
    rows = findings.wording(found).join(true, ["repo", "fid"]).join(agreed, ["repo", "fid"], "left").join(findings.dataflow(evidence), ["repo", "fid"], "left")
    no = F.lit(False)
    values = [F.coalesce("agrees", no), ~F.col("hedged"), F.coalesce("both_ends", no), F.col("severity").isin("high", "critical")]
    return rows.select("is_true", *(v.alias(s) for v, s in zip(values, SIGNALS, strict=True)))


def signal_job(*sides: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """How much each sign of a sound finding tells over all sides (found, evidence, scanner, regions), as a tree and its patched twin."""
    return summary.signal_precision(reduce(DataFrame.unionByName, (signal_rows(*side) for side in sides)), SIGNALS)
