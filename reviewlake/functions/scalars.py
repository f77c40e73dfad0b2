"""Scalar functions on columns: strings, JSON answers, arrays of citations. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The family of a file by its extension.
FAMILIES = {"python": [".py"], "js": [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"], "php": [".php"]}
#: Severities and tiers in rising order.
SEVERITIES = ["low", "medium", "high", "critical"]
TIERS = ["rejected", "suspected", "supported", "confirmed"]
#: Wording that hedges, phrases that leak an answer key, commit addresses, a copied line gutter.
HEDGE = r"(?i)\b(potential(ly)?|could|might|may|possibl[ey]|if an attacker|theoretical)"
MENTIONS_KEY = r"(?i)answer key|ground truth|according to the (key|label)|is labell?ed|as instructed"
COMMIT_URL = r"^https://github\.com/([^/]+/[^/]+)/(?:pull/\d+/commits|commit)/([0-9a-f]{7,40})"
GUTTER = r"^\s*\d+\|\s?"
#: What each category of a labelled case is called; the keys are fixed values.
CASE_LABELS = {
    "pathtraver": "a path taken from input",
    "cmdi": "a system command made from input",
    "codeinj": "code made from input",
    "deserialization": "objects loaded from untrusted bytes",
    "hash": "a broken hash function",
    "ldapi": "an LDAP filter made from input",
    "redirect": "a redirect to an address from input",
    "securecookie": "a cookie that plain connections carry",
    "sqli": "an SQL statement made from input",
    "trustbound": "input kept in the session as if it were trusted",
    "weakrand": "predictable random numbers",
    "xpathi": "an XPath expression made from input",
    "xss": "input written into a page unescaped",
    "xxe": "an XML parser that loads external entities",
}
#: What an answer without findings is told apart by.
CUT_OFF, NOT_JSON = "answer cut off by its token budget", "answer is no JSON object with a list of findings"
#: Most characters of a finding's texts.
BOUNDS = {"title": 120, "cwe": 16, "summary": 600, "reasoning": 800, "remediation": 500}
EVIDENCE = "struct<path:string,start_line:int,end_line:int,quote:string,role:string>"
FINDING_SCHEMA = f"array<struct<title:string,cwe:string,severity:string,summary:string,reasoning:string,remediation:string,evidence:array<{EVIDENCE}>,valid:boolean>>"
LARGEST_LINE = (1 << 31) - 1


def normalise_cwe(x: Column) -> Column:
    """The first run of digits as CWE-n; null without one."""
    digits = F.regexp_extract(x.cast("string"), r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits.cast("decimal(38,0)").cast("string")))


def norm_ws(x: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_gutter(x: Column) -> Column:
    """Each line without a copied `12| ` before it."""
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.regexp_replace(line, GUTTER, "")), "\n")


def wrap_untrusted(x: Column) -> Column:
    """Fence text from a repository; a closing tag inside is broken up."""
    return F.concat(F.lit("<repo_data>\n"), F.replace(x, F.lit("</repo_data>"), F.lit("<\\/repo_data>")), F.lit("\n</repo_data>"))


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path, dot included, lower-cased; null without a dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1))))


def language_family(path: Column) -> Column:
    e = extension(path)
    return reduce(lambda c, kv: c.when(e.isin(kv[1]), kv[0]), FAMILIES.items(), F.when(F.lit(False), None))


def primary_evidence(evidence: Column) -> Column:
    """The first sink, else the first citation, else null."""
    return F.coalesce(F.try_element_at(F.filter(evidence, lambda e: e["role"] == "sink"), F.lit(1)), F.try_element_at(evidence, F.lit(1)))


def apply_fixes(content: Column, steps: Column) -> Column:
    """struct(text, bad): each step's old text, which must occur exactly once, replaced in order; bad is the first step (from 1) that doesn't fit."""
    start = F.struct(content.alias("text"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))

    def step(s, x):
        times = (F.length(s["text"]) - F.length(F.replace(s["text"], x["old"], F.lit("")))) / F.length(x["old"])
        fits = s["bad"].isNull() & (times == 1)
        return F.struct(F.when(fits, F.replace(s["text"], x["old"], x["new"])).otherwise(s["text"]).alias("text"), F.when(s["bad"].isNull() & (F.coalesce(times, F.lit(0.0)) != 1), s["n"] + 1).otherwise(s["bad"]).alias("bad"), (s["n"] + 1).alias("n"))

    done = F.aggregate(steps, start, step)
    return F.struct(done["text"].alias("text"), done["bad"].alias("bad"))


def apply_each(content: Column, steps: Column) -> Column:
    """struct(text, bad): all steps (id, step, old, new) in order; one whose old text doesn't stand there once is left out and listed in bad."""
    bad = F.array().cast("array<struct<id:string,step:int>>")

    def step(s, x):
        times = (F.length(s["text"]) - F.length(F.replace(s["text"], x["old"], F.lit("")))) / F.nullif(F.length(x["old"]), F.lit(0))
        fits = F.coalesce(times == 1, F.lit(False))
        left_out = F.array(F.struct(x["id"].alias("id"), x["step"].cast("int").alias("step")))
        return F.struct(F.when(fits, F.replace(s["text"], x["old"], x["new"])).otherwise(s["text"]).alias("text"), F.when(fits, s["bad"]).otherwise(F.concat(s["bad"], left_out)).alias("bad"))

    return F.aggregate(steps, F.struct(content.alias("text"), bad.alias("bad")), step)


def extract_json(x: Column) -> Column:
    """From the first { to the last }, else the text as it is."""
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(x)


def text_field(v: Column, name: str, default: str | None = None) -> Column:
    """A field of a VARIANT object that must be a text: its value, the default where it is absent, null where it is anything else."""
    path = f"$.{name}"
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.isNull(), F.lit(default).cast("string")).when(kind == "STRING", F.try_variant_get(v, path, "string"))


def line_field(v: Column, name: str) -> Column:
    """A line number from 1: a number without a fraction, or a text of digits; null for anything else."""
    path = f"$.{name}"
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    digits = F.regexp_extract(F.try_variant_get(v, path, "string"), r"^\s*\+?(\d+)\s*$", 1)
    number = F.when(kind == "STRING", digits.try_cast("double")).when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("double")).otherwise(F.try_variant_get(v, path, "double"))
    return F.when((number >= 1) & (number == F.floor(number)), F.least(number, F.lit(float(LARGEST_LINE))).cast("int"))


def list_field(v: Column, name: str) -> Column:
    """A field's list of VARIANTs, empty where it is absent or holds nothing (null, 0, false, an empty text or object); null otherwise."""
    path = f"$.{name}"
    x = F.try_variant_get(v, path, "variant")
    kind, text = F.schema_of_variant(x), F.to_json(x)
    nothing = kind.isNull() | (kind == "VOID") | text.isin("0", "0.0", "false", '""', "{}")
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>")).when(nothing, F.array().cast("array<variant>"))


def cited(v: Column) -> Column:
    """A citation of an answer with its default role; null if it is no object or a field has another type."""
    fields = {"path": text_field(v, "path"), "start_line": line_field(v, "start_line"), "end_line": line_field(v, "end_line"), "quote": text_field(v, "quote"), "role": text_field(v, "role", "context")}
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in fields.values()))
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & whole, F.struct(*(c.alias(n) for n, c in fields.items())))


def typed_finding(v: Column) -> Column:
    """One finding of FINDING_SCHEMA: defaults for absent fields, valid if each field has its type. A wrong field costs this finding alone."""
    cwe = F.try_variant_get(v, "$.cwe", "variant")
    said = F.when(F.schema_of_variant(cwe) == "STRING", F.try_variant_get(v, "$.cwe", "string")).when(~F.to_json(cwe).isin("0", "0.0", "false", "null"), F.to_json(cwe))
    fields = {"title": text_field(v, "title"), "severity": text_field(v, "severity", "medium"), "summary": text_field(v, "summary"), "reasoning": text_field(v, "reasoning", ""), "remediation": text_field(v, "remediation", "")}
    evidence = list_field(v, "evidence")
    places = F.transform(evidence, cited)
    whole = reduce(lambda a, b: a & b, (c.isNotNull() for c in fields.values())) & fields["severity"].isin(SEVERITIES)
    valid = F.schema_of_variant(v).startswith("OBJECT") & whole & evidence.isNotNull() & F.forall(places, lambda e: e.isNotNull())
    return F.struct(
        fields["title"].alias("title"), normalise_cwe(said).alias("cwe"), *(fields[n].alias(n) for n in ("severity", "summary", "reasoning", "remediation")),
        F.filter(places, lambda e: e.isNotNull()).alias("evidence"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parse_answer(content: Column, truncated: Column) -> Column:
    """struct(findings, analysis, error) of a reviewer's JSON answer, field by field from a VARIANT.

    An absent or null list of findings is an empty one; of the analysis only texts count.
    """
    def typed(v: Column, listed: Column) -> Column:
        error = F.when(listed.isNull(), F.when(F.coalesce(truncated, F.lit(False)), CUT_OFF).otherwise(NOT_JSON))
        texts = F.filter(list_field(v, "analysis"), lambda a: F.schema_of_variant(a) == "STRING")
        analysis = F.transform(texts, lambda a: F.try_variant_get(a, "$", "string"))
        return F.struct(F.transform(listed, typed_finding).alias("findings"), analysis.alias("analysis"), error.alias("error"))

    lists = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), list_field(v, "findings"))
    return bound(F.try_parse_json(extract_json(content)), lambda v: bound(lists(v), lambda listed: typed(v, listed)))


def bound(x: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def valid_finding(f: Column) -> Column:
    """Whether a parsed finding has all its fields with their types."""
    return F.coalesce(f["valid"], F.lit(False))


def within_bounds(f: Column) -> Column:
    """Longest texts and most citations that an answer may have."""
    short = lambda c, n: F.coalesce(F.length(c) <= n, F.lit(True))
    texts = [short(f[name], n) for name, n in BOUNDS.items()]
    cited = F.forall(F.coalesce(f["evidence"], F.array()), lambda e: short(e["path"], 200) & short(e["quote"], 400))
    return reduce(lambda a, b: a & b, texts) & (F.coalesce(F.size(f["evidence"]), F.lit(0)) <= 4) & F.coalesce(cited, F.lit(True))


def to_chat_record(system: Column, prompt: Column, target: Column) -> Column:
    said = [F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", system), ("user", prompt), ("assistant", target))]
    return F.to_json(F.struct(F.array(*said).alias("messages")))


def fix_commits(references: Column) -> Column:
    """Distinct sorted (repo, sha) of the commit addresses among the references."""
    urls = F.filter(references, lambda u: u.rlike(COMMIT_URL))
    return F.array_sort(F.array_distinct(F.transform(urls, lambda u: F.struct(F.regexp_extract(u, COMMIT_URL, 1).alias("repo"), F.regexp_extract(u, COMMIT_URL, 2).alias("sha")))))


def published_between(x: Column, lo: str, hi: str) -> Column:
    return F.substring(x.cast("string"), 1, 10).between(lo, hi)


def ratio(num: Column, den: Column, digits: int | None = 3) -> Column:
    """num / den, 0.0 where den is 0; rounded half-even unless digits is None."""
    r = F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)
    return r if digits is None else F.bround(r, digits)


def hint_lines(hints: Column, most: int = 8, first: Column | None = None, last: Column | None = None) -> Column:
    """Sorted `- class: line a, b` texts of a map from class to lines, within first and last if given."""
    entries = F.array_sort(F.map_entries(hints))
    if first is not None:
        entries = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.filter(e["value"], lambda n: n.between(first, last)).alias("value"))), lambda e: F.size(e["value"]) > 0)
    return F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": line "), F.array_join(F.transform(F.slice(e["value"], 1, most), lambda n: n.cast("string")), ", ")))


def mentions_key(x: Column) -> Column:
    return x.rlike(MENTIONS_KEY)


def case_hint(category: Column, real: Column, cwe: Column) -> Column:
    """The line of a teacher's prompt that gives the case's label away."""
    label = F.element_at(F.create_map(*(F.lit(v) for kv in CASE_LABELS.items() for v in kv)), category)
    what = F.concat(label, F.lit(", CWE-"), cwe.cast("string"))
    yes = F.concat(F.lit("Label, for you alone: vulnerable ("), what, F.lit("). Cite the lines that make it so; leave everything else out and do not speak of this label."))
    no = F.concat(F.lit("Label, for you alone: safe (no "), what, F.lit("). Explain in the analysis which code prevents it; give no findings and do not speak of this label."))
    return F.when(real, yes).otherwise(no)


def hedge_word(summary: Column, reasoning: Column) -> Column:
    """The first hedging word, or an empty text."""
    return F.regexp_extract(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(reasoning, F.lit(""))), HEDGE, 0)


def cites_both_ends(evidence: Column) -> Column:
    has = lambda *roles: F.exists(evidence, lambda e: e["role"].isin(*roles))
    return has("config") | (has("sink") & has("source", "missing_check"))


def finding_markdown(f: Column, checks: Column | None = None) -> Column:
    """One section of a report; rejected findings give null. checks: an array of (name, passed, detail)."""
    at, lit, text = primary_evidence(f["evidence"]), F.lit, lambda c: F.coalesce(c, F.lit(""))
    place = lambda e: F.concat(e["path"], lit(":"), e["start_line"].cast("string"))
    shown = lambda e: F.concat(lit("\n`"), place(e), lit("` to line "), e["end_line"].cast("string"), lit(", "), e["role"], lit("\n```\n"), F.regexp_replace(e["quote"], r"(?U)\s+$", ""), lit("\n```\n"))
    facts = F.concat_ws(", ", F.concat(f["severity"], lit(" severity")), F.concat(f["tier"]), F.coalesce(f["cwe"], lit("no class")), F.coalesce(place(at), lit("nothing cited")))
    part = lambda name, c: F.when(text(c) != "", F.concat(lit(f"\n{name}: "), c, lit("\n"))).otherwise("")
    checked = lit("")
    if checks is not None:
        row = lambda c: F.concat_ws(" ", F.when(c["passed"], "- [x]").otherwise("- [ ]"), c["name"], F.when(text(c["detail"]) != "", F.concat(lit("- "), c["detail"])))
        checked = F.when(F.coalesce(F.size(checks), lit(0)) > 0, F.concat(lit("\nVerified:\n"), F.array_join(F.transform(checks, row), "\n"), lit("\n"))).otherwise("")
    head = F.concat(lit("## "), f["id"], lit(": "), f["title"], lit("\n\n"), facts, lit("\n\n"), f["summary"], lit("\n"))
    return F.when(f["tier"] != "rejected", F.concat(head, part("Reasoning", f["reasoning"]), F.array_join(F.transform(f["evidence"], shown), ""), part("Remedy", f["remediation"]), checked))
