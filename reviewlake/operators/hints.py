"""Lines, lexicon hits, ranked leads and review windows. All narrow but for the grouping by file."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reviewlake.functions.scalars import extension, hint_lines
from reviewlake.operators.ranks import ranked_by_range

#: Extensions of code and templates, names of deployment files.
CODE_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".php", ".java", ".go", ".rb", ".cs", ".kt", ".rs", ".c", ".cc", ".cpp", ".h", ".sh",
    ".html", ".htm", ".jinja", ".jinja2", ".j2", ".ejs", ".hbs", ".handlebars", ".twig", ".vue", ".svelte", ".erb", ".pug",
]
CONFIG_NAMES = r"(^|/)(Dockerfile[^/]*|docker-compose[^/]*\.ya?ml|compose\.ya?ml|\.env[^/]*|nginx[^/]*\.conf|[^/]*\.tf|settings\.py|config\.(py|js|json|ya?ml)|application\.(properties|ya?ml))$"
#: Fixed values: (weakness class, CWE, pattern), in the order that hits are listed.
LEXICON = [
    ("sql injection", "CWE-89", r"(execute|query|raw|prepare)\s*\(.*(\+|%|\$\{|\.format\(|f[\"'])"),
    ("sql injection", "CWE-89", r"(SELECT|INSERT|UPDATE|DELETE)\b.*(\"\s*\+|'\s*\+|\$\{|%s\"\s*%|\.format\()"),
    ("command injection", "CWE-78", r"\b(os\.system|subprocess\.\w+|popen|exec|execSync|spawn|shell_exec|passthru|system|Runtime\.getRuntime)\s*\("),
    ("code injection", "CWE-94", r"\b(eval|exec|Function|compile)\s*\("),
    ("unsafe deserialisation", "CWE-502", r"\b(pickle\.loads?|yaml\.load|unserialize|ObjectInputStream|marshal\.loads?|node-serialize)\b"),
    ("path traversal", "CWE-22", r"\b(open|send_file|sendFile|readFile\w*|createReadStream|file_get_contents|include|require_once)\s*\(.*(\+|req\.|request\.|\$_|params|args)"),
    ("server-side request forgery", "CWE-918", r"\b(requests\.(get|post)|urlopen|fetch|axios\.\w+|http\.get|curl_exec)\s*\(.*(req\.|request\.|params|args|\$_|url)"),
    ("cross-site scripting", "CWE-79", r"(innerHTML|dangerouslySetInnerHTML|document\.write|\|\s*safe\b|render_template_string|Markup\(|res\.send\(.*\+|echo\s+\$_)"),
    ("template injection", "CWE-1336", r"\b(render_template_string|Template\(.*request|env\.from_string)"),
    ("weak cryptography", "CWE-327", r"\b(md5|sha1|DES|RC4|ECB)\b"),
    ("insecure randomness", "CWE-330", r"\b(Math\.random|random\.(random|randint|choice))\s*\("),
    ("hardcoded secret", "CWE-798", r"(?i)(secret|passw(or)?d|api[_-]?key|token|private[_-]?key)\w*\s*[:=]\s*[\"'][^\"'\s]{6,}[\"']"),
    ("hardcoded secret", "CWE-798", r"(?i)^\s*\w*(secret|passw(or)?d|api_?key|token|private_?key)\w*\s*[:=]\s*[^\s\"'$]{6,}\s*$"),
    ("jwt verification", "CWE-347", r"(?i)(verify\s*[:=]\s*false|verify_signature.{0,6}false|algorithms?.{0,12}none|jwt\.decode\()"),
    ("tls verification disabled", "CWE-295", r"(?i)(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true)"),
    ("debug or permissive config", "CWE-489", r"(?i)(debug\s*=\s*true|DEBUG\s*=\s*True|Access-Control-Allow-Origin.{0,6}\*|origins?\s*[:=]\s*[\"']\*|ALLOWED_HOSTS\s*=\s*\[\s*[\"']\*)"),
    ("xml external entities", "CWE-611", r"\b(etree\.(parse|fromstring)|XMLParser\(|DocumentBuilderFactory|libxml_disable_entity_loader|parseString)\b"),
    ("open redirect", "CWE-601", r"\b(redirect|sendRedirect|res\.redirect)\s*\(.*(req\.|request\.|params|args|\$_)"),
    ("mass assignment", "CWE-915", r"(\*\*request\.(json|form|data)|Object\.assign\(.*req\.body|\.update\(\s*req\.body|setattr\(.*request)"),
    ("container hardening", "CWE-250", r"(?i)(^\s*USER\s+root|privileged\s*:\s*true|--privileged|/var/run/docker\.sock|network_mode\s*:\s*host|:latest\b)"),
    ("request handler", "", r"(@\w*\.?(route|get|post|put|delete|patch)\(|\b(app|router)\.(get|post|put|delete|patch|all)\(|@(Get|Post|Put|Delete|Request)Mapping|\$_(GET|POST|REQUEST|COOKIE)|http\.HandleFunc)"),
]
#: Of each pattern, lower-cased texts of which a line that it hits holds one at least.
LITERALS = [
    ["execute", "query", "raw", "prepare"],
    ["select", "insert", "update", "delete"],
    ["subprocess.", "popen", "exec", "spawn", "passthru", "system", "getruntime"],
    ["eval", "exec", "function", "compile"],
    ["pickle.load", "yaml.load", "unserialize", "objectinputstream", "marshal.load", "node-serialize"],
    ["open", "send_file", "sendfile", "readfile", "createreadstream", "file_get_contents", "include", "require_once"],
    ["requests.", "urlopen", "fetch", "axios.", "http.get", "curl_exec"],
    ["innerhtml", "document.write", "safe", "render_template_string", "markup(", "res.send(", "echo"],
    ["render_template_string", "template(", "env.from_string"],
    ["md5", "sha1", "des", "rc4", "ecb"],
    ["random"],
    ["secret", "passw", "api", "token", "private"],
    ["secret", "passw", "api", "token", "private"],
    ["verify", "algorithm", "jwt.decode("],
    ["verify", "rejectunauthorized"],
    ["debug", "origin", "allowed_hosts"],
    ["etree.", "xmlparser(", "documentbuilderfactory", "libxml_disable_entity_loader", "parsestring"],
    ["redirect"],
    ["**request.", "object.assign(", ".update(", "setattr("],
    ["user", "privileged", "docker.sock", "network_mode", ":latest"],
    ["route(", "get(", "post(", "put(", "delete(", "patch(", "all(", "mapping", "$_", "http.handlefunc"],
]
LONGEST_LINE = 500
SEPARATORS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def split_lines(content: Column) -> Column:
    """Lines as Python's splitlines gives them: a separator at the end opens no further line."""
    parts = F.split(content, SEPARATORS, -1)
    return F.when(content == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def file_lines(files: DataFrame) -> DataFrame:
    """A row for each line: the columns but content, line (from 1) and text."""
    rest = [c for c in files.columns if c != "content"]
    return files.select(*rest, F.posexplode(split_lines(F.col("content"))).alias("pos", "text")).select(*rest, (F.col("pos") + 1).alias("line"), "text")


def file_order(path: Column) -> Column:
    """Sorts paths as a sorted walk does: a folder's own files before its folders."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p))


def relevant(path: Column) -> Column:
    return F.coalesce(extension(path).isin(CODE_EXTENSIONS), F.lit(False)) | path.rlike(CONFIG_NAMES)


def relevant_files(files: DataFrame) -> DataFrame:
    return files.where(relevant(F.col("path")))


@F.arrow_udf(LongType())
def candidates(texts: pa.Array) -> pa.Array:
    """A bit for each pattern of LEXICON that a line may hit, by one automaton over the literals of all of them."""
    automaton = literal_automaton()
    masks = []
    for text in texts.to_pylist():
        mask = 0
        for _, bits in automaton.iter(text.lower().replace(LONG_S, "s")) if text else ():
            mask |= bits
        masks.append(mask)
    return pa.array(masks, pa.int64())


@lru_cache(maxsize=1)
def literal_automaton() -> ahocorasick.Automaton:
    bits: dict[str, int] = {}
    for i, literals in enumerate(LITERALS):
        for x in literals:
            bits[x] = bits.get(x, 0) | 1 << i
    automaton = ahocorasick.Automaton()
    for x, b in bits.items():
        automaton.add_word(x, b)
    automaton.make_automaton()
    return automaton


#: The two letters outside ASCII that (?i) takes for s and k.
LONG_S, KELVIN = "\u017f", "\u212a"
_WORD = "[0-9A-Za-z_]"
_MEANS = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", r"\s": r"[\t\n\f\r ]", ".": r"[^\n]", "$": r"\z"}
_TOKEN = re.compile(r"\(\?[a-z]*[:)]|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", re.DOTALL)


@lru_cache(maxsize=None)
def as_written(pattern: str) -> str:
    """A pattern of the lexicon for Java's engine, with one meaning whatever the text: \\b and \\s by ASCII, a dot is all but a newline,
    $ is the end of the text, and (?i) at its start also takes the long s and the Kelvin sign for s and k.

    Java alone takes a letter outside ASCII for part of a word at \\b only, ends a dot and $ at other line separators, and folds ASCII.
    """
    fold = pattern.startswith("(?i)")
    out = []
    for token in _TOKEN.findall(pattern):
        folded = "".join(letter for plain, letter in (("s", LONG_S), ("k", KELVIN)) if fold and _takes(token, plain))
        if token[0] == "[" and len(token) > 1:
            out.append(token[:-1].replace(r"\s", r"\t\n\f\r ") + folded + "]")
        else:
            plain = _MEANS.get(token, token)
            out.append(f"[{plain}{folded}]" if folded else plain)
    return "".join(out)


def _takes(token: str, letter: str) -> bool:
    """A letter, class or \\w that holds a letter, or leaves it out."""
    if token[0] == "[" and len(token) > 1:
        return bool(re.fullmatch(token.replace("[^", "[", 1), letter, re.IGNORECASE))
    return token == r"\w" or token.lower() == letter


def patterns_hit(text: Column, may: Column | None, lexicon=LEXICON) -> Column:
    """The numbers of the patterns that a text hits; a pattern is tried where its bit of `may` is set (None: everywhere)."""
    tried = lambda i: F.lit(True) if may is None else may.bitwiseAND(F.lit(1 << i)) != 0
    return F.array_compact(F.array(*(F.when(tried(i) & text.rlike(as_written(rx)), F.lit(i)) for i, (_, _, rx) in enumerate(lexicon))))


def with_candidates(lines: DataFrame) -> DataFrame:
    """lines and may: what the literals say of each line that isn't too long."""
    return lines.withColumn("may", candidates(F.when(F.length("text") <= LONGEST_LINE, F.col("text"))))


def match_lexicon(lines: DataFrame, lexicon=LEXICON) -> DataFrame:
    """The columns of lines, ord, class and cwe for each pattern that a line hits; long lines are skipped."""
    known = lexicon is LEXICON
    found = patterns_hit(F.col("text"), F.col("may") if known else None, lexicon)
    kept = lines.where(F.length("text") <= LONGEST_LINE)
    rows = with_candidates(kept).where("may <> 0") if known else kept
    facts = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(cls).alias("class"), F.lit(cwe).alias("cwe")) for i, (cls, cwe, _) in enumerate(lexicon)))
    return rows.select(*lines.columns, F.explode(found).alias("hit_no")).select(*lines.columns, F.get(facts, F.col("hit_no")).alias("hit")).select(*lines.columns, "hit.*")


def pattern_findings(lines: DataFrame) -> DataFrame:
    """The baseline without a model: every hit but request handlers is a finding that cites its line."""
    return match_lexicon(lines).where("class <> 'request handler'").select("repo", "path", F.col("class").alias("title"), F.nullif(F.col("cwe"), F.lit("")).alias("cwe"), F.concat(F.lit("pattern match for "), "class").alias("summary"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.col("text").alias("quote"), F.lit("sink").alias("role"), F.col("ord"))


def blank_comments(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", F.when(F.col("text").rlike(r"^\s*(#|//)") & ~F.col("text").startswith("#!"), "").otherwise(F.col("text")))


def window_spans(n: Column, size: int = 400, overlap: int = 40) -> Column:
    """array<struct<first, last>> of line spans that cover n lines; neighbours share overlap lines."""
    step = size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step + 1).cast("int").alias("first"), F.greatest(F.least(i * step + size, n), F.lit(1)).cast("int").alias("last")))


def review_windows(lines: DataFrame, size: int = 400, overlap: int = 40) -> DataFrame:
    """repo, path, part (from 1), first, last."""
    n = lines.groupBy("repo", "path").agg(F.max("line").cast("int").alias("n_lines"))
    return n.select("repo", "path", "n_lines", F.posexplode(window_spans(F.col("n_lines"), size, overlap)).alias("part", "span")).select("repo", "path", "n_lines", (F.col("part") + 1).alias("part"), "span.first", "span.last")


def lead_hints(lines: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """repo, path, hints (class to lines, duplicates kept), cwes, score of every relevant file; files without a hit too.

    paths (repo, path): only these files, whatever their kind. The patterns are tried once a line and one grouping by file gathers all.
    """
    lines = lines.where(relevant(F.col("path"))) if paths is None else lines.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    # A line's hits as numbers of patterns; lines without one add nothing to the group but the file.
    lines = with_candidates(lines.select("repo", "path", "line", "text"))
    found = F.when(F.col("may") != 0, patterns_hit(F.col("text"), F.col("may"))).otherwise(F.array().cast("array<int>"))
    each = lines.select("repo", "path", "line", found.alias("found"))
    files = each.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.when(F.size("found") > 0, F.struct("line", "found")))).alias("rows"))
    hits = F.flatten(F.transform("rows", lambda r: F.transform(r["found"], lambda i: F.struct(r["line"].alias("line"), i.alias("ord")))))
    files = files.select("repo", "path", hits.alias("hits"))
    classes = list(dict.fromkeys(c for c, _, _ in LEXICON))

    def lines_of(name):
        patterns = [i for i, (c, _, _) in enumerate(LEXICON) if c == name]
        return F.struct(F.lit(name).alias("key"), F.transform(F.filter("hits", lambda h: h["ord"].isin(patterns)), lambda h: h["line"]).alias("value"))

    entries = F.filter(F.array(*map(lines_of, classes)), lambda e: F.size(e["value"]) > 0)
    cwe_of = F.array(*(F.lit(cwe) for _, cwe, _ in LEXICON))
    cwes = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: F.get(cwe_of, h["ord"])), lambda c: c != "")))
    files = files.select("repo", "path", F.map_from_entries(entries).alias("hints"), cwes.alias("cwes"))
    score = F.size("hints") * 10 - F.when(F.array_contains(F.map_keys("hints"), "request handler"), 5).otherwise(0)
    return files.select("repo", "path", "hints", "cwes", score.alias("score"))


def rank_leads(leads: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds rank in each repository: highest score first, then path."""
    order = [F.desc("score"), F.col("path")]
    if limit is None:
        return ranked_by_range(leads, ["repo"], order)
    # The first ones of each group are kept in every task before any row is shuffled.
    return leads.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("rank") <= limit)


def leads_job(lines: DataFrame, paths: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Ranked files with their classes as one text. paths: only the files that are listed, whatever their kind."""
    return rank_leads(lead_hints(lines, paths), limit).select("repo", "path", "score", "rank", F.array_join("cwes", ",").alias("cwes"), F.array_join(hint_lines(F.col("hints")), "; ").alias("hints"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def grep(lines: DataFrame, pattern: str, glob: str | None = None, max_hits: int = 60) -> DataFrame:
    """Hits of a pattern, text stripped and cut to 240 characters; the first max_hits of a repository in file order."""
    hits = select_files(lines, "", glob).where(F.col("text").rlike(pattern))
    n = F.row_number().over(Window.partitionBy("repo").orderBy(file_order(F.col("path")), "line"))
    return hits.withColumn("n", n).where(F.col("n") <= max_hits).select("repo", "path", "line", F.substring(stripped(F.col("text")), 1, 240).alias("text"))


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return f"(?s)^{out}$"


def select_files(files: DataFrame, subdir: str = "", glob: str | None = None) -> DataFrame:
    """Files under a folder whose path or base name fits the glob."""
    out = files.where(F.col("path").startswith(subdir.rstrip("/") + "/")) if subdir.strip("/.") else files
    return out if glob is None else out.where(F.col("path").rlike(glob_pattern(glob)) | F.substring_index("path", "/", -1).rlike(glob_pattern(glob)))


def read_numbered(lines: DataFrame, start: int, end: int) -> DataFrame:
    """repo, path, body: a span of each file with a right-aligned gutter; the span is clamped to the file."""
    shown = lines.where(F.col("line").between(max(1, start), end))
    last = F.max("line").over(Window.partitionBy("repo", "path"))
    row = shown.withColumn("w", F.length(last.cast("string"))).withColumn("row", F.concat(F.lpad(F.col("line").cast("string"), F.col("w"), F.lit(" ")), F.lit("| "), "text"))
    return row.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n").alias("body"))
