"""Many wanted texts found in one pass over each file, by an Aho-Corasick automaton in an Arrow function.

A file's lines are one row, met by all that is asked of the file: the file is sent to Python once, however many quotes or anchors
it has. Files of which more than MOST rows ask something are met in parts, dealt by what is asked. The reader's size limit
bounds a file.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Rows that ask of one file at once.
MOST = 20_000


def occurrences(texts: list[str], wanted: Iterable[str]) -> dict[str, list[int]]:
    """For each wanted text the positions, rising, of the texts that hold it; none for an empty one."""
    found: dict[str, list[int]] = {}
    automaton = ahocorasick.Automaton()
    for w in wanted:
        if w:
            automaton.add_word(w, w)
    if len(automaton):
        automaton.make_automaton()
        for i, text in enumerate(texts):
            for w in {w for _, w in automaton.iter(text)}:
                found.setdefault(w, []).append(i)
    return found


class Places:
    """Where runs of wanted lines lie in a file."""

    def __init__(self, texts: list[str], runs: Iterable[list[str]]):
        self.n, self.at = len(texts), occurrences(texts, {w for run in runs for w in run})
        self.sets: dict[str, set[int]] = {}

    def first(self, run: list[str]) -> int | None:
        """The first position from which each line of the run is part of the line there; only places of the rarest line are tried."""
        if not run or any(w not in self.at for w in run):
            return None
        rare = min(range(len(run)), key=lambda k: len(self.at[run[k]]))
        for w in run:
            if w not in self.sets:
                self.sets[w] = set(self.at[w])
        for i in self.at[run[rare]]:
            start = i - rare
            if start >= 0 and start + len(run) <= self.n and all(start + k in self.sets[w] for k, w in enumerate(run)):
                return start
        return None


def pairs_of(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, IntegerType()) for n in names]))


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
COUNTS = pa.list_(pa.struct([("n", pa.int32()), ("first", pa.int32())]))


@F.arrow_udf(pairs_of("first", "last"))
def run_spans(lines: pa.Array, texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """For each wanted run of lines its first place as line numbers, or null."""
    out = []
    for numbers, held, runs in zip(lines.to_pylist(), texts.to_pylist(), wanted.to_pylist(), strict=True):
        places = Places(held or [], runs)
        starts = [places.first(run) for run in runs]
        out.append([None if s is None else {"first": numbers[s], "last": numbers[s + len(run) - 1]} for s, run in zip(starts, runs, strict=True)])
    return pa.array(out, SPANS)


@F.arrow_udf(pairs_of("n", "first"))
def anchor_counts(lines: pa.Array, texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """For each wanted text the number of lines that hold it, and the first one; an empty text is in every line, a null in none."""
    out = []
    for numbers, held, anchors in zip(lines.to_pylist(), texts.to_pylist(), wanted.to_pylist(), strict=True):
        at = occurrences(held or [], {a for a in anchors if a})
        every = list(range(len(held or [])))
        places = [every if a == "" else at.get(a, []) for a in anchors]
        out.append([{"n": len(p), "first": numbers[p[0]] if p else None} for p in places])
    return pa.array(out, COUNTS)


def asked_of_files(asked: DataFrame, wanted: Column, lines: DataFrame, text: Column, find, most: int = MOST) -> DataFrame:
    """row (all columns of asked) and found: what `find` says of each row's wanted value in its file (repo, path); null without the file.

    lines: repo, path, line, and what text needs; null texts are left out.
    """
    key = ["repo", "path"]
    # One row at most for `most` rows asked, so it may be broadcast.
    hot = asked.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = hot.select(F.col("repo").alias("h_repo"), F.col("path").alias("h_path"), F.ceil(F.col("n") / most).alias("parts"))
    dealt = asked.select(*key, F.struct(*asked.columns).alias("row"), wanted.alias("wanted"))
    dealt = dealt.join(F.broadcast(hot), F.col("repo").eqNullSafe(F.col("h_repo")) & F.col("path").eqNullSafe(F.col("h_path")), "left")
    part = F.pmod(F.xxhash64("wanted"), F.coalesce("parts", F.lit(1)))
    asks = dealt.groupBy(*key, part.alias("part")).agg(F.collect_list(F.struct("row", "wanted")).alias("asks"))
    wanted_files = asked.select(*key).distinct()
    held = lines.join(wanted_files, key, "left_semi").select(*key, "line", text.alias("text")).where("text is not null")
    held = held.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("held"))
    # Shuffled, as in stored: the estimate of a semi-join tells nothing of the files' texts.
    met = asks.join(held.hint("merge"), key, "left").withColumn("found", find("held.line", "held.text", "asks.wanted"))
    each = F.transform("asks", lambda a, i: F.struct(a["row"].alias("row"), F.get("found", i).alias("found")))
    return met.select(F.explode(each).alias("x")).select("x.row", "x.found")


#: Bytes of wanted lines that one pass over all files looks for.
BLOCK_BYTES = 4 << 20


def normalised(text: str) -> list[tuple[int, str]]:
    """Numbers and texts of a file's non-blank lines, white space collapsed."""
    every = ((n, " ".join(line.split())) for n, line in enumerate(text.splitlines(), 1))
    return [(n, line) for n, line in every if line]


def find_runs(files: DataFrame, runs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """repo, path, id, start_line, end_line: the first place of each run (id, wanted: array of lines) in each file (repo, path, content).

    Runs are a stated set, met with all files in blocks of about block_bytes: a block is the automaton of one pass, and the
    driver holds no more than one block at a time while it plans the passes. Files are not shuffled.
    """
    size = runs.select(F.length(F.array_join("wanted", "")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    kept = [F.col(c).cast("string").alias(c) for c in ("repo", "path", "content")]
    id_type = runs.schema["id"].dataType.simpleString()

    def search(block: list[tuple]):
        def run(batches):
            automaton = ahocorasick.Automaton()
            for w in {w for _, wanted in block for w in wanted}:
                automaton.add_word(w, w)
            automaton.make_automaton()
            first = {}
            for number, (_, wanted) in enumerate(block):
                first.setdefault(wanted[0], []).append(number)
            for b in batches:
                rows = []
                for repo, path, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    lines = normalised(content or "")
                    at: dict[str, list[int]] = {}
                    for i, (_, line) in enumerate(lines):
                        for w in {w for _, w in automaton.iter(line)}:
                            at.setdefault(w, []).append(i)
                    places = Places([], [])
                    places.n, places.at = len(lines), at
                    for number in sorted(k for w in at if w in first for k in first[w]):
                        name, wanted = block[number]
                        start = places.first(wanted)
                        if start is not None:
                            rows.append({"repo": repo, "path": path, "id": name, "start_line": lines[start][0], "end_line": lines[start + len(wanted) - 1][0]})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("repo", pa.string()), ("path", pa.string()), ("id", kind), ("start_line", pa.int32()), ("end_line", pa.int32())]))

        return run

    kind = to_arrow_type(runs.schema["id"].dataType)
    dealt = runs.where("size(wanted) > 0").select("id", "wanted", F.pmod(F.xxhash64("wanted"), F.lit(blocks)).alias("block"))
    out = None
    for k in range(blocks):
        block = [(r["id"], r["wanted"]) for r in dealt.where(F.col("block") == k).collect()]
        if block:
            found = files.select(*kept).mapInArrow(search(block), f"repo string, path string, id {id_type}, start_line int, end_line int")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = files.where("false").select(*kept[:2], F.lit(None).cast(id_type).alias("id"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    return out
