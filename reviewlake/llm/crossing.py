"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, and how many documents say so.

Pass one tokenizes each text twice, cuts both token rows into groups where tokens of both end at the same byte, and writes ids
and groups in chunks of about CHUNK_BYTES of text; for each chunk and segment of first ids it writes the distinct pairs of ids
with their numbers of documents. The distinct pairs of a segment, united branch by branch, get a minimal perfect hash; each
branch sums its chunks into a dense vector with a place for each pair by that hash, verified against the pair that is kept there, and
vectors are summed as a tree. All pairs of a first id share a segment, so its highest count is known there. Counts go back to
the chunks that asked. Pass two takes links from ids and groups again and looks their counts up.

The written ids are bucketed by chunk, so pass two meets the counts without shuffling them. A segment holds at most a
SEGMENTS-th of all first ids with as many second ids each; a branch holds about BRANCH_PAIRS pairs whatever the
number of chunks. A group of very many tokens is taken by distinct ids with their multiplicities.

Cases: a null or empty text, or one that a tokenizer doesn't give back byte by byte, has no tokens: zeros and an empty digest;
special tokens' strings are plain text; repeated rows are documents of their own, and a null doc_id is one too; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import forget_later, id_and_text, shared_dir, stored
from reviewlake.llm.packing import COMMON, fast_tokenizer

CHUNK_BYTES, SEGMENTS, BRANCH_PAIRS, FAN_IN = 4 << 20, 256, 4_000_000, 32
#: Texts tokenized at once, and links of one group or batch made at once.
BATCH, MOST_LINKS = 64, 1 << 20
TOKENS = "chunk long, segment int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, ids_a binary, ids_b binary, shape binary, pairs binary, docs binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers of a worker: ids of a text, and the bytes of each id."""

    def __init__(self, a: str, ranks: str | None, pattern: str | None, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(a)
        self.exact.encode_special_tokens = True
        self.fast = fast_tokenizer(ranks, pattern) if ranks else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b)
        place, names = byte_of(), self.exact.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(place.get(c, 0x20) for c in name)
        piece = self.pieces.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.pieces.vocab_size())]
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Written ids with what follows them: in a group, at its end; of A, then of B.
        self.words_a = [f"{i}{end}".encode() for end in ",|" for i in range(len(self.bytes_a))]
        self.words_b = [f"{i}{end}".encode() for end in ",;" for i in range(len(self.bytes_b))]
        self.words = self.words_a + self.words_b

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both; none unless both give the text's bytes, a space before them."""
        data = b" " + text.encode()
        if self.fast and COMMON.fullmatch(text):
            first = self.fast.encode_ordinary(" " + text)  # gives every text back
        else:
            first = self.exact.encode(" " + text, add_special_tokens=False).ids
            if b"".join(map(self.bytes_a.__getitem__, first)) != data:
                return [], []
        second = self.pieces.encode(text, num_threads=1)
        return (first, second) if b"".join(map(self.bytes_b.__getitem__, second)) == data else ([], [])

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the groups, in tokens of either, of rows that cover the same bytes."""
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a) if len(a) else at
        return np.diff(last_a, prepend=-1), np.diff(at[last_a], prepend=-1)

    def digest(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> str:
        """SHA-256 of `a1,a2|b1;a3|b2,b3`: the ids of each group, in order."""
        group_a, group_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        words = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[np.cumsum(na) - 1] = len(self.bytes_a)
        last_b[np.cumsum(nb) - 1] = len(self.bytes_b)
        words[np.arange(len(a)) + (np.cumsum(nb) - nb)[group_a]] = a + last_a
        words[np.arange(len(b)) + np.cumsum(na)[group_b]] = len(self.words_a) + b + last_b
        return hashlib.sha256(b"".join(map(self.words.__getitem__, words.tolist()))[:-1]).hexdigest()


@lru_cache(maxsize=2)
def tokenizers_of(a: str, ranks: str | None, pattern: str | None, b: str) -> Tokenizers:
    return Tokenizers(a, ranks, pattern, b)


def links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: int) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """(codes, weights, group) of all linked occurrences, in blocks: code a * base + b; weights (None: 1) count equal ones of a large group."""
    many = na * nb
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    small = np.where(many <= MOST_LINKS, many, 0)
    # Blocks of neighbouring groups with about MOST_LINKS links.
    block = np.cumsum(small) // MOST_LINKS
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(na)] if len(na) else [0]
    for lo, hi in zip(edges, edges[1:], strict=False):
        groups = lo + np.flatnonzero(small[lo:hi])
        # Each token of A in these groups, as often as its group has tokens of B.
        token = np.repeat(first_a[groups] - (np.cumsum(na[groups]) - na[groups]), na[groups]) + np.arange(int(na[groups].sum()))
        group = np.repeat(groups, na[groups])
        times = nb[group]
        total = int(times.sum())
        second = np.repeat(first_b[group] - (np.cumsum(times) - times), times) + np.arange(total)
        yield np.repeat(a[token].astype(np.int64) * base, times) + b[second], None, np.repeat(group, times)
    for g in np.flatnonzero(many > MOST_LINKS).tolist():
        one, n_one = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
        two, n_two = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        step = max(1, MOST_LINKS // len(two))
        for i in range(0, len(one), step):
            codes = (one[i : i + step].astype(np.int64)[:, None] * base + two).ravel()
            yield codes, (n_one[i : i + step, None] * n_two).ravel(), np.full(len(codes), g)


def narrow(x: np.ndarray, most: int) -> bytes:
    return x.astype("<u2" if most <= 1 << 16 else "<u4" if most <= 1 << 32 else "<u8").tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def aligned(docs: DataFrame, names: tuple, chunk_bytes: int, segments: int) -> DataFrame:
    """TOKENS, written once and bucketed by chunk: a row a document (segment null), and a row a chunk and segment with its pairs."""

    def run(batches):
        both = tokenizers_of(*names)
        base, codes_below = len(both.bytes_b), len(both.bytes_a) * len(both.bytes_b)
        part, number, size = TaskContext.get().partitionId(), 0, 0
        pairs: list[np.ndarray] = []

        def flushed(chunk: int):
            codes, counts = np.unique(np.concatenate(pairs), return_counts=True)
            segment = (codes // base) % segments
            order = np.argsort(segment, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(segment[order])) + 1):
                yield {"chunk": chunk, "segment": int(segment[own[0]]), "pairs": narrow(codes[own], codes_below), "docs": narrow(counts[own], 1 << 32), "n_a": len(own)}

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                chunk = part << 32 | number
                texts = [x or "" for x in piece.column(1).to_pylist()]
                ids = [both.encode(x) if x else ([], []) for x in texts]
                rows = []
                for doc_id, (first, second) in zip(piece.column(0).to_pylist(), ids, strict=True):
                    a, b = np.array(first, np.int64), np.array(second, np.int64)
                    na, nb = both.groups(a, b)
                    said = both.digest(a, b, na, nb) if first else ""
                    own = [pd.unique(codes) for codes, _, _ in links(a, b, na, nb, base)]
                    pairs.append(pd.unique(np.concatenate(own)) if len(own) > 1 else own[0] if own else np.zeros(0, np.int64))
                    shape = np.stack([na, nb], axis=1).ravel()
                    row = {"chunk": chunk, "doc_id": doc_id, "n_a": len(a), "n_b": len(b), "n_groups": len(na), "groups_sha256": said}
                    rows.append(row | {"ids_a": narrow(a, len(both.bytes_a)), "ids_b": narrow(b, base), "shape": narrow(shape, int(shape.max(initial=0)) + 1)})
                size += sum(map(len, texts))
                if size >= chunk_bytes:
                    rows += flushed(chunk)
                    number, size, pairs = number + 1, 0, []
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
        if pairs:
            yield pa.RecordBatch.from_pylist(list(flushed(part << 32 | number)), schema=ARROW)

    spark = docs.sparkSession
    name = f"tokens_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    forget_later(spark, path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs).mapInArrow(run, TOKENS)
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
ARROW = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in TOKENS.split(", ")])


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-spread 64-bit number for each code and seed."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: level by level, a key takes a bit that no other key of the level wants; its place is the bit's rank.

    Levels have two bits for each key left, so a key takes about 1.6 levels and 3.5 bits in all.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.cumsum([0, *sizes])
        self.ranks = np.cumsum(bits) - bits

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left):
            size = 2 * len(left) + 1
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(taken)
            left = left[~taken[place]]
        return cls(sizes, np.concatenate(levels).astype(np.int64) if levels else np.zeros(0, np.int64))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """A place from 0 to n - 1 for each key of the set; any place, or -1, for others: verify."""
        out, rows = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (mixed(keys[rows], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[rows[hit]] = self.ranks[at[hit]]
            rows = rows[~hit]
            if not len(rows):
                break
        return out

    def packed(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<i8").tobytes() + np.packbits(self.bits.astype(bool)).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8).tolist()
        return cls(sizes, np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)), count=sum(sizes)).astype(np.int64))


def united(segment_rows: DataFrame, fan_in: int) -> DataFrame:
    """segment, n, keys (in the order of their places), hash: the distinct pairs of each segment. segment_rows: segment, branch, n, pairs."""

    def unite(key, group):
        keys = np.unique(np.concatenate([widened(x, n) for x, n in zip(group["pairs"].to_pylist(), group["n"].to_pylist(), strict=True)]))
        return pa.table({"segment": [key[0].as_py()], "branch": [key[1].as_py() // fan_in], "n": [len(keys)], "pairs": [keys.astype("<i8").tobytes()]}, schema=UNITED)

    def hashed(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = widened(r["pairs"], r["n"])
                made = PerfectHash.of(keys)
                kept = np.empty(len(keys), "<i8")
                kept[made.places(keys)] = keys
                yield pa.RecordBatch.from_pylist([{"segment": r["segment"], "n": r["n"], "keys": kept.tobytes(), "hash": made.packed()}], schema=HASHED)

    rows, branches = segment_rows, segment_rows.select(F.max("branch")).first()[0]
    while True:
        rows = stored(rows.groupBy("segment", "branch").applyInArrow(unite, "segment int, branch int, n long, pairs binary"), "united")
        if not branches:
            break
        branches //= fan_in
    return stored(rows.mapInArrow(hashed, "segment int, n long, keys binary, hash binary"), "hashes")


UNITED = pa.schema([("segment", pa.int32()), ("branch", pa.int32()), ("n", pa.int64()), ("pairs", pa.binary())])
HASHED = pa.schema([("segment", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("hash", pa.binary())])
VECTOR = pa.schema([("segment", pa.int32()), ("branch", pa.int32()), ("vector", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def verified(table: dict, codes: np.ndarray) -> np.ndarray:
    """Places of pairs in a segment's vector; each must be the pair that is kept there."""
    places = PerfectHash.unpacked(table["hash"]).places(codes)
    if (places < 0).any() or (widened(table["keys"], table["n"])[places] != codes).any():
        raise ValueError("a pair of the second pass is not among those of the first")
    return places


def summed(asked: DataFrame, hashes: DataFrame, fan_in: int) -> DataFrame:
    """segment, vector: the documents of each pair, at its place. asked: segment, branch, chunk, n, pairs, docs."""
    branches = asked.select(F.max("branch")).first()[0]
    each = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches or 0))))

    def dense(group, tables):
        if not group.num_rows:
            return VECTOR.empty_table()
        table = tables.to_pylist()[0]
        vector = np.zeros(table["n"], np.int64)
        for r in group.select(["n", "pairs", "docs"]).to_pylist():
            vector[verified(table, widened(r["pairs"], r["n"]))] += widened(r["docs"], r["n"])
        return pa.table({"segment": [table["segment"]], "branch": [table["branch"] // fan_in], "vector": [vector.tobytes()]}, schema=VECTOR)

    def added(key, group):
        vectors = [np.frombuffer(x, np.int64) for x in group["vector"].to_pylist()]
        return pa.table({"segment": [key[0].as_py()], "branch": [key[1].as_py() // fan_in], "vector": [np.sum(vectors, axis=0).tobytes()]}, schema=VECTOR)

    schema = "segment int, branch int, vector binary"
    rows = stored(asked.groupBy("segment", "branch").cogroup(each.groupBy("segment", "branch")).applyInArrow(dense, schema), "vectors")
    while branches:
        rows = stored(rows.groupBy("segment", "branch").applyInArrow(added, schema), "vectors")
        branches //= fan_in
    return rows.select("segment", "vector")


def answered(asked: DataFrame, hashes: DataFrame, vectors: DataFrame, base: int) -> DataFrame:
    """chunk, n, pairs, counts, best (a byte: no pair of the same first id has more) for what each chunk asked."""
    branches = asked.select(F.max("branch")).first()[0]
    each = hashes.join(vectors, "segment").withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches or 0))))

    def answer(group, tables):
        if not group.num_rows:
            return ANSWER.empty_table()
        table = tables.to_pylist()[0]
        vector, first = np.frombuffer(table["vector"], np.int64), widened(table["keys"], table["n"]) // base
        _, number = np.unique(first, return_inverse=True)
        highest = np.zeros(int(number.max()) + 1, np.int64)
        np.maximum.at(highest, number, vector)
        best, rows = vector == highest[number], []
        for r in group.select(["chunk", "n", "pairs"]).to_pylist():
            at = verified(table, widened(r["pairs"], r["n"]))
            rows.append({"chunk": r["chunk"], "n": r["n"], "pairs": r["pairs"], "counts": narrow(vector[at], int(vector.max()) + 1), "best": best[at].astype(np.uint8).tobytes()})
        return pa.Table.from_pylist(rows, schema=ANSWER)

    pairs = asked.select("segment", "branch", "chunk", "n", "pairs")
    return pairs.groupBy("segment", "branch").cogroup(each.groupBy("segment", "branch")).applyInArrow(answer, "chunk long, n long, pairs binary, counts binary, best binary")


def looked_up(tokens: DataFrame, answers: DataFrame, base: int) -> DataFrame:
    """RESULT: the links of each document again, with what the corpus says of their pairs."""

    def look(docs, known):
        known = known.to_pylist()
        pairs, counts, best = (np.concatenate([widened(r[c], r["n"]) for r in known] or [np.zeros(0, np.int64)]) for c in ("pairs", "counts", "best"))
        order = np.argsort(pairs, kind="stable")
        pairs, counts, best = pairs[order], counts[order], best[order]
        rows = []
        for batch in docs.to_batches(max_chunksize=256):
            for r in batch.to_pylist():
                a, b, shape = widened(r["ids_a"], r["n_a"]), widened(r["ids_b"], r["n_b"]), widened(r["shape"], 2 * r["n_groups"])
                n_links = n_best = count_sum = 0
                for codes, weights, _ in links(a, b, shape[::2], shape[1::2], base):
                    at = np.searchsorted(pairs, codes)
                    n_links += len(codes) if weights is None else int(weights.sum())
                    n_best += int((best[at] if weights is None else best[at] * weights).sum())
                    count_sum += int((counts[at] if weights is None else counts[at] * weights).sum())
                rows.append({c: r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")} | {"n_links": n_links, "n_best": n_best, "count_sum": count_sum})
        return pa.Table.from_pylist(rows, schema=FINAL)

    docs = tokens.where("segment is null").drop("segment", "pairs", "docs")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(look, RESULT)


FINAL = pa.schema([(x.split()[0], TYPES[x.split()[1]]) for x in RESULT.split(", ")])


def align(docs: DataFrame, a: str, b: str, ranks: str | None = None, pattern: str | None = None, chunk_bytes: int = CHUNK_BYTES, segments: int = SEGMENTS, branch_pairs: int = BRANCH_PAIRS, fan_in: int = FAN_IN) -> DataFrame:
    """RESULT of each document. a: a tokenizer file of byte-level BPE, ranks and pattern its faster form; b: a sentencepiece model."""
    names = (a, ranks, pattern, b)
    base = len(tokenizers_of(*names).bytes_b)
    tokens = aligned(docs, names, chunk_bytes, segments)
    asked = tokens.where("segment is not null").select("segment", "chunk", F.col("n_a").alias("n"), "pairs", "docs")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    branches = max(1, math.ceil(total / (segments * branch_pairs)))
    asked = asked.withColumn("branch", F.pmod(F.xxhash64("chunk"), F.lit(branches)).cast("int"))
    hashes = united(asked.select("segment", "branch", "n", "pairs"), fan_in)
    return looked_up(tokens, answered(asked, hashes, summed(asked, hashes, fan_in), base), base)
