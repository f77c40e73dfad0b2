"""SimHash near-dedup of whole documents by the similarity of their word shingles.

op6's fingerprints of 64 bits tell near-identical texts apart. For documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, a fingerprint has WIDTH bits (each the majority of one bit of all shingle hashes): the share of
differing bits is the angle between the sets over pi, so it estimates the similarity with a standard deviation of 0.02. Pairs
link at RADIUS differing bits or fewer, and only if the sizes of their sets allow the similarity at all.

Candidates meet in tables: a table's key is a fixed random choice of bits, as many as make chance meetings rare among the
distinct fingerprints, and there are as many tables as find a pair at exactly the similarity with probability RECALL (closer
pairs more surely). Both numbers grow with the logarithm, and with a small power, of the number of documents.

What meets goes through pivot distance tables. Over all 256 bits they discard nothing at this radius, so they stand on BLOCKS
blocks of bits: distances to PIVOTS reference fingerprints inside each. A block's largest coordinate difference is a lower
bound of the bits that differ in it, and a pair is discarded if these bounds add up to more than RADIUS (`discarded` tells
which share); XOR and popcount verify the rest. No link of a group is lost: rows of small groups meet each with each,
and in larger ones clusters grow from every member, so near copies cost close to linear time. A group of over SPLIT rows is
not held: its task clusters SPLIT rows at a time and passes them on. Where such rows already are in one component,
nothing is open; rows outside their group's largest component meet all rows of the group in blocks, dealt by Spark.

Cases: null and empty texts have the fingerprint zero and link with each other; texts under `shingle` words are one shingle; repeated
rows give repeated rows; a null doc_id takes its component's id, or null alone; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import WORD, id_and_text, stored
from reviewlake.llm.components import components
from reviewlake.llm.simhash import LOWER, references
from reviewlake.llm.substring import WordHashes, window_hashes

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9
WIDTH, RADIUS = 256, 44
BLOCKS, PIVOTS = 8, 16
#: Rows of a group that are compared each with each in one step for all groups; in larger ones clusters grow.
SMALL = 8
#: Rows of a group that a task holds.
SPLIT = 8_192
#: Bits of a key at most; the number of its table stands above them.
MOST_BITS = 48
WORDS = ["f0", "f1", "f2", "f3"]


def shingle_set(text: str | None, known: WordHashes, find=re.compile(WORD).findall, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, A-Z lower-cased."""
    words = find((text or "").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))], np.uint64)
    return np.unique(window_hashes(words, known, shingle))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDTH bits as words of 64."""
    out = np.zeros(WIDTH // 64, np.uint64)
    for k in range(len(out) if len(hashes) else 0):
        with np.errstate(over="ignore"):
            x = (hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(x), 1 << 14):
            ones += np.unpackbits(x[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, f0 to f3 (the words of the fingerprint), size (of the set). Narrow."""

    def one(batches):
        known, find = WordHashes(), re.compile(WORD).findall
        for b in batches:
            sets = [shingle_set(x, known, find, shingle) for x in b.column(1).to_pylist()]
            fps = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            yield pa.record_batch([b.column(0), *(pa.array(x) for x in fps.T), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", *WORDS, "size"])

    return id_and_text(docs).mapInArrow(one, f"doc_id long, {', '.join(f'{w} long' for w in WORDS)}, size long")


def tables_for(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> np.ndarray:
    """A row of bit positions for each table that n distinct fingerprints need."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(max(n, 2))) + 1))
    count = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    rng = np.random.default_rng(19)
    return np.array([rng.choice(WIDTH, bits, replace=False) for _ in range(count)])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def alike(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    return (apart(x, y) <= radius) & (np.minimum(nx, ny) >= similarity * np.maximum(nx, ny))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances to PIVOTS references inside each block of bits: fingerprints x BLOCKS x PIVOTS."""
    blocks = np.ascontiguousarray(fps).view(f"u{WIDTH // BLOCKS // 8}")
    return np.bitwise_count(blocks[:, :, None] ^ references(PIVOTS).astype(blocks.dtype)).astype(np.int8)


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the differing bits of rows of pivot tables."""
    return np.abs(x - y).max(-1).sum(-1, dtype=np.int64)


def discarded(fps: np.ndarray, radius: int = RADIUS) -> float:
    """The share of the pairs of fps, all farther apart than radius, that the pivot table alone discards."""
    table, far, kept = pivot_table(fps), 0, 0
    for i in range(1, len(fps)):
        away = apart(fps[:i], fps[i]) > radius
        far += int(away.sum())
        kept += int((bound(table[:i], table[i]) <= radius)[away].sum())
    return 1 - kept / far if far else 1.0


class Rows:
    """Fingerprints of a batch, the sizes of their sets, their nodes and the keys under which they meet."""

    def __init__(self, node: np.ndarray, fps: np.ndarray, size: np.ndarray, key: np.ndarray):
        self.node, self.fps, self.size, self.key = node, fps, size, key

    def __len__(self):
        return len(self.node)

    def at(self, i) -> Rows:
        return Rows(self.node[i], self.fps[i], self.size[i], self.key[i])

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        """A batch of key, node, WORDS, size."""
        c = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)]
        return Rows(c[1], np.stack(c[2:6], 1).view(np.uint64), c[6], c[0])

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("node", "fps", "size", "key")))


def clusters(rows: Rows, similarity: float = SIMILARITY, radius: int = RADIUS) -> np.ndarray:
    """For each row the index of its cluster's first one: whatever links reach inside rows."""
    table, root, pool = pivot_table(rows.fps), np.arange(len(rows)), np.arange(len(rows))
    while len(pool):
        first, pool = pool[0], pool[1:]
        frontier = [first]
        while frontier and len(pool):
            x = frontier.pop()
            near = np.flatnonzero(bound(table[pool], table[x]) <= radius)  # pivots discard
            at = pool[near]
            near = near[alike(rows.fps[at], rows.size[at], rows.fps[x], rows.size[x], similarity, radius)]  # verified
            if len(near):
                root[pool[near]] = first
                frontier += pool[near].tolist()
                pool = np.delete(pool, near)
    return root


def small_pairs(rows: Rows, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked nodes inside groups of SMALL rows at most: each row with the SMALL - 1 rows after it."""
    table, x, y = pivot_table(rows.fps), [], []
    for o in range(1, min(SMALL, len(rows))):
        i = np.flatnonzero(rows.key[o:] == rows.key[:-o])
        i = i[bound(table[i], table[i + o]) <= radius]
        i = i[alike(rows.fps[i], rows.size[i], rows.fps[i + o], rows.size[i + o], similarity, radius)]
        x.append(rows.node[i])
        y.append(rows.node[i + o])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(x or none), np.concatenate(y or none)


def edges_of(rows: Rows, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    root = clusters(rows, similarity, radius)
    moved = np.flatnonzero(root != np.arange(len(rows)))
    return rows.node[root[moved]], rows.node[moved]


def links(classes: DataFrame, n: int, similarity: float = SIMILARITY, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """a, b: edges that connect the nodes of classes (node, WORDS, size; distinct) that meet and are alike, directly or over others."""
    positions = tables_for(n, similarity)

    def keyed(batches):
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)], 1).astype(np.int64)
            for lo in range(0, len(rows), 2_000):
                part = rows[lo : lo + 2_000]
                bits = np.unpackbits(np.ascontiguousarray(part[:, 1:5]).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                for t, at in enumerate(positions):
                    key = bits[:, at] @ (np.int64(1) << np.arange(len(at), dtype=np.int64)) | np.int64(t) << np.int64(MOST_BITS)
                    yield pa.record_batch([pa.array(key), *(pa.array(np.ascontiguousarray(c)) for c in part.T)], names=["key", "node", *WORDS, "size"])

    def out(a, b, key=None):
        """Edges, or with key the nodes of a group that is not held."""
        keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), keys], names=["a", "b", "key"])

    def meet(batches):
        """Rows come sorted by key. What a batch ends with is held until its group is whole or has split rows."""
        held, passed = None, None
        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows.of(b) if held is None else Rows.joined([held, Rows.of(b)])
            starts = np.flatnonzero(np.r_[True, rows.key[1:] != rows.key[:-1]])
            counts = np.diff(np.r_[starts, len(rows)])
            whole = np.arange(len(starts)) < len(starts) - 1
            whole[0] &= passed != rows.key[0]
            few = np.repeat(whole & (counts > 1) & (counts <= SMALL), counts)
            yield out(*small_pairs(rows.at(few), similarity, radius))
            for lo, k in zip(starts[whole & (counts > SMALL)].tolist(), counts[whole & (counts > SMALL)].tolist(), strict=True):
                group = rows.at(slice(lo, lo + k))
                yield from parts(group, k > split)
            if len(starts) > 1 and not whole[0]:
                yield from parts(rows.at(slice(0, starts[1])), True)
            held = rows.at(slice(starts[-1], None))
            if len(held) > split:
                passed = held.key[0]
                yield from parts(held, True)
                held = None
        if held is not None:
            yield from parts(held, passed == held.key[0])

    def parts(group, pass_on):
        """A group's clusters, split rows at a time; its rows too, if other rows of the group are or may be elsewhere."""
        for lo in range(0, len(group), split):
            part = group.at(slice(lo, lo + split))
            yield out(*edges_of(part, similarity, radius))
            if pass_on:
                yield out(part.node, None, part.key)

    rows = classes.select("node", *WORDS, "size").mapInArrow(keyed, f"key long, node long, {', '.join(f'{w} long' for w in WORDS)}, size long")
    dealt = rows.repartition("key").sortWithinPartitions("key", "size", "f0")
    met = stored(dealt.mapInArrow(meet, "a long, b long, key long"), "met")
    found = met.where("key is null").select("a", "b")
    spread = met.where("key is not null").select(F.col("a").alias("node"), "key")
    return found.union(between(spread, classes, components(found), similarity, radius, split)) if spread.head(1) else found


def between(spread: DataFrame, classes: DataFrame, nodes: DataFrame, similarity: float, radius: int, split: int) -> DataFrame:
    """a, b: links of spread (node, key) between a group's rows outside its largest component so far and all of its rows.

    Both are dealt into blocks of about `split` rows; each block of one side meets each of the other. A group whose rows all are
    in one component has no open rows and goes. Two groups may share a pair of components; each looks for itself.
    """
    rows = spread.join(nodes, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(F.col(x) / F.lit(split))).cast("int")
    tops = stored(tops.select("key", "top", blocks("n").alias("all"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("most")) / F.lit(split))).cast("int").alias("open")), "tops")
    full = stored(rows.join(tops, "key").join(classes.select("node", *WORDS, "size"), "node"), "spread")
    own = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    columns = ["key", "node", *WORDS, "size", "component"]
    left = full.where("component <> top").select(*columns, own("open").alias("i"), each("all").alias("j"), F.lit(0).alias("side"))
    right = full.select(*columns, each("open").alias("i"), own("all").alias("j"), F.lit(1).alias("side"))

    def meet(batches):
        """Sorted by (key, i, j, side): open rows come first and are held, the others pass."""
        at, held, table = None, None, None
        for b in batches:
            rows = Rows.of(b)
            more = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7, 11)]
            new = np.zeros(len(rows), bool)
            for c in (rows.key, *more[1:]):
                new[1:] |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(new)] if len(rows) else []
            for lo, hi in zip(starts, np.r_[starts[1:], len(rows)] if len(rows) else [], strict=True):
                block, part, component = (rows.key[lo], more[1][lo], more[2][lo]), rows.at(slice(lo, hi)), more[0][lo:hi]
                if more[3][lo] == 0:
                    part = (part, component) if at != block else (Rows.joined([held[0], part]), np.r_[held[1], component])
                    at, held, table = block, part, None
                elif at == block:
                    table = pivot_table(held[0].fps) if table is None else table
                    yield from across(part, component, *held, table)

    def across(part, component, some, known, table):
        """Each row's first link into each other component; the others say nothing new."""
        a, b = [], []
        for k, row in enumerate(pivot_table(part.fps)):
            hit = np.flatnonzero((known != component[k]) & (bound(table, row) <= radius))
            hit = hit[alike(some.fps[hit], some.size[hit], part.fps[k], part.size[k], similarity, radius)]
            hit = hit[np.unique(known[hit], return_index=True)[1]]
            a.append(np.full(len(hit), part.node[k]))
            b.append(some.node[hit])
        if sum(map(len, a)):
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b)], names=["a", "b"])

    dealt = left.union(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return stored(dealt.mapInArrow(meet, "a long, b long"), "between")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """doc_id, component_id (smallest doc_id that links reach)."""
    same = [*WORDS, "size"]
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    # Written before it is used, so a node's number stays.
    classes = stored(fps.groupBy(*same).agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = components(links(classes, classes.count(), similarity, radius, split))
    known = classes.join(nodes, "node", "left").select(*same, "first", F.coalesce("component", "node").alias("component"))
    heads = known.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = stored(known.join(heads, "component").select(*same, "component_id"), "ids")
    return fps.join(ids, same).select("doc_id", "component_id")
