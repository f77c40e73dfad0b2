"""SimHash near-dedup with pivot distance tables.

Fingerprints: each document's word shingles are hashed (XXH64); a bit is 1 if set in over half of the hashes. Equal
fingerprints are one class from then on, so exact copies cost one row.

Pivot tables hold Hamming distances to reference fingerprints (rows of a Walsh-Hadamard matrix, 32 bits from each other). Two of them are
made of every distinct fingerprint, once. The first has the distances to KEY_PIVOTS references inside each union of BLOCKS -
radius of BLOCKS bit blocks: a pair within `radius` bits is equal in at least one union, so all its distances there
are equal, and candidates meet in an equality join on those distances. (Over all 64 bits a close pair's distances
may differ by up to `radius`, and so do those of nearly half of all random pairs: no join there.) The second has the distances to PIVOTS references over all bits:
in every group that meets, pairs whose largest coordinate difference is over `radius` are discarded, and XOR and
popcount verify the rest. `discarded` tells which share of pairs the second table discards.

A task grows clusters from one member at a time: what it reaches leaves the pool, so near copies cost close to linear
time, and each cluster gives a star of edges, not all pairs. A group of over SPLIT members isn't held: its task passes
the members on as they come, and they meet again on unions of blocks of the bits that were left open, spread by Spark. Each round fixes half of
the open bits, so after three rounds no group can have over 1,024 members; with 8 open bits none is passed on.

Cases: null and empty texts have fingerprint zero and link like others; repeated rows give repeated rows; a null
doc_id keeps its fingerprint and takes its component's id, or null alone; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import WORD, id_and_text, stored
from reviewlake.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
BLOCKS, KEY_PIVOTS, PIVOTS = 6, 16, 64
#: Members of a group that a task holds; larger groups are dealt anew.
SPLIT = 8_192
LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None, find=re.compile(WORD).findall, shingle: int = SHINGLE) -> int:
    words = find((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(" ".join(words[i : i + shingle]).encode("utf-8", "surrogatepass"), SEED) for i in range(n)]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a signed long). Narrow."""

    def one(batches):
        find = re.compile(WORD).findall
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([signed(fingerprint(x, find, shingle)) for x in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(one, "doc_id long, fp long")


def bit_blocks(bits: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits set in `bits`, cut into blocks as equal as can be."""
    at = [i for i in range(64) if bits >> i & 1]
    cuts = [len(at) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << i for i in at[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def unions(bits: int, radius: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of the unions of blocks - radius blocks: fingerprints within radius are equal in one of them."""
    masks = bit_blocks(bits, blocks)
    return [sum(x) for x in combinations(masks, blocks - radius)]


def references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of a Walsh-Hadamard matrix, which lie 32 bits from each other."""
    rows = [sum(((r & c).bit_count() & 1) << c for c in range(64)) for r in range(n)]
    return np.array(rows, np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray, mask: int = (1 << 64) - 1) -> np.ndarray:
    """Hamming distances inside a mask, a row for each fingerprint."""
    return np.bitwise_count((fps[:, None] ^ pivots[None, :]) & np.uint64(mask)).astype(np.int8)


def joined(table: np.ndarray) -> np.ndarray:
    """A row of distances as one number; equal rows give equal numbers, and unequal ones hardly ever do (candidates only)."""
    out = np.zeros(len(table), np.uint64)
    with np.errstate(over="ignore"):
        for column in table.T:
            out = (out + column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def clusters(fps: np.ndarray, radius: int = RADIUS, table: np.ndarray | None = None) -> np.ndarray:
    """For each of distinct fingerprints the index of its cluster's first one; links inside are all within radius."""
    table = pivot_table(fps, references()) if table is None else table
    root = np.arange(len(fps))
    pool = np.arange(len(fps))
    while len(pool):
        first, pool = pool[0], pool[1:]
        frontier = [first]
        while frontier and len(pool):
            x = frontier.pop()
            near = pool[np.abs(table[pool] - table[x]).max(1) <= radius]  # pivots discard
            hits = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]  # verified
            if len(hits):
                root[hits] = first
                frontier += hits.tolist()
                pool = pool[~np.isin(pool, hits, assume_unique=True)]
    return root


def discarded(fps: np.ndarray, radius: int = RADIUS, pivots: int = PIVOTS) -> float:
    """The share of the pairs of fps, all farther apart than radius, that the pivot table alone discards."""
    table = pivot_table(fps, references(pivots))
    far = kept = 0
    for i in range(1, len(fps)):
        apart = np.bitwise_count(fps[:i] ^ fps[i]) > radius
        far += int(apart.sum())
        kept += int((np.abs(table[:i] - table[i]).max(1) <= radius)[apart].sum())
    return 1 - kept / far if far else 1.0


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split: int = SPLIT) -> DataFrame:
    """a, b: edges that connect whatever fingerprints of distinct (fp long) are within radius, directly or over others."""
    key_pivots, pivots = references(KEY_PIVOTS), references()

    def keyed(batches):
        """fp, fixed (the bits in which a group is equal already), key (of that group): a row for each union of the open bits."""
        for b in batches:
            fps, fixed, key = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(3))
            for f in np.unique(fixed):
                own, before = fps[fixed == f], key[fixed == f]
                for mask in unions(~int(f) & ((1 << 64) - 1), radius, blocks):
                    distances = joined(pivot_table(own, key_pivots, mask))
                    with np.errstate(over="ignore"):
                        at = (before ^ distances) * np.uint64(0xBF58476D1CE4E5B9)
                    columns = own, np.full(len(own), int(f) | mask, np.uint64), at
                    yield pa.record_batch([pa.array(x.view(np.int64)) for x in columns], names=["fp", "fixed", "key"])

    def out(a, b=None, group=None):
        """Edges, or with group (fixed, key) members of a group that is dealt anew."""
        n = len(a)
        rest = [pa.nulls(n, pa.int64())] if b is None else [pa.array(b)]
        rest += [pa.array(np.full(n, x, np.int64)) for x in group] if group else [pa.nulls(n, pa.int64())] * 2
        return pa.record_batch([pa.array(a), *rest], names=["fp", "other", "fixed", "key"])

    def meet(batches):
        """Rows come sorted by (fixed, key): a group may go on in the next batch. A group over split is passed on, not held."""
        held, group, passed = [], None, False
        for b in batches:
            fps, fixed, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fps):
                continue
            new = np.flatnonzero(np.r_[True, (fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[new[1:], len(fps)]
            # A lone row links with nothing, unless its group began before this batch or goes on after it.
            told = ends - new > 1
            told[[0, -1]] = True
            for lo, hi in zip(new[told].tolist(), ends[told].tolist(), strict=True):
                if group != (fixed[lo], key[lo]):
                    yield from edges(held)
                    held, group, passed = [], (fixed[lo], key[lo]), False
                held.append(fps[lo:hi])
                if passed or (sum(map(len, held)) > split and (~int(fixed[lo]) & ((1 << 64) - 1)).bit_count() > 8):
                    yield out(np.concatenate(held), group=group)
                    held, passed = [], True
        yield from edges(held)

    def edges(held):
        if sum(map(len, held)) > 1:
            own = np.unique(np.concatenate(held))
            u = own.view(np.uint64)
            root = clusters(u, radius, pivot_table(u, pivots))
            moved = np.flatnonzero(root != np.arange(len(own)))
            if len(moved):
                yield out(own[root[moved]], own[moved])

    rows, found = distinct.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("key")), None
    while True:
        dealt = rows.mapInArrow(keyed, "fp long, fixed long, key long").repartition("fixed", "key").sortWithinPartitions("fixed", "key")
        met = stored(dealt.mapInArrow(meet, "fp long, other long, fixed long, key long"), "met")
        own = met.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        found = own if found is None else found.union(own)
        rows = met.where("other is null").select("fp", "fixed", "key")
        if not rows.head(1):
            return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id that links reach)."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    nodes = components(links(classes, radius))
    known = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    heads = known.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = stored(known.join(heads, "component").select("fp", "component_id"), "ids")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
