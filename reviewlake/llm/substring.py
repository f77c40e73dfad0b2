"""Substring dedup: words in windows that also start in a document with a smaller id are removed.

A task rolls Rabin-Karp hashes (64 bits, over hashed words) along every window of its documents and keeps, for each
block of about BLOCK windows, one entry a distinct hash: the smallest document that has it. A repeat inside the block is
settled there, so a passage that all documents share sends one entry a block, not one a document. Entries go to
buckets of hash values, packed as sorted differences; a bucket finds the smallest document of each hash over all blocks and sends
the (document, hash) pairs that lose back, packed for each group of documents. Groups meet their texts again, and each
document merges its losing windows into maximal intervals and cuts them. Buckets and groups follow the size of the
texts; packing only saves bytes and rows, of which there are never more than windows.

Cases: a null or empty text has no words; a text under 13 words has no window; repeated rows of one doc_id never cost
each other words, and all are judged alike; a null doc_id neither takes nor gives, and its text stays whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import WORD, id_and_text

WINDOW = 13
BLOCK = 1 << 20
#: Bytes of text that one bucket's entries come from.
BUCKET_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
PARTS = "bucket int, grp int, hashes binary, owners binary"
PARTS_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary())])
LOSES_ARROW = pa.schema([("grp", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary())])


class WordHashes(dict):
    """Word to 64-bit hash; a cache that forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: list[str], known: WordHashes, window: int = WINDOW) -> np.ndarray:
    """The rolling hash of each window, in order of its start; Horner's rule doubled, for all starts at once."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    single = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total, done, piece, width = None, 0, single, 1
    power = BASE
    rest = window
    with np.errstate(over="ignore"):
        while rest:  # windows of 1, 2, 4, ... words, joined by the bits of the window's length
            if rest & 1:
                if total is None:
                    total, done = piece, width
                else:
                    n = len(single) - done - width + 1
                    total, done = total[:n] * power + piece[done : done + n], done + width
            rest >>= 1
            if rest:
                n = len(piece) - width
                piece = piece[:n] * power + piece[width:]
                power, width = power * power, 2 * width
        return mixed(total)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of hash values; buckets fit 31 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, one byte plane after the other: the high planes are zeros, which compress away."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_owners(docs: np.ndarray) -> bytes:
    """Document ids as a sorted dictionary and places in it."""
    ids, place = np.unique(docs, return_inverse=True)
    kind = np.uint8 if len(ids) <= 1 << 8 else np.uint16 if len(ids) <= 1 << 16 else np.uint32
    return np.int64(len(ids)).tobytes() + ids.astype("<i8").tobytes() + place.astype(kind).tobytes()


def unpack_owners(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    kind = np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32
    return np.frombuffer(data, "<i8", n, 8)[np.frombuffer(data, kind, offset=8 + 8 * n)]


def firsts(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted hashes with their smallest document, and the (document, hash) pairs that lose to one of these."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    owner = docs[new]
    loses = docs > owner[np.cumsum(new) - 1] if len(hashes) else np.zeros(0, bool)
    return hashes[new], owner, docs[loses], hashes[loses]


def group_of(doc: int, groups: int) -> int:
    """The same as pmod(xxhash64(doc_id), groups) in Spark."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
    return (h - (h >> 63 << 64)) % groups


def by_group(docs: np.ndarray, hashes: np.ndarray, groups: int) -> list[dict]:
    """Losing pairs as one packed row for each group of documents."""
    if not len(docs):
        return []
    ids, place = np.unique(docs, return_inverse=True)
    grp = np.array([group_of(x, groups) for x in ids.tolist()])[place]
    order = np.lexsort((hashes, grp))
    docs, hashes, grp = docs[order], hashes[order], grp[order]
    found, starts = np.unique(grp, return_index=True)
    ends = [*starts[1:], len(grp)]
    return [{"grp": int(g), "hashes": pack(hashes[lo:hi]), "owners": pack_owners(docs[lo:hi])} for g, lo, hi in zip(found, starts, ends, strict=True)]


def sizes(texts: DataFrame) -> int:
    """Buckets or groups for these texts: as many as shuffle partitions at least."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min((1 << 31) - 1, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))


def losing_windows(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """grp, hashes, owners: packed pairs of a window hash and a document that shares it with one of a smaller id."""
    texts = id_and_text(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def entries(batches):
        known, find = WordHashes(), re.compile(WORD).findall
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            h, d, lost_d, lost_h = firsts(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held.clear()
            rows = [x | {"bucket": x["grp"]} for x in by_group(lost_d, lost_h, buckets)]
            # Only buckets that the block has entries for: never more rows than entries, however many buckets there are.
            present, cuts = np.unique(bucket_of(h, buckets), return_index=True)
            for b, lo, hi in zip(present.tolist(), cuts, [*cuts[1:], len(h)], strict=True):
                rows.append({"grp": None, "bucket": b, "hashes": pack(h[lo:hi]), "owners": pack_owners(d[lo:hi])})
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[i : i + 500], schema=PARTS_ARROW)

        n = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(window_hashes(find(text), known, window))
                if len(h):
                    held.append((h, np.full(len(h), doc, np.int64)))
                    n += len(h)
                if n >= BLOCK:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    def settle(group: pa.Table) -> pa.Table:
        settled = pc.is_valid(group.column("grp"))
        done = group.filter(settled).select(LOSES_ARROW.names)
        group = group.filter(pc.invert(settled))
        if not group.num_rows:
            return done
        h = np.concatenate([unpack(x) for x in group.column("hashes").to_pylist()])
        d = np.concatenate([unpack_owners(x) for x in group.column("owners").to_pylist()])
        _, _, docs_, lost = firsts(h, d)
        return pa.concat_tables([done.cast(LOSES_ARROW), pa.Table.from_pylist(by_group(docs_, lost, buckets), schema=LOSES_ARROW)])

    # What a block has settled itself passes through a bucket, so that the texts are hashed once.
    return texts.mapInArrow(entries, PARTS).groupBy("bucket").applyInArrow(settle, "grp int, hashes binary, owners binary")


def removal_intervals(starts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Sorted window starts merged to maximal (start, end) word intervals."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return list(zip(starts[np.r_[0, breaks + 1]].tolist(), (starts[np.r_[breaks, len(starts) - 1]] + window).tolist(), strict=True))


def drop_repeats(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """doc_id, kept (the words left, joined by one space), n_words, n_removed, removed (word intervals)."""
    texts = id_and_text(docs)
    buckets = buckets or sizes(texts)
    lost = losing_windows(texts, buckets, window)
    # Documents without an id lose nothing, so they meet no hashes and are dealt to no group.
    dealt = texts.where("doc_id is not null").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(span))])
    schema = "doc_id long, kept string, n_words long, n_removed long, removed array<struct<start:long,end:long>>"

    def cut_rows(ids, texts, lost: dict[int, np.ndarray]) -> list[dict]:
        known, find, rows = WordHashes(), re.compile(WORD).findall, []
        for doc, text in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
            words = find(text or "")
            spans = removal_intervals(np.flatnonzero(np.isin(window_hashes(words, known, window), lost[doc])), window) if doc in lost else []
            kept, at = [], 0
            for lo, hi in spans:
                kept += words[at:lo]
                at = hi
            kept += words[at:]
            removed = [{"start": lo, "end": hi} for lo, hi in spans]
            rows.append({"doc_id": doc, "kept": " ".join(kept), "n_words": len(words), "n_removed": len(words) - len(kept), "removed": removed})
        return rows

    def cut(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        lost: dict[int, np.ndarray] = {}
        if pairs.num_rows:
            h = np.concatenate([unpack(x) for x in pairs.column("hashes").to_pylist()])
            d = np.concatenate([unpack_owners(x) for x in pairs.column("owners").to_pylist()])
            order = np.argsort(d, kind="stable")
            ids, starts = np.unique(d[order], return_index=True)
            lost = dict(zip(ids.tolist(), np.split(h[order], starts[1:]), strict=True))
        return pa.Table.from_pylist(cut_rows(texts.column("doc_id"), texts.column("text"), lost), schema=out)

    def whole(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist(cut_rows(b.column(0), b.column(1), {}), schema=out)

    known_ids = dealt.groupBy("grp").cogroup(lost.groupBy("grp")).applyInArrow(cut, schema)
    return known_ids.unionByName(texts.where("doc_id is null").mapInArrow(whole, schema))
