"""Line dedup: lines that many documents hold stay only in the one with the largest id.

Lines are exploded and hashed (128 bits), each hash's distinct documents are counted, and the hashes over the threshold go back
to the documents that lose them; what is left of a text is put together again in its order. Hashing and cutting go over a
text's bytes once, with a set of the hashes it loses, so a text of very many lines costs no more than its length. Counting groups by
(document, hash) first, so a line that a third of all documents share is spread by document and pre-aggregated; the few
hashes that hold a thousandth of all pairs each are joined by broadcast, so no key of the other join is larger than that.

Cases: a null or empty text is one empty line; a document that loses all lines has the empty text; repeated rows of one
doc_id count as one document and lose the same lines; a null doc_id isn't counted and loses nothing; an empty table gives an
empty result; other columns stay with drop_lines and are not read otherwise.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import id_and_text, stored, text_bytes

MIN_LENGTH, MIN_DOCS = 20, 3
#: Hashes that are broadcast at most: each holds at least this part of all (document, hash) pairs.
MOST_HOT = 1_000
SPACE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_length: int) -> tuple[int, int] | None:
    """Two longs for a line's key (white space at both ends stripped, A-Z lower-cased); None for a key under min_length code points."""
    key = line.strip(SPACE).lower()  # of bytes, lower() changes A-Z only
    if len(key) < min_length or (len(key) < 4 * min_length and len(key.decode("utf-8", "replace")) < min_length):
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lost_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, lost: the hashes of the lines that a document loses, as one array of their two halves."""

    def hashed(batches):
        for b in batches:
            ids, h1, h2 = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = {line_hash(x, min_length) for x in text.as_py().split(b"\n")} - {None}
                ids += [doc_id] * len(own)
                h1 += [h[0] for h in own]
                h2 += [h[1] for h in own]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["doc_id", "h1", "h2"])

    each = id_and_text(docs).where("doc_id is not null").select("doc_id", text_bytes().alias("bytes")).mapInArrow(hashed, "doc_id long, h1 long, h2 long")
    pairs = stored(each.distinct(), "lines")
    common = stored(pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs), "common")
    # Hashes that hold a 1 / MOST_HOT part of all pairs or more: MOST_HOT of them at most, so they may be broadcast.
    hot = F.col("n") * MOST_HOT >= pairs.count()
    often, others = (common.where(x).select("h1", "h2", "keeper") for x in (hot, ~hot))
    met = pairs.join(F.broadcast(often), ["h1", "h2"], "left").select("doc_id", "h1", "h2", "keeper")
    spread = met.where("keeper is null").drop("keeper").join(others, ["h1", "h2"]).select("doc_id", "h1", "h2", "keeper")
    return met.where("keeper is not null").union(spread).where("doc_id <> keeper").groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("h1", "h2"))).alias("lost"))


def drop_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs as `row`, doc_id, and kept (the text left), n_lines, n_dropped."""

    @F.arrow_udf("struct<kept:binary,n_dropped:long>")
    def cut(text: pa.Array, lost: pa.Array) -> pa.Array:
        kept, dropped = [], []
        for x, gone in zip(text, lost, strict=True):
            if not x.is_valid:
                kept.append(None)
                dropped.append(0)
                continue
            halves = gone.as_py()
            gone = set(zip(halves[::2], halves[1::2], strict=True))
            all_lines = x.as_py().split(b"\n")
            left = [y for y in all_lines if line_hash(y, min_length) not in gone]
            kept.append(b"\n".join(left))
            dropped.append(len(all_lines) - len(left))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(dropped, pa.int64())], names=["kept", "n_dropped"])

    lost = lost_lines(docs, min_length, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(lost, "doc_id", "left")
    # Texts that lose nothing are not sent to Python.
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = rows.withColumn("cut", cut(F.when(F.col("lost").isNotNull(), text.cast("binary")), "lost"))
    return rows.select("row", "doc_id", F.coalesce(F.col("cut.kept").cast("string"), text).alias("kept"), F.size(lines_of(text)).cast("long").alias("n_lines"), "cut.n_dropped")
