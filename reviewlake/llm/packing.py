"""Packing: concatenate and cut.

Pass one tokenizes each whole document once, with its end id, and writes ids, the task's number and the ids before it in the
task. Prefix sums over the tasks' totals give every document its global offset. Pass two cuts at multiples of the
sequence length; a document over a boundary has a record in each sequence. No ids are shuffled, and only the last
sequence has padding.

Ids equal those of the given tokenizers file without special tokens added. Texts of common Latin characters take a
faster encoder with the same vocabulary and rule; all others, and texts that hold a special token's string, take the file
itself.

Cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id is packed like others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import id_and_text, stored

LENGTH, END = 2048, 1
COMMON = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-\\u024f]*")


@lru_cache(maxsize=2)
def exact_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def fast_tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in exact_tokenizer(path).get_added_tokens_decoder().values())


def encode(text: str, path: str, ranks: str | None = None, pattern: str | None = None) -> list[int]:
    """Ids of a text by the tokenizer file at path; ranks and pattern name the faster encoder, if there is one."""
    if ranks and COMMON.fullmatch(text) and not any(x in text for x in special_strings(path)):
        return fast_tokenizer(ranks, pattern).encode_ordinary(text)
    return exact_tokenizer(path).encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian unsigned), part, before (ids of this part before the document), n. Written once."""

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        kind = "<u2" if exact_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
        for b in batches:
            for i in range(0, b.num_rows, 512):
                piece = b.slice(i, 512)
                ids = [encode(x or "", path, ranks, pattern) + [end] for x in piece.column(1).to_pylist()]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch([piece.column(0), pa.array([np.array(x, kind).tobytes() for x in ids], pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n)], names=["doc_id", "ids", "part", "before", "n"])

    return stored(id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, part int, before long, n long"), "tokens")


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (if with_ids)."""
    tokens = tokenized(docs, path, ranks, pattern)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each task of pass one: a few MB even for a million tasks.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("at"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches):
        for b in batches:
            rows: list[tuple] = []
            lists: list[np.ndarray] = []
            for doc, data, n, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    rows.append((doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, sequence, offset))
                    if with_ids:
                        lists.append(ids[start : start + size].astype(np.int32))
                    start += size
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            yield pa.record_batch(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=names)

    return placed.mapInArrow(cut, schema)
