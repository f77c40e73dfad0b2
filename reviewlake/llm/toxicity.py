"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms, each hashed to one of 2^BITS places. The score is the logistic function of w0 + sum w_i +
sum over pairs <v_i, v_j>: a pair of terms (an insult and whom it is aimed at) can weigh more than both alone.

Training goes over all rows at once (proximal gradient steps). Weights w pay an L1 price of the size that chance gives a
sum of residuals over a place's texts, and are then fitted again without most of it. Factors v are learned for every place
whose gradient on all pairs is larger than chance, whether or not its term tells anything alone, and for those with a
weight; so pairs of terms that tell nothing each are learned too. Places in under MIN_DOCS training texts can't be learned from and weigh nothing.

The model is fitted on a bounded sample: at most MAX_TRAIN labelled documents that are not held out, in the order of a hash of
the id, with at most MAX_TERMS distinct terms in all. Its size is fixed by BITS and RANK. Scoring is narrow and covers every whole text.

Cases: a null or empty text scores as one without terms; a null doc_id is never held out and never trained on; a doc_id
labelled twice counts as toxic if any label says so, and one with several rows is learned from once (its smallest text); no
labels at all: every score is 0; repeated rows give repeated results; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from reviewlake.llm.common import id_and_text, stored

#: The sample to learn from: labelled documents and their distinct terms in all.
MAX_TRAIN, MAX_TERMS = 20_000, 8_000_000
BITS, RANK, MIN_DOCS = 18, 8, 5
#: Training: prices of w and v in units of chance, what is left of w's in the second fit, decay of v, steps.
PRICE, PAIR_PRICE, LEFT, DECAY = 0.7, 1.5, 0.02, 0.1
STEPS, PAIR_ROUNDS, PAIR_STEPS = 150, 2, 100
#: Terms with a weight that a text is taken to hold at most, for the length of a step.
ACTIVE = 20.0
REJECT = 0.7
TERM = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


def place_of(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def places_of(text: str | None, known: dict[str, int]) -> list[int]:
    """The places of a text's terms, sorted; known is a cache that forgets all when it is full."""
    if len(known) > 500_000:
        known.clear()
    out = set()
    for t in terms(text):
        i = known.get(t)
        if i is None:
            i = known[t] = place_of(t)
        out.add(i)
    return sorted(out)


def held_out(doc_id):
    """Rows that no model may learn from: crc32 of the id's digits leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Machine:
    """w0, and for each of 2^BITS places its weight w and factors v."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        # What scoring adds up for a place: w, v and |v|^2.
        self.sums = np.concatenate([self.w[:, None], self.v, (self.v * self.v).sum(1, keepdims=True)], 1).astype(np.float32)

    def scores(self, texts: list[list[int]]) -> np.ndarray:
        """A score for each list of places."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter((i for t in texts for i in t), np.int64, int(n.sum()))
        total = np.zeros((len(texts), self.sums.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(self.sums[flat].astype(np.float64), (np.cumsum(n) - n)[some], axis=0)
        return logistic(self.w0 + total[:, 0] + 0.5 * ((total[:, 1:-1] ** 2).sum(1) - total[:, -1]))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def soft(x: np.ndarray, price: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - price, 0)


class Incidence:
    """Which of n columns each row holds, row by row; sums of values over a row's columns and over a column's rows."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int):
        self.row, self.col, self.rows, self.cols = row, col, rows, cols
        self.by_col = row[np.argsort(col, kind="stable")]
        n, m = np.bincount(row, minlength=rows), np.bincount(col, minlength=cols)
        self.some_rows, self.some_cols = np.flatnonzero(n), np.flatnonzero(m)
        self.row_starts, self.col_starts = (np.cumsum(n) - n)[self.some_rows], (np.cumsum(m) - m)[self.some_cols]

    def over_cols(self, values: np.ndarray) -> np.ndarray:
        return self._sums(values, self.col, self.row_starts, self.some_rows, self.rows)

    def over_rows(self, values: np.ndarray) -> np.ndarray:
        return self._sums(values, self.by_col, self.col_starts, self.some_cols, self.cols)

    def _sums(self, values: np.ndarray, at: np.ndarray, starts: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
        """One factor at a time, so that memory stays at a few numbers for each term of a text."""
        if values.ndim > 1:
            return np.stack([self._sums(x, at, starts, some, n) for x in values.T], 1)
        out = np.zeros(n)
        if len(at):
            out[some] = np.add.reduceat(values[at], starts)
        return out

    def only(self, cols: np.ndarray) -> Incidence:
        place = np.full(self.cols, -1, np.int32)
        place[cols] = np.arange(len(cols))
        col = place[self.col]
        return Incidence(self.row[col >= 0], col[col >= 0], self.rows, len(cols))

    def pairs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's sum of v, and of all products of two of its columns' v."""
        s = self.over_cols(v)
        return s, 0.5 * ((s * s).sum(1) - self.over_cols((v * v).sum(1)))


def train(places: np.ndarray, held: np.ndarray, y: np.ndarray, seed: int = 11) -> Machine:
    """places: those of all texts, one text after the other; held: how many each text has; y: 1.0 for toxic ones."""
    size, rng = 1 << BITS, np.random.default_rng(seed)
    n = np.bincount(places, minlength=size)
    used = np.flatnonzero(n >= MIN_DOCS)
    x = Incidence(np.repeat(np.arange(len(held), dtype=np.int32), held), places, len(held), size).only(used)
    n = n[used].astype(float)
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    w0, chance = float(np.log(p / (1 - p))), p * (1 - p) * 2 * np.log(max(len(used), 2))
    step, price = 4 / (ACTIVE * n), PRICE * np.sqrt(chance * n)

    w = np.zeros(len(used))
    for again in (False, True):
        price = np.where(w != 0, LEFT * price, np.inf) if again else price
        before = w.copy()
        for k in range(STEPS):
            ahead = w + k / (k + 3) * (w - before)
            g = logistic(w0 + x.over_cols(ahead)) - y
            w0 -= 4 * g.mean()
            before, w = w, soft(ahead - step * x.over_rows(g), step * price)

    v, free = rng.normal(0, 0.01, (len(used), RANK)), w != 0
    for _ in range(PAIR_ROUNDS):
        s, both = x.pairs(v)
        g = logistic(w0 + x.over_cols(w) + both) - y
        pull = x.over_rows(g[:, None] * s) - x.over_rows(g)[:, None] * v
        free |= (pull * pull).sum(1) > PAIR_PRICE**2 * chance * x.over_rows((s * s).sum(1)) + 1e-12
        at = np.flatnonzero(free)
        own, m = x.only(at), n[at]
        a, f = w[at], v[at]
        a_before, f_before = a.copy(), f.copy()
        for k in range(PAIR_STEPS):
            mo = k / (k + 3)
            a_ahead, f_ahead = a + mo * (a - a_before), f + mo * (f - f_before)
            s, both = own.pairs(f_ahead)
            g = logistic(w0 + own.over_cols(a_ahead) + both) - y
            w0 -= g.mean()
            total = own.over_rows(g)
            a_before, a = a, soft(a_ahead - 4 / (ACTIVE * m) * total, 4 / (ACTIVE * m) * LEFT * PRICE * np.sqrt(chance * m))
            f_before, f = f, f_ahead - (0.5 / m)[:, None] * (own.over_rows(g[:, None] * s) - total[:, None] * f_ahead + DECAY * f_ahead)
        w[at], v[at] = a, f
    v[~free] = 0
    weights, factors = np.zeros(size), np.zeros((size, RANK))
    weights[used], factors[used] = w, v
    return Machine(float(w0), weights, factors)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> Machine | None:
    """Learn labels.toxic from rows that aren't held out; None without any."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    sample = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def hashed(batches):
        known: dict[str, int] = {}
        for b in batches:
            found = [places_of(x, known) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2)], names=["doc_id", "places", "y"])

    # The sample has max_train rows of two numbers at most; a document with several rows is learned from once.
    texts = id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    seen = stored(texts.mapInArrow(hashed, "doc_id long, places array<int>, y int"), "labelled")
    # Two numbers a document tell how many of them, in the order of their hashes, stay within max_terms.
    order = seen.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.size("places").alias("n")).orderBy("h", "doc_id").toArrow()
    ids = np.array(order.column("doc_id").to_pylist(), np.int64)
    within = ids[np.cumsum(order.column("n").to_numpy()) <= max_terms] if len(ids) else ids
    if not len(within):
        return None
    kept = docs.sparkSession.createDataFrame([(int(i),) for i in within], "doc_id long")
    got = seen.join(F.broadcast(kept), "doc_id").toArrow().sort_by("doc_id")
    places = got.column("places").combine_chunks()
    return train(places.flatten().to_numpy(), np.diff(places.offsets.to_numpy()), got.column("y").to_numpy().astype(float))


def toxicity(docs: DataFrame, machine: Machine | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), and the columns named in keep."""

    def score(batches):
        known: dict[str, int] = {}
        for b in batches:
            out = np.zeros(b.num_rows)
            if machine:
                for i in range(0, b.num_rows, 256):
                    texts = [places_of(x, known) for x in b.column(1).slice(i, 256).to_pylist()]
                    out[i : i + len(texts)] = machine.scores(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), *(b.column(i) for i in range(2, b.num_columns))], names=["doc_id", "score", *keep])

    extra = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(docs[f"`{c}`"] for c in keep))
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *(extra.schema.fields[2 + i] for i in range(len(keep)))])
    return extra.mapInArrow(score, schema)
