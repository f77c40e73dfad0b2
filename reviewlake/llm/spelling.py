"""Spelling variants: words at edit distance one, found by search schemes on bidirectional FM-indexes.

Of two words that differ by one code point, one half is the same: the first m // 2 code points of a word of m, or the rest.
So every word of the vocabulary goes, as a text, to the shards of its possible halves, and as a query to those of its own two
halves. A shard concatenates its texts, `$` before each, sorts the rotations forwards and backwards, and keeps both ranges of
suffix ranks in step. A query matches one half exactly, with the `$` at its end, then turns and extends across the other half and
its `$` with one insertion, deletion or replacement. All queries of one length advance together, a symbol at a time.

What two schemes both find counts once: the second leaves out texts that begin with the query's first half. Each shard sums up
a query's near words (number, largest n, its smallest word), so no pairs leave it; Spark merges the rows of a query. A half
is seldom shared by many words, since it grows with the word; shards of over SHARD texts are split by a hash of the text all the
same, and their queries go to each part. A shard's memory is about 4 bytes for each of its code points and distinct symbols.

Cases: a null or empty text has no words; a null doc_id counts as an empty one in the hash of a run; repeated rows count each; an empty
table gives an empty result; a tie of the largest n goes to the smallest word; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import id_and_text, stored

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
SLIP = 199
#: Texts of a shard, and the largest table of ranks that keeps every row.
SHARD, WHOLE_TABLE = 20_000, 32 << 20


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, one in `slip` without a code point; built-in expressions only."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A run under the least length can't become a word: a slip makes it shorter still.
    runs = id_and_text(docs).select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(h % slip == 0, short).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Ranks:
    """Below(i, c): how many of the first i symbols of a rotated text are smaller than c. Every `step`-th row is kept."""

    def __init__(self, last: np.ndarray, symbols: int):
        n = len(last)
        self.step = 1
        while (n // self.step + 2) * (symbols + 1) * 4 > WHOLE_TABLE:
            self.step *= 2
        self.last = np.append(last, np.full(self.step, symbols, last.dtype))
        self.symbols = symbols
        rows = n // self.step + 1
        table = np.zeros((rows, symbols + 1), np.int32)
        for c in range(symbols):  # symbol by symbol, so that no one-hot copy of the text is made
            table[:, c + 1] = np.concatenate([[0], np.cumsum(last == c, dtype=np.int32)])[: rows * self.step : self.step]
        self.table = np.cumsum(table, axis=1, dtype=np.int32)

    def below(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        block, rest = np.divmod(i, self.step)
        found = self.table[block, c]
        for k in range(self.step - 1):
            found = found + ((k < rest) & (self.last[block * self.step + k] < c))
        return found

    def all_below(self, i: np.ndarray) -> np.ndarray:
        """A row for each i, a column for each c from 0 to the number of symbols."""
        block, rest = np.divmod(i, self.step)
        found = self.table[block]
        c = np.arange(self.symbols + 1)
        for k in range(self.step - 1):
            found = found + ((k < rest) & True)[:, None] * (self.last[block * self.step + k][:, None] < c)
        return found


def rotations(text: np.ndarray) -> np.ndarray:
    """The starts of a text's rotations in sorted order, by doubling. The text is no repetition of a shorter one."""
    n = len(text)
    rank, width = text.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1 or width >= 2 * n:
            return order


class Index:
    """A bidirectional FM-index over distinct words, each after a `$`. LEFT and RIGHT are the directions of an extension.

    A state is three arrays: the first rank among the forward rotations, that among the backward ones, and the number of ranks.
    """

    LEFT, RIGHT = 0, 1

    def __init__(self, words: list[str]):
        codes = np.array(sorted(set("".join(words))), dtype=str)
        self.code = {c: k + 1 for k, c in enumerate(codes.tolist())}  # 0 is the delimiter
        self.symbols = len(self.code) + 1
        text = np.frombuffer("\0".join(["", *words]).encode("utf-32-le"), np.uint32)
        points = np.array([0, *map(ord, codes.tolist())], np.uint32)
        coded = np.searchsorted(points, text).astype(np.int16)
        self.size = len(coded)
        self.firsts = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=self.symbols))])
        order = rotations(coded)
        starts = np.flatnonzero(coded == 0)
        # The first ranks are those of the rotations that begin with a delimiter: the word behind each.
        self.word_at = np.searchsorted(starts, order[: len(words)])
        back = coded[::-1]
        self.ranks = [Ranks(coded[order - 1], self.symbols), Ranks(back[rotations(back) - 1], self.symbols)]

    def encoded(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of symbols; -1 is a symbol that no text has."""
        return np.array([[self.code.get(c, -1) for c in w] for w in words], np.int64).reshape(len(words), -1)

    def everything(self, n: int) -> tuple[np.ndarray, ...]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)

    def extend(self, state, c: np.ndarray, side: int):
        """The state with one more symbol at a side; its size is 0 where no text has that."""
        own, other, size = (state[0], state[1], state[2]) if side == self.LEFT else (state[1], state[0], state[2])
        ranks, known = self.ranks[side], np.maximum(c, 0)
        low, low_next = ranks.below(own, known), ranks.below(own, known + 1)
        high, high_next = ranks.below(own + size, known), ranks.below(own + size, known + 1)
        new_own = self.firsts[known] + low_next - low
        new_size = np.where(c < 0, 0, (high_next - high) - (low_next - low)).astype(np.int64)
        new_other = other + high - low
        return (new_own, new_other, new_size) if side == self.LEFT else (new_other, new_own, new_size)

    def branches(self, state, side: int):
        """All extensions by a symbol but the delimiter: the row of the state each comes from, the symbol, the states."""
        own, other, size = (state[0], state[1], state[2]) if side == self.LEFT else (state[1], state[0], state[2])
        low, high = self.ranks[side].all_below(own), self.ranks[side].all_below(own + size)
        sizes = np.diff(high, axis=1) - np.diff(low, axis=1)
        row, c = np.nonzero(sizes[:, 1:])
        c = c + 1
        new_own = self.firsts[c] + low[row, c + 1] - low[row, c]
        new_other = other[row] + high[row, c] - low[row, c]
        new_size = sizes[row, c].astype(np.int64)
        return row, c, (new_own, new_other, new_size) if side == self.LEFT else (new_other, new_own, new_size)

    def near(self, queries: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of queries, number of the word) one edit apart, where the edit is in the half at `side`, its delimiter included.

        The other half is matched first, from its inner end to its delimiter; the way back across the first one has the edit.
        """
        n, m = queries.shape
        a = m // 2
        delimiter = np.zeros((n, 1), np.int64)
        if side == self.RIGHT:
            exact, rest = np.hstack([queries[:, :a][:, ::-1], delimiter]), np.hstack([queries[:, a:], delimiter])
        else:
            exact, rest = np.hstack([queries[:, a:], delimiter]), np.hstack([queries[:, :a][:, ::-1], delimiter])
        which, state = np.arange(n), self.everything(n)
        for k in range(exact.shape[1]):
            which, state = self.alive(which, self.extend(state, exact[which, k], 1 - side))
        end = rest.shape[1]
        found_q, found_w = [], []
        # One edit made: the query, how far it is matched, the state.
        edited = (np.empty(0, np.int64), np.empty(0, np.int64), self.everything(0))
        for k in range(end + 1):
            q, at, s = edited
            (q, at), s = self.alive((q, at + 1), self.extend(s, rest[q, at], side))
            done = at == end
            found_q.append(q[done])
            found_w.append(self.word_at[s[0][done]])
            q, at, s = q[~done], at[~done], tuple(x[~done] for x in s)
            if k < end and len(which):
                row, c, t = self.branches(state, side)
                extra = which[row], np.full(len(row), k), t
                changed = (rest[which[row], k] != c) & (k < end - 1)
                other = which[row][changed], np.full(int(changed.sum()), k + 1), tuple(x[changed] for x in t)
                lost = (which, np.full(len(which), k + 1), state) if k < end - 1 else (which[:0], which[:0], tuple(x[:0] for x in state))
                q, at = (np.concatenate([x, *y]) for x, y in ((q, (extra[0], other[0], lost[0])), (at, (extra[1], other[1], lost[1]))))
                s = tuple(np.concatenate(x) for x in zip(s, t, other[2], lost[2], strict=True))
                which, state = self.alive(which, self.extend(state, rest[which, k], side))
            edited = q, at, s
        # Edits at different places may give the same text.
        pairs = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_w)]), axis=1)
        return pairs[0], pairs[1]

    @staticmethod
    def alive(rows, state):
        ok = state[2] > 0
        kept = tuple(x[ok] for x in rows) if isinstance(rows, tuple) else rows[ok]
        return kept, tuple(x[ok] for x in state)


def near_words(texts: list[str], counts: np.ndarray, queries: list[str], side: int) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """For each query the number of near texts with the edit at side, the largest count of one, and the smallest word that has it."""
    n_near, most, form = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), [None] * len(queries)
    if not texts:
        return n_near, most, form
    index = Index(texts)
    lengths = np.array([len(q) for q in queries])
    for m in np.unique(lengths):
        for rows in np.array_split(same := np.flatnonzero(lengths == m), len(same) // 4096 + 1):
            q, w = index.near(index.encoded([queries[i] for i in rows]), side)
            q = rows[q]
            for i, k in zip(q.tolist(), w.tolist(), strict=True):
                text, query = texts[k], queries[i]
                if text == query or (side == Index.LEFT and text.startswith(query[: m // 2])):
                    continue
                n_near[i] += 1
                if counts[k] > most[i] or (counts[k] == most[i] and text < form[i]):
                    most[i], form[i] = counts[k], text
    return n_near, most, form


def halves(word: Column, length: Column, side: int) -> Column:
    """The half of a word at the side away from the edit, as a query of that length has it."""
    return F.substring(word, F.lit(1), F.floor(length / 2).cast("int")) if side == Index.RIGHT else F.substring(word, -F.ceil(length / 2).cast("int"), F.ceil(length / 2).cast("int"))


def sharded(words: DataFrame, shards: int) -> DataFrame:
    """side, shard, word, n, is_text, is_query: each word once in a shard."""
    m = F.char_length("word")
    rows = []
    for side in (Index.LEFT, Index.RIGHT):
        text = F.array_distinct(F.transform(F.array(m - 1, m, m + 1), lambda x: halves(F.col("word"), x, side)))
        own = halves(F.col("word"), m, side)
        each = words.select("word", "n", own.alias("own"), F.explode(text).alias("half"))
        shard = F.pmod(F.xxhash64(F.lit(side), "half"), F.lit(shards))
        rows.append(each.groupBy("word", "n", shard.alias("shard")).agg(F.bool_or(F.col("half") == F.col("own")).alias("is_query")).withColumn("side", F.lit(side)))
    return rows[0].unionByName(rows[1])


def variants(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, n_near, form, form_n of each word (word, n); form and form_n are those of its near word of the largest n, whatever that is."""
    words = stored(words, "words")
    shards = max(1, math.ceil(words.count() / shard))
    dealt = stored(sharded(words, shards), "dealt")
    # One row a shard: the vocabulary divided by SHARD.
    parts = dealt.groupBy("side", "shard").agg(F.ceil(F.count("*") / (4 * shard)).cast("int").alias("parts"))
    rows = dealt.join(F.broadcast(parts), ["side", "shard"])
    part = F.pmod(F.xxhash64("word", F.lit(7)), "parts").cast("int")
    texts = rows.select("side", "shard", part.alias("part"), "word", "n", F.lit(True).alias("is_text"))
    asked = rows.where("is_query").select("side", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "word", "n", F.lit(False).alias("is_text"))
    schema = "word string, n_near long, most long, form string"

    def search(key, group):
        text = group.filter(group["is_text"])
        asks = group.filter(pa.compute.invert(group["is_text"]))["word"].to_pylist()
        found = near_words(text["word"].to_pylist(), text["n"].to_numpy(), asks, key[0].as_py())
        return pa.table([pa.array(asks, pa.string()), *map(pa.array, found[:2]), pa.array(found[2], pa.string())], names=["word", "n_near", "most", "form"]).filter(pa.array(found[0] > 0))

    # A shard is seconds of work on little data: a fixed number of tasks, which Spark doesn't merge by size.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = texts.unionByName(asked).repartition(tasks, "side", "shard", "part")
    found = each.groupBy("side", "shard", "part").applyInArrow(search, schema)
    # Largest n first, then the smallest word: of structs, the smallest.
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("less"), "form")).alias("best"))
    near = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root: the end of the chain of forms. n rises RATIO-fold at each step, so chains are short; pointers double them."""
    ends = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = ends.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        moved = ends.join(up, "root", "left")
        if not moved.where("higher is not null").head(1):
            break
        ends = stored(moved.select("word", F.coalesce("higher", "root").alias("root")), "roots")
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n: the form of a word is the commonest near one, if that has `ratio` times its n or more."""
    rows = variants(counted_words(docs, min_length, min_count, slip), shard)
    higher = F.col("form_n") >= ratio * F.col("n")
    forms = rows.select("word", F.when(higher, F.col("form")).alias("form"), "n", "n_near", F.when(higher, F.col("form_n")).alias("form_n"))
    return with_roots(stored(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
