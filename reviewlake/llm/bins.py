"""Best-fit packing: a grouping genetic algorithm, its bins as genes, on islands with elite migration.

A document longer than a sequence is cut into whole sequences and one shorter first piece, so only first pieces have to be
packed. They are dealt by hash to blocks of about BLOCK pieces. A block is a packing problem of its own, on several islands:
each island is a row with its own population, starting from best-fit decreasing on sizes blurred at random. A crossing takes
whole well-filled bins of one parent into the other, dissolves the bins there that hold a piece twice, and lets
larger displaced pieces take the place of smaller ones that leave room, and gives the rest to the bins where they fit best. After each epoch an island's elite goes to the next island of its block, by a
join; blocks that reach their lower bound stop. Then the pieces of badly filled bins of all blocks are dealt to new blocks and
packed again, as long as that saves bins, so blocks don't each leave a bin half empty.

Nothing but sizes and row numbers is shuffled. A block has about BLOCK pieces at any size of the input: they are dealt by a hash
of their row, not of their text. Every epoch's state is written, so lost executors cost an epoch at most.

Cases: a null or empty text is the end id alone; a text of a multiple of the length has whole pieces only; repeated rows are
packed each; a null doc_id is packed like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_right, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import id_and_text, stored
from reviewlake.llm.packing import LENGTH, encode

END = 0
#: Pieces of a block, islands of a block, individuals of an island, epochs between which elites move, crossings of an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, CROSSINGS = 2048, 3, 6, 3, 30
#: Bins filled to less than this part are packed again, in so many rounds at most.
LOOSE, ROUNDS = 0.97, 4
PIECES = "part int, row long, doc_id long, piece int, start long, length long, ids_crc32 long, n_full long"
STATE = "block long, island int, sizes array<int>, people array<array<int>>, elite array<int>, bins int, bound int"


def pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """PIECES: each document's pieces, numbered by task (part) and row; n_full counts the task's whole pieces before one. Written once."""
    schema = PIECES + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        part, row, full = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows, lists = [], []
                for doc, text in zip(*(b.slice(i, 512).column(k).to_pylist() for k in (0, 1)), strict=True):
                    ids = np.array([*encode(text or "", path, ranks, pattern), end], "<u4")
                    start, piece = 0, 0
                    while start < len(ids):
                        size = (len(ids) - start - 1) % length + 1 if piece == 0 else length
                        rows.append((part, row, doc, piece, start, size, zlib.crc32(ids[start : start + size].tobytes()), full))
                        if with_ids:
                            lists.append(ids[start : start + size].astype(np.int32))
                        full += size == length
                        start, piece = start + size, piece + 1
                    row += 1
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], t) for t in KINDS]
                yield pa.record_batch(columns + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=names)

    return stored(id_and_text(docs).mapInArrow(run, schema), "pieces")


KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def best_fit(order, sizes: list[int], bins: np.ndarray, loads: list[int], length: int) -> list[int]:
    """Puts the pieces in their order into the bin that each fills best, a new one where none has room; bins and loads are changed.

    Bins are looked up by the room they have: a bit for each amount of room that some bin has.
    """
    at: dict[int, list[int]] = {}
    for k, load in enumerate(loads):
        at.setdefault(length - load, []).append(k)
    rooms = 0
    for room in at:
        rooms |= 1 << room
    for i in order:
        s = sizes[i]
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            same = at[room]
            k = same.pop()
            if not same:
                rooms ^= 1 << room
        else:
            k, room = len(loads), length
            loads.append(0)
        bins[i] = k
        loads[k] += s
        room -= s
        at.setdefault(room, []).append(k)
        rooms |= 1 << room
    return loads


def fitness(bins: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """Smaller is better: bins used, then how evenly they are filled."""
    loads = np.bincount(bins, sizes) if len(bins) else np.zeros(0)
    return len(loads), -int((loads * loads).sum())


def newcomer(sizes: np.ndarray, length: int, blur: float, chance: random.Random) -> np.ndarray:
    """Best-fit decreasing on sizes blurred by up to a part of themselves."""
    seen = sizes.tolist()
    order = sorted(range(len(seen)), key=lambda i: -seen[i] * (1 + blur * (chance.random() - 0.5)))
    bins = np.zeros(len(seen), np.int32)
    best_fit(order, seen, bins, [], length)
    return bins


def crossed(mother: np.ndarray, father: np.ndarray, sizes: np.ndarray, length: int, chance: random.Random) -> np.ndarray:
    """The mother's packing with about half of the father's well-filled bins."""
    loads = np.bincount(father, sizes)
    good = np.flatnonzero(loads >= loads.mean())
    taken = np.zeros(len(loads), bool)
    taken[[k for k in good if chance.random() < 0.5]] = True
    own_loads = np.bincount(mother, sizes)
    broken = np.zeros(len(own_loads), bool)
    broken[mother[taken[father]]] = True
    # Besides, the emptiest bin and one at random: so a child can have fewer bins, and differs from its parents.
    broken[[int(np.argmin(own_loads)), chance.randrange(len(broken))]] = True
    here = ~broken[mother] & ~taken[father]
    numbers = np.cumsum(~broken) - 1
    further = np.cumsum(taken) - 1 + int((~broken).sum())
    bins = np.where(taken[father], further[father], numbers[mother]).astype(np.int32)
    left = [*own_loads[~broken].astype(int).tolist(), *loads[taken].astype(int).tolist()]
    seen = sizes.tolist()
    out = ~here & ~taken[father]
    displaced = swapped(np.flatnonzero(~out), np.flatnonzero(out), seen, bins, left, length)
    best_fit(displaced[::-1], seen, bins, left, length)
    return bins


def swapped(placed: np.ndarray, displaced: np.ndarray, sizes: list[int], bins: np.ndarray, loads: list[int], length: int) -> list[int]:
    """Displaced pieces, smallest first, after each placed one gave way to a larger displaced one that fits in its place better."""
    waiting = sorted((sizes[i], i) for i in displaced.tolist())
    for i in placed.tolist():
        k, s = bins[i], sizes[i]
        room = length - loads[k]
        at = bisect_right(waiting, (s + room, len(sizes))) - 1
        if room and at >= 0 and waiting[at][0] > s:
            d, j = waiting.pop(at)
            insort(waiting, (s, i))
            bins[j] = k
            loads[k] += d - s
    return [i for _, i in waiting]


def lower_bound(sizes: np.ndarray, length: int) -> int:
    return max(math.ceil(int(sizes.sum()) / length), int((2 * sizes > length).sum()))


def evolve(sizes: np.ndarray, people: list[np.ndarray], seed: int, length: int, crossings: int = CROSSINGS) -> list[np.ndarray]:
    """The population after so many crossings, best first. An empty one is founded; a crossing's child takes the place of the worst if it is better."""
    chance = random.Random(seed)
    bound = lower_bound(sizes, length)
    people = list(people)
    while len(people) < POPULATION:
        people.append(newcomer(sizes, length, 0.0 if not people else 0.3 * chance.random(), chance))
        if fitness(people[-1], sizes)[0] <= bound:
            break
    ranked = sorted(((fitness(p, sizes), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for n in range(crossings):
        if ranked[0][0][0] <= bound or len(ranked) < 2:
            break
        mother, father = (min(chance.sample(range(len(ranked)), 2)) for _ in "mf")
        child = crossed(ranked[mother][2], ranked[father][2], sizes, length, chance)
        told = fitness(child, sizes)
        if told < ranked[-1][0] and all(told != r[0] for r in ranked):
            ranked = sorted([*ranked[:-1], (told, len(people) + n, child)], key=lambda x: x[:2])
    return [r[2] for r in ranked]


def islands_of(state: DataFrame, epoch: int, length: int) -> DataFrame:
    """STATE after an epoch. state: block, island, sizes, people (null: none yet), guest (null: none)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                people = [np.array(p, np.int32) for p in r["people"] or []]
                if r["guest"] is not None and people:
                    people[-1 if len(people) >= POPULATION else len(people) :] = [np.array(r["guest"], np.int32)]
                people = evolve(sizes, people, hash((r["block"], r["island"], epoch)), length)
                row = (r["block"], r["island"], r["sizes"], [p.tolist() for p in people], people[0].tolist(), fitness(people[0], sizes)[0], lower_bound(sizes, length))
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], schema=ARROW)

    # An island is up to a second of work on a few kB: a fixed number of tasks, which Spark doesn't merge by size.
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(state.repartition(tasks, "block", "island").mapInArrow(run, STATE), "islands")


NAMES = [x.split()[0] for x in STATE.split(", ")]
ARROW = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("people", pa.list_(pa.list_(pa.int32()))), ("elite", pa.list_(pa.int32())), ("bins", pa.int32()), ("bound", pa.int32())])


def evolved(problems: DataFrame, length: int) -> DataFrame:
    """block, best: the bin of each piece in the block's order. problems: block, items (array of structs with size)."""
    sizes = F.transform("items", lambda i: i["size"].cast("int"))
    first = problems.select("block", sizes.alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    # What is at its bound after best-fit decreasing needs one island only: the others begin where it is not.
    nobody, no_guest = F.lit(None).cast("array<array<int>>").alias("people"), F.lit(None).cast("array<int>").alias("guest")
    alone = islands_of(first.where("island = 0").select("block", "island", "sizes", nobody, no_guest), 0, length)
    ends = [alone]
    hard = alone.where("bins > bound").select("block")
    others = first.where("island > 0").join(hard, "block", "left_semi").select("block", "island", "sizes", nobody, no_guest)
    state = stored(alone.where("bins > bound").unionByName(islands_of(others, 0, length)), "islands")
    for epoch in range(1, EPOCHS):
        ends.append(state)
        done = state.groupBy("block").agg(F.min(F.col("bins") - F.col("bound")).alias("over")).where("over > 0").select("block")
        left = state.join(done, "block", "left_semi")
        if not left.head(1):
            break
        guests = left.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
        state = islands_of(left.join(guests, ["block", "island"]).select("block", "island", "sizes", "people", "guest"), epoch, length)
    ends.append(state)
    every = [e.select("block", "bins", "island", "elite") for e in ends]
    whole = every[0]
    for e in every[1:]:
        whole = whole.unionByName(e)
    return whole.groupBy("block").agg(F.min_by("elite", F.struct("bins", "island")).alias("best"))


def placed_pieces(open_pieces: DataFrame, length: int, turn: int = 0, block: int = BLOCK) -> DataFrame:
    """part, row, size, sequence_id, offset, load of the bin, after one dealing of pieces (part, row, size) to blocks. Written once."""
    n = open_pieces.count()
    blocks = max(1, math.ceil(n / block))
    dealt = open_pieces.withColumn("block", F.pmod(F.xxhash64("part", "row", F.lit(turn)), F.lit(blocks)))
    problems = stored(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("size", "part", "row"))).alias("items")), "problems")
    solved = problems.join(evolved(problems, length), "block")

    def place(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes, bins = np.array([i["size"] for i in r["items"]], np.int64), np.array(r["best"], np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                loads = np.bincount(bins, sizes).astype(np.int64)
                firsts = np.cumsum(loads) - loads
                offsets = np.empty(len(sizes), np.int64)
                offsets[order] = ends - sizes[order] - firsts[bins[order]]
                ids = ((r["block"] * ROUNDS + turn) << 24) + bins
                parts, rows = (pa.array([i[c] for i in r["items"]], t) for c, t in (("part", pa.int32()), ("row", pa.int64())))
                yield pa.record_batch([parts, rows, *map(pa.array, (sizes, ids, offsets, loads[bins]))], names=["part", "row", "size", "sequence_id", "offset", "load"])

    return stored(solved.mapInArrow(place, "part int, row long, size long, sequence_id long, offset long, load long"), "placed")


def first_pieces_packed(cut: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """part, row, sequence_id, offset of every piece shorter than a sequence."""
    last = placed_pieces(cut.where(F.col("length") < length).select("part", "row", F.col("length").alias("size")), length, 0, block)
    done: list[DataFrame] = []
    for turn in range(1, ROUNDS):
        loose = last.where(F.col("load") < LOOSE * length)
        used = bins_used(loose)
        if used < 2:
            break
        again = placed_pieces(loose.select("part", "row", "size"), length, turn, block)
        if bins_used(again) >= used:
            break  # nothing saved: the packing before stays
        done.append(last.where(F.col("load") >= LOOSE * length))
        last = again
    return reduce(DataFrame.unionByName, [*done, last]).select("part", "row", "sequence_id", "offset")


def bins_used(placed: DataFrame) -> int:
    return placed.where("offset = 0").count()


def pack_best_fit(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (if with_ids)."""
    cut = pieces(docs, path, ranks, pattern, length, end, with_ids)
    # A whole piece is a sequence of its own, with a number below zero: one for each task and its order there.
    own = -(F.col("part").cast("long") * F.lit(1 << 33) + F.col("n_full") + 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    whole = cut.where(F.col("length") == length).withColumn("sequence_id", own).withColumn("offset", F.lit(0).cast("long"))
    short = cut.where(F.col("length") < length).join(first_pieces_packed(cut, length, block), ["part", "row"])
    return whole.select(columns).unionByName(short.select(columns))
