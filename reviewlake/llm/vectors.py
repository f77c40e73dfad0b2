"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted by k-means on a bounded sample; their product is a
grid of cells, and every vector is filed in the cell of its nearest codewords. A query goes through cells by the
multi-sequence order (nearest sum of half distances first) for as many cells as a sample of queries needs to reach the
target recall, both on its links with all vectors (seen from the query's side) and on made neighbours at the threshold
(the farthest that link, so the number holds where the sample has no links); each query counts alike, and the result
carries the recall that was measured. There is no upper limit: all cells are all pairs. The members of those cells are then
compared in double precision.

The grid grows with the vectors (PER_CELL in a cell on average) up to MAX_CODES codewords a half, which is enough for ten thousand
million vectors; the codebooks are fitted on a sample of FIT_ROWS vectors, or PER_CODE for each codeword if that is more.

Equal vectors are one class, counted with its size. A pair that both sides visit is counted once for each side, a pair
that one side visits is counted for both there, so link numbers need no list of pairs; what leaves a task is a count a
vector and edges of a spanning forest. Crowded cells are cut into blocks of members and blocks of visitors.

Cases: null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of
each length link among themselves; repeated rows are vectors of their own (a repeated vec_id too: the rows count each other);
a null vec_id is counted by others and keeps a null component unless linked; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import stored
from reviewlake.llm.components import components

THRESHOLD = 0.95
#: Parameters of the index: vectors that a cell holds on average, vectors to fit codebooks on, queries to measure recall on.
PER_CELL, FIT_ROWS, RECALL_QUERIES = 48, 20_000, 1_500
#: Made neighbours of a query to measure recall on.
NEIGHBOURS = 4
TILE = 2_048
#: Codewords of a half at most; sampled vectors for each.
MAX_CODES, PER_CODE = 16_384, 8


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    codes = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, codes)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes[n > 0] = total[n > 0] / n[n > 0, None]
    return codes


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :], 0)


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The nearest code of each row, some rows at a time."""
    step = max(1, (1 << 22) // max(1, len(codes)))
    return np.concatenate([distances(x[i : i + step], codes).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def multi_sequence(first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """For each row of two tables of distances the cells (i * width + j) with the smallest first[i] + second[j], nearest first.

    In the order of their distances the k-th pair can only be one of those (i, j) with (i + 1) (j + 1) <= k, since every pair
    of an earlier i and j comes before it; so only these are summed up and sorted.
    """
    width = second.shape[1]
    cells = min(cells, first.shape[1] * width)
    i = np.repeat(np.arange(min(cells, first.shape[1])), [min(cells // (k + 1), width) for k in range(min(cells, first.shape[1]))])
    starts = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
    j = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    out = np.empty((len(first), cells), np.int64)
    step = max(1, (1 << 21) // len(i))
    for lo in range(0, len(first), step):
        a, b = (np.argsort(x[lo : lo + step], axis=1, kind="stable") for x in (first, second))
        rows = np.arange(len(a))[:, None]
        sums = np.take_along_axis(first[lo : lo + step], a, 1)[:, i] + np.take_along_axis(second[lo : lo + step], b, 1)[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, :cells]
        out[lo : lo + step] = a[rows, i[order]] * width + b[rows, j[order]]
    return out


def listed(column, dim: int) -> np.ndarray:
    """An Arrow column of lists of dim numbers as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def classes_of(vectors: DataFrame) -> DataFrame:
    """id, copies, vec (float64 bytes) of each distinct usable vector; id is its smallest vec_id."""
    e = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    flat = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, e).alias("e"))
    return flat.where("e is not null").groupBy("e").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min(F.xxhash64("e")).alias("h"))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept, measured_recall: one row a vector.

    Vectors of each length have codebooks and an index of their own, since a cosine needs equal lengths; a table is expected to have
    few lengths. Recall is measured on a sample and aimed at target_recall; measured_recall (the least of the measures) is the
    same in all rows of a length.
    """
    n = F.coalesce(F.when(F.size("embedding") > 0, F.size("embedding")), F.lit(0))
    lengths = sorted(r.n for r in vectors.select(n.alias("n")).distinct().collect())
    if len(lengths) < 2:
        return link_equally_long(vectors, threshold, target_recall)
    return reduce(DataFrame.unionByName, (link_equally_long(vectors.where(n == k), threshold, target_recall) for k in lengths))


def link_equally_long(vectors: DataFrame, threshold: float, target_recall: float) -> DataFrame:
    """link_vectors of vectors of one length; null and empty ones are a length as well."""
    classes = stored(classes_of(vectors), "classes")
    lengths = classes.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    flat = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    if lengths is None:
        return flat.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("measured_recall"))
    dim, n = lengths["n"], lengths["count"]
    usable = classes.where(F.size("e") == dim).withColumn("node", F.monotonically_increasing_id())
    k = int(min(MAX_CODES, max(2, round((n / PER_CELL) ** 0.5))))
    # A sample of bounded size, as one Arrow table: 67 MB of 64 dimensions at MAX_CODES.
    order = usable.select("e", "h").orderBy("h", "e").limit(max(FIT_ROWS, PER_CODE * k) + RECALL_QUERIES)
    drawn = unit(listed(order.select("e").toArrow().column("e"), dim))
    # Queries are not fitted on, where there are enough vectors: what codebooks have seen lies nearer to its codewords.
    held = min(RECALL_QUERIES, len(drawn) // 4)
    queries, fit = (drawn[:held], drawn[held:]) if held else (drawn, drawn)
    half = max(1, dim // 2)
    codes = [k_means(fit[:, :half], min(k, len(fit))), k_means(fit[:, half:], min(k, len(fit)))] if dim > 1 else [k_means(fit, min(k, len(fit))), np.zeros((1, 0))]

    width = len(codes[1])

    def filed(x: np.ndarray) -> np.ndarray:
        return nearest(x[:, :half], codes[0]) * width + nearest(x[:, half:], codes[1])

    visits, recalls = visits_for_recall(usable, queries, codes, half, filed, threshold, target_recall)
    logging.getLogger(__name__).info("cells visited: %d of %d; measured recall: %s", visits, len(codes[0]) * width, recalls)

    def index(batches):
        for b in batches:
            for i in range(0, len(b), 1_000):
                part = b.iloc[i : i + 1_000]
                x = unit(np.array(part["e"].tolist(), float))
                a, c = distances(x[:, :half], codes[0]), distances(x[:, half:], codes[1])
                yield pd.DataFrame({"node": part["node"].to_numpy(), "copies": part["copies"].to_numpy(), "vec": [r.tobytes() for r in x], "home": a.argmin(1) * width + c.argmin(1), "visits": list(multi_sequence(a, c, visits))})

    usable = stored(usable, "vectors")
    indexed = stored(usable.select("node", "copies", "e").mapInPandas(index, "node long, copies long, vec binary, home long, visits array<long>"), "indexed")
    # A cell's numbers of members and visitors give its blocks; there are no more cells than codebooks allow.
    visiting = indexed.select("node", "copies", "vec", "home", F.explode("visits").alias("cell"), "visits")
    cells = indexed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).join(visiting.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("shares")), "cell")
    cells = stored(cells, "cells")
    mix = F.xxhash64("node")
    members = indexed.withColumnRenamed("home", "cell").join(cells, "cell").select("cell", F.pmod(mix, F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(True).alias("member"), "node", "copies", "vec", F.col("cell").alias("home"), "visits")
    visitors = visiting.join(cells, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(mix, F.col("shares")).cast("int").alias("share"), F.lit(False).alias("member"), "node", "copies", "vec", "home", F.lit(None).cast("array<long>").alias("visits"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        inside = rows["member"].to_numpy()
        m, v = rows[inside], rows[~inside]
        if not len(m) or not len(v):
            return pd.DataFrame({"node": [], "links": [], "other": []})
        m_node, v_node = m["node"].to_numpy(), v["node"].to_numpy()
        m_copies, v_copies, v_home = m["copies"].to_numpy(), v["copies"].to_numpy(), v["home"].to_numpy()
        m_links, v_links = np.zeros(len(m), np.int64), np.zeros(len(v), np.int64)
        hit = (matrix(v["vec"]) @ matrix(m["vec"]).T >= threshold) & (v_node[:, None] != m_node[None, :])
        a, b = np.nonzero(hit)
        np.add.at(v_links, a, m_copies[b])
        # A visitor whose home a member visits too is counted there by the member.
        homes, home_of = np.unique(v_home, return_inverse=True)
        seen = np.concatenate(m["visits"].tolist())
        at = np.minimum(np.searchsorted(homes, seen), len(homes) - 1)
        known = homes[at] == seen
        meets = np.zeros((len(m), len(homes)), bool)
        meets[np.repeat(np.arange(len(m)), [len(x) for x in m["visits"]])[known], at[known]] = True
        m_links += ((hit & ~meets[:, home_of].T) * v_copies[:, None]).sum(0)
        ends = forest(v_node[a], m_node[b])
        out = pd.concat([pd.DataFrame({"node": v_node, "links": v_links}), pd.DataFrame({"node": m_node, "links": m_links})])
        out = out[out["links"] > 0].assign(other=pd.NA)
        return pd.concat([out, pd.DataFrame({"node": ends[0], "links": 0, "other": ends[1]})]).astype({"node": "int64", "links": "int64", "other": "Int64"})

    found = stored(members.unionByName(visitors).groupBy("cell", "part", "share").applyInPandas(compare, "node long, links long, other long"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = usable.join(counts, "node", "left").join(nodes, "node", "left").select("e", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = stored(known, "known")
    heads = known.groupBy("component").agg(F.min("first").alias("head"))
    result = known.join(heads, "component").select("e", F.col("n_links").alias("found"), "head")
    out = flat.join(result, "e", "left").select("vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), F.coalesce("head", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("measured_recall", F.lit(float(min(recalls.values()))))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the given edges."""
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out[0].append(x)
            out[1].append(y)
    return out


def cell_rank(first: np.ndarray, second: np.ndarray, i: int, j: int) -> int:
    """How many cells a query goes through by the multi-sequence order until it has seen cell (i, j); ties count in full."""
    rest = first[i] + second[j] - first
    rest[i] = second[j]
    return int(np.searchsorted(np.sort(second), rest, side="right").sum())


def made_neighbours(x: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """A unit vector at the given cosine from each unit vector, in a random direction."""
    r = np.random.default_rng(seed).normal(size=x.shape)
    r -= (r * x).sum(1)[:, None] * x
    size = np.linalg.norm(r, axis=1, keepdims=True)
    return unit(cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * r / np.where(size > 0, size, 1)) if x.shape[1] > 1 else x


def visits_for_recall(usable: DataFrame, queries: np.ndarray, codes, half: int, filed, threshold: float, target: float) -> tuple[int, dict[str, float]]:
    """Cells that a query has to visit so that the sampled queries meet the target share, and the share they then meet of
    made neighbours at the threshold and, where the sample has any, of their links in all vectors; queries count alike."""
    cells, width = len(codes[0]) * len(codes[1]), len(codes[1])

    def half_distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, :half], codes[0]), distances(x[:, half:], codes[1])

    a, c = half_distances(queries)

    def ranks(batches):
        known: dict[tuple[int, int], int] = {}
        for b in batches:
            n: dict[tuple[int, int], int] = {}
            for i in range(0, len(b), 2_000):
                x = unit(np.array(b["e"].iloc[i : i + 2_000].tolist(), float))
                q, y = np.nonzero(queries @ x.T >= threshold)
                other = (queries[q] != x[y]).any(1)
                pairs, times = np.unique(np.stack([q[other], filed(x)[y[other]]], 1), axis=0, return_counts=True)
                for (i_, cell), k in zip(pairs.tolist(), times.tolist(), strict=True):
                    if (i_, cell) not in known:
                        known[i_, cell] = cell_rank(a[i_], c[i_], *divmod(cell, width))
                    n[i_, known[i_, cell]] = n.get((i_, known[i_, cell]), 0) + k
            yield pd.DataFrame([(*x, k) for x, k in n.items()], columns=["query", "rank", "n"]).astype("int64")

    seen = stored(usable.select("e").mapInPandas(ranks, "query long, rank long, n long").groupBy("query", "rank").agg(F.sum("n").alias("n")), "ranks")
    # One row for each of RECALL_QUERIES queries at most.
    totals = seen.groupBy("query").agg(F.sum("n").alias("total"))
    linked = seen.join(F.broadcast(totals), "query").groupBy("rank").agg(F.sum(F.col("n") / F.col("total")).alias("share")).collect()

    near = [made_neighbours(queries, threshold, seed) for seed in range(NEIGHBOURS)]
    made = []
    for x in near:
        # A pair is found if either side visits the other's cell.
        b, d = half_distances(x)
        ends = zip(a, c, a.argmin(1), c.argmin(1), b, d, b.argmin(1), d.argmin(1), strict=True)
        made += [min(cell_rank(p, q, k, m), cell_rank(r, s, i, j)) for p, q, i, j, r, s, k, m in ends]
    measured = {"made": (np.array(made), np.ones(len(made)))}
    if linked:
        measured["linked"] = (np.array([r["rank"] for r in linked]), np.array([r["share"] for r in linked]))
    visits = 4
    for rank, share in measured.values():
        order = np.argsort(rank)
        met = np.cumsum(share[order])
        visits = max(visits, int(rank[order][np.flatnonzero(met >= target * met[-1])[0]]))
    visits = min(cells, visits)
    return visits, {name: float(share[rank <= visits].sum() / share.sum()) for name, (rank, share) in measured.items()}
