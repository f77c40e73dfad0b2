"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its token share raised to an exponent, normalised. The exponent is bisected (an aggregate
query tries several at a time) to the largest that reaches a target entropy, and not below the smallest that keeps a
source's repetitions within a limit. Unless a budget is given, it is the smallest that uses every document once.

A source that owes r times its tokens goes through floor(r) whole permutations and part of one more. Documents are
dealt to blocks of about block_tokens by hash, blocks are permuted by hash anew in each epoch, and documents within
their block. The part takes blocks in the epoch's order while they fit; only the block on the boundary is cut by
document. Running sums over a source's blocks go in two levels: RANGES ranges of the order, then the blocks of each range
that the part ends in or before; documents are summed up in the one block that is cut. So no task orders a whole source.
Words are counted once; what is written of a document then is its source, tokens and hash.

All steps are DataFrame functions. Tokens are the words of a text and one end. Cases: null or empty texts are one
token; a null source is a source of its own; repeated rows are each dealt; a null doc_id is dealt like others; ties in an
order go by doc_id and tokens; an empty table gives an empty result; other columns stay inside `row`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import WORD, stored

MAX_REPETITION = 2.0
BLOCK_TOKENS = 1 << 18
SEED = 17
STEPS, ROUNDS = 16, 9
#: Ranges that a source's order of blocks is cut into, a power of two.
RANGES = 1 << 12


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1


def dealt(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("source").cast("string").alias("name"), F.col("source").isNull().alias("none")).alias("key"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("mix")).select("row", "doc_id", F.coalesce("key.name", F.lit("")).alias("name"), F.col("key.none").alias("none"), "text", "mix")


def source_tokens(rows: DataFrame) -> DataFrame:
    """name, none, tokens of each source, from rows with the tokens of each document."""
    return rows.groupBy("name", "none").agg(F.sum("tokens").alias("tokens"))


def measures(shares: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy in nats, largest repetition) at each exponent, by one aggregate over the sources."""
    p, total = F.col("p"), F.col("total")
    made = []
    for i, x in enumerate(exponents):
        power = F.pow(p, F.lit(x))
        made += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(x - 1))).alias(f"hi{i}"), F.min(F.pow(p, F.lit(x - 1))).alias(f"lo{i}")]
    r = shares.agg(F.max(total).alias("total"), *made).first()
    return [(math.log(r[f"z{i}"]) - x * r[f"l{i}"] / r[f"z{i}"], r[f"hi{i}"] / (r[f"lo{i}"] if budget is None else r[f"z{i}"] * r["total"] / budget)) for i, x in enumerate(exponents)]


def bisected(shares: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: float | None) -> float:
    """The exponent from 0 (all sources alike) to 1 (as they are)."""

    def edge(holds, rising: bool) -> float:
        """Where holds turns: true from there on (rising), or true up to there."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = [lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)]
            good = [holds(m) for m in measures(shares, tried, budget)]
            if rising:
                at = next((i for i, ok in enumerate(good) if ok), STEPS)
                if at == 0:
                    return lo
                lo, hi = tried[at - 1], tried[at]
            else:
                at = next((i for i, ok in reversed([*enumerate(good)]) if ok), 0)
                if at == STEPS:
                    return hi
                lo, hi = tried[at], tried[at + 1]
        return hi if rising else lo

    low = edge(lambda m: m[1] <= max_repetition * (1 + 1e-12), True) if max_repetition is not None else 0.0
    return max(low, edge(lambda m: m[0] >= target_entropy, False)) if target_entropy is not None else low if max_repetition is not None else 1.0


def mix_sources(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row for each use of a document: row (all columns), doc_id, name (source), epoch, block, block_order, doc_order.

    Sorting by epoch, block_order, doc_order gives the permutation. budget: tokens to realise, or None.
    """
    rows = dealt(docs, seed)
    sizes = stored(rows.select("name", "none", "mix", token_count(F.col("text")).cast("long").alias("tokens")), "sizes")
    shares = stored(source_tokens(sizes), "sources")
    total = shares.agg(F.sum("tokens")).first()[0]
    if total is None:
        return rows.select("row", "doc_id", "name", *(F.lit(0).cast("long").alias(c) for c in ("epoch", "block", "block_order", "doc_order")))
    shares = shares.withColumns({"p": F.col("tokens") / F.lit(total), "total": F.lit(total)})
    x = bisected(shares, max_repetition, target_entropy, budget)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(x))), F.max(F.pow("p", F.lit(1 - x)))).first()
    spent = budget if budget is not None else total * z * most
    owed = F.pow("p", F.lit(x)) / z * F.lit(float(spent)) / F.col("tokens")
    plan = shares.select("name", "none", F.floor(owed + 1e-9).alias("whole"), F.greatest(F.lit(0), F.round((owed - F.floor(owed + 1e-9)) * F.col("tokens"))).cast("long").alias("rest"), F.ceil(F.col("tokens") / block_tokens).alias("blocks"))
    plan = stored(plan, "plan")

    placed = rows.join(plan, ["name", "none"]).withColumn("block", F.pmod("mix", "blocks"))
    order = lambda epoch: F.xxhash64(F.lit(seed), epoch, "name", "none", "block")
    within = lambda epoch: F.xxhash64(F.lit(seed), epoch, "mix")
    # A row for each block: sizes of its documents, its place in the order of the epoch that is cut.
    sized = sizes.join(plan, ["name", "none"]).groupBy("name", "none", F.pmod("mix", "blocks").alias("block"), "whole", "rest").agg(F.sum("tokens").alias("tokens"))
    sized = stored(sized.withColumn("at", order(F.col("whole"))).withColumn("range", F.shiftright("at", 63 - (RANGES.bit_length() - 2))), "blocks")
    key = ["name", "none"]
    ranges = sized.groupBy(*key, "range").agg(F.sum("tokens").alias("in_range"))
    before = ranges.select(*key, "range", (F.sum("in_range").over(Window.partitionBy(*key).orderBy("range")) - F.col("in_range")).alias("before"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*key, "range").orderBy("at", "block"))
    blocks = sized.join(before, [*key, "range"]).withColumn("upto", upto).select(*key, "block", F.when(F.col("upto") <= F.col("rest"), "all").when(F.col("upto") - F.col("tokens") < F.col("rest"), "some").otherwise("none").alias("share"), (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))
    blocks = stored(blocks, "shares")

    used = placed.join(blocks, ["name", "none", "block"])
    even = used.where("share <> 'some'").withColumn("uses", F.col("whole") + F.when(F.col("share") == "all", 1).otherwise(0))
    size = token_count(F.col("text"))
    run = F.sum(size).over(Window.partitionBy("name", "none").orderBy(within(F.col("whole")), "doc_id", size).rowsBetween(Window.unboundedPreceding, 0))
    cut = used.where("share = 'some'").withColumn("uses", F.col("whole") + F.when(run <= F.col("left"), 1).otherwise(0))
    out = even.unionByName(cut).where("uses > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    name = F.when(~F.col("none"), F.col("name")).alias("name")
    return out.select("row", "doc_id", name, "epoch", "block", order(F.col("epoch")).alias("block_order"), within(F.col("epoch")).alias("doc_order"))
