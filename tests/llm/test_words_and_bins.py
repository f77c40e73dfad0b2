"""Best-fit packing, spelling variants and cross-tokenizer alignment against brute-force versions, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import bins, crossing, packing, spelling
from reviewlake.llm.common import table

path = public_tokenizers.path
FAST = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
SCHEMA = "doc_id long, text string, block long, part int, row long, word string, n long, chunk long, side int, `a.b` string"
ODD = [(1, "Ünïcode — 漢字 <|endoftext|> word▁ \n"), (2, None), (3, ""), (4, "  \t two  spaces \r\n"), (5, "w " * 9000), (6, "same text"), (6, "same text"), (7, "x" * 3000), (None, "no id here"), (None, None), (8, "a\x00b"), (9, "<s> </s> <unk>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, "w", 4, 5, 6, "x") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def exact():
    t = Tokenizer.from_file(FAST[0])
    return t


def check_packing(rows, texts, length=2048):
    """Every id lies in one piece, bins are gapless, only long documents are cut."""
    t = exact()
    per, held = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        held[r["sequence_id"]].append(r)
    want = Counter()
    for doc_id, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        edges = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for own in held.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(held)


def test_bins_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = bins.pack_best_fit(docs, *FAST).collect()
    used = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    lengths = [r["length"] for r in rows]
    assert used <= max(-(-sum(lengths) // 2048), sum(2 * n > 2048 for n in lengths)) + 1


def test_bins_in_many_blocks(spark, sf):
    """Blocks of a few pieces leave loose bins; packed again across blocks, hardly more are used than in one block."""
    docs = table(spark, sf, "documents").where("doc_id is not null")
    one = bins.pack_best_fit(docs, *FAST).select("sequence_id").distinct().count()
    many = bins.pack_best_fit(docs, *FAST, block=20)
    assert check_packing(many.collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]) <= one * 1.03


def test_bins_odd_rows(spark, odd, none):
    check_packing(bins.pack_best_fit(odd, *FAST).collect(), ODD)
    assert bins.pack_best_fit(none, *FAST).collect() == []
    ids = bins.pack_best_fit(odd, *FAST, with_ids=True).where("doc_id = 4").first()["ids"]
    assert ids == [*exact().encode(ODD[3][1], add_special_tokens=False).ids, 0]


def optimum(sizes, length):
    """Fewest bins, by next-fit over all orders: some order of any packing gives it."""
    best = len(sizes)
    for order in set(permutations(sizes)):
        used, room = 1, length
        for s in order:
            if s > room:
                used, room = used + 1, length
            room -= s
        best = min(best, used)
    return best


@given(st.lists(st.integers(1, 10), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_genetic_algorithm_finds_the_optimum(sizes):
    seen = np.array(sizes)
    best = bins.evolve(seen, [], 1, 10, 200)[0]
    assert (np.bincount(best, seen) <= 10).all() and bins.fitness(best, seen)[0] == optimum(sizes, 10)


def test_genetic_algorithm_beats_best_fit():
    """Sizes where best-fit decreasing wastes a bin, and crossings find it."""
    chance, better, worse = random.Random(5), 0, 0
    for k in range(40):
        seen = np.array([chance.randint(260, 480) for _ in range(48)])
        first = bins.fitness(bins.newcomer(seen, 1000, 0.0, chance), seen)[0]
        last = bins.fitness(bins.evolve(seen, [], k, 1000, 300)[0], seen)[0]
        better, worse = better + (last < first), worse + (last > first)
    assert better >= 25 and worse == 0


def test_crossing_keeps_every_piece_once():
    chance = random.Random(2)
    for _ in range(50):
        sizes = np.array([chance.randint(1, 700) for _ in range(60)])
        a, b = (bins.newcomer(sizes, 1000, 0.9, chance) for _ in "ab")
        child = bins.crossed(a, b, sizes, 1000, chance)
        loads = np.bincount(child, sizes)
        assert (loads <= 1000).all() and (loads > 0).all() and loads.sum() == sizes.sum()


def test_islands_of_hard_blocks(spark):
    """Three sizes that fill a sequence exactly: islands evolve, elites move, all pieces stay."""
    chance = random.Random(1)
    rows = []
    for k in range(300):
        a = chance.randint(300, 900)
        b = chance.randint(300, 2048 - a - 300)
        rows += [(0, 3 * k + i, s) for i, s in enumerate((a, b, 2048 - a - b))]
    df = spark.createDataFrame(rows, "part int, row long, size long")
    placed = bins.placed_pieces(df, 2048, 0, 300).collect()
    assert Counter((r["row"], r["size"]) for r in placed) == Counter((r[1], r[2]) for r in rows)
    loads = Counter()
    for r in placed:
        loads[r["sequence_id"]] += r["size"]
    assert max(loads.values()) <= 2048 and len(loads) <= 300 * 1.06


# Spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(docs, min_length=6, min_count=5):
    counts, lower = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    keys = defaultdict(set)
    for w in words:
        for k in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            keys[k].add(w)
    near = {}
    for w in words:
        met = set().union(*(keys[k] for k in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}))
        near[w] = [x for x in met if one_edit(w, x)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def as_found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert as_found(spelling.spelling_variants(docs)) == brute_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_spelling_hot_halves_over_many_shards(spark, monkeypatch):
    """Thousands of words with the same first or last half, split over shards of a few texts; chains of forms; ties."""
    chance = random.Random(4)
    words = {f"{half}{''.join(chance.choice('abc') for _ in range(5))}" for half in ("strong", "weaker") for _ in range(400)}
    words |= {f"{''.join(chance.choice('abc') for _ in range(5))}ending" for _ in range(300)}
    words |= {"chainaaa", "chainaab", "chainabb", "chainbbb", "éèüöäß", "éèüöäâ", "aaaaaaa", "aaaaaaaa", "aaaaaa"}
    often = {"chainaaa": 640, "chainaab": 125, "chainabb": 25, "chainbbb": 5, "éèüöäß": 25}
    rows = [(k, " ".join([w] * often.get(w, chance.randint(5, 8)))) for k, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_variants(rows)
    assert want["chainbbb"][1] == "chainaaa"
    assert as_found(spelling.spelling_variants(docs, shard=60)) == want
    monkeypatch.setattr(spelling, "WHOLE_TABLE", 2_000)  # tables of ranks with every n-th row
    texts = sorted(want)
    counts = np.array([want[w][2] for w in texts])
    found = [spelling.near_words(texts, counts, texts, side) for side in (0, 1)]
    assert [int(a + b) for a, b in zip(found[0][0], found[1][0], strict=True)] == [want[w][3] for w in texts]


@given(st.sets(st.text("abé", min_size=6, max_size=10), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_index_finds_all_edits(words):
    texts = sorted(words)
    found = [spelling.near_words(texts, np.ones(len(texts), int), texts, side)[0] for side in (0, 1)]
    assert (found[0] + found[1]).tolist() == [sum(one_edit(w, x) for x in texts) for w in texts]


def test_spelling_odd_rows(spark, odd, none):
    assert as_found(spelling.spelling_variants(odd)) == brute_variants(ODD)
    assert spelling.spelling_variants(none).collect() == []
    long = "q" * 20_000
    rows = [(k, f"{long} {long}r {long[:-1]}") for k in range(5)]
    assert as_found(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_variants(rows)


# Cross-tokenizer alignment


def brute_alignment(docs):
    t = exact()
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    names, place = {i: w for w, i in t.get_vocab().items()}, crossing.byte_of()
    plain, pairs, rows = [], Counter(), []
    for doc_id, text in docs:
        a, b = t.encode(f" {text or ''}", add_special_tokens=False).ids, sp.encode(text or "")
        bytes_a = [bytes(place[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        data = f" {text}".encode()
        groups = []
        if text and b"".join(bytes_a) == data and b"".join(bytes_b) == data:
            i = j = at_a = at_b = 0
            group = ([], [])
            while i < len(a) or j < len(b):
                if at_a <= at_b and i < len(a):
                    at_a, i = at_a + len(bytes_a[i]), i + 1
                    group[0].append(a[i - 1])
                else:
                    at_b, j = at_b + len(bytes_b[j]), j + 1
                    group[1].append(b[j - 1])
                if at_a == at_b:
                    groups.append(group)
                    group = ([], [])
        else:
            a = b = []
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        pairs.update(set(links))
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (x, _), n in pairs.items():
        highest[x] = max(highest[x], n)
    for doc_id, na, nb, ng, links, said in rows:
        best = sum(n for (x, y), n in links.items() if pairs[x, y] == highest[x])
        plain.append((doc_id, na, nb, ng, sum(links.values()), best, sum(n * pairs[p] for p, n in links.items()), said))
    return Counter(plain)


def align(docs, **options):
    rows = crossing.align(docs, FAST[0], path("piece_bpe_32k.model"), *FAST[1:], **options)
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows.collect())


def test_alignment_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert align(docs) == brute_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_alignment_over_many_chunks_and_branches(spark, sf):
    """Chunks of some kB, a tree of two levels in each of a few segments."""
    docs = table(spark, sf, "documents").where("doc_id < 60").repartition(5)
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert align(docs, chunk_bytes=2_000, segments=3, branch_pairs=500, fan_in=3) == want


def test_alignment_odd_rows(spark, odd, none):
    assert align(odd) == brute_alignment(ODD)
    assert align(none) == Counter()


def test_links_of_large_groups(monkeypatch):
    """Groups over the bound are taken by distinct ids: the same links, counted."""
    chance = np.random.default_rng(1)
    na, nb = np.array([3, 40, 1, 0, 25]), np.array([2, 30, 5, 0, 40])
    a, b = chance.integers(0, 9, na.sum()), chance.integers(0, 9, nb.sum())

    def all_links():
        out = Counter()
        for codes, weights, group in crossing.links(a, b, na, nb, 100):
            for c, w, g in zip(codes.tolist(), [1] * len(codes) if weights is None else weights.tolist(), group.tolist(), strict=True):
                out[c, g] += w
        return out

    plain = all_links()
    monkeypatch.setattr(crossing, "MOST_LINKS", 60)
    assert all_links() == plain and sum(plain.values()) == int((na * nb).sum())


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 5_000))
    made = crossing.PerfectHash.unpacked(crossing.PerfectHash.of(keys).packed())
    assert sorted(made.places(keys).tolist()) == list(range(len(keys)))
    assert crossing.PerfectHash.of(keys[:0]).places(keys[:0]).tolist() == []
    table = {"n": len(keys), "hash": made.packed(), "keys": keys[np.argsort(made.places(keys))].astype("<i8").tobytes()}
    assert (crossing.verified(table, keys) == made.places(keys)).all()
    with pytest.raises(ValueError, match="not among"):
        crossing.verified(table, keys[:3] + (1 << 41))
