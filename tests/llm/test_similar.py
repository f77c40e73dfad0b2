"""The pipeline's near-dedup of whole documents against exact shingle similarities."""

import re

import numpy as np
from test_llm import ODD, brute_components, each, odd_rows

from reviewlake.llm import similar
from reviewlake.llm.common import table
from reviewlake.llm.substring import WordHashes

FIND = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingles(text, n=5):
    words = FIND("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(words, k, rng):
    out = list(words)
    for i in rng.choice(len(out), k, replace=False):
        out[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def test_near_copies_meet(spark, sf):
    """Of near copies made at similarity 0.8 or more, at least 0.9 share their original's component; no pair under 0.5 is linked."""
    rng = np.random.default_rng(4)
    base = [(i, t) for i, t in each(table(spark, sf, "documents")) if 60 <= len(FIND(t or "")) <= 1500][:120]
    data, wanted = dict(base), []
    for i, t in base:
        words = FIND(t)
        for m, k in enumerate((1, max(1, len(words) // 90), max(1, len(words) // 55))):
            other = changed(words, k, rng)
            data[10_000 + 10 * i + m] = other
            wanted.append((i, 10_000 + 10 * i + m, jaccard(shingles(t), shingles(other))))
    out = similar.similar_documents(spark.createDataFrame(list(data.items()), "doc_id long, text string"))
    part = {r.doc_id: r.component_id for r in out.collect()}
    close = [part[a] == part[b] for a, b, j in wanted if j >= 0.8]
    assert len(close) > 150 and sum(close) >= 0.9 * len(close)
    sets = {i: shingles(t) for i, t in base}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if part[a] == part[b]:
                assert jaccard(sets[a], sets[b]) >= 0.5


def test_odd_documents(spark):
    got = sorted(((r.doc_id, r.component_id) for r in similar.similar_documents(odd_rows(spark)).collect()), key=repr)
    assert len(got) == len(ODD)
    assert {(i, c) for i, c in got if i in (3, 4, 5)} == {(3, 3), (4, 3), (5, 3)} and (None, 3) in got
    assert [(i, c) for i, c in got if i in (8, 9)] == [(8, 8), (9, 8), (9, 8)]
    assert similar.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint():
    known = WordHashes()
    one = similar.shingle_set("A b c d e f g", known)
    assert len(one) == 3 and (one == similar.shingle_set("a b c d e f g", known)).all()
    bits = [sum((int(h >> np.uint64(b)) & 1) for h in one) for b in range(64)]
    assert len(bits) == 64 and (similar.fingerprint(one) == similar.fingerprint(one[::-1])).all()
    assert not similar.fingerprint(similar.shingle_set(None, known)).any() and len(similar.shingle_set("x y", known)) == 1


FPS = "node long, f0 long, f1 long, f2 long, f3 long, size long"


def flipped(base, bits):
    x = base.copy()
    for b in bits:
        x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return x


def frame_of(spark, fps, size=100):
    return spark.createDataFrame([(i, *(int(w) for w in np.asarray(f, np.uint64).view(np.int64)), size) for i, f in enumerate(fps)], FPS)


def found(spark, fps, **options):
    edges = [(r.a, r.b) for r in similar.links(frame_of(spark, fps), len(fps), **options).collect()]
    return brute_components(list(range(len(fps))), edges)


def near_group(rng, n, bits=12):
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    return [base, *(flipped(base, rng.choice(256, bits, replace=False)) for _ in range(n))]


def test_groups_over_batches(spark):
    """Links of one hot key do not depend on how its rows come: near copies of one fingerprint and others of the same key."""
    fps = near_group(np.random.default_rng(9), 400)
    assert len(set(found(spark, fps).values())) == 1
    assert len(set(found(spark, fps, split=50).values())) == 1


def test_chains_in_groups(spark, monkeypatch):
    """Ends of chains link over members that their group's first row reaches, however many rows meet and wherever batches end."""
    monkeypatch.setattr(similar, "tables_for", lambda n, *_: np.array([np.arange(244, 256)]))  # one table of bits that all share
    rng = np.random.default_rng(3)
    for fillers, split in ((0, 100), (6, 100), (40, 100), (40, 7), (300, 40)):
        base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        fps = [base, flipped(base, range(30)), flipped(base, range(60)), flipped(base, range(60, 130)), flipped(base, range(120, 244))]
        fps += [flipped(base, rng.choice(244, 3, replace=False)) for _ in range(fillers)]
        rng.shuffle(fps)
        want = brute_components(
            list(range(len(fps))), [(i, j) for i, x in enumerate(fps) for j, y in enumerate(fps[:i]) if similar.apart(x, y) <= similar.RADIUS]
        )
        assert len(set(want.values())) == 3
        assert found(spark, fps, split=split) == want


def test_many_components_in_a_hot_group(spark, monkeypatch):
    """A group over the split whose rows are chains of many components: blocks find the links between what tasks held apart."""
    monkeypatch.setattr(similar, "tables_for", lambda n, *_: np.array([np.arange(244, 256)]))
    rng = np.random.default_rng(5)
    last = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = []
    for _ in range(30):
        at = flipped(last, rng.choice(244, 120, replace=False))
        for _ in range(10):
            fps.append(at)
            at = flipped(at, rng.choice(244, 40, replace=False))
    rng.shuffle(fps)
    want = brute_components(list(range(len(fps))), [(i, j) for i, x in enumerate(fps) for j, y in enumerate(fps[:i]) if similar.apart(x, y) <= similar.RADIUS])
    assert 20 < len(set(want.values())) < 40
    for split in (1000, 60, 16):
        assert found(spark, fps, split=split) == want


def test_pivots_discard():
    """Tables on blocks discard nearly all random pairs and never a pair within the radius."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    assert similar.discarded(fps) > 0.99
    close = np.array([flipped(f, rng.choice(256, similar.RADIUS, replace=False)) for f in fps])
    assert (similar.bound(similar.pivot_table(fps), similar.pivot_table(close)) <= similar.RADIUS).all()


def test_small_splits_change_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    want = sorted(tuple(r) for r in similar.similar_documents(docs).collect())
    assert sorted(tuple(r) for r in similar.similar_documents(docs, split=2).collect()) == want
