"""Each training-data operator against a brute-force version, an exact round trip or held-out rows, and on odd input."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.llm import components, licences, lines, media, mixing, packing, simhash, substring, token_counts, toxicity, vectors
from reviewlake.llm.common import table

FIND = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, row string, lost string, score double, node long, block long, `my-col` int, `__id` long, `a.b` string, own array<string>"
PASSAGE = " ".join(f"shared{i}" for i in range(30))
LINE = "This very line is found in many documents."
ODD = [
    (1, f"one two three {PASSAGE} end one\n{LINE}\nx", "a"),
    (2, f"{PASSAGE} other words here\n  {LINE.upper()}\t\ny", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, "   \n\t ", "b"),
    (6, "Ünïcode — 漢字 <|endoftext|> word\n" + LINE, "b"),
    (7, "w " * 9000 + PASSAGE, "c"),
    (8, "same text in three rows " * 5, "c"),
    (9, "same text in three rows " * 5, "c"),
    (9, "same text in three rows " * 5, "c"),
    (10, f"start {PASSAGE} {PASSAGE} stop", None),
    (None, f"no id {PASSAGE}\n{LINE}", "c"),
    (None, None, None),
]


def odd_rows(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "r", "l", 0.5, 3, 4, 5, 6, "x", ["y"]) for i, t, s in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def each(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# media


def test_media_round_trip(odd, docs, none):
    for d in (odd, docs):
        out = media.media_features(media.store_media(d)).collect()
        want = Counter()
        for i, t in each(d):
            b = (t or "").encode()
            p = b + b" " * ((-len(b)) % 192 or (0 if b else 192))
            want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
        for r in out:
            assert r.codec == "raw" and r.n_samples == r.payload_bytes // 192 and r.n_keyframes == -(-r.n_samples // media.GROUP)
            assert abs(r.duration_s - r.n_samples / 25) < 1e-9 and len(r.keyframes) == r.n_keyframes
    assert media.media_features(media.store_media(none)).count() == 0


def test_media_boxes(spark):
    payload = bytes(range(192)) * 40
    data = media.write_container(payload)
    t = media.read_tables(data)
    assert media.payload_of(data, t["places"]) == payload
    assert [data[a : a + n] for a, n in t["keyframes"]] == [bytes(range(192))] * 4
    assert {p for p, _, _ in media.walk(data)} >= {(b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz")}
    broken = spark.createDataFrame([(1, 5, b"nothing"), (2, 5, None), (3, 5, data[:-9])], "doc_id long, n_bytes long, media binary")
    assert [r.feature for r in media.media_features(broken).collect()] == [None] * 3
    # no keyframe table, sizes of their own, wide offsets
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    body = b"abcdefghij"
    head = media.box(b"mdat", body)
    stbl = media.box(b"stbl", media.full_box(b"stsd", u32(1), media.box(b"avc1", bytes(70))), media.full_box(b"stts", u32(2, 2, 10, 1, 30)), media.full_box(b"stsc", u32(1), u32(1, 3, 1)), media.full_box(b"stsz", u32(0, 3), u32(2, 3, 5)), media.full_box(b"co64", u32(1), struct.pack(">Q", 8)))
    t = media.read_tables(head + media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full_box(b"mdhd", u32(0, 0, 10, 50)), media.box(b"minf", stbl)))))
    assert (t["codec"], t["seconds"], t["ticks"], t["keyframes"]) == ("avc1", 5.0, 50, [(8, 2), (10, 3), (13, 5)])


def u32(*x):
    return struct.pack(f">{len(x)}I", *x)


def small_movie(*stbl, extra=b"", head=b"", video=False):
    """A movie of one track with these sample tables."""
    media_ = media.box(b"mdia", media.full_box(b"mdhd", u32(0, 0, 10, 0)), media.box(b"minf", *([media.full_box(b"vmhd", bytes(8))] if video else []), media.box(b"stbl", *stbl)))
    return head + media.box(b"moov", media.box(b"trak", media.full_box(b"tkhd", u32(0, 0, 7, 0, 0)), media_), extra)


def test_media_fragments_and_small_sizes():
    empty = [media.full_box(b"stsd", u32(1), media.box(b"mp4a", bytes(70))), media.full_box(b"stts", u32(0)), media.full_box(b"stsc", u32(0)), media.full_box(b"stsz", u32(0, 0)), media.full_box(b"stco", u32(0))]
    movie = small_movie(*empty, extra=media.box(b"mvex", media.full_box(b"trex", u32(7, 1, 5, 4, 1 << 16))))
    run = lambda at: media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", u32(7), flags=0x20000), media.full_box(b"trun", u32(3, at, 0), flags=0x5)), media.box(b"traf", media.full_box(b"tfhd", u32(8), flags=0), media.full_box(b"trun", u32(1))))
    moof = run(len(run(0)) + 8)
    data = movie + moof + media.box(b"mdat", b"aaaabbbbcccc")
    t = media.read_tables(data)
    assert media.payload_of(data, t["places"]) == b"aaaabbbbcccc" and [data[a : a + n] for a, n in t["keyframes"]] == [b"aaaa"]
    assert (t["codec"], t["width"], t["ticks"], t["seconds"]) == ("mp4a", None, 15, 1.5)
    sizes = [*empty[:1], media.full_box(b"stts", u32(1, 3, 2)), media.full_box(b"stsc", u32(1, 1, 3, 1)), media.full_box(b"stz2", u32(4, 3), bytes([0x23, 0x50])), media.full_box(b"stco", u32(1, 8))]
    assert media.read_tables(small_movie(*sizes, head=media.box(b"mdat", b"abcdefghij")))["places"] == [(8, 2), (10, 3), (13, 5)]


def test_media_hostile(spark):
    """Deep nesting, forged counts and keyframes that are no samples: broken, and nothing large is built."""
    nested = b""
    for _ in range(3_000):
        nested = media.box(b"moov", nested)
    base = [media.full_box(b"stsd", u32(1), media.box(b"avc1", bytes(70))), media.full_box(b"stts", u32(1, 1, 1)), media.full_box(b"stsc", u32(1, 1, 1, 1))]
    forged = small_movie(*base, media.full_box(b"stsz", u32(1, 0xFFFFFFFF)), media.full_box(b"stco", u32(1, 0)))
    table_ = small_movie(*base, media.full_box(b"stsz", u32(0, 0xFFFFFFF0)), media.full_box(b"stco", u32(1, 0)))
    zero = small_movie(*base, media.full_box(b"stss", u32(1, 0)), media.full_box(b"stsz", u32(4, 1)), media.full_box(b"stco", u32(1, 0)))
    beyond = small_movie(*base, media.full_box(b"stsz", u32(0, 1, 500_000)), media.full_box(b"stco", u32(1, 0)))
    run = small_movie(*base, media.full_box(b"stsz", u32(0, 0)), media.full_box(b"stco", u32(0)), media.full_box(b"stsc", u32(0))) + media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", u32(7)), media.full_box(b"trun", u32(0xFFFFFFF0))))
    rows_ = [(i, 1, x) for i, x in enumerate((nested, forged, table_, zero, beyond, run, b"", b"\0" * 40))]
    got = media.media_features(spark.createDataFrame(rows_, "doc_id long, n_bytes long, media binary")).collect()
    assert len(got) == len(rows_) and all(r.feature is None and r.keyframes is None for r in got)


@given(st.binary(max_size=200), st.integers(0, 700), st.integers(0, 255))
@settings(deadline=None, max_examples=200)
def test_media_damaged(payload, at, value):
    """A changed byte gives tables or a ValueError and the like, never anything else."""
    data = bytearray(media.write_container(media.padded(payload)))
    data[at % len(data)] = value
    try:
        media.read_tables(bytes(data))
    except (ValueError, KeyError, IndexError, struct.error, ZeroDivisionError, OverflowError):
        pass


# token counts


def viterbi(word, pieces):
    text, best = token_counts.MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = [(best[end - 1][0] + token_counts.UNKNOWN, best[end - 1][1] + len(text[end - 1].encode()))]
        found += [(best[s][0] + pieces[text[s:end]], best[s][1] + 1) for s in range(end) if text[s:end] in pieces]
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_token_counts(odd, docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, known = token_counts.load_pieces(path), {}
    for d in (odd, docs):
        want = []
        for i, t in each(d):
            words = FIND(t or "")
            for w in set(words) - set(known):
                known[w] = viterbi(w, pieces)
            want.append((i, len(words), sum(known[w] for w in words)))
        assert rows(token_counts.token_counts(d, path), "doc_id", "n_pretokens", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(none, path).count() == 0


def test_trie_shares_prefixes_and_forgets(monkeypatch):
    pieces = {"▁": -1.0, "a": -2.0, "ab": -2.5, "▁a": -2.2, "b": -2.0}
    trie = token_counts.PrefixTrie(pieces)
    assert [trie.count(w) for w in ("abab", "abaa", "a")] == [3, 4, 1]
    assert len(trie.score) == 1 + len({("▁" + w)[:k] for w in ("abab", "abaa", "a") for k in range(1, len(w) + 2)})
    monkeypatch.setattr(token_counts, "MAX_NODES", 3)
    small = token_counts.PrefixTrie(pieces)
    assert [small.count(w) for w in ("abab", "abaa", "a", "abab")] == [trie.count(w) for w in ("abab", "abaa", "a", "abab")]


# substring dedup


def brute_substring(docs, n=13):
    first = {}
    for i, t in docs:
        w = FIND(t or "")
        for k in range(len(w) - n + 1 if i is not None else 0):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = FIND(t or "")
        gone = {p for k in range(len(w) - n + 1 if i is not None else 0) if first[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [None, 7])
def test_substring(odd, docs, none, buckets):
    for d in (odd, docs):
        cut = substring.drop_repeats(d, buckets=buckets)
        assert rows(cut.withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)), "doc_id", "n_words", "n_removed", "sha") == brute_substring(each(d))
    assert substring.drop_repeats(none).count() == 0


def test_substring_hot_passage_long_text_and_rows_without_id(spark):
    """A passage that all blocks hold, one text of 120,000 words that repeats itself and others, many rows without id or text."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows_in = [(i, f"own{i} {passage} end{i} " + " ".join(f"w{i * k % 997}" for k in range(30))) for i in range(300)]
    rows_in += [(1000, " ".join(f"l{k % 70_000}" for k in range(120_000)) + " " + passage), (1001, " ".join(f"l{k}" for k in range(60_000, 65_000)))]
    rows_in += [(None, None)] * 500 + [(None, passage)] * 20
    cut = substring.drop_repeats(spark.createDataFrame(rows_in, "doc_id long, text string").repartition(12), buckets=5)
    assert rows(cut.withColumn("sha", F.sha2(F.col("kept").cast("binary"), 256)), "doc_id", "n_words", "n_removed", "sha") == brute_substring(rows_in)


@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 14))
@settings(deadline=None, max_examples=60)
def test_window_hashes(words, n):
    h = substring.window_hashes(words, substring.WordHashes(), n)
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    assert len(h) == len(windows)
    assert all((h[i] == h[j]) == (windows[i] == windows[j]) for i in range(len(h)) for j in range(i))


@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=50))
def test_packed_hashes(values):
    x = np.array(sorted(values), np.uint64)
    assert (substring.unpack(substring.pack(x)) == x).all()
    docs = np.array([v % 7 for v in sorted(values)], np.int64)
    assert (substring.unpack_owners(substring.pack_owners(docs)) == docs).all()


def test_intervals_are_maximal():
    assert substring.removal_intervals(np.array([1, 2, 5, 30, 43, 60])) == [(1, 18), (30, 56), (60, 73)]


# licences


def brute_likeness(words, family):
    pairs = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
    own, texts = pairs(words), [pairs(licences._words(x)) for x in licences.TEMPLATES[family]]
    one = max(len(own & t) / max(min(len(own), len(t)), 1) for t in texts)
    return max(one, len(own & set().union(*texts)) / max(len(own), 1))


@pytest.fixture(scope="module")
def licence_model(docs):
    return licences.fit(docs)


def test_licences(spark, docs, none, licence_model):
    wrapped = "\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this|software and associated documentation files (the \"Software\"), to deal in the Software|without restriction, including without limitation the rights to use, copy, modify, merge,|publish, distribute, sublicense, and/or sell copies of the Software".split("|"))
    extra = [(9001, "Some words before.\nReleased under the MIT License.\nfin"), (9002, None), (9003, ""), (9004, "Licensed under the Apache License, Version 2.0.\n\nLicensed under CC BY-NC 4.0."), (9005, "nothing to see here " * 3000), (9001, "Released under the MIT License."), (9006, f"intro\n\n{wrapped}\n\nend"), (9007, "Released under the MIT License."), (9007, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    every = licences.scan(d, licence_model)
    out = every.where("confirmed")
    assert rows(out.where("doc_id > 9000"), "doc_id", "paragraph", "n_lines", "family") == [(9001, 0, 1, "MIT"), (9001, 1, 1, "MIT"), (9004, 0, 1, "Apache-2.0"), (9004, 2, 1, "CC-BY-NC-4.0"), (9006, 2, 4, "MIT"), (9007, 0, 1, "MIT"), (9007, 0, 1, "MIT")]
    assert rows(out.where("doc_id is null"), "paragraph", "family") == [(0, "CC-BY-4.0")]
    want = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    assert rows(out.where("doc_id < 9000"), "doc_id", "family") == sorted(((i, f) for i, t in each(docs) for f, x in want.items() for line in (t or "").split("\n") if line == x), key=repr)
    assert licences.scan(none, licences.fit(none)).count() == 0


def test_licences_against_brute_force(spark, docs, licence_model):
    """Every line by itself through the fitted weights, runs of one family merged and compared by plain Python."""
    texts = {i: t or "" for i, t in each(docs)} | {9001: "a b\nReleased under the MIT License.\nThis project is licensed under the terms of the MIT license.\n\nReleased under the MIT License."}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    w, b0 = licence_model.model.coefficientMatrix.toArray(), licence_model.model.interceptVector.toArray()
    judged = {}
    for r in licences.vectors(licences.lines(d)).collect():
        z = w[:, r.features.indices].sum(1) + b0
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if p.argmax() > 0 and 1 - p[0] >= licence_model.limit:
            judged[r.doc_id, r.line] = licences.FAMILIES[p.argmax()]
    want = []
    for (i, k), family in judged.items():
        if judged.get((i, k - 1)) != family:
            end = k
            while judged.get((i, end)) == family:
                end += 1
            words = [x for line in texts[i].split("\n")[k:end] for x in re.split(r"[^\w.+-]+|_+", line.lower()) if x]
            like = brute_likeness(words, family)
            want.append((i, k, end - k, family, like >= licences.LIKENESS, round(like, 9)))
    got = [(r.doc_id, r.paragraph, r.n_lines, r.family, r.confirmed, round(r.likeness, 9)) for r in licences.scan(d, licence_model).collect()]
    assert sorted(got) == sorted(want)
    assert [x[:4] for x in sorted(got) if x[0] == 9001] == [(9001, 1, 2, "MIT"), (9001, 4, 1, "MIT")]


def test_licences_unseen(spark, licence_model):
    """On variations and lines that the fit hasn't seen; notices that share a text (GPL versions) can't all be told apart."""
    assert licence_model.recall > 0.8 and licence_model.false_rate < 0.01
    n = [r.features.numNonzeros() for r in licences.vectors(spark.createDataFrame([(["a", "b", "a", "b"],), (["x"],)], "words array<string>")).collect()]
    assert n == [2 + 2 + 2, 1]


def test_every_line_is_an_example(spark):
    """No line is left to a sample; those like a licence are no examples of the class unknown."""
    d = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("some line "), F.col("id").cast("string"), F.lit("\n\nReleased under the MIT License.\nother words")).alias("text"))
    got = licences.unknown_lines(d)
    assert got.count() == 2500 * 2 and {r.w for r in got.select(F.array_join("words", " ").alias("w")).distinct().collect()} >= {f"some line {i}" for i in range(2500)}


def test_order_statistic(spark):
    p = [float(x) for x in np.random.default_rng(5).beta(0.1, 3, 3000)] + [1.0] * 50 + [0.25] * 40
    values, p = spark.createDataFrame([(x,) for x in p], "p double"), sorted(p)
    assert [licences.order_statistic(values, k) for k in (0, 1700, 3036, 3039, 3089)] == [p[k] for k in (0, 1700, 3036, 3039, 3089)]
    assert licences.percentile(values, 0.95) == pytest.approx(np.percentile(p, 95), rel=1e-12) and licences.percentile(values.limit(0), 0.5) is None


def test_fit_knows_classes_by_their_means(spark, docs, licence_model):
    """The weights are those of every line's counts, by numpy."""
    known, size = licences.variations(spark), len(licences.FAMILIES)
    counts, n = np.zeros((size, licences.DIMENSIONS)), np.zeros(size)
    n[0] = 1  # the line without words
    for r in licences.vectors(known.unionByName(licences.unknown_lines(docs).select(*known.columns))).where("train").select("label", "features").collect():
        counts[r.label, r.features.indices] += 1
        n[r.label] += 1
    weight = np.minimum(n, [licences.UNKNOWN_WEIGHT] + [np.inf] * (size - 1))
    counts = counts * (weight / n)[:, None] + licences.SMOOTHING
    assert np.allclose(licence_model.model.coefficientMatrix.toArray(), np.log(counts / counts.sum(1, keepdims=True)), rtol=1e-9)
    weight = weight + licences.SMOOTHING
    assert np.allclose(licence_model.model.interceptVector.toArray(), np.log(weight / weight.sum()), rtol=1e-9)


def test_fit_counts_places_without_vectors(spark, docs):
    """Each place of each line for the fit is counted once, as HashingTF has it; no function outside SQL takes part."""
    long = spark.createDataFrame([(9001, "again and again and again\n" + " ".join(f"w{i % 700}" for i in range(3000))), (9002, "x"), (9003, None)], "doc_id long, text string")
    lines_of = licences.unknown_lines(docs.select("doc_id", "text").union(long))
    counted = licences.place_counts(lines_of)
    assert "UDF" not in counted._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for r in licences.vectors(lines_of.select("train", "words")).select("train", "features").collect():
        want[licences.SHOWN if r.train else licences.HIDDEN] += 1
        want.update(map(int, r.features.indices) if r.train else ())
    assert {r.place: r.n for r in counted.collect()} == want and min(want[licences.SHOWN], want[licences.HIDDEN]) > 100


def test_bound_loses_no_licence(spark, docs, licence_model):
    """Lines that the bound leaves out are under LEAST_P by their vectors; the limit is that of all unseen lines."""
    pieces = [(9000 + i, "\n".join([" ".join(x.split()[: 2 + i]) + " and other words in this line" * (i % 3) for v in licences.TEMPLATES.values() for x in v])) for i in range(12)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(pieces, "doc_id long, text string"))
    w, b0 = licence_model.model.coefficientMatrix.toArray(), licence_model.model.interceptVector.toArray()

    def p(r):
        z = w[:, r.features.indices].sum(1) + b0
        return 1 - np.exp(z[0] - z.max()) / np.exp(z - z.max()).sum()

    every = {(r.doc_id, r.line): p(r) for r in licences.vectors(licences.lines(d)).select("doc_id", "line", "features").collect()}
    kept = {(r.doc_id, r.line) for r in licences.likely(licences.lines(d), licence_model.model).select("doc_id", "line").collect()}
    got = {(r.doc_id, r.line): r.p for r in licences.judge(d, licence_model.model).collect()}
    assert got == pytest.approx({k: x for k, x in every.items() if x >= licences.LEAST_P}) and set(got) <= kept and 300 < len(got) and len(kept) < len(every) / 2
    unseen = [p(r) for r in licences.vectors(licences.unknown_lines(docs).where("not train").select("words")).collect()]
    exact, lower = (np.percentile(unseen, 100 * (1 - licences.FALSE_RATE), method=m) for m in ("linear", "lower"))
    # Between a line under LEAST_P and one over it the limit is LEAST_P, which lets the same unseen lines pass.
    assert licence_model.limit == pytest.approx(exact if lower >= licences.LEAST_P else licences.LEAST_P)
    passed = sum(x >= max(exact, licences.LEAST_P) for x in unseen)
    assert sum(x >= licence_model.limit for x in unseen) == passed and licence_model.false_rate == pytest.approx(passed / len(unseen))
    values = spark.createDataFrame([(x / 1000,) for x in range(1001)], "p double")
    assert licences.percentile(values.where("p >= 0.6"), 0.9995, 1001) == pytest.approx(0.9995) and licences.percentile(values.where("p >= 0.6"), 0.5, 1001) is None


def test_frequent_notices(spark, sf):
    """Notices in a third of all documents: as sure as rare ones."""
    notice, family = "Licensed under CC BY 4.0.", "CC-BY-4.0"
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + notice))).otherwise(F.col("text")).alias("text"))
    got = {r.doc_id for r in licences.scan(d, licences.fit(d)).where(F.col("confirmed") & (F.col("family") == family)).select("doc_id").collect()}
    want = {r.doc_id for r in d.where("doc_id % 3 = 0").collect()}
    assert want and not want - got


# mixing


def brute_exponent(tokens, limit):
    total = sum(tokens)
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        r = [(t / total) ** (mid - 1) for t in tokens]
        lo, hi = (lo, mid) if max(r) / min(r) <= limit else (mid, hi)
    return hi


@pytest.mark.parametrize("block_tokens", [1 << 18, 50])
def test_mixing(odd, docs, none, block_tokens):
    for d in (odd, docs):
        out = [tuple(r) for r in mixing.mix_sources(d, block_tokens=block_tokens).select("doc_id", "name", "epoch", "row.text").collect()]
        size, tokens = {}, defaultdict(int)
        data = [(r.doc_id, r.source, r.text) for r in d.collect()]
        for i, s, t in data:
            size[i, s, t] = len(FIND(t or "")) + 1
            tokens[s] += size[i, s, t]
        x = brute_exponent(list(tokens.values()), mixing.MAX_REPETITION)
        total = sum(tokens.values())
        shares = {s: (t / total) ** x for s, t in tokens.items()}
        z = sum(shares.values())
        spent = max(t / (shares[s] / z) for s, t in tokens.items())
        assert {(i, s, t) for i, s, _, t in out} == {(i, s, t) for i, s, t in data}  # each document at least once
        first = Counter((i, s, t) for i, s, e, t in out if e == 0)
        assert first == Counter(data)
        for s in tokens:
            used = sum(size[i, n, t] for i, n, _, t in out if n == s)
            owed = shares[s] / z * spent
            largest = max(v for k, v in size.items() if k[1] == s)
            assert owed - largest - 1 <= used <= owed + 1
    assert mixing.mix_sources(none).count() == 0


def test_mixing_order_and_long_text(spark, monkeypatch):
    """The partial epoch takes blocks from the front of its order; one giant document and a source of a third of all rows."""
    data = [(i, f"w{i} " * (1 + i % 7), f"s{i % 3}") for i in range(900)] + [(1000, "long " * 200_000, "s3"), (1001, "few", "s4")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mix_sources(d, max_repetition=None, budget=3_000, block_tokens=40).withColumn("n", mixing.token_count(F.col("row.text")))
    got = defaultdict(list)
    for r in out.collect():
        got[r.name].append((r.epoch, r.block_order, r.block, r.n))
    every = defaultdict(dict)
    for r in mixing.mix_sources(d, block_tokens=40).where("epoch = 0").collect():
        every[r.name].setdefault(r.block, r.block_order)
    for name in ("s0", "s1", "s2"):
        last = max(e for e, _, _, _ in got[name])
        taken = {b for e, _, b, _ in got[name] if e == last}
        if last == 0:  # the orders of epoch 0 are comparable: what is taken lies before what isn't
            assert max(every[name][b] for b in taken) <= min([v for b, v in every[name].items() if b not in taken], default=1 << 63)
    monkeypatch.setattr(mixing, "RANGES", 2)
    two = mixing.mix_sources(d, max_repetition=None, budget=3_000, block_tokens=40)
    assert rows(two, "doc_id", "epoch", "block") == rows(out, "doc_id", "epoch", "block")


def test_mixing_targets(docs):
    data = defaultdict(int)
    for r in docs.collect():
        data[r.source] += len(FIND(r.text)) + 1
    total = sum(data.values())
    most = math.log(len(data))
    rows_ = mixing.dealt(docs, 1).withColumn("tokens", mixing.token_count(F.col("text")))
    shares = mixing.stored(mixing.source_tokens(rows_), "t").withColumns({"p": F.col("tokens") / total, "total": F.lit(total)})
    natural = -sum(t / total * math.log(t / total) for t in data.values())
    target = (natural + most) / 2
    x = mixing.bisected(shares, None, target, None)
    assert 0 < x < 1 and abs(mixing.measures(shares, [x], None)[0][0] - target) < 1e-6
    assert mixing.bisected(shares, None, most, None) < 1e-3
    assert mixing.bisected(shares, 1.0, None, None) > 0.999
    halved = mixing.mix_sources(docs, max_repetition=None, budget=total / 2)
    assert abs(halved.select(F.sum(mixing.token_count(F.col("row.text")))).first()[0] / (total / 2) - 1) < 0.2


# simhash


def brute_fingerprint(text, n=3):
    w = FIND("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(ids, linked):
    up = {i: i for i in ids}
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in linked:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_simhash(spark, odd, docs, none):
    near = [(5000 + k, "alpha beta gamma delta " * 80 + f"tail{k % 7} {'x ' * (k % 3)}", "en", "s", 1) for k in range(30)]
    d = docs.union(spark.createDataFrame(near, docs.schema))
    data = each(d)
    fp = {i: brute_fingerprint(t) for i, t in data}
    ids = sorted(fp)
    part = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert rows(simhash.near_duplicates(d), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{fp[i]:016x}", part[i]) for i in ids), key=repr)
    got = rows(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id")
    assert len(got) == len(ODD)
    assert {(i, c) for i, f, c in got if f == "0" * 16} == {(3, 3), (4, 3), (5, 3), (None, 3)}
    assert [(i, c) for i, _, c in got if i in (8, 9)] == [(8, 8), (9, 8), (9, 8)]
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("split", [simhash.SPLIT, 40, 3])
def test_simhash_links_find_all(spark, split):
    """Also with groups that are passed on and dealt anew, up to three times."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for r in range(5):
            fps.add(x ^ int(sum(1 << int(b) for b in rng.choice(64, r, replace=False))))
    for k in range(150):  # one large group of near copies
        fps.add(int(base[0]) ^ int(sum(1 << int(b) for b in rng.choice(64, 1 + k % 3, replace=False))))
    fps = sorted(fps)
    close = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3]
    want = brute_components(fps, close)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, split=split).collect()]
    assert brute_components(fps, edges) == want
    own = np.array(fps, np.uint64)
    root = simhash.clusters(own)
    assert all((own[i] == own[root[i]]) or root[i] < i for i in range(len(own)))
    assert brute_components(fps, [(fps[i], fps[int(root[i])]) for i in range(len(fps))]) == want


def test_pivot_tables():
    """Close pairs are equal in one union's distances and never discarded; the table discards nearly all others."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = x ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in x], np.uint64)
    keys = [[simhash.joined(simhash.pivot_table(f, simhash.references(simhash.KEY_PIVOTS), m)) for f in (x, near)] for m in simhash.unions((1 << 64) - 1, 3)]
    assert np.any([a == b for a, b in keys], axis=0).all()
    assert (np.abs(simhash.pivot_table(x, simhash.references()) - simhash.pivot_table(near, simhash.references())).max(1) <= 3).all()
    assert simhash.discarded(x) > 0.9999 and 0.4 < simhash.discarded(x, pivots=1) < 0.7


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 8), (8, 9), (9, 7), (3, 3)] + [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute_components({x for e in edges for x in e} - {3}, [e for e in edges if e != (3, 3)]).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# embeddings


def brute_vectors(data, limit=0.95):
    good = [(k, np.array(e, float)) for k, (_, e) in enumerate(data) if e is not None and None not in e and len(e) and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float))]
    lengths = Counter(len(e) for _, e in good)
    dim = max(lengths, key=lambda n: (lengths[n], n))
    good = [(k, e) for k, e in good if len(e) == dim]
    x = np.array([e for _, e in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= limit
    np.fill_diagonal(hit, False)
    n = dict(zip((k for k, _ in good), hit.sum(1).tolist(), strict=True))
    part = brute_components(range(len(data)), [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(hit), strict=True)])
    groups = defaultdict(list)
    for k in range(len(data)):
        groups[part[k]].append(data[k][0])
    least = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return sorted(((i, n.get(k, 0), least[part[k]], i is not None and i == least[part[k]]) for k, (i, _) in enumerate(data)), key=repr)


def test_vectors(spark, sf):
    base = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    rng = np.random.default_rng(3)
    near = [(9000 + k, (np.array(base[0][1]) + rng.normal(0, 0.02, 64)).tolist()) for k in range(200)]
    same = [(9500 + k, base[1][1]) for k in range(50)]
    bad = [(9900, None), (9901, [0.0] * 64), (9902, [float("nan")] * 64), (9903, [1.0, None] * 32), (9904, [1.0, 0.0]), (9905, []), (9906, [float("inf")] * 64), (9907, base[2][1]), (9907, base[2][1]), (None, base[3][1])]
    for data in (base, base + near + same + bad):
        frame = spark.createDataFrame([(i, e, 1, 2) for i, e in data], "vec_id long, embedding array<float>, label int, node long")
        data = [(r.vec_id, r.embedding) for r in frame.collect()]
        got, want = rows(vectors.link_vectors(frame), "vec_id", "n_links", "component_id", "kept"), brute_vectors(data)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
        if data is not base:
            assert [g for g in got if g[0] is None or g[0] >= 9900] == [w for w in want if w[0] is None or w[0] >= 9900]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.link_vectors(empty).count() == 0
    alone = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert rows(vectors.link_vectors(alone), "vec_id", "n_links", "component_id", "kept") == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pairs_without_links_in_the_sample(spark, monkeypatch):
    """Rare pairs at the threshold of which neither codebooks nor sampled queries see any; many small cells."""
    monkeypatch.setattr(vectors, "PER_CELL", 4)
    monkeypatch.setattr(vectors, "FIT_ROWS", vectors.RECALL_QUERIES)
    rng = np.random.default_rng(5)
    x = vectors.unit(rng.normal(size=(5_000, 64)))
    one = vectors.unit(rng.normal(size=(400, 64)))
    r = rng.normal(size=one.shape)
    r = vectors.unit(r - (r * one).sum(1)[:, None] * one)
    two = 0.951 * one + np.sqrt(1 - 0.951**2) * r
    data = [(i, e) for i, e in enumerate([*x.tolist(), *one.tolist(), *two.tolist()])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    h = {r.vec_id: r.h for r in frame.select("vec_id", F.xxhash64("embedding").alias("h")).collect()}
    last = sorted(h[i] for i in range(5_000))[vectors.RECALL_QUERIES]
    unseen = [k for k in range(400) if min(h[5_000 + k], h[5_400 + k]) > last]
    assert len(unseen) > 100
    pairs = [5_000 + k for k in unseen] + [5_400 + k for k in unseen]
    got = vectors.link_vectors(frame.where(F.col("vec_id").isin([*range(5_000), *pairs]))).where(F.col("vec_id").isin(pairs)).select("n_links").collect()
    assert sum(r.n_links > 0 for r in got) >= 0.97 * len(pairs)


def test_cell_rank():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    order = vectors.multi_sequence(a[None], b[None], 63)[0]
    assert [vectors.cell_rank(a, b, *divmod(cell, 7)) for cell in order] == list(range(1, 64))


def test_multi_sequence_is_nearest_first():
    rng = np.random.default_rng(1)
    a, b = rng.random((40, 9)), rng.random((40, 7))
    for n in (1, 5, 30, 63):
        got = vectors.multi_sequence(a, b, n)
        for row, p, q in zip(got, a, b, strict=True):
            assert row.tolist() == sorted(range(63), key=lambda c: p[c // 7] + q[c % 7])[:n]
    assert vectors.multi_sequence(a, b, 999).shape == (40, 63)


def test_crowded_cell(spark, monkeypatch):
    """One cell of many tiles: near copies of one vector, all linked with each other."""
    monkeypatch.setattr(vectors, "TILE", 37)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(0, 0.01, (300, 16)), rng.normal(size=(100, 16))])
    got = vectors.link_vectors(spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")).where("vec_id < 300").collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)} and min(r.measured_recall for r in got) >= 0.9


# toxicity


def test_toxicity_held_out(spark):
    d, y = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    machine = toxicity.fit(d, y)
    got = toxicity.toxicity(d, machine).join(y, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in d.where(toxicity.held_out(F.col("doc_id"))).select("doc_id").collect())
    pos, neg = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.85
    assert sum(s >= 0.7 for s in neg) <= 0.03 * len(neg)


def brute_score(machine, text):
    at = toxicity.places_of(text, {})
    z = machine.w0 + sum(machine.w[i] for i in at)
    z += sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(at) for j in at[:k])
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_machine_learns_pairs(spark):
    """Learned by fit from texts: two terms tell nothing alone, both or neither of them mean toxic; no additive weights separate that."""
    rng = np.random.default_rng(2)
    data, labels = [], []
    for i in range(6000):
        a, b = rng.integers(0, 2, 2)
        words = [f"filler{k}" for k in rng.choice(200, 8, replace=False)] + ["insult"] * a + ["group"] * b
        data.append((i, " ".join(rng.permutation(words))))
        labels.append((i, 0, int(a == b)))
    d, y = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(d, y)
    got = toxicity.toxicity(d, machine).join(y, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((r.score > 0.5) == r.toxic for r in got) > 0.95 * len(got)
    texts = dict(data)
    assert all(abs(brute_score(machine, texts[r.doc_id]) - r.score) < 1e-5 for r in got[:300])


def test_sample_is_bounded(spark, sf, docs):
    y = table(spark, sf, "labels")
    few = toxicity.fit(docs.unionByName(docs), y, max_train=5, max_terms=150)
    assert few is None or (few.w == 0).all()
    one, two = toxicity.fit(docs, y), toxicity.fit(docs.unionByName(docs), y)
    assert one.w0 == two.w0 and (one.w == two.w).all()  # repeated rows are learned from once


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 0, 0), (None, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    for m in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.limit(0)), toxicity.fit(none, labels)):
        got = toxicity.toxicity(odd, m, keep=("row", "score")[:1]).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and {r.row for r in got} == {"r"}
        assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
        assert toxicity.toxicity(none, m).count() == 0


# lines


def brute_lines(data):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = defaultdict(set)
    for i, t in data:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t in data:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or len(held[key(x)]) < 3 or i == max(held[key(x)])]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_hot", [1_000, 100, 0])
def test_lines(odd, docs, none, most_hot, monkeypatch):
    monkeypatch.setattr(lines, "MOST_HOT", most_hot)
    for d in (odd, docs):
        assert rows(lines.drop_lines(d), "doc_id", "kept", "n_lines", "n_dropped") == brute_lines(each(d))
    assert lines.drop_lines(none).count() == 0
    assert set(lines.drop_lines(odd).select("row.*").columns) == set(odd.columns)


# packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_packing(odd, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    for d in (odd, docs):
        want = Counter()
        for i, x in each(d):
            want[i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])] += 1
        out = packing.pack(d, JSON, RANKS, public_tokenizers.PATTERN).collect()
        out.sort(key=lambda r: (r.sequence_id, r.offset))
        docs_, at = Counter(), 0
        ids: list[int] = []
        for r in out:
            assert (r.sequence_id, r.offset) == divmod(at, 2048) and r.length == len(r.ids) and r.start == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
            ids += r.ids
            if len(ids) == r.doc_tokens:
                docs_[r.doc_id, tuple(ids)] += 1
                ids = []
        assert not ids and docs_ == want
    assert packing.pack(none, JSON).count() == 0


@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60) | st.text(max_size=20) | st.just("a <|endoftext|> b"))
@settings(deadline=None, max_examples=400)
def test_fast_encoder_gives_the_same_ids(text):
    assert packing.encode(text, JSON, RANKS, public_tokenizers.PATTERN) == packing.exact_tokenizer(JSON).encode(text, add_special_tokens=False).ids
