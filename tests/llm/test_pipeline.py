"""Every stage of the corpus pipeline against a brute-force version, each on its own input."""

import math
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import LINE, SCHEMA, brute_components, brute_lines, brute_score, each, odd_rows

import corpus_pipeline
from reviewlake.llm import mixing, similar, toxicity
from reviewlake.llm.common import table
from reviewlake.llm.substring import WordHashes

STAGES = dict(corpus_pipeline.STAGES)


def full(df):
    return Counter(repr(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def given(spark, sf):
    return {"documents": table(spark, sf, "documents"), "odd": odd_rows(spark), "empty": spark.createDataFrame([], SCHEMA)}


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_toxicity_stage(spark, sf, given, name):
    docs = given[name]
    machine = toxicity.fit(docs, table(spark, sf, "labels"))
    out = STAGES["toxicity"](spark, docs, sf)
    assert out.columns == docs.columns
    want = Counter(repr(tuple(r)) for r in docs.collect() if machine is None or brute_score(machine, r.text) < toxicity.REJECT)
    assert full(out) == want


def test_toxic_documents_go(spark, sf):
    """At a hundredth, where the labels are enough to learn from: toxic documents go, held-out ones too, no labelled clean one does."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    gone = docs.select("doc_id").subtract(STAGES["toxicity"](spark, docs, sf).select("doc_id"))
    got = gone.join(labels, "doc_id").select("doc_id", "toxic", toxicity.held_out(labels["doc_id"]).alias("held_out")).collect()
    assert not [r for r in got if not r.toxic]
    assert {r.held_out for r in got if r.toxic} == {True, False}


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_lines_stage(spark, sf, given, name):
    docs = given[name]
    out = STAGES["line_dedup"](spark, docs, sf)
    assert out.columns == docs.columns
    want = sorted(((i, t) for i, t, _, _ in brute_lines(each(docs))), key=repr)
    got = out.select("doc_id", "text", "n_chars").collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert sum(r.text is None for r in got) == docs.where("text is null").count()
    if name == "odd":
        assert [r.doc_id for r in got if r.doc_id is not None and LINE in (r.text or "")] == [6]


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_simhash_stage(spark, sf, given, name):
    docs = given[name]
    out = STAGES["simhash"](spark, docs, sf)
    assert out.columns == docs.columns
    known = WordHashes()
    sets = {i: similar.shingle_set(t, known) for i, t in each(docs) if i is not None}
    fp = {i: similar.fingerprint(x) for i, x in sets.items()}
    ids = sorted(fp)
    alike = lambda a, b: similar.alike(fp[a], len(sets[a]), fp[b], len(sets[b]), similar.SIMILARITY, similar.RADIUS)
    part = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if alike(a, b)])
    assert full(out) == Counter(repr(tuple(r)) for r in docs.collect() if r.doc_id is None or part[r.doc_id] == r.doc_id)


def test_clashing_columns(spark, sf, given):
    """Columns named like an operator's own change no stage's result and come out as they went in."""
    docs = given["odd"]
    names = ["row", "key", "node", "size", "f0", "component_id", "kept", "score", "mix", "a.b", "my-col", "__id"]
    names = [n for n in names if n not in docs.columns]
    more = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for name in ("toxicity", "line_dedup", "simhash", "mixing"):
        out = STAGES[name](spark, more, sf)
        assert out.columns == more.columns
        rows = out.collect()
        assert all(list(r)[-len(names) :] == names for r in rows)
        if name != "mixing":
            k = len(docs.columns)
            assert Counter(repr(tuple(r)[:k]) for r in rows) == Counter(repr(tuple(r)) for r in STAGES[name](spark, docs, sf).collect())


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_mixing_stage(spark, sf, given, name):
    docs = given[name]
    out = STAGES["mixing"](spark, docs, sf)
    assert out.columns == docs.columns
    before, after = full(docs), full(out)
    assert set(before) == set(after)
    assert all(n <= after[row] <= n * math.ceil(mixing.MAX_REPETITION + 1) for row, n in before.items())


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_packing_stage(spark, sf, given, name):
    from tokenizers import Tokenizer

    docs = given[name]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted((r for r in STAGES["packing"](spark, docs, sf).collect()), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in pieces:
        assert (r.sequence_id, r.offset) == divmod(at, 2048)
        at += r.length
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in each(docs))
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    assert at == sum(n * k for (_, n), k in want.items())


def test_run(spark, sf):
    """The stages one after the other: ids only go, and the packed ids are those that are left."""
    docs = table(spark, sf, "documents")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    left = docs
    for name in ("toxicity", "line_dedup", "simhash"):
        left = STAGES[name](spark, left, sf)
    assert packed == {r.doc_id for r in left.select("doc_id").collect()}
