"""Vectors of several lengths: each length is linked among itself."""

from reviewlake.llm import vectors


def test_each_length_is_linked(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.01]), (5, [0.0, 1.0, 0.0]), (6, [2.0]), (7, [5.0]), (8, [-1.0]), (9, None), (10, []), (11, [0.0, 0.0]), (12, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.link_vectors(df).collect()}
    alone = {k: (0, k, True) for k in (5, 8, 9, 10, 11, 12)}
    assert got == alone | {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 6: (1, 6, True), 7: (1, 6, False)}
