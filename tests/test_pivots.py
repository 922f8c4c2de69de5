"""Neighbours by pivots against the comparison of all blocks."""

import numpy as np

from plumage.operators import pivots, ranking


def rows(df):
    return sorted((r.query, r.rank, r.candidate, r.similarity) for r in df.collect())


def test_pivots_skip_cells_and_lose_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.05, (900, 16))
    x[:300] = x[0]  # a third are copies: ties at every place
    x[300], x[301] = 0, x[5] * 1e-9
    data = [(i, v, f"i{i % 7}" if i % 5 else None) for i, v in enumerate(x.tolist())] + [(1000, None, "i1"), (1001, [1.0], "i1"), (1002, [], "i1")]
    df = spark.createDataFrame(data, "id long, vec array<double>, image string")
    whole = df.where("id < 1000")
    for image, keep in ((None, False), ("image", False), (None, True)):
        got = pivots.top_k(df, df, 6, image_col=image, keep_self=keep, block=128, cell=32)
        want = rows(ranking.top_k(whole, whole, 6, image_col=image, keep_self=keep))
        found = rows(got)
        assert [r[:3] for r in found] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in found], [r[3] for r in want], atol=1e-9)
    compared = {r.query: r.compared for r in pivots.top_k(whole, whole, 6, cell=32).select("query", "compared").distinct().collect()}
    assert len(compared) == 900 and np.mean(list(compared.values())) < 450, np.mean(list(compared.values()))


def test_pivots_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    assert rows(pivots.top_k(df, df, 3)) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]
    assert rows(pivots.top_k(df, df.limit(0), 3)) == [] and rows(pivots.top_k(df.limit(0), df, 3)) == []


def test_a_visitor_travels_once_to_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(900, 16)).tolist())], "id long, vec array<double>")
    sent, grouped = spark.sparkContext.accumulator(0), pivots.B.grouped
    want = rows(ranking.top_k(df, df, 6))
    monkeypatch.setattr(pivots.B, "grouped", lambda keys, fn: grouped(keys, lambda t: (sent.add(t.num_rows), fn(t))[1]))
    assert [r[:3] for r in rows(pivots.top_k(df, df, 6, block=128, cell=16))] == [r[:3] for r in want]
    assert sent.value < 20_000, sent.value  # one copy a cell would be 900 * 57
