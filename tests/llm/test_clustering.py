import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.llm import clustering as C


def brute(rows, k, rounds, dim):
    """Plain integers, whole distances, every pair."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [x for _, _, x in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x, x) for i, x in kept if i is not None)[:k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c)) for _, x in kept]
    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    end, fit = assign(), lambda d: d if d < 2**63 else None
    return [(i, j, fit(d), fit(sum(f for f, g in end if g == j)), fit(sum(f for f, _ in end)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, end, strict=True)]


def check(spark, rows, k=5, rounds=3, dim=4, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"cluster": F.lit("x"), "distance": F.lit(1), "label": F.lit(2)})
    got = [tuple(r) for r in C.cluster(df, k, rounds, dim).collect()]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=key) == sorted(brute(rows, k, rounds, dim), key=key)


def test_equals_plain_integers(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, [0.5] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf")] * 4), (905, [0.0] * 4), (906, [-0.0] * 4)]
    check(spark, rows)


def test_ties_repeated_rows_and_more_centroids_than_vectors(spark):
    check(spark, [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(12)])
    check(spark, [(1, [1.0, 2.0, 3.0, 4.0])] * 3, k=40)


def test_vectors_beyond_sixty_four_bits(spark):
    check(spark, [(i, [float(i), -1e9 * i, 1e200 if i % 3 else 1.0, 2.0 ** (i * 10)]) for i in range(20)])


def test_production_parameters_and_floats(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows, 40, 5, 64, "float")


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(None, [1.0] * 64)]):
        assert C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("step", [1, 3, 8, 64])
def test_abandoning_loses_nothing(step):
    rng = np.random.default_rng(step)
    x, c = rng.integers(-4, 5, (500, 16)), rng.integers(-4, 5, (12, 16))
    own, far = C.search(x, c, rng.permutation(16), step)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (own == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
