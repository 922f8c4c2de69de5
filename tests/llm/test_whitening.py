import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.llm import whitening as W


def run(spark, rows, kind="double", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"x": F.lit("y"), "component": F.lit(9), "d": F.lit(1)})
    return W.whiten(df, **more).collect()


def check(spark, rows, kind="double", dim=None):
    out = run(spark, rows, kind)
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and len(v) == (dim or len(v)) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(4, len(s))
    assert len(out) == k * len(kept)
    left = {}
    for i, x in kept:
        left.setdefault((i, tuple(x)), 0)
    by_dev = {}
    for i, x in kept:
        by_dev.setdefault((i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))), []).append((np.array(x) - np.array(s) / n) @ vectors[:, :k] / np.sqrt(values[:k]))
    signs = {}
    for r in out:
        want = by_dev[r.vec_id, int(r.deviation_exact)]
        assert r.n == n and r.deviation == int(r.deviation_exact)
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9 and r.identity_error <= 1e-9
        near = [w[r.component - 1] for w in want]
        assert any(abs(abs(r.whitened) - abs(w)) < 1e-7 for w in near)
        if len({round(w, 9) for w in near}) == 1 and abs(near[0]) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * near[0] > 0)
    assert all(len(v) == 1 for v in signs.values())


def test_equals_the_dense_solver(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(0, 1, 6) * [5, 4, 3, 2, 1, 0.5]]) for i in range(200)]
    rows += rows[:50] + [(None, rows[3][1]), (500, None), (501, []), (502, [1.0]), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6), (505, [float("inf")] * 6)]
    check(spark, rows, dim=6)


def test_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows, "float")


def test_few_dimensions_and_no_variance(spark):
    check(spark, [(i, [float(i), float(i * i % 7)]) for i in range(10)])
    out = run(spark, [(1, [1.0, 2.0, 3.0])] * 3)
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(c, 1, 0, None, None, 0.0) for _ in range(3) for c in (1, 2, 3)]
    flat = run(spark, [(i, [float(i), 5.0, 5.0]) for i in range(4)])  # one direction only
    assert {r.component for r in flat if r.whitened is not None} == {1} and abs(flat[0].explained - 1) < 1e-12
    assert run(spark, []) == []


def test_large_entries(spark):
    rows = [(i, [float(i) * 1e14, float(i % 3), -float(i) * 1e9]) for i in range(6)]
    out = run(spark, rows)
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((6 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert all(int(r.deviation_exact) == want[r.vec_id] and r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in out)
    assert all(len(r) == 8 for r in run(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])]))


@pytest.mark.parametrize("n", [7, 1 << 31, 1 << 45])
def test_deviations_limb_by_limb(n):
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (50, 64))
    s = np.array([int(v) * n // 1000 - n for v in rng.integers(-(10**6), 10**6, 64)], object)
    assert W.deviations(x, n, s) == [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


@pytest.mark.parametrize(("d", "rank", "blocks"), [(64, 64, 24), (300, 300, 4), (300, 5, 24), (40, 0, 24), (3, 3, 24), (120, 120, 3)])
def test_block_lanczos(d, rank, blocks):
    rng = np.random.default_rng(d + rank)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectrum = np.zeros(d)
    spectrum[:rank] = np.sort(rng.random(rank))[::-1]
    a = q * spectrum @ q.T
    values, vectors, _ = W.block_lanczos(lambda x: a @ x, d, 4, basis_blocks=blocks)
    assert np.allclose(values, spectrum[:4], atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
