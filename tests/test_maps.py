"""Maps in the plane: shares by perplexity, forces against all pairs, identities of neighbours."""

import math

import numpy as np

from plumage.operators import maps, ranking


def dense(at, p):
    """Gradient over all pairs."""
    d = at[:, None, :] - at[None, :, :]
    q = 1 / (1 + (d * d).sum(axis=2))
    np.fill_diagonal(q, 0)
    return 4 * (((p - q / q.sum()) * q)[:, :, None] * d).sum(axis=1)


def test_shares_have_the_perplexity(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 8)))], "id long, vec array<double>")
    lists = {}
    for r in maps.shares(ranking.top_k(v, v, 30), 10.0).collect():
        lists.setdefault(r.src, []).append(r.p)
    assert len(lists) == 120
    for p in lists.values():
        assert len(p) == 30 and math.isclose(sum(p), 1) and math.isclose(-sum(x * math.log(x) for x in p if x), math.log(10), abs_tol=1e-9)
    pairs = {(r.src, r.dst): r.p for r in maps.affinities(ranking.top_k(v, v, 30), 10.0).collect()}
    assert math.isclose(sum(pairs.values()), 1) and all(math.isclose(p, pairs[b, a]) for (a, b), p in pairs.items())


def test_shares_of_copies_and_of_few(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)] + [(6, [0.0, 0.0])], "id long, vec array<double>")
    got = {(r.src, r.dst): r.p for r in maps.shares(ranking.top_k(v, v, 3), 30.0).collect()}
    assert len(got) == 21 and all(math.isclose(p, 1 / 3) for p in got.values())


def test_forces_equal_all_pairs(spark):
    """On a grid that holds a point a cell; ends with more pairs than a part holds; copies of a place share a cell exactly."""
    rng = np.random.default_rng(2)
    at = np.vstack([rng.normal(size=(80, 2)) * 5, np.full((40, 2), 2.5)])
    p = rng.random((120, 120)) * (rng.random((120, 120)) < 0.2)
    p[0] = 1.0  # an end that has pairs with all
    p = p + p.T
    np.fill_diagonal(p, 0)
    p /= p.sum()
    points = spark.createDataFrame([(i, *x) for i, x in enumerate(at.tolist())], "id long, x double, y double")
    pairs = spark.createDataFrame([(int(a), int(b), float(p[a, b])) for a, b in zip(*p.nonzero())], "src long, dst long, p double")
    for part in (7, maps.PART):
        placed, edges = maps.laid(points, pairs, part)
        found = maps.forces(placed, edges, 1 << 16)
        total = sum(r.push[2] for r in found.collect())
        got = {r.id: (r.gx, r.gy) for r in found.withColumns(maps.gradient(found, total)).collect()}
        assert np.allclose([got[i] for i in range(120)], dense(at, p), atol=1e-12)


def test_neighbours_keep_their_identities(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    label = rng.integers(0, 8, 240)
    x = centres[label] + rng.normal(0, 0.45, (240, 16))
    x[:80] = x[0]  # a third are copies
    label[:80] = label[0]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>")
    odd = spark.createDataFrame([(900, None), (901, []), (902, [float("nan")] * 16), (903, [1.0] * 17), (None, [1.0] * 16)], "id long, vec array<double>")
    at = maps.tsne(v.union(odd), perplexity=10.0, rate=50.0, turns=60)
    at = at.selectExpr("id", "array(x, y) vec")
    assert at.count() == 240

    def kept(df, **how):
        return np.mean([label[r.query] == label[r.candidate] for r in ranking.top_k(df, df, 9, **how).collect()])

    assert kept(at, distance=True) >= kept(v) - 0.05, (kept(at, distance=True), kept(v))


def test_maps_of_few_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    assert maps.tsne(v.limit(0), turns=2).collect() == []
    assert [tuple(r) for r in maps.tsne(v.where("id = 1"), turns=2).collect()] == [(1, 0.0, 0.0)]
    got = maps.tsne(v, turns=3).collect()
    assert sorted(r.id for r in got) == [1, 2] and all(math.isfinite(r.x + r.y) for r in got)
