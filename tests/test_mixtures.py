"""k-means|| seeds and mixtures of every kind of covariance against plain numpy."""

import numpy as np
import pytest

from plumage.operators import kernels as K
from plumage.operators import models
from plumage.plans import fixtures as X


def clouds(spark, n=600, d=3, k=4):
    rng = np.random.default_rng(8)
    means = rng.normal(0, 6, (k, d))
    turn = rng.normal(0, 1, (k, d, d))
    x = np.concatenate([means[i] + rng.normal(0, 1, (n // k, d)) @ turn[i] for i in range(k)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5), x, means


def step(x, m, reg=1e-6):
    """The plain formulas, around the new means."""
    kind, (k, d) = K.covariance_kind(m), m["mean"].shape
    covs = {"full": lambda: m["var"], "tied": lambda: np.tile(m["shared"], (k, 1, 1)), "diag": lambda: np.stack([np.diag(v) for v in m["var"]]), "spherical": lambda: np.stack([v * np.eye(d) for v in m["var"]])}[kind]()
    log = np.stack([np.log(w) - 0.5 * (np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(c), x - mu) + np.linalg.slogdet(2 * np.pi * c)[1]) for w, mu, c in zip(m["weight"], m["mean"], covs, strict=True)], axis=1)
    top = np.logaddexp.reduce(log, axis=1)
    g = np.exp(log - top[:, None])
    n = g.sum(axis=0)
    mean = g.T @ x / n[:, None]
    full = np.stack([(g[:, i, None] * (x - mean[i])).T @ (x - mean[i]) / n[i] for i in range(k)])
    diag = np.stack([np.diag(f) for f in full])
    out = {"weight": n / len(x), "mean": mean}
    if kind == "tied":
        return out | {"shared": np.einsum("k,kij->ij", n, full) / len(x) + reg * np.eye(d)}, top.mean()
    return out | {"var": {"full": full + reg * np.eye(d), "diag": diag + reg, "spherical": diag.mean(axis=1) + reg}[kind]}, top.mean()


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_steps_equal_the_formulas_and_raise_the_likelihood(spark, kind):
    df, x, _ = clouds(spark)
    m = models.gmm_start(df, "x", "id", 4, kind=kind)
    assert K.covariance_kind(m) == kind and np.isclose(m["weight"].sum(), 1)
    lls = []
    for _ in range(4):
        want, ll = step(x, m)
        m, got = models.gmm_step(df, "x", m)
        assert np.isclose(ll, got) and all(np.allclose(m[c], want[c], atol=1e-8) for c in want)
        lls.append(got)
    assert all(b >= a - 1e-9 for a, b in zip(lls[:-1], lls[1:], strict=True))


def test_seeds_find_every_cloud(spark):
    df, x, means = clouds(spark)
    c = models.kmeans(df, "x", models.kmeans_seeds(df, "x", "id", 4))
    assert {int(((c - m) ** 2).sum(axis=1).argmin()) for m in means} == {0, 1, 2, 3}
    best = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert best <= 1.05 * ((x[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_fewer_different_rows_than_seeds_repeats_and_none(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, x array<double>")
    assert np.array_equal(np.unique(models.kmeans_seeds(df, "x", "id", 10), axis=0), [[0, 1], [1, 1], [2, 1]])
    assert len(models.kmeans_seeds(df.where("id < 0"), "x", "id", 3)) == 0
    m = models.gmm_fit(df, "x", "id", 3, kind="full", max_iter=5)
    assert np.allclose(np.sort(m["mean"][:, 0]), [0, 1, 2], atol=1e-6)


def test_no_worse_than_a_start_from_rows(spark, small):
    df = X.patches(spark, small).selectExpr("id * 16 + p as key", "x")
    old, new = (models.gmm_fit(df, "x", "key", 4, max_iter=40, start=s)["log_likelihood"] for s in ("rows", "kmeans"))
    assert new >= old - 1e-2
    assert models.gmm_fit(df, "x", "key", 4, max_iter=40, kind="full")["log_likelihood"] >= new - 1e-2
