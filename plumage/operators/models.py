"""Fitting: principal components, Gaussian mixtures, mixtures of linear regressions, conditional regressions.

Each iteration is one pass that sums fixed-size statistics; models are small arrays on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.operators import blocks as B
from plumage.operators import encode as E
from plumage.operators import kernels as K
from plumage.operators import sampling


# ---------------------------------------------------------------- principal components


def moments(df: DataFrame, vec: str, d: int) -> dict:
    """n, sum and sum of outer products; two tables' moments add up, in any order and any batches."""
    v = E.total(df, [vec], lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), 1 + d + d * d)
    return {"n": float(v[0]), "sum": v[1 : 1 + d], "outer": v[1 + d :].reshape(d, d)}


def merge_moments(a: dict | None, b: dict) -> dict:
    return b if a is None else {k: a[k] + b[k] for k in b}


def pca(m: dict, start: int = 0, n: int | None = None) -> dict:
    """Mean, components [start, start + n), their variances and all variance ratios; signs make each component's
    largest loading positive."""
    mean = m["sum"] / m["n"]
    cov = (m["outer"] - m["n"] * np.outer(mean, mean)) / (m["n"] - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    band = slice(start, None if n is None else start + n)
    return {"mean": mean, "components": vectors[:, band].T, "variance": values[band], "ratio": values / values.sum()}


def pca_transform(df: DataFrame, model: dict, vec: str, out: str = "projected", whiten: bool = True) -> DataFrame:
    by = model["components"].T / (np.sqrt(model["variance"]) if whiten else 1.0)
    return E.add_columns(df, [vec], [out], lambda x: ((x - model["mean"]) @ by,))


def variance_summary(model: dict) -> dict:
    return {"total": float(model["ratio"].sum()), "top10": float(model["ratio"][:10].sum())}


# ---------------------------------------------------------------- mixtures


#: Rounds of k-means||, rows drawn in each as a multiple of k, and rounds of k-means after it.
SEED_ROUNDS, OVERSAMPLE, MEANS_ROUNDS = 4, 2, 5


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, in blocks of centres so that no (N, K, D) array is made."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None], 0)


def kmeans_seeds(df: DataFrame, vec: str, key: str, k: int, seed: int = 42, rounds: int = SEED_ROUNDS, oversample: int = OVERSAMPLE) -> np.ndarray:
    """k starting centres by k-means||, fewer if there are fewer different rows.

    From one row, each round draws every row with a chance of its share of the squared distances to the centres so far, times
    oversample * k, by a hash of its key; the driver gets about rounds * oversample * k rows. They are weighted by the rows
    nearest to them and reduced to k by k-means++ and k-means over the weights."""
    rows = df.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("x")).where("x is not null")
    first = sampling.exact_sample(rows, 1, "key", seed).collect()
    if not first:
        return np.zeros((0, 0))
    c = np.array([first[0].x])
    for turn in range(rounds):
        cost = E.total(rows, ["x"], lambda x, c=c: np.array([_squared(x, c).min(axis=1).sum()]), 1)[0]
        if cost <= 0:
            break
        u = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(turn)), F.lit(1 << 53)) / F.lit(float(1 << 53))

        def draw(batches, c=c, rate=oversample * k / cost):
            for b in batches:
                if b.num_rows:
                    near = _squared(B.column(b.column(0)), c).min(axis=1)
                    yield b.filter(pa.array(b.column(1).to_numpy() < rate * near))

        drawn = rows.select("x", u.alias("u")).mapInArrow(draw, "x array<double>, u double").select("x").collect()
        c = np.unique(np.vstack([c, *[np.array([r.x]) for r in drawn]]), axis=0)
    weight = E.total(rows, ["x"], lambda x: np.bincount(_squared(x, c).argmin(axis=1), minlength=len(c)).astype(float), len(c))
    return _reduced(c[weight > 0], weight[weight > 0], k, np.random.default_rng(seed))


def _reduced(c: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres of weighted points: k-means++, then k-means."""
    chosen = [int(weight.argmax())]
    near = _squared(c, c[chosen]).min(axis=1)
    while len(chosen) < min(k, len(c)) and (near * weight).sum() > 0:
        chosen.append(int(rng.choice(len(c), p=near * weight / (near * weight).sum())))
        near = np.minimum(near, _squared(c, c[chosen[-1:]])[:, 0])
    out = c[chosen]
    for _ in range(20):
        own = _squared(c, out).argmin(axis=1)
        n = np.bincount(own, weight, len(out))
        sums = np.stack([np.bincount(own, weight * c[:, j], len(out)) for j in range(c.shape[1])], axis=1)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], out)
    return out


def kmeans(df: DataFrame, vec: str, centres: np.ndarray, rounds: int = MEANS_ROUNDS) -> np.ndarray:
    """Centres after so many rounds of k-means; each is one pass, and a centre without rows stays."""
    k, d = centres.shape

    def stats(x, c):
        own = _squared(x, c).argmin(axis=1)
        return np.concatenate([np.bincount(own, minlength=k), *[np.bincount(own, x[:, j], k) for j in range(d)]])

    for _ in range(rounds):
        v = E.total(df, [vec], lambda x, c=centres: stats(x, c), k * (1 + d))
        n, sums = v[:k], v[k:].reshape(d, k).T
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def gmm_start(df: DataFrame, vec: str, key: str, k: int, seed: int = 42, kind: str = "diag", start: str = "kmeans", reg: float = 1e-6) -> dict:
    """A mixture to begin with. "kmeans": k-means from k-means|| seeds, and the weights, means and covariances of its clusters.
    "rows": means are an exact sample of rows, every covariance that of all rows (kinds diag and spherical)."""
    if start == "rows":
        rows = sampling.exact_sample(df.select(key, F.col(vec).cast("array<double>").alias("v")), k, key, seed).collect()
        mean = np.array([r.v for r in rows])
        m = moments(df, vec, mean.shape[1])
        var = np.maximum(np.diag(m["outer"]) / m["n"] - (m["sum"] / m["n"]) ** 2, 1e-6)
        return {"weight": np.full(len(mean), 1 / len(mean)), "mean": mean, "var": np.tile(var, (len(mean), 1)) if kind == "diag" else np.full(len(mean), var.mean())}
    c = kmeans(df, vec, kmeans_seeds(df, vec, key, k, seed))
    hard = lambda x: (np.eye(len(c))[_squared(x, c).argmin(axis=1)], np.zeros(len(x)))
    return _maximised(df, vec, {"mean": c}, kind, hard, reg)[0]


def _maximised(df: DataFrame, vec: str, m: dict, kind: str, expect, reg: float) -> tuple[dict, float]:
    """Weights, means and covariances under expect(x) = (shares, log likelihoods), and the mean log likelihood. Moments are
    taken around the old means, which keeps their precision."""
    mean = m["mean"]
    k, d = mean.shape
    size = {"full": k * d * d, "tied": d * d, "diag": k * d, "spherical": k}[kind]

    def stats(x):
        g, ll = expect(x)
        s0 = g.sum(axis=0)
        s1 = g.T @ x - s0[:, None] * mean
        s2 = np.zeros((d, d)) if kind == "tied" else []
        for i in range(k):
            y = x - mean[i]
            if kind in ("full", "tied"):
                one = (y * g[:, i, None]).T @ y
                s2 = s2 + one if kind == "tied" else [*s2, one]
            else:
                one = g[:, i] @ y**2
                s2.append(one if kind == "diag" else one.sum())
        return np.concatenate([[len(x), ll.sum()], s0, s1.ravel(), np.asarray(s2).ravel()])

    v = E.total(df, [vec], stats, 2 + k + k * d + size)
    n, s0 = v[0], np.maximum(v[2 : 2 + k], 1e-10)
    shift = v[2 + k : 2 + k + k * d].reshape(k, d) / s0[:, None]
    s2, out = v[2 + k + k * d :], {"weight": s0 / n, "mean": mean + shift}
    if kind == "diag":
        out["var"] = s2.reshape(k, d) / s0[:, None] - shift**2 + reg
    elif kind == "spherical":
        out["var"] = (s2 / s0 - (shift**2).sum(axis=1)) / d + reg
    elif kind == "full":
        out["var"] = s2.reshape(k, d, d) / s0[:, None, None] - shift[:, :, None] * shift[:, None, :] + reg * np.eye(d)
    else:
        out["shared"] = (s2.reshape(d, d) - (shift * s0[:, None]).T @ shift) / n + reg * np.eye(d)
    return out, float(v[1] / n)


def gmm_step(df: DataFrame, vec: str, m: dict, reg: float = 1e-6) -> tuple[dict, float]:
    """One turn of expectation-maximisation for a mixture of any kind of covariance (kernels.covariance_kind), and the mean log
    likelihood before it."""
    kind = K.covariance_kind(m)
    inverse = K.whitener(m) if kind in ("full", "tied") else None
    return _maximised(df, vec, m, kind, lambda x: K.softmax(K.log_mixture(x, m, inverse) + np.log(m["weight"] + 1e-300)), reg)


def gmm_fit(
    df: DataFrame, vec: str, key: str, k: int, max_iter: int = 100, tol: float = 1e-3, seed: int = 42, kind: str = "diag", start: str = "kmeans", reg: float = 1e-6,
) -> dict:
    m, last = gmm_start(df, vec, key, k, seed, kind, start, reg), -np.inf
    for _ in range(max_iter):
        m, ll = gmm_step(df, vec, m, reg)
        if abs(ll - last) < tol:
            break
        last = ll
    return m | {"log_likelihood": last}


def gmm_size_mb(m: dict) -> float:
    return 4 * (m["weight"].size + m["mean"].size + m["shared" if "shared" in m else "var"].size) / 2**20


def mlr_from_gmm(g: dict, d_s: int, d_t: int, reg: float = 1e-3) -> dict:
    """A start from a mixture over (s, t): no regression yet."""
    return {
        "weight": g["weight"], "mean_s": g["mean"][:, :d_s], "var_s": g["var"][:, :d_s] + reg, "mean_t": g["mean"][:, d_s:],
        "a": np.zeros((len(g["weight"]), d_t, d_s)), "var_r": g["var"][:, d_s:] + reg,
    }


def mlr_step(df: DataFrame, s: str, t: str, m: dict, reg: float = 1e-3) -> tuple[dict, float]:
    """One turn for a mixture of linear regressions, and the log likelihood before it: a pass for means and
    cross-covariances, one for the residual variances under the new regressions."""
    k, ds, dt = len(m["weight"]), m["mean_s"].shape[1], m["mean_t"].shape[1]

    def first(x, y):
        g, ll = K.joint_posteriors(x, y, m, "add")
        parts = [[len(x), ll.sum()], g.sum(axis=0)]
        for i in range(k):
            xs, ys = x - m["mean_s"][i], y - m["mean_t"][i]
            parts += [g[:, i] @ xs, g[:, i] @ ys, g[:, i] @ xs**2, ((g[:, i, None] * ys).T @ xs).ravel()]
        return np.concatenate(parts)

    v = E.total(df, [s, t], first, 2 + k + k * (2 * ds + dt + ds * dt))
    n, ll, n_k = v[0], float(v[1]), np.maximum(v[2 : 2 + k], 1e-10)
    each = v[2 + k :].reshape(k, -1) / n_k[:, None]
    ms, mt, ss, ts = np.split(each, [ds, ds + dt, 2 * ds + dt], axis=1)
    new = {"weight": n_k / n, "mean_s": m["mean_s"] + ms, "mean_t": m["mean_t"] + mt, "var_s": ss - ms**2 + reg}
    new["a"] = (ts.reshape(k, dt, ds) - mt[:, :, None] * ms[:, None, :]) / new["var_s"][:, None, :]

    def second(x, y):
        g = K.joint_posteriors(x, y, m, "add")[0]
        r = K.textural_residuals(x, y, new)
        return np.einsum("nk,nkd->kd", g, r * r).ravel()

    new["var_r"] = E.total(df, [s, t], second, k * dt).reshape(k, dt) / n_k[:, None] + reg
    return new, ll


def mlr_fit(df: DataFrame, s: str, t: str, start: dict, max_iter: int = 100, tol: float = 1e-4, reg: float = 1e-3) -> dict:
    """Turns until the relative rise of the log likelihood is between 0 and tol; that turn's model is kept."""
    m, last = start, -np.inf
    for turn in range(max_iter):
        m, ll = mlr_step(df, s, t, m, reg)
        rise = (ll - last) / (abs(last) + 1e-10) if turn else np.inf
        last = ll
        if 0 <= rise < tol:
            break
    return m | {"log_likelihood": last}


def structured_to_mlr(weight, mean_s, var_s, mean_t, var_t, cross) -> dict:
    """A joint Gaussian mixture with cross-covariances (K, Dt, Ds) as a mixture of regressions."""
    a = cross / var_s[:, None, :]
    return {"weight": weight, "mean_s": mean_s, "var_s": var_s, "mean_t": mean_t, "a": a, "var_r": np.maximum(var_t - (a * cross).sum(axis=2), 1e-6)}


def mlr_diagnostics(df: DataFrame, s: str, t: str, m: dict) -> dict:
    """Hard assignment counts, R^2 by component (0 below two rows), norms of A, mean residual variances, effective
    number of components."""
    k, dt = len(m["weight"]), m["mean_t"].shape[1]

    def stats(x, y):
        own = K.joint_posteriors(x, y, m)[0].argmax(axis=1)
        r = K.textural_residuals(x, y, m)[np.arange(len(x)), own]
        add = lambda z: np.stack([np.bincount(own, z[:, d], k) for d in range(dt)], axis=1).ravel()
        return np.concatenate([np.bincount(own, minlength=k), add(y), add(y * y), add(r * r)])

    v = E.total(df, [s, t], stats, k + 3 * k * dt)
    n, (sy, sy2, sr2) = v[:k], v[k:].reshape(3, k, dt)
    spread = (sy2 - sy**2 / np.maximum(n, 1)[:, None]).sum(axis=1)
    r2 = np.where(n < 2, 0, np.maximum(0, 1 - sr2.sum(axis=1) / np.maximum(spread, 1e-12)))
    w = np.maximum(m["weight"], 1e-300)
    return {"counts": n, "r2": r2, "norm_a": np.sqrt((m["a"] ** 2).sum(axis=(1, 2))), "mean_var": m["var_r"].mean(axis=1), "effective": float(np.exp(-(w * np.log(w)).sum()))}


# ---------------------------------------------------------------- conditional regressions


def conditional_fit(df: DataFrame, s: str, t: str, gmm: dict, ridge: float = 1e-6) -> dict:
    """For each component, the ridge regression of t on s weighted by p(k | s): one pass of weighted moments. Diagonal
    or spherical variances, or the diagonals of full ones, are taken."""
    if "shared" in gmm:
        raise ValueError("a covariance shared by all components is not supported")
    var = gmm["var"]
    if var.ndim == 3:
        var = np.stack([np.diag(v) for v in var])
    elif var.ndim == 1:
        var = np.tile(var[:, None], (1, gmm["mean"].shape[1]))
    elif var.shape != gmm["mean"].shape:
        raise ValueError("a covariance shared by all components is not supported")
    k, ds = gmm["mean"].shape
    dt = len(df.select(F.col(t)).first()[0])

    def stats(x, y):
        g = K.posteriors(x, gmm["weight"], gmm["mean"], var)
        parts = []
        for i in range(k):
            w, xs = g[:, i], x - gmm["mean"][i]
            parts.append(np.concatenate([[w.sum()], w @ xs, w @ y, ((w[:, None] * xs).T @ xs).ravel(), ((w[:, None] * y).T @ xs).ravel(), w @ (y * y)]))
        return np.concatenate(parts)

    width = 1 + ds + dt + ds * ds + dt * ds + dt
    rows = E.total(df, [s, t], stats, k * width).reshape(k, width)
    a, b, v = np.zeros((k, dt, ds)), np.zeros((k, dt)), np.ones((k, dt))
    for i, row in enumerate(rows):
        w = row[0]
        if w < 1e-10:
            continue
        xs, ys, ss, ts, yy = np.split(row[1:] / w, np.cumsum([ds, dt, ds * ds, dt * ds]))
        css = ss.reshape(ds, ds) - np.outer(xs, xs)
        cts = ts.reshape(dt, ds) - np.outer(ys, xs)
        a[i] = np.linalg.solve((css + ridge * np.eye(ds)).T, cts.T).T
        b[i] = ys - a[i] @ (xs + gmm["mean"][i])
        v[i] = np.maximum(yy - ys**2 - 2 * (a[i] * cts).sum(axis=1) + ((a[i] @ css) * a[i]).sum(axis=1), 1e-10)
    return {"weight": gmm["weight"], "mean_s": gmm["mean"], "var_s": var, "a": a, "b": b, "var_r": v}
