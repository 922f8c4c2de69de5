"""numpy kernels of mixture models: posteriors, residuals, statistics. Rows of x, s, t are patches; models are plain
arrays: weight (K), mean and var (K, D), a (K, Dt, Ds) and so on."""

from __future__ import annotations

import numpy as np

LOG_2PI = float(np.log(2 * np.pi))


def log_normal(x: np.ndarray, mean: np.ndarray, var: np.ndarray, constant: bool = True) -> np.ndarray:
    """(N, K) log densities of diagonal Gaussians; without the constant, the 2 pi term is left out."""
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        out[:, k] = -0.5 * (((x - mean[k]) ** 2) / var[k]).sum(axis=1)
    return out - 0.5 * (np.log(var).sum(axis=1) + (LOG_2PI * mean.shape[1] if constant else 0.0))


def covariance_kind(m: dict) -> str:
    """Of a mixture: "tied" with one matrix `shared`, else by `var`: "full" (K, D, D), "diag" (K, D) or "spherical" (K)."""
    return "tied" if "shared" in m else {3: "full", 2: "diag", 1: "spherical"}[m["var"].ndim]


def whitener(m: dict) -> np.ndarray:
    """(K, D, D) or (1, D, D): inverses of the Cholesky factors of full or tied covariances."""
    return np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in (m["shared"][None] if "shared" in m else m["var"])])


def log_mixture(x: np.ndarray, m: dict, inverse: np.ndarray | None = None) -> np.ndarray:
    """(N, K) log densities of the components of a mixture of any kind; inverse: whitener(m), if the caller has it."""
    kind, d = covariance_kind(m), m["mean"].shape[1]
    if kind in ("diag", "spherical"):
        return log_normal(x, m["mean"], m["var"] if kind == "diag" else np.tile(m["var"][:, None], (1, d)))
    inverse = whitener(m) if inverse is None else inverse
    out = np.empty((len(x), len(m["mean"])))
    for k, mean in enumerate(m["mean"]):
        w = inverse[k % len(inverse)]
        out[:, k] = -0.5 * (((x - mean) @ w.T) ** 2).sum(axis=1) + np.log(np.diag(w)).sum()
    return out - 0.5 * LOG_2PI * d


def softmax(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each row and the log of its sum."""
    top = log.max(axis=1, keepdims=True)
    e = np.exp(log - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def posteriors(x, weight, mean, var):
    """p(k | x), log weights offset by 1e-10."""
    return softmax(log_normal(x, mean, var, False) + np.log(weight + 1e-10))[0]


def semantic_posteriors(s, m: dict):
    """p(k | s), log weights of at least 1e-10."""
    return softmax(log_normal(s, m["mean_s"], m["var_s"]) + np.log(np.maximum(m["weight"], 1e-10)))[0]


def textural_residuals(s, t, m: dict) -> np.ndarray:
    """(N, K, Dt): t - mean_t - A (s - mean_s)."""
    return np.stack([t - m["mean_t"][k] - (s - m["mean_s"][k]) @ m["a"][k].T for k in range(len(m["weight"]))], axis=1)


def regression_residuals(s, t, m: dict) -> np.ndarray:
    """(N, K, Dt): t - A s - b."""
    return np.stack([t - s @ m["a"][k].T - m["b"][k] for k in range(len(m["weight"]))], axis=1)


def joint_log_likelihood(s, t, m: dict) -> np.ndarray:
    """(N, K): log N(s) + log N(t | s)."""
    r = textural_residuals(s, t, m)
    v = m["var_r"]
    return log_normal(s, m["mean_s"], m["var_s"]) - 0.5 * ((r * r / v).sum(axis=2) + np.log(v).sum(axis=1) + LOG_2PI * v.shape[1])


def joint_posteriors(s, t, m: dict, floor: str = "max"):
    """Shares and log likelihoods of rows under the mixture of regressions; floor: how weights are kept above zero."""
    log_w = np.log(np.maximum(m["weight"], 1e-10)) if floor == "max" else np.log(m["weight"] + 1e-300)
    return softmax(joint_log_likelihood(s, t, m) + log_w)


def residual_posteriors(s, t, m: dict) -> np.ndarray:
    """p(k | s, r) with r of one regression for all components (global_a, global_b)."""
    r = t - s @ m["global_a"].T - m["global_b"]
    log = log_normal(s, m["mean_s"], m["var_s"]) + log_normal(r, m["mean_r"], m["var_r"])
    return softmax(log + np.log(np.maximum(m["weight"], 1e-10)))[0]


def power_unit(v: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    v = np.sign(v) * np.abs(v) ** alpha
    n = np.linalg.norm(v)
    return v / n if n > 1e-10 else v


# ---------------------------------------------------------------- encoders: statistics of some patches, and the vector


class WeightEncoder:
    """[sqrt(N_k / N), sum of g z / sqrt(N_k), sum of g (z^2 - 1) / sqrt(2 N_k)] of each component, one after another;
    zeros for components without mass."""

    inputs = 1

    def __init__(self, weight, mean, var):
        self.weight, self.mean, self.var = weight, mean, var
        self.dim = len(weight) * (2 * mean.shape[1] + 1)

    def stats(self, x):
        g = posteriors(x, self.weight, self.mean, self.var)
        z0 = g.sum(axis=0)
        z1 = g.T @ x - z0[:, None] * self.mean
        z2 = np.stack([g[:, k] @ (x - self.mean[k]) ** 2 for k in range(len(z0))])
        return np.concatenate([z0, z1.ravel(), z2.ravel()])

    def finish(self, total, n):
        k, d = self.mean.shape
        z0, z1, z2 = total[:k], total[k : k + k * d].reshape(k, d), total[k + k * d :].reshape(k, d)
        live = z0 >= 1e-10
        root = np.sqrt(np.where(live, z0, 1))[:, None]
        parts = [np.sqrt(z0 / max(n, 1))[:, None], z1 / np.sqrt(self.var) / root, (z2 / self.var - z0[:, None]) / (np.sqrt(2) * root)]
        return np.where(live[:, None], np.concatenate(parts, axis=1), 0).ravel()


class ImprovedEncoder(WeightEncoder):
    """The improved Fisher vector as published: gradients by weight, mean and variance in blocks, signed square root, unit
    length."""

    def finish(self, total, n):
        k, d = self.mean.shape
        z0, z1, z2 = total[:k] / n, total[k : k + k * d].reshape(k, d) / n, total[k + k * d :].reshape(k, d) / n
        root = np.sqrt(self.weight)
        return power_unit(np.concatenate([
            (z0 - self.weight) / root, (z1 / np.sqrt(self.var) / root[:, None]).ravel(), ((z2 / self.var - z0[:, None]) / (np.sqrt(2) * root[:, None])).ravel()
        ]))


class RegressionEncoder:
    """Gradients of the residuals of a mixture of regressions by mean and variance, in blocks; kind "mlr": posteriors of
    s and t and offsets within the roots; kind "conditional": posteriors of s alone."""

    inputs = 2

    def __init__(self, model: dict, kind: str = "mlr", alpha: float = 0.5):
        self.m, self.kind, self.alpha = model, kind, alpha
        self.dim = 2 * len(model["weight"]) * model["a"].shape[1]

    def stats(self, s, t):
        m = self.m
        if self.kind == "mlr":
            g, r = joint_posteriors(s, t, m)[0], textural_residuals(s, t, m)
            z = r / np.sqrt(m["var_r"] + 1e-10)
        else:
            g, r = posteriors(s, m["weight"], m["mean_s"], m["var_s"]), regression_residuals(s, t, m)
            z = r / np.sqrt(m["var_r"])
        return np.concatenate([np.einsum("nk,nkd->kd", g, z).ravel(), np.einsum("nk,nkd->kd", g, z * z - 1).ravel()])

    def finish(self, total, n):
        w, half = self.m["weight"][:, None], len(total) // 2
        first, second = total[:half].reshape(len(w), -1), total[half:].reshape(len(w), -1)
        if self.kind == "mlr":
            parts = [first / np.sqrt(w + 1e-10), second / np.sqrt(2 * w + 1e-10)]
        else:
            parts = [first / np.sqrt(w + 1e-10), second / (np.sqrt(2) * np.sqrt(w + 1e-10))]
        return power_unit(np.concatenate([p.ravel() for p in parts]), self.alpha)
