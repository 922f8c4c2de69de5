"""Ranking and matching of vectors: top-k, rank of the first correct match, mutual nearest neighbours, ratio test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumage.operators import blocks as B

#: Similarities are compared at so many decimals; equal ones rank by id.
DECIMALS = 9


def similarities(q: dict, c: dict, epsilon: float = 1e-8) -> np.ndarray:
    return np.round(B.units(q["vec"], epsilon) @ B.units(c["vec"], epsilon).T, DECIMALS) + 0.0


def negative_distances(q: dict, c: dict) -> np.ndarray:
    x, y = q["vec"], c["vec"]
    out = np.empty((len(x), len(y)))
    for i in range(0, len(x), 64):
        out[i : i + 64] = -np.sqrt(((x[i : i + 64, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return np.round(out, DECIMALS) + 0.0


class Pairs:
    """Similarities (or negative distances) of a block of queries and one of candidates. `rough` gives a tile of them in single precision,
    increasing with the exact value; `least` turns exact values into what `rough` is at least for these, and `exact` works single pairs out."""

    def __init__(self, q: np.ndarray, c: np.ndarray, distance: bool = False):
        self.distance, dim = distance, q.shape[1]
        if not distance:
            self.q, self.c = B.units(q), B.units(c)
            self.fast, self.shift, x, y, scale = True, None, self.q, self.c, 1.0
            self.slack = np.full(len(q), (dim + 8) * 2.0**-23)
        else:
            self.q, self.c = q, c
            with np.errstate(over="ignore"):
                scale = max(np.linalg.norm(q, axis=1).max(initial=0), np.linalg.norm(c, axis=1).max(initial=0))
            self.fast = bool(1e-100 < scale < 1e100)
            x, y = (q / scale, c / scale) if self.fast else (q, c)
            self.norm, norm = (x * x).sum(axis=1), (y * y).sum(axis=1)
            self.shift, most = (norm / 2).astype(np.float32), np.sqrt(norm.max(initial=0))
            self.slack = 2.0**-22 * (dim + 8) * (np.sqrt(self.norm) * most + most * most) + 1e-30
        self.scale, self.x, self.y = scale, x.astype(np.float32), y.astype(np.float32)

    def rough(self, i: slice, j: slice) -> np.ndarray:
        out = self.x[i] @ self.y[j].T
        return out if self.shift is None else np.subtract(out, self.shift[j], out=out)

    def least(self, i: slice, s: np.ndarray, more: float = 1.0) -> np.ndarray:
        """With `more` = -1: the least that `rough` must be for the exact value to be above s."""
        step = 2 * 10.0**-DECIMALS * more
        if self.distance:
            far = np.maximum(0, step - s) / self.scale
            s, step = (self.norm[i] - far * far) / 2, 0.0
        return (s - step - more * self.slack[i]).astype(np.float32)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for t in B.tiles(len(i), 1 << 16):
            a, b = self.q[i[t]], self.c[j[t]]
            out[t] = -np.sqrt(((a - b) ** 2).sum(axis=1)) if self.distance else np.einsum("ij,ij->i", a, b)
        return np.round(out, DECIMALS) + 0.0

    def dense(self, i: slice, j: slice) -> np.ndarray:
        if self.distance:
            return negative_distances({"vec": self.q[i]}, {"vec": self.c[j]})
        return np.round(self.q[i] @ self.c[j].T, DECIMALS) + 0.0


#: A tile of which more than this share needs exact values is worked out exactly as a whole.
CROWDED = 1 / 32


def nearest(q: dict, c: dict, k: int, distance: bool, out) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, s): for each query its k best candidates, which are sorted by id; out(i, j) says which pairs don't count, of index arrays that
    broadcast. After a first tile only what may reach a query's k-th best in single precision is worked out exactly."""
    good = np.isfinite(q["vec"]).all(axis=1), np.isfinite(c["vec"]).all(axis=1)
    qi, cj = map(np.flatnonzero, good)
    pairs, found = Pairs(q["vec"][qi], c["vec"][cj], distance), []
    for i in B.tiles(len(qi), B.TILE[0]):
        held, kth = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(i.stop - i.start, -np.inf)
        for j in B.tiles(len(cj), B.TILE[1]):
            crowded = not pairs.fast
            if pairs.fast:
                s = pairs.rough(i, j)
                if j.start == 0:
                    s[out(qi[i][:, None], cj[j][None, :])] = -np.inf
                    need = np.full(len(s), -np.inf, np.float32)
                    if k < s.shape[1]:
                        need = (np.partition(s, -k, axis=1)[:, -k] - 2 * pairs.slack[i] - (0 if distance else 4 * 10.0**-DECIMALS)).astype(np.float32)
                        need = np.nextafter(need, np.float32(-np.inf))
                        if distance:  # a tie after rounding is a little farther
                            need = need - np.float32(1e-7) * np.abs(need) - (8 * 10.0**-DECIMALS / pairs.scale * np.maximum(1, np.sqrt(pairs.norm[i]))).astype(np.float32)
                else:
                    need = pairs.least(i, kth)
                a, b = np.nonzero((s >= need[:, None]) & (s > -np.inf))
                crowded = len(a) > max(s.size * CROWDED, 2 * k * len(s))
            if crowded:
                s = pairs.dense(i, j)
                s[np.broadcast_to(out(qi[i][:, None], cj[j][None, :]), s.shape)] = -np.inf
                b = np.argsort(-s, axis=1, kind="stable")[:, :k]
                a = np.repeat(np.arange(len(s)), b.shape[1])
                b = b.reshape(-1)
                s = s[a, b]
            else:
                s = pairs.exact(a + i.start, b + j.start)
            b = b + j.start
            some = (s > kth[a]) & ~np.broadcast_to(out(qi[a + i.start], cj[b]), s.shape)  # candidates come in the order of their ids, so ties come too late
            if not some.any():
                continue
            a, b, s = (np.concatenate([x, y[some]]) for x, y in zip(held, (a, b, s), strict=True))
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            kth[a[place == k - 1]] = s[place == k - 1]
            held = tuple(x[place < k] for x in (a, b, s))
        found.append((qi[held[0] + i.start], cj[held[1]], held[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def steps(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """Distances of all pairs, times scale, as whole numbers. By a matrix product where that is as good as nine decimals, so not where its
    rounding shows: squares below that error, or rounded right at a half, are worked out by differences."""
    n, m = (x * x).sum(axis=1), (y * y).sum(axis=1)
    d = n[:, None] + m[None, :] - 2 * (x @ y.T)
    error = (x.shape[1] + 8) * 2.0**-51 * (n.max(initial=0) + m.max(initial=0))
    close = d < max(error * 1e9, 1e-300)
    d = np.sqrt(np.maximum(d, 0, out=d), out=d)
    if not np.isfinite(error) or np.count_nonzero(close) > close.size * CROWDED:
        d = -negative_distances({"vec": x}, {"vec": y})
    elif close.any():
        i, j = np.nonzero(close)
        d[i, j] = -Pairs(x, y, True).exact(i, j)
    return np.rint(np.multiply(d, scale, out=d), out=d).astype(np.int64)


def _vectors(df: DataFrame, **cols: str) -> DataFrame:
    return df.select(*[F.col(v).cast("array<double>").alias(k) if k == "vec" else F.col(v).alias(k) for k, v in cols.items()])


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", image_col: str | None = None,
    distance: bool = False, keep_self: bool = False,
) -> DataFrame:
    """(query, candidate, similarity, rank): the k best by cosine (or least distance: `similarity` is then its
    negative), without the query itself and, given image_col, without its image; a missing image equals a missing one."""
    cols = {"id": id_col, "vec": vec_col} | ({"image": image_col} if image_col else {})
    q, c = _vectors(queries, **cols), _vectors(candidates, **cols)

    def reduce(q, c):
        order = np.argsort(c["id"], kind="stable")
        c = {n: v[order] for n, v in c.items()}
        a, b = B.codes(q["image"], c["image"]) if image_col else (None, None)

        def out(i, j):
            own = np.False_ if keep_self else q["id"][i] == c["id"][j]
            return own | (a[i] == b[j]) if image_col else own

        i, j, s = nearest(q, c, k, distance, out)
        return {"query": q["id"][i], "candidate": c["id"][j], "similarity": s}

    id_type = dict(q.dtypes)["id"]
    lists = B.compare(q, c, reduce, f"query {id_type}, candidate {id_type}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "candidate")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_match_ranks(df: DataFrame, id_col: str = "id", vec_col: str = "vec", identity_col: str = "identity", image_col: str | None = None) -> DataFrame:
    """(id, rank): for each row as a query, the rank of the best candidate of its identity; null if there is none.

    Two passes over the blocks: the best correct candidate of each query, then how many candidates come before it."""
    cols = {"id": id_col, "vec": vec_col, "identity": identity_col} | ({"image": image_col} if image_col else {})
    rows = _vectors(df, **cols)
    id_type = dict(rows.dtypes)["id"]

    def codes(q, c, name):
        return B.codes(q[name], c[name])

    def barred(q, c):
        """Pairs that don't count: of one image, and of one id."""
        if image_col:
            yield from B.equal_pairs(*codes(q, c, "image"))
        for i, j in B.equal_pairs(*codes(q, c, "id")):
            keep = ~B.alike(q["image"][i], c["image"][j]) if image_col else np.ones(len(i), bool)
            yield i[keep], j[keep]

    def best(q, c):
        order = np.argsort(c["id"], kind="stable")
        c = {n: v[order] for n, v in c.items()}
        pairs, (qi, ci) = Pairs(q["vec"], c["vec"]), codes(q, c, "identity")
        a, b = codes(q, c, "image") if image_col else (None, None)
        top, at = np.full(len(qi), -np.inf), np.zeros(len(qi), np.int64)
        by_q, by_c = np.argsort(qi, kind="stable"), np.flatnonzero(np.isfinite(pairs.c).all(axis=1))
        by_c = by_c[np.argsort(ci[by_c], kind="stable")]  # candidates of an identity by their ids
        for code in np.unique(qi):
            rows, cols = (by[slice(*np.searchsorted(of[by], [code, code + 1]))] for by, of in ((by_q, qi), (by_c, ci)))
            for r in B.tiles(len(rows), B.TILE[0]):
                for t in B.tiles(len(cols), B.TILE[1]):
                    i, j = rows[r], cols[t]
                    bar = q["id"][i][:, None] == c["id"][j][None, :]
                    if image_col:
                        bar |= a[i][:, None] == b[j][None, :]
                    s = pairs.rough(i, j)
                    s[bar] = -np.inf
                    least = np.maximum(s.max(axis=1) - 2 * pairs.slack[i] - 4 * 10.0**-DECIMALS, pairs.least(i, top[i]))
                    near = (s >= least.astype(np.float32)[:, None]) & ~bar
                    if np.count_nonzero(near) > max(s.size * CROWDED, 2 * len(s)):
                        s = pairs.dense(i, j)
                        s[bar] = -np.inf
                        x, y = np.arange(len(s)), s.argmax(axis=1)
                        v = s[x, y]
                    else:
                        x, y = np.nonzero(near)
                        v = pairs.exact(i[x], j[y])
                        order = np.lexsort((y, -v, x))
                        order = order[np.unique(x[order], return_index=True)[1]]
                        x, y, v = x[order], y[order], v[order]
                    better = v > top[i[x]]
                    x, y = i[x[better]], j[y[better]]
                    top[x], at[x] = v[better], y
        good = top > -np.inf
        return {"id": q["id"][good], "similarity": top[good], "candidate": c["id"][at[good]]}

    found = B.compare(rows, rows, best, f"id {id_type}, similarity double, candidate {id_type}")
    found = found.groupBy("id").agg(F.max("similarity").alias("best"), F.min(F.struct((-F.col("similarity")).alias("s"), "candidate"))["candidate"].alias("best_id"))
    known = rows.join(found, "id", "left")

    def before(q, c):
        pairs, count = Pairs(q["vec"], c["vec"]), np.zeros(len(q["id"]), np.int64)
        ahead = lambda s, i, j: (s > q["best"][i]) | ((s == q["best"][i]) & (c["id"][j] < q["best_id"][i]))
        for i in B.tiles(len(count), B.TILE[0]):
            low, high = pairs.least(i, q["best"][i]), pairs.least(i, q["best"][i], -1.0)
            for j in B.tiles(len(c["id"]), B.TILE[1]):
                s = pairs.rough(i, j)
                sure = s > high[:, None]
                near = (s >= low[:, None]) & ~sure
                if np.count_nonzero(near) > s.size * CROWDED:
                    every = np.arange(i.start, i.stop)[:, None], np.arange(j.start, j.stop)[None, :]
                    count[i] += ahead(pairs.dense(i, j), *every).sum(axis=1)
                    continue
                a, b = (x + t.start for x, t in zip(np.nonzero(near), (i, j), strict=True))
                count[i] += np.count_nonzero(sure, axis=1) + np.bincount(a[ahead(pairs.exact(a, b), a, b)] - i.start, minlength=len(s))
        for i, j in barred(q, c):
            count -= np.bincount(i[ahead(pairs.exact(i, j), i, j)], minlength=len(count))
        return {"id": q["id"], "ahead": count}

    q = known.where("best is not null")
    c = rows.withColumn("best", F.lit(None).cast("double")).withColumn("best_id", F.col("id"))
    counts = B.compare(q, c.select(q.columns), before, f"id {id_type}, ahead long").groupBy("id").agg(F.sum("ahead").alias("ahead"))
    return rows.select("id").join(counts, "id", "left").select("id", (F.col("ahead") + 1).alias("rank"))


def reid_metrics(df: DataFrame, **cols) -> DataFrame:
    """One row: top1, top5, top10, mrr over all queries (a query without a correct candidate counts as 0), n_queries;
    all zero for fewer than two rows."""
    ranks = first_match_ranks(df, **cols)
    n = F.count("*")
    share = lambda k: F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0))
    few = lambda x: F.when(n < 2, F.lit(0.0)).otherwise(x)
    return ranks.agg(
        *[few(share(k)).alias(f"top{k}") for k in (1, 5, 10)], few(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0))).alias("mrr"),
        F.when(n < 2, F.lit(0)).otherwise(n).cast("long").alias("n_queries"),
    )


def _best_two(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    return top_k(left, right, k, id_col, vec_col, keep_self=True)


def mutual_nearest(left: DataFrame, right: DataFrame, threshold: float = 0.0, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(i, j, similarity): pairs that are each other's best, at a similarity of the threshold or more."""
    a = _best_two(left, right, id_col, vec_col, 1).select(F.col("query").alias("i"), F.col("candidate").alias("j"), "similarity")
    b = _best_two(right, left, id_col, vec_col, 1).select(F.col("query").alias("j"), F.col("candidate").alias("i"))
    return a.join(b, ["i", "j"]).where(F.col("similarity") >= threshold)


def ratio_test(left: DataFrame, right: DataFrame, ratio: float = 0.75, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(i, j, similarity): best matches above 0 whose runner-up is less than `ratio` of them; none if there is no
    runner-up."""
    two = _best_two(left, right, id_col, vec_col, 2)
    wide = two.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("candidate"))).alias("j"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("similarity"),
        F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"),
    )
    good = (F.col("similarity") > 0) & (F.try_divide("second", "similarity") < ratio)
    return wide.where(good).select(F.col("query").alias("i"), "j", "similarity")


def top_k_matches(left: DataFrame, right: DataFrame, k: int = 1, threshold: float = 0.0, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(i, j, similarity, rank): the k best of each row at a similarity of the threshold or more."""
    best = _best_two(left, right, id_col, vec_col, k).where(F.col("similarity") >= threshold)
    return best.select(F.col("query").alias("i"), F.col("candidate").alias("j"), "similarity", "rank")
