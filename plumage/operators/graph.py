"""Neighbour graphs, their normalised Laplacian and its smallest eigenvectors."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumage import files, scratch
from plumage.functions import vec as V
from plumage.operators import encode as E
from plumage.operators import ranking as R
from plumage.operators.blocks import grouped

#: dense_eigenvectors(), a reference for tests, takes graphs of up to so many nodes (a dense matrix of 8 bytes squared).
DENSE_NODES = 4000
#: Vectors of a block beside the wanted ones; norm of L v - value * v to reach.
GUARD, TOLERANCE = 10, 1e-8
#: Vectors of a block where the graph is small: wide blocks take fewer products, whose cost is then that of starting stages. Larger graphs
#: get as many as keep to so many numbers, but not fewer than GUARD asks for.
BLOCK, BLOCK_CELLS = 64, 1 << 18
#: Entries of a part of the matrix, about; parts at least; products of a block's first and of any round at most.
PART_ENTRIES, PARTS, FIRST_DEGREE, DEGREE = 1 << 17, 4, 14, 32


def knn_edges(df: DataFrame, k: int = 10, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(src, dst), both directions, once each: every row and its k - 1 nearest others (k counts the row itself)."""
    near = R.top_k(df, df, k - 1, id_col, vec_col, distance=True).select(F.col("query").alias("src"), F.col("candidate").alias("dst"))
    return near.union(near.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node")


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, value) of D^-1/2 (D - A) D^-1/2; degrees are at least 1e-10 within the root. The edges, which may be dear, are asked for once."""
    edges = scratch.written(edges.select("src", "dst"))
    d = degrees(edges).select("node", "degree", (1 / F.sqrt(F.greatest(F.col("degree").cast("double"), F.lit(1e-10)))).alias("r"))
    off = edges.where("src <> dst").join(d.toDF("src", "ds", "rs"), "src").join(d.toDF("dst", "dd", "rd"), "dst")
    off = off.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("rs") * F.col("rd")).alias("value"))
    return off.union(d.select(F.col("node"), F.col("node"), F.col("degree") * F.col("r") * F.col("r")))


def dense_eigenvectors(lap: DataFrame, n: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Nodes, eigenvalues and eigenvectors as smallest_eigenvectors() has them, by a dense solver on the driver: the
    reference for tests, used by no query."""
    ids = [r.node for r in lap.select(F.col("i").alias("node")).distinct().orderBy("node").limit(DENSE_NODES + 1).collect()]
    if len(ids) > DENSE_NODES:
        raise ValueError(f"more than {DENSE_NODES} nodes")
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for i, j, v in lap.collect():
        m[at[i], at[j]] += v
    values, vectors = np.linalg.eigh(m)
    vectors = vectors[:, :n] * np.sign(vectors[np.abs(vectors[:, :n]).argmax(axis=0), np.arange(min(n, len(ids)))])
    return ids, values[:n], vectors


def smallest_eigenvectors(lap: DataFrame, n: int, turns: int = 1000) -> DataFrame:
    """(node, vec, eigenvalues): the eigenvectors of the n smallest eigenvalues in rising order; signs are fixed so that the
    largest component is positive (among equal ones, at nine decimals, that of the smallest node). Equal eigenvalues leave
    their vectors free up to rotation.

    Filtered subspaces at every size: rounds apply a Chebyshev polynomial of L to a block of vectors, which damps all that lies above the
    block's largest value so far, and take the best vectors of what comes out by sums of fixed size. Nodes are dealt to parts by a hash; a
    part holds its rows of the block and the columns of L that they meet, and sends each other part its share of a product, so that a
    product is one shuffle and the products of a round are the stages of one job. Blocks are no narrower than n, so that equal eigenvalues
    are all found. At the end L v - value * v is worked out and checked. Raises if `turns` products were not enough. Nothing that
    grows with the graph leaves Spark."""
    spark, old = lap.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        old.append(scratch.place(spark))
        return scratch.written(df, old[-1])

    lap = kept(lap.select("i", "j", "value"))
    parts = max(PARTS, -(-lap.count() // PART_ENTRIES))
    place = lap.groupBy(F.col("i").alias("node")).agg(F.sqrt(F.greatest(F.count_if(F.col("i") != F.col("j")), F.lit(1))).alias("u"))
    place = place.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    place = kept(place.withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1))
    size = place.count()
    n, width = min(n, size), min(size, max(n + GUARD, min(BLOCK, BLOCK_CELLS // max(size, 1))))
    if not size:
        return place.select("node", F.array().cast("array<double>").alias("vec"), F.array().cast("array<double>").alias("eigenvalues"))
    block, high = _matrix_parts(lap, place, parts, kept)
    above, degree, turn, used, left = high / 5, FIRST_DEGREE if width < size else 0, None, 0, np.inf
    while used < turns:
        used += degree + 1
        block = kept(_filtered(block, parts, width, degree, above, high, turn, used))
        for path in old[:-1][2:]:  # what the round was made of; the matrix and the places of its nodes stay until the end
            files.remove(spark, path)
            old.remove(path)
        gram = np.sum([r.gram for r in block.orderBy("part").select("gram").collect()], axis=0).reshape(3, width, width)
        values, turn, left = _best(*gram)
        if len(values) >= n and left[:n].max() <= 1e-6:  # by differences of squares, which tell no more
            left = np.sqrt(_residuals(block, turn[:, :n], values[:n]))
            if left.max() <= TOLERANCE:
                break
        above, degree = _next(values, left, n, above, high)
    else:
        raise RuntimeError(f"no convergence in {used} products: a residual norm of {np.max(left):.1e} is left")
    vectors = block.select("part", "data").mapInArrow(_rows(turn[:, :n]), "part int, pos int, vec array<double>")
    found = scratch.written(vectors.join(place, ["part", "pos"]).select("node", "vec"))
    for path in old:
        files.remove(spark, path)
    largest = lambda i: F.min_by(F.signum(F.col("vec")[i]), F.struct(-F.round(F.abs(F.col("vec")[i]), 9), "node"))
    signs = found.agg(*[largest(i) for i in range(n)]).first()
    signed = F.zip_with("vec", F.array(*[F.lit(float(s)) for s in signs]), lambda v, s: v * s)
    return found.select("node", signed.alias("vec"), F.lit(values[:n].tolist()).cast("array<double>").alias("eigenvalues"))


def _matrix_parts(lap: DataFrame, place: DataFrame, parts: int, kept) -> tuple[DataFrame, float]:
    """(part, data) with the columns of L of each part's nodes, and a bound of its eigenvalues: for any positive u no value is beyond the
    greatest sum over j of |L_ij| u_j / u_i. With u the roots of degrees a normalised Laplacian gets 2."""
    side = lambda a: place.select(*[F.col(c).alias(f"{c}_{a}") for c in ("node", "part", "pos", "u")])
    both = lap.join(side("i"), F.col("i") == F.col("node_i")).join(side("j"), F.col("j") == F.col("node_j"))
    share = (F.abs("value") * F.col("u_j") / F.col("u_i")).alias("share")
    both = kept(both.select(F.col("part_j").alias("part"), F.col("part_i").alias("to"), F.col("pos_i").alias("row"), F.col("pos_j").alias("col"), "value", share))
    high = both.groupBy("to", "row").agg(F.sum("share").alias("s")).agg(F.max("s")).first()[0]
    own = place.select("part", F.lit(-1).alias("to"), F.col("pos").alias("row"), F.col("pos").alias("col"), F.lit(0.0).alias("value"))
    rows = both.drop("share").union(own).repartitionById(parts, "part").sortWithinPartitions("part", "to", "row", "col")

    def build(t: pa.Table):
        to, row, col, value = (t.column(c).to_numpy() for c in ("to", "row", "col", "value"))
        size = int(np.searchsorted(to, 0))  # the part's own nodes come first
        to, row, col, value = to[size:], row[size:], col[size:], value[size:]
        start = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (row[1:] != row[:-1])]) if len(to) else np.zeros(0, int)
        others = np.unique(to)
        matrix = {"size": size, "to": others, "cut": np.append(np.searchsorted(to[start], others), len(start)), "row": row[start], "start": np.r_[start, len(to)], "col": col, "value": value}
        yield _row(t.column("part")[0].as_py(), -1, {"matrix": matrix})

    return kept(rows.mapInArrow(grouped(1, build), PIECES)), high * (1 + 1e-12)


#: Rows that parts send: to `part`, from `source`, or with -1 what a part keeps.
PIECES = "part int, source int, data binary"


def _row(part: int, source: int, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([source], pa.int32()), pa.array([pickle.dumps(data)], pa.binary())], names=["part", "source", "data"])


def _sent(part: int, state: dict, x: np.ndarray):
    """What a part keeps, and for each part the rows of its share of L x."""
    m = state["matrix"]
    yield _row(part, -1, state)
    for to, a, b in zip(m["to"].tolist(), m["cut"][:-1], m["cut"][1:], strict=True):
        start = m["start"][a : b + 1]
        at = slice(start[0], start[-1])
        share = np.add.reduceat(m["value"][at, None] * x[m["col"][at]], start[:-1] - start[0], axis=0)
        yield _row(to, part, (m["row"][a:b], share))


def _received(t: pa.Table, width: int) -> tuple[int, dict, np.ndarray]:
    """A part's number, what it kept, and the sum of the shares, in the order of their parts."""
    source = t.column("source").to_numpy()
    order, data = np.argsort(source), t.column("data")
    state = pickle.loads(data[int(order[0])].as_buffer())
    out = np.zeros((state["matrix"]["size"], width))
    for i in order[1:]:
        row, share = pickle.loads(data[int(i)].as_buffer())
        out[row] += share
    return t.column("part")[0].as_py(), state, out


def _filtered(block: DataFrame, parts: int, width: int, degree: int, above: float, high: float, turn: np.ndarray | None, seed: int) -> DataFrame:
    """(part, source, data, gram): x times the Chebyshev polynomial of L of that degree on [above, high] as y, L y as ly, and the inner products
    of both. x is the block before times `turn`, filled up with random columns."""
    mid, half = (high + above) / 2, (high - above) / 2

    def first(t: pa.Table):
        part, state, _ = _received(t, width)
        x = np.zeros((state["matrix"]["size"], 0)) if turn is None else state["y"] @ turn
        fill = np.random.default_rng([seed, part]).normal(size=(len(x), width - x.shape[1]))
        x = np.hstack([x, fill])
        yield from _sent(part, {"matrix": state["matrix"], "y": x, "before": None}, x)

    def step(t: pa.Table):
        part, state, product = _received(t, width)
        x, before = state["y"], state["before"]
        x, before = ((product - mid * x) / half if before is None else (product - mid * x) * (2 / half) - before), x
        yield from _sent(part, {"matrix": state["matrix"], "y": x, "before": before}, x)

    def last(t: pa.Table):
        part, state, product = _received(t, width)
        y = state["y"]
        row = _row(part, -1, {"matrix": state["matrix"], "y": y, "ly": product})
        yield row.append_column("gram", E.lists(np.stack([y.T @ y, y.T @ product, product.T @ product]).reshape(1, -1)))

    df = block.select("part", "source", "data")
    for run in [first, *[step] * degree]:
        df = df.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(grouped(1, run), PIECES)
    return df.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(grouped(1, last), PIECES + ", gram array<double>")


def _best(gram: np.ndarray, inner: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in rising order, the combinations of y that give their vectors, and estimates of the residuals, from y'y, y'Ly and (Ly)'Ly.
    Directions that the others hold already are left out."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
    w, u = np.linalg.eigh(gram * np.outer(scale, scale))
    good = w > 1e-13 * w.max()
    basis = scale[:, None] * u[:, good] / np.sqrt(w[good])
    small = basis.T @ inner @ basis
    values, v = np.linalg.eigh((small + small.T) / 2)
    turn = basis @ v
    return values, turn, np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, square, turn) - values**2, 0))


def _next(values: np.ndarray, left: np.ndarray, n: int, above: float, high: float) -> tuple[float, int]:
    """Above what the next polynomial damps, and its degree: enough for what is left of the wanted residuals, but no more than keeps the
    block's vectors apart. The block's largest value is damped, unless it is noise still beyond what was damped before."""
    low = float(values[0])
    above = min(float(values[-1]), max(above, float(values[min(n + GUARD // 2, len(values) - 1)])), low + 0.9 * (high - low))
    rate = lambda v: float(np.arccosh(max((high + above - 2 * v) / (high - above), 1 + 1e-12)))
    need = (np.log(max(np.max(left[:n]), TOLERANCE) / TOLERANCE) + 3) / max(rate(values[min(n, len(values)) - 1]), 1e-6)
    return above, int(np.clip(np.ceil(min(need, 16 / rate(low))), 4, DEGREE))


def _residuals(block: DataFrame, turn: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Squares of the norms of L v - value * v."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                state = pickle.loads(data.as_buffer())
                out = ((state["ly"] @ turn - state["y"] @ turn * values) ** 2).sum(axis=0)
                yield pa.RecordBatch.from_arrays([E.lists(out[None])], names=["v"])

    return np.sum([r.v for r in block.select("data").mapInArrow(run, "v array<double>").collect()], axis=0)


def _rows(turn: np.ndarray):
    def run(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                state = pickle.loads(data.as_buffer())
                x = state["y"] @ turn
                pos = np.arange(len(x), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(pos), E.lists(x)], names=["part", "pos", "vec"])

    return run


def angle(a: int, b: int, vec_col: str = "vec"):
    """atan2 of components b and a, counted from 0."""
    return F.atan2(F.col(vec_col)[b], F.col(vec_col)[a])


def polar(vectors: DataFrame) -> DataFrame:
    """(node, theta, radius, x, y) from the first two vectors after the constant one."""
    r = V.norm(F.slice("vec", 2, 2))
    return vectors.select("node", angle(1, 2).alias("theta"), r.alias("radius"), F.col("vec")[1].alias("x"), F.col("vec")[2].alias("y"))


def without_subspace(df: DataFrame, basis: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of X - E (E^T X): the part of the vectors that the orthonormal columns of basis (node, vec) don't span. E^T X, a
    number for each column and dimension, is summed within tasks and goes back to them."""
    rows = df.select(F.col(id_col).alias("node"), F.col(vec_col).alias("x")).join(basis.select("node", F.col("vec").alias("e")), "node")
    head = rows.select(F.size("e").alias("k"), F.size("x").alias("d")).first()
    if head is None:
        return rows.select("node", F.col("x").alias("vec"))
    inner = E.total(rows, ["e", "x"], lambda e, x: (e.T @ x).ravel(), head.k * head.d).reshape(head.k, head.d)
    return E.add_columns(rows, ["e", "x"], ["vec"], lambda e, x: (x - e @ inner,)).select("node", "vec")
