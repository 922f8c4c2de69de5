"""Toxicity: a convolutional text classifier over hashed words, trained here in numpy.

Words (runs of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased) are hashed into 2^22 buckets. Buckets seen
in enough training documents have an embedding; all others share one that stays zero. Filters of widths 1, 2 and 3 run
over the embeddings, each keeps its greatest value over the whole text, and a logistic unit joins them. Scores depend
on the text alone. Thresholds for a yes-or-no decision are calibrated by language on out-of-sample scores.

Plan: all labelled documents are tokenised on the executors and dealt by a hash of the id to shards of about `rows` documents and `size` bytes.
In each of some rounds every shard trains the model by one pass, and the shards' models are averaged: an embedding over the shards that changed it. The driver holds one model, whose size the buckets bound, and counts of scores; one Arrow pass over all
documents scores them with the broadcast model. Texts are shuffled only where the labels are too many for a broadcast.

Nulls and edge cases: a null or empty text scores what no evidence gives; labels that are null are ignored, a document
labelled twice counts as toxic if one label says so; without labelled rows every score is 0. Null languages and those
without enough labels get the threshold of all. Extra columns are ignored; rows that repeat are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage import scratch
from plumage.llm import common as C
from plumage.operators.blocks import grouped

BUCKET_BITS, DIM, FILTERS, WIDTHS = 22, 8, 6, (1, 2, 3)
TRAIN_ROWS, TRAIN_BYTES, STEPS, MAX_EPOCHS, MIN_DOCS = 6000, 1 << 26, 600, 30, 2
PAD = max(WIDTHS) - 1
#: Words of one step of pooling; bins of scores that calibrate thresholds; embeddings whose products are kept for scoring.
POOLED, BINS, KEPT = 1 << 18, 1 << 16, 1 << 18

_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, first = C.word_hashes(data, offsets, _SEP)
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), first


class Model:
    """row: embedding number of each bucket (0: unknown); e: embeddings; w: filters by width; b, v, c: the rest."""

    def __init__(self, seen: np.ndarray):
        rng = np.random.default_rng(5)
        self.row = np.zeros(1 << BUCKET_BITS, np.int32)
        self.row[seen] = np.arange(1, len(seen) + 1)
        self.e = rng.normal(0, 0.01, (len(seen) + 1, DIM)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.v = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.c = np.float32(-2)

    def tables(self, e: np.ndarray | None = None) -> list[list[np.ndarray]]:
        """Each filter position's contribution of each embedding: scoring is then gathers and sums."""
        return [[(self.e if e is None else e) @ w[j] for j in range(len(w))] for w in self.w]

    @staticmethod
    def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with PAD unknown words behind each document (an empty one is an unknown word), and each document's start
        and end there."""
        n = np.diff(first)
        behind = np.cumsum(PAD + (n == 0))
        before = behind - PAD - (n == 0)
        start = first[:-1] + before
        out = np.zeros(len(rows) + (behind[-1] if len(n) else 0) + PAD, np.int32)
        out[np.arange(len(rows)) + np.repeat(before, n)] = rows
        return out, start, start + np.maximum(n, 1)

    def pooled(self, rows: np.ndarray, first: np.ndarray, tables=None, where: bool = False):
        """(documents, filters) greatest values; where: also the positions that gave them."""
        flat, start, end = self.padded(rows, first)
        if where and len(flat) > POOLED:  # documents one by one, a long one in windows
            return (*self._by_windows(flat, start, end), flat)
        rows = flat
        if tables is None:
            used, rows = np.unique(flat, return_inverse=True)
            tables = self.tables(self.e[used])
        n = int(end[-1])
        bounds = np.stack([start, np.minimum(end, n)], axis=1).reshape(-1)
        values, at = [], []
        for parts in tables:
            act = parts[0][rows[:n]].copy()
            for j in range(1, len(parts)):
                act += parts[j][rows[j : n + j]]
            top = np.maximum.reduceat(act, bounds[:-1] if bounds[-1] >= n else bounds, axis=0)[::2]
            values.append(top)
            if where:
                at.append(np.stack([s + act[s:e].argmax(axis=0) for s, e in zip(start, end, strict=True)]))
        return (np.concatenate(values, axis=1), np.concatenate(at, axis=1), flat) if where else np.concatenate(values, axis=1)

    def _by_windows(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest values of each document and the positions that gave them, POOLED positions at a time."""
        top = np.full((len(start), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        at = np.zeros(top.shape, np.int64)
        for d, (s, e) in enumerate(zip(start, end, strict=True)):
            for i in range(s, e, POOLED):
                j = min(i + POOLED, e)
                used, rows = np.unique(flat[i : j + PAD], return_inverse=True)
                act = np.hstack([sum(p[rows[k : k + j - i]] for k, p in enumerate(parts)) for parts in self.tables(self.e[used])])
                best = act.argmax(axis=0)
                value = act[best, np.arange(len(best))]
                better = value > top[d]
                top[d][better], at[d][better] = value[better], i + best[better]
        return top, at

    def score(self, rows: np.ndarray, first: np.ndarray, tables=None) -> np.ndarray:
        hidden = np.maximum(self.pooled(rows, first, tables) + self.b, 0)
        return 1 / (1 + np.exp(-(hidden @ self.v + self.c).astype(np.float64)))


def known(docs: list[np.ndarray]) -> np.ndarray:
    """Buckets of at least MIN_DOCS documents, in order."""
    heard = np.concatenate([np.unique(d) for d in docs]) if docs else np.zeros(0, np.int32)
    seen, n = np.unique(heard, return_counts=True)
    return seen[n >= MIN_DOCS]


def train(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """docs: bucket numbers of each; y: 0 or 1. Adagrad on the log loss, 32 documents a step, about STEPS steps."""
    m = Model(known(docs))
    passes(m, docs, y, fresh(m), min(MAX_EPOCHS, -(-STEPS * 32 // max(1, len(docs)))))
    return m


def fresh(m: Model) -> list:
    """Sums of squared gradients of [embeddings, *filters, b, v, c] before training."""
    return [*(np.full_like(p, 1e-6) for p in (m.e, *m.w, m.b, m.v)), 1e-6]


def passes(m: Model, docs: list[np.ndarray], y: np.ndarray, sums: list, epochs: int, seed: int = 11) -> None:
    """Trains m, and brings `sums` forward, by so many passes over docs."""
    params, past, past_c = [m.e, *m.w, m.b, m.v], sums[:-1], sums[-1]
    rng, rate = np.random.default_rng(seed), 0.1
    rows = [m.row[d] for d in docs]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), 32):
            own = order[i : i + 32]
            first = np.concatenate([[0], np.cumsum([len(rows[x]) for x in own])])
            top, at, flat = m.pooled(np.concatenate([rows[x] for x in own]), first, where=True)
            hidden = np.maximum(top + m.b, 0)
            p = 1 / (1 + np.exp(-(hidden @ m.v + m.c)))
            g = ((p - y[own]) / len(own)).astype(np.float32)
            gv, gc = g @ hidden + 1e-5 * m.v, g.sum()
            gh = g[:, None] * m.v[None, :] * (hidden > 0)
            grads = [None, *[np.zeros_like(w) for w in m.w], gh.sum(axis=0), gv]
            touched, by = [], []
            for f in range(gh.shape[1]):
                k, local = f // FILTERS, f % FILTERS
                live = np.flatnonzero(gh[:, f])
                for j in range(WIDTHS[k]):
                    r = flat[at[live, f] + j]
                    grads[1 + k][j, :, local] = gh[live, f] @ m.e[r]
                    touched.append(r)
                    by.append(gh[live, f, None] * m.w[k][j, :, local][None, :])
            r, by = np.concatenate(touched), np.concatenate(by)
            u, inverse = np.unique(r, return_inverse=True)
            ge = np.zeros((len(u), DIM), np.float32)
            np.add.at(ge, inverse, by)
            u, ge = (u[1:], ge[1:]) if len(u) and u[0] == 0 else (u, ge)
            past[0][u] += ge**2
            m.e[u] -= rate * ge / np.sqrt(past[0][u])
            for q, param, grad in zip(past[1:], params[1:], grads[1:], strict=True):
                q += grad**2
                param -= 0.3 * rate * grad / np.sqrt(q)
            past_c += gc**2
            m.c -= np.float32(rate * gc / np.sqrt(past_c))
    sums[-1] = past_c


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1: halfway between two neighbouring scores."""
    at, code = np.unique(score, return_inverse=True)
    return best_cut(at, at, np.bincount(code), np.bincount(code, weights=y))


def best_cut(least: np.ndarray, most: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The same from rising bins of scores: the least and greatest of each, how many, and how many of label 1."""
    least, most, n, hits = (x[::-1] for x in (least, most, n, hits))
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    i = int(np.argmax(f1))
    return float((least[i] + (most[i + 1] if i + 1 < len(most) else 0)) / 2)


def calibrate(bins: dict, least: int = 40) -> dict:
    """Threshold by language and, under None, of all, from bins as best_cut() takes them. With fewer than `least` positives a threshold leans
    on the more general one: a language's on that of all, that of all on 0.5."""

    def blend(own: tuple, general: float) -> float:
        n = own[3].sum()
        weight = min(1.0, n / least)
        return float(weight * best_cut(*own) + (1 - weight) * general) if n else general

    out = {None: blend(bins[None], 0.5)}
    return out | {x: blend(own, out[None]) for x, own in bins.items() if x is not None}


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.string_bytes(batch.column(0))
        for i, j in C.steps(offsets):
            b, first = buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(b)), *(c.slice(i, j - i) for c in batch.columns[1:])],
                names=["buckets", *batch.schema.names[1:]],
            )


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[Model | None, dict]:
    """The model and the thresholds by language, from all labelled documents, in shards of about `rows` of them and `size` bytes. Rows that
    repeat an id count once, the least by text."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string")).join(chosen, "doc_id")
    # the bucket numbers in place of the texts, with a digest that tells which of the rows of an id is the first
    named = texts.select("text", "doc_id", "lang", "toxic", F.sha2("text", 256).alias("digest"))
    got = C.map_arrow(named, _tokenise, "buckets array<int>, doc_id long, lang string, toxic int, digest string")
    first = F.min(F.struct("digest", "lang", "toxic", "buckets")).alias("r")
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(5)) == 4  # a fifth is not seen by the model that sets the thresholds
    sample = C.materialize(got.groupBy("doc_id").agg(first).select("doc_id", "r.lang", "r.toxic", "r.buckets", part.alias("rest")))
    n, words = sample.agg(F.count("*"), F.sum(F.size("buckets").cast("long"))).first()
    if not n:
        return None, {None: 0.5}
    shards = max(1, -(-n // rows), -(-(words or 0) * 4 // size))
    seen = [train_shards(sample, n, shards), train_shards(sample.where("not rest"), n * 4 // 5, shards)]
    return seen[0], calibrate(_score_bins(sample.where("rest"), seen[1]))


def _seen(sample: DataFrame) -> np.ndarray:
    """Buckets of at least MIN_DOCS documents: at most as many as there are."""
    heard = sample.select(F.explode(F.array_distinct("buckets")).alias("b")).groupBy("b").count().where(F.col("count") >= MIN_DOCS)
    return np.sort(heard.select(F.col("b").cast("int")).toArrow().column(0).to_numpy()).astype(np.int32)


def train_shards(sample: DataFrame, n: int, shards: int) -> Model:
    """The model of all rows (doc_id, buckets, toxic), about n in all. A single shard makes all its passes at once, as train() does; the models
    of several are averaged after each pass. Passes are as many as take about STEPS steps in a shard."""
    seen = _seen(sample)
    m = Model(seen)
    sums = fresh(m)
    epochs = min(MAX_EPOCHS, max(1, -(-STEPS * 32 // max(1, n // shards))))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int").alias("shard")
    own = sample.select(shard, "doc_id", "toxic", "buckets").repartition(shards, "shard").sortWithinPartitions("shard", "doc_id")
    for turn, count in enumerate([1] * epochs if shards > 1 else [epochs]):
        shared = sample.sparkSession.sparkContext.broadcast((m, sums))
        _average(own.mapInArrow(grouped(1, _shard(shared, count, 11 + turn)), "row int, v array<float>, n long"), m, sums)
        shared.unpersist()
    return m


def _shard(shared, epochs: int, seed: int):
    """One shard's model after training, as rows: -1 for filters and the rest, others for the embeddings that changed; v is values, then
    sums of squared gradients."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        start, sums = shared.value
        m = Model.__new__(Model)
        m.row, m.e, m.w, m.b, m.v, m.c = start.row, start.e.copy(), [w.copy() for w in start.w], start.b.copy(), start.v.copy(), start.c
        past = [*(p.copy() for p in sums[:-1]), sums[-1]]
        lists = pc.fill_null(t.column("buckets").combine_chunks(), [])
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        docs = [flat[offsets[i] : offsets[i + 1]] for i in range(len(t))]
        passes(m, docs, t.column("toxic").to_numpy().astype(np.float64), past, epochs, seed)
        changed = np.flatnonzero((past[0] != sums[0]).any(axis=1))
        rest = np.concatenate([*(x.ravel() for x in (*m.w, m.b, m.v)), [m.c], *(x.ravel() for x in past[1:-1]), [past[-1]]]).astype(np.float32)
        yield _vectors(np.array([-1]), rest[None], len(t))
        for i in range(0, len(changed), 1 << 14):
            at = changed[i : i + (1 << 14)]
            yield _vectors(at, np.hstack([m.e[at], past[0][at]]), len(t))

    return run


def _vectors(row: np.ndarray, v: np.ndarray, n: int) -> pa.RecordBatch:
    offsets = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), lists, pa.array(np.full(len(row), n))], names=["row", "v", "n"])


def _average(models: DataFrame, m: Model, sums: list) -> None:
    """m and sums become the means over the shards, by their documents."""
    mean = lambda width: F.array(*[(F.sum(F.get("v", F.lit(i)).cast("double") * F.col("n")) / F.sum("n")).cast("float") for i in range(width)]).alias("v")
    models = scratch.written(models)
    parts = [*m.w, m.b, m.v]
    width = sum(p.size for p in parts) + 1
    rest = models.where("row < 0").groupBy().agg(mean(2 * width)).first().v
    if rest is None:
        return
    rest = np.array(rest, np.float32)
    for k, targets in ((0, parts), (width, sums[1:-1])):
        for p in targets:
            p[...] = rest[k : k + p.size].reshape(p.shape)
            k += p.size
    m.c, sums[-1] = np.float32(rest[width - 1]), float(rest[2 * width - 1])
    got = models.where("row >= 0").groupBy("row").agg(mean(2 * DIM)).toArrow()
    if len(got):
        at, v = got.column("row").to_numpy(), got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM)
        m.e[at], sums[0][at] = v[:, :DIM], v[:, DIM:]


def _score_bins(rows: DataFrame, model: Model) -> dict:
    """Scores of labelled rows counted in BINS bins: by language, and under None all."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lists = pc.fill_null(b.column(0), [])
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            for i, j in C.steps(offsets - offsets[0], POOLED):
                score = m.score(m.row[flat[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(score)], names=["lang", "toxic", "score"])

    scored = C.map_arrow(rows.select("buckets", "lang", "toxic"), run, "lang string, toxic int, score double")
    counts = scored.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n"), F.sum("toxic").alias("hits")
    ).toPandas()
    over = counts.groupby("bin").agg(least=("least", "min"), most=("most", "max"), n=("n", "sum"), hits=("hits", "sum")).reset_index()
    arrays = lambda f: tuple(f.sort_values("bin")[c].to_numpy() for c in ("least", "most", "n", "hits"))
    return {None: arrays(over), **{x: arrays(f) for x, f in counts.groupby("lang") if x is not None}}


def _scorer(shared, thresholds: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model and len(model.e) <= KEPT else None
        for batch in batches:
            data, offsets = C.string_bytes(batch.column(1))
            lang = batch.column(2).to_pylist()
            cut = np.array([thresholds.get(x, thresholds[None]) for x in lang])
            for i, j in C.steps(offsets):
                score = np.zeros(j - i)
                if model:
                    b, first = buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    score = model.score(model.row[b], first, tables)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array(cut[i:j]), pa.array(score >= cut[i:j])],
                    names=["doc_id", "score", "threshold", "toxic"],
                )

    return run


def score(docs: DataFrame, model: Model | None, thresholds: dict) -> DataFrame:
    """(doc_id, score, threshold, toxic), one row per row of docs; the threshold is the language's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    return C.map_arrow(texts, _scorer(shared, thresholds), "doc_id long, score double, threshold double, toxic boolean")


def held_out(doc_id: str):
    """Whether a document is kept from training; one without an id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, thresholds = fit(docs, labels.where(~held_out("doc_id")))
    out = score(docs, model, thresholds)
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the threshold of their language calls toxic. The decision is joined to the rows in the
    scoring pass itself, so texts are not shuffled."""
    model, thresholds = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            three = pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text", "lang")], names=["doc_id", "text", "lang"])
            keep = [~b.column("toxic").to_numpy(zero_copy_only=False) for b in _scorer(shared, thresholds)(iter([three]))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return C.map_arrow(docs, run, docs.schema)
