"""Quality: a weak-label model teaches a hashed linear scorer.

Eight heuristic labellers look at each text and vote good, bad or nothing. How often each pattern of votes occurs over
all documents is summed in Spark; expectation-maximisation on these counts estimates, for both classes, how often each
labeller gives each vote, and the posterior of each pattern. Posteriors of a bounded sample of documents train a linear
scorer over hashed words, word shapes and repeats; its score decides.

Plan: one Arrow pass for the vote patterns with a partial and a final sum (at most 3^8 patterns reach the driver), one
broadcast join with at most `rows` ids for the sample (at most `size` bytes of text), one Arrow pass for the scores. No shuffle of texts.

Nulls and edge cases: a null, empty or word-less text casts no vote that counts against it, scores the prior and is
kept; extra columns are ignored; rows that repeat are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C

LABELLERS = ("capitals", "marked words", "bars", "repeats", "variety", "word length", "exclamations", "short words")
TRAIN_ROWS, TRAIN_BYTES, BUCKET_BITS, THRESHOLD = 8000, 1 << 26, 17, 0.5
GOOD, BAD, NONE = 1, 0, 2

_UPPER, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK[[ord(c) for c in "*%&$#!|~^@=+<>_\\"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return np.diff(total[offsets])


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes (documents, labellers), hashed words, hashed shapes and each document's first word."""
    start, end, first = C.word_spans(data, offsets)
    words = C.span_hashes(data, start, end)
    n = np.diff(first)
    per_word = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    keyed = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    distinct = np.bincount((keyed[new] >> np.uint64(40)).astype(np.int64), minlength=len(n))
    letters = np.maximum(_per_doc(_LETTER[data], offsets), 1)
    length = np.bincount(doc, end - start, len(n)) / per_word
    shares = [
        (_per_doc(_UPPER[data], offsets) / letters, 0.3, 0.5),
        (np.bincount(doc, _MARK[data[end - 1]], len(n)) / per_word, 0.1, 0.3),
        (_per_doc(data == ord("|"), offsets) / per_word, 0.02, 0.1),
        (np.bincount(doc, again, len(n)) / per_word, 0.05, 0.2),
        (np.where(n >= 50, 1 - distinct / per_word, 0), 0.6, 0.75),
        (length, 10, 14),
        (_per_doc(data == ord("!"), offsets) / per_word, 0.05, 0.2),
        (np.where(n >= 30, 1 - np.bincount(doc, end - start <= 3, len(n)) / per_word, 0), 0.85, 0.95),
    ]
    votes = np.stack([np.where(x > high, BAD, np.where(x < low, GOOD, NONE)) for x, low, high in shares], axis=1)
    votes[n == 0] = NONE
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[start] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    shapes = C.mix(C.span_hashes(shape[keep], place[start], place[end]) + again.astype(np.uint64))
    down = np.uint64(64 - BUCKET_BITS)
    return votes.astype(np.int64), (words >> down).astype(np.int64), (shapes >> down).astype(np.int64), first


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(len(LABELLERS))


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, turns: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, the chance of each vote (class, labeller, vote), and the prior of good.
    Labellers are taken as independent within a class; starts from good documents that draw few bad votes."""
    votes = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    onehot = np.eye(3)[votes]
    chance = np.empty((2, len(LABELLERS), 3))
    chance[GOOD], chance[BAD] = (0.02, 0.88, 0.1), (0.4, 0.5, 0.1)
    prior, w = 0.8, counts.astype(float)
    for _ in range(turns):
        log = np.einsum("plv,clv->pc", onehot, np.log(chance)) + np.log([1 - prior, prior])
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[:, GOOD]
        for c, share in ((GOOD, p), (BAD, 1 - p)):
            seen = np.einsum("p,plv->lv", w * share, onehot) + 0.5 / 3
            chance[c] = seen / seen.sum(axis=1, keepdims=True)
        prior = float(np.clip((w * p).sum() / w.sum(), 0.01, 0.99))
    return p, chance, prior


class Scorer:
    """Logistic regression on the mean weight of a document's words plus that of its shapes."""

    def __init__(self, bias: float):
        self.words, self.shapes = (np.zeros(1 << BUCKET_BITS) for _ in range(2))
        self.bias = bias

    def score(self, words: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        total = np.bincount(doc, self.words[words] + self.shapes[shapes], len(n)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-(total + self.bias)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: float, epochs: int = 5) -> Scorer:
    """docs: hashed words and shapes of each; y: posterior of good. Adagrad, 16 documents a step."""
    m = Scorer(float(np.log(prior / (1 - prior))))
    past, rng = [np.full(1 << BUCKET_BITS, 1e-4) for _ in range(2)], np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), 16):
            own = order[i : i + 16]
            n = np.array([len(docs[x][0]) for x in own])
            first = np.concatenate([[0], np.cumsum(n)])
            both = [np.concatenate([docs[x][k] for x in own]) for k in range(2)]
            g = np.repeat((m.score(*both, first) - y[own]) / np.maximum(n, 1), n)
            for w, q, idx in zip((m.words, m.shapes), past, both, strict=True):
                u, inverse = np.unique(idx, return_inverse=True)
                grad = np.bincount(inverse, g, len(u)) + 1e-5 * w[u]
                q[u] += grad**2
                w[u] -= 0.5 * grad / np.sqrt(q[u])
    return m


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.string_bytes(batch.column(0))
        found = [pattern(read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]) for i, j in C.steps(offsets)]
        codes, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pattern", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.string_bytes(batch.column(1))
        for i, j in C.steps(offsets):
            votes, words, shapes, first = read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (words, shapes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(pattern(votes)), *lists], names=["doc_id", "pattern", "words", "shapes"]
            )


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[Scorer, dict[int, float], float, np.ndarray]:
    """The scorer, the posterior of each vote pattern, the prior and the labellers' chances."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counted = C.map_arrow(texts.select("text"), _votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    if not len(counted):
        return Scorer(0.0), {}, 0.5, np.zeros((2, len(LABELLERS), 3))
    codes, n = (counted.column(c).to_numpy() for c in ("pattern", "n"))
    order = np.argsort(codes)
    p, chance, prior = expectation_maximisation(codes[order], n[order])
    posterior = dict(zip(codes[order].tolist(), p.tolist(), strict=True))
    chosen = texts.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taken = C.bounded_sample(texts, chosen, size).select("doc_id", "text")
    got = C.map_arrow(taken, _features, "doc_id long, pattern long, words array<int>, shapes array<int>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    lists = [got.column(c).combine_chunks() for c in ("words", "shapes")]
    flat, offsets = [x.values.to_numpy() for x in lists], lists[0].offsets.to_numpy() if len(got) else [0]
    sample = [tuple(f[offsets[i] : offsets[i + 1]] for f in flat) for i in order]
    y = np.array([posterior[c] for c in got.column("pattern").to_numpy()[order].tolist()])
    return train(sample, y, prior), posterior, prior, chance


def _scorer(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, posterior, prior = shared.value
        for batch in batches:
            data, offsets = C.string_bytes(batch.column(1))
            for i, j in C.steps(offsets):
                votes, words, shapes, first = read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score = model.score(words, shapes, first)
                weak = np.array([posterior.get(c, prior) for c in pattern(votes).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(weak), pa.array(score), pa.array((score >= threshold) | (np.diff(first) == 0))],
                    names=["doc_id", "weak_label", "score", "kept"],
                )

    return run


def score(docs: DataFrame, fitted, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, weak_label, score, kept), one row per row of docs: posterior of good by the labellers, the scorer's
    probability of good, and whether that reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted[:3])
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return C.map_arrow(texts, _scorer(shared, threshold), "doc_id long, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below the threshold; decided in one pass, so texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs)[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text")], names=["doc_id", "text"])
            keep = [b.column("kept").to_numpy(zero_copy_only=False) for b in _scorer(shared, threshold)(iter([two]))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return C.map_arrow(docs, run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs))
