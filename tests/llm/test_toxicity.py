import numpy as np

from plumage.llm import common as C
from plumage.llm import toxicity


def test_op1_finds_held_out_toxic_documents(spark, small):
    rows = {r.doc_id: r for r in toxicity.op1(spark, small).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    test = [(rows[i].score, t) for i, t in labels.items() if rows[i].held_out]
    hot, cold = [s for s, t in test if t], [s for s, t in test if not t]
    assert np.mean([[(h > c) + (h == c) / 2 for c in cold] for h in hot]) > 0.8


def test_scores_by_plain_loops(spark):
    """The score of every document again, a word and a filter at a time."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["bad", "fine", "day", "sea", "word", "x"], rng.integers(0, 12))), "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int("bad" in t)) for i, t, _ in rows], "doc_id long, toxic int")
    m, cut = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, m, cut).collect():
        data = np.frombuffer(rows[r.doc_id][1].encode(), np.uint8)
        words = [m.row[b] for b in toxicity.buckets(data, np.array([0, len(data)]))[0]]
        hidden = []
        for w in m.w:
            at = range(max(len(words), 1))
            e = [m.e[x] for x in words] + [np.zeros(toxicity.DIM)] * 4
            hidden += [max(sum(float(e[i + j] @ w[j][:, f]) for j in range(len(w))) for i in at) for f in range(toxicity.FILTERS)]
        logit = sum(max(h + b, 0) * v for h, b, v in zip(hidden, m.b, m.v, strict=True)) + m.c
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-4 and r.threshold == cut["en"] and r.toxic == (r.score >= r.threshold)


def test_thresholds_with_ties():
    assert toxicity.best_threshold(np.array([0.9, 0.5, 0.5, 0.1]), np.array([1, 1, 0, 0])) in (0.7, 0.3)
    assert toxicity.best_threshold(np.array([0.5, 0.5, 0.5]), np.array([1, 0, 0])) <= 0.5


def test_sample_is_bounded_and_folds_repeated_ids(spark):
    rows = [(1, "a" * 100), (1, "a" * 100), (2, "b" * 100), (3, "c" * 100), (4, "d" * 5000), (5, None)] + [(6, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, 0) for i in range(1, 7)], "doc_id long, toxic int")
    got = {r.doc_id: r.text for r in C.bounded_sample(docs, chosen, 1 << 14).collect()}
    assert got == {1: "a" * 100, 2: "b" * 100, 3: "c" * 100, 5: "", 6: "t0"}
    assert sum(len(r.text) for r in C.bounded_sample(docs, chosen, 1600).collect()) <= 1600
    assert sum(len(r.text) for r in C.bounded_sample(docs, chosen, 0).collect()) == 0


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 1), (2, "", None, 1), (3, "bad " * 50_000, "xx", 1), (3, "good", "en", 2), (None, "bad", "en", 2)],
        "doc_id long, text string, lang string, score int",
    )
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    model, cut = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model, cut).count() == 5
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    model, cut = toxicity.fit(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs, model, cut).collect()] == [0.0] * 5
    assert toxicity.score(docs.limit(0), model, cut).count() == 0


def test_all_labelled_documents_teach_the_model(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 3)
    rows = [(i, f"odd{i % 60} day sea " + ("bad " * (400 if i == 7 else 1) if i % 3 == 0 else "fine "), "en") for i in range(119)] + [(119, "odd59 " + "long " * 900, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int("bad" in t)) for i, t, _ in rows], "doc_id long, toxic int")
    m, cut = toxicity.fit(docs, labels, rows=40, size=1 << 14)  # the longest text is beyond a sixteenth of size
    data = np.frombuffer(" ".join(f"odd{i}" for i in range(60)).encode(), np.uint8)
    known = m.row[toxicity.buckets(data, np.array([0, len(data)]))[0]]
    assert (known > 0).all() and np.isfinite(m.e).all() and 0 < cut[None] < 1  # before, words of at most 40 documents
    assert {r.doc_id for r in toxicity.score(docs, m, cut).collect()} == set(range(120))


def test_windows_pool_what_whole_documents_do(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 37, 400)]
    m = toxicity.Model(np.arange(40, dtype=np.int32))
    m.e = rng.normal(0, 1, m.e.shape).astype(np.float32)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    rows = m.row[np.concatenate(docs)]
    want = m.pooled(rows, first, where=True)
    monkeypatch.setattr(toxicity, "POOLED", 16)
    top, at, flat = m.pooled(rows, first, where=True)
    assert np.allclose(top, want[0], atol=1e-5) and np.array_equal(at, want[1]) and np.array_equal(flat, want[2])
