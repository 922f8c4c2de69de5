import numpy as np

from plumage.llm import quality


def test_op7_agrees_with_labels_it_never_saw(spark, small):
    rows = {r.doc_id: r for r in quality.op7(spark, small).collect()}
    assert len(rows) == 1000
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good, bad = [rows[i].kept for i, q in labels.items() if q], [rows[i].kept for i, q in labels.items() if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    bad = np.where(truth[:, None], rng.random((20_000, 8)) < 0.03, rng.random((20_000, 8)) < 0.5)
    codes, n = np.unique(quality.pattern(np.where(bad, quality.BAD, quality.GOOD)), return_counts=True)
    _, chance, prior = quality.expectation_maximisation(codes, n)
    assert abs(prior - 0.8) < 0.02
    assert np.allclose(chance[quality.BAD, :, quality.BAD], 0.5, atol=0.05) and np.allclose(chance[quality.GOOD, :, quality.BAD], 0.03, atol=0.02)


def test_scores_by_plain_loops(spark, small):
    """Score and weak label of every document again, a word at a time and by Bayes' rule over the votes."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m, posterior, prior, chance = fitted = quality.fit(docs)
    for r in quality.score(docs, fitted).collect():
        data = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        votes, words, shapes, _ = quality.read(data, np.array([0, len(data)]))
        total = sum(m.words[w] + m.shapes[s] for w, s in zip(words.tolist(), shapes.tolist(), strict=True)) / max(len(words), 1)
        assert abs(r.score - 1 / (1 + np.exp(-(total + m.bias)))) < 1e-9
        p = [x * np.prod([chance[c, i, v] for i, v in enumerate(votes[0])]) for c, x in ((quality.BAD, 1 - prior), (quality.GOOD, prior))]
        assert abs(r.weak_label - p[1] / sum(p)) < 1e-3  # the posteriors are from the last turn but one
        assert r.kept == (r.score >= quality.THRESHOLD or not len(words))


def test_edge_cases(spark):
    good = "the quick brown fox of the hill ran to an old house and then it was late. "
    rows = [(i, good * 3, "a") for i in range(30)] + [(40, None, "a"), (41, "", "a"), (42, " \n", "a"), (None, good, "a"), (1, good, "b"), (43, "x" * 300_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = quality.score(docs, quality.fit(docs)).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id in (40, 41, 42))
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0))).count() == 0
