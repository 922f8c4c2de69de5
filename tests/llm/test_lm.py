import re
import zlib
from collections import Counter

import numpy as np

from plumage.llm import lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return [*WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_op8_base_is_exact_and_the_model_beats_it(spark, small):
    rows = {r.doc_id: split(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = Counter(w for i, ws in rows.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm.op8(spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(w in c for w in ws)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_filter_never_undercounts():
    rng = np.random.default_rng(0)
    code, n = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(1, 500, 5000)
    twice = np.concatenate([np.sort(code), np.sort(code)[:100]])  # some come in two sums
    times = np.concatenate([n[np.argsort(code)], np.full(100, 7)]).astype(np.uint32)
    got = [lm.section_bits([twice[own].tobytes()], [times[own].tobytes()], 4, 1.5) for own in (lm.bucket_of(twice, 1) == s for s in range(2))]
    bucket, bits, top = (sum((b.column(i).to_pylist() for b in got), []) for i in range(3))
    f = lm.Filter(bucket, bits, 4, 1.5, max(top))
    whole = n[np.argsort(code)].copy()
    whole[:100] += 7
    want, got = f.counts[lm.level(whole, 1.5)], f.read(np.sort(code))
    assert (want <= whole).all() and (want > whole / 1.5 - 1).all()
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (f.read(rng.integers(0, 2**64, 10_000, dtype=np.uint64)) == 0).mean() > 0.9


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, False), (2, "", True), (3, "A b\ta", False), (None, "zz", False), (3, "A b\ta", False), (4, "q " * 100_000, True)], "doc_id long, text string, held_out boolean")
    got = lm.score(df, *lm.fit(df.where("not held_out"))).collect()
    assert len(got) == 6 and all(r.train_tokens == 1 + 4 + 2 + 4 for r in got)
    assert [(r.n_tokens, r.n_known) for r in got if r.doc_id == 4] == [(100_001, 1)]
    none = lm.score(df, *lm.fit(df.limit(0))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-9 for r in none)
    assert lm.score(df.limit(0), *lm.fit(df)).count() == 0


def test_all_pairs_count_and_a_shuffled_filter_scores_alike(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    # every word once, in pairs that come once: more words than any list of contexts or of frequent words
    texts = [" ".join(f"w{i * 40 + j}" for j in range(40)) for i in range(500)] + ["the cat the dog"] * 30
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000, "w5 w6 w7", True), (1001, "w7 w5 w60 new w6", True), (1002, "new w1", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(4)
    docs = [split(t) for _, t, h in rows if not h]
    c, pairs = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d[:-1], d[1:], strict=True))
    n, v = sum(c.values()), len(c)
    stands = lambda x: lm.stands(40, lm.BASE)[lm.level(np.array([x]), lm.BASE)[0]] if x else 0.0
    fits = [lm.fit(df.where("not held_out")), lm.fit(df.where("not held_out"), broadcast_bytes=0)]
    assert fits[0][0].filter is not None and fits[1][0].filter is None
    got, other = ({r.doc_id: r.score for r in lm.score(df, *f).collect()} for f in fits)
    assert len(got) == len(other) == len(rows) and all(abs(got[i] - other[i]) < 1e-6 for i in got)
    exact = []
    for i, text, _ in rows:
        ws, want = split(text), 0.0
        for a, w in zip([..., *ws[:-1]], ws, strict=True):
            own = c[a] if a is not ... else 0
            base = (c[w] + 1) / (n + v + 1)
            want += np.log10((stands(pairs[a, w]) + lm.MU * base) / (own + lm.MU))
        assert got[i] > want - 1e-6  # the filter never undercounts
        exact.append(abs(got[i] - want) < 1e-6)
    assert np.mean(exact) > 0.2
    seen, unseen = (lm.score(df.sparkSession.createDataFrame([(1, t, True)], df.schema), *fits[0]).first().score for t in ("w5 w6 w7", "w7 w5 w6 w5"))
    assert seen > unseen + 1


def test_a_shuffled_filter_makes_no_row_of_a_position(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 300, n)) for n in rng.integers(0, 60, 300)] + [None, "", "unseen", "w1 " * 3000]
    rows = [(i if i else None, t, i % 5 == 0) for i, t in enumerate(texts)] + [(7, texts[7], False)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    train = df.where("not held_out")
    want = lm.score(df, *lm.fit(train))
    plans, materialize = [], lm.C.materialize
    monkeypatch.setattr(lm.C, "materialize", lambda df: (plans.append(df._jdf.queryExecution().toString()), materialize(df))[1])
    for size in (1 << 9, 1 << 22):
        monkeypatch.setattr(lm, "CHUNK_BYTES", size, raising=False)
        got = lm.score(df, *lm.fit(train, broadcast_bytes=0))
        plans.append(got._jdf.queryExecution().toString())
        assert not any("Generate" in p for p in plans) and got.dtypes == want.dtypes
        key = lambda r: (r.doc_id or -1, r.held_out, r.n_tokens)
        a, b = (sorted(df.collect(), key=key) for df in (got, want))
        assert [r[:5] for r in a] == [r[:5] for r in b] and len(a) == len(rows)
        assert np.allclose([r[5:] for r in a], [r[5:] for r in b], rtol=1e-9, atol=1e-9)


def test_codes_fit_six_bytes_and_a_section():
    code = np.sort(lm.pair_codes(np.arange(5000, dtype=np.uint64), np.arange(5000, dtype=np.uint64)[::-1]))
    for bits in (8, 11):
        section = lm.bucket_of(code, bits)
        for s in np.unique(section):
            own = code[section == s]
            assert (lm.widen(lm.narrow(own).tobytes(), int(s), bits) == own).all()
