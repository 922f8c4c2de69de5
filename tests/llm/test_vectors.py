from fractions import Fraction

import numpy as np

from plumage.llm import ann, embed_dedup


def table(spark, small):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]


def test_op5_equals_brute_force(spark, small):
    rows = sorted(table(spark, small))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in ann.op5(spark, small).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        s = (x * x[ids == q]).sum(axis=1)
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        assert [f[1] for f in sorted(found)] == ids[order].tolist()
        assert np.allclose([f[2] for f in sorted(found)], s[order], atol=1e-12)


def test_op5_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (9, [-1.0, 2.0], 1), (10, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int")
    got = sorted(tuple(r) for r in ann.nearest(df.where("vec_id in (0, 3, 4)"), df, 2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.nearest(df.limit(0), df, 2).count() == 0 and ann.nearest(df, df.limit(0), 2).count() == 0


def brute_links(rows, t):
    ok = [i for i, v, lab in rows if lab is not None and v is not None]
    x = {i: np.array(v, float) for i, v, _ in rows if v is not None}
    label = {i: lab for i, _, lab in rows}
    near = {i: set() for i, *_ in rows}
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if label[a] == label[b] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= t:
                near[a].add(b)
                near[b].add(a)
    comp = {}
    for i in sorted(near):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += near[j]
    return {i: (len(near[i]), comp[i]) for i in near}


def test_op9_equals_brute_force(spark, small):
    rows = table(spark, small)
    want = brute_links(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.op9(spark, small).collect()}
    assert set(got) == set(want)
    links = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.98 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)


def test_op9_signs_grow_with_the_group():
    for size, want in ((1, (20, 8)), (5000, (20, 9)), (1 << 14, (20, 10)), (1 << 20, (45, 16))):
        assert embed_dedup.signs_for(size, 0.93) == want
    for size in (10, 10**4, 10**6, 10**9):
        tables, bits = embed_dedup.signs_for(size, 0.93)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= 0.002 and size / 2**bits <= 16


def test_op9_finds_links_at_the_threshold_with_many_signs(spark):
    """The signs and tables of a group of 2^20, on pairs at a cosine of 0.93 to 0.94."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((600, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.93, 0.94, (600, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_duplicates(df, tables=45, bits=16).collect()
    assert sum(r.n_links for r in got) >= 0.98 * 1200


def test_op9_blocks_copies_and_nulls(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.normal(0, 0.05, 16)).tolist(), 1) for i in range(60)]
    rows += [(100 + i, base.tolist(), 1) for i in range(20)] + [(200 + i, base.tolist(), 2) for i in range(3)]
    rows += [(300, base.tolist(), None), (301, None, 1), (302, [0.0] * 16, 1)]
    df = spark.createDataFrame(rows + [(None, base.tolist(), 1)], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_duplicates(df, block=16).collect()
    want = brute_links([r if r[0] != 302 else (302, None, 1) for r in rows], 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op5_repeated_rows_and_two_vectors_of_one_id(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 8).astype(float).tolist()) for i in range(1, 61)]
    rows += [rows[19], rows[19], rows[4], (40, rng.normal(0, 1, 8).tolist())]  # 20 three times, 5 twice, 40 with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df.where("vec_id % 20 = 0"), df, 6).collect()]
    kinds = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for q, x in kinds:
        if q % 20 == 0:
            best = sorted(((-float(np.dot(x, y)), i) for i, y in kinds if i != q))[:6]
            want += [(q, r, i) for r, (_, i) in enumerate(best, 1)]
    assert sorted(t[:3] for t in got) == sorted(want)


def test_op5_any_finite_vectors(spark):
    """Components of 1e200 and 1e-310, together with plain ones; products beyond the doubles are ties."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, -3e200]), (2, [2e200, 1e199]), (3, [1.0, 2.0]), (4, [1e-310, 3e-310]), (5, [-1e200, 1.0]), (6, [1e100, 2e100]),
            (20, [1e-310, 0.0]), (40, [1e-200, 3.0]), (60, [1.0, 1.0]), (7, [1.7e308, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df.where("vec_id % 20 = 0"), df, 20).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, x in rows:
        if q % 20 == 0:
            true = {i: sum(Fraction(a) * Fraction(b) for a, b in zip(x, y, strict=True)) for i, y in rows if i != q}
            score = {i: float(s) if abs(s) < Fraction(1.7e308) else (np.inf if s > 0 else -np.inf) for i, s in true.items()}
            assert [i for i, _ in got[q]] == sorted(score, key=lambda i: (-score[i], i))
            assert all(s == score[i] or abs(s - score[i]) <= 1e-15 * abs(score[i]) for i, s in got[q])


def test_op5_candidates_stream_in_chunks():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(300, 16)), rng.normal(size=(2000, 16))
    x[500:1200] = x[499]  # a third are copies
    best = ann.Best(ann.Rows(np.arange(300), q), 7)
    for i in range(0, 2000, 130):
        best.see(ann.Rows(np.arange(i, min(i + 130, 2000)), x[i : i + 130]))
    a, ids, score = best.rows()
    want = np.array([(x * row).sum(axis=1) for row in q])
    want[np.arange(300), np.arange(300)] = -np.inf
    order = np.array([np.lexsort((np.arange(2000), -row))[:7] for row in want])
    assert (a.reshape(300, 7) == np.arange(300)[:, None]).all() and (ids.reshape(300, 7) == order).all()
    assert np.allclose(score.reshape(300, 7), np.take_along_axis(want, order, 1))
