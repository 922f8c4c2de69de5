import re

from plumage.llm import minhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op4_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op4(spark, small).collect()}
    assert got == brute(rows, 3, 85)


def test_edge_cases_and_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (4, "ONE", "x"), (5, "a\tb", "x"), (6, "A B", "x"), (7, " \n ", None), (None, "one", "x")]
    for i in range(40):  # a chain of variants, more than a block of 8
        w = list(base)
        w[3 * (i % 30)] = f"v{i}"
        rows.append((100 + i, " ".join(w), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = minhash.near_duplicates(df, k=3, similarity_percent=85, block=8).collect()
    assert len(got) == len(rows)
    want = brute([r[:2] for r in rows if r[0] is not None], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    none = [r for r in got if r.doc_id is None][0]
    assert none.component_id is None and none.kept and none.n_shingles == 1


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=3).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_pairs_at_the_stage_threshold_are_found(spark):
    rows = []
    for i in range(4000):  # 8 words of 10 in common: a similarity of 0.8
        rows += [(2 * i, " ".join(f"p{i}w{j}" for j in range(9))), (2 * i + 1, " ".join(f"p{i}w{j}" for j in range(1, 10)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    missed = lambda **how: 4000 - minhash.near_duplicates(df, k=1, similarity_percent=80, **how).where("not kept").count()
    assert minhash.banding(85) == 6 and minhash.banding(80) == 5
    assert missed() <= 2 < missed(rows_per_band=6)
