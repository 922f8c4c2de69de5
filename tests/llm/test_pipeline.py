import pyarrow as pa

import corpus_pipeline
from plumage.llm import common
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_packing import check as check_packing


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("toxic", "quality", "lines", "groups", "pack"), strict=True):
        docs = common.materialize(stage(spark, docs, sf_dir))
        if check != "pack":
            assert docs.columns == columns, name
            now = {r.doc_id: r.text for r in docs.collect()}
        if check == "toxic":
            clean = [i for i in texts if i in labels and not labels[i].toxic]
            assert sum(i in now for i in clean) > 0.95 * len(clean)
        if check == "quality":
            clean = [i for i in texts if i in labels and labels[i].quality]
            assert sum(i in now for i in clean) > 0.95 * len(clean)
        if check == "lines":
            want = brute_lines(texts.items())
            assert now == {i: t for i, t in want.items() if t.strip(" ") or t == texts[i]}
        if check == "groups":
            assert set(now) == {i for i, (_, c) in brute_groups(texts.items(), 5, 80).items() if i == c}
        if check == "pack":
            check_packing(docs.collect(), texts)
        texts = now


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, extra columns of any name."""
    good = "the quick brown fox of the hill ran to an old house and then it was late in the day for him"
    rows = [(i, f"{good} number {i} of them\n" * 2 + " ".join(f"w{i}x{j}" for j in range(40)), "en", "web", 10) for i in range(20)]
    rows += [(30, None, None, None, None), (31, "", "en", None, 0), (32, "x " * 60_000, "en", "web", 3), (None, f"{good} once more", None, "web", 5)]
    rows += [rows[3], rows[3], (33, rows[4][1], "de", "web", 4), (34, "é" * 150_000, None, None, None)]
    extra = ", score double, kept string, gone string, component_id string, n_lines int, n_removed string, k int, th string, toxic string, _doc int"
    docs = spark.createDataFrame([(*r, 0.5, "a", "b", "c", 7, "d", 1, "e", "f", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name == "packing":
            found = got.groupBy("doc_id").sum("length").collect()
            assert {r.doc_id for r in found} == {r[0] for r in rows}, name
            continue
        assert got.columns == docs.columns, name
        kept = got.collect()
        ids = [r.doc_id for r in kept]
        assert {30, 31} <= set(ids) and all(r.n_removed == "d" and r._doc == 2 for r in kept), name
        if name == "line dedup":
            text = {r.doc_id: r.text for r in kept}
            assert text[30] is None and text[32] == "x " * 60_000 and text[34] == "é" * 150_000 and text[3].count("quick") == 1
            assert text[0].count("quick") == 0 and "w0x39" in text[0]  # near to the line that stands most often
            assert ids.count(3) == 3 and 33 not in ids  # a copy of a document loses every line
        if name == "MinHash near-dedup":
            assert ids.count(3) == 3 and 33 not in ids and {4, 32, 34, None} <= set(ids)


def test_texts_travel_in_small_batches(spark, monkeypatch):
    """No stage gets its texts in Arrow batches of the default 64 MB; the row that reaches the limit still arrives whole."""
    from plumage.llm import minhash, packing, quality, toxicity

    MOST = common.BATCH_BYTES + 10_000_000

    def flags(name):
        def make(*_):
            def run(batches):
                for b in batches:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b.nbytes > MOST] * len(b))], names=["doc_id", name])

            return run

        return make

    def sizes(*_):
        def run(batches):
            for b in batches:
                n, none = pa.array([b.nbytes] * len(b), pa.int64()), pa.nulls(len(b), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), n, none, n, none], names=["doc_id", "n", "windows", "rest", "powers"])

        return run

    def signatures(*_):
        def run(batches):
            for b in sizes()(batches):
                yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 1, 1, 2)], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

        return run

    text = "case when id = 7 then repeat('x', 9000000) else repeat('a b ', 2500) end"
    docs = spark.range(0, 2500, 1, 1).selectExpr("id as doc_id", f"{text} as text", "'en' as lang")
    for module, name in ((toxicity, "toxic"), (quality, "kept")):
        monkeypatch.setattr(module, "fit", lambda *_: (None, {None: 0.5}, 0.5))
        monkeypatch.setattr(module, "_scorer", flags(name))
    monkeypatch.setattr(toxicity, "fit", lambda *_: (None, {None: 0.5}))
    monkeypatch.setattr(packing, "_measure", sizes)
    monkeypatch.setattr(minhash, "_signature_batches", signatures)
    assert toxicity.drop_toxic(docs, None).count() == 2500
    assert quality.keep_good(docs).count() == 0
    assert packing.measure(docs, "").where(f"n <= {MOST}").count() == 2500
    assert minhash.signatures(docs, 5).where(f"n_shingles <= {MOST}").count() == 2500
