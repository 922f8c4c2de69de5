import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage import config
from plumage.functions import extractors, geometry, labels, vec
from plumage.operators import encode, graph, kernels, layout, matching, metrics, models, ranking, sampling
from plumage.sources import coco, stores
from plumage.streaming import ingest


def test_coco_variants(spark, tmp_path):
    data = {
        "categories": [{"id": 1, "species": "a"}, {"id": 2, "name": "b"}],
        "images": [{"uuid": "i1", "image_path": "x/i1.jpg", "width": 10, "height": 10, "datetime": "2020"}, {"uuid": "i2", "image_path": "/abs/i2.jpg"}],
        "annotations": [
            {"uuid": "1", "image_uuid": "i1", "bbox": [1, 2, 3, 4], "individual_id": 7, "viewpoint": "left", "category_id": 1},
            {"uuid": "2", "image_uuid": "i1", "bbox_x": 1, "bbox_y": 2, "bbox_w": 3, "bbox_h": 4, "name_uuid": "n", "category_id": 2},
            {"uuid": "3", "image_uuid": "i2", "category_id": 9},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(data))
    t = coco.read(spark, str(tmp_path / "c.json"))
    got = {r.uuid: r for r in t["annotations"].collect()}
    assert tuple(got["1"].bbox) == (1, 2, 3, 4) and tuple(got["2"].bbox) == (1, 2, 4, 6) and tuple(got["3"].bbox) == (0, 0, 0, 0)
    assert [got[i].individual_id for i in "123"] == ["7", "n", ""] and got["3"].viewpoint == "unknown" and got["2"].category == "b"
    assert sorted(r.path for r in coco.with_image(t["annotations"], t["images"], "root/").collect()) == ["/abs/i2.jpg", "root/x/i1.jpg", "root/x/i1.jpg"]
    assert matching.resolve_categories(t["categories"], ["b", "zz"]) == [2] and matching.resolve_categories(t["categories"], ["zz"]) is None
    (tmp_path / "w.txt").write_text("https://h/m/net_small_x-1.pth?k=1\nhttps://h/m/net_small_x-2.pth?k=2")
    assert [(r.model, r.url[-1]) for r in coco.weight_urls(spark, str(tmp_path / "w.txt")).collect()] == [("net_small", "2")]


def test_stores(spark, tmp_path):
    d = stores.Detections(spark, str(tmp_path / "d"))
    assert d.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "detection_id string, image_path string, x int")
    d.write(rows(("a", "i", 1), ("b", "i", 2)), 0)
    d.upsert(rows(("b", "i", 3), ("c", "j", 4)), 1)
    assert sorted((r.detection_id, r.x, r.batch) for r in d.read().collect()) == [("a", 1, 0), ("b", 3, 1), ("c", 4, 1)]
    assert tuple(d.counts().first()) == (3, 2, 2) and d.one("a").count() == 1 and d.of_image("j").count() == 1
    m = rows(("a", "i", 1))
    p = str(tmp_path / "m")
    assert stores.read_matches(spark, p) is None
    assert stores.cached_matches(spark, p, {"f": 0.2}, lambda: m).count() == 1
    assert stores.read_matches(spark, p, {"f": 0.3}) is None and stores.read_matches(spark, p, {"f": 0.2}).columns == m.columns
    model = {"weight": np.arange(3.0), "a": np.ones((2, 3, 4))}
    stores.write_model(spark, model, str(tmp_path / "model"))
    assert all(np.array_equal(v, model[k]) for k, v in stores.read_model(spark, str(tmp_path / "model")).items())


def test_streaming_counts_each_image_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "image_path string, detection_id string")
    src, out, done, check = (str(tmp_path / n) for n in ("src", "out", "done", "check"))
    run = lambda: ingest.ingest(ingest.read_files(spark, src, "image_path string, detection_id string"), out, done, check, lambda df: df.where("detection_id is not null")).awaitTermination()
    rows(("i1", "d1"), ("i2", None)).coalesce(1).write.parquet(src)
    run()
    rows(("i2", "late"), ("i3", "d3")).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.detection_id for r in stores.Detections(spark, out).read().collect()) == ["d1", "d3"]
    assert spark.read.parquet(done).count() == 3


def test_matching_is_one_to_one(spark):
    c = spark.createDataFrame([("i", "d1", "g1", 5, 0.5), ("i", "d1", "g2", 4, 0.4), ("i", "d2", "g1", 5, 0.5), ("j", "d3", "g3", 1, 0.2)], "image string, det string, gt string, n_inside int, fraction double")
    got = sorted((r.det, r.gt) for r in matching.greedy_one_to_one(c).collect())
    assert got == [("d1", "g1"), ("d3", "g3")]


def test_touching_boxes(spark):
    b = lambda *x: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x1", "y1", "x2", "y2"), strict=True)])
    r = spark.range(1).select(
        geometry.iou(b(0, 0, 1, 1), b(1, 0, 2, 1)).alias("iou"), geometry.overlaps(b(0, 0, 1, 1), b(1, 0, 2, 1)).alias("o"), geometry.contains(b(0, 0, 1, 1), F.lit(1.0), F.lit(0.0)).alias("c"),
        geometry.iou(b(0, 0, 2, 2), b(1, 1, 3, 3)).alias("seventh"),
    ).first()
    assert (r.iou, r.o, r.c) == (0.0, False, True) and abs(r.seventh - 1 / 7) < 1e-12


def test_patch_centres(spark):
    b = F.struct(*[F.lit(v).alias(n) for v, n in ((0.0, "x1"), (0.0, "y1"), (512.0, "x2"), (256.0, "y2"))])
    mask = F.array_repeat(F.array_repeat(F.lit(True), 32), 32)
    got = spark.range(1).select(geometry.patch_centres(b, mask, F.lit(512), F.lit(256), 512, 16).alias("c")).first().c
    assert len(got) == 1024 and (got[0].x, got[0].y) == (8.0, 8.0 - 128) and (got[-1].x, got[-1].y) == (504.0, 504.0 - 128)
    empty = F.struct(*[F.lit(0.0).alias(n) for n in ("x1", "y1", "x2", "y2")])
    assert spark.range(1).select(geometry.patch_centres(empty, mask, F.lit(512), F.lit(256), 512, 16).alias("c")).first().c == []
    grid = spark.range(1).select(geometry.grid_points(64, 16).alias("g"), geometry.content_mask(0, 8, 0, 40, 64, 16).alias("m"), geometry.patch_rectangle(F.lit(0), F.lit(0), F.lit(512), F.lit(256)).alias("p")).first()
    assert (grid.g[0].x, grid.g[-1].y) == (-0.75, 0.75) and grid.m == [True] * 8 + [False] * 8 and grid.p is None


def test_metrics_edge_cases(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0], "a")], "id long, vec array<double>, identity string")
    assert tuple(ranking.reid_metrics(one).first()) == (0, 0, 0, 0, 0)
    same_image = spark.createDataFrame([(1, [1.0, 0.0], "a", None), (2, [1.0, 0.1], "a", None)], "id long, vec array<double>, identity string, image string")
    assert ranking.reid_metrics(same_image, image_col="image").first().mrr == 0  # a missing image equals a missing one
    s = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True)], "s double, y boolean")
    assert metrics.auc(s, "s", "y").first().auc == 0.75 and metrics.auc(s.where("y"), "s", "y").first().auc == 0.5
    long = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "c string, x double").withColumn("k", F.lit(1))
    assert abs(metrics.fisher_ratio(long, "c", ["k"]).first().ratio - 2 * (2 - 13 / 3) ** 2 / 2) < 1e-12
    two = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    assert ranking.ratio_test(two, two).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([4.0, -9.0],)], "v array<double>")
    got = [r.u for r in df.select(vec.power_unit("v").alias("u")).collect()]
    assert got[0] == [0, 0] and np.allclose(got[1], np.array([2, -3]) / np.sqrt(13))
    m = spark.range(1).select(vec.block_mask(2, 3, max_dim=2).alias("m"), vec.block_mask(2, 3, max_dim=0).alias("all")).first()
    assert m.m == [True, True, True, False, True, True, False] * 2 and all(m.all)
    with pytest.raises(Exception, match="components"):
        df.select(vec.decompose("v", "v", 2, 2)).collect()


def test_labels(spark):
    df = spark.createDataFrame([("/a/img.v1.jpg", 3), ("noext", 0)], "p string, i int")
    ids = [r.d for r in df.select(labels.detection_id("p", "i").alias("d")).collect()]
    assert ids == ["img.v1_det_0003", "noext_det_0000"]
    back = spark.createDataFrame([("a_det_b_det_0001",), ("plain",)], "d string").select(labels.image_of_detection("d").alias("i"))
    assert [r.i for r in back.collect()] == ["a_det_b", "plain"]


def gaussians(spark, n=600):
    rng = np.random.default_rng(0)
    k = rng.integers(0, 2, n)
    s = rng.normal(0, 0.3, (n, 2)) + np.array([[-2, 0], [2, 1]])[k]
    a = np.array([[[1, 0], [0, 2]], [[0, -1], [1, 0]]])
    t = np.einsum("nij,nj->ni", a[k], s) + rng.normal(0, 0.1, (n, 2))
    return spark.createDataFrame([(i, int(k[i]), s[i].tolist(), t[i].tolist()) for i in range(n)], "id long, k int, s array<double>, t array<double>"), s, t, a


def test_fits(spark):
    df, s, t, a = gaussians(spark)
    p = models.pca(models.moments(df, "s", 2))
    assert np.allclose(p["components"] @ p["components"].T, np.eye(2)) and np.allclose(np.sort(p["variance"]), np.sort(np.linalg.eigvalsh(np.cov(s.T))))
    w = np.array([r.q for r in models.pca_transform(df, p, "s", "q").collect()])
    assert np.allclose(np.cov(w.T), np.eye(2))
    half = models.merge_moments(models.moments(df.where("id < 100"), "s", 2), models.moments(df.where("id >= 100"), "s", 2))
    assert np.allclose(models.pca(half)["variance"], p["variance"])
    g = models.gmm_fit(df, "s", "id", 2, max_iter=30)
    order = np.argsort(g["mean"][:, 0])
    assert np.allclose(g["mean"][order], [[-2, 0], [2, 1]], atol=0.1) and np.allclose(g["var"], 0.09, atol=0.03)
    c = models.conditional_fit(df, "s", "t", g)
    assert np.allclose(c["a"][order], a, atol=0.15)
    joint = df.withColumn("st", F.concat("s", "t"))
    start, lls = models.mlr_from_gmm(models.gmm_fit(joint, "st", "id", 2, max_iter=10), 2, 2), []
    for _ in range(6):
        start, ll = models.mlr_step(df, "s", "t", start)
        lls.append(ll)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(lls[:-1], lls[1:], strict=True))
    d = models.mlr_diagnostics(df, "s", "t", start)
    assert d["counts"].sum() == 600 and 1 <= d["effective"] <= 2.001
    with pytest.raises(ValueError):
        models.conditional_fit(df, "s", "t", g | {"var": np.ones((5, 2))})


def test_encoders(spark):
    df, s, t, _ = gaussians(spark, 40)
    df = df.withColumn("valid", F.col("id") % 10 > 0).withColumn("det", F.expr("id div 10"))
    m = {"weight": np.array([0.5, 0.5]), "mean": s[:2], "var": np.full((2, 2), 0.5)}
    enc = kernels.WeightEncoder(m["weight"], m["mean"], m["var"])
    got = {r.detection: (r.n, r.vec) for r in encode.encode(df.repartition(3), enc, "det", ["s"], "valid").collect()}
    assert set(got) == {0, 1, 2, 3} and got[0][0] == 9
    x = s[1:10]
    g = kernels.posteriors(x, m["weight"], m["mean"], m["var"])
    assert np.allclose(g.sum(axis=1), 1)
    z = (x - m["mean"][0]) / np.sqrt(0.5)
    n0 = g[:, 0].sum()
    assert np.allclose(got[0][1][:5], np.concatenate([[np.sqrt(n0 / 9)], g[:, 0] @ z / np.sqrt(n0), g[:, 0] @ (z * z - 1) / np.sqrt(2 * n0)]))
    none = encode.encode(df.withColumn("valid", F.lit(False)), enc, "det", ["s"], "valid")
    assert none.count() == 0
    assert np.isclose(np.linalg.norm(encode.encode(df, kernels.ImprovedEncoder(m["weight"], m["mean"], m["var"]), "det", ["s"]).first().vec), 1)


def test_graph(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 3).tolist()) for i in range(60)], "id long, vec array<double>")
    lap = graph.laplacian(graph.knn_edges(df, 6)).cache()
    dense = {r.node: r for r in graph.smallest_eigenvectors(lap, 4).collect()}
    values = np.array(dense[0].eigenvalues)
    assert abs(values[0]) < 1e-9 and (np.diff(values) > -1e-12).all()
    vectors = np.array([dense[i].vec for i in range(60)])
    assert np.allclose(vectors.T @ vectors, np.eye(4))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    basis = graph.smallest_eigenvectors(lap, 2).select("node", "vec")
    x = np.array([r.vec for r in df.orderBy("id").collect()])
    e = np.array([r.vec for r in basis.orderBy("node").collect()])
    got = np.array([r.vec for r in graph.without_subspace(df, basis, "id", "vec").orderBy("node").collect()])
    assert np.allclose(got, x - e @ (e.T @ x))
    monkeypatch.setattr(graph, "DENSE_NODES", 3)
    edges = [(a, b) for g in (0, 5) for a in range(g, g + 5) for b in range(g, g + 5) if a != b] + [(4, 5), (5, 4)]
    small = graph.laplacian(spark.createDataFrame(edges, "src long, dst long")).cache()
    rows = graph.smallest_eigenvectors(small, 2, turns=25).orderBy("node").collect()
    m = np.zeros((10, 10))
    for i, j, v in small.collect():
        m[i, j] += v
    assert np.allclose(rows[0].eigenvalues, np.linalg.eigvalsh(m)[:2], atol=1e-3)
    x = np.array([r.vec for r in rows])
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-6)


def test_eigenvectors_of_the_spark_path_have_signs_and_tell_if_not_converged(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 3).tolist()) for i in range(150)], "id long, vec array<double>")
    lap = graph.laplacian(graph.knn_edges(df, 6)).cache()
    ids, values, want = graph.dense_eigenvectors(lap, 4)
    monkeypatch.setattr(graph, "DENSE_NODES", 3)
    for parts in (3, 7):  # the same signs however rows are dealt
        rows = graph.smallest_eigenvectors(lap.repartition(parts), 4).orderBy("node").collect()
        assert [r.node for r in rows] == ids and np.allclose(rows[0].eigenvalues, values, atol=1e-8)
        assert np.allclose([r.vec for r in rows], want, atol=1e-5)
    with pytest.raises(RuntimeError, match="residual"):
        graph.smallest_eigenvectors(lap, 4, turns=0)


def test_eigenvectors_leave_no_basis_behind_and_narrow_blocks_find_the_same(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 3).tolist()) for i in range(400)], "id long, vec array<double>")
    lap = graph.laplacian(graph.knn_edges(df, 6)).cache()
    _, values, want = graph.dense_eigenvectors(lap, 4)
    monkeypatch.setattr(graph, "BLOCK_CELLS", 1, raising=False)  # blocks of 14, a basis of 56, so it is cut
    monkeypatch.setattr(graph, "BASIS_CELLS", 1, raising=False)
    monkeypatch.setattr(graph.scratch, "folder", lambda spark: f"file://{tmp_path}")
    rows = graph.smallest_eigenvectors(lap, 4).orderBy("node").collect()
    assert np.allclose(rows[0].eigenvalues, values, atol=1e-8) and np.allclose([r.vec for r in rows], want, atol=1e-5)
    assert len(list(tmp_path.iterdir())) <= 3  # the matrix, its nodes, the result: before, two tables a turn more


def test_eigenvectors_take_many_products_in_a_job(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 5).tolist()) for i in range(600)], "id long, vec array<double>")
    lap = graph.laplacian(graph.knn_edges(df, 8)).cache()
    _, values, want = graph.dense_eigenvectors(lap, 3)
    monkeypatch.setattr(graph, "BLOCK_CELLS", 1)
    tables, written = [], graph.scratch.written
    monkeypatch.setattr(graph.scratch, "written", lambda *a: tables.append(1) or written(*a))
    rows = graph.smallest_eigenvectors(lap, 3).orderBy("node").collect()
    assert np.allclose(rows[0].eigenvalues, values, atol=1e-8) and np.allclose([r.vec for r in rows], want, atol=1e-5)
    assert len(tables) <= 12  # before, one a product and three more


def test_sampling_and_layout(spark):
    df = spark.range(1000)
    assert sampling.exact_sample(df, 10, "id").count() == 10 and sampling.exact_sample(df, 5000, "id").count() == 1000
    pts = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0)], "id long, x double, y double")
    assert sorted((r.x, r.y) for r in layout.scaled(pts).collect()) == [(0, 0), (1, 0)]
    assert layout.tiled(pts).count() == 18 and layout.atlas_columns(10) == 4
    got = layout.nearest_before(pts.withColumnRenamed("id", "rank")).collect()
    assert [(r["rank"], r.distance) for r in got] == [(2, 10.0)]
    c = spark.createDataFrame([([0.2, 0.8],)], "r array<double>").select(layout.blended(F.col("r"), layout.palette(2)).alias("h"), layout.blended(F.col("r"), layout.palette(2), False).alias("b"), layout.contribution_map(F.col("r"), F.array(F.lit(1.0), F.lit(2.0))).alias("m")).first()
    assert np.allclose(c.h, layout.palette(2)[1]) and len(c.b) == 3 and abs(c.m - 1.8) < 1e-12


def test_extractor_contract(spark):
    crops = spark.createDataFrame([("d", "i", "s", [float(i) for i in range(32 * 32)], [1.0] * 1024, 32)], "detection_id string, image_path string, species string, pixels array<double>, mask array<double>, side int")
    rows = extractors.patch_rows(crops, "patch_mean").collect()
    assert len(rows) == 4 and all(r.valid for r in rows) and rows[0].feature[0] == np.arange(1024).reshape(32, 32)[:16, :16].mean()
    with pytest.raises(ValueError, match="no extractor"):
        extractors.get("nothing")
    images = spark.createDataFrame([("i1", "a"), ("i1", "b")], "image_path string, species string")
    assert extractors.prompts(images, {"a": ["p", "q"]}).count() == 3
    ids = extractors.numbered(images.withColumn("idx", F.lit(0))).collect()
    assert sorted(r.detection_id for r in ids) == ["i1_det_0000", "i1_det_0001"]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    config.PipelineSettings.write_default(path)
    c = config.PipelineSettings.read(path)
    assert c.gmm.n_components == 256 and c.pca.end_component is None and c.active_patch_size == 16
    c.fisher_vector.use_pca = True
    with pytest.raises(ValueError):
        c.validate()
    assert config.from_dict(config.PipelineSettings, {"pca": {"n_components": "8", "start_component": 2}, "unknown": 1}).pca.end_component == 10


def test_densities(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0)] * 30 + [("b", 0.0, 0.0)] * 5, "g string, x double, y double")
    got = layout.densities(pts, "g", "x", "y", grid=72)
    r = got.groupBy("g").agg(F.sum("density").alias("s"), F.max_by(F.struct("gx", "gy"), "density").alias("top")).collect()
    assert [x.g for x in r] == ["a"] and abs(r[0].s * 25 - 1) < 0.05 and tuple(r[0].top) == (36, 36)


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 05:00:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(src)
    counts = ingest.windowed_counts(ingest.read_files(spark, src, "t timestamp, k string"), "t", "k")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.sql("select * from windowed").collect()) == [("a", 2), ("b", 1)]


def test_greedy_pairs_equal_a_single_sweep(spark):
    """Images with few and with many pairs, with ties, against pairs taken one after the other."""
    rng = np.random.default_rng(2)
    rows = {(int(i), int(i) * 100 + int(d), int(i) * 100 + int(g)): int(n) for i, d, g, n in zip(rng.integers(0, 4, 900) ** 2, rng.integers(0, 40, 900), rng.integers(0, 40, 900), rng.integers(1, 6, 900), strict=True)}
    df = spark.createDataFrame([(*k, n, n / 16) for k, n in rows.items()], "image long, det long, gt long, n_inside int, fraction double")
    dets, gts, want = set(), set(), set()
    for (image, det, gt), _ in sorted(rows.items(), key=lambda r: (-r[1], r[0][1], r[0][2])):
        if (image, det) not in dets and (image, gt) not in gts:
            dets.add((image, det))
            gts.add((image, gt))
            want.add((image, det, gt))
    assert {(r.image, r.det, r.gt) for r in matching.greedy_one_to_one(df).collect()} == want
    assert matching.greedy_one_to_one(df.limit(0)).count() == 0


def test_long_vectors_are_normalised_in_linear_time(spark):
    x = np.random.default_rng(1).uniform(0, 1, 4000)
    df = spark.createDataFrame([(x.tolist(),)] * 4, "v array<double>").coalesce(1)
    start = time.time()
    got = df.select(vec.root_l1("v").alias("r"), vec.unit("v").alias("u"), vec.power_unit("v").alias("p"), vec.stats("v").alias("s")).collect()[0]
    assert time.time() - start < 20
    root = np.sqrt(x / x.sum())
    power = np.sqrt(x)
    for have, want in ((got.r, root / np.linalg.norm(root)), (got.u, x / np.linalg.norm(x)), (got.p, power / np.linalg.norm(power))):
        assert np.allclose(have, want)
    assert np.isclose(got.s["std"], x.std())


def test_ranges_nearest_and_digest_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 10, (300, 2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "rank long, x double, y double")
    near = {r["rank"]: r.distance for r in layout.nearest_before(pts, block=64).collect()}
    assert set(near) == set(range(1, 300)) and all(np.isclose(near[i], np.sqrt(((xy[:i] - xy[i]) ** 2).sum(axis=1)).min()) for i in near)
    ranges = spark.createDataFrame([("a", 0, 7), ("b", 7, 7), ("c", 7, 250)], "batch string, start long, stop long")
    got = {(r["rank"], r.batch) for r in sampling.rows_in_ranges(pts, ranges, "rank", width=16).collect()}
    assert got == {(i, "a" if i < 7 else "c") for i in range(250)}
    one, other = (sampling.digest(pts.where(f"rank < {n}"), "rank", 5).first().digest for n in (300, 299))
    assert one == sampling.digest(pts.repartition(5), "rank", 5).first().digest != other


def test_pooled_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 6))
    rows = [(i % 7, bool(i % 3) and i % 7 != 6, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "d long, ok boolean, v array<double>").repartition(5)
    for r in metrics.pooled(df, "d", "ok", "v").collect():
        own = x[[i for i, (d, ok, _) in enumerate(rows) if d == r.detection and ok]]
        want = own.mean(axis=0) / np.linalg.norm(own.mean(axis=0)) if len(own) else np.zeros(6)
        assert np.allclose(r.vec, want)
