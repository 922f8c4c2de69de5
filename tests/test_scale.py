"""Operators that must not depend on the size of a group: selection, samples, joins of boxes, matching."""

import functools
import itertools
import math
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumage.functions import extractors
from plumage.operators import blocks, layout, matching, metrics, nets, ranking, sampling, selection
from plumage.plans import more
from plumage.plans.queries import QUERIES


@pytest.mark.parametrize("at_once", [1, 50, 1 << 14])
def test_order_statistics_by_rounds_of_bits(spark, at_once):
    rng = np.random.default_rng(5)
    values = [*rng.normal(0, 1, 300).tolist(), *[0.0, -0.0, float("inf"), float("-inf"), 1e-310, -1e300], *[2.5] * 200, *rng.normal(1, 1e-12, 100).tolist()]
    rows = [(g, float(x)) for g, part in (("a", values), ("b", values[:7]), (None, values[3:60]), ("c", [4.0])) for x in part] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    ranks = F.array(F.lit(0), F.expr("n div 3"), F.expr("n - 1"), F.lit(400))
    found = {(r.g, r["rank"]): r for r in selection.order_statistics(df, ["g"], selection.ordered_bits(F.col("x")), ranks, at_once=at_once, small=2).withColumn("x", selection.from_bits(F.col("key"))).collect()}
    for g in ("a", "b", None, "c"):
        own = sorted(x for k, x in rows if k == g and x is not None)
        for k in {0, len(own) // 3, len(own) - 1, 400}:
            if k < len(own):
                r = found.pop((g, k))
                assert (r.x, r.n, r.before, r.same) == (own[k], len(own), k - sum(x < own[k] for x in own), own.count(own[k]))
    assert not found
    med = {r.g: r["median"] for r in selection.medians(df, ["g"], F.col("x"), at_once=at_once).collect()}
    assert med == {g: float(np.median([x for k, x in rows if k == g and x is not None])) for g in ("a", "b", None, "c")}


@pytest.mark.parametrize("at_once", [60, 1 << 14])
def test_health_equals_sorting(spark, at_once):
    rng = np.random.default_rng(6)
    x = rng.standard_cauchy((400, 3))
    df = spark.createDataFrame([(d, float(v)) for row in x for d, v in enumerate(row)], "d long, x double")
    out = {r.d: r for r in metrics.health(df, "d", 4.0, at_once).collect()}
    for d in range(3):
        med = np.median(x[:, d])
        z = np.abs(x[:, d] - med) / (np.median(np.abs(x[:, d] - med)) + 1e-12)
        r = out[d]
        assert np.isclose(r["median"], med) and np.isclose(r.max_z, z.max()) and r.n_outliers == (z > 4).sum() and r.least == x[:, d].min()


def hashes(keys, seed=42):
    return [0 if k is None else ((k * 1103515245 + seed * 12345) % 2147483647 * 48271 + seed) % 2147483647 for k in keys]


@pytest.mark.parametrize("n", [0, 1, 17, 40, 63, 64, 100, 499, 500, 900])
def test_exact_sample_with_repeated_keys(spark, n):
    keys = [*range(300), None, None, *[7] * 120, *[2**40 + 5] * 78]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, i long").repartition(5)
    got = sampling.exact_sample(df, n, "key").collect()
    order = sorted(zip(hashes(keys), [(k is not None, k or 0) for k in keys], strict=True))[:n]
    assert sorted((k is not None, k or 0) for k, _ in got) == sorted(k for _, k in order) and len({i for _, i in got}) == len(got)


def test_exact_sample_has_no_step_in_a_single_task(spark):
    df = spark.range(100000).withColumnRenamed("id", "key")
    out = sampling.exact_sample(df, 50000, "key")
    assert out.count() == 50000 and "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def boxes(rng, n, image=1):
    size = np.exp(rng.normal(1, 2, n))
    xy = rng.uniform(-50, 1000, (n, 2))
    return [(image, i, tuple(map(float, (x, y, x + s, y + s * r)))) for i, ((x, y), s, r) in enumerate(zip(xy, size, rng.uniform(0.2, 3, n), strict=True))]


def frame(spark, rows, name):
    df = spark.createDataFrame([(m, i, *b) for m, i, b in rows], f"image long, {name} long, a double, b double, c double, d double")
    return df.select("image", name, F.struct(F.col("a").alias("x1"), F.col("b").alias("y1"), F.col("c").alias("x2"), F.col("d").alias("y2")).alias("box"))


def test_cells_give_the_pairs_of_a_plain_join(spark):
    rng = np.random.default_rng(7)
    d = [*boxes(rng, 150), *boxes(rng, 40, 2), (1, 900, (0.0, 0.0, 64.0, 64.0)), (1, 901, (10.0, 10.0, 5.0, 30.0)), (1, 902, (5.0, 5.0, 5.0, 5.0)), (1, 903, (-1e6, -1e6, 1e6, 1e6))]
    t = [*boxes(rng, 150), *boxes(rng, 40, 2), (1, 900, (64.0, 0.0, 128.0, 64.0)), (1, 901, (0.0, 0.0, 1e-9, 1e-9)), (3, 1, (0.0, 0.0, 9.0, 9.0)), (1, 902, (32.0, 32.0, 64.0, 64.0))]
    left, right = frame(spark, d, "det"), frame(spark, t, "gt")
    left = left.union(spark.range(1).select(F.lit(1), F.lit(999), F.lit(None).cast(left.schema["box"].dataType)))
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    want = sorted((m, i, j) for m, i, a in d for k, j, b in t if m == k and meets(a, b))
    for crowded in (0, 2000, 1 << 30):
        got = matching.overlapping(left, right, crowded).select("image", "det", "gt").collect()
        assert sorted(map(tuple, got)) == want


def test_fifty_thousand_boxes_of_one_image(spark):
    n = 50_000
    side = spark.range(n).select(F.lit(1).cast("long").alias("image"), "id", ((F.col("id") % 250) * 10.0).alias("x"), (F.floor(F.col("id") / 250) * 10.0).alias("y"))
    box = lambda dx: F.struct((F.col("x") + dx).alias("x1"), (F.col("y") + dx).alias("y1"), (F.col("x") + dx + 9).alias("x2"), (F.col("y") + dx + 9).alias("y2"))
    d, t = side.select("image", F.col("id").alias("det"), box(0.0).alias("box")), side.select("image", F.col("id").alias("gt"), box(3.0).alias("box"))
    pairs = matching.overlapping(d, t)
    assert pairs.count() == sum(len([1 for i in (-1, 0) if 0 <= x + i]) * len([1 for i in (-1, 0) if 0 <= y + i]) for x in range(250) for y in range(200))
    out = matching.match_by_iou(d, t, 0.1)
    assert out.count() == n and out.where("det = gt").count() == n


def sweep(pairs):
    dets, gts, out = set(), set(), set()
    for m, d, g, n in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if (m, d) not in dets and (m, g) not in gts:
            dets.add((m, d))
            gts.add((m, g))
            out.add((m, d, g))
    return out


def pairs_of(spark, pairs):
    return spark.createDataFrame([(*p, p[3] / 10) for p in pairs], "image long, det long, gt long, n_inside int, fraction double")


@pytest.mark.parametrize("seed", range(3))
def test_greedy_in_rounds_equals_a_single_sweep(spark, seed):
    rng = random.Random(seed)
    pairs = list({(m, rng.randrange(25), rng.randrange(25)): rng.randrange(1, 6 + 50 * seed) for m in (1, 2, 3) for _ in range(120)}.items())
    pairs = [(*k, n) for k, n in pairs]
    for swept in (0, 100, 1 << 20):
        got = matching.greedy_one_to_one(pairs_of(spark, pairs), swept).collect()
        assert {(r.image, r.det, r.gt) for r in got} == sweep(pairs) and len(got) == len(sweep(pairs))


def test_a_path_of_ten_thousand_falling_priorities(spark):
    pairs = [(1, i // 2, (i + 1) // 2, 20_000 - i) for i in range(10_000)]  # each shares an end with the next
    turns: list = []
    got = matching.in_rounds(pairs_of(spark, pairs), turns).collect()
    assert {(r.image, r.det, r.gt) for r in got} == sweep(pairs) and len(turns) <= 40


def plain_net(points, distance):
    """Points (prio, id, x, y) taken one after the other."""
    kept = []
    for p in sorted(points):
        if all((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 >= distance**2 for q in kept):
            kept.append(p)
    return kept


@pytest.mark.parametrize("distance", [0.7, 5.0, 200.0])
def test_a_net_is_the_first_maximal_set_by_priority(spark, distance):
    rng = np.random.default_rng(9)
    xy = rng.normal(0, 20, (700, 2))
    xy[:40] = np.stack([np.arange(40) * 0.69, np.full(40, 300.0)], axis=1)  # a chain of falling priority, longer than a tile sees
    prio = np.concatenate([np.arange(40), rng.integers(100, 200, 660)])
    rows = [(i, float(x), float(y), int(p)) for i, ((x, y), p) in enumerate(zip(xy, prio, strict=True))]
    got = nets.net(spark.createDataFrame(rows, "id long, x double, y double, prio long"), distance)
    assert {r.id for r in got.where("state = 1").collect()} == {p[1] for p in plain_net([(p, i, x, y) for i, x, y, p in rows], distance)} and got.count() == 700


@pytest.mark.parametrize("budget", [0.0, 1.5])
def test_minimum_zoom_covers_and_packs_every_level(spark, budget):
    rng = np.random.default_rng(10)
    xy = np.concatenate([rng.uniform(0, 3000, (800, 2)), rng.normal(500, 4, (400, 2)), np.full((5, 2), 700.0)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9000, None, 1.0)], "id long, x double, y double")
    zoom = {r.id: r.min_zoom for r in nets.minimum_zoom(df, budget=budget).collect()}
    assert len(zoom) == len(xy) and min(zoom.values()) >= -5 and max(zoom.values()) <= 5
    z = np.array([zoom[i] for i in range(len(xy))])
    assert z[((xy - xy.mean(axis=0)) ** 2).sum(axis=1).argmin()] == -4 and sorted(z[-5:])[1:] == [5.0] * 4
    for level in range(-4, 5):
        shown = xy[z <= level]
        d = np.sqrt(((xy[:, None] - shown[None]) ** 2).sum(axis=2))
        r = 50 / 2 ** (level + budget)
        assert d.min(axis=1).max() < 2 * r
        own = np.sqrt(((shown[:, None] - shown[None]) ** 2).sum(axis=2)) + np.eye(len(shown)) * 1e9
        assert own.min() >= r * (1 - 1e-9)


def test_minimum_zoom_of_one_point_and_of_none(spark):
    one = spark.createDataFrame([(4, 1.0, 2.0)], "id long, x double, y double")
    assert [tuple(r) for r in nets.minimum_zoom(one).collect()] == [(4, -4.0)] and nets.minimum_zoom(one.limit(0)).count() == 0


def test_patches_of_a_crop_are_made_once_for_each_padding(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.crossJoin(spark.range(12)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 1800).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["patch_grid"](spark, str(tmp_path))
    below = df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[1]
    assert any(line.lstrip(" :+-").startswith("Aggregate") for line in below.splitlines())  # of the paddings, not of the parts
    at = {r.id: tuple(r)[1:] for r in df.collect()}
    assert len(at) == 12 * part.count() and all(v == at[k - 1800] for k, v in at.items() if k > 1800 and k - 1800 in at)


def test_means_at_the_threshold_are_added_in_order(spark):
    rows = [(g, 0, i % 16, v, i) for g, values in (("up", (0.1, 0.2, 0.3)), ("down", (0.3, 0.2, 0.1)), ("far", (0.1, 0.1, 0.9)), ("odd", (0.2, float("nan")))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, y long, x long, value double, at long")
    for dealt in (df.orderBy("at"), df.orderBy(F.desc("at")), df.repartition(9, "at")):
        got = {r.id: r.valid for r in extractors.patch_mask(dealt, 16, 0.2, "at").collect()}
        assert got == {"up": (0.1 + 0.2 + 0.3) / 3 > 0.2, "down": (0.3 + 0.2 + 0.1) / 3 > 0.2, "far": True, "odd": True} and got["up"] and not got["down"]


def test_pixel_masks_depend_on_no_order_of_the_events(spark, tmp_path):
    values = (16.12, 101.69, 91.65, 30.61, 9.93)  # their mean is 50; in some orders doubles add up to more
    orders = [*itertools.permutations(values)]
    assert len({functools.reduce(operator.add, v) / 5 > 50 for v in orders}) == 2
    rows = [(64 * 3 * (5 * u + i), u, v) for u, vs in enumerate(orders) for i, v in enumerate(vs)] + [(1, 500, 50.0), (193, 500, 50.00000000000001), (1, 501, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.valid for r in more.pixel_masks(spark, str(tmp_path)).collect()}
    assert got == {**dict.fromkeys(range(len(orders)), False), 500: math.fsum([50.0, 50.00000000000001]) / 2 > 50, 501: None}


@pytest.mark.parametrize("distance", [False, True])
@pytest.mark.parametrize("kind", ["plain", "copies", "odd", "huge", "tiny"])
def test_nearest_by_tiles_equals_all_pairs(monkeypatch, distance, kind):
    monkeypatch.setattr(blocks, "TILE", (16, 32))
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (150, 12))
    if kind == "copies":
        x = x[rng.integers(0, 5, 150)]
        x[::9] += rng.normal(0, 1e-7, x[::9].shape)
    if kind == "odd":
        x[3], x[5, 2], x[7, 1], x[9] = 0, np.nan, np.inf, x[10] + 1e-9
    x = x * {"huge": 1e160, "tiny": 1e-11}.get(kind, 1)
    ids, image = rng.permutation(150), rng.integers(0, 30, 150)
    by_id = np.argsort(ids)
    q, c = {"vec": x, "id": ids, "image": image}, {"vec": x[by_id], "id": ids[by_id], "image": image[by_id]}
    out = lambda i, j: (q["id"][i] == c["id"][j]) | (q["image"][i] == c["image"][j])
    with np.errstate(all="ignore"):
        got = sorted(zip(*(v.tolist() for v in ranking.nearest(q, c, 6, distance, out)), strict=True), key=lambda r: (r[0], -r[2], r[1]))
        s = (ranking.negative_distances if distance else ranking.similarities)(q, c)
    want = []
    for i in range(150):
        near = sorted((-s[i, j], j) for j in range(150) if s[i, j] > -np.inf and not out(i, j))[:6]
        want += [(i, j, -v) for v, j in near]
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9, rtol=1e-12)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e200])
def test_steps_of_distance_equal_differences(scale):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (60, 8)), np.full((5, 8), 1e3)]) * scale
    y = np.concatenate([x[:20] + rng.normal(0, 1e-6, (20, 8)) * scale, x[20:40]])
    with np.errstate(over="ignore", invalid="ignore"):
        want = np.rint(-ranking.negative_distances({"vec": x}, {"vec": y}) * 1e4).astype(np.int64)
        assert (ranking.steps(x, y, 1e4) == want).all()


def test_ranks_of_first_matches_by_blocks(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (40, 4))[rng.integers(0, 40, 120)]
    rows = [(i, v.tolist(), ["a", "b", None][i % 3] if i < 110 else f"own {i}", i // 4 if i % 5 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, identity string, image long")
    s = ranking.similarities({"vec": x}, {"vec": x})
    for image in (None, "image"):
        got = {r.id: r["rank"] for r in ranking.first_match_ranks(df, image_col=image).collect()}
        for i, _, identity, place in rows:
            order = sorted((-s[i, j], j) for j in range(120) if j != i and not (image and rows[j][3] == place))
            right = [n + 1 for n, (_, j) in enumerate(order) if rows[j][2] == identity]
            assert got[i] == (right[0] if right else None)


def test_nearest_before_by_cells(spark):
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.uniform(0, 10, (300, 2)), rng.normal(50, 1e-3, (150, 2)), rng.integers(0, 4, (80, 2)) * 1.0, np.stack([np.full(90, 7.0), np.arange(90) * 1e4], axis=1)])
    ranks = rng.permutation(len(xy)) // 2  # every rank twice
    pts = spark.createDataFrame([(int(r), float(a), float(b)) for r, (a, b) in zip(ranks, xy, strict=True)], "rank long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    want = {r: d[np.ix_(ranks == r, ranks < r)].min() for r in range(1, ranks.max() + 1)}
    for block in (16, 2048):
        got = {r["rank"]: r.distance for r in layout.nearest_before(pts, block).collect()}
        assert set(got) == set(want) and all(np.isclose(got[r], want[r], rtol=1e-12, atol=0) for r in want)
    assert layout.nearest_before(pts.limit(0)).count() == 0
    asked = layout.nearest_before(pts, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "_q" not in asked  # no pairs of all blocks
