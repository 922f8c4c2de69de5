"""Further queries: patch grids, layouts, masks, ranges, joins of labels. Registered with those of plans.queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumage import files, scratch
from plumage.functions import extractors
from plumage.functions import geometry as G
from plumage.functions import labels as L
from plumage.operators import encode as E
from plumage.operators import graph, kernels, layout, maps, metrics, nets, pivots, ranking, sampling
from plumage.plans import fixtures as X
from plumage.plans.queries import ORACLES, SQL_COARSE, SQL_HALVES, SQL_POST, SQL_SIM, _view, query, r6, rounded
from plumage.sources import stores
from plumage.streaming import ingest

SQL_CROP = """crop as (select p_partkey as id, cast(40 + p_partkey * 7 % 600 as double) as w, cast(30 + p_partkey * 11 % 450 as double) as h from part),
    pad as (select id, w, h, least(512.0 / w, 512.0 / h) as sc, floor((512 - trunc(w * least(512.0 / w, 512.0 / h))) / 2) as l, floor((512 - trunc(h * least(512.0 / w, 512.0 / h))) / 2) as t from crop),
    cell as (select *, r.range as r, c.range as c from pad, range(0, 32, 5) r, range(0, 32, 5) c)"""


def _cells(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (40 + F.col("p_partkey") * 7 % 600).cast("double").alias("w"), (30 + F.col("p_partkey") * 11 % 450).cast("double").alias("h")
    )
    steps = F.sequence(F.lit(0), F.lit(31), F.lit(5))
    return p.select("id", "w", "h", F.explode(steps).alias("r")).select("*", F.explode(steps).alias("c"))


@query(f"""with {SQL_CROP}, x as (select id, r, c, greatest(0, (c * 16 - l) / sc) as x1, greatest(0, (r * 16 - t) / sc) as y1, least(w, ((c + 1) * 16 - l) / sc) as x2, least(h, ((r + 1) * 16 - t) / sc) as y2 from cell)
    select id, r, c, round(x1, 5) as x, round(y1, 5) as y, round(x2 - x1, 5) as pw, round(y2 - y1, 5) as ph from x where x2 > x1 and y2 > y1""")
def patch_rectangles(spark, sf_dir):
    p = G.patch_rectangle(F.col("r"), F.col("c"), F.col("w"), F.col("h"))
    out = _cells(spark, sf_dir).select("id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), p.alias("p")).where("p is not null")
    five = lambda c: F.round(c, 5) + 0.0
    return out.select("id", "r", "c", five("p.x").alias("x"), five("p.y").alias("y"), five("p.w").alias("pw"), five("p.h").alias("ph"))


@query(f"""with {SQL_CROP}, x as (select id, r, c, w, h, (c * 16 + 8 - l) / sc as x, (r * 16 + 8 - t) / sc as y from cell)
    select id, r, c, round(x, 5) as x, round(y, 5) as y from x where x between 0 and w and y between 0 and h""")
def patch_centres_in_crop(spark, sf_dir):
    p = G.patch_centre_in_crop(F.col("r"), F.col("c"), F.col("w"), F.col("h"))
    out = _cells(spark, sf_dir).select("id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), p.alias("p")).where("p is not null")
    return out.select("id", "r", "c", (F.round("p.x", 5) + 0.0).alias("x"), (F.round("p.y", 5) + 0.0).alias("y"))


@query(f"""with {SQL_CROP}, g as (select id, r.range as r, c.range as c, (c.range * 16 + 8.0) / 512 * 2 - 1 as x, (r.range * 16 + 8.0) / 512 * 2 - 1 as y from pad, range(0, 32) r, range(0, 32) c
        where r.range >= floor(t / 16) and r.range < 32 - floor((512 - trunc(h * sc) - t) / 16) and c.range >= floor(l / 16) and c.range < 32 - floor((512 - trunc(w * sc) - l) / 16))
    select id, count(*) as n, min(r * 32 + c) as first, max(r * 32 + c) as last, round(sum((r * 32 + c) * (x + 2 * y)), 6) + 0.0 as place from g group by id""")
def patch_grid(spark, sf_dir):
    """Patches of each part's crop that hold some of its content, and where they are. They depend on the padding in whole patches alone,
    so they are made once for each padding that occurs, of at most 33^4."""
    p = X.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (40 + F.col("p_partkey") * 7 % 600).cast("double").alias("w"), (30 + F.col("p_partkey") * 11 % 450).cast("double").alias("h")
    ).withColumn("p", G.padding(F.col("w"), F.col("h")))
    rest = lambda side, pad: 512 - (F.col(side) * F.col("p.scale")).cast("int") - F.col(pad)
    pads = {"left": F.col("p.left"), "top": F.col("p.top"), "right": rest("w", "p.left"), "bottom": rest("h", "p.top")}
    p = p.select("id", *[F.floor(v / 16).alias(k) for k, v in pads.items()])
    mask = G.content_mask(*[F.col(k) * 16 for k in pads], 512, 16)
    rows = p.select(*pads).distinct().select(*pads, F.posexplode(F.arrays_zip(G.grid_points(512, 16).alias("g"), mask.alias("m"))).alias("i", "z")).where("z.m")
    place = F.sum(F.col("i") * (F.col("z.g.x") + 2 * F.col("z.g.y")))
    kinds = rows.groupBy(*pads).agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first"), F.max("i").cast("long").alias("last"), place.alias("place"))
    return p.join(kinds, [*pads]).groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), (F.round(F.sum("place"), 6) + F.lit(0.0)).alias("place"))


@query("""with r as (select min(value) as a, max(value) as b, min(user_id) as c, max(user_id) as d from events)
    select event_id, round((value - a) / (case when b > a then b - a else 1 end), 6) as x, round((user_id - c) / cast(case when d > c then d - c else 1 end as double), 6) as y from events, r""")
def scaled_points(spark, sf_dir):
    pts = X.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return rounded(layout.scaled(pts), "x", "y")


@query("select event_id, event_id // 100 as row, event_id % 100 as col from events")
def atlas_cells(spark, sf_dir):
    return layout.atlas_cells(X.table(spark, sf_dir, "events").select("event_id"), "event_id", 100)


@query("""select event_id, round(value + a.range * 360 - 360, 6) + 0.0 as x, round(cast(user_id as double) + b.range * 360 - 360, 6) + 0.0 as y from events, range(0, 3) a, range(0, 3) b""")
def tiled_points(spark, sf_dir):
    pts = X.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return rounded(layout.tiled(pts), "x", "y")


@query("""with p as (select event_id as rank, value as x, cast(user_id as double) as y from events)
    select a.rank, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) as distance from p a join p b on b.rank < a.rank group by a.rank""")
def nearest_before(spark, sf_dir):
    pts = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("rank"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return rounded(layout.nearest_before(pts), "distance")


@query()
def minimum_zoom(spark, sf_dir):
    """The zoom from which each vector is shown on a map of the first two components."""
    v = X.vectors(spark, sf_dir)
    return nets.minimum_zoom(v.select("id", (F.col("vec")[0] * 2000).alias("x"), (F.col("vec")[1] * 2000).alias("y")))


@query("select event_id, value / 20 - 4 + log2(80.0 / 50.0) - (1.5 - 2.0) <= 1.0 - log2(64.0) + 6 as visible from events")
def visible_points(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 20 - 4).alias("z"), F.lit(64.0).alias("s"), F.lit(7.0).alias("zoom"))
    return e.select("event_id", L.min_zoom_visible("z", "s", "zoom", 80.0, 50.0, 1.5, 2.0).alias("visible"))


@query("""select user_id as id, cast(floor(event_id % 64 / 16) as int) as row, cast(floor(event_id % 48 / 16) as int) as col, avg(value) > 50 as valid from events group by all""")
def pixel_masks(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 64).alias("y"), (F.col("event_id") % 48).alias("x"), "value")
    return extractors.patch_mask(e, 16, 50.0, exact=True)


@query("select distinct source || '/' || lang as path from documents order by path")
def distinct_paths(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path")).distinct().orderBy("path")


_LEVELS = "".join(f", r{i} as (select r // 65536 as r, md5(string_agg(v, '' order by r)) as v from r{i - 1} group by r // 65536)" for i in range(2, 5))


@query(f"""with r1 as (select vec_id // 65536 as r, md5(string_agg(cast(vec_id as varchar), '' order by vec_id)) as v from embeddings group by vec_id // 65536){_LEVELS}
    select substring(max(v), 1, 8) as digest from r4""")
def dataset_digest(spark, sf_dir):
    return sampling.digest(X.table(spark, sf_dir, "embeddings"), "vec_id")


@query("""with c as (select event_type as batch, count(*) as n from events group by event_type), r as (select batch, sum(n) over (order by batch) - n as start, sum(n) over (order by batch) as stop from c)
    select batch, count(*) as n, sum(event_id) as ids from events join r on event_id >= start and event_id < stop group by batch""")
def rows_in_ranges(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    ranges = sampling.batch_ranges(e.groupBy(F.col("event_type").alias("batch")).agg(F.count("*").alias("n")), "batch")
    return sampling.rows_in_ranges(e, ranges, "event_id").groupBy("batch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"with {SQL_POST} select id, p, round(sum(g * case k when 0 then 1.0 when 1 then -0.5 when 2 then 0.25 else 2.0 end), 6) + 0.0 as contribution from post where valid group by id, p")
def contribution_maps(spark, sf_dir):
    m = X.model(spark, sf_dir)
    out = E.add_columns(X.patches(spark, sf_dir).where("valid"), ["x"], ["g"], lambda x: (kernels.posteriors(x, m["weight"], m["mean"], m["var"]),))
    c = layout.contribution_map(F.col("g"), F.array(*map(F.lit, (1.0, -0.5, 0.25, 2.0))))
    return out.select("id", F.col("p").cast("int").alias("p"), r6(c).alias("contribution"))


@query(f"""with v as (select vec_id as id, label as identity, embedding[1] as x, {"case cast(vec_id % 9 as int) " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(['right', 'frontright', 'left', 'backleft', 'front', 'back', 'upfrontleft', 'downbackleft', 'unknown'])) + " end"} as viewpoint from embeddings)
    select id, case when id % 5 = 0 then null when id % 5 = 1 then 'NaN' else 'i' || identity end as identity, id % 5 > 1 as has_identity, viewpoint, {SQL_COARSE.format('viewpoint')} as coarse from v""")
def labelled_points(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    name = F.when(F.col("vec_id") % 5 == 1, "NaN").otherwise(F.concat(F.lit("i"), "label"))
    ids = e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"), name.alias("identity"))
    views = e.select(F.col("vec_id").alias("id"), _view("vec_id").alias("viewpoint"))
    return layout.labelled(e.select(F.col("vec_id").alias("id")), ids, views).select("id", "identity", "has_identity", "viewpoint", "coarse")


@query(f"""with {X.SQL_DIMS}, b as (select id, case when id % 2 = 0 then 1.0 else 0.0 end / sqrt((select count(*) from v where id % 2 = 0)) as e1, case when id % 2 = 1 then 1.0 else 0.0 end / sqrt((select count(*) from v where id % 2 = 1)) as e2 from v),
    p as (select d, sum(e1 * x) as p1, sum(e2 * x) as p2 from dims join b using (id) group by d)
    select id, cast(d as bigint) as d, round(x - e1 * p1 - e2 * p2, 6) + 0.0 as x from dims join b using (id) join p using (d)""")
def residual_vectors(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    n = v.groupBy((F.col("id") % 2).alias("o")).agg(F.count("*").alias("n"))
    root = lambda o: F.when(F.col("id") % 2 == o, 1 / F.sqrt("n")).otherwise(0.0)
    basis = v.withColumn("o", F.col("id") % 2).join(F.broadcast(n), "o").select(F.col("id").alias("node"), F.array(root(0), root(1)).alias("vec"))
    out = graph.without_subspace(v, basis, "id", "vec")
    return rounded(metrics.dimensions(out, "vec", "node"), "x").select(F.col("node").alias("id"), F.col("d").cast("long").alias("d"), "x")


@query(f"with {SQL_HALVES} select q as query, count(*) filter (same) as n_same, count(*) as n from pick group by q")
def pose_neighbours(spark, sf_dir):
    v = X.vectors(spark, sf_dir).select("id", "identity", F.slice("vec", 1, 32).alias("semantic"))
    near = ranking.top_k(v, v, 22, "id", "semantic").where("rank > 2")
    side = v.select("id", "identity")
    both = near.join(side.toDF("query", "qi"), "query").join(side.toDF("candidate", "ci"), "candidate")
    return both.groupBy("query").agg(F.count_if(F.col("qi") == F.col("ci")).alias("n_same"), F.count("*").alias("n"))


@query()
def eigenvector_sweep(spark, sf_dir):
    """Metrics over growing slices of the graph's eigenvectors."""
    v = X.vectors(spark, sf_dir)
    vectors = graph.smallest_eigenvectors(graph.laplacian(graph.knn_edges(v, 10)), 11).join(v.select(F.col("id").alias("node"), "identity"), "node")
    out = None
    for n in (2, 5, 10):
        part = vectors.select(F.col("node").alias("id"), F.slice("vec", 2, n).alias("vec"), "identity")
        row = ranking.reid_metrics(part).withColumn("n_vectors", F.lit(n))
        out = row if out is None else out.union(row)
    return out


@query()
def viewpoint_subgraphs(spark, sf_dir):
    """Fisher ratio of the eigenvectors of each side's own graph; sides of fewer than 30 rows are left out."""
    v = X.vectors(spark, sf_dir).withColumn("side", L.coarse_viewpoint(_view("id"))).where("side is not null")
    sizes = {r.side: r["n"] for r in v.groupBy("side").agg(F.count("*").alias("n")).collect() if r["n"] >= 30}  # at most four sides
    out = None
    for side in sorted(sizes):
        own = sampling.at_least_two(v.where(F.col("side") == side), "identity")
        vectors = graph.smallest_eigenvectors(graph.laplacian(graph.knn_edges(own, 10)), 5)
        long = metrics.dimensions(vectors.join(own.select(F.col("id").alias("node"), "identity"), "node"), "vec", "identity")
        row = metrics.fisher_ratio(long, "identity", ["d"]).withColumn("side", F.lit(side))
        out = row if out is None else out.union(row)
    return out


# ---------------------------------------------------------------- stores and ingestion


def _place(spark):
    return f"{scratch.folder(spark)}/{uuid.uuid4().hex}"


@query("""select count(distinct event_id) as detections, 4 as batches, count(distinct user_id) as images, round(sum(value + case when event_id % 7 = 0 then 1 else 0 end), 4) as total,
    count(*) filter (event_id % 7 <> 0 and event_id % 3 = 1) as second, count(*) filter (event_id % 7 = 0 or event_id % 3 <> 1) as others from events""")
def detection_store(spark, sf_dir):
    """All events as detections in three batches, a seventh of them replaced by a fourth batch."""
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("detection_id"), F.col("user_id").cast("string").alias("image_path"), "event_id", "value")
    store = stores.Detections(spark, _place(spark))
    for b in range(3):
        store.write(e.where(F.col("event_id") % 3 == b).drop("event_id"), b)
    store.upsert(e.where("event_id % 7 = 0").drop("event_id").withColumn("value", F.col("value") + 1), 9)
    sums = store.read().agg(F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("batch") == 1).alias("second"))
    return store.counts().crossJoin(sums).crossJoin(store.without_batch(1).agg(F.count("*").alias("others")))  # one row each


@query("""select vec_id % 2 as batch, count(*) as n, min(len(embedding)) as dim, round(sum(cast(embedding[1] as double)), 4) as first, 'interleaved' as layout from embeddings group by all""")
def vector_store(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("detection_id"), F.col("embedding").alias("vec"))
    place = _place(spark)
    for b in range(2):
        stores.write_vectors(v.where(F.col("vec_id") % 2 == b), place, b, "interleaved", "fv")
    found = stores.read_or_none(spark, place)
    return found.groupBy(F.col("batch").cast("long").alias("batch"), "layout").agg(
        F.count("*").alias("n"), F.min("dim").cast("long").alias("dim"), F.round(F.sum(F.get("vec", F.lit(0)).cast("double")), 4).alias("first")
    )


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def ingested_events(spark, sf_dir):
    """The events streamed in from their files, each key once."""
    rows, place = X.table(spark, sf_dir, "events"), _place(spark)
    stream = ingest.read_files(spark, f"{sf_dir}/events.parque[t]", rows.schema)
    ingest.ingest(stream, f"{place}-out", f"{place}-done", f"{place}-log", lambda r: r, "event_id").awaitTermination()
    return stores.Detections(spark, f"{place}-out").read().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with v as (select vec_id, label from embeddings), m as (select a.vec_id as det, b.vec_id as gt, a.label from v a join v b on b.vec_id = a.vec_id + 1 and a.label = b.label)
    select count(*) as n, sum(det) as dets, sum(gt) as gts from m""")
def match_store(spark, sf_dir):
    """Matches computed once, kept with their parameters and read again."""
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    of = lambda: v.select(F.col("vec_id").alias("det"), "label", (F.col("vec_id") + 1).alias("gt")).join(v.select(F.col("vec_id").alias("gt"), "label"), ["gt", "label"])
    place = _place(spark)
    stores.cached_matches(spark, place, {"next": 1}, of)
    found = stores.cached_matches(spark, place, {"next": 1}, lambda: v.limit(0))
    return found.agg(F.count("*").alias("n"), F.sum("det").alias("dets"), F.sum("gt").alias("gts"))


_STORE = "select vec_id, vec_id // 3 as image, vec_id // 3 % 8 as b, embedding from embeddings"


def _stored(spark, sf_dir):
    """All vectors as detections of images in eight batches, and the marks of the images."""
    rows, place = X.table(spark, sf_dir, "embeddings"), _place(spark)
    rows = rows.select(F.col("vec_id").cast("string").alias("detection_id"), F.expr("vec_id div 3").alias("image_path"), "vec_id", "embedding", F.transform("embedding", lambda x: x > 0).alias("mask"))
    at = F.col("image_path") % 8
    rows.withColumn("batch", at.cast("int")).repartition("batch").write.partitionBy("batch").parquet(f"{place}-out")
    marks = rows.groupBy("image_path").agg(F.count("*").alias("n")).withColumn("batch", at.cast("int"))
    marks.write.partitionBy("batch").parquet(f"{place}-done")
    return rows, place


@query(f"""with d as ({_STORE}) select b as batch, count(*) as detections, min(len(embedding)) as least_dim, max(len(embedding)) as most_dim, 'float' as dtype, max(len(embedding)) * 4 / 1048576.0 as features_mb,
    max(len(embedding)) / 1024.0 as patch_mask_kb, true as has_files from d group by b""")
def batch_content(spark, sf_dir):
    """Content and size of every batch of a store of all vectors."""
    _, place = _stored(spark, sf_dir)
    out = stores.Detections(spark, f"{place}-out").content("embedding", "mask")
    return out.select(F.col("batch").cast("long").alias("batch"), "detections", F.col("least_dim").cast("long").alias("least_dim"), F.col("most_dim").cast("long").alias("most_dim"), "dtype", "features_mb", "patch_mask_kb", ((F.col("files") >= 1) & (F.col("mb") > 0)).alias("has_files"))


@query(f"""with d as ({_STORE}), n as (select *, case when b in (2, 5) then {ingest.REPAIRS} else b end as batch from d)
    select batch, count(*) as detections, count(distinct image) as images, sum(vec_id) as ids, count(distinct case when b in (2, 5) then image end) as recovered from n group by batch""")
def recovered_store(spark, sf_dir):
    """A store of all vectors of which one batch lost the content of its files and one has files that are no tables: the damaged
    batches are found and dropped with the marks of their images, which are then processed again."""
    rows, place = _stored(spark, sf_dir)
    store = stores.Detections(spark, f"{place}-out")
    for f in store.file_sizes().where("batch in (2, 5)").collect():  # the files of two batches
        files.overwrite(spark, f"{place}-out/batch={f.batch}/{f.name}", b"" if f.batch == 2 else b"no table at all")
    lost = ingest.recover(spark, f"{place}-out", f"{place}-done")
    images = rows.select("image_path").distinct()
    ingest.reprocess(images, lost, f"{place}-out", f"{place}-done", lambda again: rows.join(again, "image_path", "left_semi"))
    held = store.read().withColumn("again", F.when(F.col("batch") >= ingest.REPAIRS, F.col("image_path")))
    return held.groupBy(F.col("batch").cast("long").alias("batch")).agg(
        F.count("*").alias("detections"), F.countDistinct("image_path").alias("images"), F.sum("vec_id").alias("ids"), F.countDistinct("again").alias("recovered")
    )


@query(ORACLES["topk_neighbors"])
def pivot_neighbors(spark, sf_dir):
    """The rows of topk_neighbors, by pivots."""
    v = X.vectors(spark, sf_dir)
    return pivots.top_k(v, v, 5, image_col="image").select("query", "candidate", "similarity", F.col("rank").cast("long").alias("rank"))


SQL_SHARES = f"""{SQL_SIM}, near as (select q as src, c as dst, greatest(0, 2 - 2 * s) as d, row_number() over (partition by q order by s desc, c) as rk from sim),
    lists as (select src, list(dst order by rk) as dst, list(d order by rk) as d0 from near where rk <= 90 group by src),
    base as (select src, dst, list_transform(d0, lambda v: v - d0[1]) as d from lists),
    widths as (select src, dst, d, cast(-64 as double) as low, cast(64 as double) as high, 0 as step from base
        union all select src, dst, d, case when wide then t else low end, case when wide then high else t end, step + 1 from (
            select *, ln(s) + pow(2, t) * list_sum(list_transform(d, lambda v: v * exp(-v * pow(2, t)))) / s > ln(30) as wide from (
                select *, list_sum(list_transform(d, lambda v: exp(-v * pow(2, t)))) as s from (select *, (low + high) / 2 as t from widths where step < {maps.STEPS})))),
    weights as (select src, dst, list_transform(d, lambda v: exp(-v * pow(2, (low + high) / 2))) as w from widths where step = {maps.STEPS}),
    shares as (select src, unnest(dst) as dst, unnest(list_transform(w, lambda v: v / list_sum(w))) as p from weights),
    pairs as (select src, dst, sum(p) / 2 / (select count(*) from v) as p from (select src, dst, p from shares union all select dst, src, p from shares) group by src, dst)"""


def _affinities(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return maps.affinities(ranking.top_k(v, v, 90), 30.0)


@query(f"with recursive {SQL_SHARES} select src, dst, round(p * (select count(*) from v), 6) as weight from pairs")
def neighbour_affinities(spark, sf_dir):
    """Weights of the pairs of a map of all vectors, times the number of rows."""
    n = X.table(spark, sf_dir, "embeddings").count()
    return _affinities(spark, sf_dir).select("src", "dst", r6(F.col("p") * n).alias("weight"))


SQL_PLACES = """places as (select id, vec[1] * 64 as x, vec[33] * 64 as y from v),
    frame as (select min(x) as x0, min(y) as y0, greatest(max(x) - min(x), max(y) - min(y)) / 64 as w from places),
    put as (select id, x, y, least(63, floor((x - x0) / w)) * 64 + least(63, floor((y - y0) / w)) as cell from places, frame),
    cells as (select cell, count(*) as n, sum(x) as sx, sum(y) as sy from put group by cell),
    others as (select id, x, y, case when own then n - 1 else n end as n, case when own then sx - x else sx end as sx, case when own then sy - y else sy end as sy
        from (select p.id, p.x, p.y, c.n, c.sx, c.sy, p.cell = c.cell as own from put p, cells c)),
    apart as (select id, n, x - sx / n as dx, y - sy / n as dy from others where n > 0),
    push as (select id, sum(n * dx / (1 + dx * dx + dy * dy) ** 2) as rx, sum(n * dy / (1 + dx * dx + dy * dy) ** 2) as ry, sum(n / (1 + dx * dx + dy * dy)) as q from apart group by id),
    pull as (select src as id, sum(p * dx / (1 + dx * dx + dy * dy)) as ax, sum(p * dy / (1 + dx * dx + dy * dy)) as ay
        from (select e.src, e.p, a.x - b.x as dx, a.y - b.y as dy from pairs e join places a on a.id = e.src join places b on b.id = e.dst) group by src)"""


@query(f"""with recursive {SQL_SHARES}, {SQL_PLACES} select id, round(4 * (ax - rx / (select sum(q) from push)) * (select count(*) from v), 6) as gx,
    round(4 * (ay - ry / (select sum(q) from push)) * (select count(*) from v), 6) as gy, round(q, 6) as near from push join pull using (id)""")
def map_gradient(spark, sf_dir):
    """The gradient of a map that starts at two components of the vectors, times the number of rows."""
    places = X.vectors(spark, sf_dir).select("id", (F.get("vec", F.lit(0)) * 64).alias("x"), (F.get("vec", F.lit(32)) * 64).alias("y"))
    found = scratch.written(maps.forces(*maps.laid(places, _affinities(spark, sf_dir))))
    sums = found.agg(F.sum(F.col("push")[2]).alias("q"), F.count("*").alias("n")).first()
    slope = maps.gradient(found, sums.q)
    return found.select("id", *[r6(slope[c] * sums.n).alias(c) for c in ("gx", "gy")], r6(F.col("push")[2]).alias("near"))
