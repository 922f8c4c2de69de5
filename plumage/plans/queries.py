"""The queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumage.functions import geometry as G
from plumage.functions import labels as L
from plumage.functions import vec as V
from plumage.operators import encode as E
from plumage.operators import graph, kernels, matching, metrics, models, ranking, sampling
from plumage.plans import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# ---------------------------------------------------------------- ranking

SQL_SIM = f"""{X.SQL_VECTORS}, u as (select *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) + 1e-8 as n from v),
    sim as (select q.id as q, c.id as c, q.identity as qi, c.identity as ci, q.image as qm, c.image as cm,
        round(list_dot_product(q.vec, c.vec) / q.n / c.n, 9) as s from u q, u c where q.id <> c.id)"""


@query(f"""with {SQL_SIM}, ranked as (select q, qi, ci, row_number() over (partition by q order by s desc, c) as rk from sim where qm <> cm),
    firsts as (select v.id, (select min(rk) from ranked r where r.q = v.id and r.qi = r.ci) as rk from v)
    select round(avg(case when rk <= 1 then 1.0 else 0.0 end), 6) as top1, round(avg(case when rk <= 5 then 1.0 else 0.0 end), 6) as top5,
    round(avg(case when rk <= 10 then 1.0 else 0.0 end), 6) as top10, round(avg(coalesce(1.0 / rk, 0)), 6) as mrr, count(*) as n_queries from firsts""")
def reid_metrics(spark, sf_dir):
    out = ranking.reid_metrics(X.vectors(spark, sf_dir), image_col="image")
    return rounded(out, "top1", "top5", "top10", "mrr")


@query(f"""with {SQL_SIM} select q as query, c as candidate, s as similarity, rk as rank from
    (select q, c, s, row_number() over (partition by q order by s desc, c) as rk from sim where qm <> cm) where rk <= 5""")
def topk_neighbors(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return ranking.top_k(v, v, 5, image_col="image").withColumn("rank", F.col("rank").cast("long"))


SQL_TWO = f"""{SQL_SIM}, ab as (select q as i, c as j, s from sim where q % 2 = 0 and c % 2 = 1),
    fwd as (select *, row_number() over (partition by i order by s desc, j) as ri, row_number() over (partition by j order by s desc, i) as rj from ab)"""


def _two(spark, sf_dir):
    """Even against odd images."""
    v = X.vectors(spark, sf_dir)
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


@query(f"with {SQL_TWO} select i, j, s as similarity from fwd where ri = 1 and rj = 1 and s >= 0.0")
def mutual_nearest(spark, sf_dir):
    return ranking.mutual_nearest(*_two(spark, sf_dir))


@query(f"""with {SQL_TWO} select a.i, a.j, a.s as similarity from fwd a join fwd b on a.i = b.i and b.ri = 2
    where a.ri = 1 and a.s > 0 and b.s / a.s < 0.9""")
def ratio_test(spark, sf_dir):
    return ranking.ratio_test(*_two(spark, sf_dir), ratio=0.9)


@query(f"with {SQL_TWO} select i, j, s as similarity, ri as rank from fwd where ri <= 3 and s >= 0.1")
def topk_matches(spark, sf_dir):
    return ranking.top_k_matches(*_two(spark, sf_dir), 3, 0.1).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {SQL_TWO} select count(*) as n, round(avg(s), 6) as mean from fwd where ri = 1 and rj = 1 and s >= 0.0")
def mean_match_similarity(spark, sf_dir):
    m = ranking.mutual_nearest(*_two(spark, sf_dir))
    return m.agg(F.count("*").alias("n"), r6(F.avg("similarity")).alias("mean"))


# ---------------------------------------------------------------- class separation


@query(f"""with {X.SQL_DIMS}, c as (select d, identity, count(*) as n, avg(x) as m, var_pop(x) as s from dims group by all),
    t as (select d, avg(x) as mean from dims group by d)
    select cast(d as bigint) as d, round(sum(n * (m - mean) * (m - mean)) / greatest(sum(n * s), 1e-20), 6) as ratio from c join t using (d) where n >= 2 group by d""")
def fisher_ratio(spark, sf_dir):
    long = metrics.dimensions(X.vectors(spark, sf_dir), "vec", "identity")
    return rounded(metrics.fisher_ratio(long, "identity", ["d"]), "ratio").withColumn("d", F.col("d").cast("long"))


@query(f"""with {X.SQL_VECTORS}, p as (select round(-list_distance(a.vec, b.vec), 4) as s, a.identity = b.identity as same from v a, v b where a.id < b.id),
    h as (select s, count(*) filter (same) as p, count(*) filter (not same) as q from p group by s),
    l as (select p, q, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding), 0) as lower from h)
    select round(sum(p * (lower + q / 2.0)) / (sum(p) * cast(sum(q) as double)), 4) as auc from l""")
def same_class_auc(spark, sf_dir):
    out = metrics.same_class_auc(X.vectors(spark, sf_dir), "id", "vec", "identity")
    return out.select((F.round("auc", 4) + 0.0).alias("auc"))


SQL_HALVES = f"""{X.SQL_VECTORS}, h as (select id, identity, vec[1:32] as a, vec[33:64] as b from v),
    u as (select *, sqrt(list_dot_product(a, a)) + 1e-8 as na, sqrt(list_dot_product(b, b)) + 1e-8 as nb from h),
    near as (select q.id as q, q.identity = c.identity as same, round(list_dot_product(q.b, c.b) / (q.nb * c.nb), 9) as s,
        row_number() over (partition by q.id order by round(list_dot_product(q.a, c.a) / q.na / c.na, 9) desc, c.id) as rk from u q, u c where q.id <> c.id),
    pick as (select * from near where rk > 2 and rk <= 22), few as (select q from pick group by q having count(*) filter (same) >= 1),
    good as (select * from pick where q in (select q from few))"""


@query(f"""with {SQL_HALVES}, hist as (select s, count(*) filter (same) as p, count(*) filter (not same) as q from good group by s),
    l as (select p, q, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding), 0) as lower from hist),
    a as (select round(sum(p * (lower + q / 2.0)) / (sum(p) * cast(sum(q) as double)), 6) as auc from l)
    select auc, (select count(*) filter (same) from good) as n_same, (select count(*) filter (not same) from good) as n_diff,
    (select round(avg(s) filter (same), 6) from good) as mean_same, (select round(avg(s) filter (not same), 6) from good) as mean_diff,
    (select round(stddev_pop(s) filter (same), 6) from good) as std_same, (select round(stddev_pop(s) filter (not same), 6) from good) as std_diff,
    case when auc > 0.7 then 'strong' when auc > 0.55 then 'weak' else 'none' end as verdict from a""")
def texture_diagnostic(spark, sf_dir):
    v = X.vectors(spark, sf_dir).select("id", "identity", F.slice("vec", 1, 32).alias("semantic"), F.slice("vec", 33, 32).alias("textural"))
    out = metrics.texture_separation(v, neighbours=20, skip=2)
    return rounded(out, "auc", "mean_same", "mean_diff", "std_same", "std_diff")


# ---------------------------------------------------------------- descriptors


@query(f"""with {X.SQL_PATCH}, m as (select id, d, coalesce(avg(x) filter (valid), 0) as x from patch group by id, d),
    n as (select id, sqrt(sum(x * x)) as n from m group by id) select id, cast(d as bigint) as d, round(case when n > 0 then x / n else x end, 6) + 0.0 as x from m join n using (id)""")
def masked_pool(spark, sf_dir):
    out = metrics.pooled(X.patches(spark, sf_dir), "id", "valid", "x")
    return rounded(metrics.dimensions(out, "vec", "detection"), "x").select(F.col("detection").alias("id"), F.col("d").cast("long").alias("d"), "x")


@query(f"""with {X.SQL_DIMS} select id, count(*) as dim, round(sqrt(sum(x * x)), 6) as l2_norm, round(min(x), 6) as least, round(max(x), 6) as greatest, round(avg(x), 6) + 0.0 as mean,
    round(stddev_pop(x), 6) as std, round(avg(case when x = 0 then 1.0 else 0.0 end), 6) as sparsity from dims group by id""")
def vector_stats(spark, sf_dir):
    out = X.vectors(spark, sf_dir).select("id", V.stats("vec").alias("s")).select("id", "s.*").withColumn("dim", F.col("dim").cast("long"))
    return rounded(out, "l2_norm", "least", "greatest", "mean", "std", "sparsity")


SQL_POST = f"""{X.SQL_PATCH} {X.SQL_MODEL}, ll as (select patch.id, p, valid, k, ln(any_value(w) + 1e-10) - 0.5 * sum(ln(v) + (x - m) * (x - m) / v) as l from patch join comp using (d) group by patch.id, p, valid, k),
    mx as (select *, exp(l - max(l) over (partition by id, p)) as e from ll), post as (select id, p, valid, k, e / sum(e) over (partition by id, p) as g from mx)"""


@query(f"with {SQL_POST} select id, p, k, round(g, 6) + 0.0 as g from post where valid")
def patch_posteriors(spark, sf_dir):
    m = X.model(spark, sf_dir)
    out = E.add_columns(X.patches(spark, sf_dir).where("valid"), ["x"], ["g"], lambda x: (kernels.posteriors(x, m["weight"], m["mean"], m["var"]),))
    return rounded(out.select("id", F.col("p").cast("int").alias("p"), F.posexplode("g").alias("k", "g")), "g").withColumn("k", F.col("k").cast("long"))


SQL_FV = f"""{SQL_POST}, gz as (select post.id, k, d, sum(g * (x - m) / sqrt(v)) as z1, sum(g * ((x - m) * (x - m) / v - 1)) as z2
        from post join patch using (id, p) join comp using (k, d) where post.valid group by post.id, k, d),
    nk as (select id, k, sum(g) as s, count(*) as n from post where valid group by id, k),
    raw as (select id, k * 9 + 1 as pos, case when s < 1e-10 then 0 else sqrt(s / n) end as x from nk
        union all select gz.id, k * 9 + 1 + d, case when s < 1e-10 then 0 else z1 / sqrt(s) end from gz join nk using (id, k)
        union all select gz.id, k * 9 + 5 + d, case when s < 1e-10 then 0 else z2 / sqrt(2 * s) end from gz join nk using (id, k)),
    pw as (select id, pos, sign(x) * sqrt(abs(x)) as x from raw)"""


def _weight_vectors(spark, sf_dir):
    m = X.model(spark, sf_dir)
    return E.encode(X.patches(spark, sf_dir), kernels.WeightEncoder(m["weight"], m["mean"], m["var"]), "id", ["x"], "valid")


@query(f"""with {SQL_FV}, n as (select id, sqrt(sum(x * x)) as n from pw group by id)
    select id, cast(pos as bigint) as pos, round(case when n > 1e-10 then x / n else x end, 6) + 0.0 as x from pw join n using (id)""")
def weight_fisher_vectors(spark, sf_dir):
    out = _weight_vectors(spark, sf_dir).select("detection", V.power_unit("vec").alias("vec"))
    return rounded(metrics.dimensions(out, "vec", "detection"), "x").select(F.col("detection").alias("id"), F.col("d").cast("long").alias("pos"), "x")


@query(f"""with {SQL_FV}, keep as (select id, pos, case when (pos - 1) % 9 between 1 and 3 then x else 0 end as x from pw), n as (select id, sqrt(sum(x * x)) as n from keep group by id)
    select id, cast(pos as bigint) as pos, round(x / greatest(n, 1e-10), 6) + 0.0 as x from keep join n using (id)""")
def masked_fisher_vectors(spark, sf_dir):
    mask = V.block_mask(4, 4, use_weight=False, use_var=False, max_dim=3)
    out = _weight_vectors(spark, sf_dir).select("detection", V.masked_power_unit("vec", mask).alias("vec"))
    return rounded(metrics.dimensions(out, "vec", "detection"), "x").select(F.col("detection").alias("id"), F.col("d").cast("long").alias("pos"), "x")


@query(f"""with {X.SQL_VECTORS}, a as (select id, vec[1:36] as x from v), b as (select l.id, l.x as x, r.x as y from a l join a r on r.id = l.id + 1 where l.id % 2 = 0),
    c as (select id, unnest([0, 1, 2, 3]) as k, x, y from b)
    select id, cast(k as bigint) as k, round(x[k + 1] * y[k + 1], 6) + 0.0 as weight, round(list_dot_product(x[5 + 4 * k : 8 + 4 * k], y[5 + 4 * k : 8 + 4 * k]), 6) + 0.0 as mean,
    round(list_dot_product(x[21 + 4 * k : 24 + 4 * k], y[21 + 4 * k : 24 + 4 * k]), 6) + 0.0 as var from c""")
def similarity_decomposition(spark, sf_dir):
    a = X.vectors(spark, sf_dir).select("id", F.slice("vec", 1, 36).alias("x"))
    both = a.where("id % 2 = 0").join(a.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    out = both.select("id", F.explode(V.decompose("x", "y", 4, 4)).alias("c")).select("id", "c.*").withColumn("k", F.col("k").cast("long"))
    return rounded(out, "weight", "mean", "var")


SQL_SEM = f"""{X.SQL_PAIRS} {X.SQL_MLR}, ls as (select sdim.id, p, k, -0.5 * sum(ln(2 * pi() * v) + (x - m) * (x - m) / v) as l from sdim join comp using (d) group by sdim.id, p, k),
    sp as (select id, p, k, exp(l - max(l) over (partition by id, p)) as e from ls), sem as (select id, p, k, e / sum(e) over (partition by id, p) as g from sp),
    dev as (select sdim.id, p, k, d as j, x - m as y from sdim join comp using (d)),
    pr as (select dev.id, p, k, i as d, sum(a * y) as q from dev join amat using (k, j) group by dev.id, p, k, i),
    res as (select tdim.id, tdim.p, pr.k, tdim.d, x - mt.m - q as r from tdim join pr using (id, p, d) join mt on mt.k = pr.k and mt.d = tdim.d),
    lj as (select res.id, res.p, res.k, any_value(ls.l) - 0.5 * sum(ln(2 * pi() * 0.03) + r * r / 0.03) as l from res join ls on ls.id = res.id and ls.p = res.p and ls.k = res.k group by res.id, res.p, res.k),
    je as (select id, p, k, l, exp(l - max(l) over (partition by id, p)) as e from lj), joint as (select id, p, k, l, e / sum(e) over (partition by id, p) as g from je)"""


@query(f"with {SQL_SEM} select id, p, k, round(sem.g, 6) + 0.0 as semantic, round(joint.g, 6) + 0.0 as joint from sem join joint using (id, p, k)")
def regression_posteriors(spark, sf_dir):
    m = X.model(spark, sf_dir)
    out = E.add_columns(X.pairs(spark, sf_dir), ["s", "t"], ["a", "b"], lambda s, t: (kernels.semantic_posteriors(s, m), kernels.joint_posteriors(s, t, m)[0]))
    out = out.select("id", F.col("p").cast("int").alias("p"), F.posexplode(F.arrays_zip("a", "b")).alias("k", "g"))
    return rounded(out.select("id", "p", F.col("k").cast("long").alias("k"), F.col("g.a").alias("semantic"), F.col("g.b").alias("joint")), "semantic", "joint")


@query(f"""with {SQL_SEM}, ga as (select i, j, a from amat where k = 0), gb as (select d, b from bvec where k = 0),
    gr as (select tdim.id, tdim.p, tdim.d, any_value(tdim.x) - sum(a * sdim.x) - any_value(b) as r from tdim join ga on ga.i = tdim.d join sdim on sdim.id = tdim.id and sdim.p = tdim.p and sdim.d = ga.j join gb on gb.d = tdim.d group by tdim.id, tdim.p, tdim.d),
    lr as (select gr.id, gr.p, mr.k, sum(-0.5 * (ln(2 * pi() * 0.03) + (r - mr.m) * (r - mr.m) / 0.03)) as l from gr join mr using (d) group by gr.id, gr.p, mr.k),
    lt as (select id, p, k, lr.l + ls.l as l from lr join ls using (id, p, k)), le as (select id, p, k, exp(l - max(l) over (partition by id, p)) as e from lt),
    rp as (select id, p, k, e / sum(e) over (partition by id, p) as g from le)
    select id, p, k, round(rp.g - sem.g, 6) + 0.0 as shift from rp join sem using (id, p, k)""")
def posterior_shift(spark, sf_dir):
    m = X.model(spark, sf_dir)
    m = m | {"var_r": m["var_rr"]}
    out = E.add_columns(X.pairs(spark, sf_dir), ["s", "t"], ["g"], lambda s, t: (kernels.residual_posteriors(s, t, m) - kernels.semantic_posteriors(s, m),))
    return rounded(out.select("id", F.col("p").cast("int").alias("p"), F.posexplode("g").alias("k", "shift")), "shift").withColumn("k", F.col("k").cast("long"))


@query(f"""with {SQL_SEM}, z as (select res.id, res.k, d, sum(g * r / sqrt(0.03 + 1e-10)) as z1, sum(g * (r * r / (0.03 + 1e-10) - 1)) as z2 from res join joint on joint.id = res.id and joint.p = res.p and joint.k = res.k group by res.id, res.k, d),
    raw as (select id, k * 4 + d as pos, z1 / sqrt(0.25 + 1e-10) as x from z union all select id, 16 + k * 4 + d, z2 / sqrt(0.5 + 1e-10) from z),
    pw as (select id, pos, sign(x) * sqrt(abs(x)) as x from raw), n as (select id, sqrt(sum(x * x)) as n from pw group by id)
    select id, cast(pos as bigint) as pos, round(case when n > 1e-10 then x / n else x end, 6) + 0.0 as x from pw join n using (id)""")
def mlr_fisher_vectors(spark, sf_dir):
    out = E.encode(X.pairs(spark, sf_dir), kernels.RegressionEncoder(X.model(spark, sf_dir)), "id", ["s", "t"])
    return rounded(metrics.dimensions(out, "vec", "detection"), "x").select(F.col("detection").alias("id"), F.col("d").cast("long").alias("pos"), "x")


@query(f"""with {SQL_SEM}, ca as (select sdim.id, p, k, i as d, sum(a * x) as q from sdim join amat on amat.j = sdim.d group by sdim.id, p, k, i),
    cr as (select tdim.id, tdim.p, ca.k, tdim.d, x - q - b as r from tdim join ca using (id, p, d) join bvec on bvec.k = ca.k and bvec.d = tdim.d),
    cl as (select sdim.id, p, k, ln(0.25 + 1e-10) - 0.5 * sum(ln(v) + (x - m) * (x - m) / v) as l from sdim join comp using (d) group by sdim.id, p, k),
    ce as (select id, p, k, exp(l - max(l) over (partition by id, p)) as e from cl), cg as (select id, p, k, e / sum(e) over (partition by id, p) as g from ce),
    z as (select cr.id, cr.k, d, sum(g * r / sqrt(0.03)) as z1, sum(g * (r * r / 0.03 - 1)) as z2 from cr join cg on cg.id = cr.id and cg.p = cr.p and cg.k = cr.k group by cr.id, cr.k, d),
    raw as (select id, k * 4 + d as pos, z1 / sqrt(0.25 + 1e-10) as x from z union all select id, 16 + k * 4 + d, z2 / (sqrt(2) * sqrt(0.25 + 1e-10)) from z),
    pw as (select id, pos, sign(x) * sqrt(abs(x)) as x from raw), n as (select id, sqrt(sum(x * x)) as n from pw group by id)
    select id, cast(pos as bigint) as pos, round(case when n > 1e-10 then x / n else x end, 6) + 0.0 as x from pw join n using (id)""")
def conditional_fisher_vectors(spark, sf_dir):
    out = E.encode(X.pairs(spark, sf_dir), kernels.RegressionEncoder(X.model(spark, sf_dir), "conditional"), "id", ["s", "t"])
    return rounded(metrics.dimensions(out, "vec", "detection"), "x").select(F.col("detection").alias("id"), F.col("d").cast("long").alias("pos"), "x")


# ---------------------------------------------------------------- fitting


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query(f"""with {SQL_POST}, lw as (select id, p, k, l - 0.5 * 4 * ln(2 * pi()) - ln(0.25 + 1e-10) + ln(0.25 + 1e-300) as l from ll),
    e as (select id, p, k, exp(l - max(l) over (partition by id, p)) as e from lw), g as (select id, p, k, e / sum(e) over (partition by id, p) as g from e),
    s as (select k, sum(g) as s0 from g group by k), mu as (select g.k, d, sum(g * x) / any_value(s0) as mean from g join patch using (id, p) join s on s.k = g.k group by g.k, d)
    select cast(g.k as bigint) as k, cast(patch.d as bigint) as d, round(any_value(s0) / (select count(*) from (select distinct id, p from g)), 6) as weight, round(any_value(mean), 6) + 0.0 as mean,
    round(sum(g * (x - mean) * (x - mean)) / any_value(s0) + 1e-6, 6) as var from g join patch using (id, p) join s on s.k = g.k join mu on mu.k = g.k and mu.d = patch.d group by g.k, patch.d""")
def gmm_step(spark, sf_dir):
    m = X.model(spark, sf_dir)
    new, _ = models.gmm_step(X.patches(spark, sf_dir), "x", {k: m[k] for k in ("weight", "mean", "var")})
    rows = [(k, d + 1, float(new["weight"][k]), float(new["mean"][k, d]), float(new["var"][k, d])) for k in range(4) for d in range(4)]
    return rounded(_frame(spark, rows, "k long, d long, weight double, mean double, var double"), "weight", "mean", "var")


@query(f"""with {X.SQL_PATCH} {X.SQL_MODEL}, q as (select patch.id, p, k, sum((x - m) * (x - m)) as ss, sum(x - m) as s1 from patch join comp using (d) group by patch.id, p, k),
    lw as (select id, p, k, -0.5 * (4 * ln(2 * pi()) + 3 * ln(0.02) + ln(0.06) + (ss - 0.01 / 0.06 * s1 * s1) / 0.02) as l from q),
    e as (select id, p, k, exp(l - max(l) over (partition by id, p)) as e from lw), g as (select id, p, k, e / sum(e) over (partition by id, p) as g from e),
    s as (select k, sum(g) as s0 from g group by k), y as (select g.id, g.p, g.k, d, g, x, s0, sum(g * x) over (partition by g.k, d) / s0 as mean from g join patch using (id, p) join s on s.k = g.k)
    select a.k, cast(a.d as bigint) as i, cast(b.d as bigint) as j, round(any_value(a.mean), 6) + 0.0 as mean, round(sum(a.g * (a.x - a.mean) * (b.x - b.mean)) / any_value(a.s0) + case when a.d = b.d then 1e-6 else 0 end, 6) + 0.0 as cov
    from y a join y b on a.id = b.id and a.p = b.p and a.k = b.k group by a.k, a.d, b.d""")
def gmm_full_step(spark, sf_dir):
    """One turn with full covariances, from 0.02 I + 0.01."""
    m = X.model(spark, sf_dir)
    k, d = m["mean"].shape
    new, _ = models.gmm_step(X.patches(spark, sf_dir), "x", {"weight": m["weight"], "mean": m["mean"], "var": np.tile(0.02 * np.eye(d) + 0.01, (k, 1, 1))})
    rows = [(a, i + 1, j + 1, float(new["mean"][a, i]), float(new["var"][a, i, j])) for a in range(k) for i in range(d) for j in range(d)]
    return rounded(_frame(spark, rows, "k long, i long, j long, mean double, cov double"), "mean", "cov")


@query(f"""with {SQL_SEM}, n as (select k, sum(g) as n from joint group by k),
    ms as (select joint.k, d, sum(g * x) / any_value(n) as m from joint join sdim using (id, p) join n on n.k = joint.k group by joint.k, d),
    nt as (select joint.k, d, sum(g * x) / any_value(n) as m from joint join tdim using (id, p) join n on n.k = joint.k group by joint.k, d),
    vs as (select joint.k, sdim.d, sum(g * (x - ms.m) * (x - ms.m)) / any_value(n) + 1e-3 as v from joint join sdim using (id, p) join n on n.k = joint.k join ms on ms.k = joint.k and ms.d = sdim.d group by joint.k, sdim.d),
    na as (select joint.k, tdim.d as i, sdim.d as j, sum(g * (tdim.x - nt.m) * (sdim.x - ms.m)) / any_value(n) / any_value(vs.v) as a from joint join sdim using (id, p) join tdim on tdim.id = joint.id and tdim.p = joint.p
        join n on n.k = joint.k join ms on ms.k = joint.k and ms.d = sdim.d join nt on nt.k = joint.k and nt.d = tdim.d join vs on vs.k = joint.k and vs.d = sdim.d group by joint.k, tdim.d, sdim.d),
    pr2 as (select sdim.id, sdim.p, na.k, na.i as d, sum(na.a * (sdim.x - ms.m)) as q from sdim join na on na.j = sdim.d join ms on ms.k = na.k and ms.d = sdim.d group by sdim.id, sdim.p, na.k, na.i),
    vr as (select joint.k, tdim.d, sum(g * (tdim.x - nt.m - q) * (tdim.x - nt.m - q)) / any_value(n) + 1e-3 as v from joint join tdim using (id, p) join pr2 on pr2.id = joint.id and pr2.p = joint.p and pr2.k = joint.k and pr2.d = tdim.d
        join nt on nt.k = joint.k and nt.d = tdim.d join n on n.k = joint.k group by joint.k, tdim.d)
    select cast(na.k as bigint) as k, cast(i as bigint) as i, cast(j as bigint) as j, round(a, 6) + 0.0 as a, round(vs.v, 6) as var_s, round(vr.v, 6) as var_r from na join vs on vs.k = na.k and vs.d = na.j join vr on vr.k = na.k and vr.d = na.i""")
def mlr_step(spark, sf_dir):
    m = X.model(spark, sf_dir)
    new, _ = models.mlr_step(X.pairs(spark, sf_dir), "s", "t", m)
    rows = [(k, i + 1, j + 1, float(new["a"][k, i, j]), float(new["var_s"][k, j]), float(new["var_r"][k, i])) for k in range(4) for i in range(4) for j in range(4)]
    return rounded(_frame(spark, rows, "k long, i long, j long, a double, var_s double, var_r double"), "a", "var_s", "var_r")


@query(f"""with {X.SQL_DIMS}, f as (select id, d, x from dims), m as (select d, avg(x) as m from f group by d)
    select cast(a.d as bigint) as i, cast(b.d as bigint) as j, round(sum((a.x - ma.m) * (b.x - mb.m)) / (count(*) - 1), 6) + 0.0 as cov from f a join f b using (id) join m ma on ma.d = a.d join m mb on mb.d = b.d group by a.d, b.d""")
def pca_covariance(spark, sf_dir):
    m = models.moments(X.vectors(spark, sf_dir), "vec", 64)
    p = models.pca(m)
    cov = p["components"].T @ np.diag(p["variance"]) @ p["components"]
    return rounded(_frame(spark, [(i + 1, j + 1, float(cov[i, j])) for i in range(64) for j in range(64)], "i long, j long, cov double"), "cov")


@query()
def pca_projection(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return models.pca_transform(v, models.pca(models.moments(v, "vec", 64), 0, 16), "vec").select("id", "projected")


@query(f"""with {X.SQL_VECTORS}, w as (select vec[1] as s, vec[33] as t, 1.0 as g from v), m as (select avg(s) as ms, avg(t) as mt from w),
    c as (select avg((s - ms) * (s - ms)) + 1e-6 as css, avg((t - mt) * (s - ms)) as cts, any_value(ms) as ms, any_value(mt) as mt from w, m)
    select round(cts / css, 6) as a, round(mt - cts / css * ms, 6) as b, (select round(avg((t - cts / css * s - (mt - cts / css * ms)) ** 2), 6) from w) as var from c""")
def conditional_regression(spark, sf_dir):
    v = X.vectors(spark, sf_dir).select(F.slice("vec", 1, 1).alias("s"), F.slice("vec", 33, 1).alias("t"))
    one = {"weight": np.ones(1), "mean": np.zeros((1, 1)), "var": np.ones((1, 1))}
    m = models.conditional_fit(v, "s", "t", one)
    return rounded(_frame(spark, [(float(m["a"][0, 0, 0]), float(m["b"][0, 0]), float(m["var_r"][0, 0]))], "a double, b double, var double"), "a", "b", "var")


@query()
def gmm_fit(spark, sf_dir):
    m = models.gmm_fit(X.patches(spark, sf_dir).withColumn("key", F.col("id") * 16 + F.col("p")), "x", "key", 4)
    return _frame(spark, [(k, float(m["weight"][k]), m["mean"][k].tolist(), m["var"][k].tolist()) for k in range(4)], "k int, weight double, mean array<double>, var array<double>")


# ---------------------------------------------------------------- graphs

SQL_KNN = f"""{X.SQL_VECTORS}, nn as (select a.id as q, b.id as c, row_number() over (partition by a.id order by round(-list_distance(a.vec, b.vec), 9) desc, b.id) as rk from v a, v b where a.id <> b.id),
    half as (select q as src, c as dst from nn where rk <= 9), edges as (select src, dst from half union select dst, src from half),
    deg as (select src as node, count(*) as degree from edges group by src)"""


@query(f"with {SQL_KNN} select src, dst from edges")
def knn_graph(spark, sf_dir):
    return graph.knn_edges(X.vectors(spark, sf_dir), 10)


@query(f"with {SQL_KNN} select node, degree from deg")
def knn_degrees(spark, sf_dir):
    return graph.degrees(graph.knn_edges(X.vectors(spark, sf_dir), 10))


@query(f"""with {SQL_KNN} select src as i, dst as j, round(-1 / sqrt(a.degree) / sqrt(b.degree), 6) as value from edges join deg a on a.node = src join deg b on b.node = dst
    union all select node, node, 1.0 from deg""")
def normalised_laplacian(spark, sf_dir):
    return rounded(graph.laplacian(graph.knn_edges(X.vectors(spark, sf_dir), 10)), "value")


@query()
def laplacian_polar(spark, sf_dir):
    return graph.polar(graph.smallest_eigenvectors(graph.laplacian(graph.knn_edges(X.vectors(spark, sf_dir), 10)), 6))


# ---------------------------------------------------------------- boxes

SQL_BOXES = """b as (select l_orderkey as image, l_linenumber as ln, (min(l_partkey) * 37 + l_linenumber * 101) % 400 as x1, (min(l_suppkey) * 53 + l_linenumber * 67) % 300 as y1,
        80 + 4 * min(l_quantity) as w, 60 + 3 * min(l_quantity) as h from lineitem group by l_orderkey, l_linenumber),
    box as (select image, ln, image * 10 + ln as id, cast(x1 as double) as x1, cast(y1 as double) as y1, cast(x1 + w as double) as x2, cast(y1 + h as double) as y2 from b),
    pair as (select d.image, d.id as det, g.id as gt, d.x1 as dx1, d.y1 as dy1, d.x2 as dx2, d.y2 as dy2, g.x1, g.y1, g.x2, g.y2 from box d join box g on d.image = g.image and d.ln % 2 = 0 and g.ln % 2 = 1
        and d.x1 < g.x2 and g.x1 < d.x2 and d.y1 < g.y2 and g.y1 < d.y2)"""


def _boxes(spark, sf_dir):
    b = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    x1, y1 = ((F.col("a") * 37 + F.col("l_linenumber") * 101) % 400).cast("double"), ((F.col("s") * 53 + F.col("l_linenumber") * 67) % 300).cast("double")
    return b.select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("ln"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        G.xywh(x1, y1, 80 + 4 * F.col("q"), 60 + 3 * F.col("q")).alias("box"),
    )


@query(f"""with {SQL_BOXES}, a as (select *, (least(dx2, x2) - greatest(dx1, x1)) * (least(dy2, y2) - greatest(dy1, y1)) as inter from pair),
    s as (select image, det, gt, inter / ((dx2 - dx1) * (dy2 - dy1) + (x2 - x1) * (y2 - y1) - inter) as iou from a),
    r as (select *, row_number() over (partition by det order by round(iou, 9) desc, gt) as n from s where iou >= 0.2)
    select image, det, gt, round(iou, 6) as iou from r where n = 1""")
def iou_matches(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    det, gt = b.where("ln % 2 = 0").select("image", F.col("id").alias("det"), "box"), b.where("ln % 2 = 1").select("image", F.col("id").alias("gt"), "box")
    return rounded(matching.match_by_iou(det, gt, 0.2), "iou")


SQL_CENTRES = f"""{SQL_BOXES}, g as (select unnest(generate_series(0, 15)) as i), c as (select image, id as det, x1 + (x2 - x1) * (a.i % 4 + 0.5) / 4 as cx, y1 + (y2 - y1) * (a.i // 4 + 0.5) / 4 as cy from box, g a where ln % 2 = 0),
    cand as (select pair.image, pair.det, gt, count(*) filter (cx between x1 and x2 and cy between y1 and y2) as n_inside from pair join c on c.det = pair.det group by pair.image, pair.det, gt)"""


def _patch_candidates(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    at = lambda lo, hi, i: lo + (hi - lo) * (i + 0.5) / 4
    grid = lambda box: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(at(box["x1"], box["x2"], i % 4).alias("x"), at(box["y1"], box["y2"], F.floor(i / 4)).alias("y")))
    det = b.where("ln % 2 = 0").select("image", F.col("id").alias("det"), "box")
    gt = b.where("ln % 2 = 1").select("image", F.col("id").alias("gt"), "box", F.lit(False).alias("region"))
    return matching.overlap_candidates(det, gt, 0.2, grid)


@query(f"with {SQL_CENTRES} select image, det, gt, n_inside, round(n_inside / 16.0, 6) as fraction from cand where n_inside / 16.0 >= 0.2 and n_inside > 0")
def patch_overlap_candidates(spark, sf_dir):
    out = _patch_candidates(spark, sf_dir).select("image", "det", "gt", F.col("n_inside").cast("long").alias("n_inside"), "fraction")
    return rounded(out, "fraction")


@query(f"""with recursive {SQL_CENTRES}, o as (select *, row_number() over (partition by image order by n_inside desc, det, gt) as n from cand where n_inside / 16.0 >= 0.2 and n_inside > 0),
    s as (select image, n, det, gt, true as taken, [det] as dets, [gt] as gts from o where n = 1 union all
        select o.image, o.n, o.det, o.gt, not (contains(dets, o.det) or contains(gts, o.gt)), case when contains(dets, o.det) or contains(gts, o.gt) then dets else list_append(dets, o.det) end,
        case when contains(dets, o.det) or contains(gts, o.gt) then gts else list_append(gts, o.gt) end from s join o on o.image = s.image and o.n = s.n + 1)
    select s.image, s.det, s.gt, cast(n_inside as int) as n_inside, round(n_inside / 16.0, 6) as fraction from s join o using (image, n) where taken""")
def patch_overlap_matches(spark, sf_dir):
    return rounded(matching.greedy_one_to_one(_patch_candidates(spark, sf_dir)), "fraction")


@query(f"""with {SQL_BOXES}, i as (select id, trunc(x1) as x1, trunc(y1) as y1, trunc(x2) as x2, trunc(y2) as y2 from box),
    s as (select *, greatest(greatest(0, least(x2, 640)) - greatest(0, least(x1, 640)), greatest(0, least(y2, 480)) - greatest(0, least(y1, 480))) as side from i),
    q as (select id, floor((x1 + x2) / 2) as cx, floor((y1 + y2) / 2) as cy, floor(side / 2) as half from s),
    b2 as (select id, greatest(0, cx - half) as l, greatest(0, cy - half) as t, least(640, cx + half) as r, least(480, cy + half) as bo from q),
    p as (select *, r - l as w, bo - t as h, least(512.0 / (r - l), 512.0 / (bo - t)) as sc from b2)
    select id, cast(w as bigint) as w, cast(h as bigint) as h, round(sc, 6) as scale, cast(floor((512 - trunc(w * sc)) / 2) as bigint) as pad_left, cast(floor((512 - trunc(h * sc)) / 2) as bigint) as pad_top from p""")
def crop_geometry(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    cut = G.crop_bounds(G.square_crop(F.col("box"), F.lit(640), F.lit(480)), F.lit(640), F.lit(480))
    out = b.select("id", cut.alias("c")).select("id", (F.col("c.x2") - F.col("c.x1")).alias("w"), (F.col("c.y2") - F.col("c.y1")).alias("h"))
    out = out.withColumn("p", G.padding(F.col("w"), F.col("h")))
    as_long = lambda c: F.col(c).cast("long")
    return out.select("id", as_long("w").alias("w"), as_long("h").alias("h"), r6("p.scale").alias("scale"), as_long("p.left").alias("pad_left"), as_long("p.top").alias("pad_top"))


# ---------------------------------------------------------------- labels, angles, health

SQL_COARSE = "case " + " ".join(f"when {{0}} = '{k}' then '{v}'" for k, v in L.COARSE_VIEWPOINT.items()) + " end"
_RAW = ["right", "frontright", "left", "backleft", "front", "back", "upfrontleft", "downbackleft", "unknown"]
SQL_RAW = "case cast({0} % 9 as int) " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_RAW)) + " end"


def _view(c):
    return F.element_at(F.array(*map(F.lit, _RAW)), (F.col(c) % 9 + 1).cast("int"))


@query(f"""with v as (select vec_id as id, {SQL_RAW.format('vec_id')} as raw, {SQL_RAW.format('(vec_id * 5 + 1)')} as other from embeddings), c as (select *, {SQL_COARSE.format('raw')} as coarse, {SQL_COARSE.format('other')} as co from v)
    select id, raw, coarse, coalesce(coarse, raw) = other or raw = other or (other in ('right', 'left', 'front', 'back') and contains(raw, other)) as relaxed,
    coalesce(coarse, raw) = coalesce(co, other) or (contains(raw, 'right') and contains(other, 'right')) or (contains(raw, 'left') and contains(other, 'left')) or (contains(raw, 'front') and contains(other, 'front')) or (contains(raw, 'back') and contains(other, 'back')) as same from c""")
def viewpoints(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _view("vec_id").alias("raw"), F.element_at(F.array(*map(F.lit, _RAW)), ((F.col("vec_id") * 5 + 1) % 9 + 1).cast("int")).alias("other"))
    return v.select("id", "raw", L.coarse_viewpoint("raw").alias("coarse"), L.relaxed_correct("raw", "other").alias("relaxed"), L.relaxed_same("raw", "other").alias("same"))


@query("""select event_type, round(atan2(avg(sin(radians(value))), avg(cos(radians(value)))), 6) as mean,
    round(sqrt(-2 * ln(least(greatest(sqrt(avg(sin(radians(value))) ** 2 + avg(cos(radians(value))) ** 2), 1e-10), 1.0))), 6) as std, count(*) as n from events group by event_type""")
def circular_statistics(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").withColumn("angle", F.radians("value"))
    return rounded(metrics.circular(e, "angle", "event_type"), "mean", "std")


@query("""with a as (select event_id, radians(value) as a, radians(cast(user_id % 360 as double)) as b from events)
    select event_id, round(least(abs(a - b), 2 * pi() - abs(a - b)), 6) + 0.0 as distance, round(atan2((sin(a) + sin(b)) / 2, (cos(a) + cos(b)) / 2), 5) + 0.0 as middle from a where abs(abs(a - b) - pi()) > 1e-6""")
def circular_pairs(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", F.radians("value").alias("a"), F.radians((F.col("user_id") % 360).cast("double")).alias("b"))
    e = e.where(F.abs(F.abs(F.col("a") - F.col("b")) - F.pi()) > 1e-6)
    return e.select("event_id", r6(L.circular_distance("a", "b")).alias("distance"), (F.round(L.circular_midpoint("a", "b"), 5) + 0.0).alias("middle"))


@query(f"""with {X.SQL_DIMS}, f as (select d, x from dims), m as (select d, median(x) as med from f group by d), a as (select d, median(abs(x - med)) + 1e-12 as mad from f join m using (d) group by d),
    z as (select d, max(abs(x - med) / mad) as max_z, count(*) filter (abs(x - med) / mad > 4) as n_outliers, min(x) as least, max(x) as greatest, any_value(med) as med, any_value(mad) as mad from f join m using (d) join a using (d) group by d),
    y as (select *, greatest(greatest - med, med - least) / greatest(least(greatest - med, med - least), 1e-12) as asym from z)
    select cast(d as bigint) as d, round(med, 6) + 0.0 as median, round(mad, 6) as mad, round(max_z, 5) as max_z, n_outliers, round(asym, 5) as asymmetry, (n_outliers > 0 and max_z > 8) or asym > 20 as bottleneck from y""")
def eigenvector_health(spark, sf_dir):
    long = metrics.dimensions(X.vectors(spark, sf_dir), "vec", "id")
    out = metrics.health(long, "d", 4.0)
    five = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return out.select(F.col("d").cast("long").alias("d"), r6("median").alias("median"), r6("mad").alias("mad"), five("max_z"), "n_outliers", five("asymmetry"), "bottleneck")


@query(f"with {X.SQL_VECTORS} select id, round(atan2(vec[3], vec[2]), 6) as theta_a, round(atan2(vec[4], vec[3]), 6) as theta_b from v")
def angle_pairs(spark, sf_dir):
    return X.vectors(spark, sf_dir).select("id", r6(graph.angle(1, 2)).alias("theta_a"), r6(graph.angle(2, 3)).alias("theta_b"))


@query(f"with {X.SQL_VECTORS}, c as (select identity, count(*) as n from v group by identity) select identity, n from c where n >= 2")
def identity_counts(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return sampling.at_least_two(v, "identity").groupBy("identity").agg(F.count("*").alias("n"))


@query(f"""with v as (select vec_id as id, label as identity, {SQL_RAW.format('vec_id')} as raw from embeddings), c as (select *, {SQL_COARSE.format('raw')} as coarse from v)
    select coarse, count(*) as n from c where coarse is not null and raw not in ('ignore', 'unknown') and identity in (select identity from v group by identity having count(*) >= 2) group by coarse""")
def recognisable_by_viewpoint(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("identity"), _view("vec_id").alias("raw"))
    return sampling.recognisable(v, "identity", "raw", L.coarse_viewpoint("raw")).groupBy(L.coarse_viewpoint("raw").alias("coarse")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- ids, samples, batches


@query("""with d as (select 'dir/' || source || '_' || doc_id || '.v1.jpg' as path, doc_id % 3 as i from documents), e as (select path, i, source_id || '_det_' || lpad(cast(i as varchar), 4, '0') as det from
        (select path, i, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') as source_id from d))
    select det as detection_id, regexp_extract(det, '^(.*)_det_', 1) as image, case when length(det) > 16 then substring(det, 1, 16) || '...' else det end as short from e""")
def detection_ids(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.concat(F.lit("dir/"), "source", F.lit("_"), "doc_id", F.lit(".v1.jpg")).alias("path"), (F.col("doc_id") % 3).alias("i"))
    out = d.select(L.detection_id("path", "i").alias("detection_id"))
    return out.select("detection_id", L.image_of_detection("detection_id").alias("image"), L.short_label("detection_id").alias("short"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unprocessed_images(spark, sf_dir):
    return sampling.unprocessed(X.table(spark, sf_dir, "documents").select("doc_id"), X.table(spark, sf_dir, "labels"), "doc_id")


@query("""with k as (select *, l_orderkey * 10 + l_linenumber as key from lineitem), g as (select key, sum(l_quantity) as q from k group by key),
    h as (select *, ((key * 1103515245 + 42 * 12345) % 2147483647 * 48271 + 42) % 2147483647 as h from g) select key, q from h order by h, key limit 1000""")
def exact_sample(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")).agg(F.sum("l_quantity").alias("q"))
    return sampling.exact_sample(li, 1000, "key")


@query(f"""with {X.SQL_PATCH}, b as (select id // 50 as batch, count(*) filter (valid) // 4 as n from patch group by id // 50)
    select batch, cast(coalesce(sum(n) over (order by batch rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(sum(n) over (order by batch) as bigint) as stop from b where n > 0""")
def batch_ranges(spark, sf_dir):
    p = X.patches(spark, sf_dir).groupBy(F.expr("id div 50").alias("batch"), "id").agg(F.collect_list("valid").alias("mask"))
    return sampling.batch_ranges(sampling.patches_per_batch(p, "batch", "mask"), "batch")


@query("select cast(l_shipdate as date) as day, count(*) as n, count(distinct l_orderkey) as orders from lineitem group by cast(l_shipdate as date) having count(*) >= 2")
def processed_counts(spark, sf_dir):
    li = X.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders")).where("n >= 2")


@query("""with h as (select event_id, abs(value) as a, abs(value) / 2 as b, cast(1 as double) as c from events), l as (select *, sqrt(a / greatest(a + b + c, 1e-7)) as ra, sqrt(b / greatest(a + b + c, 1e-7)) as rb, sqrt(c / greatest(a + b + c, 1e-7)) as rc from h)
    select event_id, round(ra / greatest(sqrt(ra * ra + rb * rb + rc * rc), 1e-7), 6) as x, round(rb / greatest(sqrt(ra * ra + rb * rb + rc * rc), 1e-7), 6) as y from l""")
def root_descriptors(spark, sf_dir):
    h = X.table(spark, sf_dir, "events").select("event_id", F.array(F.abs("value"), F.abs("value") / 2, F.lit(1.0)).alias("h"))
    out = h.select("event_id", V.root_l1("h").alias("v"))
    return out.select("event_id", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query("""select user_id, cast(max(value) as double) as score, arg_max(event_id, (value, -event_id)) as event_id from events group by user_id""")
def best_in_cell(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max("value").alias("score"), F.max(F.struct("value", (-F.col("event_id")).alias("m"), "event_id"))["event_id"].alias("event_id"))
