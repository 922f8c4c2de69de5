"""SQL for the operators that SQL can express, over whole tables, by other means than the operators' own."""

from __future__ import annotations

from plumage.llm import clustering, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(nodes: str, links: str) -> str:
    """CTE comp(id, component): the smallest id reachable over links(a, b), which holds both directions."""
    return f"""reach as (select id, id as r from {nodes} union select l.b, reach.r from reach join {links} l on l.a = reach.id where reach.r < l.b),
        comp as (select id, min(r) as component from reach group by id)"""


#: Pairs of kinds of lines that share one of the shorter one's k + 1 parts, and their distance over a band of nine diagonals.
OP2 = r"""with recursive line as (select doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as l from documents),
    able as (select * from line where length(l) >= 20 and trim(l, chr(9) || chr(11) || chr(12) || chr(13) || ' ') <> ''),
    kind as (select l, count(*) as c, min((doc_id, pos)) as f, len(string_split(l, ' ')) >= 10 as words from able group by l),
    cut as (select *, case when words then string_split(l, ' ') else string_split(l, '') end as s, case when words then 10 else 20 end as base from kind),
    size as (select *, len(s) as n, case when len(s) < 2 * base then 1 when len(s) < 4 * base then 2 when len(s) < 8 * base then 3 else 4 end as k,
        case when words then ' ' else '' end as gap from cut),
    part as (select *, list_transform(generate_series(0, k), lambda i: case when words then ' ' || array_to_string(s[n * i // (k + 1) + 1 : n * (i + 1) // (k + 1)], ' ') || ' '
            else array_to_string(s[n * i // (k + 1) + 1 : n * (i + 1) // (k + 1)], '') end) as parts from size),
    pair as (select row_number() over () as id, a.s as a, b.s as b, a.n as n, b.n as m, a.k as k, case when (-a.c, a.f) < (-b.c, b.f) then b.l else a.l end as later
        from part a join part b on a.words = b.words and b.n between a.n and a.n + a.k and a.l <> b.l
        where len(list_filter(a.parts, lambda x: contains(b.gap || b.l || b.gap, x))) > 0),
    step as (select id, 0 as i, [99, 99, 99, 99, 0, 1, 2, 3, 4] as r from pair union all
        select id, i + 1, list_transform(range(1, 10), lambda t: case when i + t - 4 between 0 and m then list_min(list_transform(range(1, t + 1), lambda v: u[v] + t - v)) else 99 end)
        from (select d.id, d.i, p.m, list_transform(range(1, 10), lambda t: case when d.i + t - 4 not between 0 and p.m then 99 when d.i + t = 4 then d.i + 1
            else least(coalesce(d.r[t + 1], 99) + 1, d.r[t] + case when p.b[d.i + t - 4] = p.a[d.i + 1] then 0 else 1 end) end) as u
            from step d join pair p using (id) where d.i < p.n)),
    near as (select distinct later as l from pair join step using (id) where i = n and r[m - n + 5] <= k),
    gone as (select a.doc_id, a.pos from able a join kind k on a.l = k.l where (a.doc_id, a.pos) <> k.f or a.l in (select l from near)),
    kept as (select line.*, gone.pos is not null as out from line left join gone using (doc_id, pos))
    select doc_id, count(*) as n_lines, count(*) filter (out) as n_removed, coalesce(string_agg(l, chr(10) order by pos) filter (not out), '') as text from kept group by doc_id"""

OP4 = rf"""with recursive w as (select doc_id as id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
    s as (select id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, chr(1))]
        else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) end as s from w),
    n as (select id, len(s) as n from s), x as (select id, unnest(s) as g from s),
    common as (select a.id as a, b.id as b, count(*) as c from x a join x b on a.g = b.g and a.id <> b.id group by all),
    link as (select a, b from common join n na on na.id = a join n nb on nb.id = b where 100 * c >= 85 * (na.n + nb.n - c)), {_components('n', 'link')}
    select n.id as doc_id, n.n as n_shingles, component as component_id, n.id = component as kept from n join comp on comp.id = n.id"""

#: Sums in the order in which numpy adds 64 numbers: eight running sums, then pairwise.
_PART = ["(" + " + ".join(f"p[{j + 8 * i}]" for i in range(8)) + ")" for j in range(1, 9)]
_SUM = "((({0} + {1}) + ({2} + {3})) + (({4} + {5}) + ({6} + {7})))".format(*_PART)

OP5 = f"""with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
    p as (select q.vec_id as query_id, c.vec_id, list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]) as p from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    s as (select query_id, vec_id, {_SUM} as score from p)
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""

OP9 = f"""with recursive v as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings),
    link as (select a.id as a, b.id as b from v a join v b on a.label = b.label and a.id <> b.id where list_cosine_similarity(a.e, b.e) >= 0.93), {_components('v', 'link')}
    select v.id as vec_id, (select count(*) from link where a = v.id) as n_links, component as component_id, v.id = component as kept from v join comp on comp.id = v.id"""


def _spans(kind: str, pattern: str, value: str, least: int) -> str:
    """Rows (id, kind, i, s, e, v) of one kind, from the lengths of the hits and of what lies between them."""
    return rf"""select id, {KINDS.index(kind)} as k, '{kind}' as kind, s, s + length(m) as e, v from (select id, m, {value} as v,
            coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as s
            from (select id, gaps, hits, unnest(hits) as m, unnest(generate_series(1, len(hits))) as i from
                (select id, regexp_split_to_array(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as hits from d))) where length(v) >= {least}"""


_ASSIGN = secret_scan.ASSIGN.replace("'", "''")
KINDS = secret_scan.KINDS

OP11 = rf"""with d as (select row_number() over () as id, doc_id, source, source || '/' || lang as repo, coalesce(text, '') as t from documents),
    base as ({_spans('assign', _ASSIGN, f"regexp_extract(m, '{_ASSIGN}', 2)", 8)} union all {_spans('access', secret_scan.ACCESS, 'm', 16)} union all {_spans('hex', '[0-9a-f]+', 'm', 32)}),
    wide as (select * from ({_spans('owner', '[A-Za-z0-9+/_-]+', 'm', 16)}) where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')),
    cand as (select * from base union all select * from wide),
    own as (select v, count(distinct source) as owners, string_split(v, '') as cs from cand join d using (id) group by v),
    known as (select v, case when owners >= {secret_scan.SHARED_OWNERS} then 'shared' when not regexp_matches(v, '{secret_scan.PLACEHOLDERS}') and
        -list_sum(list_transform(list_distinct(cs), lambda c: len(list_filter(cs, lambda x: x = c)) / len(cs) * log2(len(list_filter(cs, lambda x: x = c)) / len(cs)))) >= {secret_scan.LEAST_BITS} then 'live' else 'unsure' end as verdict from own),
    every as (select base.*, verdict from base join known using (v) union all
        select w.*, verdict from wide w join known using (v) where verdict = 'live' and not exists (select 1 from base b where b.id = w.id and b.s < w.e and w.s < b.e)),
    said as (select *, kind || ':' || s || ':' || e as span from every),
    per as (select id, count(*) filter (k = 0) as n0, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2, count(*) filter (k = 3) as n3,
        string_agg(span, ',' order by s, k, e) filter (k < 3) as base, string_agg(span, ',' order by s, k, e) as spans,
        string_agg(span, ',' order by s, k, e) filter (verdict = 'live') as live, string_agg(span, ',' order by s, k, e) filter (verdict = 'shared') as shared from said group by id)
    select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
        coalesce(n3, 0) as n_added, coalesce(live, '') as live_spans, coalesce(shared, '') as shared_spans from d left join per using (id)"""


def _clusters(clusters: int, rounds: int, dim: int, seed: int) -> str:
    """Rounds of assignments over all pairs of a vector and a centroid, whole distances, whole numbers."""
    far = "cast(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    sql = f"""with v as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda y: cast(floor(256 * cast(y as double)) as bigint)) as x from embeddings
            where len(embedding) = {dim} and len(list_filter(embedding, lambda y: y is null or isnan(y) or isinf(y))) = 0),
        c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 as k, x from v where vec_id is not null order by sha256('{seed}:' || vec_id), x limit {clusters})"""
    for i in range(rounds + 1):
        sql += f""", a{i} as materialized (select id, k, f from (select id, k, {far} as f from v, c{i} c) qualify row_number() over (partition by id order by f, k) = 1)"""
        if i < rounds:
            sql += f""", s{i} as (select k, j, cast(sum(y) as bigint) as s, count(*) as n from (select k, unnest(x) as y, unnest(generate_series(1, {dim})) as j from a{i} join v using (id)) group by k, j),
                m{i} as (select k, list((s - ((s % n) + n) % n) // n order by j) as x from s{i} group by k),
                c{i + 1} as materialized (select c.k, coalesce(m.x, c.x) as x from c{i} c left join m{i} m on c.k = m.k)"""
    return sql + f""" select vec_id, cast(a.k as int) as cluster, f as distance, cast(sum(f) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(f) over () as bigint) as inertia,
        sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{rounds} a join v using (id) join c{rounds} c on c.k = a.k"""


OP12 = _clusters(clustering.CLUSTERS, clustering.ROUNDS, clustering.DIM, clustering.SEED)

ORACLES = {
    "op2_segment_line_dedup": OP2, "op4_minmax_near_dedup": OP4, "op5_block_nearest": OP5, "op9_hyperplane_dedup": OP9, "op11_secret_ownership": OP11,
    "op12_partial_distance_clusters": OP12,
}
