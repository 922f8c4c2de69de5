"""Secrets in texts, told apart by how many repositories and owners hold the same value.

Every text is scanned for credentials by shape. The digests of all candidate values are then counted over the whole
corpus by distinct repositories and owners: a value that many owners hold was copied from an example, one that few hold
and that looks random is likely to be live. Only column functions: positions come from the lengths of what lies between
the matches, and no text leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumage.functions.vec import bound
from plumage.llm import common

#: Kinds in the order in which spans of one start are listed; fixed values of the contract. A run of 32 or more of
#: [0-9a-f] is the same as a whole run that is long enough, so shorter ones needn't be matched at all.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "owner")
#: Candidates beyond those: runs of so many characters with letters and digits.
WIDE = r"[A-Za-z0-9+/_-]{16,}"

#: Owners from which on a value counts as widely copied.
SHARED_OWNERS = 5
#: Least entropy of a value that looks live, in bits a character, and words that one must not hold.
LEAST_BITS = 3.0
PLACEHOLDERS = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|12345|abcdef"
#: A value held by more than one in so many candidates is joined by broadcast; there are fewer than that.
HOT_SHARE = 1024
#: Sums of positions are taken in runs of so many.
RUN = 128

_plus = lambda a, x: a + x
_sum = lambda v: F.aggregate(v, F.lit(0), _plus)


def _before(steps: Column) -> Column:
    """Sums of the elements before each: those of whole runs, then those of its own run."""
    run = lambda s, b: F.slice(s, b * RUN + 1, F.lit(RUN))
    last = lambda s: F.floor((F.size(s) - 1) / RUN).cast("int")
    runs = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(last(s), F.lit(0))), lambda b: _sum(run(s, b)))

    def one(s: Column, r: Column, i: Column) -> Column:
        b = F.floor(i / RUN).cast("int")
        return _sum(F.slice(r, F.lit(1), b)) + _sum(F.slice(s, b * RUN + 1, i % RUN))

    return bound(steps, lambda s: bound(runs(s), lambda r: F.transform(s, lambda _, i: one(s, r, i))))


def spans(text: Column, pattern: str, kind: int, value: Column | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches, leftmost and not overlapping, in code points. value: of a match
    m, by default m itself; matches whose value has fewer than `least` characters go, but what they took stays taken."""
    of = value if value is not None else (lambda m: m)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def at(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))

        def one(before: Column) -> Column:
            start = lambda i: F.get(before, i) + F.length(F.get(x["gaps"], i))
            return F.transform(x["hits"], lambda m, i: F.struct(start(i).alias("start"), F.lit(kind).alias("kind"), (start(i) + F.length(m)).alias("end"), of(m).alias("value")))

        return bound(_before(steps), one)

    found = F.filter(bound(both, at), lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start: int, kind: int, end: int, value: string>>"))


def bits(value: Column) -> Column:
    """Entropy of the characters of a value."""
    n = F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    shares = F.transform(F.array_distinct(F.split(value, "")), share)
    return -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p))


def looks_live(value: Column) -> Column:
    return (bits(value) >= LEAST_BITS) & ~value.rlike(PLACEHOLDERS)


def listed(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, keep: list[str], text: str, repository: Column, owner: Column) -> DataFrame:
    """(row_id, keep..., repository, owner, base, found), written: the base spans of each row, and all candidates with the digest
    of their value and whether it looks live. row_id is drawn once and then stands in the table."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = lambda m: F.regexp_extract(m, ASSIGN, 2)  # noqa: E731  a match holds no other match of its pattern at its start
    base = F.array_sort(F.concat(spans(t, ASSIGN, 0, own, 8), spans(t, ACCESS, 1, None, 16), spans(t, HEX, 2)))
    wide = F.filter(spans(t, WIDE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = docs.select(*keep, repository.alias("_repository"), owner.alias("_owner"), base.alias("_base"), wide.alias("_wide"))
    slim = lambda s: F.struct(s["start"], s["kind"], s["end"])
    full = lambda s: F.struct(s["start"], s["kind"], s["end"], F.unhex(F.md5(s["value"])).alias("digest"), looks_live(s["value"]).alias("live"))
    found = F.transform(F.concat("_base", "_wide"), full)
    return common.materialize(rows.select(F.expr("uuid()").alias("_row"), *keep, "_repository", "_owner", F.transform("_base", slim).alias("_base"), found.alias("_found")))


def ownership(rows: DataFrame) -> DataFrame:
    """(digest, n, repositories, owners) of each value. Counted by (digest, owner, repository) first, so a value that a third of
    the corpus holds reaches the shuffle as a row for each task and repository."""
    one = rows.groupBy("digest", "_owner", "_repository").agg(F.count("*").alias("n"))
    two = one.groupBy("digest", "_owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return two.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def judged(rows: DataFrame) -> DataFrame:
    """rows with n, repositories and owners of their digest. The few values that make up more than a share of all rows are
    joined by broadcast, so no task gets all rows of one."""
    counts = common.materialize(ownership(rows))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    is_hot = F.col("n") * HOT_SHARE > total
    hot = counts.where(is_hot)  # fewer than HOT_SHARE rows
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(counts.where(~is_hot), "digest")
    return rows.join(F.broadcast(hot), "digest").unionByName(cold)


def scan(docs: DataFrame, keep: list[str], text: str, repository: Column, owner: Column) -> DataFrame:
    """(keep..., base, secrets), a row for each row of docs. base: array<struct<start, kind, end>> of the three given kinds. secrets: base
    and the spans added to it, array<struct<start, kind, end, verdict, owners, repositories>>, sorted; verdict is "shared" (SHARED_OWNERS
    owners or more), "live" (fewer, and looks random) or "unsure". Added, as kind "owner", is a wide candidate that is live
    and overlaps no base span.

    A null text counts as empty and has no spans. A null owner or repository is one of its own. Rows that repeat, or
    share their ids, are rows of their own; values count once an owner. An empty table gives an empty one."""
    rows = candidates(docs, keep, text, repository, owner)
    some = F.size("_found") > 0
    each = rows.where(some).select("_row", "_repository", "_owner", F.explode("_found").alias("f")).select("_row", "_repository", "_owner", "f.*")
    known = judged(each.withColumn("_wide", F.col("kind") == 3))
    verdict = F.when(F.col("owners") >= SHARED_OWNERS, "shared").when(F.col("live"), "live").otherwise("unsure")
    # base spans that begin at or before a wide one and reach into it, or begin within it
    order = Window.partitionBy("_row").orderBy("start", "_wide", "kind", "end")
    up, down = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base_only = lambda c: F.when(~F.col("_wide"), F.col(c))
    free = F.coalesce(F.max(base_only("end")).over(up) <= F.col("start"), F.lit(True)) & F.coalesce(F.min(base_only("start")).over(down) >= F.col("end"), F.lit(True))
    kept = known.withColumns({"verdict": verdict, "_free": free}).where(~F.col("_wide") | (F.col("_free") & (F.col("verdict") == "live")))
    span = F.struct("start", "kind", "end", "verdict", "owners", "repositories")
    secrets = kept.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("secrets"))  # those of one text
    none = F.array().cast(secrets.schema["secrets"].dataType)
    own = [*keep, F.col("_base").alias("base")]
    rest = rows.where(some).join(secrets, "_row", "left").select(*own, F.coalesce("secrets", none).alias("secrets"))
    return rows.where(~some).select(*own, none.alias("secrets")).union(rest)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, and its documents of one language a repository of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, ["doc_id"], "text", F.concat_ws("/", "source", "lang"), F.col("source"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    of = lambda v: F.filter("secrets", lambda s: s["verdict"] == v)
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["kind"] == 3)).cast("long").alias("n_added"), listed(of("live")).alias("live_spans"), listed(of("shared")).alias("shared_spans"),
    )
