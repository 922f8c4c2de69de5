"""Line dedup: a segment-partition edit join, in DataFrame functions only.

Equal lines of MIN_CHARS characters or more are one kind; its first occurrence, in the order of doc_id and position,
stays. A kind goes altogether if a preferred kind (one that occurs more often, then the earlier one) is within k edits.
The symbols that edits insert, delete or replace are the words of a line that has WORDS of them or more, and the
characters of any other; lines of different symbols aren't compared. k grows with the shorter line: 1 edit below twice
its least number of symbols (10 words or 20 characters), 2 below four times, 3 below eight times, 4 from there on.

For the join, lines fall into classes of length, each twice as long as the one before. A line is cut into k + 1 segments
of a size that its class sets, and an equally long or longer line is probed for them at the few places that k edits
leave (the first segment i that has met at most i edits so far is intact, moved by at most i, with at most k - i edits
behind it). Hashes of segment, number and class meet in one sum over keys; only keys that two kinds share go on. Their
lines are fetched and verified by a bit-parallel edit distance over a band of 2k + 1 diagonals, after the shared
beginning and end are taken off.

Skew: in a group of more than GROUP kinds under one key each is first compared with the most preferred one. Those left
are compared only with kinds of the group that share one of their k + 1 rarest symbols as well, which any two within k
edits do; there again first with the most preferred one. A line that a third of all documents repeat is one row a task
in the sums. No group is collected.

Plan: texts are read twice for keys and result and once for the lines that share keys; joins carry hashes. Verdicts are
broadcast to the documents up to BROADCAST_LINES of them; beyond that the last join shuffles the texts once.

Edge cases: lines of white space and lines shorter than min_chars are never removed. A null or empty text stays as it
is. Rows with equal doc_id and text are one document and keep the same lines; a null doc_id sorts first. Other columns
are carried along. An empty table gives an empty result. A text of any number of lines is split once.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C

MIN_CHARS, WORDS, MAX_EDITS = 20, 10, 4
#: Classes of length, each of twice the length: enough for the longest string.
CLASSES = 27
#: Kinds of one key that are compared with each other directly.
GROUP = 32
#: Buckets of symbols whose counts tell which are rare.
BUCKETS = 1 << 14
#: Shared keys, wanted lines and gone kinds are broadcast up to this many rows (8 to 40 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Removed lines whose positions are broadcast (4 bytes each and 40 a document), else joined by a shuffle.
BROADCAST_LINES = 1_000_000
_BLANK = " \t\r\x0b\x0c"


def _let(x: Column, body) -> Column:
    """body(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if C.is_small(df, BROADCAST_ROWS) else df


# ---------------------------------------------------------------- symbols and segments


def with_class(df: DataFrame) -> DataFrame:
    """df (line, ...) with the number n of symbols, the class of length (even: words, odd: characters; negative: too
    short), the edits k allowed to lines of at least that class, and the class's least length."""
    df = df.withColumn("_words", F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
    by_word = F.col("_words") >= WORDS
    df = df.withColumns({"n": F.when(by_word, F.col("_words")).otherwise(F.length("line")), "_base": F.when(by_word, WORDS).otherwise(MIN_CHARS)})
    step = F.floor(F.log2(F.col("n") / F.col("_base")) + 1e-9).cast("int")
    df = df.withColumn("class", step * 2 + F.when(F.col("_base") == WORDS, 0).otherwise(1)).drop("_words", "_base")
    return df.withColumns({"k": _edits(F.col("class")), "least": _least(F.col("class"))})


def _by_word(class_: Column) -> Column:
    return F.pmod(class_, F.lit(2)) == 0


def _edits(class_: Column) -> Column:
    return F.least(F.shiftright(class_, 1) + 1, F.lit(MAX_EDITS))


def _least(class_: Column) -> Column:
    base = F.when(_by_word(class_), WORDS).otherwise(MIN_CHARS)
    return F.call_function("shiftleft", base, F.shiftright(class_, 1))


def _places(k: int) -> list[tuple[int, int]]:
    """(segment, how far it may have moved) of all probes for k edits; the first k + 1 have not moved and are the index."""
    moved = [(i, d) for i in range(k + 1) for d in range(-min(i, k - i), i + 1) if d]
    return [(i, 0) for i in range(k + 1)] + moved


def _by_edits(k: Column, of) -> Column:
    """of(1), of(2), ... by the value of k."""
    return reduce(lambda out, e: out.when(k == e, of(e)), range(2, MAX_EDITS + 1), F.when(k == 1, of(1)))


def _probes() -> Column:
    """By class of length: the end, the size and a salt of each probe. One constant, so that the work on a key is short."""
    table = []
    for class_ in range(2 * CLASSES):
        k = min(class_ // 2 + 1, MAX_EDITS)
        size = ((MIN_CHARS if class_ % 2 else WORDS) << class_ // 2) // (k + 1)
        table.append([{"stop": i * size + d + size, "size": size, "salt": class_ * (MAX_EDITS + 1) + i} for i, d in _places(k)])
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<stop: int, size: int, salt: int>>>")


def probe_keys(line: Column, n: Column, class_: Column) -> Column:
    """Hashes of the substrings that segments of an equally long or shorter line of the class may equal, in the order of
    _places; null where the line ends before. The first k + 1 are the line's own segments, if it is of the class."""
    probes = F.get(_probes(), class_)
    index = lambda x, count: F.call_function("substring_index", x, F.lit(" "), count)
    words = F.transform(probes, lambda p: F.when(p["stop"] <= n, F.xxhash64(index(index(line, p["stop"]), -p["size"]), p["salt"])))
    chars = F.transform(probes, lambda p: F.when(p["stop"] <= n, F.xxhash64(F.substring(line, p["stop"] - p["size"] + 1, p["size"]), p["salt"])))
    return F.when(_by_word(class_), words).otherwise(chars)


def _all_keys() -> Column:
    """Keys of a line in its own class and, if a line k edits shorter may be in the class below, in that one."""
    line, n, class_ = (F.col(c) for c in ("line", "n", "class"))
    below = F.when((class_ >= 2) & (n < F.col("least") + _edits(class_ - 2)), probe_keys(line, n, class_ - 2))
    return F.when(class_ >= 0, F.concat(probe_keys(line, n, class_), F.coalesce(below, F.array().cast("array<bigint>"))))


def with_symbols(df: DataFrame) -> DataFrame:
    """df as with_class() gives it, with the array of symbols."""
    return df.withColumn("symbols", F.when(_by_word(F.col("class")), F.split("line", " ")).otherwise(F.split("line", "")))


def with_hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("symbols", lambda s: F.xxhash64(s)))


def sketch(hashes: Column) -> Column:
    """64 parities of numbers of symbols by hash, of which one edit changes two at most."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


# ---------------------------------------------------------------- the distance


def trimmed(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with the arrays a and b without the beginning and the end that they share, which leaves their distance as it is."""
    for _ in range(2):
        apart = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        df = df.withColumn("_head", F.when(apart == 0, F.least(F.size(a), F.size(b))).otherwise(apart - 1).cast("int"))
        cut = lambda x: F.reverse(F.slice(x, F.col("_head") + 1, F.size(x)))
        df = df.withColumns({a: cut(F.col(a)), b: cut(F.col(b))}).drop("_head")
    return df


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two arrays if it is at most `edits` and their sizes differ by no more, else edits + 1.

    One pass over b; bit i of a word stands for the cell `edits` - i above or below the diagonal, and each symbol
    takes a constant number of bit operations on words of 2 * edits + 1 bits."""
    k = edits
    width = 2 * k + 1
    mask, top = (1 << width) - 1, 1 << (2 * k)
    same = F.array(*[F.lit("")] * (k + 1))  # a shared beginning keeps both longer than the band
    as_long = lambda x: F.lit(x).cast("long")
    flip = lambda x: x.bitwiseXOR(as_long(mask))

    def run(p: Column, t: Column) -> Column:
        m = F.size(p)

        def step(s: Column, i: Column) -> Column:
            here = F.get(t, i)
            match = as_long(0)
            for bit in range(width):
                match = match.bitwiseOR(F.when(F.get(p, F.when(i - k + bit >= 0, i - k + bit)) == here, as_long(1 << bit)).otherwise(as_long(0)))

            def after(x: Column) -> Column:
                d0 = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(as_long(mask))
                return _let(d0, lambda d: with_hp(d, s["vn"].bitwiseOR(flip(d.bitwiseOR(s["vp"])))))

            def with_hp(d: Column, hp: Column) -> Column:
                return _let(hp, lambda h: state(d, h, d.bitwiseAND(s["vp"]), F.shiftright(d, 1)))

            def state(d: Column, h: Column, hn: Column, half: Column) -> Column:
                row = as_long(1 << (2 * k - 1))
                at = F.call_function("shiftright", row, F.greatest(i - (m - k), F.lit(0)))
                on_diagonal = F.when(d.bitwiseAND(as_long(top)) == 0, 1).otherwise(0)
                on_last = F.when(h.bitwiseAND(at) != 0, 1).when(hn.bitwiseAND(at) != 0, -1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(flip(half.bitwiseOR(h))).bitwiseAND(as_long(mask)).alias("vp"), half.bitwiseAND(h).alias("vn"),
                    (s["d"] + F.when(i < m - k, on_diagonal).otherwise(on_last)).alias("d"),
                )

            return _let(match, after)

        first = F.struct(as_long(((1 << (k + 1)) - 1) << k).alias("vp"), as_long(0).alias("vn"), F.lit(k).alias("d"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), first, step, lambda s: s["d"])

    near = F.abs(F.size(a) - F.size(b)) <= k
    both = F.struct(F.concat(same, a).alias("p"), F.concat(same, b).alias("t"))
    return F.when(near, F.least(_let(both, lambda x: run(x["p"], x["t"])), F.lit(k + 1))).otherwise(k + 1)


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(id): later kinds of the pairs (later, earlier, k) that are within k edits."""
    side = lambda name, s: found.select(F.col("id").alias(name), F.col("symbols").alias(s))
    both = pairs.distinct().join(side("later", "x"), "later").join(side("earlier", "y"), "earlier")
    both = C.materialize(trimmed(both, "x", "y"))  # written, as the optimizer would else repeat its expressions in the next step
    near = _by_edits(F.col("k"), lambda e: edit_distance(F.col("x"), F.col("y"), e) <= e)
    return C.materialize(both.where(near).select(F.col("later").alias("id")).distinct())


# ---------------------------------------------------------------- the join


def _members(lines: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, id, at) of the kinds that share a key with another one, and (id, p, doc, th, pos) of those kinds: p orders
    them by preference, the rest is where the kind stands first. A kind is once under a key, by its first place."""
    rows = lines.select("ha", "hb", F.posexplode("keys").alias("at", "g")).where("g is not null")
    shared = C.materialize(rows.groupBy("g").agg(F.min("ha").alias("a"), F.max("ha").alias("b")).where("a <> b").select("g"))
    # a line that repeats itself meets a key at several places: keys of a class tell them apart only as its own, the first ones, or not
    rows = C.materialize(rows.join(_small(shared), "g").groupBy("g", "ha", "hb").agg(F.min("at").alias("at")))
    wanted = rows.select("ha", "hb").distinct().join(kinds, ["ha", "hb"])
    wanted = C.materialize(wanted.select(
        F.monotonically_increasing_id().alias("id"), "ha", "hb", F.struct((-F.col("times")).alias("times"), "first").alias("p"), "first.*"
    ))
    return rows.join(_small(wanted.select("id", "ha", "hb")), ["ha", "hb"]).select("g", "id", "at"), wanted


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, p, symbols, hashes, sketch, n, class, k, least) of the wanted kinds."""
    places = C.materialize(wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("id", "pos")).alias("places")))
    texts = _documents(docs).join(_small(places), ["doc", "th"])
    lines = _let(F.split("text", "\n"), lambda ls: F.transform("places", lambda w: F.struct(w["id"].alias("id"), F.get(ls, w["pos"]).alias("line"))))
    lines = texts.select(F.inline(lines)).groupBy("id").agg(F.first("line").alias("line"))
    lines = with_hashes(with_symbols(with_class(lines))).withColumn("sketch", sketch(F.col("hashes")))
    return C.materialize(lines.join(wanted.select("id", "p"), "id").drop("line"))


def _fit(x: str, y: str) -> str:
    """SQL: one of the rows x and y holds a segment of its own, and the other is no shorter and not k longer; and k
    edits can explain their sketches."""
    one = "({a}.own and {b}.n between {a}.n and {a}.n + x.k)"
    return f"(({one.format(a=x, b=y)} or {one.format(a=y, b=x)}) and bit_count({x}.sketch ^ {y}.sketch) <= 2 * x.k)"


def _compared(now: DataFrame, found: DataFrame, group: int, to_the_end: bool) -> tuple[DataFrame, DataFrame]:
    """Of rows (g, id, p, n, k, sketch, own, open): (id) of the kinds that turn out near to a preferred one, and (g, lead) of the
    large groups, in which each was compared with the most preferred one, the lead, only. Rows that are not open are only
    compared with. to_the_end: what is left open in large groups is compared with all of them."""
    lead = F.min(F.struct("p", "id", "n", "own", "sketch")).alias("lead")
    groups = now.groupBy("g").agg(F.count("*").alias("rows"), lead, F.max("id").alias("a"), F.min("id").alias("b"), F.max("own").alias("owned"), F.max("open").alias("left"))
    groups = C.materialize(groups.where("a <> b and owned and left").select("g", "rows", "lead"))
    small, large = groups.where(F.col("rows") <= group), C.materialize(groups.where(F.col("rows") > group).select("g", "lead"))

    def each(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.alias("x").join(right.alias("y"), F.expr(f"x.g = y.g and y.p < x.p and x.id <> y.id and {_fit('x', 'y')}"))
        return both.select(F.col("x.id").alias("later"), F.col("y.id").alias("earlier"), F.col("x.k").alias("k"))

    few = now.join(_small(small.select("g")), "g", "left_semi")
    star = now.join(_small(large.select("g", F.col("lead").alias("y"))), "g").alias("x").where(f"open and id <> y.id and {_fit('x', 'y')}")
    pairs = each(few.where("open"), few).union(star.select(F.col("id").alias("later"), F.col("y.id").alias("earlier"), "k"))
    gone = _verified(pairs, found)
    if to_the_end and not large.isEmpty():
        rest = C.materialize(now.join(_small(large.select("g")), "g", "left_semi"))
        gone = gone.union(_verified(each(rest.where("open").join(_small(gone), "id", "left_anti"), rest), found))
    return gone, large


def _rare(now: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of large groups under finer keys: the group and one of the k + 1 rarest symbols of the line. k edits change at
    most k different symbols, so under any order of the symbols two such lines share one of their first k + 1; the
    order here is in how many of the kinds that share keys the symbol's bucket of BUCKETS is met."""
    symbols = found.select("id", F.array_distinct("hashes").alias("hashes"))
    now = C.materialize(now.join(symbols, "id"))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    met = symbols.select(F.explode("hashes").alias("h")).groupBy(bucket(F.col("h")).alias("b")).agg(F.count("*").alias("times"))
    met = now.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(met, "b", "left").select("b", F.coalesce("times", F.lit(0)).alias("times"))
    met = met.agg(F.array_sort(F.collect_list(F.struct("b", "times"))).alias("met"))  # one row of BUCKETS numbers
    met = C.materialize(met.select(F.col("met.times").alias("met")))
    ranked = F.array_sort(F.transform("hashes", lambda h: F.struct(F.get("met", bucket(h)).alias("times"), h.alias("h"))))
    first = F.transform(F.slice(ranked, F.lit(1), F.col("k") + 1), lambda r: F.xxhash64(F.col("g"), r["h"]))
    few = F.when(F.size("hashes") <= 2 * F.col("k"), F.array(F.xxhash64("g", F.lit("few")))).otherwise(F.array().cast("array<bigint>"))
    rows = now.crossJoin(F.broadcast(met)).withColumn("keys", F.concat(first, few))
    return rows.select(F.explode("keys").alias("g"), "id", "p", "n", "k", "sketch", "own", "open")


def near_kinds(docs: DataFrame, lines: DataFrame, kinds: DataFrame, group: int = GROUP) -> DataFrame:
    """(ha, hb) of the kinds of lines that a preferred one is near to."""
    members, wanted = _members(lines, kinds)
    found = _fetched(docs, wanted)
    below = F.col("at") >= _by_edits(F.col("k"), lambda e: F.lit(len(_places(e))))  # keys beyond those of the own class belong to the one below
    now = members.join(found.drop("symbols", "hashes"), "id").withColumns({
        "own": F.col("at") <= F.col("k"), "k": _edits(F.when(below, F.col("class") - 2).otherwise(F.col("class"))), "open": F.lit(True),
    })
    now = C.materialize(now.select("g", "id", "p", "n", "k", "sketch", "own", "open"))
    gone, large = _compared(now, found, group, False)
    if not large.isEmpty():
        now = now.join(_small(large.select("g", F.col("lead.id").alias("_lead"))), "g").join(_small(gone.withColumn("_gone", F.lit(True))), "id", "left")
        # nothing is preferred to a lead in its group
        now = C.materialize(now.withColumn("open", F.col("_gone").isNull() & (F.col("id") != F.col("_lead"))).drop("_gone", "_lead"))
        now = _rare(now.join(_small(now.where("open").select("g").distinct()), "g", "left_semi"), found)
        gone = gone.union(_compared(C.materialize(now), found, group, True)[0])
    return gone.distinct().join(wanted.select("id", "ha", "hb"), "id").select("ha", "hb")


# ---------------------------------------------------------------- documents


def _documents(docs: DataFrame) -> DataFrame:
    """(doc, th, text): doc orders documents, th tells texts apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("th"), "text")


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """(doc, th, gone): for each document that loses any, the positions of the lines to remove."""
    lines = _documents(docs).select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = with_class(lines.where((F.length("line") >= min_chars) & (F.trim("line", F.lit(_BLANK)) != "")))
    lines = C.materialize(lines.select("doc", "th", "pos", F.xxhash64("line").alias("ha"), F.xxhash64(F.lit(1), "line").alias("hb"), _all_keys().alias("keys")))
    kinds = C.materialize(lines.groupBy("ha", "hb").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count("*").alias("times")))
    near = near_kinds(docs, lines, kinds, group).withColumn("near", F.lit(True))
    marked = kinds.join(_small(C.materialize(near)), ["ha", "hb"], "left").where("times > 1 or near")
    hits = lines.select("doc", "th", "pos", "ha", "hb").join(marked, ["ha", "hb"])
    hits = hits.where(F.col("near") | (F.struct("doc", "th", "pos") != F.col("first")))
    return C.materialize(hits.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone")))


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed"), **how) -> DataFrame:
    """docs with the lines removed from text, and with the numbers of lines and of lines removed under the names of
    `counts`; clashing columns of those names are replaced."""
    gone = removed_lines(docs, **how)
    n_gone = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if n_gone <= BROADCAST_LINES else gone.hint("shuffle_hash")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # apart from the names used here
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    rows = docs.select(row, doc.alias("doc"), F.xxhash64(docs["text"]).alias("th")).join(gone, ["doc", "th"], "left")
    text = F.col("row.text")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
        return F.struct(F.size(lines).cast("long").alias("n"), F.when(F.col("gone").isNull(), text).otherwise(left).alias("text"))

    new = F.when(text.isNull(), F.struct(F.lit(0).cast("long").alias("n"), text.alias("text"))).otherwise(_let(F.split(text, "\n"), without))
    rows = rows.withColumn("new", new)
    kept = [F.col("new.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return rows.select(*kept, F.col("new.n").alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(counts[1]))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document of documents with its lines in the order they stood, without repeated and nearly repeated ones."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text")
