import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from plumage.llm import line_dedup


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def edits(a, b):
    """Edits allowed between the shorter and another of the same symbols, from doubling lengths."""
    words = isinstance(a, list)
    least, k = (10, 1) if words else (20, 1)
    n = min(len(a), len(b))
    while n >= 2 * least and k < 4:
        least, k = 2 * least, k + 1
    return k


def brute(rows):
    """rows: (doc_id, text). What stays of each text, comparing every kind of line with every other."""
    kinds, out = defaultdict(list), {}
    able = lambda l: len(l) >= 20 and l.strip(" \t\r\x0b\x0c")
    rows = sorted(rows, key=lambda r: r[0])
    for i, text in rows:
        for pos, line in enumerate(text.split("\n")):
            if able(line):
                kinds[line].append((i, pos))
    order = sorted(kinds, key=lambda l: (-len(kinds[l]), kinds[l][0]))
    symbols = {l: l.split(" ") if len(l.split(" ")) >= 10 else l for l in order}
    by_size, near = defaultdict(list), set()
    for line in order:
        s = symbols[line]
        words = isinstance(s, list)
        for n in range(len(s) - 4, len(s) + 5):
            if any(distance(s, x, edits(s, x)) <= edits(s, x) for x in by_size[words, n]):
                near.add(line)
                break
        by_size[words, len(s)].append(s)
    for i, text in rows:
        lines = enumerate(text.split("\n"))
        out[i] = "\n".join(l for pos, l in lines if not (able(l) and (l in near or kinds[l][0] != (i, pos))))
    return out


def test_bit_parallel_distance(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(600):
        a = [rng.choice("abé") for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["b"], ["x"]])
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for k in (1, 2, 4):
        for r in df.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect():
            assert r.d == distance(r.a, r.b, k), r
    cut = line_dedup.trimmed(df.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), "x", "y")
    for r in cut.collect():
        assert distance(r.a, r.b, 30) == distance(r.x, r.y, 30), r


def _variants(rng, base, pool, times, most):
    for i in range(times):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(most)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(pool)
            lines.append(line)
        yield i, lines


def test_variants_of_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 190))) for _ in range(14)]
    rows = [(i, "\n".join([*map("".join, lines), "", "short"])) for i, lines in _variants(rng, base, ["", "x", "ü"], 60, 6)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_variants_of_lines_by_words(spark):
    """Groups small and large for the join: what a large group leaves open is cut again."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    base = [[word() for _ in range(rng.choice([9, 10, 11, 19, 20, 22, 39, 41, 79, 82, 170]))] for _ in range(14)]
    rows = [(i, "\n".join(map(" ".join, lines))) for i, lines in _variants(rng, base, [[], ["x"], ["é", "y"]], 80, 7)]
    head = [word() for _ in range(12)]  # a beginning that many different lines share
    rows += [(100 + i, " ".join(head + [word() for _ in range(10 + i % 3)])) for i in range(60)]
    rows += [(200 + i, " ".join(head[:9] + ["q"] + rows[90 + i][1].split(" ")[10:])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(want[200 + i] == "" for i in range(20)) == 20
    for group in (2, 1000):
        assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df, group=group).collect()} == want


def test_op2_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.text for r in line_dedup.op2(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_a_text_of_many_lines(spark):
    text = "\n".join(f"line number {i} of a text that has very many of them {i * i}" for i in range(50_000))
    df = spark.createDataFrame([(1, text), (2, f"{text}\nline number 3 of a text that has very many of them 9")], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).drop("text").collect()}
    assert got[1][0] == 50_000 and got[2] == (50_001, 50_001) and time.time() - start < 120


def test_edge_cases(spark):
    long = "a line that is long enough to be compared with others"
    blank = " \t" * 25
    rows = [(1, None, "a"), (2, "", "a"), (3, f"{long}\n{long}", "a"), (3, f"{long}\n{long}", "b"), (None, long, "a"), (4, f"{blank}\n{blank}", "a"), (5, f"{long}!", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted(((r.doc_id or 0, r.line, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=lambda r: r[:2])
    assert got == [(0, "a", long, 1, 0), (1, "a", None, 0, 0), (2, "a", "", 1, 0), (3, "a", "", 2, 2), (3, "b", "", 2, 2), (4, "a", rows[5][1], 2, 0), (5, "a", "", 1, 1)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_line_that_repeats_itself_is_once_under_a_key(spark):
    texts = ["la " * 40 + end for end in ("one", "two", "three", "four")] + ["ab" * 30 + end for end in ("x", "yz", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.with_class(line_dedup._documents(docs).select("doc", "th", F.lit(0).alias("pos"), F.col("text").alias("line")))
    lines = lines.select("doc", "th", "pos", F.xxhash64("line").alias("ha"), F.xxhash64(F.lit(1), "line").alias("hb"), line_dedup._all_keys().alias("keys")).localCheckpoint()
    kinds = lines.groupBy("ha", "hb").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count("*").alias("times"))
    members = line_dedup._members(lines, kinds)[0].select("g", "id")
    assert members.count() == members.distinct().count() > 0
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.text}
    assert kept == {0, 4}
