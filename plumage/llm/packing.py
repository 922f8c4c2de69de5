"""Packing documents into windows of WINDOW tokens by non-negative least squares.

A document's full windows fill sequences of their own. What remains of it is shorter than a window, so the histogram
of these remainders has under WINDOW bins whatever the corpus. Shallow combinations of two or three lengths that fill
a window exactly are enumerated; non-negative least squares finds how often to repeat each so that together they use
up the histogram; the counts are rounded down. What is left is cut into powers of two (the binary digits of its
length) and packed greedily from the largest: powers of two in falling order never straddle a window, so at most the
last sequence needs padding.

Plan: one Arrow pass tokenises and keeps, per document, the length and the CRC-32 of each full window, of the
remainder and of its powers of two, so ids are never shuffled. Documents get a rank among those of equal remainder by
salted windows: local ranks within (remainder, salt), plus offsets summed over the salts. Where a rank goes follows
from the plan by a broadcast join with a table of at most a few thousand intervals.

Nulls and edge cases: a null or empty text is the end token alone; extra columns are ignored; rows that repeat are
packed each, as is a row with a null doc_id; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from json import loads

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C

WINDOW = 1024
BITS = WINDOW.bit_length() - 1
#: Lengths whose triples are enumerated, the most frequent ones; with all pairs, fewer than 1,700 combinations.
FREQUENT = 48
ROWS_PER_SALT = 20_000


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of a byte-level BPE file of `tokenizers`. A text that holds the string of a special token goes through that
    library, which is loaded at the first such text; all others through `tiktoken` with the file's vocabulary as ranks, which
    gives the same ids (tests compare them over every code point) in a sixth of the time."""

    def __init__(self, json: str):
        import public_tokenizers as P
        import tiktoken

        self.json, self.tokenizer = json, None
        held = loads(json)
        self.special = [t["content"] for t in held["added_tokens"]]
        byte, special = byte_of(), set(self.special)
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in held["model"]["vocab"].items() if t not in special}
        del held
        self.quick = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_str(self.json)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.quick.encode_ordinary(text), np.uint32)


def cut_points(n: int) -> tuple[list[int], list[int]]:
    """Ends of the full windows of n tokens, and of the powers of two that make up the remainder, largest first."""
    windows = list(range(WINDOW, n + 1, WINDOW))
    at, parts = n - n % WINDOW, []
    for k in reversed(range(BITS)):
        if n % WINDOW >> k & 1:
            at += 1 << k
            parts.append(at)
    return windows, parts


_tokens: dict[int, Tokens] = {}


def _measure(shared, end_id: int):
    """Arrow batches (doc_id, text) to lengths and checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _tokens:
            _tokens[key] = Tokens(shared.value)
        for batch in batches:
            rows = max(1, len(batch) * (2 << 20) // max(1, batch.nbytes))
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                n, windows, rest, powers = [], [], [], []
                for text in part.column(1).to_pylist():
                    raw = np.append(_tokens[key].encode(text or ""), np.uint32(end_id)).astype("<u4").tobytes()
                    size = len(raw) // 4
                    full, parts = cut_points(size)
                    n.append(size)
                    windows.append([zlib.crc32(raw[4 * (e - WINDOW) : 4 * e]) for e in full])
                    start = size - size % WINDOW
                    rest.append(zlib.crc32(raw[4 * start :]))
                    powers.append([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([start, *parts[:-1]], parts, strict=False)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(windows, pa.list_(pa.int64())), pa.array(rest, pa.int64()), pa.array(powers, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "windows", "rest", "powers"],
                )

    return run


def combinations(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill a window and, of the most frequent lengths, triples; only of lengths that occur."""
    some = hist > 0
    out = [(a, WINDOW - a) for a in range(1, WINDOW // 2 + 1) if some[a] and some[WINDOW - a]]
    top = sorted(np.argsort(-hist, kind="stable")[:FREQUENT].tolist())
    top = [a for a in top if some[a]]
    seen = set()
    for i, a in enumerate(top):
        for b in top[i:]:
            c = WINDOW - a - b
            if c > 0 and some[c]:
                seen.add(tuple(sorted((a, b, c))))
    return out + sorted(seen)


def least_squares(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Counts x >= 0 of the columns (lengths with repeats) that bring the sum of squares of target - A x to its least:
    each coordinate in turn takes its best value at or above zero."""
    use = [np.unique(c, return_counts=True) for c in columns]
    left, x = target.astype(float), np.zeros(len(columns))
    norm = [float((m * m).sum()) for _, m in use]
    for _ in range(sweeps):
        moved = 0.0
        for i, (length, m) in enumerate(use):
            step = max(float(left[length] @ m) / norm[i], -x[i])
            if step:
                x[i] += step
                left[length] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(hist: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Combinations with whole repeat counts, and how many of each length are left for the greedy packing."""
    columns = combinations(hist)
    x = np.floor(least_squares(columns, hist) + 1e-6).astype(np.int64)
    left, out = hist.copy(), []
    for i in np.argsort(-x, kind="stable"):
        length, m = np.unique(columns[i], return_counts=True)
        times = int(min(x[i], (left[length] // m).min()))
        if times > 0:
            left[length] -= times * m
            out.append((columns[i], times))
    for c in columns:  # what rounding has left and still fits
        length, m = np.unique(c, return_counts=True)
        times = int((left[length] // m).min())
        if times > 0:
            left[length] -= times * m
            out.append((c, times))
    return out, left


def _table(rows: list[tuple], **columns: pa.DataType) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(columns, row, strict=True)) for row in rows], pa.schema(list(columns.items())))


def measure(docs: DataFrame, json: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n, windows, rest, powers): tokens of each document with the end token, and CRC-32 of its full windows,
    of its remainder and of the powers of two that this is cut into if no combination takes it."""
    shared = docs.sparkSession.sparkContext.broadcast(json)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return C.map_arrow(texts, _measure(shared, end_id), "doc_id long, n long, windows array<long>, rest long, powers array<long>")


def pack(docs: DataFrame, json: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    rows = C.materialize(measure(docs, json, end_id))
    salts = max(64, rows.count() // ROWS_PER_SALT)
    rows = rows.select(
        "*", F.expr(f"cast(n % {WINDOW} as int)").alias("r"), F.expr(f"n div {WINDOW}").alias("q"),
        F.pmod(F.xxhash64("doc_id", "n", "rest"), F.lit(salts)).cast("int").alias("salt"),
    )
    sums = C.materialize(rows.groupBy("r", "salt").agg(F.count("*").alias("c"), F.sum("q").alias("w")))
    by_r = {x.r: (x.c, x.w) for x in sums.groupBy("r").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).collect()}  # at most WINDOW rows

    hist = np.zeros(WINDOW, np.int64)
    for r, (c, _) in by_r.items():
        hist[r] = c if r else 0
    chosen, left = plan(hist)

    # full windows come first, by remainder; then the combinations; then the powers of two
    window_base, at = {}, 0
    for r in sorted(by_r):
        window_base[r] = at
        at += by_r[r][1]
    taken, intervals = np.zeros(WINDOW, np.int64), []
    for lengths, times in chosen:
        offset = 0
        for length in lengths:
            intervals.append((int(length), int(taken[length]), int(taken[length]) + times, at, offset))
            taken[length] += times
            offset += length
        at += times
    position, bases = 0, np.zeros((WINDOW, BITS), np.int64)
    for k in reversed(range(BITS)):
        for r in range(WINDOW):
            if r >> k & 1:
                bases[r, k] = position
                position += int(left[r]) << k
    lengths = [(r, window_base[r], int(taken[r]), [int(x) for x in bases[r]]) for r in sorted(by_r)]

    by = ["r", "salt"]
    from pyspark.sql import Window

    earlier = Window.partitionBy("r").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"))
    inside = Window.partitionBy(*by).orderBy("doc_id", "n", "rest", "windows")
    ranked = rows.join(offsets, by).select(
        "*", (F.col("c0") + F.row_number().over(inside) - 1).alias("rank"),
        (F.col("w0") + F.coalesce(F.sum("q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("w"),
    )
    # as Arrow tables: lists would go through Python workers of another kind, which stay beside those of the texts
    of_length = spark.createDataFrame(_table(lengths, r=pa.int32(), window_base=pa.int64(), taken=pa.int64(), bases=pa.list_(pa.int64())))
    spans = spark.createDataFrame(_table(intervals, r=pa.int32(), low=pa.int64(), high=pa.int64(), base=pa.int64(), at=pa.int64()))
    placed = ranked.join(F.broadcast(of_length), "r").alias("a").join(
        F.broadcast(spans).alias("b"), F.expr("a.r = b.r and a.rank >= b.low and a.rank < b.high"), "left"
    ).select("a.*", "b.low", "b.base", "b.at")
    piece = "'start', {}, 'length', {}, 'ids_crc32', {}, 'sequence_id', {}, 'offset', {}"
    full = piece.format(f"i * {WINDOW}L", f"{WINDOW}L", "windows[cast(i as int)]", "window_base + w + i", "0L")
    whole = piece.format(f"q * {WINDOW}", "cast(r as bigint)", "rest", "base + rank - low", "at")
    where = "(bases[k] + shiftleft(rank - taken, k))"
    power = piece.format(
        f"q * {WINDOW} + shiftleft(shiftright(r, k + 1), k + 1)", "cast(shiftleft(1, k) as bigint)",
        "powers[bit_count(shiftright(r, k + 1))]", f"{at}L + {where} div {WINDOW}", f"{where} % {WINDOW}",
    )
    pieces = F.expr(f"""concat(
        case when q > 0 then transform(sequence(0L, q - 1), i -> named_struct({full})) else array() end,
        case when r = 0 then array() when base is not null then array(named_struct({whole}))
             else transform(filter(sequence({BITS - 1}, 0), k -> shiftright(r, k) % 2 = 1), k -> named_struct({power})) end)""")
    out = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(pieces).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def read_json(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers as P

    with open(P.path(name)) as f:
        return f.read()


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_json())
