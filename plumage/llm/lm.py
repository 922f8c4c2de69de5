"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts.

Unigrams give the base: add-one smoothing with exact counts. All pairs of neighbouring training words are counted; a pair
seen c times enters the filter under the levels 1 .. 1 + floor(log_BASE c), and a reader probes level after level until
one is missing. The last level that is there stands for the least count of that level, so that the counts of a context
never add up to more than c(v), but for false positives. With c(v) the exact count of a context and B the base, the model is

    P(w | v) = (pair(v, w) + MU * B(w)) / (c(v) + MU),

which is B(w) for a word v that training has not and for the first word of a document.

Plan: all counts are taken over all training documents by partial and final sums; a pair's key is a 64-bit hash of both
words. Tasks sum pairs and send them packed, one row for each section of the hash's range (a section holds about
SECTION_TOKENS pairs at most, so a task can; SECTIONS of them at least, a power of two from 2^8 on), to where the section's pairs are summed and enter the bits of its buckets:
BITS_PER_KEY for each level of each pair, and buckets grow in number with the tokens, so the filter grows with the pairs. Only bounded things are broadcast: words more frequent than a
count that a histogram gives (at most FREQUENT), and the filter up to BROADCAST_BYTES; a larger one stays in buckets over
the partitions, and each chunk of documents sends every section of it its different pairs and rare words, packed, and gets
levels and counts back. With a broadcast filter, positions with a word outside the broadcast list are rows (document, pair, times)
that get what they lack by shuffle joins on the hash of the word; their part of a score is a sum, so it is added
afterwards. Both ways give the same scores. Rows that repeat altogether are scored in one chunk.

Nulls and edge cases: a null or empty text is the end token alone; a null doc_id is not held out and trains; without
training documents every count is 0; extra columns are ignored; rows that repeat train and are scored each. Words are
told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C

FREQUENT, MU = 1 << 18, 50.0
BASE, PROBES, BITS_PER_KEY = 1.5, 4, 8
#: A filter of at most so many bytes is broadcast; chunks of documents ask the buckets of a larger one.
BROADCAST_BYTES = 1 << 27
#: Training tokens for each bucket of the filter, and for each section that is summed at once; sections at least.
BUCKET_TOKENS, SECTION_TOKENS, SECTIONS = 1 << 13, 1 << 22, 1 << 8
END = np.uint64(0x5BD1E9955BD1E995)
#: Bytes of the texts that are scored at once where the filter is not broadcast.
CHUNK_BYTES = 1 << 22
#: Words, or pairs, that a task counts before it hands on its sums.
BUFFER, PAIR_BUFFER = 4_000_000, 2_500_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, each followed by the end token, and each document's first."""
    words, first = C.word_hashes(data, offsets)
    n = len(first) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = first[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    return out, first + np.arange(n + 1)


class Lookup:
    """Positions of 64-bit keys in a list of at most FREQUENT, -1 for others."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.shift = keys[self.order], np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.stop = np.append(self.start[1:], np.int32(len(keys)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int32)
        slot = (x >> self.shift).astype(np.int32)
        at, stop, left = self.start[slot], self.stop[slot], np.arange(len(x))
        while len(left):
            live = at < stop
            left, at, stop = left[live], at[live], stop[live]
            hit = self.keys[at] == x[left]
            out[left[hit]] = self.order[at[hit]]
            left, at, stop = left[~hit], at[~hit] + 1, stop[~hit]
        return out


def _sums(count, buffer: int, pack):
    """Arrow batches (text) to sums of what count() finds, at most `buffer` entries a time, as pack() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = C.string_bytes(batch.column(0))
            for i, j in C.steps(offsets):
                held.append(count(*tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
                size += len(held[-1])
                if size >= buffer:
                    yield pack(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield pack(*np.unique(np.concatenate(held), return_counts=True))

    return run


def _as_rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def pair_codes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of pairs, whose upper bits give the bucket; of 64 bits the lowest eight are 0, so that six bytes and the section give a code."""
    return C.mix(C.mix(v ^ np.uint64(0xA0761D6478BD642F)) + w) & ~np.uint64(0xFF)


def narrow(code: np.ndarray) -> np.ndarray:
    """The bytes of pair codes without the lowest, which is 0, and the highest, which the section gives: (n, 6)."""
    return np.ascontiguousarray(code.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 1:7])


def widen(data: bytes, section: int, bits: int) -> np.ndarray:
    """The pair codes that narrow() took the bytes of; they are of one of 2^bits sections, at least SECTIONS."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 1:7] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out[:, 7] = section >> (bits - 8)
    return out.view("<u8").ravel()


def _pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    good = np.ones(max(len(words) - 1, 0), bool)
    good[first[1:-1] - 1] = False  # no pair across documents
    return pair_codes(words[:-1][good], words[1:][good])


# ---------------------------------------------------------------- the filter


def level(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(base) + 1e-9).astype(np.int64)


def stands(top: int, base: float) -> np.ndarray:
    """The least count of each level from 0 (absent) to top."""
    return np.concatenate([[0.0], np.ceil(base ** np.arange(top) - 1e-9)])


def bucket_of(code: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each pair, of 2^bits."""
    return (code >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)


def _cut(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the rows x[cuts[0] : cuts[1]], x[cuts[1] : cuts[2]], ..."""
    size = x.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64) * size), pa.py_buffer(x)]).cast(pa.binary())


def _packed(bits: int):
    """Sorted codes and counts to one row for each of 2^bits sections: (section, codes, counts), the latter as bytes."""

    def pack(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        section = bucket_of(code, bits)
        cuts = np.append(np.flatnonzero(np.append(True, section[1:] != section[:-1])), len(code))
        return pa.RecordBatch.from_arrays([pa.array(section[cuts[:-1]]), _cut(narrow(code), cuts), _cut(n.astype(np.uint32), cuts)], names=["section", "codes", "counts"])

    return pack


def _spots(code: np.ndarray, lv: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The bits, from 0 in buckets of `size` bits, that a level of each pair sets or reads, one array a probe."""
    a = C.mix(code + lv.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, high = a & np.uint64(0xFFFFFFFF), a >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((low + np.uint64(i) * high & np.uint64(0xFFFFFFFF)) * size.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def bucket_bits(code: np.ndarray, n: np.ndarray, base: float) -> tuple[bytes, int]:
    """The bits of a bucket that holds these pairs, each of which comes once, and the highest level."""
    lv = level(n, base)
    every = np.repeat(code, lv)
    steps = np.arange(len(every)) - np.repeat(np.cumsum(lv) - lv, lv) + 1
    bits = np.zeros(-(-len(every) * BITS_PER_KEY // 64) * 64, bool)
    for spot in _spots(every, steps, np.full(len(every), len(bits))):
        bits[spot] = True
    return np.packbits(bits, bitorder="little").tobytes(), int(lv.max())


def section_bits(codes: list[bytes], counts: list[bytes], log_buckets: int, base: float) -> pa.RecordBatch:
    """(bucket, bits, top) of the buckets of a section, from the sums of all tasks."""
    code, at = np.unique(np.frombuffer(b"".join(codes), np.uint64), return_inverse=True)
    n = np.bincount(at, np.frombuffer(b"".join(counts), np.uint32), len(code))
    bucket = bucket_of(code, log_buckets)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(code))
    bits, top = zip(*(bucket_bits(code[i:j], n[i:j], base) for i, j in zip(cuts[:-1], cuts[1:], strict=True)), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(bits, pa.binary()), pa.array(top, pa.int64())], names=["bucket", "bits", "top"])


def _fill(log_sections: int, log_buckets: int, base: float):
    """Arrow batches (section, codes, counts), sorted by section, to (bucket, bits, top)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, counts = None, [], []
        for batch in batches:
            for section, code, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if section != now and codes:
                    yield section_bits(codes, counts, log_buckets, base)
                    codes, counts = [], []
                now = section
                codes.append(widen(code, section, log_sections).tobytes())
                counts.append(n)
        if codes:
            yield section_bits(codes, counts, log_buckets, base)

    return run


class Filter:
    """The bits of all buckets, or of a section's, and what each level stands for."""

    def __init__(self, buckets: list[int], bits: list[bytes], log_buckets: int, base: float, top: int):
        self.log, self.base, self.top = log_buckets, base, top
        size = np.zeros(1 << log_buckets, np.int64)
        size[buckets] = [8 * len(b) for b in bits]
        self.size, order = size, np.argsort(buckets)
        self.start = np.cumsum(size) - size
        self.bits = np.frombuffer(b"".join(bits[i] for i in order), np.uint8)
        self.counts = stands(top, base)

    def read(self, code: np.ndarray) -> np.ndarray:
        """Quantised counts: probes of level after level until one is missing."""
        return self.counts[self.levels(code, bucket_of(code, self.log))]

    def levels(self, code: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        lv = np.zeros(len(code), np.int64)
        left = np.flatnonzero(self.size[bucket])
        for step in range(1, self.top + 1):
            own = bucket[left]
            start, there = self.start[own], np.ones(len(left), bool)
            for spot in _spots(code[left], np.full(len(left), step), self.size[own]):
                spot += start
                there &= self.bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 == 1
            left = left[there]
            if not len(left):
                break
            lv[left] = step
        return lv


class Filters:
    """A filter too large to broadcast: the table (bucket, bits) and what is needed to read it."""

    def __init__(self, table: DataFrame, log_sections: int, log_buckets: int, base: float, top: int):
        self.table, self.log_sections, self.log, self.base, self.top = table, log_sections, log_buckets, base, top


class Model:
    """What tasks need: the most frequent words with their counts, and the filter, or None where probes are shuffled."""

    def __init__(self, keys, counts, n_tokens: int, n_types: int, filter_: Filter | None, mu: float):
        self.lookup, self.counts, self.n, self.v, self.filter, self.mu = Lookup(keys), counts, n_tokens, n_types, filter_, mu
        self.log1, self.whole = np.log10(counts + 1.0), counts + mu
        self.log_total = float(np.log10(n_tokens + n_types + 1))


class Words:
    """The written table (key, n) of all training words, and the filter if it is not in the model."""

    def __init__(self, table: DataFrame, filters: Filters | None):
        self.table, self.filters = table, filters


# ---------------------------------------------------------------- fitting


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words met at least as often as some count, the least for which they are at most `most`: no task sorts them."""
    level_ = F.floor(F.log2("n") * 16)
    steps = words.groupBy(level_.alias("level")).agg(F.count("*").alias("words")).collect()  # at most 16 * 63 rows
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r.level):
        total += r.words
        if total > most:
            break
        least = r.level
    return words.where(level_ >= least) if least is not None else words.limit(0)


def fit(docs: DataFrame, mu: float = MU, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[Model, Words]:
    """The model and all training words; docs: the training documents."""
    texts = docs.select("text")
    words = C.materialize(texts.mapInArrow(_sums(lambda w, first: w, BUFFER, _as_rows), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(words, FREQUENT).toArrow()  # at most FREQUENT rows of 16 bytes
    keys, counts = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()

    log_of = lambda tokens, least: max(int(np.log2(least)), int(np.ceil(np.log2(max(total.n, 1) / tokens))))
    log_sections = log_of(SECTION_TOKENS, SECTIONS)
    log_buckets = max(log_of(BUCKET_TOKENS, 1), log_sections)
    pairs = texts.mapInArrow(_sums(_pairs, PAIR_BUFFER, _packed(log_sections)), "section long, codes binary, counts binary")
    table = pairs.repartition("section").sortWithinPartitions("section").mapInArrow(_fill(log_sections, log_buckets, BASE), "bucket long, bits binary, top long")
    table = C.materialize(table)
    size = table.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("bytes"), F.coalesce(F.max("top"), F.lit(0)).alias("top")).first()
    if size.bytes <= broadcast_bytes:
        got = table.select("bucket", "bits").toArrow()  # broadcast_bytes at most
        filter_, filters = Filter(got.column(0).to_pylist(), got.column(1).to_pylist(), log_buckets, BASE, size.top), None
    else:
        filter_, filters = None, Filters(table, log_sections, log_buckets, BASE, size.top)
    return Model(keys, counts, int(total.n), int(total.v), filter_, mu), Words(words, filters)


# ---------------------------------------------------------------- scoring


def _sum_by_doc(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1]) if len(x) else np.zeros(len(first) - 1)


#: A position that tasks can't score alone: what is known of it (counts of v and w, else -1, and of the pair).
_OPEN = "v long, cv long, w long, cw long, pair double, times long"


def _scorer(shared):
    """Arrow batches (doc_id, held_out, text) to rows with what the model gives, and the other positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = C.string_bytes(batch.column(2))
            for i, j in C.steps(offsets):
                words, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = m.lookup(words)
                known = at >= 0
                base = np.where(known, m.log1[at] if len(m.log1) else 0.0, 0.0) - m.log_total  # others: their log10(c + 1) is added later
                starts = np.zeros(len(words), bool)
                starts[first[:-1]] = True
                before = np.roll(words, 1)
                v = np.roll(at, 1)
                key = pair_codes(before, words)
                count = m.filter.read(key)
                count[starts] = 0
                model = np.where(starts, base, 0.0)
                easy = np.flatnonzero(known & (v >= 0) & ~starts)
                model[easy] = np.log10((count[easy] + m.mu * 10 ** base[easy]) / m.whole[v[easy]])
                left = ~known | (v < 0) & ~starts
                model[left] = 0
                left = np.flatnonzero(left)
                doc = np.repeat(np.arange(j - i), np.diff(first))[left]
                order = np.lexsort((starts[left], key[left], doc))
                left, doc = left[order], doc[order]
                new = np.ones(len(left), bool)
                new[1:] = (key[left][1:] != key[left][:-1]) | (doc[1:] != doc[:-1]) | (starts[left][1:] != starts[left][:-1])
                cut = np.flatnonzero(new)
                times = np.diff(np.append(cut, len(left)))
                left, lists = left[cut], np.searchsorted(doc[cut], np.arange(j - i + 1)).astype(np.int32)
                there, here, begins = v[left], at[left], starts[left]
                got = there >= 0
                of = lambda x, i, ok: np.where(ok, x[i] if len(x) else 0, -1)
                open_ = [
                    np.where(begins | got, 0, before[left].view(np.int64)), np.where(begins, 0, of(m.counts, there, got)),
                    np.where(here >= 0, 0, words[left].view(np.int64)), of(m.counts, here, here >= 0), count[left], times,
                ]
                kinds = [x.split() for x in _OPEN.split(", ")]
                open_ = pa.StructArray.from_arrays([pa.array(x.astype(np.int64 if k == "long" else float)) for x, (_, k) in zip(open_, kinds, strict=True)], names=[n for n, _ in kinds])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(j - i)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                        pa.array(np.diff(first)), pa.array(_sum_by_doc(known.astype(np.int64), first)),
                        pa.array(_sum_by_doc(base, first)), pa.array(_sum_by_doc(model, first)), pa.ListArray.from_arrays(pa.array(lists), open_),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "open"],
                )
                row += j - i

    return run


def _section(key: str, log: int):
    return F.call_function("shiftrightunsigned", F.col(key), F.lit(64 - log))


def _chunk_tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk's texts, each text's first, and the codes of its pairs (any at a text's first word)."""
    data, offsets = C.string_bytes(texts.combine_chunks())
    parts = [tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.steps(offsets)]
    words = np.concatenate([w for w, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    return words, first, pair_codes(np.roll(words, 1), words)


def _inner(first: np.ndarray) -> np.ndarray:
    """Which positions are no text's first."""
    out = np.ones(first[-1], bool)
    out[first[:-1]] = False
    return out


def _ask(shared, log: int):
    """A chunk of documents to rows (section, chunk, kind, keys): what its score lacks, its different pairs (kind 0) and its different words
    outside the broadcast list (kind 1), sorted, as bytes."""

    def run(t: pa.Table) -> pa.Table:
        words, first, code = _chunk_tokens(t.column("text"))
        rare = np.unique(words[shared.value.lookup(words) < 0])
        out = []
        for kind, keys in enumerate((np.unique(code[_inner(first)]), rare)):
            section = bucket_of(keys, log)
            cuts = np.append(np.flatnonzero(np.append(len(keys) > 0, section[1:] != section[:-1])), len(keys))
            n = len(cuts) - 1
            chunk = pa.array(np.full(n, t.column("chunk")[0].as_py(), np.int64))
            out.append(pa.RecordBatch.from_arrays([pa.array(section[cuts[:-1]]), chunk, pa.array(np.full(n, kind, np.int32)), _cut(keys if kind else narrow(keys), cuts)], names=["section", "chunk", "kind", "keys"]))
        return pa.Table.from_batches(out)

    return run


def _answer(f: Filters):
    """Arrow batches of sections, each with its buckets and its words before what is asked of it, to rows (chunk, kind, section, values): the
    levels of pairs, a byte each, and the counts of words."""
    log, whole, below, base, top = f.log_sections, f.log, f.log - f.log_sections, f.base, f.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buckets, bits, words, counts, ready = None, [], [], [], [], None
        for batch in batches:
            section = batch.column("section").to_numpy()
            for i in [0, *(np.flatnonzero(section[1:] != section[:-1]) + 1).tolist()] if len(section) else []:
                own = batch.slice(i, int(np.searchsorted(section, section[i], "right")) - i)
                if section[i] != now:
                    now, buckets, bits, words, counts, ready = section[i], [], [], [], [], None
                kind = own.column("kind").to_numpy()
                a, b = np.searchsorted(kind, [-1, 0])
                buckets += own.column("key").slice(0, a).to_pylist()
                bits += own.column("bits").slice(0, a).to_pylist()
                words.append(own.column("key").slice(a, b - a).to_numpy(zero_copy_only=False).view(np.uint64))
                counts.append(own.column("n").slice(a, b - a).to_numpy(zero_copy_only=False))
                if b == len(own):
                    continue
                if ready is None:
                    w, n = np.concatenate(words), np.concatenate(counts)
                    order = np.argsort(w)
                    first = int(now) << below
                    ready = Filter([x - first for x in buckets], bits, below, base, top), w[order], n[order]
                asks, values = own.slice(b), []
                for k, keys in zip(asks.column("kind").to_pylist(), asks.column("keys").to_pylist(), strict=True):
                    if k:
                        x, n = np.frombuffer(keys, np.uint64), 0
                        if len(ready[1]):
                            at = np.minimum(np.searchsorted(ready[1], x), len(ready[1]) - 1)
                            n = np.where(ready[1][at] == x, ready[2][at], 0)
                        values.append((np.zeros(len(x), np.int64) + n).tobytes())
                    else:
                        x = widen(keys, int(now), log)
                        values.append(ready[0].levels(x, bucket_of(x, whole) & (1 << below) - 1).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([asks.column("chunk"), asks.column("kind"), asks.column("section"), pa.array(values, pa.binary())], names=["chunk", "kind", "section", "values"])

    return run


def _score_chunk(shared, top: int, base_: float):
    """A chunk of documents and the answers to what it asked, to its rows of score()."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        m: Model = shared.value
        words, first, code = _chunk_tokens(t.column("text"))
        answers = answers.sort_by([("kind", "ascending"), ("section", "ascending")])
        kind, values = answers.column("kind").to_numpy(), answers.column("values").to_pylist()
        levels, counts = (np.frombuffer(b"".join(v for k, v in zip(kind, values, strict=True) if k == own), dtype) for own, dtype in ((0, np.uint8), (1, np.int64)))
        at, inner = m.lookup(words), _inner(first)
        c = m.counts[np.maximum(at, 0)].astype(float) if len(m.counts) else np.zeros(len(words))
        c[at < 0] = counts[np.unique(words[at < 0], return_inverse=True)[1]]
        base = np.log10(c + 1.0) - m.log_total
        model = base.copy()
        pair = stands(top, base_)[levels[np.unique(code[inner], return_inverse=True)[1]]]
        model[inner] = np.log10((pair + m.mu * 10 ** base[inner]) / (np.roll(c, 1)[inner] + m.mu))
        n = len(first) - 1
        made = [pa.array(np.diff(first)), pa.array(_sum_by_doc((c > 0).astype(np.int64), first)), pa.array(np.full(n, m.n, np.int64)), pa.array(_sum_by_doc(base, first)), pa.array(_sum_by_doc(model, first))]
        return pa.Table.from_arrays([t.column("doc_id"), t.column("held_out"), *made], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_by_chunks(docs: DataFrame, model: Model, words: Words) -> DataFrame:
    """score() with a filter that stays in its buckets: documents meet in chunks of about CHUNK_BYTES, a chunk asks each section of the
    filter and of the words once for all it lacks, sorted, and the answers come back to it in that order. No position is a row."""
    shared, f = docs.sparkSession.sparkContext.broadcast(model), words.filters
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count("*")).first()[0]
    text = F.coalesce("text", F.lit(""))
    chunk = F.pmod(F.xxhash64("doc_id", text), F.lit(-(-size // CHUNK_BYTES) or 1)).alias("chunk")
    docs = docs.select(chunk, F.col("doc_id").cast("long"), "held_out", text.alias("text"))
    asks = docs.groupBy("chunk").applyInArrow(_ask(shared, f.log_sections), "section long, chunk long, kind int, keys binary")
    names = {"section": "long", "kind": "int", "key": "long", "bits": "binary", "n": "long", "chunk": "long", "keys": "binary"}
    row = lambda df, **cols: df.select(*[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in names.items()])
    col, whole = F.col, f.log - f.log_sections
    rows = row(f.table, section=F.shiftright("bucket", whole), kind=F.lit(-2), key=col("bucket"), bits=col("bits"))
    rows = rows.union(row(words.table, section=_section("key", f.log_sections), kind=F.lit(-1), key=col("key"), n=col("n")))
    rows = rows.union(row(asks, section=col("section"), kind=col("kind"), chunk=col("chunk"), keys=col("keys")))
    rows = rows.repartition("section").sortWithinPartitions("section", "kind")
    answers = rows.mapInArrow(_answer(f), "chunk long, kind int, section long, values binary")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(shared, f.top, f.base), _SCORES)


def score(docs: DataFrame, model: Model, words: Words) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); docs: (doc_id, text, held_out)."""
    if words.filters is not None:
        return _score_by_chunks(docs, model, words)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    opens = ", ".join(x.replace(" ", ": ") for x in _OPEN.split(", "))
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        _scorer(shared), f"row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, open array<struct<{opens}>>"
    )
    rows = C.materialize(rows)
    open_ = rows.select("row", F.inline("open"))
    table = words.table
    rest = [c for c in open_.columns if c not in ("v", "cv")]
    of_v = open_.where("cv < 0").join(table.select(F.col("key").alias("v"), "n"), "v", "left").select(*rest, F.coalesce("n", F.lit(0)).alias("cv"))
    open_ = of_v.union(open_.where("cv >= 0").select(*rest, "cv")).withColumn("late", F.col("cw") < 0)
    rest = [c for c in open_.columns if c not in ("w", "cw")]
    of_w = open_.where("cw < 0").join(table.select(F.col("key").alias("w"), "n"), "w", "left").select(*rest, F.coalesce("n", F.lit(0)).alias("cw"))
    open_ = of_w.union(open_.where("cw >= 0").select(*rest, "cw"))
    gain = F.log10(F.col("cw") + F.lit(1.0))
    by_base = F.pow(F.lit(10.0), gain - F.lit(model.log_total))
    p = (F.col("pair") + F.lit(model.mu) * by_base) / (F.col("cv") + F.lit(model.mu))
    met = open_.groupBy("row").agg(
        F.sum(F.when(F.col("late") & (F.col("cw") > 0), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("late"), F.col("times") * gain).otherwise(0.0)).alias("gain"), F.sum(F.col("times") * F.log10(p)).alias("part"),
    )
    return rows.drop("open").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    model, words = fit(docs.where("not held_out"))
    return score(docs, model, words)
