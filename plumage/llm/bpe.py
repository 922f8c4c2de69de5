"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token starts as its bytes in a doubly linked list. Every neighbouring pair that has a merge rank is noted in the
bucket of that rank; a two-level bitmap over the ranks tells which buckets hold something, so find-first-set gives the
next rank. A bucket's positions are merged from the left; those whose pair has changed since are skipped. Each merge
costs a constant number of bit operations whatever the length, so a pre-token of a million bytes takes linear space
and nearly linear time.

Plan: one Arrow pass without a shuffle. The rank file is read on the driver and broadcast (50,000 entries). Every Python
worker keeps a bounded cache of pieces it has met, as words repeat.

Nulls and edge cases: a null text counts as empty and gives no ids; texts that no vocabulary word covers fall back to
single bytes, which the ranks always hold; extra columns are ignored; rows that repeat are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage.llm.pieces import Recent, chunks

#: Pieces, and pre-tokens, that a worker remembers in each half of its memory (at most about 300 MB).
CACHE = 400_000


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    The queue: `buckets` holds positions by rank; `top` has a bit for each block of 256 ranks that holds any, and
    low[block] a bit for each rank within it. It is written out in place, as a call for each entry would double the time.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # links of the list; a part is piece[i:after[i]]
    current: list[int | None] = [None] * n  # the rank of the pair that begins at i
    top, low, buckets = 0, {}, {}
    for i in range(n - 1):
        r = current[i] = get(piece[i : i + 2])
        if r is not None:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                block = r >> 8
                top |= 1 << block
                low[block] = low.get(block, 0) | 1 << (r & 255)
    while top:
        # find-first-set on both levels
        block = (top & -top).bit_length() - 1
        bits = low[block]
        rank = block << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets.pop(rank)
        low[block] = bits = bits & (bits - 1)
        if not bits:
            top &= top - 1
        if len(bucket) > 1:
            bucket.sort()
        for turn, i in enumerate(bucket):
            if current[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            current[j] = None
            lower = False
            if end < n:
                before[end] = i
                r = current[i] = get(piece[i : after[end]])
                if r is not None:
                    lower = r < rank
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        block = r >> 8
                        top |= 1 << block
                        low[block] = low.get(block, 0) | 1 << (r & 255)
            else:
                current[i] = None
            p = before[i]
            if p >= 0:
                r = current[p] = get(piece[p:end])
                if r is not None:
                    lower |= r < rank
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        buckets[r] = [p]
                        block = r >> 8
                        top |= 1 << block
                        low[block] = low.get(block, 0) | 1 << (r & 255)
            if lower:  # a merge of a smaller rank has come up: it goes before the rest of this bucket
                rest = [k for k in bucket[turn + 1 :] if current[k] == rank]
                if rest:
                    buckets[rank] = rest
                    top |= 1 << (rank >> 8)
                    low[rank >> 8] = low.get(rank >> 8, 0) | 1 << (rank & 255)
                break
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


def read_ranks(text: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, text.splitlines()) if a}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.words = {i: b for b, i in ranks.items()}
        self.pieces, self.tokens = Recent(cache), Recent(cache)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as 32-bit numbers in the machine's order."""
        found = self.pieces.find(piece)
        if found is None:
            parts = []
            for token in self.find(piece):
                ids = self.tokens.find(token)
                if ids is None:
                    ids = array("I", merge(token.encode(), self.ranks)).tobytes()
                    if len(token) <= 64:
                        self.tokens.put(token, ids)
                parts.append(ids)
            found = b"".join(parts)
            if len(piece) <= 64:
                self.pieces.put(piece, found)
        return found

    def encode_all(self, texts: list[str]) -> Iterator[array]:
        """Ids of each text; each different piece of all of them is looked up once."""
        cut = [chunks(t) for t in texts]
        own = {p: self._piece(p) for p in set().union(*cut)}
        for pieces in cut:
            ids = array("I")
            ids.frombytes(b"".join(map(own.__getitem__, pieces)))
            yield ids

    def encode(self, text: str) -> array:
        return next(self.encode_all([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a worker process and vocabulary."""
    text, pattern = shared.value
    key = hash(text), pattern
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(text), pattern)
    return _codecs[key]


def _shared(spark: SparkSession, path: str, pattern: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def _texts(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes."""
    for batch in batches:
        rows = max(1, len(batch) * size // max(1, batch.nbytes))
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(shared)
        for b in _texts(batches):
            ids = [x.tolist() for x in codec.encode_all([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids)."""
    shared = _shared(ids.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(shared)
        for b in _texts(batches):
            out = [codec.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, of which the digests stay."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(shared)
        number = [str(i) for i in range(max(codec.words) + 1)].__getitem__
        for b in _texts(batches):
            n, coded, decoded = [], [], []
            for ids in codec.encode_all([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
