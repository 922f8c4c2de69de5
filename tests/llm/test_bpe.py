import hashlib
import random
import time

import public_tokenizers as P
import tiktoken

from plumage.llm import bpe
from plumage.llm.pieces import chunks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_same_ids_as_the_library():
    codec = bpe.Codec(RANKS, P.PATTERN, cache=50)
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", "\x85", " ", "don't", "'s", "12", "²", "日本", "\x1c", "\0", "!?", " the", "ing", "\r\n", "٣", "<|endoftext|>", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert "".join(chunks(text)) == text
        ids = codec.encode(text).tolist()
        assert ids == ENC.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_long_pre_tokens():
    rng = random.Random(2)
    for text in ("a" * 200_000, "".join(rng.choice("abcdehirst") for _ in range(200_000)), "ab" * 60_000):
        t = time.time()
        assert bpe.Codec(RANKS, P.PATTERN).encode(text).tolist() == ENC.encode_ordinary(text)
        assert time.time() - t < 30


def test_op3(spark, small):
    got = {r.doc_id: r for r in bpe.op3(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = ENC.encode_ordinary(text)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_and_round_trip(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "a b", 0), (None, "c", 1)], "doc_id long, text string, ids int")
    ids = bpe.encode(df, PATH, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in bpe.decode(ids, PATH, P.PATTERN).collect()) == [b"", b"", b"a b", b"c"]
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
