import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from plumage.llm import packing


def check(rows, texts):
    """Every id in one piece, pieces gapless in their sequences, little padding."""
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    total = 0
    for i, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024
    return len(by_seq), total


def test_op6(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    n, total = check(packing.op6(spark, small).collect(), {r.doc_id: r.text for r in rows})
    assert n <= total // 1024 + 3


def test_least_squares_and_plan():
    hist = np.zeros(1024, np.int64)
    hist[[100, 200, 724, 512, 300]] = [50, 50, 50, 20, 7]
    chosen, left = packing.plan(hist)
    assert left.sum() <= 14 and sum(t for c, t in chosen if c == (512, 512)) == 10
    a = np.random.default_rng(0).integers(1, 1024, 20_000)
    hist = np.bincount(a, minlength=1024)
    chosen, left = packing.plan(hist)
    assert all(sum(c) == 1024 for c, _ in chosen) and (left >= 0).all() and left.sum() < 0.2 * hist.sum()


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a <|endoftext|> b", 5: "x" * 1022, 6: "  <|endoftext|>  "} | {10 + i: "same text here" for i in range(40)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, offset int")
    check(packing.pack(df, packing.read_json()).collect(), texts)
    assert packing.pack(df.limit(0), packing.read_json()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = packing.pack(twice, packing.read_json()).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.length for r in got) == 8


def test_same_ids_as_tokenizers():
    tokens = packing.Tokens(packing.read_json())
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    points = points[:0x3000] + points[0x3000::16]
    for i in range(0, len(points), 64):
        text = "".join(f"{c}a{c}1{c} {c}{c}!{c}\n{c}b 1{c} " for c in points[i : i + 64])
        assert tokens.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids
    for text in ("a" * 300_000, " " * 300_000, "\n" * 100_000 + "x", " <|endoftext|>x", "ab " * 100_000):
        assert tokens.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_plan_needs_no_python_rows(spark):
    """The tables of lengths and intervals reach Spark without Python workers of their own."""
    df = spark.createDataFrame([(i, "word " * i) for i in range(300)], "doc_id long, text string")
    out = packing.pack(df, packing.read_json())
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
