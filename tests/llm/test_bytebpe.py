"""Byte-level BPE joined over halves against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from graphmill.llm import bytebpe, queries
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bytebpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("leaf", "match_leaf"), [(1, 1), (2, 3), (5, 2), (7, 8), (64, 4)])
def test_joins(ranks, library, monkeypatch, leaf, match_leaf):
    """Tiny leaves: every join at every kind of seam."""
    monkeypatch.setattr(bytebpe, "LEAF", leaf)
    monkeypatch.setattr(bytebpe, "MATCH_LEAF", match_leaf)
    bpe, rng = bytebpe.ByteBpe(ranks, public_tokenizers.PATTERN), random.Random(leaf)
    parts = ["a", "b", "'", " ", "  ", "\n", "\t", "re", "'ll", "'s", "1", "23", ".", "!!", "é", "ß", "日", "本語", "\u3000", "the", " and", "ing", "X", "\r\n", "'ve", "😀", "\u0301", "==", "-----", "\0", "\x1c", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choices(rng.sample(parts, rng.randint(1, 8)), k=rng.randint(0, 40)))
        ids = bpe.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text
        assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 40000, "ab" * 30000, " " * 50000 + "x", "=-" * 20000, "日" * 20000, "the" * 20000, "1" * 30000, "\n \n" * 9000])
def test_one_long_match(ranks, library, text):
    bpe = bytebpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    ids = bpe.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_memory_of_a_worker_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    monkeypatch.setattr(bytebpe, "LEAF", 50)
    bpe = bytebpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    text = " ".join(f"w{k} x" for k in range(500))
    assert bpe.encode(text).tolist() == library.encode_ordinary(text)
    assert len(bpe) <= 5 and len(bpe.apart) <= 5


def test_tokens_that_no_merge_reaches(monkeypatch):
    """A match that is a token is that token, though merges wouldn't make it; inside a longer match it isn't."""
    monkeypatch.setattr(bytebpe, "MATCH_LEAF", 2)
    monkeypatch.setattr(bytebpe, "LEAF", 2)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bcd": 301, b"abcd": 400, b"xyz": 302}
    bpe = bytebpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzxyz", "bcd", "abcd", "aabcd", "abcdx", "bcd bcd", "xxyz xyz", "bcdbcdbcdbcd"):
        assert bpe.encode(text).tolist() == library.encode_ordinary(text), text


def test_single_bytes_are_needed():
    with pytest.raises(ValueError, match="single bytes"):
        bytebpe.read_ranks(b"YQ== 0\n")


def expected(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, docs, rows, sf_dir, library):
    got = queries.op12_bpe_tree_reduction(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, [r[:2] for r in rows])


def test_given_tables(spark, library):
    top = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{top}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op12_bpe_tree_reduction(spark, top).collect()), key=str) == expected(library, rows)


def test_edges(spark, docs, empty, library):
    assert bytebpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, ids int")
    odd = odd.union(spark.range(1).select(F.lit(4), F.unhex(F.lit("61FF62")).cast("string"), F.lit(4)))
    got = bytebpe.decode_documents(bytebpe.encode_documents(odd.withColumn("decoded", F.col("ids")), PATH, public_tokenizers.PATTERN, keep=("ids", "decoded", "text")), PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "ids", "ids_in", "decoded_in", "text_in", "decoded"]
    found = sorted(((r["doc_id"], r["ids_in"], r["decoded_in"], bytes(r["decoded"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got.collect()), key=str)
    ab = library.encode_ordinary("a b")
    assert found == sorted([(None, 1, 1, b"a b", ab), (None, 1, 1, b"a b", ab), (2, 2, 2, b"", []), (3, 3, 3, b"", []), (4, 4, 4, "a\ufffdb".encode(), library.encode_ordinary("a\ufffdb"))], key=str)
