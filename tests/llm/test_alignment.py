"""Two tokenizers aligned by elementary intervals against two pointers over the token lists, links counted in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from graphmill.llm import alignment, bytebpe, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import sentencepiece

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """ids and bytes of both sides for a text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    sides = alignment.BytePairs(bytebpe.file_bytes(None, A)), alignment.SentencePieces(bytebpe.file_bytes(None, B))

    def tokens(text):
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [sides[0].bytes_of[k] for k in ids_a], [sides[1].bytes_of[k] for k in ids_b]
        whole = (" " + text).encode()
        return (ids_a, ids_b, bytes_a, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])

    return tokens


def expected(plain, rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b, bytes_a, bytes_b = plain(text)
        i = j = at_a = at_b = 0
        links, groups, now = [], [], ([], [])
        while i < len(a):
            if len(now[0]) == 0 or now[0][-1] != i:
                now[0].append(i)
            if len(now[1]) == 0 or now[1][-1] != j:
                now[1].append(j)
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(bytes_a[i]), at_b + len(bytes_b[j])
            if end_a == end_b:
                groups.append(now)
                now = ([], [])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
        counts.update(set(links))
        text = ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in groups)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    return counts, sorted(((d, n, m, g, len(k), sum(counts[p] == top[p[0]] for p in k), sum(counts[p] for p in k), h) for d, n, m, g, k, h in found), key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["▁", "a▁b", "<|endoftext|> <s> </s> <unk>", " ", "  ", "\n", "a  b", " a", "a ", "é\u0301", "日本語 x", "\0", "😀😀", "<0x41>", "ﬁ", "it's they'll", "x" * 900, "\t\tif x:\n        y", "\u00a0a\u2003b", "Ǆ\r\n\r\n"]


def test_query(spark, docs, rows, sf_dir, plain):
    got = queries.op13_token_alignment(spark, sf_dir)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == expected(plain, [r[:2] for r in rows])[1]


def test_given_tables(spark, plain):
    top = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{top}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op13_token_alignment(spark, top).collect()), key=str) == expected(plain, rows)[1]


def sides():
    return (alignment.BytePairs, bytebpe.file_bytes(None, A)), (alignment.SentencePieces, bytebpe.file_bytes(None, B))


def test_odd_texts_in_small_blocks_and_parts(spark, plain, monkeypatch):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices([*ODD, " ", "word", " the"], k=rng.randint(1, 30))).replace("▁", "") for _ in range(200)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, "a  b"), (1, "a  b")]
    counts, want = expected(plain, rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(3)
    monkeypatch.setattr(alignment, "BLOCK", 700)
    pairs, got = alignment.align_documents(frame, *sides())
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)


def test_parts(monkeypatch):
    """Encoded by parts, of which few are remembered: the same ids as at once. (Texts with a U+2581 have no tokens in any case.)"""
    rng, plain = random.Random(5), [t for t in ODD if "▁" not in t]
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    aligner = alignment.Aligner(*[kind(file) for kind, file in sides()])
    for _ in range(400):
        texts = ["".join(rng.choices([*plain, " ", "word", " the", "ing"], k=30)) for _ in range(3)]
        for text, parts in zip(texts, aligner.parts([t.encode() for t in texts]), strict=True):
            assert "".join(alignment.parts_of(" " + text)) == " " + text
            whole = [s.encode([" " + text])[0] for s in (aligner.a, aligner.b)]
            same = all(b"".join(s.bytes_of[k] for k in w) == (" " + text).encode() for s, w in zip((aligner.a, aligner.b), whole, strict=True))
            assert [np.frombuffer(b"".join(p[k] for p in parts), np.int32).tolist() for k in (0, 1)] == (whole if same else [[], []])


def test_groups_and_their_products(spark, plain):
    frame = spark.createDataFrame([(1, "Unbelievable tokenization, naïve 日本"), (2, None), (3, "▁")], "doc_id long, text string")
    groups = alignment.token_groups(frame, *sides())
    rows = sorted(groups.collect(), key=lambda r: r["group"])
    a, b, bytes_a, bytes_b = plain("Unbelievable tokenization, naïve 日本")
    assert {r["doc_id"] for r in rows} == {1}
    assert [k for r in rows for k in r["a_ids"]] == a and [k for r in rows for k in r["b_ids"]] == b
    ends = lambda parts: set(np.cumsum([len(p) for p in parts]).tolist())
    assert len(rows) == len(ends(bytes_a) & ends(bytes_b))
    products = Counter((r["group"], r["a"], r["b"]) for r in alignment.group_pairs(groups).collect())
    assert products == Counter((r["group"], x, y) for r in rows for x in r["a_ids"] for y in r["b_ids"])


def test_empty(spark, empty):
    pairs, got = alignment.align_documents(empty, *sides())
    assert got.columns == NAMES and got.count() == 0 and pairs.count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_documents(nothing, *sides())[1].collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
