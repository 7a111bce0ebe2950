"""The registered queries themselves, on small tables, against brute force."""

import zlib

import numpy as np
import public_tokenizers
from graphmill.llm import queries
from test_llm_operators import brute_fingerprint, check_packing, closure
from test_passages import brute_bytes, brute_words


def test_passage_queries(spark, rows, sf_dir):
    assert sorted(map(tuple, queries.op1_substring_automata(spark, sf_dir).collect()), key=str) == brute_words(rows)
    assert sorted(map(tuple, queries.op5_suffix_array_grouping(spark, sf_dir).collect()), key=str) == brute_bytes(rows)


def test_simhash_query(spark, rows, sf_dir):
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = closure([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert sorted(map(tuple, queries.op6_simhash_deletion_variants(spark, sf_dir).collect())) == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True))


def test_packing_query(spark, rows, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = queries.op10_local_search_packing(spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)


def test_embedding_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 64))
    rows = [(i, (base[i % 12] + 0.15 * rng.normal(size=64)).tolist(), i % 12 % 3) for i in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 64, 1), (102, [float("nan")] * 64, 1), (103, rows[0][1], None), (104, rows[0][1], rows[0][2])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: tuple(r) for r in queries.op8_embedding_near_dedup(spark, str(tmp_path)).collect()}
    v = {i: np.array(e, np.float32).astype(float) for i, e, label in rows if e is not None and label is not None and np.isfinite(e).all() and np.any(e)}
    label = {r[0]: r[2] for r in rows}
    ids = sorted(r[0] for r in rows)

    def linked(a, b):
        a, b = ids[a], ids[b]
        return a in v and b in v and label[a] == label[b] and v[a] @ v[b] >= 0.93 * np.linalg.norm(v[a]) * np.linalg.norm(v[b])

    comp = closure(ids, linked)
    links = [sum(linked(i, j) for j in range(len(ids)) if j != i) for i in range(len(ids))]
    assert got == {i: (i, n, c, i == c) for i, n, c in zip(ids, links, comp, strict=True)}
    assert sum(links) > 50
