"""Substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from graphmill.llm import passages, substring, suffixarray


def covered(n, hits, size):
    out = np.zeros(n, bool)
    for k in hits:
        out[k : k + size] = True
    return out


def brute_words(rows, size=13):
    words = [(r[0] if r[0] is not None else 2**63 - 1, (r[1] or "").encode().split()) for r in rows]
    low = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            low[key] = min(low.get(key, i), i)
    out = []
    for r, (i, w) in zip(rows, words):
        gone = covered(len(w), [k for k in range(len(w) - size + 1) if low[tuple(w[k : k + size])] < i], size)
        out.append((r[0], len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, size=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = {}
    for _, b in texts:
        for k in range(len(b) - size + 1):
            count[b[k : k + size]] = count.get(b[k : k + size], 0) + 1
    out = []
    for i, b in texts:
        gone = covered(len(b), [k for k in range(len(b) - size + 1) if count[b[k : k + size]] > 1], size)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [(8, 48), (2, 2)])
def test_words_and_bytes(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(passages, "HOT_IN_CHUNK", hot[0])
    monkeypatch.setattr(passages, "HOT_ANYWHERE", hot[1])
    assert sorted(map(tuple, substring.repeat_digests(docs).collect()), key=str) == brute_words(rows)
    assert sorted(map(tuple, suffixarray.repeated_byte_digests(docs).collect()), key=str) == brute_bytes(rows)


def test_null_ids_and_empty(spark, empty):
    shared = " ".join(f"x{k}" for k in range(20))
    rows = [(None, shared + " tail"), (4, shared), (4, shared), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.repeat_digests(df).collect()), key=str) == brute_words(rows)
    assert substring.repeat_digests(empty).count() == 0
    assert suffixarray.repeated_byte_digests(empty).count() == 0


def test_kept_text_and_columns(spark):
    shared = " ".join(f"x{k}" for k in range(15))
    df = spark.createDataFrame([(1, f"a\n{shared} b", "k1", 7), (2, f"c  d\n{shared}\ne", None, 8)], "doc_id long, text string, n_words string, kept int")
    out = {r["doc_id"]: r for r in substring.remove_repeats(df, keep=("n_words", "kept")).collect()}
    assert out[1]["kept"] == f"a\n{shared} b" and out[1]["n_words_in"] == "k1" and out[1]["kept_in"] == 7
    assert out[2]["kept"] == "c  d\ne" and out[2]["n_words_in"] is None and out[2]["n_words"] == 18


def test_kept_bytes(spark, empty):
    shared = "".join(f"y{k} " for k in range(90))
    df = spark.createDataFrame([(1, f"é{shared}a", 1), (2, f"b{shared}", 2), (3, None, 3), (None, "z", 4)], "doc_id long, text string, kept int")
    out = {r["kept_in"]: r for r in suffixarray.remove_repeated_bytes(df, keep=("kept",)).collect()}
    assert [bytes(out[k]["kept"]) for k in (1, 2, 3, 4)] == ["éa".encode(), b"b", b"", b"z"]
    assert suffixarray.remove_repeated_bytes(empty).count() == 0


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_equal_hashes_of_unequal_content(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base."""
    word = thue_morse(11)
    other = word.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"x{k}" for k in range(12))
    rows = [(1, f"{lead} {word}"), (2, f"{lead} {other}"), (3, f"{lead} {other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, substring.repeat_digests(df).collect())) == brute_words(rows)
    assert sorted(map(tuple, suffixarray.repeated_byte_digests(df).collect())) == brute_bytes(rows)


@pytest.mark.parametrize("limit", [3000])
def test_across_chunks_and_shards(docs, rows, monkeypatch, limit):
    """Small chunks and shards, so that documents, segments and structures are cut at every limit."""
    monkeypatch.setattr(passages, "CHUNK_BYTES", limit)
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    monkeypatch.setattr(suffixarray, "SHARD_BYTES", 2000)
    monkeypatch.setattr(passages, "COMPARED_UNITS", 500)
    assert sorted(map(tuple, substring.repeat_digests(docs).collect()), key=str) == brute_words(rows)
    assert sorted(map(tuple, suffixarray.repeated_byte_digests(docs).collect()), key=str) == brute_bytes(rows)


def test_windows_of_one_anchor():
    """repeated_windows on texts of few letters, where nearly everything repeats."""
    rng = random.Random(4)
    for _ in range(60):
        base = "".join(rng.choice("ab") for _ in range(rng.randint(60, 160))).encode()
        texts, places, windows = [], [], []
        for _ in range(rng.randint(1, 6)):
            cut = rng.randint(0, 12)
            text = base[cut : len(base) - rng.randint(0, 12)] if rng.random() < 0.7 else bytes(base[cut:20]) + bytes([rng.choice(b"ab")]) + base[21:]
            if len(text) < 41 or 20 < cut:
                continue
            texts.append(text)
            places.append(20 - cut)
            windows.append(min(len(text) - 40, 20 - cut) + 1)
        if not texts:
            continue
        seen = {}
        for t, n in zip(texts, windows):
            for k in range(n):
                seen[t[k : k + 40]] = seen.get(t[k : k + 40], 0) + 1
        aligned = {}
        for t, p, n in zip(texts, places, windows):
            for k in range(n):
                aligned[(p - k, t[k : k + 40])] = aligned.get((p - k, t[k : k + 40]), 0) + 1
        got = suffixarray.repeated_windows(texts, places, windows, 40)
        for t, p, n, g in zip(texts, places, windows, got):
            for k in range(n):
                assert g[k] >= (aligned[(p - k, t[k : k + 40])] > 1) and (not g[k] or seen[t[k : k + 40]] > 1)


def test_reference_broadcast(spark):
    reference = spark.createDataFrame([(" ".join(f"r{k}" for k in range(30)),), (None,)], "text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(f"r{k}" for k in range(5, 20)) + " b"), (2, None), (3, "r1 r2")], "doc_id long, text string")
    assert sorted(map(tuple, substring.remove_reference(docs, reference).collect())) == [(1, 17, 15), (2, 0, 0), (3, 2, 0)]
    with pytest.raises(ValueError):
        substring.remove_reference(docs, reference, max_reference_words=10)


def test_automaton_matching():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        a = substring.SuffixAutomaton()
        for k, t in enumerate(texts):
            a.add(t, k)
        a.finish()
        probe = [rng.randint(0, 2) for _ in range(12)]
        want = []
        for k in range(len(probe) - 2):
            w = probe[k : k + 3]
            want.append(min((d for d, t in enumerate(texts) if any(t[j : j + 3] == w for j in range(len(t)))), default=2**63 - 1))
        assert a.stream(probe, 3) == want


def test_grouping_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffixarray.grouping_suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_chunks_stay_dealt_by_their_number(docs):
    """A join on the chunk number shuffles the other side alone; a saved frame without its partitioning shuffled every text three times more."""
    chunks = passages._chunks(docs.select("doc_id", "text"))
    other = chunks.select("chunk_id").distinct()
    plan = chunks.select("chunk_id", "chunk").join(other.hint("merge"), "chunk_id", "left")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line]
