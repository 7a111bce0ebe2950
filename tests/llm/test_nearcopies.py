"""The pipeline's near-duplicate stage against all pairs."""

from fractions import Fraction

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA
from graphmill.llm import simhash
from pyspark.sql import functions as F
from test_llm_operators import closure


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_stage_keeps_one_of_each_component(spark, docs, rows, empty, sf_dir):
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, docs, sf_dir)
    sets = [shingles(r[1]) for r in rows]
    comp = closure([r[0] for r in rows], lambda i, j: near(sets[i], sets[j]))
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(comp))
    assert stage(spark, empty, sf_dir).count() == 0


def test_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(120)]
    near_copy = [*words[:60], "other", *words[61:]]
    texts = [(5, words), (None, near_copy), (5, words[::-1]), (None, ["alone", *words[::2]]), (7, None), (8, [])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), None, None, 0) for i, w in texts], SCHEMA)
    got = {(r["doc_id"], r["text"]) for r in simhash.near_copies(docs).collect()}
    assert got == {(5, " ".join(words)), (5, " ".join(words[::-1])), (None, " ".join(["alone", *words[::2]])), (7, None)}


def test_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(90)) for x in "abc")
    near_a = a.replace("a50 ", "changed ")
    docs = spark.createDataFrame([(1, a, None, None, 0), (1, b, None, None, 0), (2, c, None, None, 0), (3, near_a, None, None, 0)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.near_copies(docs).collect()) == [(1, a), (1, b), (2, c)]


def test_recall_at_the_threshold(spark):
    """Planted pairs just above similarity 0.8, and pairs below it."""
    rng = np.random.default_rng(3)
    rows, linked = [], set()
    for k in range(400):
        w = [f"v{x}" for x in rng.integers(0, 50_000, 200)]
        other = list(w)
        at = int(rng.integers(0, 150))
        n = 17 if k % 2 else 40
        other[at : at + n] = [f"u{x}" for x in rng.integers(0, 50_000, n)]
        if near(shingles(" ".join(w)), shingles(" ".join(other))):
            linked.add(2 * k + 1)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    assert len(linked) == 200
    got = {r["doc_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {i for i, _ in rows} - linked
    assert len(linked - got) >= 0.93 * len(linked)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """More texts than the window share every variant; one group, and another beside it."""
    monkeypatch.setattr(simhash, "WINDOW", 4)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(300):
        w = [*words] if k % 2 else words[::-1]
        w[k] = f"x{k}"
        rows.append((k, " ".join(w)))
    got = sorted(r["doc_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert got == [0, 1]


@pytest.mark.parametrize(("window", "block"), [(2, 20), (16, 4096)])
def test_wide_variants_lose_no_link(spark, monkeypatch, window, block):
    """Overlapping families about the threshold in shared variants: the components of all candidates that are near, not of a window's."""
    monkeypatch.setattr(simhash, "WINDOW", window)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base, rows = [f"w{k}" for k in range(260)], []
    for k in range(60):
        w = list(base)
        for at in rng.choice(260, int(rng.integers(1, 9)), replace=False):
            w[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    length, segments = simhash.segment_shape(len(rows), 0.8, 0.95)
    sketches = simhash._sketches(frame, 5, length, segments).orderBy("doc_id").collect()
    sets, most = [shingles(t) for _, t in rows], simhash._most_apart(0.8)

    def linked(i, j):
        x, y = sketches[i], sketches[j]
        meet = any((p ^ q).bit_count() <= 1 for p, q in zip(x.segments, y.segments))
        return meet and sum(((p ^ q) % 2**64).bit_count() for p, q in ((x.a, y.a), (x.b, y.b))) <= most and near(sets[i], sets[j])

    want = sorted(set(closure([i for i, _ in rows], linked)))
    assert 1 < len(want) < 60
    assert sorted(r["doc_id"] for r in simhash.near_copies(frame).collect()) == want


def test_wide_variants_across_batches(monkeypatch):
    monkeypatch.setattr(simhash, "WINDOW", 3)
    monkeypatch.setattr(simhash, "BLOCK", 6)
    rng = np.random.default_rng(1)
    key = np.sort(rng.choice([1, 2, 3, 4, 5, 1 << 16 | 7, 1 << 16 | 8], 60, p=[0.5, 0.05, 0.2, 0.05, 0.1, 0.05, 0.05]))
    cls = np.arange(60)
    for size in (1, 4, 7, 60):
        wide = simhash.WideVariants(16)
        batches = [pa.RecordBatch.from_arrays([pa.array(key[s : s + size] * 2 + cls[s : s + size] % 2), pa.array(cls[s : s + size])], names=["variant", "cls"]) for s in range(0, 60, size)]
        assert len(list(wide.watch(iter(batches)))) == len(batches)
        got = wide.taken()
        assert len({g[:2] for g in got}) == len(got) and all(len(g[2]) <= 6 for g in got)
        assert {k: sorted(c for g in got if g[0] == k for c in g[2].tolist()) for k in {g[0] for g in got}} == {int(k): cls[key == k].tolist() for k in np.unique(key) if (key == k).sum() > 4}


def test_window_pairs_across_batches(monkeypatch):
    monkeypatch.setattr(simhash, "WINDOW", 5)
    rng = np.random.default_rng(0)
    key = np.sort(rng.integers(0, 60, 400))
    cls, a, b = np.arange(400), rng.integers(0, 4, 400) + np.iinfo(np.int64).min, rng.integers(-(2**62), 2**62, 400) & ~0xFFFFFFFFFFFFFF8
    batches = [pa.RecordBatch.from_arrays([pa.array(x[s : s + 7].astype(np.int64)) for x in (key * 2 + np.arange(400) % 2, cls, a, b)], names=["variant", "cls", "a", "b"]) for s in range(0, 400, 7)]
    got = sorted((u, v, d) for us, vs, ds in simhash.window_pairs(iter(batches), 2, 16) for u, v, d in zip(us.tolist(), vs.tolist(), ds.tolist()))
    bits = lambda i, j: sum(((int(x[i]) ^ int(x[j])) % 2**64).bit_count() for x in (a, b))
    want = sorted((i, j, bits(i, j)) for i in range(400) for j in range(i + 1, min(400, i + 6)) if key[i] == key[j] and bits(i, j) <= 2 and (j - i <= 1 or j - int(np.searchsorted(key, key[j])) <= 5))
    assert got == want
    # under a wildcard that isn't the first, only rows that differ below it
    other = [pa.RecordBatch.from_arrays([pa.array(np.array([(5 << 16 | 9) * 2 + x for x in (0, 0, 1)])), *[pa.array(np.arange(3))] * 3], names=["variant", "cls", "a", "b"])]
    assert [(u.tolist(), v.tolist()) for u, v, _ in simhash.window_pairs(iter(other), 64, 16)] == [([1], [2]), ([0], [2])]


def test_names_that_clash_and_equal_hashes(spark, monkeypatch):
    """Columns called as the operator's own come back as they were; unequal words with equal first 64 bits stay apart."""
    import xxhash

    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abc"]
    rows = [(1, texts[0], "m1", 5, "r"), (2, texts[0], "m2", 6, "r"), (3, texts[1], "m3", 7, "r"), (4, texts[2], None, 8, "r"), (4, texts[2], None, 8, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, cls int, row string")
    got = sorted(map(tuple, simhash.near_copies(docs).collect()))
    assert got == [rows[0], rows[2], rows[3]] and simhash.near_copies(docs).columns == docs.columns
    plain = simhash._sketches(docs, 5, 16, 8).select("doc_id", "cls", "more").collect()
    assert len({r["cls"] for r in plain}) == 3 and len({r["more"] for r in plain}) == 3
    own = simhash._sketches
    monkeypatch.setattr(simhash, "_sketches", lambda *a: own(*a).withColumn("cls", F.lit(7).cast("long")))
    assert sorted(map(tuple, simhash.near_copies(docs).collect())) == got
    assert xxhash.xxh3_128_digest(b"a") != xxhash.xxh3_128_digest(b"b")


@pytest.mark.parametrize("home", [40, 512])
def test_a_group_just_below_the_threshold_gives_no_pairs(spark, monkeypatch, home):
    """160 texts that share most variants, few of which are near: all pairs are decided, but neither pairs nor edges are made as the square of them."""
    monkeypatch.setattr(simhash, "HOME", home)
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(160):
        w = list(base)
        for at in rng.choice(40, int(rng.integers(2, 5)), replace=False):
            w[5 * at + 2] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, most = [shingles(t) for _, t in rows], simhash._most_apart(0.8)
    length, segments = simhash.segment_shape(len(rows), 0.8, 0.95)
    sketches = simhash._sketches(frame, 5, length, segments).orderBy("doc_id").collect()

    def linked(i, j):
        x, y = sketches[i], sketches[j]
        meet = any((p ^ q).bit_count() <= 1 for p, q in zip(x.segments, y.segments))
        return meet and sum(((p ^ q) % 2**64).bit_count() for p, q in ((x.a, y.a), (x.b, y.b))) <= most and near(sets[i], sets[j])

    want = sorted(set(closure([i for i, _ in rows], linked)))
    made = {"pairs": 0, "edges": 0}
    own, merged = simhash._verified, simhash._merged
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: made.update(pairs=made["pairs"] + pairs.count()) or own(pairs, *a))
    rest = simhash._rest
    monkeypatch.setattr(simhash, "_rest", lambda *a: made.update(pairs=0) or rest(*a))  # the window's pairs are bounded a text
    monkeypatch.setattr(simhash, "_merged", lambda roots, links: made.update(edges=made["edges"] + links.count()) or merged(roots, links))
    got = sorted(r["doc_id"] for r in simhash.near_copies(frame).collect())
    assert got == want and len(want) > 10
    assert made["pairs"] < 160 and made["edges"] < 160 * 10


def test_links_between_homes_are_all_near_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(20, 60)))).astype(np.uint64) for _ in range(60)]
    bits = rng.integers(0, 2, (60, 2), dtype=np.int64)
    least = Fraction(1, 2)

    def home(at):
        return simhash.Home({"root": np.array(at), "a": bits[at, 0], "b": bits[at, 1], "segments": np.zeros(len(at) * 3, np.int64), "sizes": np.array([len(sets[k]) for k in at]), "grams": np.concatenate([sets[k] for k in at])})

    x, y = home(list(range(25))), home(list(range(25, 60)))
    for p, q in ((x, x), (y, y), (x, y)):
        ok = lambda i, j: len(np.intersect1d(sets[i], sets[j])) * 3 >= len(sets[i]) + len(sets[j]) and int((bits[i] != bits[j]).sum()) <= 1
        here = sorted({*p.root.tolist(), *q.root.tolist()})
        edges = simhash.links_between(p, q, 1, least)
        assert len(edges) < len(here) and all(ok(i, j) for i, j in edges)
        across = lambda i, j: p is q or (i < 25) != (j < 25)
        assert closure(here, lambda i, j: (here[i], here[j]) in set(edges) or (here[j], here[i]) in set(edges)) == closure(here, lambda i, j: across(here[i], here[j]) and ok(here[i], here[j]))


def test_wide_variants_give_no_row_a_text_and_variant(spark, monkeypatch):
    """A large group of near copies and some texts beside it in the same variants: what the second pass keeps is a few rows a text, not one for each of its variants."""
    monkeypatch.setattr(simhash, "WINDOW", 4)
    rng = np.random.default_rng(4)
    base, rows = [f"w{k}" for k in range(300)], []
    for k in range(240):
        w = list(base)
        for at in range(150, 150 + 60 * (k % 20 == 0), 6):  # every 20th shares less than 0.8 with the others
            w[at] = f"y{k}.{at}"
        w[int(rng.integers(0, 140))] = f"x{k}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own, rest, counts = simhash.saved, simhash._rest, []

    def counted(*a):
        with monkeypatch.context() as m:
            m.setattr(simhash, "saved", lambda df: counts.append((kept := own(df)).count()) or kept)
            return rest(*a)

    monkeypatch.setattr(simhash, "_rest", counted)
    got = {r["doc_id"] for r in simhash.near_copies(frame).collect()}
    assert got == {1, *range(0, 240, 20)}
    assert counts and max(counts) <= 5 * len(rows)


def test_probes_go_to_all_parts_in_several_rounds(spark, monkeypatch):
    """Little is linked by the window: whatever the parts and rounds, it finds the components of all near pairs."""
    rng = np.random.default_rng(11)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(80):
        w = list(base)
        for at in rng.choice(40, int(rng.integers(2, 5)), replace=False):
            w[5 * at + 2] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    length, segments = simhash.segment_shape(len(rows), 0.8, 0.95)
    sketches = simhash._sketches(frame, 5, length, segments).orderBy("doc_id").collect()

    def linked(i, j):
        x, y = sketches[i], sketches[j]
        meet = any((p ^ q).bit_count() <= 1 for p, q in zip(x.segments, y.segments))
        return meet and sum(((p ^ q) % 2**64).bit_count() for p, q in ((x.a, y.a), (x.b, y.b))) <= simhash._most_apart(0.8) and near(sets[i], sets[j])

    want = sorted(set(closure([i for i, _ in rows], linked)))
    assert 1 < len(want) < 80
    for name, value in (("WINDOW", 1), ("PART_LEAST", 4), ("PART_BYTES", 9000), ("COPIED_BYTES", 1), ("HOME", 3)):
        monkeypatch.setattr(simhash, name, value)
    rounds, parted = [], simhash._linked_parts
    monkeypatch.setattr(simhash, "_linked_parts", lambda *a: rounds.append(1) or parted(*a))
    assert sorted(r["doc_id"] for r in simhash.near_copies(frame).collect()) == want
    assert len(rounds) > 1


def test_later_rows_of_other_wildcards_are_left_to_the_second_pass(monkeypatch):
    monkeypatch.setattr(simhash, "WINDOW", 3)
    n = 50
    for wildcard, pairs in ((0, 6 + n - 4), (9, None)):
        numbers = np.full(n, (wildcard << 16) * 2) + np.arange(n) % 2
        wide = simhash.WideVariants(16)
        batch = pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.arange(n)), *[pa.array(np.zeros(n, np.int64))] * 2], names=["variant", "cls", "a", "b"])
        got = [p for u, v, _ in simhash.window_pairs(wide.watch(iter([batch])), 2, 16) for p in zip(u.tolist(), v.tolist())]
        assert len(got) == pairs if wildcard == 0 else max(v for _, v in got) == 3
        assert sorted(c for g in wide.taken() for c in g[2].tolist()) == list(range(n))
