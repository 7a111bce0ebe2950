"""The other operators against brute force, and their edge cases."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from graphmill.llm import components, embeddings, mixing, packing, quality, queries, sharding, simhash, toxicity, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(docs, rows, empty):
    out = sharding.hypergeometric_shards(docs.select("doc_id", "text"), 7).collect()
    again = sharding.hypergeometric_shards(docs.select("doc_id", "text"), 7).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = {}
    for r in out:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(rows) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in sizes.values())
    assert sharding.hypergeometric_shards(empty, 7).count() == 0


def test_communication_matrix_is_exact_and_uniform():
    for seed in range(30):
        m = sharding.communication_matrix([5, 0, 17, 100], 6, seed)
        assert m.sum(axis=1).tolist() == [5, 0, 17, 100] and np.ptp(m.sum(axis=0)) <= 1
    mean = np.mean([sharding.communication_matrix([60, 60], 4, s)[0] for s in range(400)], axis=0)
    assert np.abs(mean - 15).max() < 0.6


URLS = [
    "http://example.org/es/1", "https://a.EXAMPLE.org/es/", "http://example.org/en/12?x", "http://badexample.org/es/1", "http://x.org", "http://x.org/", "ftp://a.com/fr/q#z", "http://a.com/de/", "http://com/fr/", None, "", "no scheme",
    "http://foo.net/a.example.org/es/1", "http://example.org?/es/", "http://é.com/fr/ü", "://org/a", "http://a.b.example.org/en/1", "http://org/x", "http://u@h.com:80/fr/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, html string")
    got = queries.urlfilter.judge_urls(pages, queries.URL_RULES).toPandas()
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    want = con.execute(queries.ORACLE_SQL["op3_url_automaton"]).df()
    key = lambda d: sorted(map(tuple, d[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(d.notna(), None).values.tolist()))
    assert key(got) == key(want)
    assert urlfilter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, []).collect()} == {"allow"}


def test_wildcards_over_many_words():
    globs = ["a*c", "a?c", "**z", "x" * 100 + "*", "*/b", ""]
    texts = ["abc", "ac", "a/c", "abbc", "q/z", "x" * 130, "a/b", "a/a/b", ""]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    got = urlfilter.WildcardAutomaton(globs).matches(np.frombuffer(b"".join(raw), np.uint8), off)
    as_regex = [re.compile("".join({"**": ".*", "*": "[^/]*", "?": "."}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g))) for g in globs]
    assert got.tolist() == [[bool(r.fullmatch(t)) for r in as_regex] for t in texts]


def brute_stats(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    marked = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality(spark, docs, rows, empty, sf_dir):
    rules = quality.fit_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = sorted((tuple(r) for r in quality.judge_quality(docs, rules).collect()), key=str)
    assert sorted((g[:6] for g in got), key=str) == sorted(((r[0], *brute_stats(r[1])) for r in rows), key=str)
    for g in got:
        assert g[6] == (g[1] < 20 or 100 * g[5] > 30 * g[1]) and g[7] == (not g[6] and g[8] is None)
    assert quality.judge_quality(empty, rules).count() == 0
    assert quality.fit_quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_decision_list_finds_the_rule(spark):
    made = spark.range(4000).select((F.col("id") % 5 == 0).cast("int").alias("_bad"), (F.col("id") % 3 > 0).alias("_grow"), F.when(F.col("id") % 5 == 0, 0.2 + F.rand(1)).otherwise(F.rand(2) * 0.1).alias("symbol_share"), *[F.rand(k).alias(c) for k, c in enumerate(quality.FEATURES[1:])])
    rules = quality.learn_decision_list(made)
    assert rules and rules[0][0].feature == "symbol_share" and rules[0][0].above
    wrong = made.where(quality.rejected_by(rules).isNotNull().cast("int") != F.col("_bad")).count()
    assert wrong < 40


def brute_fingerprint(text):
    w = [x.encode() for x in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, linked):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[find(i)] for i in range(len(ids))]


def test_simhash(docs, rows, empty):
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()))
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = closure([r[0] for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))
    assert simhash.near_duplicates(empty).count() == 0


def test_large_draws_have_the_law_of_small_ones(monkeypatch):
    """The ratio of uniforms, forced on small populations, against exact probabilities."""
    monkeypatch.setattr(sharding, "NUMPY_BOUND", 0)
    for good, bad, draws in ((30, 50, 20), (4000, 9000, 2500), (3, 10**6, 4000)):
        rng, n = np.random.default_rng(7), 20_000
        got = np.bincount([sharding._hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=draws + 1)
        logs = lambda k: math.lgamma(k + 1)
        choose = lambda a, b: logs(a) - logs(b) - logs(a - b)
        want = np.array([n * math.exp(choose(good, k) + choose(bad, draws - k) - choose(good + bad, draws)) if max(0, draws - bad) <= k <= good else 0.0 for k in range(draws + 1)])
        big = want > 5
        assert ((got - want)[big] ** 2 / want[big]).sum() < big.sum() + 5 * math.sqrt(2 * big.sum()) and got[want == 0].sum() == 0
    assert sharding._log_factorial_step(10**6, 10**6 + 999) == pytest.approx(sum(math.log(10**6 + k) for k in range(1, 1000)), rel=1e-12)


def test_matrix_beyond_a_billion_rows():
    m = sharding.communication_matrix([3 * 10**9, 10**9, 7], 5, 1)
    assert m.sum(axis=1).tolist() == [3 * 10**9, 10**9, 7] and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()


@pytest.mark.parametrize("wide", [2048, 3])
def test_links_of_close_fingerprints(spark, monkeypatch, wide):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = list(base)
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, np.uint64))
    monkeypatch.setattr(simhash, "WIDE_RUN", wide)
    ids = fps.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    got = {r["u"]: r["root"] for r in components.components(simhash.fingerprint_links(df)).collect()}
    want = closure(ids, lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j])) <= 3)
    assert [got.get(i, i) for i in ids] == want


def test_components_of_a_hub(spark):
    edges = spark.range(1, 3000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(5000).alias("u"), F.when(F.col("id") % 2 == 0, 5000).otherwise(F.col("id")).alias("v")).union(spark.range(9000, 9001).selectExpr("id", "id + 1"))
    got = {r["u"]: r["root"] for r in components.components(edges).collect()}
    assert got == {k: 1 for k in (*range(2, 3000), 5000)} | {9001: 9000}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(((F.col("id") * 7919) % 200).alias("u"), (((F.col("id") + 1) * 7919) % 200).alias("v")).where("id < 199")
    assert {r["root"] for r in components.components(edges).collect()} == {0}


def test_toxicity(spark, empty):
    rng = np.random.default_rng(1)
    bad = [f"bad{k}" for k in range(6)]
    texts, toxic = [], []
    for i in range(900):
        w = [f"v{rng.integers(400)}" for _ in range(rng.integers(5, 60))]
        y = int(i % 6 == 0)
        if y:
            w.insert(rng.integers(len(w)), str(rng.choice(bad)).upper() + ",")
        texts.append(" ".join(w))
        toxic.append(y)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(toxic[i]) for i in held)
    assert right >= 0.98 * len(held) and len(got) == 902 and 0 < got[5000] == got[5001] < 0.3
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0))).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((centre + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist())
    rows += [rows[0]] * 3 + [[0.0] * 16, None, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [1.0] * 3, [2.0] * 3]
    labels = [None if k % 17 == 0 else k % 2 for k in range(len(rows))]
    data = [(k, v, l) for k, (v, l) in enumerate(zip(rows, labels))] + [(None, rows[1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 4)
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.link_vectors(df, recall=0.9999999).collect()}

    def linked(i, j):
        a, b = rows[i], rows[j]
        if labels[i] is None or labels[i] != labels[j] or not a or not b or len(a) != len(b) or None in a or None in b:
            return False
        a, b = np.array(a, float), np.array(b, float)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return bool(np.isfinite(n) and n > 0 and a @ b / n >= 0.93)

    ids = list(range(len(rows)))
    comp = closure(ids, linked)
    for i in ids:
        assert got[i] == (sum(linked(i, j) for j in ids if j != i), comp[i], comp[i] == i), i
    assert got[None] == (0, None, None)
    assert embeddings.link_vectors(df.limit(0)).count() == 0


def test_embedding_recall_by_default(spark):
    """Planted pairs just above the threshold among unlike vectors, with the default tables."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        a, b = a / np.linalg.norm(a), b - (b @ a) / (a @ a) * a
        b = 0.932 * a + math.sqrt(1 - 0.932**2) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, b.tolist(), 1)]
    got = embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.where("n_links = 1 and component_id = vec_id - vec_id % 2").count() >= 0.98 * 2 * 1500


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        free -= set(over)
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(docs, rows, empty, whole):
    df = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix_sources(df, whole=whole).collect()
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    target = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"]) and (not whole or r["taken"] == r["copies"] * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= (largest / 2 if whole else 0.5) + 1e-6 for s in sizes)
    order = [r["position"] for r in mixing.in_training_order(mixing.mix_sources(df, whole=whole)).collect()]
    assert order == sorted(order)
    assert mixing.mix_sources(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0


def test_schedules_of_sources(spark):
    """All demand of one source falls into the first tenth, of another into the last."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(5).cast("long").alias("size"), F.lit("x").alias("target"))
    early, late = ((0, 1.0), (0.1, 1.0), (0.1001, 0.0), (1, 0.0)), ((0, 0.0), (0.9, 0.0), (0.9001, 1.0), (1, 1.0))
    out = mixing.mix_sources(df, weights=(1.0,), share=1.0, own={"a": early, "b": late})
    assert "target_in" in out.columns
    got = mixing.in_training_order(out).collect()
    assert [r["source"] for r in got] == ["a"] * 2000 + ["b"] * 2000 and max(r["position"] for r in got if r["source"] == "a") <= 0.1001
    for points in (((0, 1), (0.5, 2)), ((0, 0), (1, 0)), ((0, 1), (0.7, -1), (1, 1))):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, schedules=(points,))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b " * 30, "s", "k", 1.5)], "doc_id long, text string, shard string, kept string, n_words double")
    out = sharding.hypergeometric_shards(df, 2).collect()[0]
    assert (out["shard_in"], out["slot"]) == ("s", 0)
    row = quality.judge_quality(df, [], keep=("kept", "n_words", "text")).collect()[0]
    assert (row["kept_in"], row["n_words_in"], row["n_words"], row["text_in"]) == ("k", 1.5, 60, "a b " * 30)
    pieces = spark.createDataFrame([(1, 0, 5, "x", "y")], "doc_id long, piece int, length long, offset string, _rank string")
    assert packing.pack_pieces(pieces, 10).select("doc_id", "offset_in", "_rank_in", "offset", "sequence_id").collect()[0][:4] == (1, "x", "y", 0)


def test_repeated_ids_in_training(spark):
    """A doc_id that very many rows share is one training row."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("bad words here").alias("text")).union(spark.range(2, 400).select("id", F.concat(F.lit("word"), F.col("id") % 7).alias("text")))
    labels = spark.range(1, 400).select(F.col("id").alias("doc_id"), (F.col("id") == 1).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    assert len(toxicity.fit_toxicity(docs, labels)[0]) > 0
    assert quality.fit_quality_rules(docs, labels) == []


def test_mixing_of_empty_texts(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [tuple(r) for r in mixing.mix_sources(df).select("target", "taken", "copies").collect()] == [(0.0, 0, 0)] * 2


def check_packing(pieces, limit):
    at = {}
    for s, o, n in sorted(pieces):
        assert o == at.get(s, 0)
        at[s] = o + n
    assert all(x <= limit for x in at.values())
    return len(at)


def test_packing(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 256)):
            want.append((r[0], k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())))
    got = packing.pack_documents(docs, path, 256).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    used = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 256)
    assert used <= math.ceil(sum(w[3] for w in want) / 256) + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_tokenizer_chunks():
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert tok.direct
    for s in ["A<|endoftext|>B, c. Á. x0, 100% K it's IT'S don't.\xa0nb sp ém É,", "", "0", "a.,b ., x. .y a,\nb", "ΑΣ. ΟΔΟΣ, İstanbul. ß, ǅ", "<|EndOfText|> A. b", "a#b##c \x1c x\x85y 日本語。", "d'a 's'T ]]>^_`{|}~"]:
        assert tok.encode(s.encode()) == np.array(tok.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), s


def test_local_search_empties_bins():
    found = packing.LocalSearch([[6, 2], [5, 3], [4, 4]], 12).run(100)
    assert len(found) == 2 and sorted(x for b in found for x in b) == [2, 3, 4, 4, 5, 6]
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 101, 300)
        values, counts = np.unique(lengths, return_counts=True)
        bins = packing.pack_histogram(dict(zip(values.tolist(), counts.tolist())), 100)
        assert sorted(x for b, n in bins.items() for x in b * n) == sorted(lengths.tolist())
        assert all(sum(b) <= 100 for b in bins) and sum(bins.values()) <= lengths.sum() / 100 * 1.1 + 2


def test_queries(spark, docs, rows, sf_dir):
    """The registered queries themselves, on the made-up documents."""
    got = {n: queries.QUERIES[n](spark, sf_dir).collect() for n in ("op2_hypergeometric_sharding", "op4_quality_list", "op7_toxicity_ftrl", "op9_curriculum_mix")}
    crc = lambda t: zlib.crc32((t or "").encode())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, crc(r[1]), "rows", None) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got["op2_hypergeometric_sharding"]) == want
    per = Counter(r["shard"] for r in got["op2_hypergeometric_sharding"])
    assert set(per) <= set(range(24)) and max(per.values()) - min(per[s] for s in range(24)) <= 1
    assert Counter(tuple(r)[:6] for r in got["op4_quality_list"]) == Counter((r[0], *brute_stats(r[1])) for r in rows)
    for r in got["op7_toxicity_ftrl"]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
    first = [r["positions"][0] for r in got["op9_curriculum_mix"] if r["positions"]]
    assert first == sorted(first) and all(r["positions"] for r in got["op9_curriculum_mix"][: len(first)]) and len(got["op9_curriculum_mix"]) == len(rows)
