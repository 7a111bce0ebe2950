"""The pipeline's stages on made-up documents."""

import corpus_pipeline
from graphmill.llm import mixing, quality
from pyspark.sql import functions as F

from test_llm_operators import WORD, closure
from test_nearcopies import near, shingles


def test_stages(spark, docs, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now, columns = docs.withColumn("row", F.lit("clash")).withColumn("kept", F.lit(1)), None
    columns = now.columns
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns, name
        held.append((now, after))
        now = after
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    rules = quality.fit_quality_rules(docs, labels)
    assert ids(held[0][1]) == ids(quality.judge_quality(docs, rules).where("kept"))
    before = [tuple(r) for r in held[1][0].select("doc_id", "text").collect()]
    sets = [shingles(t) for _, t in before]
    assert ids(held[1][1]) == sorted(set(closure([i for i, _ in before], lambda i, j: near(sets[i], sets[j]))))
    assert held[1][1].where("kept = 1 and row = 'clash'").count() == held[1][1].count()
    assert ids(held[2][1]) == ids(held[2][0])
    size = lambda df: sum(len(WORD.findall(r[0] or "")) for r in df.select("text").collect())
    before, mixed = size(held[3][0]), size(held[3][1])
    assert abs(mixed - 1.5 * before) < 0.2 * before
    assert held[4][1].where("piece = 0").count() == held[3][1].count()


def test_empty(spark, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    assert mixing.mix_sources(empty.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_null_ids_keep_their_texts(spark, docs, sf_dir, tmp_path):
    """Every second row without a doc_id: the same texts go and stay as with one, up to the stages that rank by it."""
    half = docs.dropDuplicates(["doc_id"]).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    stages = dict(corpus_pipeline.STAGES)
    rules = quality.fit_quality_rules(half, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = stages["quality_rules"](spark, half, sf_dir)
    texts = lambda df: sorted((r["text"] for r in df.select("text").collect()), key=str)
    assert texts(kept) == texts(quality.judge_quality(half, rules, keep=("text",)).where("kept").withColumnRenamed("text_in", "text"))
    assert kept.where("doc_id is null").count() > 20
    kept.write.parquet(f"{tmp_path}/kept")
    now = spark.read.parquet(f"{tmp_path}/kept")
    before = [r["text"] for r in now.collect()]
    sets = [shingles(t) for t in before]
    groups = set(closure(range(len(before)), lambda i, j: near(sets[i], sets[j])))
    for name in ("simhash_near_dedup", "substring_dedup", "mix_to_weights", "best_fit_packing"):
        after = stages[name](spark, now, sf_dir)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert after.where("doc_id is null").count() > 0, name
        if name == "simhash_near_dedup":
            assert after.count() == len(groups)
        if name == "substring_dedup":
            assert after.count() == now.count()
        if name == "best_fit_packing":
            assert after.where("piece = 0").count() == now.count()
        now = after


def test_substring_stage_carries_a_text_once(spark, monkeypatch):
    import corpus_pipeline
    from graphmill.llm import substring

    seen, whole = [], substring.remove_repeats
    monkeypatch.setattr(substring, "remove_repeats", lambda docs, **how: seen.append(docs.schema["row"].dataType.names) or whole(docs, **how))
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, source string")
    got = corpus_pipeline.substring_dedup(spark, docs, "")
    assert seen == [["c0", "c2"]] and sorted(map(tuple, got.collect())) == [(1, "a b", "x"), (2, "", "y")]
