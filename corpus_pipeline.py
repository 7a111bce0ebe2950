"""From raw documents to packed training sequences: five stages, each one operator of graphmill.llm on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage carries the
other columns of a row along as one struct, so their names can't clash with an operator's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import mixing, packing, quality, simhash, substring
from graphmill.llm.common import checkpoint_dir

#: SQL can't tokenise, learn the rules or find components; tests compare each stage with brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and row: a struct of all columns but those that the stage makes anew, by position."""
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in but]
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*fields).alias("row"))


def _restored(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return rows.select(*[(changed[c] if c in changed else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the learned list reject. Rows without a doc_id are judged by their texts like all others."""
    rules = quality.fit_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge_quality(_carried(docs), rules, keep=("row",))
    return _restored(judged.where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash deletion variants find candidates, exact Jaccard >= 0.8 of five-word shingles decides; of each group the row of the least doc_id stays."""
    return simhash.near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that a document with a smaller id has; n_chars follows the text. No row goes."""
    cut = substring.remove_repeats(_carried(docs, but=("text",)), keep=("row",))  # the text would be shuffled twice
    changed = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return _restored(cut, docs, **changed)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times, whole), in training order."""
    rows = _carried(docs).withColumn("source", F.col(f"row.c{docs.columns.index('source')}")).withColumn("size", mixing.word_count(F.col("text")))
    alike = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    mixed = mixing.mix_sources(alike.select("doc_id", "source", (F.col("size") * F.col("m")).alias("size"), F.col("size").alias("each")), whole=True)
    due = mixed.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("each").alias("_size"), "positions")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    return _restored(mixing.in_training_order(rows.select("doc_id", "source", "size", "row").join(due, same)), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents packed into sequences of 2048 tokens; each copy of a document is packed."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_to_weights", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    checkpoint_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if k:  # nothing reads the stage before again
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{k - 1}-{STAGES[k - 1][0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs = spark.read.parquet(out)
    return docs
