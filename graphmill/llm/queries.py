"""The thin registered queries over the training-data operators, their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytebpe, embeddings, mixing, packing, quality, sharding, simhash, substring, suffixarray, toxicity, upsert, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The contract's url rules.
URL_RULES = (
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
)


def op1_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(table(spark, sf_dir, "documents"))


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    out = sharding.hypergeometric_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.fit_quality_rules(docs, table(spark, sf_dir, "labels")))


def op5_suffix_array_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.repeated_byte_digests(table(spark, sf_dir, "documents"))


def op6_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.in_first_order(mixing.mix_sources(docs)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "positions")


def op10_local_search_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_copy_on_write_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    def crc(c: Column) -> Column:
        return F.crc32(c.cast("string").cast("binary"))

    clients, key = table(spark, sf_dir, "clients"), "client_id"
    rows_per_file = 1 + clients.count() // 1000
    folder = upsert.new_folder(spark, "clients")
    files = upsert.write_table(clients.where(crc(F.col(key)) % 7 > 3), folder, key, rows_per_file)
    changes = upsert.latest(table(spark, sf_dir, "client_changes"), key, ["seq", "change_id"])
    stay = upsert.upsert(
        spark, folder, files, changes, key, ["source", "segment", "city", "balance"], rows_per_file,
        ignored=lambda first: crc(first) % 16 > 7,
        deleted=lambda first: (F.col("op") == "D") | (crc(F.col("change_id")) % 8 < crc(first) % 16),
    )
    text = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    numbers = {"cents": F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)), "rows_crc": F.crc32(text.cast("binary"))}
    found = upsert.file_digests(spark, folder, key, numbers, clients.columns, dict(clients.dtypes))
    return found.withColumn("rewritten", ~F.element_at(F.split("path", "/"), -1).isin(stay)).select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten")


def op12_bpe_tree_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.coding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = ((kind, bytebpe.file_bytes(spark, public_tokenizers.path(name))) for kind, name in ((alignment.BytePairs, "byte_bpe_50k.json"), (alignment.SentencePieces, "piece_bpe_32k.model")))
    return alignment.align_documents(table(spark, sf_dir, "documents"), a, b)[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_automata, op2_hypergeometric_sharding, op3_url_automaton, op4_quality_list, op5_suffix_array_grouping, op6_simhash_deletion_variants, op7_toxicity_ftrl, op8_embedding_near_dedup, op9_curriculum_mix, op10_local_search_packing, op11_copy_on_write_upsert, op12_bpe_tree_reduction, op13_token_alignment)}

ORACLE_SQL: dict[str, str] = {
    "op3_url_automaton": r"""
WITH cut AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
canon AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM canon JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT canon.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM canon LEFT JOIN fits ON canon.page_id = fits.page_id AND k = 1
""",
}
