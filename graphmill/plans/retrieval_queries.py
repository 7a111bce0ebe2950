"""Registered queries: vector and keyword search, fusion, query routing, text predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, strings
from ..operators import retrieval as R
from . import projection as P


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cosine to the one of vec_id 0, which is read first (one row)."""
    e = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    query = e.where("id = 0").select("embedding").first()
    return R.vector_scores(e, list(query[0]) if query else [])


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_scored(spark, sf_dir), 10).select("id", "score")


def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_scored(spark, sf_dir), 5, before=F.col("label") == 3).select("id", "score")


def cosine_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_scored(spark, sf_dir), 100, after=(F.col("label") == 3) & (F.col("score") >= 0.1)).select("id", "score")


def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score >= 0.2").select("id", "score")


def cosine_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relaxed(_scored(spark, sf_dir).where("id <> 0").select("id", "score"), 0.99, 0.25)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    a = p.select(F.lit("vector").alias("list"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("raw")).orderBy(F.desc("raw"), "id").limit(50)
    b = p.select(F.lit("graph").alias("list"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("raw")).orderBy(F.desc("raw"), "id").limit(80)
    return a.union(b)


def rrf_two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_lists(spark, sf_dir))


def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = scores.intent_weight(F.when(F.col("list") == "vector", 3.0).otherwise(0.8), F.lit(1.0))
    return R.capped(R.fuse(_lists(spark, sf_dir), weight), 0.01)


def rrf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lists(spark, sf_dir).select(F.col("list").alias("token"), F.when(F.col("list") == "graph", "code").otherwise("description").alias("kind"), "id", "raw")
    return R.fuse_tokens(hits)


def callee_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    nodes = P.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S:"), "s_suppkey").alias("id"))
    return R.propagate(c, P.call_sites(spark, sf_dir), nodes)


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.methods(spark, sf_dir)
    entries = m.select(F.col("node").alias("src"), F.concat_ws("/", "service", "module").alias("dst"))
    statements = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("C:"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"))
    out = R.enriched(m.select(F.col("node").alias("id")), P.call_sites(spark, sf_dir), 3, entries, statements)
    return out.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("callers", "callees", "entries", "sql_ids")])


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return R.reranked(s, P.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")))


def keyword_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    covered = P.table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return R.keyword_supplement(p, covered, ["the", "PROMO", "x", "LARGE", "PROMO"], "p_type", stop_words=("the",))


def annotation_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    return R.with_bonus(p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score")), p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id")))


def dual_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.when(F.col("p_size") % 3 == 0, "GENERAL").otherwise("CODE").alias("intent"), (F.col("p_size") / 50.0).alias("confidence"))
    return R.dual_channel(q.select("query", "intent", F.round("confidence", 6).alias("confidence")))


def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_type").alias("text"), F.col("p_size").alias("uses"))
    return R.similar_cases(c, "Brand#11", ["PROMO", "LARGE"])


def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, q): queries of every kind, made of each part's own words."""
    name, kind, brand = F.regexp_replace("p_name", " ", "_"), F.initcap("p_type"), F.regexp_replace("p_brand", "#", "")
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    forms = (
        F.concat(F.lit("get"), camel), F.concat(camel, F.lit("Service")), F.concat(F.lit("com.acme."), F.lower("p_type"), F.lit("."), camel, F.lit(".load")), F.concat(F.lit("com.acme."), F.lower("p_type"), F.lit("."), camel),
        F.concat(F.lit("select "), name, F.lit(" from "), F.lower("p_type")), F.concat(F.lit("GET /api/"), name), F.concat(F.lit("if (x == "), F.col("p_size"), F.lit(") { return "), name, F.lit("; }")), F.concat(F.lit("@"), kind, F.lit("(value)")),
        F.concat(kind, F.lit("Exception")), F.concat(F.lit("how to find the "), F.col("p_name")), F.concat(F.lit("/v1/"), brand), F.concat(brand, F.lit("."), F.lower("p_type")), F.concat(name, F.lit(" "), kind),
    )
    q = F.element_at(F.array(*forms), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return P.table(spark, sf_dir, "part").select("p_partkey", q.alias("q"))


def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_strings(spark, sf_dir).select("p_partkey", strings.query_type(F.col("q")).alias("kind"))


def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").where(strings.contains_any(F.col("text"), ["trash", "Apache License"])).select("doc_id")


def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "part").where(F.col("p_type").startswith("PROMO")).select("p_partkey")


def suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "part").where(F.col("p_name").endswith("ring")).select("p_partkey")


def like_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name fits the pattern stored for their nation, in which a backslash escapes."""
    n = P.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Cust_mer#%"), F.col("n_nationkey") % 10).alias("pattern"))
    c = P.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.where(F.expr("c_name LIKE pattern")).select("c_custkey", "pattern")


def group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped lists with the total, one page."""
    n = P.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string"))).alias("ids"))
    return n.join(F.broadcast(n.agg(F.count("*").alias("total")))).orderBy("s_nationkey").offset(2).limit(10)  # one row


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_topk_filtered, cosine_post_filter, cosine_threshold, cosine_relaxed, rrf_two_lists, rrf_weighted, rrf_tokens, callee_propagation, enrichment, rerank, keyword_supplement, annotation_bonus, dual_channel, similar_cases, query_type, keyword_any, prefix, suffix, like_pattern, group_page)}

_S = "s AS (SELECT e.vec_id AS id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
SQL_QUERY_STRINGS = """pw AS (SELECT p_partkey, p_size, p_name, lower(p_type) AS t, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind, replace(p_name, ' ', '_') AS name, replace(p_brand, '#', '') AS brand,
  upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS camel FROM part),
qs AS (SELECT p_partkey, list_extract(['get' || camel, camel || 'Service', 'com.acme.' || t || '.' || camel || '.load', 'com.acme.' || t || '.' || camel, 'select ' || name || ' from ' || t, 'GET /api/' || name, 'if (x == ' || p_size || ') { return ' || name || '; }', '@' || kind || '(value)',
  kind || 'Exception', 'how to find the ' || p_name, '/v1/' || brand, brand || '.' || t, name || ' ' || kind], (p_partkey % 13 + 1)::INT) AS q FROM pw)"""
_L = "a AS (SELECT 'vector' AS list, p_partkey AS id, p_retailprice AS raw FROM part ORDER BY raw DESC, id LIMIT 50), b AS (SELECT 'graph' AS list, p_partkey AS id, p_size::DOUBLE AS raw FROM part ORDER BY raw DESC, id LIMIT 80), l AS (SELECT * FROM a UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY raw DESC, id) AS k FROM l)"
ORACLE_SQL = {
    "cosine_topk": f"WITH {_S} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10",
    "cosine_topk_filtered": f"WITH {_S} SELECT id, score FROM s WHERE label = 3 ORDER BY score DESC, id LIMIT 5",
    "cosine_post_filter": f"WITH {_S} SELECT id, score FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 100) WHERE label = 3 AND score >= 0.1",
    "cosine_threshold": f"WITH {_S} SELECT id, score FROM s WHERE score >= 0.2",
    "cosine_relaxed": f"WITH {_S}, t AS (SELECT id, score FROM s WHERE id <> 0) SELECT id, score FROM t WHERE score >= CASE WHEN (SELECT max(score) FROM t) >= 0.99 THEN 0.99 ELSE 0.25 END",
    "rrf_two_lists": f"WITH {_L} SELECT id, round(sum(1.0::DOUBLE / (60 + k)), 6) AS score FROM r GROUP BY id",
    "rrf_weighted": f"WITH {_L} SELECT id, least(round(sum((CASE WHEN list = 'vector' THEN 1.0 + 0.5 * ln(3.0) ELSE 1.0 END)::DOUBLE / (60 + k)), 6), 0.02) AS score FROM r GROUP BY id",
    "rrf_tokens": f"WITH {_L}, w AS (SELECT id, row_number() OVER (ORDER BY raw * CASE WHEN list = 'vector' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END DESC, id, list) AS n, count(*) OVER (PARTITION BY id) AS h FROM l) SELECT id, round(sum(sqrt(h) / (60 + n)), 6) AS score FROM w GROUP BY id",
    "callee_propagation": f"""WITH {P.SQL_CALLS}, c AS (SELECT 'C:' || c_custkey AS id, c_acctbal AS score FROM customer), best AS (SELECT * FROM c ORDER BY score DESC, id LIMIT 20),
x AS (SELECT DISTINCT best.id AS o, dst AS id, score * 0.3::DOUBLE AS score FROM best JOIN calls ON src = best.id WHERE dst IN (SELECT 'S:' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)) SELECT id, round(sum(score), 6) AS score FROM (SELECT id, score FROM c UNION ALL SELECT id, score FROM x) GROUP BY id""",
    "enrichment": f"""WITH {P.SQL_CALLS}, {P.SQL_METHODS}, e AS (SELECT DISTINCT src, dst FROM calls), a AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM e), b AS (SELECT dst, src, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e),
x AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS callers FROM a WHERE k <= 3 GROUP BY 1), y AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS callees FROM b WHERE k <= 3 GROUP BY 1),
z AS (SELECT id, string_agg(p, ',' ORDER BY p) AS sql_ids FROM (SELECT 'C:' || o_custkey AS id, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) WHERE k <= 3 GROUP BY 1)
SELECT node AS id, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees, service || '/' || module AS entries, coalesce(sql_ids, '') AS sql_ids FROM methods LEFT JOIN x ON x.id = node LEFT JOIN y ON y.id = node LEFT JOIN z ON z.id = node""",
    "rerank": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 0.0 END AS score, s_suppkey % 3 <> 0 AS missing FROM supplier",
    "keyword_supplement": "SELECT p_partkey AS id, 0.1::DOUBLE AS score FROM part WHERE p_size > 25 AND (contains(p_type, 'PROMO') OR contains(p_type, 'LARGE'))",
    "annotation_bonus": "SELECT p_partkey AS id, p_size + CASE WHEN p_partkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END AS score FROM part",
    "dual_channel": "WITH q AS (SELECT p_partkey AS query, CASE WHEN p_size % 3 = 0 THEN 'GENERAL' ELSE 'CODE' END AS intent, round(p_size / 50.0::DOUBLE, 6) AS confidence FROM part) SELECT * FROM q UNION ALL SELECT query, 'GENERAL', confidence FROM q WHERE confidence < 0.7 AND intent <> 'GENERAL'",
    "similar_cases": "SELECT id, priority, uses FROM (SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#11' THEN 0 WHEN contains(p_type, 'PROMO') OR contains(p_type, 'LARGE') THEN 1 END AS priority, p_size AS uses FROM part) WHERE priority IS NOT NULL",
    "query_type": f"""WITH {{SQL_QUERY_STRINGS}}, s AS (SELECT p_partkey, [
  CASE WHEN regexp_matches(q, '[一-鿿]') THEN 8 ELSE 0 END + CASE WHEN len(string_split_regex(trim(q), '\\s+')) >= 3 THEN 8 ELSE 0 END,
  CASE WHEN regexp_full_match(q, '[A-Z][a-zA-Z0-9]*\\.[a-z][a-zA-Z0-9]*') THEN 12 WHEN regexp_full_match(q, '[a-z][a-zA-Z0-9]*') THEN 10 WHEN regexp_full_match(q, '(?i)(?:select|insert|update|delete|get|find|save|query|count|exists)[A-Z].*') THEN 10 ELSE 0 END,
  CASE WHEN regexp_full_match(q, '[a-z][a-z0-9]*(\\.[a-z][a-z0-9]*){{2,}}\\.[A-Z][a-zA-Z0-9]*\\.[a-z][a-zA-Z0-9]*') THEN 20 WHEN regexp_full_match(q, '[a-z][a-z0-9]*(\\.[a-z][a-z0-9]*)+\\.[A-Z][a-zA-Z0-9]*\\.[a-z][a-zA-Z0-9]*') THEN 12 WHEN regexp_full_match(q, '[a-z_][a-zA-Z0-9_]*(\\.[a-zA-Z_][a-zA-Z0-9_]*){{2,}}') THEN 18 ELSE 0 END,
  CASE WHEN regexp_full_match(q, '[a-z][a-z0-9]*(\\.[a-z][a-z0-9]*){{2,}}\\.[A-Z][a-zA-Z0-9]*') THEN 22 WHEN regexp_full_match(q, '[a-z][a-z0-9]*(\\.[a-z][a-z0-9]*)+\\.[A-Z][a-zA-Z0-9]*') THEN 13 ELSE 0 END,
  CASE WHEN regexp_full_match(q, '[A-Z][a-zA-Z0-9]*') THEN 12 - CASE WHEN regexp_matches(q, '(Exception|Error|Fault|Failure)$') THEN 5 ELSE 0 END ELSE 0 END,
  CASE WHEN regexp_full_match(q, '(?i)(?:SELECT|INSERT|UPDATE|DELETE|WITH|MERGE)\\s+.*') THEN 15 ELSE 0 END,
  CASE WHEN regexp_full_match(q, '(?i)(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\\s+/.*') THEN 20 WHEN regexp_full_match(q, '/\\S+') THEN 10 ELSE 0 END,
  CASE WHEN c >= 4 THEN c ELSE 0 END,
  CASE WHEN regexp_full_match(q, '@[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*(\\(.*\\))?') THEN 20 ELSE 0 END,
  CASE WHEN regexp_full_match(q, '[A-Z][a-zA-Z0-9]*(Exception|Error|Fault|Failure)') THEN 15 ELSE 0 END] AS v FROM (SELECT *,
    CASE WHEN contains(q, '(') OR contains(q, ')') THEN 3 ELSE 0 END + CASE WHEN contains(q, '{{{{') OR contains(q, '}}}}') THEN 2 ELSE 0 END + CASE WHEN contains(q, ';') THEN 2 ELSE 0 END + CASE WHEN list_has_any(string_split_regex(q, '[\\s(){{{{}}}};.,<>=+\\-*/&|!\\[\\]]+'), {list(strings.CODE_KEYWORDS)}) THEN 3 ELSE 0 END
    + CASE WHEN contains(q, '->') THEN 2 ELSE 0 END + CASE WHEN contains(q, '=') AND NOT contains(q, '==') THEN 1 ELSE 0 END + CASE WHEN contains(q, '.') THEN 1 ELSE 0 END AS c FROM qs))
SELECT p_partkey, CASE WHEN list_max(v) < 4 THEN 'NATURAL_LANGUAGE' ELSE list_extract(['NATURAL_LANGUAGE', 'METHOD_NAME', 'FULL_QUALIFIED_NAME', 'FULL_QUALIFIED_CLASS_NAME', 'CLASS_NAME', 'SQL_SNIPPET', 'HTTP_URI', 'CODE_SNIPPET', 'ANNOTATION', 'EXCEPTION_TYPE'], list_position(v, list_max(v))) END AS kind FROM s""".replace("{{SQL_QUERY_STRINGS}}", "{SQL_QUERY_STRINGS}").replace("{SQL_QUERY_STRINGS}", SQL_QUERY_STRINGS).replace("{{", "{").replace("}}", "}"),
    "keyword_any": "SELECT doc_id FROM documents WHERE contains(text, 'trash') OR contains(text, 'Apache License')",
    "prefix": "SELECT p_partkey FROM part WHERE starts_with(p_type, 'PROMO')",
    "suffix": "SELECT p_partkey FROM part WHERE ends_with(p_name, 'ring')",
    "like_pattern": "SELECT c_custkey, 'Cust_mer#%' || (c_nationkey % 10) AS pattern FROM customer WHERE starts_with(c_name, 'Customer#') AND ends_with(c_name, (c_nationkey % 10)::VARCHAR)",
    "group_page": "SELECT s_nationkey, count(*) AS n, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS ids, count(*) OVER () AS total FROM supplier GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 2",
}
