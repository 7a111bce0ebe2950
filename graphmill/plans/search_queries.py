"""Registered queries: the search path over the parts as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from . import projection as P
from .retrieval_queries import SQL_QUERY_STRINGS, query_strings


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_strings(spark, sf_dir).select(F.col("p_partkey").alias("query_id"), F.col("q").alias("query"))


def token_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.routed_tokens(_queries(spark, sf_dir))


def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of_language(P.part_methods(spark, sf_dir), "JAVA").select("node", "language")


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keyword_filter(P.part_methods(spark, sf_dir), ["promo", "small", "large"], "find", "Brand#7", ["Stock", ""], "java").select("node", "method_name", "service")


def required_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.required_words(P.part_methods(spark, sf_dir), ["ROMO small", "saveItem com.shop.large"]).select("node")


def exception_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_exception(P.part_methods(spark, sf_dir), "LARGEErr", ("thrown",)).select("node")


def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_annotation(P.part_methods(spark, sf_dir), "Cacheable", ("comment",)).select("node")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = P.table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("node"))
    return S.by_node_ids(P.part_methods(spark, sf_dir), ids).select("node", "class_name")


def inner_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.part_methods(spark, sf_dir).withColumn("class_name", F.concat("class_name", F.when(F.col("node") % 3 == 0, F.concat(F.lit("$In"), F.col("node") % 5)).when(F.col("node") % 3 == 1, "Other").otherwise("")))
    return S.of_class(m, "com.shop.promo.RedWidget").select("node", "class_name")


def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = lambda k: F.element_at(F.split("p_name", " "), k)
    p = P.table(spark, sf_dir, "part").select(F.concat_ws("/", F.lit("/repo"), F.when(F.col("p_size") > 5, segment(1)), F.when(F.col("p_size") > 30, segment(2))).alias("project_path"))
    return S.nearest_paths(p, "/repo/red")


def file_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path holds a language tag's path or is held by it."""
    from ..functions.strings import mutual_substring

    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    return P.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(mutual_substring(F.col("path"), F.lit("/fr/8")) & (F.col("path") != "")).select("page_id")


def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dispatched(_queries(spark, sf_dir)).select("query_id", "kind", "channel", "sought")


def _own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that name methods, by every exact form in turn."""
    m = P.part_methods(spark, sf_dir)
    simple = F.element_at(F.split("class_name", r"\."), -1)
    forms = (F.concat_ws(".", "class_name", "method_name"), F.col("class_name"), simple, F.concat_ws(".", simple, "method_name"), F.concat(F.lit("GET /"), F.lower("service"), F.lit("/")), F.lit("@Cacheable(1)"), F.lit("IOException"))
    return m.where("service = 'Brand#3'").select(F.col("node").alias("query_id"), F.element_at(F.array(*forms), (F.col("node") % len(forms) + 1).cast("int")).alias("query"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.part_methods(spark, sf_dir).where("language = 'Java'").select("node", F.concat(F.lit("/"), F.col("service")).alias("path"))


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact_hits(S.dispatched(_own_words(spark, sf_dir)), P.part_methods(spark, sf_dir), _entries(spark, sf_dir))


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.user_edges(spark, sf_dir)
    return S.expanded(e, e.where("src < 4").select(F.col("src").alias("seed")).distinct(), 1)


def exact_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.part_edges(spark, sf_dir)
    hits = P.table(spark, sf_dir, "part").where("p_brand = 'Brand#9'").select((F.col("p_partkey") % 20).alias("query_id"), F.col("p_partkey").alias("node"))
    kinds = hits.select("query_id").distinct().withColumn("kind", F.when(F.col("query_id") % 2 == 0, "HTTP_URI").otherwise("METHOD_NAME"))
    return S.unless_exact(hits, kinds, e, 1)


def union_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    lists = [p.where(t).select(F.col("p_partkey").alias("id"), F.lit(n).alias("origin"), "p_size") for t, n in (("p_size > 30", "big"), ("p_type = 'PROMO'", "promo"), ("p_retailprice < 1000", "cheap"))]
    return S.first_of(lists)


def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return S.in_all([p.where(t).select("id") for t in ("p_size > 20", "p_type <> 'PROMO'", "p_brand > 'Brand#15'")])


def _vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    query = e.where("id = 0").select("embedding").first()
    return e, list(query[0]) if query else []


def class_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, query = _vector(spark, sf_dir)
    return S.class_search(e.where("label <> 3"), query, 25).select("id", "score")


def similar_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, query = _vector(spark, sf_dir)
    return S.similar_logs(e, query, 0.2, 40).select("id", "score")


def batched_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    lists = p.select(F.col("p_brand").alias("query_id"), F.lit("price").alias("list"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("raw")).union(p.where("p_size > 25").select("p_brand", F.lit("size"), "p_partkey", F.col("p_size").cast("double")))
    return S.batched_search(lists, F.when(F.col("list") == "price", 0.01).otherwise(0.02), 0.02, 5)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method name, without exact hits' short circuit, expanded over the part graph."""
    return S.hybrid_search(P.part_methods(spark, sf_dir), _entries(spark, sf_dir), P.part_edges(spark, sf_dir), "RedWidget.findAll", projects=["promo"], language="java", depth=1, k=50)


def _vectors(spark: SparkSession, sf_dir: str):
    """Methods with two vectors each, and a stand-in for the embedding model: a text's vector is that of the row numbered by its length."""
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = P.part_methods(spark, sf_dir).join(e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("description_vector")), "node")
    m = m.join(e.select((F.col("vec_id") - 1).alias("node"), F.col("embedding").alias("code_vector")), "node")
    return m, lambda text: e.where(F.col("vec_id") == len(text)).head()["embedding"]


#: A question whose tokens are of both routes.
QUESTION = "show how findAll and Stock work for the RedWidget"


def hybrid_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, embed = _vectors(spark, sf_dir)
    return S.hybrid_search(m, _entries(spark, sf_dir), P.part_edges(spark, sf_dir), QUESTION, k=40, embed=embed)


def hybrid_exact_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full name that no method has: the nearest descriptions at the relaxed threshold."""
    m, embed = _vectors(spark, sf_dir)
    return S.hybrid_search(m, _entries(spark, sf_dir), P.part_edges(spark, sf_dir), "com.shop.promo.Nope.findAll", depth=1, k=60, embed=embed)


def hybrid_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code: the nearest by code, expanded over the part graph."""
    m, embed = _vectors(spark, sf_dir)
    return S.hybrid_search(m, _entries(spark, sf_dir), P.part_edges(spark, sf_dir), "public void run() { return x; }", depth=1, k=30, embed=embed)


def hybrid_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL: the methods of the nearest statements; every third part has the statement of its size, whose vector has that number."""
    m, embed = _vectors(spark, sf_dir)
    e = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sql_id"), "embedding")
    statements = P.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("sql_id")).join(e, "sql_id")
    return S.hybrid_search(m, _entries(spark, sf_dir), P.part_edges(spark, sf_dir), "SELECT a FROM b WHERE c = 1", k=10, embed=embed, statements=statements)


QUERIES = {f.__name__: f for f in (hybrid_natural, hybrid_exact_miss, hybrid_code, hybrid_sql, token_route, language_filter, keyword_filter, required_words, exception_filter, annotation_filter, point_lookup, inner_classes, path_prefix, file_substring, search_dispatch, exact_search, graph_expand, exact_short_circuit, union_keep_first, intersection, class_search, similar_logs, batched_search, hybrid_search)}

_PM = P.SQL_PART_METHODS
_CODE = r"(NOT regexp_matches(t, '[一-鿿]') AND (regexp_matches(t, '^(@\w+|\w+Exception|[A-Z][a-z]+[A-Z][a-zA-Z]*|\w+\.\w+|sql|query|insert|update|delete|select|from|where)$') OR list_contains(" + str(list(S.CODE_WORDS)) + ", lower(t))))"
_V = "v AS (SELECT e.vec_id AS id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_KIND = """list_extract(['METHOD_NAME', 'CLASS_NAME', 'FULL_QUALIFIED_NAME', 'FULL_QUALIFIED_CLASS_NAME', 'SQL_SNIPPET', 'HTTP_URI', 'CODE_SNIPPET', 'ANNOTATION', 'EXCEPTION_TYPE', 'NATURAL_LANGUAGE', 'HTTP_URI', 'METHOD_NAME', 'NATURAL_LANGUAGE'], (p_partkey % 13 + 1)::INT)"""
ORACLE_SQL = {
    "token_route": f"""WITH {SQL_QUERY_STRINGS}, cut AS (SELECT p_partkey AS query_id, list_filter(string_split_regex(q, '[\\s()' || '{{}}' || ';.,<>=+\\-*/&|!\\[\\]]+'), lambda x: trim(x) <> '') AS ts FROM qs),
x AS (SELECT query_id, generate_subscripts(ts, 1) - 1 AS place, unnest(ts) AS t, len(ts) AS n FROM cut), c AS (SELECT *, {_CODE} AS code FROM x)
SELECT query_id, place, t AS token, CASE WHEN code AND NOT (n > 1 AND bool_and(code) OVER (PARTITION BY query_id)) THEN 'CODE' ELSE 'DESCRIPTION' END AS route FROM c""",
    "language_filter": f"WITH {_PM} SELECT node, language FROM pm WHERE coalesce(lower(language), 'java') = 'java'",
    "keyword_filter": f"WITH {_PM} SELECT node, method_name, service FROM pm WHERE project IN ('promo', 'small', 'large') AND (contains(method_name, 'find') OR contains(method_name, 'Stock') OR service = 'Brand#7') AND coalesce(lower(language), 'java') = 'java'",
    "required_words": f"WITH {_PM}, t AS (SELECT node, method_name || ' ' || class_name || ' ' || description AS x FROM pm) SELECT node FROM t WHERE contains(x, 'ROMO small') OR contains(x, 'saveItem com.shop.large')",
    "exception_filter": "SELECT p_partkey AS node FROM part WHERE p_size % 11 = 0 AND p_type = 'LARGE'",
    "annotation_filter": "SELECT p_partkey AS node FROM part WHERE p_size % 7 = 0",
    "point_lookup": f"WITH {_PM} SELECT node, class_name FROM pm WHERE node IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)",
    "inner_classes": f"WITH {_PM} SELECT node, CASE WHEN node % 3 = 0 THEN class_name || '$In' || (node % 5) ELSE class_name END AS class_name FROM pm WHERE class_name = 'com.shop.promo.RedWidget' AND node % 3 <> 1",
    "path_prefix": "WITH p AS (SELECT DISTINCT '/repo' || CASE WHEN p_size > 5 THEN '/' || split_part(p_name, ' ', 1) ELSE '' END || CASE WHEN p_size > 30 THEN '/' || split_part(p_name, ' ', 2) ELSE '' END AS project_path FROM part) SELECT project_path FROM p WHERE starts_with('/repo/red', project_path) OR starts_with(project_path, '/repo/red') ORDER BY length(project_path) DESC, project_path LIMIT 5",
    "file_substring": "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id FROM p WHERE path <> '' AND (contains(path, '/fr/8') OR contains('/fr/8', path))",
    "search_dispatch": f"""WITH {SQL_QUERY_STRINGS}, k AS (SELECT p_partkey AS query_id, trim(q) AS q, {_KIND} AS kind FROM qs)
SELECT query_id, kind, CASE WHEN kind IN ('FULL_QUALIFIED_NAME', 'FULL_QUALIFIED_CLASS_NAME', 'HTTP_URI', 'ANNOTATION', 'EXCEPTION_TYPE', 'CLASS_NAME') THEN 'EXACT' WHEN kind = 'METHOD_NAME' THEN 'NAME' ELSE 'VECTOR' END AS channel,
CASE kind WHEN 'HTTP_URI' THEN lower(replace(q, 'GET ', '')) WHEN 'ANNOTATION' THEN split_part(q, '(', 1) ELSE q END AS sought FROM k""",
    "exact_search": f"""WITH {_PM}, s AS (SELECT *, split_part(class_name, '.', 4) AS simple FROM pm), q AS (SELECT *, node % 7 AS f FROM s WHERE service = 'Brand#3')
SELECT DISTINCT q.node AS query_id, m.node FROM q JOIN s m ON CASE q.f WHEN 0 THEN m.class_name = q.class_name AND m.method_name = q.method_name WHEN 1 THEN m.class_name = q.class_name WHEN 2 THEN m.simple = q.simple WHEN 3 THEN m.simple = q.simple AND m.method_name = q.method_name
WHEN 4 THEN m.service = q.service AND m.language = 'Java' WHEN 5 THEN m.comment IS NOT NULL ELSE len(m.thrown) > 0 END""",
    "graph_expand": f"WITH {P.SQL_USER_EDGES}, s AS (SELECT DISTINCT src AS seed FROM edges WHERE src < 4) SELECT seed, seed AS node FROM s UNION SELECT seed, dst FROM s JOIN edges ON src = seed UNION SELECT seed, src FROM s JOIN edges ON dst = seed",
    "exact_short_circuit": f"WITH {P.SQL_PART_EDGES}, h AS (SELECT DISTINCT p_partkey % 20 AS query_id, p_partkey AS node FROM part WHERE p_brand = 'Brand#9') SELECT * FROM h UNION SELECT query_id, dst FROM h JOIN edges ON src = node WHERE query_id % 2 = 1 UNION SELECT query_id, src FROM h JOIN edges ON dst = node WHERE query_id % 2 = 1",
    "union_keep_first": "SELECT p_partkey AS id, CASE WHEN p_size > 30 THEN 'big' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'cheap' END AS origin, p_size FROM part WHERE p_size > 30 OR p_type = 'PROMO' OR p_retailprice < 1000",
    "intersection": "SELECT p_partkey AS id FROM part WHERE p_size > 20 AND p_type <> 'PROMO' AND p_brand > 'Brand#15'",
    "class_search": f"WITH {_V} SELECT id, score FROM v WHERE label <> 3 AND score > 0 ORDER BY score DESC, id LIMIT 25",
    "similar_logs": f"WITH {_V} SELECT id, score FROM (SELECT * FROM v ORDER BY score DESC, id LIMIT 40) WHERE score >= 0.2",
    "batched_search": """WITH l AS (SELECT p_brand AS query_id, 'price' AS list, p_partkey AS id, p_retailprice AS raw, 0.01::DOUBLE AS w FROM part UNION ALL SELECT p_brand, 'size', p_partkey, p_size, 0.02 FROM part WHERE p_size > 25),
r AS (SELECT *, w / (60 + row_number() OVER (PARTITION BY query_id, list ORDER BY raw DESC, id)) AS one FROM l), f AS (SELECT query_id, id, sum(one) AS s FROM r GROUP BY 1, 2), m AS (SELECT query_id, max(w) * 0.02::DOUBLE AS m FROM l GROUP BY 1), c AS (SELECT query_id, id, round(least(s, m), 6) AS score FROM f JOIN m USING (query_id))
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM c) WHERE k <= 5""",
    "hybrid_search": f"""WITH {_PM}, {P.SQL_PART_EDGES}, first AS (SELECT node AS id FROM pm WHERE project = 'promo' AND coalesce(lower(language), 'java') = 'java' AND ends_with(class_name, '.RedWidget') AND method_name = 'findAll' ORDER BY node LIMIT 50),
a AS (SELECT DISTINCT seed, node FROM (SELECT id AS seed, dst AS node FROM first JOIN edges ON src = id UNION SELECT id, src FROM first JOIN edges ON dst = id) WHERE seed <> node), l AS (SELECT 'vector' AS list, id, 1.0::DOUBLE AS raw FROM first UNION ALL SELECT 'graph', node, count(*) FROM a GROUP BY node),
r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY raw DESC, id) AS k FROM l) SELECT id, round(sum(1.0::DOUBLE / (60 + k)), 6) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 50""",
}

# The methods' two vectors, and the cosines to the vector of row n.
_HV = f"WITH {_PM}, d AS (SELECT pm.*, e.embedding::DOUBLE[] AS dv, c.embedding::DOUBLE[] AS cv FROM pm JOIN embeddings e ON e.vec_id = node JOIN embeddings c ON c.vec_id - 1 = node)"


def _cos(v: str, n: int) -> str:
    return f"round(list_cosine_similarity({v}, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {n})), 6)"


def _token(token: str, kind: str, k: int) -> str:
    v, w = ("dv", "1.0") if kind == "description" else ("cv", "0.7")
    return f"SELECT * FROM (SELECT '{token}' AS token, node AS id, {_cos(v, len(token))} AS raw, {w}::DOUBLE AS w FROM d) WHERE raw >= 0.5 ORDER BY raw DESC, id LIMIT {k * 20})"


_TOKENS = [(t, "code" if t == "RedWidget" else "description") for t in QUESTION.split(" ")]
_DISTINCT = list(dict.fromkeys(_TOKENS))
ORACLE_SQL |= {
    "hybrid_natural": f"""{_HV}, hits AS ({' UNION ALL '.join('(' + _token(t, kind, 40) for t, kind in _DISTINCT)}),
r AS (SELECT *, row_number() OVER (ORDER BY raw * w DESC, id, token) AS k, count(*) OVER (PARTITION BY id) AS n FROM hits), f AS (SELECT id, round(sum(sqrt(n) / (60 + k)), 6) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 40),
s AS (SELECT node AS id, 0.1::DOUBLE AS score FROM d WHERE node NOT IN (SELECT id FROM f) AND (contains(method_name, 'show') OR contains(method_name, 'how') OR contains(method_name, 'findAll') OR contains(method_name, 'Stock') OR contains(method_name, 'work')) ORDER BY id LIMIT 40)
SELECT * FROM f UNION ALL SELECT * FROM s""",
    "hybrid_exact_miss": f"{_HV} SELECT node AS id, {_cos('dv', 27)} AS score FROM d WHERE {_cos('dv', 27)} >= 0.3 ORDER BY score DESC, id LIMIT 60",
    "hybrid_code": f"""{_HV}, {P.SQL_PART_EDGES}, a AS (SELECT node AS id, {_cos('cv', 31)} AS score FROM d), t AS (SELECT CASE WHEN max(score) >= 0.5 THEN 0.5 ELSE 0.3 END AS t FROM a),
first AS (SELECT id, score FROM a, t WHERE score >= t ORDER BY score DESC, id LIMIT 30),
x AS (SELECT DISTINCT seed, node FROM (SELECT id AS seed, dst AS node FROM first JOIN edges ON src = id UNION SELECT id, src FROM first JOIN edges ON dst = id) WHERE seed <> node),
l AS (SELECT 'vector' AS list, id, score AS raw FROM first UNION ALL SELECT 'graph', node, count(*) FROM x GROUP BY node),
r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY raw DESC, id) AS k FROM l) SELECT id, round(sum(1.0::DOUBLE / (60 + k)), 6) AS score FROM r WHERE k <= 600 GROUP BY id ORDER BY score DESC, id LIMIT 30""",
    "hybrid_sql": f"""{_HV}, q AS (SELECT DISTINCT p_size AS sql_id FROM part WHERE p_partkey % 3 = 0), a AS (SELECT sql_id, {_cos('e.embedding::DOUBLE[]', 27)} AS score FROM q JOIN embeddings e ON vec_id = sql_id),
t AS (SELECT CASE WHEN max(score) >= 0.5 THEN 0.5 ELSE 0.3 END AS t FROM a), b AS (SELECT sql_id, score FROM a, t WHERE score >= t ORDER BY score DESC, sql_id LIMIT 10)
SELECT p_partkey AS id, max(score) AS score FROM part JOIN b ON p_size = sql_id JOIN d ON node = p_partkey WHERE p_partkey % 3 = 0 GROUP BY 1 ORDER BY score DESC, id LIMIT 10""",
}
