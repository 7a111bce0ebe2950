"""Registered queries: linking, incremental upkeep, call resolution, data types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, strings
from ..operators import architecture as A
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import linking as L
from ..operators import resolution as R
from . import projection as P


def _implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", "p_brand", "p_type").alias("iface"), F.col("p_partkey").cast("string").alias("impl"), F.when(F.col("p_size") % 2 == 0, "OVERRIDE").otherwise("IMPLEMENTS").alias("kind"))


def dispatch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dispatch_edges(_implements(spark, sf_dir))


def rebuilt_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.when(F.col("src") % 3 == 0, "DISPATCH").otherwise("DIRECT").alias("call_type"))
    return R.rebuilt_dispatch(e, _implements(spark, sf_dir).where("kind = 'OVERRIDE'"))


def refreshed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old cells of the calls with flag A; those of the dirty nations are counted anew over all calls."""
    calls = P.module_calls(spark, sf_dir)
    dirty = P.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("module"))
    return A.refreshed_cells(A.dependency_cells(calls.where("bridge_type = 'A'")), calls, dirty)


def without_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"))
    return I.without_deleted(P.part_edges(spark, sf_dir), files, p.where("p_size = 50 and p_type = 'PROMO'").select(F.col("p_brand").alias("file"))).select("src", "dst")


def dirty_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.part_methods(spark, sf_dir)
    return I.dirty_packages(m.where("service < 'Brand#12'").select(F.concat("class_name", F.lit("#"), "method_name", F.lit("(int)")).alias("id")))


def inherited_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part extends the one with half its number; its name is a method."""
    p = P.table(spark, sf_dir, "part")
    extends = p.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return I.inherited_methods(extends, p.where("p_size < 25").select(F.col("p_partkey").alias("owner"), F.col("p_type").alias("method")), 12)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return I.upserted(s.where("s_acctbal < 6000"), s.where("s_acctbal > 3000").withColumn("s_acctbal", F.lit(0.0)))


def connected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.connected_edges(P.part_edges(spark, sf_dir), P.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("node"))).select("src", "dst")


def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return I.appended_once(e.where("ts < '2024-01-20'"), e.where("ts > '2024-01-15'").select("event_id", "user_id", "ts"), "event_id").select("event_id")


def carried_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by hash; the count of characters stands for a vector."""
    d = P.table(spark, sf_dir, "documents").where("text is not null")
    old = d.where("lang <> 'de'").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"), F.col("n_chars").alias("vector"))
    new = d.select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))).alias("hash"))
    return R.carried_vectors(old, new).select("id", "vector")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are repositories, orders commits, priorities files; the checkpoint is the latest finished order."""
    o = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("file"), "o_orderstatus")
    checkpoints = o.where("o_orderstatus = 'F'").groupBy("repo").agg(F.max_by("commit", F.struct("at", "commit")).alias("commit"))
    return R.changed_files(o.drop("o_orderstatus"), checkpoints)


def community_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer")
    after = F.when(F.col("c_acctbal") > 5000, "moved").otherwise(F.col("c_mktsegment"))
    return G.community_drift(c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("community")), c.select(F.col("c_custkey").alias("node"), after.alias("community"))).select(F.round("drift", 6).alias("drift"))


def frontend_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    path = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.regexp_replace("p_brand", "#", ""))
    clients = p.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("get").alias("method"), F.concat(F.lit("/api"), path, F.lit("/${id}")).alias("url"))
    return L.frontend_links(clients, p.where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.concat(F.lit("GET "), path, F.lit("/{key}")).alias("key")))


def artifact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.table(spark, sf_dir, "nation")
    deps = F.transform(F.array(F.lit(1), F.lit(5), F.lit(40)), lambda k: F.concat(F.lit("org.n:m"), F.col("n_nationkey") + k, F.lit(":1.0")))
    return L.artifact_edges(n.select(F.col("n_name").alias("module"), F.lit("org.n").alias("group_id"), F.concat(F.lit("m"), "n_nationkey").alias("artifact_id"), deps.alias("dependencies")))


def link_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies at once, their links once each."""
    from .graph_queries import feign_bridge, topic_link, url_link

    return L.all_links(*[q(spark, sf_dir).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "bridge_type") for q in (url_link, topic_link, feign_bridge)])


def bridge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("project"), F.when(F.col("p_size") % 2 == 0, "HTTP").otherwise("MQ").alias("kind"), F.concat_ws(":", "p_brand", "p_name").alias("key"))
    return R.bridges_from_endpoints(p.where("id % 3 = 0"), p.where("id % 3 = 1"))


def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call a class and a method; a class has a parent, an interface its implementations, and some names are known by their class alone."""
    p = P.table(spark, sf_dir, "part")
    methods = p.where("p_size < 40").select(F.col("p_partkey").alias("node"), F.concat(F.lit("a.C"), F.col("p_partkey") % 200).alias("class_name"), F.concat(F.lit("m"), F.col("p_size") % 10).alias("method_name"))
    extends = spark.range(1, 200).select(F.concat(F.lit("a.C"), "id").alias("child"), F.concat(F.lit("a.C"), F.floor(F.col("id") / 4)).alias("parent"))
    implements = spark.range(60).select(F.concat(F.lit("a.I"), F.col("id") % 20).alias("iface"), F.concat(F.lit("a.C"), F.col("id") * 3).alias("impl"))
    cls = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a.I"), F.col("o_custkey") % 20)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("a.C"), F.col("o_custkey") % 200)).otherwise(F.concat(F.lit("x.y.C"), F.col("o_custkey") % 200))
    sites = P.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("src"), cls.alias("class_name"), F.concat(F.lit("m"), F.col("o_orderkey") % 10).alias("method_name"), F.col("o_orderkey").alias("line"))
    return R.resolved_calls(sites, methods, extends, implements)


def schema_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are types, their two heaviest targets the types of their fields."""
    fields = P.top_nation_edges(spark, sf_dir).select(F.col("src").alias("owner"), F.concat(F.lit("f_"), "dst").alias("field"), F.col("dst").alias("type"))
    return R.expanded_schema(fields, P.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("node")), 3)


def description_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = F.element_at(F.array(*[F.lit(v) for v in ("get", "is", "has", "init", "list", "issue", "remove")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    name = F.when(F.col("p_size") == 50, verb).otherwise(F.concat(verb, F.regexp_replace(F.initcap("p_name"), " ", "")))
    return P.table(spark, sf_dir, "part").select("p_partkey", R.described(name).alias("guess"))


def cyclomatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.repeat(F.lit("if (a && b) { x(); } // if\n"), F.col("p_size")), F.lit('for (;;) { s = "while(" + c ? 1 : 2; } switch (k) { case 1: case 2: }'))
    return P.table(spark, sf_dir, "part").select("p_partkey", R.cyclomatic(body).alias("complexity"))


def java_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "part").select("p_partkey", strings.java_hash(F.concat_ws("/", "p_name", "p_brand")).alias("h"))


def snowflake_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of an order's time, nation and number, taken apart again."""
    o = P.table(spark, sf_dir, "events").select("event_id", scores.snowflake(F.unix_millis(F.col("ts").cast("timestamp")), F.col("user_id") % 32, F.col("user_id") % 7, F.col("event_id") % 4096).alias("x"))
    return o.select("event_id", "x", *[c.alias(n) for n, c in scores.snowflake_parts(F.col("x")).items()])


QUERIES = {f.__name__: f for f in (dispatch_edges, rebuilt_dispatch, refreshed_cells, without_deleted, dirty_packages, inherited_methods, upserted, connected_edges, appended_once, carried_vectors, changed_files, community_drift, frontend_links, artifact_edges, link_strategies, bridge_endpoints, call_resolution, schema_expand, description_guess, cyclomatic, java_hash, snowflake_ids)}

_IMPL = "impl AS (SELECT p_brand || '/' || p_type AS iface, p_partkey::VARCHAR AS impl, p_size % 2 = 0 AS o FROM part)"
_CAMEL = "upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"


def _links() -> str:
    from .graph_queries import ORACLE_SQL as graph

    return " UNION ".join(f"(SELECT src, dst, bridge_type FROM ({graph[n]}))" for n in ("url_link", "topic_link", "feign_bridge"))


ORACLE_SQL = {
    "dispatch_edges": f"WITH {_IMPL} SELECT DISTINCT iface AS src, impl AS dst, CASE WHEN o THEN 'OVERRIDE' ELSE 'DISPATCH' END AS call_type FROM impl",
    "rebuilt_dispatch": f"WITH {P.SQL_PART_EDGES}, {_IMPL} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, 'DIRECT' AS call_type FROM edges WHERE src % 3 <> 0 UNION ALL SELECT DISTINCT iface, impl, 'OVERRIDE' FROM impl WHERE o",
    "refreshed_cells": f"WITH {P.SQL_MODULE_CALLS} SELECT src_module, dst_module, count(*) AS weight, string_agg(DISTINCT bridge_type, ',' ORDER BY bridge_type) AS flags FROM mcalls WHERE src_module <> dst_module AND (bridge_type = 'A' OR src_module IN (SELECT n_name FROM nation WHERE n_regionkey = 1)) GROUP BY 1, 2",
    "without_deleted": f"WITH {P.SQL_PART_EDGES} SELECT src, dst FROM edges JOIN part ON p_partkey = dst WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_type = 'PROMO')",
    "dirty_packages": "SELECT DISTINCT 'com.shop.' || lower(p_type) AS module FROM part WHERE p_brand < 'Brand#12'",
    "inherited_methods": """WITH RECURSIVE up(child, node, d) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT child, node // 2, d + 1 FROM up WHERE node > 0 AND d < 12), m AS (SELECT p_partkey AS owner, p_type AS method FROM part WHERE p_size < 25),
f AS (SELECT child, method, owner, row_number() OVER (PARTITION BY child, method ORDER BY d, owner) AS k FROM up JOIN m ON owner = node) SELECT child, method, owner FROM f WHERE k = 1 AND (child, method) NOT IN (SELECT (owner, method) FROM m)""",
    "upserted": "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 3000 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "connected_edges": f"WITH {P.SQL_PART_EDGES} SELECT src, dst FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_size > 10 AND b.p_size > 10",
    "appended_once": "SELECT event_id FROM events WHERE ts >= '2024-01-20'",
    "carried_vectors": "SELECT doc_id AS id, CASE WHEN lang NOT IN ('de', 'fr') OR lang = 'fr' AND upper(text) = text THEN n_chars END AS vector FROM documents WHERE text IS NOT NULL",
    "changed_files": "WITH c AS (SELECT o_custkey AS repo, max(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT DISTINCT o_custkey AS repo, o_orderpriority AS file FROM orders LEFT JOIN c ON repo = o_custkey WHERE t IS NULL OR o_orderdate > t",
    "community_drift": "SELECT round(avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END), 6) AS drift FROM customer",
    "frontend_links": "WITH f AS (SELECT p_type, p_brand, min(p_partkey) AS dst FROM part WHERE p_size <= 25 GROUP BY 1, 2) SELECT p_partkey AS src, dst FROM part JOIN f USING (p_type, p_brand) WHERE p_size > 25",
    "artifact_edges": "SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey IN (1, 5)",
    "link_strategies": _links(),
    "bridge_endpoints": "SELECT a.p_partkey AS src, b.p_partkey AS dst, CASE WHEN a.p_size % 2 = 0 THEN 'HTTP' ELSE 'MQ' END AS bridge_type FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_size % 2 = b.p_size % 2 AND a.p_type <> b.p_type WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 = 1",
    "call_resolution": """WITH RECURSIVE m AS (SELECT p_partkey AS node, p_partkey % 200 AS c, 'm' || (p_size % 10) AS f FROM part WHERE p_size < 40), s AS (SELECT o_orderkey AS line, o_orderkey % 3 AS k, o_custkey % 500 AS src, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 20 ELSE o_custkey % 200 END AS c, 'm' || (o_orderkey % 10) AS f FROM orders),
direct AS (SELECT line, node AS dst, 'DIRECT' AS t FROM s JOIN m USING (c, f) WHERE k = 1), up(c, a, d) AS (SELECT x, x // 4, 1 FROM range(1, 200) t(x) UNION ALL SELECT c, a // 4, d + 1 FROM up WHERE a > 0), r AS (SELECT line, node, row_number() OVER (PARTITION BY line ORDER BY d, node) AS n FROM s JOIN up ON up.c = s.c JOIN m ON m.c = a AND m.f = s.f WHERE k = 1 AND line NOT IN (SELECT line FROM direct)),
inherited AS (SELECT line, node AS dst, 'INHERITED' AS t FROM r WHERE n = 1), dispatch AS (SELECT DISTINCT line, node AS dst, 'DISPATCH' AS t FROM s JOIN range(60) i(x) ON x % 20 = s.c JOIN m ON m.c = x * 3 AND m.f = s.f WHERE k = 0), one AS (SELECT c, f, min(node) AS dst FROM m GROUP BY 1, 2 HAVING count(*) = 1),
static AS (SELECT line, dst, 'STATIC' AS t FROM s JOIN one USING (c, f) WHERE k = 2) SELECT DISTINCT src, dst, t AS call_type, line FROM (SELECT * FROM direct UNION ALL SELECT * FROM inherited UNION ALL SELECT * FROM dispatch UNION ALL SELECT * FROM static) JOIN s USING (line) WHERE src <> dst""",
    "schema_expand": f"""WITH RECURSIVE {P.SQL_TOP_EDGES}, t(root, path, type, seen, depth) AS (SELECT n_name, 'f_' || dst, dst, [n_name], 1 FROM nation JOIN edges ON src = n_name WHERE n_regionkey = 2
UNION ALL SELECT root, path || '.f_' || dst, dst, list_append(seen, type), depth + 1 FROM t JOIN edges ON src = type WHERE depth < 3 AND NOT list_contains(seen, type)) SELECT root, path, type, depth FROM t""",
    "description_guess": """WITH n AS (SELECT p_partkey, p_partkey % 7 AS k, CASE WHEN p_size = 50 THEN '' ELSE lower(p_name) END AS r FROM part)
SELECT p_partkey, trim(CASE k WHEN 0 THEN 'get ' || r WHEN 1 THEN CASE WHEN r = '' THEN 'is' ELSE 'whether ' || r END WHEN 2 THEN CASE WHEN r = '' THEN 'has' ELSE 'whether it has ' || r END WHEN 3 THEN 'initialise ' || r WHEN 4 THEN 'list ' || r WHEN 5 THEN 'whether sue ' || r ELSE 'remove ' || r END) AS guess FROM n""",
    "cyclomatic": "SELECT p_partkey, 2 * p_size + 5 AS complexity FROM part",
    "java_hash": "WITH c AS (SELECT p_partkey, p_name || '/' || p_brand AS s FROM part) SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda x: ord(x)::BIGINT)), lambda a, x: CASE WHEN (a * 31 + x) & 4294967295 > 2147483647 THEN ((a * 31 + x) & 4294967295) - 4294967296 ELSE (a * 31 + x) & 4294967295 END) AS h FROM c",
    "snowflake_ids": "WITH o AS (SELECT event_id, epoch_us(ts) // 1000 AS t, user_id % 32 AS c, user_id % 7 AS w, event_id % 4096 AS s FROM events) SELECT event_id, ((t - 1704067200000) << 22) | (c << 17) | (w << 12) | s AS x, t AS millis, c AS centre, w AS worker, s AS sequence FROM o",
}
