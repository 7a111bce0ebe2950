"""Registered queries: traversal, components, cycles, communities, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, strings
from ..operators import graph as G
from ..operators import linking as L
from . import projection as P


def _seed(spark: SparkSession, value: int = 0) -> DataFrame:
    return spark.range(value, value + 1).select(F.col("id").alias("seed"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose id is a multiple of ten stand for entry points."""
    return P.table(spark, sf_dir, "events").where("user_id % 10 = 0").select(F.col("user_id").alias("seed")).distinct()


def callees_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.call_sites(spark, sf_dir).where("src = 'C:7'").groupBy("dst").agg(F.count("*").alias("calls"))


def callers_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.methods(spark, sf_dir).select(F.col("node").alias("src"), "module")
    return P.call_sites(spark, sf_dir).where("dst = 'S:3'").select("src").distinct().join(m, "src")


def callees_to_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach_once(P.user_edges(spark, sf_dir), _seed(spark), 2)


def callers_to_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach_once(G.reversed_edges(P.user_edges(spark, sf_dir)), _seed(spark), 2)


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.user_edges(spark, sf_dir)
    return G.chain_edges(e, G.reach_once(e, _seed(spark), 1), 2)


def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.depth_histogram(G.reach_once(P.user_edges(spark, sf_dir), _seed(spark)))


def undirected_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach_once(G.undirected(P.part_edges(spark, sf_dir)), P.part_edges(spark, sf_dir).agg(F.min("src").alias("seed")), 6)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(P.user_edges(spark, sf_dir), 0, 1).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "length")


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.blast_radius(P.user_edges(spark, sf_dir), _seed(spark), 10)
    return out.withColumn("level", scores.blast_level(F.col("total")))


def reachable_from_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.part_edges(spark, sf_dir)
    return G.reach_once(e, e.where("src % 10 = 0").select(F.col("src").alias("seed")).distinct()).agg(F.count("*").alias("reachable"))


def entries_affecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = G.reach_once(G.reversed_edges(P.user_edges(spark, sf_dir)), _seed(spark), 10).where("depth > 0")
    return up.join(_entries(spark, sf_dir), F.col("node") == F.col("seed")).select("node", "depth")


def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strongly_connected(P.part_edges(spark, sf_dir))


def scc_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strongly_connected(P.top_nation_edges(spark, sf_dir))


def cycle_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.table(spark, sf_dir, "nation")
    layers = n.select(F.col("n_name").alias("node"), F.when(F.col("n_regionkey") < 4, F.col("n_regionkey")).alias("layer"))
    return G.classify_cycles(G.strongly_connected(P.top_nation_edges(spark, sf_dir)), layers)


def mutual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mutual_pairs(P.nation_edges(spark, sf_dir))


def ego_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego_net(P.nation_edges(spark, sf_dir), P.table(spark, sf_dir, "nation").where("n_name = 'NATION_3'").select(F.col("n_name").alias("node")))


def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.call_tree(P.top_nation_edges(spark, sf_dir), "NATION_3", 4).select(F.concat_ws(">", "path").alias("path"), "node", "depth")


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = P.module_calls(spark, sf_dir).where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.sum("n").alias("weight"))
    return G.louvain(cells.select(F.lit("p").alias("project"), F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), "weight"))


def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("item"), F.col("n_chars").alias("size"))
    return G.greedy_batches(d, 20_000)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1), r"\d+", "{id}")
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), path.alias("path")).where("path <> ''").withColumn("project", F.element_at(F.split("host", r"\."), -1))


def url_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    calls = p.where("id % 2 = 0").select("id", "project", F.lit("get").alias("method"), F.col("path").alias("url"))
    entries = p.where("id % 2 = 1").select("id", "project", F.concat(F.lit("GET "), "path").alias("key"))
    return L.http_links(calls, entries)


def topic_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("mq:"), F.split("p_brand", "#")[0], F.lit(":"), "p_type", F.lit("-"), "p_size").alias("topic"), (F.col("p_partkey") % 3).alias("project"))
    return L.topic_links(p.where("id % 2 = 0"), p.where("id % 2 = 1"))


def feign_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("interface"), (F.col("p_partkey") % 4 == 0).alias("remote"))
    return L.sibling_links(p)


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.regexp_replace("url", r"^https?://[^/]+", "")
    return P.table(spark, sf_dir, "pages").select("page_id", strings.normalize_url(u).alias("path"), strings.normalize_route(u).alias("route"))


def span_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    methods = p.select(F.col("p_partkey").alias("node"), F.concat(F.lit("a.b.C"), F.col("p_partkey") % 50).alias("class_name"), F.concat(F.lit("m"), F.col("p_size")).alias("method_name"))
    name = F.concat(F.lit("a.b.C"), F.col("event_id") % 60)
    proxied = F.when(F.col("event_id") % 4 == 0, F.concat(name, F.lit("$$EnhancerBySpringCGLIB$$1f"))).when(F.col("event_id") % 4 == 1, F.regexp_replace(name, "^a[.]b", "x.y")).otherwise(name)
    spans = P.table(spark, sf_dir, "events").select(F.col("event_id").alias("span_id"), proxied.alias("class_name"), F.concat(F.lit("m"), F.col("user_id") % 60).alias("method_name"))
    return L.map_spans(spans, methods)


QUERIES = {f.__name__: f for f in (callees_1hop, callers_1hop, callees_to_depth, callers_to_depth, chain_edges, depth_histogram, undirected_distance, shortest_path, blast_radius, reachable_from_entries, entries_affecting, scc, scc_small, cycle_class, mutual_pairs, ego_net, call_tree, louvain, greedy_batches, url_link, topic_link, feign_bridge, url_normalize, span_map)}


def _walk(edges: str, seed: str, depth: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"WITH RECURSIVE {edges}, walk(node, d) AS ({seed} UNION SELECT e.{b}, d + 1 FROM walk JOIN edges e ON e.{a} = node WHERE d < {depth})"


_PAIRS = "WITH RECURSIVE {edges}, r(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM r JOIN edges ON b = src), members AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)"
_PATHS = r"paths AS (SELECT page_id AS id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '\d+', '{id}', 'g') AS path, list_extract(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.'), -1) AS project FROM pages)"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(CASE WHEN ends_with(lower(x), '/') AND length(x) > 1 THEN left(lower(x), -1) ELSE lower(x) END, '<[^>]+>', '{}', 'g'), ':[^/]+', '{}', 'g'), '\{[^}]+\}', '{}', 'g')"
_ROUTE = r"regexp_replace(split_part(x, '?', 1), '/\d+', '/{id}', 'g')"

ORACLE_SQL = {
    "callees_1hop": f"WITH {P.SQL_CALLS} SELECT dst, count(*) AS calls FROM calls WHERE src = 'C:7' GROUP BY 1",
    "callers_1hop": f"WITH {P.SQL_CALLS}, {P.SQL_METHODS} SELECT DISTINCT src, module FROM calls JOIN methods ON node = src WHERE dst = 'S:3'",
    "callees_to_depth": _walk(P.SQL_USER_EDGES, "SELECT 0::BIGINT, 0", 2) + " SELECT node, min(d) AS depth FROM walk GROUP BY 1",
    "callers_to_depth": _walk(P.SQL_USER_EDGES, "SELECT 0::BIGINT, 0", 2, True) + " SELECT node, min(d) AS depth FROM walk GROUP BY 1",
    "chain_edges": f"WITH {P.SQL_USER_EDGES} SELECT src, dst FROM edges WHERE src = 0 OR src IN (SELECT dst FROM edges WHERE src = 0)",
    "depth_histogram": _walk(P.SQL_USER_EDGES, "SELECT 0::BIGINT, 0", 12) + " SELECT depth, count(*) AS n FROM (SELECT node, min(d) AS depth FROM walk GROUP BY 1) GROUP BY 1",
    "undirected_distance": _walk(P.SQL_PART_EDGES.replace("edges AS", "one AS") + ", edges AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one)", "SELECT min(src), 0 FROM one", 6) + " SELECT node, min(d) AS depth FROM walk GROUP BY 1",
    "shortest_path": _walk(P.SQL_USER_EDGES, "SELECT 0::BIGINT, 0", 12).replace("WITH RECURSIVE", "WITH RECURSIVE near AS (SELECT 1),", 1) + """, shortest AS (SELECT min(d) AS k FROM walk WHERE node = 1), back(node, d) AS (SELECT 1::BIGINT, k FROM shortest UNION SELECT e.src, d - 1 FROM back JOIN edges e ON e.dst = back.node WHERE d > 0 AND (e.src, d - 1) IN (SELECT (node, d) FROM walk)),
way(p, node, d) AS (SELECT [0::BIGINT], 0::BIGINT, 0 UNION SELECT list_append(p, e.dst), e.dst, way.d + 1 FROM way JOIN edges e ON e.src = way.node JOIN back ON back.node = e.dst AND back.d = way.d + 1)
SELECT array_to_string(min(p), '>') AS path, max(d) AS length FROM way WHERE node = 1 AND d = (SELECT k FROM shortest) HAVING count(*) > 0""",
    "blast_radius": f"""WITH RECURSIVE {P.SQL_USER_EDGES}, up(node, d) AS (SELECT 0::BIGINT, 0 UNION SELECT src, d + 1 FROM up JOIN edges ON dst = node WHERE d < 10), down(node, d) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, d + 1 FROM down JOIN edges ON src = node WHERE d < 10),
n AS (SELECT (SELECT count(DISTINCT node) FROM up WHERE node <> 0) AS callers, (SELECT count(DISTINCT node) FROM down WHERE node <> 0) AS callees) SELECT callers, callees, callers + callees AS total, CASE WHEN callers + callees > 100 THEN 'HIGH' WHEN callers + callees > 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM n""",
    "reachable_from_entries": f"WITH RECURSIVE {P.SQL_PART_EDGES}, walk(node) AS (SELECT src FROM edges WHERE src % 10 = 0 UNION SELECT dst FROM walk JOIN edges ON src = node) SELECT count(*) AS reachable FROM walk",
    "entries_affecting": _walk(P.SQL_USER_EDGES, "SELECT 0::BIGINT, 0", 10, True) + " SELECT node, min(d) AS depth FROM walk WHERE node <> 0 AND node % 10 = 0 AND node IN (SELECT user_id FROM events) GROUP BY 1",
    "scc": _PAIRS.format(edges=P.SQL_PART_EDGES) + " SELECT node, component FROM members",
    "scc_small": _PAIRS.format(edges=P.SQL_TOP_EDGES) + " SELECT node, component FROM members",
    "cycle_class": _PAIRS.format(edges=P.SQL_TOP_EDGES) + " SELECT component, count(*) AS size, CASE WHEN count(DISTINCT l) > 1 THEN 'CROSS_LAYER' WHEN count(DISTINCT l) = 1 THEN 'SAME_LAYER' ELSE 'MODULE' END AS kind FROM members JOIN (SELECT n_name, CASE WHEN n_regionkey < 4 THEN n_regionkey END AS l FROM nation) ON n_name = node GROUP BY 1",
    "mutual_pairs": f"WITH {P.SQL_NATION_EDGES} SELECT x.src AS a, x.dst AS b FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst",
    "ego_net": f"WITH {P.SQL_NATION_EDGES} SELECT src, dst FROM edges WHERE src = 'NATION_3' OR dst = 'NATION_3'",
    "call_tree": f"WITH RECURSIVE {P.SQL_TOP_EDGES}, t(p, node, depth) AS (SELECT ['NATION_3'], 'NATION_3', 0 UNION ALL SELECT list_append(p, dst), dst, depth + 1 FROM t JOIN edges ON src = node WHERE depth < 4 AND NOT list_contains(p, dst)) SELECT array_to_string(p, '>') AS path, node, depth FROM t",
    "url_link": f"WITH {_PATHS}, n AS (SELECT id, project, {_NORM.replace('lower(x)', 'lower(path)').replace('length(x)', 'length(path)')} AS k FROM paths WHERE path <> '') SELECT a.id AS src, min(b.id) AS dst, 'HTTP' AS bridge_type FROM n a JOIN n b ON a.k = b.k AND a.project <> b.project WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id, b.project",
    "topic_link": "WITH t AS (SELECT p_partkey AS id, p_type || '-' || p_size AS k, p_partkey % 3 AS g FROM part) SELECT a.id AS src, b.id AS dst, 'MQ' AS bridge_type FROM t a JOIN t b ON a.k = b.k AND a.g <> b.g WHERE a.id % 2 = 0 AND b.id % 2 = 1",
    "feign_bridge": "SELECT DISTINCT a.p_partkey AS src, b.p_partkey AS dst, 'FEIGN' AS bridge_type FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.p_partkey % 4 = 0 AND b.p_partkey % 4 <> 0",
    "url_normalize": f"WITH u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS x FROM pages) SELECT page_id, {_NORM} AS path, {_ROUTE} AS route FROM u",
    "span_map": r"""WITH m AS (SELECT 'a.b.C' || (p_partkey % 50) AS c, 'C' || (p_partkey % 50) AS s, 'm' || p_size AS f, p_partkey AS node FROM part),
g AS (SELECT c, s, f, min(node) AS node, count(*) AS n FROM m GROUP BY 1, 2, 3), e AS (SELECT event_id AS span_id, event_id % 4 AS k, 'C' || (event_id % 60) AS s, 'm' || (user_id % 60) AS f FROM events)
SELECT span_id, node, CASE WHEN n IS NULL THEN 3 WHEN n > 1 THEN 2 WHEN k > 1 THEN 0 ELSE 1 END AS match_level FROM e LEFT JOIN g ON e.s = g.s AND e.f = g.f""",
}
