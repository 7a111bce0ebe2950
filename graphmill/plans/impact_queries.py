"""Registered queries: entry points, impact rings, validation, diffs, instrumentation, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import architecture as A
from ..operators import graph as G
from ..operators import impact as I
from . import projection as P


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the type STANDARD stand for entry points."""
    return P.table(spark, sf_dir, "part").where("p_type = 'STANDARD'").select(F.col("p_partkey").alias("node"))


def _modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "part").where("p_brand = 'Brand#4'").select(F.col("p_partkey").alias("node"))


def entry_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.part_methods(spark, sf_dir).where("service <> 'Brand#2'")
    simple = F.element_at(F.split("class_name", r"\."), -1)
    asked = F.when(F.col("node") % 4 == 0, F.col("class_name")).when(F.col("node") % 4 == 1, simple).when(F.col("node") % 4 == 2, F.concat_ws(".", "project", simple)).otherwise("no.Such")
    return I.resolved_entries(P.part_methods(spark, sf_dir).where("service = 'Brand#2'").select(F.col("node").alias("ask_id"), asked.alias("class_name"), "method_name"), m)


def root_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.root_entries(P.part_edges(spark, sf_dir), _entries(spark, sf_dir), _modified(spark, sf_dir).withColumnRenamed("node", "seed"))


def class_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers up to depth 2 of the methods of one class."""
    seeds = P.part_methods(spark, sf_dir).where("class_name = 'com.shop.promo.RedWidget'").select(F.col("node").alias("seed"))
    return G.reach_once(G.reversed_edges(P.part_edges(spark, sf_dir)), seeds, 2).where("depth > 0")


def entries_affecting_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = P.part_methods(spark, sf_dir).where("class_name = 'com.shop.promo.RedWidget'").select(F.col("node").alias("seed"))
    return I.entries_reaching(P.part_edges(spark, sf_dir), _entries(spark, sf_dir), seeds, 10)


def cross_service_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts of one project reach in two steps in other projects."""
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_type")
    reached = G.reach_once(P.part_edges(spark, sf_dir), p.where("p_type = 'PROMO'").select(F.col("node").alias("seed")), 2)
    return reached.join(p.where("p_type <> 'PROMO'"), "node").select("node", "depth")


def _bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    e = P.part_edges(spark, sf_dir).join(p.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("a")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("b")), "dst")
    return e.where("a <> b").select("src", "dst", F.when(F.col("src") % 2 == 0, "FEIGN").otherwise("MQ").alias("bridge_type"))


def impact_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _modified(spark, sf_dir)
    return I.impact_ring(P.part_edges(spark, sf_dir), _entries(spark, sf_dir), _bridges(spark, sf_dir), m, m.where("node % 3 = 0"))


def bridge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of bridges between nations, each with its two heaviest targets."""
    starts = P.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("node"))
    return I.bridge_chains(P.top_nation_edges(spark, sf_dir), starts, 4).select(F.concat_ws(">", "path").alias("path"), "length")


def ring_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return I.ring_violations(P.part_edges(spark, sf_dir), _entries(spark, sf_dir), p.where("p_size = 7").select("node"), p.where("p_size = 9").select("node"), _modified(spark, sf_dir))


def entry_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.entry_relevance(P.part_methods(spark, sf_dir), F.lit("changes RedWidget#findAll and SmallRing#saveItem")).select("node", "relevance")


def diff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the classes of one brand are the diff; a documentation file in it names no class."""
    m = P.part_methods(spark, sf_dir)
    files = m.where("service = 'Brand#5'").select(F.col("file_path").alias("file")).distinct().union(spark.range(1).select(F.lit("README.md")))
    return I.entries_of_diff(files, m, P.part_edges(spark, sf_dir), _entries(spark, sf_dir), 2)


def instrumentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.part_edges(spark, sf_dir)
    entry = _entries(spark, sf_dir).where("node < 60").withColumnRenamed("node", "seed")
    return I.instrumented(e, P.part_methods(spark, sf_dir), entry, 3, ("java.", "com.shop.economy."))


def frontend_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("consumer"))
    entries = P.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("S:"), "s_suppkey").alias("node"))
    return I.consumers(clients, P.call_sites(spark, sf_dir), entries).groupBy("entry", "consumer").agg(F.count("*").alias("clients"))


def implementation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    impl = p.select(F.col("p_brand").alias("iface"), F.col("p_partkey").alias("impl"))
    return I.implementations(impl, p.where("p_size = 50").select(F.col("p_brand").alias("node")))


def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cycle_paths(P.top_nation_edges(spark, sf_dir), 6).select(F.concat_ws(">", "path").alias("path"), "length")


def call_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.walks(P.user_edges(spark, sf_dir), spark.range(3).select(F.col("id").alias("seed")), 3)


def shared_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.shared_graph(P.user_edges(spark, sf_dir), spark.range(1).select(F.col("id").alias("seed")), 2)


def layer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.layers(G.reach_once(P.user_edges(spark, sf_dir), spark.range(1).select(F.col("id").alias("seed"))))


def ego_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.neighbours(P.top_nation_edges(spark, sf_dir), P.table(spark, sf_dir, "nation").where("n_name = 'NATION_3'").select(F.col("n_name").alias("node")))


def flow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    e = P.part_edges(spark, sf_dir).join(p.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("a")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("b")), "dst")
    return I.flow(e.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def neighbourhood_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("size"))
    out = I.neighbourhood_features(p, P.part_edges(spark, sf_dir), ["size"], 1)
    return out.select("node", F.round("size_1", 6).alias("size_1"))


def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers, kinds of entry points and the change of each part, from its numbers."""
    size = F.col("p_size")
    kinds = F.transform(F.sequence(F.lit(1), size % 5), lambda k: F.element_at(F.array(*[F.lit(x) for x in ("HTTP_ENDPOINT", "MQ_CONSUMER", "SCHEDULED_TASK", "OTHER")]), (k % 4 + 1).cast("int")))
    kinds = F.when(size % 5 > 0, kinds).otherwise(F.array().cast("array<string>"))
    change = F.element_at(F.array(*[F.lit(x) for x in ("DELETE", "REFACTOR", "MODIFY", "ADD")]), size % 4 + 1)
    return P.table(spark, sf_dir, "part").select("p_partkey", scores.impact_scope(size % 30).alias("scope"), scores.entry_criticality(kinds).alias("business"), scores.change_complexity(change, size * 10).alias("complexity"))


def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .architecture_queries import set_metrics

    return A.mean_metrics(set_metrics(spark, sf_dir), 0.05)


def dependency_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dependency_labels(A.dependency_cells(P.module_calls(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (entry_resolution, root_entries, class_callers, entries_affecting_class, cross_service_reach, impact_ring, bridge_chains, ring_validation, entry_relevance, diff_entries, instrumentation, frontend_consumers, implementation_lookup, cycle_paths, call_walks, shared_graph, layer_view, ego_neighbours, flow_links, neighbourhood_features, impact_score, mean_metrics, dependency_labels)}

_PM, _E = P.SQL_PART_METHODS, P.SQL_PART_EDGES
_ENTRY = "entry AS (SELECT p_partkey AS node FROM part WHERE p_type = 'STANDARD')"
_UP = "up(seed, node, d) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT seed, src, d + 1 FROM up JOIN edges ON dst = node WHERE d < {depth})"
_SIMPLE = "split_part(class_name, '.', 4)"
_MOD = "modified AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#4')"
ORACLE_SQL = {
    "entry_resolution": f"""WITH {_PM}, a AS (SELECT node AS ask_id, CASE node % 4 WHEN 0 THEN class_name WHEN 1 THEN {_SIMPLE} WHEN 2 THEN project || '.' || {_SIMPLE} ELSE 'no.Such' END AS c, method_name AS f FROM pm WHERE service = 'Brand#2'),
m AS (SELECT node, class_name, method_name, {_SIMPLE} AS s FROM pm WHERE service <> 'Brand#2'), h AS (SELECT ask_id, node, CASE WHEN class_name = c THEN 1 WHEN s = list_extract(string_split(c, '.'), -1) THEN 2 ELSE 3 END AS step FROM a JOIN m ON f = method_name AND (class_name = c OR s = list_extract(string_split(c, '.'), -1) OR contains(class_name, c)))
SELECT ask_id, node, step FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY step, node) AS k FROM h) WHERE k = 1""",
    "root_entries": f"WITH RECURSIVE {_E}, {_ENTRY}, seeds AS (SELECT p_partkey AS seed FROM part WHERE p_brand = 'Brand#4'), {_UP.format(depth=3)} SELECT DISTINCT seed, up.node AS entry FROM up JOIN entry USING (node)",
    "class_callers": f"WITH RECURSIVE {_PM}, {_E}, seeds AS (SELECT node AS seed FROM pm WHERE class_name = 'com.shop.promo.RedWidget'), w(node, d) AS (SELECT seed, 0 FROM seeds UNION SELECT src, d + 1 FROM w JOIN edges ON dst = node WHERE d < 2) SELECT node, min(d) AS depth FROM w GROUP BY 1 HAVING min(d) > 0",
    "entries_affecting_class": f"WITH RECURSIVE {_PM}, {_E}, {_ENTRY}, w(node, d) AS (SELECT node, 0 FROM pm WHERE class_name = 'com.shop.promo.RedWidget' UNION SELECT src, d + 1 FROM w JOIN edges ON dst = node WHERE d < 10) SELECT DISTINCT node AS entry FROM w JOIN entry USING (node)",
    "cross_service_reach": f"WITH RECURSIVE {_E}, w(node, d) AS (SELECT p_partkey, 0 FROM part WHERE p_type = 'PROMO' UNION SELECT dst, d + 1 FROM w JOIN edges ON src = node WHERE d < 2) SELECT node, min(d) AS depth FROM w JOIN part ON p_partkey = node WHERE p_type <> 'PROMO' GROUP BY 1",
    "impact_ring": f"""WITH RECURSIVE {_E}, {_ENTRY}, {_MOD}, seeds AS (SELECT node AS seed FROM modified WHERE (SELECT count(*) FROM modified) <= 20 OR node % 3 = 0), {_UP.format(depth=3)}, down(node, d) AS (SELECT seed, 0 FROM seeds UNION SELECT dst, d + 1 FROM down JOIN edges ON src = node WHERE d < 2),
b AS (SELECT src, dst FROM edges JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst WHERE x.p_type <> y.p_type), o AS (SELECT src, dst FROM b JOIN seeds ON src = seed)
SELECT DISTINCT 'UPSTREAM' AS side, node, NULL::VARCHAR AS target FROM up JOIN entry USING (node) UNION SELECT 'DOWNSTREAM', node, NULL FROM down GROUP BY node HAVING min(d) > 0 UNION SELECT 'BRIDGE', src, dst::VARCHAR FROM o UNION SELECT 'CHAIN', src, dst::VARCHAR FROM b WHERE src IN (SELECT dst FROM o)""",
    "bridge_chains": f"WITH RECURSIVE {P.SQL_TOP_EDGES}, t(p, node, d) AS (SELECT [n_name], n_name, 0 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT list_append(p, dst), dst, d + 1 FROM t JOIN edges ON src = node WHERE d < 4 AND NOT list_contains(p, dst)) SELECT array_to_string(p, '>') AS path, d AS length FROM t WHERE d > 0",
    "ring_validation": f"""WITH RECURSIVE {_E}, {_ENTRY}, {_MOD}, seeds AS (SELECT p_partkey AS seed FROM part WHERE p_size = 7), {_UP.format(depth=10)}, ok AS (SELECT DISTINCT node FROM up JOIN entry USING (node))
SELECT 'ENTRY_NOT_REACHABLE' AS rule, seed AS node FROM seeds WHERE seed NOT IN (SELECT node FROM ok) UNION ALL SELECT 'IMPLEMENTATION_NOT_MODIFIED', p_partkey FROM part WHERE p_size = 9 AND p_partkey NOT IN (SELECT node FROM modified)""",
    "entry_relevance": f"WITH {_PM} SELECT node, CASE WHEN {_SIMPLE} || '#' || method_name IN ('RedWidget#findAll', 'SmallRing#saveItem') THEN 'DIRECT' ELSE 'INDIRECT' END AS relevance FROM pm",
    "diff_entries": f"""WITH RECURSIVE {_PM}, {_E}, {_ENTRY}, f AS (SELECT DISTINCT class_name FROM pm WHERE service = 'Brand#5'), s AS (SELECT class_name, node AS seed FROM pm JOIN f USING (class_name)), seeds AS (SELECT seed FROM s), {_UP.format(depth=2)}
SELECT up.node AS entry, count(DISTINCT class_name) AS files FROM up JOIN entry USING (node) JOIN s USING (seed) GROUP BY 1""",
    "instrumentation": f"""WITH RECURSIVE {_PM}, {_E}, w(node, d) AS (SELECT p_partkey, 0 FROM part WHERE p_type = 'STANDARD' AND p_partkey < 60 UNION SELECT dst, d + 1 FROM w JOIN edges ON src = node WHERE d < 3),
r AS (SELECT node, min(d) AS d FROM w GROUP BY 1), o AS (SELECT class_name, method_name, min(struct_pack(d := d, n := r.node)) AS x FROM r JOIN pm ON pm.node = r.node WHERE project <> 'economy' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY x) AS k FROM o)
SELECT class_name, string_agg(method_name, ',' ORDER BY x) AS methods FROM (SELECT * FROM k WHERE k <= 32 ORDER BY x, method_name LIMIT 256) GROUP BY 1""",
    "frontend_consumers": f"WITH {P.SQL_CALLS} SELECT dst AS entry, c_mktsegment AS consumer, count(DISTINCT src) AS clients FROM calls JOIN customer ON src = 'C:' || c_custkey JOIN supplier ON dst = 'S:' || s_suppkey WHERE s_acctbal > 5000 GROUP BY 1, 2",
    "implementation_lookup": "SELECT p_brand AS iface, p_partkey AS impl FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)",
    "cycle_paths": f"WITH RECURSIVE {P.SQL_TOP_EDGES}, t(p, first, node, d) AS (SELECT [src], src, src, 1 FROM (SELECT DISTINCT src FROM edges) UNION ALL SELECT list_append(p, dst), first, dst, d + 1 FROM t JOIN edges ON src = node WHERE d < 6 AND dst > first AND NOT list_contains(p, dst)) SELECT array_to_string(list_append(p, first), '>') AS path, d AS length FROM t JOIN edges ON src = node AND dst = first",
    "call_walks": f"WITH {P.SQL_USER_EDGES}, a AS (SELECT src AS seed, dst AS node, 1 AS depth, 1 AS n FROM edges WHERE src < 3), b AS (SELECT seed, dst AS node, 2 AS depth, sum(n)::BIGINT AS n FROM a JOIN edges ON src = node GROUP BY 1, 2), c AS (SELECT seed, dst AS node, 3 AS depth, sum(n)::BIGINT AS n FROM b JOIN edges ON src = node GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c",
    "shared_graph": f"WITH {P.SQL_USER_EDGES}, r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT dst, 1 FROM edges WHERE src = 0 AND dst <> 0) SELECT src, dst, depth FROM edges JOIN r ON node = src",
    "layer_view": f"WITH RECURSIVE {P.SQL_USER_EDGES}, w(node, d) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, d + 1 FROM w JOIN edges ON src = node WHERE d < 12), m AS (SELECT node, min(d) AS depth FROM w GROUP BY 1) SELECT depth, count(*) AS n, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes FROM m GROUP BY 1",
    "ego_neighbours": f"WITH {P.SQL_TOP_EDGES} SELECT dst AS node FROM edges WHERE src = 'NATION_3' UNION SELECT src FROM edges WHERE dst = 'NATION_3'",
    "flow_links": f"WITH {_E} SELECT x.p_type AS source, y.p_type AS target, count(*) AS value FROM edges JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst WHERE x.p_type <> y.p_type GROUP BY 1, 2",
    "neighbourhood_features": f"WITH {_E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), m AS (SELECT src, avg(p_size) AS a FROM u JOIN part ON p_partkey = dst GROUP BY 1) SELECT p_partkey AS node, round(coalesce(a, p_size), 6) AS size_1 FROM part LEFT JOIN m ON src = p_partkey",
    "impact_score": """SELECT p_partkey, CASE WHEN x % 30 = 0 THEN 10 WHEN x % 30 <= 3 THEN 25 WHEN x % 30 <= 5 THEN 40 WHEN x % 30 <= 10 THEN 60 WHEN x % 30 <= 20 THEN 80 ELSE 100 END AS scope,
CASE x % 5 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 45 WHEN 3 THEN 55 ELSE 85 END AS business, least(100, 30 + CASE x % 4 WHEN 0 THEN 40 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END + least(20, x * 10 // 50 * 5)) AS complexity FROM (SELECT p_partkey, p_size AS x FROM part)""",
    "mean_metrics": """WITH l AS (SELECT source AS grp, doc_id, bool_or(quality = 1) AS p, bool_or(toxic = 1) AS a FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), n AS (SELECT grp, count(*) FILTER (p AND a) AS h, count(*) FILTER (p) AS np, count(*) FILTER (a) AS na, count(*) FILTER (p OR a) AS u FROM l WHERE p OR a GROUP BY 1),
m AS (SELECT round(coalesce(h / nullif(na, 0), 0), 6) AS r, round(coalesce(h / nullif(np, 0), 0), 6) AS p, round(coalesce(h / nullif(u, 0), 0), 6) AS j FROM n) SELECT count(*) AS n, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision, round(avg(j), 6) AS jaccard, round(avg(CASE WHEN r >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM m""",
    "dependency_labels": f"WITH {P.SQL_MODULE_CALLS}, c AS (SELECT DISTINCT src_module AS s, dst_module AS d FROM mcalls WHERE src_module <> dst_module), b AS (SELECT s, d, 0 AS k, s AS label FROM c UNION ALL SELECT s, d, 1, d FROM c), m AS (SELECT label, min(struct_pack(s := s, d := d, k := k)) AS x FROM b GROUP BY 1) SELECT label, row_number() OVER (ORDER BY x) - 1 AS place FROM m",
}
