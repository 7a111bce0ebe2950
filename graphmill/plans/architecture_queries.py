"""Registered queries: module statistics, matrices, hotspots, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import architecture as A
from ..operators import incremental as I
from . import projection as P


def dsm_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dependency_cells(P.module_calls(spark, sf_dir))


def dsm_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    cells = A.dependency_cells(P.module_calls(spark, sf_dir, "service"), others_only=False)
    return A.dependency_matrix(cells, names).select("src_module", *[F.col(f"`{n}`").cast("long").alias(n.lower().replace(" ", "_")) for n in names])


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.degrees(P.methods(spark, sf_dir).select("node"), P.call_sites(spark, sf_dir))


def module_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.methods(spark, sf_dir).withColumn("complexity", F.length("node"))
    out = A.module_stats(A.degrees(nodes, P.call_sites(spark, sf_dir)))
    return out.withColumns({"avg_complexity": F.round("avg_complexity", 6), "instability": F.round("instability", 6)})


def bridge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bridge_stats(P.call_sites(spark, sf_dir), ["A", "N", "R"])


def bridge_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.call_sites(spark, sf_dir).groupBy("bridge_type", "call_type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.module_calls(spark, sf_dir, "service").where("src_module <> dst_module").groupBy("src_module", "dst_module", "bridge_type").agg(F.sum("n").alias("n"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.dependency_cells(P.module_calls(spark, sf_dir))
    top = F.concat_ws(",", F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "src_module", "dst_module"))), 1, 5), lambda x: F.concat_ws(">", x["src_module"], x["dst_module"])))
    best = cells.orderBy(F.desc("weight"), "src_module", "dst_module").limit(5).agg(top.alias("top"))  # one row
    return cells.agg(F.countDistinct("src_module").alias("modules"), F.count("*").alias("dependencies"), F.sum("weight").alias("calls"), F.round(F.avg("weight"), 1).alias("avg_coupling")).join(F.broadcast(best))


def hotspot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = P.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")  # noqa: E741
    newest = l.agg(F.max("l_shipdate").alias("newest"))
    per = l.join(F.broadcast(newest)).groupBy("l_partkey").agg(F.count(F.when(F.col("l_shipdate") >= F.col("newest") - F.expr("interval 90 days"), 1)).alias("churn"), F.countDistinct("l_suppkey").alias("in_degree"))  # one row
    p = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("complexity"))
    files = p.join(per, F.col("file") == F.col("l_partkey"), "left").fillna(0, ["churn", "in_degree"]).withColumn("in_cycle", F.col("complexity") % 7 == 0)
    return A.hotspots(files).select("file", F.round("churn_rank", 6).alias("churn_rank"), F.round("in_degree_rank", 6).alias("in_degree_rank"), "hotspot_score")


def hotspot_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotspot_score(spark, sf_dir).select("file", "hotspot_score").orderBy(F.desc("hotspot_score"), "file").limit(20)


def churn_90d(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = P.table(spark, sf_dir, "lineitem")  # noqa: E741
    commits = l.select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("author"), F.col("l_quantity").alias("lines"), F.col("l_shipdate").alias("at"))
    return A.churn(commits)


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 6
    name = F.concat(F.lower("n_name"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("controller", "service", "dao", "model", "util", "misc")]), (n + 1).cast("int")))
    return P.table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"), A.package_role(name).alias("layer"))


def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.package_violations(_roles(spark, sf_dir), P.nation_edges(spark, sf_dir))


def class_layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = _roles(spark, sf_dir).select(F.col("module").alias("node"), F.col("layer").alias("role"))
    return A.class_violations(roles, P.nation_edges(spark, sf_dir))


def module_layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = P.table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"), F.when(F.col("n_nationkey") % 4 > 0, (F.col("n_nationkey") % 4).cast("int")).alias("layer"))
    return A.module_violations(layers, P.nation_edges(spark, sf_dir))


def class_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("Controller", "ServiceImpl", "Mapper", "DTO", "Util", "Thing")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    role = A.class_role(F.when(F.col("p_partkey") % 11 == 0, F.array(F.lit("org.x.RestController"))), F.concat(F.lit("a.b.P"), suffix), F.when(F.col("p_partkey") % 2 == 0, "a.service").otherwise("a.b"))
    return p.select("p_partkey", role.alias("role"))


def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x"))
    score = scores.change_risk(scores.scope_points(F.col("x")), F.least(F.lit(100), 30 + F.col("x") % 4 * 15), scores.complexity_points(F.col("x"), F.col("x") * 5), scores.coverage_points(F.col("x") * 2.0), scores.change_points(F.col("x") % 13), scores.dependency_points(F.col("x") % 11))
    return p.select("p_partkey", score.alias("risk"), scores.level(score).alias("level"), F.round(scores.ring_risk(F.col("x") % 7, F.col("x") % 25, F.col("x") % 5), 6).alias("ring"), scores.diff_level(F.col("x") * 12, F.col("x") % 12).alias("diff"))


def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = P.table(spark, sf_dir, "labels").join(d, "doc_id")
    return A.set_metrics(lab.where("quality = 1").select(F.col("source").alias("grp"), F.col("doc_id").alias("item")), lab.where("toxic = 1").select(F.col("source").alias("grp"), F.col("doc_id").alias("item")))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = P.table(spark, sf_dir, "documents").where("text is not null")
    old = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    new = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return old, new


def hash_reuse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hash_split(*_versions(spark, sf_dir))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return I.orphans(c, P.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")))


def domain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import domain_confidence as confidence

    m = P.methods(spark, sf_dir).select(F.col("service").alias("domain"), F.col("class_name").alias("community"))
    return confidence(m).withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (dsm_nation, dsm_wide, degree, module_stats, bridge_stats, bridge_by_type, topology, dashboard, hotspot_score, hotspot_top, churn_90d, layer_violations, class_layer_violations, module_layer_violations, class_roles, change_risk, set_metrics, hash_reuse_split, orphans, domain_confidence)}

_HOT = """WITH newest AS (SELECT max(l_shipdate) AS d FROM lineitem),
per AS (SELECT l_partkey, count(*) FILTER (l_shipdate >= d - INTERVAL 90 DAY) AS churn, count(DISTINCT l_suppkey) AS in_degree FROM lineitem, newest GROUP BY l_partkey),
files AS (SELECT p_partkey AS file, p_size AS x, coalesce(churn, 0) AS churn, coalesce(in_degree, 0) AS in_degree, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS c FROM part LEFT JOIN per ON p_partkey = l_partkey),
ranked AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE percent_rank() OVER (ORDER BY churn) END AS cr, CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE percent_rank() OVER (ORDER BY in_degree) END AS ir FROM files),
scored AS (SELECT file, round(cr, 6) AS churn_rank, round(ir, 6) AS in_degree_rank, round(0.35 * (CASE WHEN x <= 10 THEN x / 10.0 * 0.25 WHEN x <= 20 THEN 0.25 + (x - 10) / 10.0 * 0.25 WHEN x <= 50 THEN 0.5 + (x - 20) / 30.0 * 0.35 ELSE least(1.0, 0.85 + (x - 50) / 100.0 * 0.15) END)::DOUBLE + 0.35 * cr + 0.2 * ir + 0.1 * c, 6) AS hotspot_score FROM ranked)"""
_ROLE_SQL = "roles AS (SELECT n_name AS module, CASE n_nationkey % 6 WHEN 0 THEN 'CONTROLLER' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'REPOSITORY' WHEN 3 THEN 'MODEL' WHEN 4 THEN 'UTILITY' ELSE 'UNKNOWN' END AS layer, CASE n_nationkey % 6 WHEN 5 THEN NULL ELSE n_nationkey % 6 END AS o, CASE n_nationkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 END AS h FROM nation)"
_STEP = "CASE WHEN x <= 1 THEN 10 WHEN x <= 3 THEN 25 WHEN x <= 5 THEN 40 WHEN x <= 10 THEN 60 WHEN x <= 20 THEN 80 ELSE 95 END"

ORACLE_SQL = {
    "dsm_nation": f"WITH {P.SQL_MODULE_CALLS} SELECT src_module, dst_module, count(*) AS weight, string_agg(DISTINCT bridge_type, ',' ORDER BY bridge_type) AS flags FROM mcalls WHERE src_module <> dst_module GROUP BY 1, 2",
    "dsm_wide": f"WITH {P.SQL_MODULE_CALLS} SELECT src_service AS src_module, " + ", ".join(f"count(*) FILTER (dst_service = '{n}') AS {n.lower().replace(' ', '_')}" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM mcalls GROUP BY 1",
    "degree": f"WITH {P.SQL_CALLS}, {P.SQL_METHODS} SELECT node, (SELECT count(DISTINCT src) FROM calls WHERE dst = node) AS in_degree, (SELECT count(DISTINCT dst) FROM calls WHERE src = node) AS out_degree FROM methods",
    "module_stats": f"""WITH {P.SQL_CALLS}, {P.SQL_METHODS}, i AS (SELECT dst AS node, count(DISTINCT src) AS n FROM calls GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS n FROM calls GROUP BY 1),
g AS (SELECT module, count(*) AS n_methods, count(DISTINCT class_name) AS n_classes, round(avg(length(m.node)), 6) AS avg_complexity, sum(coalesce(i.n, 0))::BIGINT AS in_degree, sum(coalesce(o.n, 0))::BIGINT AS out_degree FROM methods m LEFT JOIN i ON i.node = m.node LEFT JOIN o ON o.node = m.node GROUP BY module)
SELECT *, round(CASE WHEN in_degree + out_degree > 0 THEN out_degree / (in_degree + out_degree) ELSE 0 END, 6) AS instability FROM g""",
    "bridge_stats": f"WITH {P.SQL_CALLS} SELECT count(*) FILTER (bridge_type = 'A') AS n_a, count(*) FILTER (bridge_type = 'N') AS n_n, count(*) FILTER (bridge_type = 'R') AS n_r, count(*) AS total, round(count(*) FILTER (dst IS NOT NULL AND bridge_type IN ('A', 'N', 'R')) / count(*), 6) AS jumpable_rate FROM calls",
    "bridge_by_type": f"WITH {P.SQL_CALLS} SELECT bridge_type, call_type, count(*) AS n, count(DISTINCT dst) AS targets FROM calls GROUP BY 1, 2",
    "topology": f"WITH {P.SQL_MODULE_CALLS} SELECT src_service AS src_module, dst_service AS dst_module, bridge_type, count(*) AS n FROM mcalls WHERE src_service <> dst_service GROUP BY 1, 2, 3",
    "dashboard": f"WITH {P.SQL_MODULE_CALLS}, cells AS (SELECT src_module, dst_module, count(*) AS w FROM mcalls WHERE src_module <> dst_module GROUP BY 1, 2) SELECT count(DISTINCT src_module) AS modules, count(*) AS dependencies, sum(w)::BIGINT AS calls, round(avg(w), 1) AS avg_coupling, (SELECT string_agg(src_module || '>' || dst_module, ',' ORDER BY w DESC, src_module, dst_module) FROM (SELECT * FROM cells ORDER BY w DESC, src_module, dst_module LIMIT 5)) AS top FROM cells",
    "hotspot_score": f"{_HOT} SELECT * FROM scored",
    "hotspot_top": f"{_HOT} SELECT file, hotspot_score FROM scored ORDER BY hotspot_score DESC, file LIMIT 20",
    "churn_90d": "WITH newest AS (SELECT max(l_shipdate) AS d FROM lineitem) SELECT l_partkey AS file, count(*) AS n_commits, sum(l_quantity) AS lines_changed, count(DISTINCT l_suppkey) AS n_authors, max(l_shipdate) AS last_commit FROM lineitem, newest WHERE l_shipdate >= d - INTERVAL 90 DAY GROUP BY 1",
    "layer_violations": f"WITH {P.SQL_NATION_EDGES}, {_ROLE_SQL} SELECT src, dst, a.layer AS src_layer, b.layer AS dst_layer FROM edges JOIN roles a ON a.module = src JOIN roles b ON b.module = dst WHERE a.o > b.o AND b.layer <> 'UTILITY' AND (SELECT avg(CASE WHEN o IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM roles) >= 0.3",
    "class_layer_violations": f"WITH {P.SQL_NATION_EDGES}, {_ROLE_SQL} SELECT src, dst, a.layer AS src_role, b.layer AS dst_role FROM edges JOIN roles a ON a.module = src JOIN roles b ON b.module = dst WHERE b.h > a.h",
    "module_layer_violations": f"""WITH {P.SQL_NATION_EDGES}, lay AS (SELECT n_name AS module, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 4 END AS l FROM nation),
e AS (SELECT src, dst, a.l AS a, b.l AS b FROM edges JOIN lay a ON a.module = src JOIN lay b ON b.module = dst),
low AS (SELECT src AS m, max(b) AS v FROM e WHERE a IS NULL AND b IS NOT NULL GROUP BY 1), high AS (SELECT dst AS m, min(a) AS v FROM e WHERE b IS NULL AND a IS NOT NULL GROUP BY 1)
SELECT src, dst, CASE WHEN b > a + 1 THEN 'CROSS_LAYER' ELSE 'REVERSE' END AS kind FROM e WHERE b > a UNION ALL SELECT low.m, low.m, 'CONTRADICTION' FROM low JOIN high ON low.m = high.m WHERE low.v > high.v""",
    "class_roles": "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'CONTROLLER' WHEN p_partkey % 6 = 0 THEN 'CONTROLLER' WHEN p_partkey % 6 = 1 THEN 'SERVICE' WHEN p_partkey % 6 = 2 THEN 'REPOSITORY' WHEN p_partkey % 6 = 3 THEN 'MODEL' WHEN p_partkey % 6 = 4 THEN 'UTILITY' WHEN p_partkey % 2 = 0 THEN 'SERVICE' ELSE 'UNKNOWN' END AS role FROM part",
    "change_risk": f"""WITH f AS (SELECT p_partkey, p_size AS x FROM part), s AS (SELECT *, floor({_STEP} * 0.25 + least(100, 30 + x % 4 * 15) * 0.2
+ least(100, CASE WHEN x <= 5 THEN 0 WHEN x <= 10 THEN 10 WHEN x <= 15 THEN 20 WHEN x <= 20 THEN 30 ELSE 40 END + CASE WHEN x * 5 <= 50 THEN 0 WHEN x * 5 <= 100 THEN 10 WHEN x * 5 <= 200 THEN 20 ELSE 30 END + 30) * 0.2
+ CASE WHEN x * 2 >= 80 THEN 15 WHEN x * 2 >= 60 THEN 30 WHEN x * 2 >= 40 THEN 50 WHEN x * 2 >= 20 THEN 70 ELSE 90 END * 0.2
+ CASE WHEN x % 13 >= 10 THEN 80 WHEN x % 13 >= 5 THEN 60 WHEN x % 13 >= 3 THEN 40 WHEN x % 13 >= 1 THEN 20 ELSE 10 END * 0.1
+ CASE WHEN x % 11 >= 10 THEN 80 WHEN x % 11 >= 5 THEN 50 WHEN x % 11 >= 3 THEN 30 WHEN x % 11 >= 1 THEN 20 ELSE 10 END * 0.05 + 0.5)::INT AS risk FROM f)
SELECT p_partkey, risk, CASE WHEN risk < 30 THEN 'LOW' WHEN risk < 60 THEN 'MEDIUM' WHEN risk < 85 THEN 'HIGH' ELSE 'CRITICAL' END AS level, round((0.5 * least(100.0, 20.0 * (x % 7)) + 0.3 * least(100.0, 5.0 * (x % 25)))::DOUBLE + 20.0::DOUBLE / greatest(1, x % 5), 6) AS ring, CASE WHEN x * 12 > 500 OR x % 12 > 10 THEN 'HIGH' WHEN x * 12 > 100 OR x % 12 > 3 THEN 'MEDIUM' ELSE 'LOW' END AS diff FROM s""",
    "set_metrics": """WITH l AS (SELECT source AS grp, doc_id, bool_or(quality = 1) AS p, bool_or(toxic = 1) AS a FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
n AS (SELECT grp, count(*) FILTER (p AND a) AS hits, count(*) FILTER (p) AS np, count(*) FILTER (a) AS na, count(*) FILTER (p OR a) AS u FROM l WHERE p OR a GROUP BY 1)
SELECT grp, hits, round(coalesce(hits / nullif(na, 0), 0), 6) AS recall, round(coalesce(hits / nullif(np, 0), 0), 6) AS precision, round(coalesce(hits / nullif(u, 0), 0), 6) AS jaccard FROM n""",
    "hash_reuse_split": """WITH o AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL), n AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' WHEN o.h = n.h THEN 'REUSE' ELSE 'OVERWRITE' END AS action FROM o FULL JOIN n ON o.id = n.id""",
    "orphans": "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "domain_confidence": f"WITH {P.SQL_METHODS}, n AS (SELECT service, class_name, count(*) AS n FROM methods GROUP BY 1, 2) SELECT service AS domain, round(max(n) / sum(n), 6) AS confidence FROM n GROUP BY 1",
}
