"""The driver's tables as the code-graph model: who calls whom, in which module, and the graphs for traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, bridge_type, call_type): a lineitem is a call of its customer to its supplier."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("C:"), "o_custkey").alias("src"), F.concat(F.lit("S:"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("bridge_type"), F.col("l_linestatus").alias("call_type"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, module, service, class_name): customers and suppliers, their nation and region; a market segment is a class."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("module"), F.col("r_name").alias("service"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("class_name"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("n_nationkey"), F.lit("SUPPLIER").alias("class_name"))
    return c.union(s).join(nation, "n_nationkey").select("node", "module", "service", "class_name")


def module_calls(spark: SparkSession, sf_dir: str, by: str = "module") -> DataFrame:
    """(src_module, dst_module, bridge_type, call_type, n): call sites counted. Only nation numbers travel with orders and lines, and names
    join the counts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey", "l_returnflag", "l_linestatus")
    counted = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("c_nationkey", "s_nationkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name" if by == "module" else "r_name").alias("name"))
    a, b = names.select(F.col("n_nationkey").alias("c_nationkey"), F.col("name").alias("src_module")), names.select(F.col("n_nationkey").alias("s_nationkey"), F.col("name").alias("dst_module"))
    return counted.join(a, "c_nationkey").join(b, "s_nationkey").groupBy("src_module", "dst_module", F.col("l_returnflag").alias("bridge_type"), F.col("l_linestatus").alias("call_type")).agg(F.sum("n").alias("n"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): every dependency of a nation on another."""
    return module_calls(spark, sf_dir).where("src_module <> dst_module").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).distinct()


#: The names that stand for methods of the part classes.
METHOD_NAMES = ("getById", "findAll", "saveItem", "deleteRow", "updateStock")


def part_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, project, class_name, method_name, service, language, description, comment, thrown, file_path): a part is a method; its type
    is the package and its name the class."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    cls = F.concat(F.lit("com.shop."), F.lower("p_type"), F.lit("."), F.regexp_replace(F.initcap("p_name"), " ", ""))
    return p.select(
        F.col("p_partkey").alias("node"), F.lower("p_type").alias("project"), cls.alias("class_name"), F.element_at(F.array(*map(F.lit, METHOD_NAMES)), size % 5 + 1).alias("method_name"),
        F.col("p_brand").alias("service"), F.when(size % 3 == 1, "Java").when(size % 3 == 2, "python").alias("language"), F.concat_ws(" ", "p_type", "p_name").alias("description"),
        F.when(size % 7 == 0, "cached, see @Cacheable").alias("comment"), F.when(size % 11 == 0, F.array(F.lit("java.io.IOException"), F.concat(F.lit("com.shop."), "p_type", F.lit("Error")))).otherwise(F.array().cast("array<string>")).alias("thrown"),
        F.concat(F.lit("src/main/java/"), F.regexp_replace(cls, r"\.", "/"), F.lit(".java")).alias("file_path"),
    )


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): user to the user of the next event by time, where the first event is an error."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id", "event_type")
    nxt = graph.consecutive(e, "day", ["ts", "event_id"], "user_id")
    return nxt.where("event_type = 'error' and following is not null").select(F.col("user_id").alias("src"), F.col("following").alias("dst")).distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): part to the part on the order's next line, for quantities from 48."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")  # noqa: E741
    b = l.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    return l.where("l_quantity >= 48").join(b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") + 1 == F.col("n"))).select(F.col("l_partkey").alias("src"), "dst").distinct()


def top_nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each nation's two heaviest targets, ties by name."""
    from pyspark.sql import Window

    cells = module_calls(spark, sf_dir).where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.sum("n").alias("w"))
    k = F.row_number().over(Window.partitionBy("src_module").orderBy(F.desc("w"), "dst_module"))
    return cells.withColumn("k", k).where("k <= 2").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))


def json_number(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


# the same in SQL
SQL_CALLS = "calls AS (SELECT 'C:' || o_custkey AS src, 'S:' || l_suppkey AS dst, l_returnflag AS bridge_type, l_linestatus AS call_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
SQL_METHODS = """methods AS (
  SELECT node, n_name AS module, r_name AS service, class_name FROM (
    SELECT 'C:' || c_custkey AS node, c_nationkey AS k, c_mktsegment AS class_name FROM customer
    UNION ALL SELECT 'S:' || s_suppkey, s_nationkey, 'SUPPLIER' FROM supplier) JOIN nation ON n_nationkey = k JOIN region ON n_regionkey = r_regionkey)"""
SQL_USER_EDGES = "edges AS (SELECT DISTINCT user_id AS src, following AS dst FROM (SELECT user_id, event_type, lead(user_id) OVER (ORDER BY ts, event_id) AS following FROM events) WHERE event_type = 'error' AND following IS NOT NULL)"
SQL_PART_EDGES = "edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 48)"
SQL_MODULE_CALLS = f"{SQL_CALLS}, {SQL_METHODS}, mcalls AS (SELECT a.module AS src_module, b.module AS dst_module, a.service AS src_service, b.service AS dst_service, bridge_type, call_type FROM calls JOIN methods a ON a.node = src JOIN methods b ON b.node = dst)"
SQL_NATION_EDGES = f"{SQL_MODULE_CALLS}, edges AS (SELECT DISTINCT src_module AS src, dst_module AS dst FROM mcalls WHERE src_module <> dst_module)"
SQL_PART_METHODS = """pm AS (SELECT p_partkey AS node, lower(p_type) AS project, 'com.shop.' || lower(p_type) || '.' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS class_name,
  list_extract(['getById', 'findAll', 'saveItem', 'deleteRow', 'updateStock'], p_size % 5 + 1) AS method_name, p_brand AS service, CASE p_size % 3 WHEN 1 THEN 'Java' WHEN 2 THEN 'python' END AS language, p_type || ' ' || p_name AS description,
  CASE WHEN p_size % 7 = 0 THEN 'cached, see @Cacheable' END AS comment, CASE WHEN p_size % 11 = 0 THEN ['java.io.IOException', 'com.shop.' || p_type || 'Error'] ELSE [] END AS thrown FROM part)"""
SQL_TOP_EDGES = f"{SQL_MODULE_CALLS}, edges AS (SELECT src_module AS src, dst_module AS dst FROM (SELECT src_module, dst_module, row_number() OVER (PARTITION BY src_module ORDER BY count(*) DESC, dst_module) AS k FROM mcalls WHERE src_module <> dst_module GROUP BY src_module, dst_module) WHERE k <= 2)"
