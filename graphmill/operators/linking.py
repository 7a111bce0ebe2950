"""Edges between services: by normalised url, topic, shared interface, artifact, and spans to methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from .pairs import distinct_pairs


def http_links(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, dst, bridge_type) of calls (id, project, method, url) and entries (id, project, key) of other projects: same method and
    normalised path; of several entries with one key and project the least id. A link comes once."""
    a = calls.select(F.col("id").alias("src"), F.col("project").alias("_a"), F.concat_ws(" ", F.upper("method"), strings.normalize_url(F.col("url"))).alias("_key"))
    b = entries.select(F.col("id").alias("dst"), F.col("project").alias("_b"), strings.normalize_entry_key(F.col("key")).alias("_key")).groupBy("_key", "_b").agg(F.min("dst").alias("dst"))
    return distinct_pairs(a, b, ["_key"], F.col("_a") != F.col("_b"), F.col("src"), F.col("dst"), F.lit("HTTP").alias("bridge_type"))


def topic_links(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(src, dst, bridge_type) of (id, project, topic): equal text after the last colon, other projects. A link comes once."""
    a = producers.select(F.col("id").alias("src"), F.col("project").alias("_a"), strings.topic_tail(F.col("topic")).alias("_key"))
    b = consumers.select(F.col("id").alias("dst"), F.col("project").alias("_b"), strings.topic_tail(F.col("topic")).alias("_key"))
    return distinct_pairs(a, b, ["_key"], F.col("_a") != F.col("_b"), F.col("src"), F.col("dst"), F.lit("MQ").alias("bridge_type"))


def sibling_links(implements: DataFrame) -> DataFrame:
    """(src, dst, bridge_type) of (id, interface, remote boolean): a remote proxy to each local class of the same interface."""
    a = implements.where("remote").select(F.col("id").alias("src"), "interface")
    b = implements.where("not remote").select(F.col("id").alias("dst"), "interface")
    return distinct_pairs(a, b, ["interface"], F.col("src") != F.col("dst"), F.col("src"), F.col("dst"), F.lit("FEIGN").alias("bridge_type"))


def frontend_links(clients: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, dst) of clients (id, method, url) and entries (id, key) on `METHOD path`, the first entry of a key."""
    a = clients.select(F.col("id").alias("src"), F.concat_ws(" ", F.upper("method"), strings.normalize_frontend_url(F.col("url"))).alias("_key"))
    path = F.regexp_replace(F.regexp_replace(F.trim(F.substr("key", F.instr("key", " ") + 1)), "^/api(?=/|$)", ""), r"\{[^}]+\}", ":param")
    b = entries.select(F.col("id").alias("dst"), F.concat_ws(" ", F.upper(F.substring_index("key", " ", 1)), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))).alias("_key"))
    first = b.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("dst"))).where("_k = 1").drop("_k")
    return a.join(first, "_key").select("src", "dst")


def dispatch_edges(implements: DataFrame) -> DataFrame:
    """(src, dst, call_type): interface method to each implementation (iface, impl, kind)."""
    return implements.select(F.col("iface").alias("src"), F.col("impl").alias("dst"), F.when(F.col("kind") == "OVERRIDE", "OVERRIDE").otherwise("DISPATCH").alias("call_type")).distinct()


def artifact_edges(modules: DataFrame) -> DataFrame:
    """(src, dst) of modules (module, group_id, artifact_id, dependencies array of `group:artifact:version`) that depend on each other."""
    a = modules.select(F.col("module").alias("src"), F.explode("dependencies").alias("_dep")).select("src", F.substring_index("_dep", ":", 2).alias("_key"))
    b = modules.select(F.col("module").alias("dst"), F.concat_ws(":", "group_id", "artifact_id").alias("_key"))
    return a.join(b, "_key").where("src <> dst").select("src", "dst").distinct()


def all_links(*found: DataFrame) -> DataFrame:
    """The links of strategies that have a bridge_type each and give a link once, so that none is compared with another."""
    return reduce(lambda a, b: a.unionByName(b), found)


def map_spans(spans: DataFrame, methods: DataFrame) -> DataFrame:
    """spans (span_id, class_name, method_name) to (span_id, node, match_level): 0 exact, 1 the only method of the class with the proxy
    suffix off, 2 one of several, 3 none. Exact comes first, then the bare class, then the simple class name; the least node if several."""
    s = spans.select("span_id", "class_name", "method_name", strings.strip_proxy(F.col("class_name")).alias("_bare"))
    m = methods.select(F.col("class_name").alias("_class"), F.col("method_name").alias("_method"), "node")
    by_class = m.groupBy("_class", "_method").agg(F.min("node").alias("_node"), F.count("*").alias("_n"))
    by_simple = m.groupBy(strings.simple_name(F.col("_class")).alias("_class"), "_method").agg(F.min("node").alias("_node"), F.count("*").alias("_n"))
    out = s
    for k, (key, table) in enumerate((("class_name", by_class), ("_bare", by_class), ("_simple", by_simple))):
        left = out.withColumn("_simple", strings.simple_name(F.col("_bare"))) if key == "_simple" else out
        t = table.select(F.col("_class").alias(f"_c{k}"), F.col("_method").alias(f"_m{k}"), F.col("_node").alias(f"_node{k}"), F.col("_n").alias(f"_n{k}"))
        out = left.join(t, (F.col(key) == F.col(f"_c{k}")) & (F.col("method_name") == F.col(f"_m{k}")), "left")
    several = lambda k: F.when(F.col(f"_n{k}") > 1, 2)
    level = F.when(F.col("_n0").isNotNull(), F.coalesce(several(0), F.lit(0))).when(F.col("_n1").isNotNull(), F.coalesce(several(1), F.lit(1))).when(F.col("_n2").isNotNull(), F.coalesce(several(2), F.lit(1))).otherwise(3)
    return out.select("span_id", F.coalesce("_node0", "_node1", "_node2").alias("node"), level.alias("match_level"))
