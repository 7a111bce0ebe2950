"""Incremental maintenance: what to reuse, overwrite, insert and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import saved


def hash_split(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action) of (id, hash): REUSE if equal, OVERWRITE if not, INSERT if only new, DELETE if only old."""
    o, n = old.select("id", F.col("hash").alias("_old"), F.lit(True).alias("_in_old")), new.select("id", F.col("hash").alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "INSERT").when(F.col("_in_new").isNull(), "DELETE").when(F.col("_old").eqNullSafe(F.col("_new")), "REUSE").otherwise("OVERWRITE")
    return o.join(n, "id", "full").select("id", action.alias("action"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def orphans(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti")


def connected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends exist in nodes (node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").dropDuplicates(["src", "dst"]).select(*edges.columns)


def without_deleted(edges: DataFrame, files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges but those from a live file into a deleted one. files: (node, file); deleted: (file)."""
    gone = files.join(deleted.select("file").distinct(), "file", "left_semi").select(F.col("node").alias("dst"))
    return edges.join(gone, "dst", "left_anti")


def appended_once(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key the log lacks, once."""
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def dirty_packages(ids: DataFrame) -> DataFrame:
    """(module) of ids like `a.b.Class#method(args)`."""
    return ids.select(F.regexp_replace(F.regexp_replace("id", r"#.*$", ""), r"\.?[^.]*$", "").alias("module")).distinct()


def inherited_methods(extends: DataFrame, methods: DataFrame, max_depth: int = 10) -> DataFrame:
    """(child, method, owner): methods that a class has from its nearest ancestor (the least of several as near). extends: (child, parent);
    methods: (owner, method). A level a round: what a class gets goes on to its children, so no row is made that isn't in the result."""
    up = saved(extends.select("child", "parent").where("child <> parent").distinct())
    own = methods.select("owner", "method").distinct()
    has = own.select(F.col("owner").alias("child"), "method")
    now, found = own.select(F.col("owner").alias("parent"), "method", "owner"), None
    for _ in range(max_depth):
        step = up.join(now, "parent").groupBy("child", "method").agg(F.min("owner").alias("owner")).join(has, ["child", "method"], "left_anti")
        step = saved(step if found is None else step.join(found.select("child", "method"), ["child", "method"], "left_anti"))
        if found is not None and step.isEmpty():
            break
        found = step if found is None else found.union(step)
        now = step.withColumnRenamed("child", "parent")
    return found
