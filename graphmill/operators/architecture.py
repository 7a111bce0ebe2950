"""Module statistics, dependency matrices, hotspots and layer rules over nodes and edges."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.strings import simple_name
from .lineage import running, saved

# The two orders of layers. In the first a lower number stands above; in the second a higher one.
PACKAGE_ORDER = {"CONTROLLER": 0, "SERVICE": 1, "REPOSITORY": 2, "MODEL": 3, "UTILITY": 4}
CLASS_ORDER = {"MODEL": 1, "UTILITY": 1, "REPOSITORY": 2, "SERVICE": 3, "CONTROLLER": 4}
# Endings of names, in the order in which they are tried.
ROLE_ENDINGS = (
    ("CONTROLLER", ("controller",)),
    ("SERVICE", ("service", "serviceimpl")),
    ("REPOSITORY", ("repository", "dao", "mapper")),
    ("MODEL", ("dto", "entity", "model", "po", "vo", "domain")),
    ("UTILITY", ("util", "config", "common", "constant", "helper")),
)
# Last package segments.
ROLE_SEGMENTS = {
    "CONTROLLER": ("controller", "handler", "endpoint"),
    "SERVICE": ("service",),
    "REPOSITORY": ("repository", "dao", "mapper"),
    "MODEL": ("dto", "model", "entity", "vo", "domain"),
    "UTILITY": ("util", "common", "config", "constant"),
}
# Class annotations.
ROLE_ANNOTATIONS = {"RestController": "CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY"}


def lookup(key: Column, table: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def role_by_ending(name: Column) -> Column:
    """null if no ending fits."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for role, endings in reversed(ROLE_ENDINGS):
        out = F.when(low.rlike(f"({'|'.join(endings)})$"), role).otherwise(out)
    return out


def class_role(annotations: Column, class_name: Column, package: Column) -> Column:
    """By annotation, else by the class name's ending, else by the package's."""
    known = F.filter(F.transform(annotations, lambda a: lookup(simple_name(a), ROLE_ANNOTATIONS)), lambda r: r.isNotNull())
    return F.coalesce(F.get(known, 0), role_by_ending(simple_name(class_name)), role_by_ending(simple_name(package)), F.lit("UNKNOWN"))


def package_role(name: Column) -> Column:
    table = {segment: role for role, segments in ROLE_SEGMENTS.items() for segment in segments}
    return F.coalesce(lookup(simple_name(F.lower(name)), table), F.lit("UNKNOWN"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, ...) with in_degree and out_degree, distinct neighbours, zero if none: two aggregates on one distinct edge list."""
    e = edges.select("src", "dst").distinct()
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    return nodes.join(into, "node", "left").join(out, "node", "left").fillna(0, ["in_degree", "out_degree"])


def module_stats(nodes: DataFrame) -> DataFrame:
    """nodes (module, class_name, complexity, in_degree, out_degree) to a row a module; instability is out / (in + out) or 0."""
    agg = nodes.groupBy("module").agg(F.count("*").alias("n_methods"), F.countDistinct("class_name").alias("n_classes"), F.avg("complexity").alias("avg_complexity"), F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    both = F.col("in_degree") + F.col("out_degree")
    return agg.withColumn("instability", F.when(both > 0, F.col("out_degree") / both).otherwise(0.0))


def dependency_cells(edges: DataFrame, others_only: bool = True) -> DataFrame:
    """edges (src_module, dst_module, bridge_type), and n if a row stands for n edges, to cells with weight and the sorted flags."""
    e = edges.where("src_module <> dst_module") if others_only else edges
    weight = F.sum("n") if "n" in edges.columns else F.count("*")
    return e.groupBy("src_module", "dst_module").agg(weight.alias("weight"), F.concat_ws(",", F.array_sort(F.collect_set("bridge_type"))).alias("flags"))


def dependency_matrix(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Wide form for a stated list of labels."""
    return cells.groupBy("src_module").pivot("dst_module", labels).agg(F.sum("weight")).fillna(0)


def refreshed_cells(cells: DataFrame, edges: DataFrame, dirty: DataFrame) -> DataFrame:
    """cells with those of the dirty (module) sources counted anew."""
    marks = dirty.select(F.col("module").alias("src_module")).distinct()
    return cells.join(marks, "src_module", "left_anti").unionByName(dependency_cells(edges.join(marks, "src_module", "left_semi")).select(*cells.columns))


def bridge_stats(edges: DataFrame, types: list[str]) -> DataFrame:
    """One row: a conditional count a type, all, and the share of those that can be jumped to (type not null and target known)."""
    counts = [F.sum(F.when(F.col("bridge_type") == t, 1).otherwise(0)).alias(f"n_{t.lower()}") for t in types]
    jump = F.sum(F.when(F.col("dst").isNotNull() & F.col("bridge_type").isin(types), 1).otherwise(0))
    return edges.agg(*counts, F.count("*").alias("total"), F.round(F.coalesce(jump / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("jumpable_rate"))


def hotspots(files: DataFrame) -> DataFrame:
    """files (file, complexity, churn, in_degree, in_cycle) with ranks and hotspot_score.

    A rank is the share of the other files with a smaller value: files are counted by value, and the counts of smaller values are summed
    over ranges of values, so that no task orders all files.
    """
    files = saved(files)
    n = files.count()
    for c in ("churn", "in_degree"):
        per_value = running(files.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")), [F.col("_v")], F.col("_n"), "_less")
        share = F.lit(0.5) if n == 1 else F.col("_less") / F.lit(max(1, n - 1))
        files = files.join(per_value.select("_v", share.alias(f"{c}_rank")), F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    return files.withColumn("hotspot_score", F.round(scores.hotspot_score(F.col("complexity"), F.col("churn_rank"), F.col("in_degree_rank"), F.col("in_cycle")), 6))


def dependency_labels(cells: DataFrame) -> DataFrame:
    """(label, place): the modules of cells (src_module, dst_module) in the order in which the sorted cells first name them, from 0."""
    both = cells.select(F.struct("src_module", "dst_module", F.lit(0)).alias("at"), F.col("src_module").alias("label")).union(cells.select(F.struct("src_module", "dst_module", F.lit(1)), "dst_module"))
    return running(both.groupBy("label").agg(F.min("at").alias("_at")), [F.col("_at")], F.lit(1), "place").drop("_at")


def churn(commits: DataFrame, days: int = 90) -> DataFrame:
    """commits (file, commit, author, lines, at) of the last days before the newest, to a row a file."""
    newest = commits.agg(F.max("at").alias("_newest"))
    recent = commits.join(F.broadcast(newest), F.col("at") >= F.col("_newest") - F.expr(f"interval {int(days)} days"))  # one row
    return recent.groupBy("file").agg(F.count("*").alias("n_commits"), F.sum("lines").alias("lines_changed"), F.countDistinct("author").alias("n_authors"), F.max("at").alias("last_commit"))


def package_violations(modules: DataFrame, edges: DataFrame, least_known: float = 0.3) -> DataFrame:
    """(src, dst, src_layer, dst_layer): a lower layer depends on a higher one, utilities may be used by all. Nothing if fewer than
    least_known of modules (module, layer) have a known layer."""
    known = modules.agg(F.coalesce(F.avg(F.col("layer").isin(list(PACKAGE_ORDER)).cast("double")), F.lit(0.0)).alias("_share"))
    a = modules.select(F.col("module").alias("src"), F.col("layer").alias("src_layer"))
    b = modules.select(F.col("module").alias("dst"), F.col("layer").alias("dst_layer"))
    pairs = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where(lookup(F.col("src_layer"), PACKAGE_ORDER) > lookup(F.col("dst_layer"), PACKAGE_ORDER)).where("dst_layer <> 'UTILITY'")
    return pairs.join(F.broadcast(known), F.col("_share") >= least_known).select("src", "dst", "src_layer", "dst_layer")  # one row


def class_violations(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, src_role, dst_role) whose target stands above. roles: (node, role)."""
    a = roles.select(F.col("node").alias("src"), F.col("role").alias("src_role"))
    b = roles.select(F.col("node").alias("dst"), F.col("role").alias("dst_role"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where(lookup(F.col("dst_role"), CLASS_ORDER) > lookup(F.col("src_role"), CLASS_ORDER)).select("src", "dst", "src_role", "dst_role")


def module_violations(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, kind): REVERSE, CROSS_LAYER if the gap is over one, CONTRADICTION for a module of unknown layer whose lower bound
    (highest layer it depends on) is above its upper bound (lowest layer that depends on it). modules: (module, layer int, null unknown)."""
    a = modules.select(F.col("module").alias("src"), F.col("layer").alias("a"))
    b = modules.select(F.col("module").alias("dst"), F.col("layer").alias("b"))
    e = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    known = e.where("b > a").select("src", "dst", F.when(F.col("b") > F.col("a") + 1, "CROSS_LAYER").otherwise("REVERSE").alias("kind"))
    low = e.where("a is null and b is not null").groupBy(F.col("src").alias("module")).agg(F.max("b").alias("low"))
    high = e.where("b is null and a is not null").groupBy(F.col("dst").alias("module")).agg(F.min("a").alias("high"))
    odd = low.join(high, "module").where("low > high").select(F.col("module").alias("src"), F.col("module").alias("dst"), F.lit("CONTRADICTION").alias("kind"))
    return known.union(odd)


def mean_metrics(metrics: DataFrame, least_recall: float = 0.8) -> DataFrame:
    """(n, recall, precision, jaccard, pass_rate): means over the rows of set_metrics, and the share with at least least_recall."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count("*").alias("n"), *[mean(c).alias(c) for c in ("recall", "precision", "jaccard")], mean((F.col("recall") >= least_recall).cast("double")).alias("pass_rate"))


def set_metrics(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """(grp, hits, recall, precision, jaccard) of (grp, item) sets; a ratio over an empty set is 0."""
    p, a = predicted.select("grp", "item").distinct().withColumn("p", F.lit(1)), actual.select("grp", "item").distinct().withColumn("a", F.lit(1))
    n = p.join(a, ["grp", "item"], "full").groupBy("grp").agg(F.count("p").alias("n_p"), F.count("a").alias("n_a"), F.count(F.when(F.col("p").isNotNull() & F.col("a").isNotNull(), 1)).alias("hits"), F.count("*").alias("n_all"))
    ratio = lambda c: F.round(F.coalesce(F.col("hits") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)), 6)
    return n.select("grp", "hits", ratio("n_a").alias("recall"), ratio("n_p").alias("precision"), ratio("n_all").alias("jaccard"))
