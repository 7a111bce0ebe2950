"""Connected components of a distributed edge list: alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a minimum per node (partial aggregation, so a hub combines before the shuffle) and a merge join with these minima, which never
reach the driver. A node with more than a thousandth of the edges is hot; there are 2000 such nodes at most, so their names are broadcast
and their rows dealt over SALTS keys. The number of rounds is logarithmic in the longest chain. Every step ends in a checkpoint, so that
plans stay small, and the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, tidy

SALTS = 64


def _met(rows: DataFrame, least: DataFrame, hot_from: int) -> DataFrame:
    """rows (u, v) with m, the least v of u, from least (u, m, n)."""
    most = least.agg(F.max("n")).first()[0]
    if most is None or most < hot_from:
        return rows.join(least.select("u", "m").hint("merge"), "u")
    hot = least.where(F.col("n") >= hot_from).select(F.col("u").alias("hot"))
    salted = rows.join(F.broadcast(hot), F.col("u") == F.col("hot"), "left")  # at most 2 * edges / hot_from rows
    salted = salted.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.lit(SALTS))).cast("int")).drop("hot")
    many = F.when(F.col("n") >= hot_from, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(least.withColumn("salt", F.explode(many)).drop("n").hint("merge"), ["u", "salt"]).drop("salt")


def _least(edges: DataFrame) -> DataFrame:
    return saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))


def _large_star(edges: DataFrame, hot_from: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = saved(_met(both.where("v > u"), least, hot_from).select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
    dropped(edges, least)
    return out


def _small_star(edges: DataFrame, hot_from: int) -> DataFrame:
    """edges has u > v, as a large star gives them."""
    least = _least(edges)
    moved = _met(edges, least, hot_from).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    out = saved(moved.select("e.u", "e.v").where("u > v").distinct())
    dropped(edges, least)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (u, root) for every node of edges (u long, v long) but the roots, root the least node of its component.

    Nulls and loops are left out; an empty list gives no rows.
    """
    now = saved(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(after):
            break
        state = tuple(after)
        if not state[0]:
            break
        hot_from = max(100, state[0] // 1000)
        now = _small_star(_large_star(now, hot_from), hot_from)
        tidy(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root"))
