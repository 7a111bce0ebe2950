"""Search: vector top-k, keyword recall, rank fusion, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .lineage import running

RRF_K = 60


def vector_scores(items: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """items with score: the cosine to one stated query vector."""
    return items.withColumn("score", F.round(scores.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6))


def top_k(scored: DataFrame, k: int, key: str = "id", before: Column | None = None, after: Column | None = None) -> DataFrame:
    """The k best by score, then key. `before` filters first; `after` filters what the index gave, so fewer than k rows may stay."""
    out = (scored if before is None else scored.where(before)).orderBy(F.desc("score"), key).limit(k)
    return out if after is None else out.where(after)


def relaxed(scored: DataFrame, threshold: float = 0.5, lower: float = 0.3) -> DataFrame:
    """Those at or above threshold, or, if there is none, at or above the lower one: decided inside the plan."""
    best = scored.agg(F.max("score").alias("_best"))
    return scored.join(F.broadcast(best), F.col("score") >= F.when(F.col("_best") >= threshold, threshold).otherwise(lower)).drop("_best")  # one row


def best_rows(ranked: DataFrame, most: int | None) -> DataFrame:
    """Rows whose _rank is at most most. Up to 1000, Spark cuts each task's rows of a list before they are shuffled, so no task ranks a whole list."""
    return ranked if most is None else ranked.where(F.col("_rank") <= most)


def fuse(lists: DataFrame, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """(id, score): reciprocal-rank fusion of (list, id, raw[, weight columns]) rows: sum of weight / (60 + rank), rank from 1 by raw, id; of each
    list the most best rows, or all (for lists that are short already)."""
    ranked = best_rows(lists.withColumn("_rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("raw"), "id"))), most)
    one = (F.lit(1.0) if weight is None else weight) / (RRF_K + F.col("_rank"))
    return ranked.groupBy("id").agg(F.round(F.sum(one), 6).alias("score"))


def fuse_tokens(hits: DataFrame) -> DataFrame:
    """(id, score) of (token, kind, id, raw): raw weighs 1.0 for descriptions and 0.7 for code, one order over all rows, and each row
    adds sqrt(hits of its id) / (60 + rank). (id, token) is unique."""
    weighed = hits.withColumn("_w", F.col("raw") * F.when(F.col("kind") == "description", 1.0).otherwise(0.7))
    ranked = running(weighed, [F.desc("_w"), F.col("id"), F.col("token")], F.lit(1), "_rank").withColumn("_rank", F.col("_rank") + 1)
    ranked = ranked.withColumn("_hits", F.count("*").over(Window.partitionBy("id")))
    return ranked.groupBy("id").agg(F.round(F.sum(F.sqrt("_hits") / (RRF_K + F.col("_rank"))), 6).alias("score"))


def dual_channel(sub_queries: DataFrame) -> DataFrame:
    """A GENERAL copy is added for sub-queries with confidence below 0.7 that aren't GENERAL."""
    return sub_queries.unionByName(sub_queries.where("confidence < 0.7 and intent <> 'GENERAL'").withColumn("intent", F.lit("GENERAL")))


def capped(scored: DataFrame, most: float, ratio: float = 2.0) -> DataFrame:
    return scored.withColumn("score", F.least("score", F.lit(most * ratio)))


def with_bonus(scored: DataFrame, marked: DataFrame, bonus: float = 0.5) -> DataFrame:
    """bonus for ids of marked (id)."""
    m = marked.select("id").distinct().withColumn("_bonus", F.lit(bonus))
    return scored.join(m, "id", "left").withColumn("score", F.col("score") + F.coalesce("_bonus", F.lit(0.0))).drop("_bonus")


def propagate(scored: DataFrame, edges: DataFrame, nodes: DataFrame, sources: int = 20, share: float = 0.3) -> DataFrame:
    """(id, score): the best sources add share of their score to each callee; callees without a node row are left out."""
    best = scored.select("id", "score").orderBy(F.desc("score"), "id").limit(sources)
    to = best.join(edges.select("src", "dst").distinct(), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("score") * share).alias("score"))
    known = to.join(nodes.select("id").distinct(), "id", "left_semi")
    return scored.select("id", "score").union(known).groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"))


def reranked(scored: DataFrame, external: DataFrame, k: int | None = None) -> DataFrame:
    """External scores (id, score), best first; those without one go last with 0. With k, only the first k."""
    out = scored.select("id").join(external.select("id", "score"), "id", "left").withColumn("missing", F.col("score").isNull()).fillna(0.0, ["score"])
    out = out.orderBy("missing", F.desc("score"), "id")
    return out if k is None else out.limit(k)


def keyword_supplement(items: DataFrame, covered: DataFrame, keywords: list[str], text: str, most: int = 5, score: float = 0.1, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of items whose text has one of the first `most` keywords of 2 to 30 characters, stop words aside, and whose id isn't covered."""
    words = [w for w in dict.fromkeys(keywords) if 2 <= len(w) <= 30 and w not in stop_words][:most]
    if not words:
        return items.select("id").where("false").withColumn("score", F.lit(score))
    any_of = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(text), w))
    return items.where(any_of).select("id").join(covered.select("id"), "id", "left_anti").withColumn("score", F.lit(score))


def enriched(ids: DataFrame, edges: DataFrame, most: int = 3, entries: DataFrame | None = None, statements: DataFrame | None = None) -> DataFrame:
    """ids with the first callers and callees by id, and of entries (src: id, dst: entry) and statements (src: id, dst: statement) the
    first entries and sql_ids. Neighbours are cut by rank before they are gathered."""

    def side(own: str, other: str, name: str, edges: DataFrame = edges) -> DataFrame:
        # Places count different neighbours, so each task cuts its own rows before any are shuffled, repeats and all.
        first = edges.select("src", "dst").withColumn("_k", F.dense_rank().over(Window.partitionBy(own).orderBy(other))).where(F.col("_k") <= most)
        first = first.groupBy(F.col(own).alias("id")).agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col(other)).cast("array<string>"))).alias(name))
        return first.join(ids.select("id").distinct(), "id", "left_semi")

    out = ids.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left")
    for more, name in ((entries, "entries"), (statements, "sql_ids")):
        out = out if more is None else out.join(side("src", "dst", name, more), "id", "left")
    return out


def similar_cases(cases: DataFrame, kind: str, keywords: list[str]) -> DataFrame:
    """(id, priority, uses): exact type first, then any of up to five keywords in the text, by uses."""
    like = F.exists(F.array(*[F.lit(w) for w in keywords[:5]]), lambda w: F.contains(F.col("text"), w)) if keywords else F.lit(False)
    ranked = cases.withColumn("priority", F.when(F.col("kind") == kind, 0).when(like, 1)).where("priority is not null")
    return ranked.select("id", "priority", "uses").orderBy("priority", F.desc("uses"), "id")
