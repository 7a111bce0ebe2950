"""The search path: token routing, filters, exact search by kind of query, expansion, merging of lists.

Queries come as rows (query_id, query), so that a batch of them is one plan; `hybrid_search` is the path of a single query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from . import graph, retrieval
from .lineage import saved
from .pairs import equal_pairs, split_repeated

# What separates tokens, the shape of a code token, and words that count as code.
TOKEN_BREAKS = r"[\s(){};.,<>=+\-*/&|!\[\]]+"
CODE_TOKEN = r"^(@\w+|\w+Exception|[A-Z][a-z]+[A-Z][a-zA-Z]*|\w+\.\w+|sql|query|insert|update|delete|select|from|where)$"
CODE_WORDS = (
    "sql", "query", "insert", "update", "delete", "select", "from", "where",
    "exception", "error", "fault", "failure", "annotation", "override",
    "async", "sync", "thread", "lock", "queue", "cache", "pool",
)
# Kinds of queries that an exact hit answers, without expansion.
EXACT_KINDS = ("FULL_QUALIFIED_NAME", "FULL_QUALIFIED_CLASS_NAME", "HTTP_URI", "ANNOTATION", "EXCEPTION_TYPE")


def routed_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, place, token, route): CODE or DESCRIPTION. Several tokens that are all code count as descriptions. Null and blank: none."""
    code = lambda t: ~t.rlike(r"[一-鿿]") & (t.rlike(CODE_TOKEN) | F.lower(t).isin(*CODE_WORDS))
    tokens = F.filter(F.split("query", TOKEN_BREAKS), lambda t: F.trim(t) != "")
    cut = queries.where(F.trim("query") != "").select("query_id", tokens.alias("tokens"))
    cut = cut.withColumn("words_only", (F.size("tokens") > 1) & F.forall("tokens", code))
    out = cut.select("query_id", "words_only", F.posexplode("tokens").alias("place", "token"))
    return out.select("query_id", "place", "token", F.when(code(F.col("token")) & ~F.col("words_only"), "CODE").otherwise("DESCRIPTION").alias("route"))


def of_language(methods: DataFrame, language: str | None) -> DataFrame:
    """Methods of a language; those without one count as java. No language: all."""
    if not (language or "").strip():
        return methods
    own = F.lower(F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("java")))
    return methods.where(own == language.lower())


def keyword_filter(methods: DataFrame, projects: list[str], method_type: str | None = None, service: str | None = None, keywords: list[str] | None = None, language: str | None = None) -> DataFrame:
    """Methods of the projects whose name has method_type or a keyword, or whose service is service; without any of these, all. Once each."""
    if not projects:
        raise ValueError("name the projects")
    words = [w for w in [method_type, *(keywords or [])] if w]
    tests = [F.contains(F.col("method_name"), F.lit(w)) for w in words] + ([F.col("service") == service] if service else [])
    inside = methods.where(F.col("project").isin(projects))
    return of_language(inside.where(reduce(lambda a, b: a | b, tests)) if tests else inside, language).dropDuplicates(["node"])


def required_words(methods: DataFrame, words: list[str]) -> DataFrame:
    """Methods whose name, class and description, joined by spaces, have one of the words; no words: all."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("method_name", "class_name", "description")])
    return methods.where(strings.contains_any(text, words)) if words else methods


def with_exception(methods: DataFrame, kind: str, lists: tuple[str, ...] = ("thrown", "caught")) -> DataFrame:
    """Methods with an exception whose name has kind in one of the lists."""
    has = lambda c: F.coalesce(F.exists(c, lambda e: F.contains(e, F.lit(kind))), F.lit(False))
    return methods.where(reduce(lambda a, b: a | b, [has(c) for c in lists]))


def with_annotation(methods: DataFrame, annotation: str, columns: tuple[str, ...] = ("body", "comment")) -> DataFrame:
    """Methods whose body or comment has @annotation."""
    mark = "@" + annotation.removeprefix("@")
    return methods.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(c), F.lit(mark)), F.lit(False)) for c in columns]))


def by_node_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of nodes (node, ...) that ids (node) names."""
    return nodes.join(ids.select("node").distinct(), "node", "left_semi")


def of_class(methods: DataFrame, cls: str) -> DataFrame:
    """Methods of a class and its inner classes."""
    return methods.where(strings.own_or_inner(F.col("class_name"), cls))


def nearest_paths(paths: DataFrame, path: str, most: int = 5) -> DataFrame:
    """(project_path) that is a prefix of path or has it as one, longest first."""
    known = paths.select("project_path").where("project_path is not null").distinct()
    return known.where(strings.mutual_prefix(F.lit(path), F.col("project_path"))).orderBy(F.desc(F.length("project_path")), "project_path").limit(most)


def dispatched(queries: DataFrame) -> DataFrame:
    """queries with kind, the search that answers it (EXACT, NAME or VECTOR), and what that looks for."""
    q = F.trim("query")
    kind = strings.query_type(F.col("query"))
    channel = F.when(F.col("kind").isin(*EXACT_KINDS, "CLASS_NAME"), "EXACT").when(F.col("kind") == "METHOD_NAME", "NAME").otherwise("VECTOR")
    bare = F.regexp_replace(F.regexp_replace(q, r"^@", ""), r"\(.*$", "")
    sought = F.when(F.col("kind") == "HTTP_URI", strings.normalize_url(F.regexp_replace(q, r"^(?i)(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+", ""))).when(F.col("kind") == "ANNOTATION", F.concat(F.lit("@"), bare)).otherwise(q)
    return queries.withColumn("kind", kind).withColumns({"channel": channel, "sought": sought})


def exact_hits(queries: DataFrame, methods: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, node): what dispatched queries of the channels EXACT and NAME find.

    A full name is a class and a method, a class its full or simple name, a method name class.method or the method alone: equality joins.
    A uri equals an entry's normalised path. Annotations and exceptions are looked for in comments and in the exceptions thrown; the
    distinct ones sought are few, as they are words that users type.
    """
    q = saved(queries.select("query_id", "kind", "sought").where("sought is not null").distinct())  # the kind is worked out once
    m = methods.select("node", "class_name", "method_name")
    split = lambda c: (F.regexp_replace(c, r"\.[^.]*$", ""), strings.simple_name(c))
    simple = m.withColumn("simple", strings.simple_name(F.col("class_name")))
    uri = entries.select("node", strings.normalize_url(F.col("path")).alias("sought"))
    mark = methods.where("comment is not null").select("node", F.explode(F.array_distinct(F.regexp_extract_all("comment", F.lit(r"@[A-Za-z_][\w.]*"), F.lit(0)))).alias("sought"))
    error = methods.select("node", F.explode(F.array_distinct(F.transform("thrown", strings.simple_name))).alias("sought"))

    def met(q: DataFrame) -> DataFrame:
        cls, name = split(F.col("sought"))
        of = lambda kind: q.where(F.col("kind") == kind)
        forms = [
            (of("FULL_QUALIFIED_NAME").withColumns({"class_name": cls, "method_name": name}), m, ["class_name", "method_name"]),
            (of("FULL_QUALIFIED_CLASS_NAME").withColumnRenamed("sought", "class_name"), m, ["class_name"]),
            (of("CLASS_NAME").withColumnRenamed("sought", "simple"), simple, ["simple"]),
            (of("METHOD_NAME").where("not contains(sought, '.')").withColumnRenamed("sought", "method_name"), m, ["method_name"]),
            (of("METHOD_NAME").where("contains(sought, '.')").withColumns({"simple": cls, "method_name": name}), simple, ["simple", "method_name"]),
            (of("HTTP_URI"), uri, ["sought"]), (of("ANNOTATION"), mark, ["sought"]), (of("EXCEPTION_TYPE"), error, ["sought"]),
        ]
        return reduce(lambda a, b: a.union(b), [equal_pairs(x.select("query_id", *key), y.select("node", *key).distinct(), key).select("query_id", "node") for x, y, key in forms])

    once, several = split_repeated(q, ["query_id"])
    several = saved(several)
    return met(q) if several.isEmpty() else met(once).union(met(several).distinct())  # one text finds a method once


def expanded(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node): each seed, and its callers and callees up to depth."""
    if depth <= 0:
        return seeds.select("seed", F.col("seed").alias("node")).where("seed is not null").distinct()
    return graph.reach(edges, seeds, depth).select("seed", "node").union(graph.reach(graph.reversed_edges(edges), seeds, depth).select("seed", "node")).distinct()


def unless_exact(hits: DataFrame, kinds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, node): hits (query_id, node), of queries whose kind (query_id, kind) isn't an exact one with what surrounds them."""
    known = hits.join(kinds.select("query_id", F.col("kind").isin(*EXACT_KINDS).alias("_exact")), "query_id").distinct()
    around = expanded(edges, known.where("not _exact").select(F.col("node").alias("seed")), depth)
    more = known.where("not _exact").select("query_id", F.col("node").alias("seed")).join(around, "seed").select("query_id", "node")
    return known.select("query_id", "node").union(more).distinct()


def first_of(lists: list[DataFrame], key: str = "id", order: Column | None = None) -> DataFrame:
    """Rows of several lists, of each key the one of the earliest list, and there the first by order. Rows without a key go."""
    both = reduce(lambda a, b: a.unionByName(b), [x.withColumn("_list", F.lit(k)) for k, x in enumerate(lists)]).where(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy("_list", *([order] if order is not None else []))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_list")


def in_all(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of the first list whose key all others have."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), lists)


def class_search(classes: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k classes (id, embedding) nearest to query among those with a cosine above 0."""
    return retrieval.top_k(retrieval.vector_scores(classes, query).where("score > 0"), k)


def similar_logs(chunks: DataFrame, query: list[float], threshold: float = 0.85, k: int = 5) -> DataFrame:
    """Of the k log chunks nearest to query those at or above threshold: the limit comes first, so fewer may stay."""
    return retrieval.top_k(retrieval.vector_scores(chunks, query), k, after=F.col("score") >= threshold)


def batched_search(lists: DataFrame, weight: Column, most_ratio: float = 2.0, k: int = 20, most: int | None = None) -> DataFrame:
    """(query_id, id, score): the lists (query_id, list, id, raw, ...) of many queries fused at once, scores capped at most_ratio times
    the query's largest weight, the k best of each. With most, only a list's so many best rows count, and each task cuts its own first."""
    w = Window.partitionBy("query_id", "list").orderBy(F.desc("raw"), "id")
    ranked = retrieval.best_rows(lists.withColumn("_w", weight).withColumn("_rank", F.row_number().over(w)), most).withColumn("_one", F.col("_w") / (retrieval.RRF_K + F.col("_rank")))
    most = ranked.groupBy("query_id").agg((F.max("_w") * most_ratio).alias("_most"))
    fused = ranked.groupBy("query_id", "id").agg(F.sum("_one").alias("score")).join(most, "query_id").select("query_id", "id", F.round(F.least("score", "_most"), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k).drop("_k")


# What separates a query's keywords, and words that are none.
KEYWORD_BREAKS = r"[\s，,。.；;、！!？?（）()\[\]【】{}\"'<>《》]+"
STOP_WORDS = (
    "的", "了", "在", "是", "和", "与", "及", "或", "不", "有", "无", "从", "到", "向", "上", "下", "中", "后", "前", "时", "当",
    "the", "a", "an", "is", "are", "was", "and", "or", "not", "in", "on", "at", "to", "for",
)
#: An index gives so many times k hits of a token; hits of the description weigh 1.0, of the code 0.7; a method found by a keyword alone scores this.
INDEX_FACTOR, SUPPLEMENT_SCORE = 20, 0.1


def search_keywords(query: str, most: int = 5) -> list[str]:
    """The first words of 2 to 30 characters that aren't stop words; words of two characters only if they have a Chinese one."""
    words = [w for w in re.split(KEYWORD_BREAKS, query or "") if 2 <= len(w) <= 30 and w.lower() not in STOP_WORDS]
    return [w for w in words if len(w) >= 3 or re.search(r"[\u4e00-\u9fa5]", w)][:most]


def token_hits(pool: DataFrame, tokens: list[tuple[str, str]], embed: Callable[[str], list[float]], k: int, threshold: float = 0.5) -> DataFrame:
    """(token, kind, id, raw): for each token (token, route) the k * INDEX_FACTOR methods nearest by description or by code, cut before they are joined."""
    parts = []
    for token, route in dict.fromkeys(tokens):
        by, kind = ("description_vector", "description") if route == "DESCRIPTION" else ("code_vector", "code")
        near = retrieval.vector_scores(pool.select("id", by), embed(token), by).where(F.col("score") >= threshold)
        parts.append(retrieval.top_k(near, k * INDEX_FACTOR).select(F.lit(token).alias("token"), F.lit(kind).alias("kind"), "id", F.col("score").alias("raw")))
    return reduce(lambda a, b: a.union(b), parts)


def natural_hits(pool: DataFrame, query: str, embed: Callable[[str], list[float]], k: int) -> DataFrame:
    """(id, score) of a question: its tokens' hits fused; if there are none, the methods nearest to the whole question (0.5, relaxed to 0.3); then
    up to k more whose name has one of its keywords."""
    spark = pool.sparkSession
    tokens = [(r["token"], r["route"]) for r in routed_tokens(spark.createDataFrame([(0, query)], "query_id int, query string")).orderBy("place").collect()]  # a query's words
    found = saved(retrieval.top_k(retrieval.fuse_tokens(token_hits(pool, tokens, embed, k)), k).select("id", "score")) if tokens else None
    if found is None or found.isEmpty():
        found = saved(retrieval.top_k(retrieval.relaxed(retrieval.vector_scores(pool, embed(query), "description_vector")), k).select("id", "score"))
    more = retrieval.keyword_supplement(pool, found, search_keywords(query), "method_name", score=SUPPLEMENT_SCORE)
    return found.union(more.select("id", "score").orderBy("id").limit(k))


def statement_hits(pool: DataFrame, statements: DataFrame, vector: list[float], k: int, lower: float = 0.3) -> DataFrame:
    """(id, score) of the methods (node) of the statements (node, sql_id, embedding) nearest to vector, a method's best statement."""
    near = retrieval.relaxed(retrieval.vector_scores(statements, vector).select("sql_id", "score").distinct(), lower=lower)
    best = retrieval.top_k(near, k, key="sql_id")
    return statements.select(F.col("node").alias("id"), "sql_id").join(F.broadcast(best), "sql_id").join(pool.select("id"), "id", "left_semi").groupBy("id").agg(F.max("score").alias("score"))  # at most k rows


def hybrid_search(
    methods: DataFrame, entries: DataFrame, edges: DataFrame, query: str, vector: list[float] | None = None, projects: list[str] | None = None, language: str | None = None, depth: int = 0, k: int = 20,
    embed: Callable[[str], list[float]] | None = None, statements: DataFrame | None = None,
) -> DataFrame:
    """(id, score) of one query, by its kind.

    Exact kinds and names: an exact search. A question: token routing, vectors by token, fusion, keywords (`natural_hits`). Code: the nearest code
    (0.5, relaxed to 0.3). SQL: the methods of the nearest statements. Hits of an exact kind end the search; others are expanded over edges
    and both lists fused by rank. A query without any result is retried: methods whose name has it, else the nearest descriptions at 0.3.

    embed gives the vector of a text (vector: the same for any). methods then also has embedding, or description_vector and code_vector.
    """
    spark = methods.sparkSession
    pool = of_language(methods if not projects else methods.where(F.col("project").isin(projects)), language)
    embed = embed or (None if vector is None else lambda _: vector)
    for name in ("description_vector", "code_vector"):
        if name not in pool.columns and "embedding" in pool.columns:
            pool = pool.withColumn(name, F.col("embedding"))
    asked = saved(dispatched(spark.createDataFrame([(0, query)], "query_id int, query string")))
    kind, channel = asked.select("kind", "channel").first()
    items = pool.withColumnRenamed("node", "id")
    if channel == "VECTOR":
        if embed is None:
            raise ValueError(f"a query of kind {kind} needs its vector")
        if kind == "SQL_SNIPPET" and statements is not None:
            found = statement_hits(items, statements, embed(query), k)
        elif kind == "NATURAL_LANGUAGE" and vector is None:
            found = natural_hits(items, query, embed, k)
        else:
            by = "description_vector" if kind == "NATURAL_LANGUAGE" else "code_vector"
            found = retrieval.relaxed(retrieval.vector_scores(items, embed(query), by).select("id", "score"))
    else:
        found = exact_hits(asked, pool, entries).select(F.col("node").alias("id"), F.lit(1.0).alias("score"))
        if kind == "METHOD_NAME" and embed is not None:
            found = first_of([found, retrieval.relaxed(retrieval.vector_scores(items, embed(query), "description_vector").select("id", "score"))])
    most = 2 * k if kind == "NATURAL_LANGUAGE" and vector is None else k  # keywords add up to k
    first = saved(retrieval.top_k(found, most).select("id", "score"))
    if first.isEmpty():
        first = saved(retrieval.top_k(items.where(F.contains("method_name", F.lit(query.strip()))).select("id", F.lit(0.0).alias("score")), k))
        if first.isEmpty() and embed is not None:
            first = retrieval.top_k(retrieval.vector_scores(items, embed(query), "description_vector").where("score >= 0.3").select("id", "score"), k)
        return first
    if depth <= 0 or kind in EXACT_KINDS:
        return first
    around = expanded(edges, first.select(F.col("id").alias("seed")), depth).where("seed <> node").groupBy(F.col("node").alias("id")).agg(F.count("*").cast("double").alias("raw"))
    lists = first.select(F.lit("vector").alias("list"), "id", F.col("score").alias("raw")).union(around.select(F.lit("graph"), "id", "raw"))
    return retrieval.top_k(retrieval.fuse(lists, most=k * INDEX_FACTOR), k)
