"""What frontend facts mean over files: calls of the server, routes, and which components call what through which modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

# Objects that send requests, and their methods.
SENDERS, VERBS = ("request", "axios", "http", "$http", "service", "client"), ("get", "post", "put", "delete", "patch", "head")


def _of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def _file(path: Column) -> Column:
    """A file's path as imports name it."""
    return F.regexp_replace(path, r"(/index)?\.(ts|js|tsx|jsx|vue|mjs)$", "")


def _node(path: Column, function: Column) -> Column:
    return F.concat(_file(path), F.lit("#"), function)


def api_clients(facts: DataFrame) -> DataFrame:
    """(path, function, method, url, component, line): request.get(url) and the like, and fetch (GET unless its options say else). component is the
    file's name where that is a .vue file, else null."""
    calls = _of(facts, "call").where((F.size("values") > 0) & F.col("values")[0].rlike(r"^(/|https?:|\$\{)"))
    last, before = F.regexp_extract("target", r"([^.]+)$", 1), F.regexp_extract("target", r"([^.]+)\.[^.]+$", 1)
    option = F.upper(F.regexp_extract(F.coalesce(F.get("values", F.lit(1)), F.lit("")), r"method:['\"`](\w+)", 1))
    method = F.when(F.col("target").isin("fetch", "window.fetch"), F.coalesce(F.nullif(option, F.lit("")), F.lit("GET"))).when(before.isin(*SENDERS) & last.isin(*VERBS), F.upper(last))
    component = F.when(F.endswith("path", F.lit(".vue")), F.regexp_extract("path", r"([^/]+)\.vue$", 1))
    return calls.withColumn("method", method).where("method is not null").select("path", F.col("owner").alias("function"), "method", F.col("values")[0].alias("url"), component.alias("component"), "line")


def frontend_routes(facts: DataFrame) -> DataFrame:
    """(path, component): the route tables of files with router in their path; a component is the name of its file or what it is imported from."""
    routes = _of(facts, "route").where("path like '%router%'").select(F.col("path").alias("file"), F.col("values")[0].alias("path"), "target")
    imports = _of(facts, "import").select(F.col("path").alias("file"), F.col("name").alias("target"), F.regexp_replace("target", "#.*$", "").alias("_from")).dropDuplicates(["file", "target"])
    whole = F.coalesce("_from", "target")
    return routes.join(imports, ["file", "target"], "left").select("path", F.regexp_extract(whole, r"([^/]+)$", 1).alias("component"))


def function_calls(facts: DataFrame) -> DataFrame:
    """(src, dst): calls between functions as file#function: of the file itself (f or this.f), or of what an import names (f, or m.f of a module m)."""
    calls = _of(facts, "call").select("path", "owner", F.regexp_replace("target", r"^this\.", "").alias("target"))
    head, rest = F.substring_index("target", ".", 1), F.regexp_extract("target", r"^[^.]+\.([^.]+)$", 1)
    imports = _of(facts, "import").where("name <> ''").select("path", F.col("name").alias("_head"), F.col("target").alias("_import"))
    met = calls.withColumn("_head", head).join(imports, ["path", "_head"])
    whole = F.endswith("_import", F.lit("#*"))
    named = F.when(whole & (rest != ""), F.concat(F.regexp_replace("_import", r"\*$", ""), rest)).when(~whole & ~F.contains("target", F.lit(".")), F.col("_import"))
    abroad = met.select(_node(F.col("path"), F.col("owner")).alias("src"), named.alias("dst")).where("dst is not null")
    functions = _of(facts, "function").select(_node(F.col("path"), F.col("name")).alias("dst")).distinct()
    here = calls.select(_node(F.col("path"), F.col("owner")).alias("src"), _node(F.col("path"), F.col("target")).alias("dst")).join(functions, "dst", "left_semi").select("src", "dst")
    return abroad.union(here).where("src <> dst").distinct()


def component_clients(facts: DataFrame, depth: int = 10) -> DataFrame:
    """(component, method, url): what a .vue file calls on the server, itself or by functions of other files, up to depth calls away."""
    inside = facts.where(F.endswith("path", F.lit(".vue")) & F.col("kind").isin("call", "function"))
    nodes = inside.select(F.regexp_extract("path", r"([^/]+)\.vue$", 1).alias("component"), _node(F.col("path"), F.when(F.col("kind") == "function", F.col("name")).otherwise(F.col("owner"))).alias("seed")).distinct()
    clients = api_clients(facts).select(_node(F.col("path"), F.col("function")).alias("node"), "method", "url").distinct()
    reached = graph.reach(function_calls(facts), nodes.select("seed").distinct(), depth).select("seed", "node")
    return nodes.join(reached, "seed").join(clients, "node").select("component", "method", "url").distinct()
