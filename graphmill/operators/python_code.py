"""What Python facts mean over files: routes with the prefixes of what includes them, tasks, outgoing calls, resolved calls.

A router's or url module's prefixes come by joins from includer to included, a level a round until nothing new is included, so that files
may include each other over any number of levels (a cycle ends, as an object is never included in itself again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .java_code import _value, _values
from .lineage import saved

# frameworks' and libraries' names.
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
ROUTERS = {"FastAPI": "prefix", "APIRouter": "prefix", "Flask": "url_prefix", "Blueprint": "url_prefix"}
URL_FUNCTIONS = ("path", "re_path", "url")
HTTP_MODULES, HTTP_OBJECTS = ("requests", "httpx", "aiohttp"), ("session", "client")
LIST_ACTIONS = ("list", "create")
#: Levels of inclusion that are followed.
DEPTH = 20


def _of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def _last(c: Column) -> Column:
    return F.regexp_extract(c, r"([^.]+)$", 1)


def full_names(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (module, written and others) with full: written with its first name as an import of the module names it, else as the module's own."""
    imports = _of(facts, "import").groupBy("module", F.col("name").alias("_head")).agg(F.max_by("target", "place").alias("_import"))
    head = F.substring_index("written", ".", 1)
    rest = F.expr("substring(written, length(substring_index(written, '.', 1)) + 1)")
    out = wanted.withColumn("_head", head).join(imports, ["module", "_head"], "left")
    return out.withColumn("full", F.concat(F.coalesce("_import", F.concat_ws(".", F.nullif("module", F.lit("")), "_head")), rest)).drop("_head", "_import")


def _slashed(*parts: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.concat_ws("/", *[F.coalesce(p, F.lit("")) for p in parts]), "/+", "/"), "^/", ""))


def prefixes(nodes: DataFrame, includes: DataFrame) -> DataFrame:
    """(node, prefix): nodes with their own prefix, after the prefixes of all chains of includes (parent, child, prefix); a node that nothing includes
    has its own alone."""
    own = nodes.select("node", "prefix").distinct()
    inside = includes.join(own.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi")
    now = saved(own.join(inside.select(F.col("child").alias("node")), "node", "left_anti").select("node", "prefix", F.array("node").alias("seen")))
    out = now
    for _ in range(DEPTH):
        step = now.join(includes.select(F.col("parent").alias("node"), "child", F.col("prefix").alias("_by")), "node").where(~F.array_contains("seen", F.col("child")))
        step = step.withColumn("_at", F.concat("prefix", F.lit("/"), F.coalesce("_by", F.lit("")))).drop("node", "prefix")
        step = step.join(own.select(F.col("node").alias("child"), F.col("prefix").alias("_own")), "child")
        now = saved(step.select(F.col("child").alias("node"), F.concat_ws("/", "_at", "_own").alias("prefix"), F.concat("seen", F.array("child")).alias("seen")))
        if now.isEmpty():
            break
        out = out.union(now)
    return out.select("node", _slashed(F.col("prefix")).alias("prefix")).distinct()


def decorated_routes(facts: DataFrame) -> DataFrame:
    """(module, function, method, path, framework): FastAPI and Flask routes. A route's router is looked up by its full name, so that prefixes of
    routers, include_router and register_blueprint in other files count."""
    routers = _of(facts, "assign").where(_last(F.col("target")).isin(*ROUTERS))
    nodes = routers.select(F.concat_ws(".", F.nullif("module", F.lit("")), "name").alias("node"), F.coalesce(_value(F.col("values"), "prefix", "url_prefix"), F.lit("")).alias("prefix"), F.when(_last(F.col("target")).isin("Flask", "Blueprint"), "flask").otherwise("fastapi").alias("framework"))
    mounts = _of(facts, "call").where(F.col("target").rlike(r"\.(include_router|register_blueprint)$"))
    mounts = mounts.select("module", F.regexp_replace("target", r"\.\w+$", "").alias("written"), _value(F.col("values"), "0", "router", "blueprint").alias("_child"), F.coalesce(_value(F.col("values"), "prefix", "url_prefix"), F.lit("")).alias("prefix"))
    parents = full_names(facts, mounts.where("_child is not null")).withColumnRenamed("full", "parent")
    children = full_names(facts, parents.select("module", "parent", "prefix", F.col("_child").alias("written"))).select("parent", F.col("full").alias("child"), "prefix")
    whole = prefixes(nodes, children)
    marks = _of(facts, "decorator").where(F.col("target").rlike(r"\.\w+$"))
    verb = F.lower(_last(F.col("target")))
    asked = F.transform(_values(F.col("values"), "methods"), lambda v: F.upper(v))
    methods = F.when(verb == "route", F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("GET")))).when(verb == "api_route", asked).when(verb.isin(*VERBS), F.array(F.upper(verb)))
    routes = marks.select("module", F.col("name").alias("function"), F.explode(methods).alias("method"), F.coalesce(_value(F.col("values"), "0", "path", "rule"), F.lit("")).alias("own"), F.regexp_replace("target", r"\.\w+$", "").alias("written"), (verb == "route").alias("is_flask"), F.size("values").alias("_n"))
    routes = full_names(facts, routes.where("_n > 0")).join(whole.withColumnRenamed("node", "full"), "full", "left").join(nodes.select(F.col("node").alias("full"), "framework"), "full", "left")
    return routes.select("module", "function", "method", _slashed(F.col("prefix"), F.col("own")).alias("path"), F.coalesce("framework", F.when(F.col("is_flask"), "flask").otherwise("fastapi")).alias("framework")).distinct()


def django_routes(facts: DataFrame) -> DataFrame:
    """(module, view, method, path): urls with the prefixes of all modules that include theirs. A view function's method is GET; a class has a row a
    method it defines; a registered view set has its list actions at the prefix and the others under /{pk}. <int:x> and (?P<x>...) become {x}."""
    entries = _of(facts, "call").where("owner = ''").where(F.col("module").rlike(r"(^|\.)urls$") & _last(F.col("target")).isin(*URL_FUNCTIONS))
    entries = entries.select("module", F.coalesce(_value(F.col("values"), "0", "route", "regex"), F.lit("")).alias("own"), _value(F.col("values"), "1", "view").alias("view"))
    inside = F.regexp_extract("view", r"^(?:\w+\.)*include\(([\w.]+)", 1)
    modules = facts.where(F.col("module").rlike(r"(^|\.)urls$")).select(F.col("module").alias("node"), F.lit("").alias("prefix")).distinct()
    whole = prefixes(modules, entries.where(inside != "").select(F.col("module").alias("parent"), inside.alias("child"), F.regexp_replace("own", r"[\^$]", "").alias("prefix")))
    views = entries.where(inside == "").select("module", "own", F.regexp_replace(F.regexp_replace("view", r"\.as_view\(.*$", ""), r"\(.*$", "").alias("written"))
    registered = _of(facts, "call").where(F.col("module").rlike(r"(^|\.)urls$") & F.col("target").rlike(r"\.register$")).select("module", _value(F.col("values"), "0", "prefix").alias("own"), _value(F.col("values"), "1", "viewset").alias("written"))
    named = full_names(facts, views.withColumn("_set", F.lit(False)).union(registered.withColumn("_set", F.lit(True))).where("written is not null"))
    functions = _of(facts, "function").select("module", "name")
    of_class = functions.where(F.col("name").contains(".")).select(F.concat_ws(".", F.nullif("module", F.lit("")), F.regexp_replace("name", r"\.\w+$", "")).alias("full"), _last(F.col("name")).alias("action"))
    actions = {"list": "GET", "retrieve": "GET", "create": "POST", "update": "PUT", "partial_update": "PATCH", "destroy": "DELETE"}
    met = named.join(of_class, "full", "left")
    verb = F.coalesce(*[F.when(F.col("action") == a, v) for a, v in actions.items()])
    method = F.when(F.col("_set"), verb).when(F.col("action").isin(*VERBS), F.upper("action")).when(F.col("action").isNull(), F.lit("GET"))
    met = met.withColumn("method", method).where("method is not null")
    suffix = F.when(F.col("_set") & ~F.col("action").isin(*LIST_ACTIONS), F.lit("/{pk}")).otherwise(F.lit(""))
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace("own", r"\(\?P<(\w+)>[^)]*\)", "{$1}"), r"<(?:\w+:)?(\w+)>", "{$1}"), r"[\^$]", "")
    rows = met.select("module", F.col("full").alias("view"), "method", F.concat(own, suffix).alias("own")).join(whole.withColumnRenamed("node", "module"), "module")
    return rows.select("module", "view", "method", _slashed(F.col("prefix"), F.col("own")).alias("path")).distinct()


def celery_tasks(facts: DataFrame) -> DataFrame:
    """(module, function, task): the name given, else module.function."""
    marks = _of(facts, "decorator").where(F.col("target").rlike(r"^(\w+\.task|(\w+\.)?shared_task)$"))
    return marks.select("module", F.col("name").alias("function"), F.coalesce(_value(F.col("values"), "name"), F.concat_ws(".", "module", "name")).alias("task")).distinct()


def http_calls(facts: DataFrame) -> DataFrame:
    """(module, function, method, url, line): calls of the HTTP libraries, and of objects called session or client in modules that import one."""
    calls = _of(facts, "call").where(F.col("target").rlike(rf"\.({'|'.join(VERBS)}|request)$"))
    users = _of(facts, "import").where(F.substring_index("target", ".", 1).isin(*HTTP_MODULES)).select("module").distinct()
    on = F.regexp_replace("target", r"\.\w+$", "")
    calls = calls.select("module", "owner", on.alias("written"), _last(F.col("target")).alias("verb"), "values", "line")
    named = full_names(facts, calls).join(users.withColumn("_user", F.lit(True)), "module", "left")
    ok = F.substring_index("full", ".", 1).isin(*HTTP_MODULES) | (F.coalesce("_user", F.lit(False)) & F.lower(_last(F.col("written"))).rlike(f"({'|'.join(HTTP_OBJECTS)})$"))
    request = F.col("verb") == "request"
    url = F.when(request, _value(F.col("values"), "1", "url")).otherwise(_value(F.col("values"), "0", "url"))
    method = F.when(request, F.upper(F.coalesce(_value(F.col("values"), "0", "method"), F.lit("REQUEST")))).otherwise(F.upper("verb"))
    return named.where(ok & url.isNotNull()).select("module", F.col("owner").alias("function"), method.alias("method"), url.alias("url"), "line")


def queue_calls(facts: DataFrame) -> DataFrame:
    """(module, function, library, topic, line): send_task, a producer's send, publish in modules that import the library."""
    calls = _of(facts, "call").select("module", F.col("owner").alias("function"), _last(F.col("target")).alias("verb"), _value(F.col("values"), "0", "topic", "name", "routing_key").alias("topic"), F.col("target").contains(".").alias("on"), "line")
    kafka = _of(facts, "import").where(F.substring_index("target", ".", 1).isin("kafka", "confluent_kafka", "aiokafka")).select("module").distinct().withColumn("_kafka", F.lit(True))
    pika = _of(facts, "import").where(F.substring_index("target", ".", 1).isin("aio_pika", "pika")).select("module").distinct().withColumn("_pika", F.lit(True))
    met = calls.where("on and topic is not null").join(kafka, "module", "left").join(pika, "module", "left")
    library = F.when(F.col("verb") == "send_task", "celery").when(F.col("verb").isin("send", "produce", "send_and_wait") & F.col("_kafka"), "kafka").when(F.col("verb").isin("publish", "basic_publish") & F.col("_pika"), "aio_pika")
    return met.withColumn("library", library).where("library is not null").select("module", "function", "library", "topic", "line")


def python_calls(facts: DataFrame) -> DataFrame:
    """(src, dst, line): calls whose full name is a function or class of the facts; self.x is a method of the class, or of a base class that has it."""
    functions = _of(facts, "function").select(F.concat_ws(".", F.nullif("module", F.lit("")), "name").alias("full")).distinct()
    classes = _of(facts, "class").select("module", "name", F.concat_ws(".", F.nullif("module", F.lit("")), "name").alias("full"), "values")
    calls = saved(_of(facts, "call").where("owner <> ''").select("module", "owner", F.concat_ws(".", F.nullif("module", F.lit("")), "owner").alias("src"), F.col("target").alias("written"), "line"))
    plain = full_names(facts, calls.where(~F.col("written").rlike(r"^(self|cls)\."))).join(functions, "full", "left_semi").select("src", F.col("full").alias("dst"), "line")
    made = full_names(facts, calls.where(~F.col("written").rlike(r"^(self|cls)\."))).withColumn("full", F.concat("full", F.lit(".__init__"))).join(functions, "full", "left_semi").select("src", F.col("full").alias("dst"), "line")
    own = calls.where(F.col("written").rlike(r"^(self|cls)\.\w+$")).select("src", "line", _last(F.col("written")).alias("method"), F.regexp_replace("src", r"\.\w+$", "").alias("cls"))
    bases = full_names(facts, classes.select("module", F.col("full").alias("cls"), F.posexplode("values").alias("k", "written"))).select("cls", "k", F.col("full").alias("base"))
    now, out = saved(own.withColumn("at", F.col("cls")).drop("cls")), plain.union(made)
    for _ in range(DEPTH):  # up the bases until one has the method
        here = now.withColumn("full", F.concat("at", F.lit("."), "method"))
        out = out.union(here.join(functions, "full", "left_semi").select("src", F.col("full").alias("dst"), "line"))
        left = here.join(functions, "full", "left_anti").drop("full")
        now = saved(left.join(bases.withColumnRenamed("cls", "at"), "at").select("src", "line", "method", F.col("base").alias("at")).distinct())
        if now.isEmpty():
            break
    return out.distinct()
