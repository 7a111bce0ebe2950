"""What a change reaches: entry points, rings, validation, diffs, instrumentation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.logs import FRAMEWORK_PREFIXES
from . import graph
from .lineage import saved

# Depths and caps of the impact ring and of the instrumentation list.
UPSTREAM, DOWNSTREAM, FULL_RING = 3, 2, 20
METHODS_PER_CLASS, METHODS_IN_ALL = 32, 256
# Methods that live as long as the process.
LIFECYCLE_CLASSES = ("Initializer", "Bootstrap", "Application")
LIFECYCLE_METHODS = ("initialize", "init", "start", "run", "onApplicationEvent", "verifyInitialization")
LIFECYCLE_ANYWHERE = ("main", "onApplicationReady", "onContextRefreshed")


def _grams(c: Column, n: int = 3) -> Column:
    """The distinct substrings of n characters; a shorter text itself."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda k: F.substring(c, k, F.lit(n))))


def _holding(asked: DataFrame, m: DataFrame) -> DataFrame:
    """asked (class_name, method_name) with each of m (node, _class, _method) of that method whose class name has the text asked for.

    They meet in the rarest three characters of the text among the classes of that method's name, so a name that many classes have (get, run)
    isn't joined as a whole. Texts of fewer than three characters meet in the name alone.
    """
    wanted = saved(asked.select("class_name", "method_name", F.explode(F.when(F.length("class_name") < 3, F.array(F.lit(""))).otherwise(_grams(F.col("class_name")))).alias("gram")))
    keys = wanted.select(F.col("method_name").alias("_method"), "gram").distinct()
    named = m.join(keys.select("_method").distinct(), "_method", "left_semi")
    placed = saved(named.select("node", "_class", "_method", F.explode(F.array_union(F.array(F.lit("")), _grams(F.col("_class")))).alias("gram")).join(keys, ["_method", "gram"], "left_semi"))
    counts = placed.groupBy(F.col("_method").alias("method_name"), "gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, ["method_name", "gram"], "left").groupBy("class_name", "method_name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    rarest = rarest.where("g.n > 0").select("class_name", "method_name", F.col("method_name").alias("_method"), F.col("g.gram").alias("gram"))
    return rarest.join(placed, ["_method", "gram"]).where(F.contains("_class", "class_name"))


def resolved_entries(asked: DataFrame, methods: DataFrame) -> DataFrame:
    """(ask_id, node, step) of asked (ask_id, class_name, method_name): 1 the exact class, 2 its simple name or an inner class, 3 a class
    whose name has the text asked for; the least node of the first step that finds one. Step 3 is only tried for what is left.

    Only the least node counts, so a class and method (or simple name and method) has one row before it is joined, and a text and method is
    looked for once for all that ask for it.
    """
    of = lambda *by: methods.groupBy(*by, F.col("method_name").alias("_method")).agg(F.min("node").alias("node"))
    asked, m = asked.select("ask_id", "class_name", "method_name"), of(F.col("class_name").alias("_class"))
    same = F.col("method_name") == F.col("_method")
    exact = asked.join(m, same & (F.col("class_name") == F.col("_class"))).select("ask_id", "node", F.lit(1).alias("step"))
    left = asked.join(exact.select("ask_id"), "ask_id", "left_anti")
    outer = of(F.regexp_replace(strings.simple_name(F.col("class_name")), r"\$.*$", "").alias("_simple"))
    simple = left.join(outer, same & (strings.simple_name(F.col("class_name")) == F.col("_simple"))).select("ask_id", "node", F.lit(2).alias("step"))
    left = saved(left.join(simple.select("ask_id"), "ask_id", "left_anti"))
    held = _holding(left.select("class_name", "method_name").distinct(), m).groupBy("class_name", "method_name").agg(F.min("node").alias("node"))
    part = left.join(held, ["class_name", "method_name"]).select("ask_id", "node", F.lit(3).alias("step"))
    return exact.union(simple).union(part).groupBy("ask_id").agg(F.min(F.struct("step", "node")).alias("x")).select("ask_id", "x.node", "x.step")


def root_entries(edges: DataFrame, entries: DataFrame, seeds: DataFrame, depth: int | None = UPSTREAM) -> DataFrame:
    """(seed, entry): entry points (node) that reach a seed within depth steps, itself included if it is one."""
    up = graph.reach(graph.reversed_edges(edges), seeds, depth)
    return up.join(entries.select("node").distinct(), "node", "left_semi").select("seed", F.col("node").alias("entry"))


def entries_reaching(edges: DataFrame, entries: DataFrame, seeds: DataFrame, depth: int | None = UPSTREAM) -> DataFrame:
    """(entry): entry points (node) that reach any of the seeds within depth steps; a node is walked once, whatever the number of seeds."""
    up = graph.reach_once(graph.reversed_edges(edges), seeds, depth)
    return up.join(entries.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("entry"))


def ring_seeds(modified: DataFrame, roots: DataFrame, most: int = FULL_RING) -> DataFrame:
    """(seed): the modified nodes (node), or the roots alone if there are more than `most`."""
    n = modified.select("node").distinct().agg(F.count("*").alias("_n"))
    nodes = modified.select(F.col("node").alias("seed")).distinct().join(F.broadcast(n.where(F.col("_n") <= most))).select("seed")  # one row
    return nodes.union(roots.select("node").distinct().join(F.broadcast(n.where(F.col("_n") > most))).select("node"))


def impact_ring(edges: DataFrame, entries: DataFrame, bridges: DataFrame, modified: DataFrame, roots: DataFrame) -> DataFrame:
    """(side, node, target): UPSTREAM root entries, DOWNSTREAM callees, BRIDGE edges (src, dst, bridge_type) that leave the seeds, and
    CHAIN: the bridges of those targets' own."""
    seeds = saved(ring_seeds(modified, roots))
    up = root_entries(edges, entries, seeds).select(F.lit("UPSTREAM").alias("side"), F.col("entry").alias("node"), F.lit(None).cast("string").alias("target"))
    down = graph.reach_once(edges, seeds, DOWNSTREAM).where("depth > 0").select(F.lit("DOWNSTREAM"), "node", F.lit(None).cast("string"))
    out = saved(bridges.join(seeds, F.col("src") == F.col("seed")).select("src", "dst", "bridge_type").distinct())
    chains = bridges.join(out.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select(F.lit("CHAIN"), "src", F.col("dst").cast("string"))
    return up.distinct().union(down).union(out.select(F.lit("BRIDGE"), "src", F.col("dst").cast("string"))).union(chains).distinct()


def bridge_chains(bridges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """(path, length) of the bridges (src, dst) from the starts (node), a service or topic never twice on one; grows with the number of paths."""
    hops = bridges.select("src", "dst").distinct()
    now = saved(starts.select(F.array("node").alias("path"), "node"))
    out = None
    for length in range(1, max_depth + 1):
        step = now.join(hops, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        now = saved(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")))
        part = now.select("path", F.lit(length).alias("length"))
        out = part if out is None else out.union(part)
        if now.isEmpty():
            break
    return out


def ring_violations(edges: DataFrame, entries: DataFrame, claimed: DataFrame, implementations: DataFrame, modified: DataFrame, depth: int = 10) -> DataFrame:
    """(rule, node): claimed entries (node) that no entry point reaches within depth steps, and implementations that aren't modified."""
    seeds = claimed.select(F.col("node").alias("seed")).where("seed is not null").distinct()
    entered = entries_reaching(edges, entries, seeds, depth)
    lost = seeds.join(entered, F.col("seed") == F.col("entry"), "left_anti").select(F.lit("ENTRY_NOT_REACHABLE").alias("rule"), F.col("seed").alias("node"))
    missing = implementations.select("node").where("node is not null").distinct().join(modified.select("node"), "node", "left_anti")
    return lost.union(missing.select(F.lit("IMPLEMENTATION_NOT_MODIFIED"), "node"))


def entry_relevance(entries: DataFrame, target: Column) -> DataFrame:
    """entries (class_name, method_name, ...) with relevance: DIRECT if the target text has Class#method, else INDIRECT."""
    short = F.when(F.col("class_name").isNull(), F.col("method_name")).when(F.col("method_name").isNull(), strings.simple_name(F.col("class_name"))).otherwise(F.concat(strings.simple_name(F.col("class_name")), F.lit("#"), "method_name"))
    return entries.withColumn("relevance", F.when(F.coalesce(F.contains(target, short), F.lit(False)), "DIRECT").otherwise("INDIRECT"))


def class_of_file(path: Column) -> Column:
    """The class that a source file declares; null for files of other kinds."""
    p = F.regexp_replace(path, r"\\", "/")
    java = F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"src/main/java/(.*)\.java$", 1), "/", "."), r"^$", "")
    python = F.regexp_replace(F.regexp_replace(p, r"\.py$", ""), "/", ".")
    return F.nullif(F.when(p.endswith(".java"), java).when(p.endswith(".py"), python), F.lit(""))


def entries_of_diff(files: DataFrame, methods: DataFrame, edges: DataFrame, entries: DataFrame, depth: int = UPSTREAM) -> DataFrame:
    """(entry, files): entry points that reach a method of a changed class, with how many changed files (file) each stands behind."""
    changed = files.select("file", class_of_file(F.col("file")).alias("class_name")).where("class_name is not null")
    seeds = saved(changed.join(methods.select("class_name", F.col("node").alias("seed")), "class_name").select("file", "seed"))
    found = root_entries(edges, entries, seeds, depth)
    return seeds.join(found, "seed").groupBy("entry").agg(F.countDistinct("file").alias("files"))


def instrumented(edges: DataFrame, methods: DataFrame, entry: DataFrame, depth: int = 5, prefixes: tuple[str, ...] = FRAMEWORK_PREFIXES) -> DataFrame:
    """(class_name, methods): project methods within depth steps of the entries (seed), named as bytecode has it, by depth and node, at
    most 32 of a class and 256 in all; frameworks, constructors, synthetic names and methods that live as long as the process are left out."""
    m = methods.select("node", "class_name", "method_name")
    framework = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("class_name"), p))
    lifecycle = F.col("method_name").isin(*LIFECYCLE_ANYWHERE) | (F.col("class_name").rlike(f"({'|'.join(LIFECYCLE_CLASSES)})$") & F.col("method_name").isin(*LIFECYCLE_METHODS))
    bytecode = F.regexp_replace("class_name", r"(?<=\.)([A-Z]\w*)\.(?=[A-Z])", "$1\\$")  # an outer class is followed by $
    named = graph.reach_once(edges, entry, depth).join(m, "node").where(~framework & ~lifecycle & ~F.startswith("method_name", F.lit("<")))
    named = named.withColumn("class_name", bytecode).where(F.col("class_name").rlike(r"^[A-Za-z_][\w.$]*$") & F.col("method_name").rlike(r"^[A-Za-z_]\w*$"))
    once = named.groupBy("class_name", "method_name").agg(F.min(F.struct("depth", "node")).alias("at"))
    w = Window.partitionBy("class_name").orderBy("at")
    kept = once.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= METHODS_PER_CLASS).orderBy("at", "method_name").limit(METHODS_IN_ALL)
    return kept.groupBy("class_name").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "method_name"))), lambda x: x["method_name"])).alias("methods"))


def consumers(clients: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, client, consumer): of links (src: client, dst: entry) the client calls (node, consumer) that use each entry."""
    return edges.join(entries.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").join(clients.select(F.col("node").alias("src"), "consumer"), "src").select(F.col("dst").alias("entry"), F.col("src").alias("client"), "consumer").distinct()


def implementations(implements: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(iface, impl) of implements (iface, impl) for the interfaces (node)."""
    return implements.join(interfaces.select(F.col("node").alias("iface")).distinct(), "iface", "left_semi").select("iface", "impl").distinct()


def cycle_paths(edges: DataFrame, max_length: int = 6) -> DataFrame:
    """(path, length): simple cycles of at most max_length nodes, closed, each once, from its least node. Only nodes of one strongly
    connected component are walked; the number of cycles may grow exponentially with max_length."""
    members = saved(graph.strongly_connected(edges))
    a = members.select(F.col("node").alias("src"), F.col("component").alias("_a"))
    b = members.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    hops = saved(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst"))
    now = saved(hops.select(F.col("src").alias("first")).distinct().select("first", F.array("first").alias("path"), F.col("first").alias("node")))
    out = None
    for length in range(1, max_length + 1):
        step = now.join(hops, F.col("node") == F.col("src"))
        part = step.where("dst = first").select(F.concat("path", F.array("first")).alias("path"), F.lit(length).alias("length"))
        out = part if out is None else out.union(part)
        now = saved(step.where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("first", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node")))
        if now.isEmpty():
            break
    return out


def walks(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth, n): nodes at the end of walks of up to depth calls, repeats kept as n, the number of walks."""
    now = saved(seeds.select("seed", F.col("seed").alias("node"), F.lit(1).cast("long").alias("n")).groupBy("seed", "node").agg(F.sum("n").alias("n")))
    out = None
    for k in range(1, depth + 1):
        now = saved(now.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).groupBy("seed", F.col("dst").alias("node")).agg(F.sum("n").alias("n")))
        part = now.select("seed", "node", F.lit(k).alias("depth"), "n")
        out = part if out is None else out.union(part)
    return out


def shared_graph(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """(src, dst, depth): edges from the nodes that the seeds reach before max_depth, each with its source's least depth."""
    at = graph.reach_once(edges, seeds, max_depth)
    return edges.select("src", "dst").distinct().join(at.where(F.col("depth") < max_depth).select(F.col("node").alias("src"), "depth"), "src").select("src", "dst", "depth")


def layers(reached: DataFrame) -> DataFrame:
    """(depth, n, nodes) of (node, depth): the node list of each layer, as text in order."""
    return reached.groupBy("depth").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string"))).alias("nodes"))


def neighbours(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """(node): the nodes beside those of centre in their ego net."""
    e = graph.ego_net(edges, centre)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(centre.select("node"), "node", "left_anti")


def flow(edges: DataFrame) -> DataFrame:
    """(source, target, value): links of a flow diagram, edges (src, dst) counted; edges of a node to itself have no place in it."""
    return edges.where("src <> dst").groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.count("*").alias("value"))


def neighbourhood_features(nodes: DataFrame, edges: DataFrame, features: list[str], rounds: int = 2) -> DataFrame:
    """node and for each feature and round the mean over the node's neighbours of the round before (its own if it has none)."""
    hops = saved(graph.undirected(edges))
    now = saved(nodes.select("node", *[F.col(f).cast("double").alias(f) for f in features]))
    out = now
    for k in range(1, rounds + 1):
        mean = hops.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.avg(f).alias(f"_{f}") for f in features])
        now = saved(now.join(mean, "node", "left").select("node", *[F.coalesce(f"_{f}", f).alias(f) for f in features]))
        out = out.join(now.select("node", *[F.col(f).alias(f"{f}_{k}") for f in features]), "node")
    return out
