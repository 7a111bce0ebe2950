"""Graph operators on edge lists (src, dst): frontier loops of joins, each round a checkpoint, until no new node is reached.

Rounds join the frontier with the edges on the node (an equality join; adaptive execution broadcasts a small frontier by its measured
size) and drop what is known with an anti-join. Nothing is collected but one count a round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import dropped, saved

#: Rounds of a loop whose results are read one by one before they are written as one.
COMPACTED = 8


class Rounds:
    """What a loop has found: a checkpoint a round, made one every COMPACTED rounds, so that early rounds aren't rewritten each time."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > COMPACTED:
            whole = saved(self.all())
            dropped(*self.parts[:-1])  # the last one is the frontier, which is read once more
            self.parts = [whole]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.union(p)
        return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(reversed_edges(edges)).distinct()


def _hops(edges: DataFrame, max_depth: int | None) -> DataFrame:
    """Distinct edges between nodes, worked out once where several rounds read them."""
    hops = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    return hops if max_depth is not None and max_depth < 2 else saved(hops)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) of every node within max_depth steps of a seed, its own at depth 0; depth is the least. seeds: (seed)."""
    hops = _hops(edges, max_depth)
    frontier = saved(seeds.select("seed").where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    known, depth = Rounds(frontier), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(hops, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(known.all(), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known.add(frontier)
    return known.all()


def reach_once(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): as reach from all seeds at once, so that a node counts once whatever the number of seeds."""
    hops = _hops(edges, max_depth)
    frontier = saved(seeds.select(F.col("seed").alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)))
    known, depth = Rounds(frontier), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(known.all(), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known.add(frontier)
    return known.all()


def chain_edges(edges: DataFrame, reached: DataFrame, max_depth: int) -> DataFrame:
    """Distinct edges on walks of at most max_depth steps from the seeds of reached (node, depth)."""
    return edges.select("src", "dst").distinct().join(reached.where(F.col("depth") < max_depth).select(F.col("node").alias("src")).distinct(), "src").select("src", "dst")


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(callers, callees, total): nodes that reach the seeds, and that they reach, the seeds left out."""
    up = reach_once(reversed_edges(edges), seeds, min(max_depth, 10)).where("depth > 0")
    down = reach_once(edges, seeds, min(max_depth, 10)).where("depth > 0")
    both = up.select(F.lit(1).alias("up"), F.lit(0).alias("down")).union(down.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("callers"), F.coalesce(F.sum("down"), F.lit(0)).alias("callees")).withColumn("total", F.col("callers") + F.col("callees"))


def shortest_path(edges: DataFrame, source: object, target: object, max_depth: int | None = None) -> DataFrame:
    """(path, length): one shortest directed path, the least by node order; no row if there is none, or none of max_depth steps or fewer."""
    hops = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    now = saved(edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"), F.array(F.lit(source).cast(kind)).alias("path")))
    known, depth = Rounds(now.select("node")), 0
    while max_depth is None or depth <= max_depth:
        depth += 1
        found = now.where(F.col("node") == F.lit(target).cast(kind))
        if not found.isEmpty():
            return found.select("path", (F.size("path") - 1).alias("length"))
        step = now.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        now = saved(step.join(known.all(), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if now.isEmpty():
            break
        known.add(saved(now.select("node")))
    return now.where("false").select("path", (F.size("path") - 1).alias("length"))


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b and edges both ways, once."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    back = reversed_edges(e)
    return e.where("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): components of two nodes or more, or one with a loop, named by their least node.

    Colouring: nodes without an incoming or outgoing edge are trimmed away, the least node id spreads forward as a colour until it
    settles, and of each colour those that reach its namesake within the colour are one component. They leave, and the rest goes on.
    """
    e = saved(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left = saved(e.where("src <> dst"))
    found = None
    while True:
        size = left.count()
        while size:  # trim
            left = saved(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if (now := left.count()) == size:
                break
            size = now
        if not size:
            break
        colour = saved(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("pushed"))
            after = saved(colour.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", F.coalesce("pushed", "colour")).alias("colour"), (F.col("pushed") < F.col("colour")).alias("moved")))
            settled = after.where("moved").isEmpty()
            colour = after.select("node", "colour")
            if settled:
                break
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", "a")
        inside = saved(inside)
        edge_of = saved(colour.where("node = colour"))
        back = Rounds(edge_of)
        while True:  # back from each namesake, inside its colour
            step = inside.join(edge_of, (F.col("dst") == F.col("node")) & (F.col("a") == F.col("colour"))).select(F.col("src").alias("node"), "colour").distinct()
            edge_of = saved(step.join(back.all(), ["node", "colour"], "left_anti"))
            if edge_of.isEmpty():
                break
            back.add(edge_of)
        reached = saved(back.all())
        sized = reached.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        part = reached.join(sized, "colour").select("node", F.col("colour").alias("component"))
        found = part if found is None else found.union(part)
        gone = reached.select("node")
        left = saved(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return loops
    found = saved(found)
    return found.union(loops.join(found, "node", "left_anti"))


def classify_cycles(members: DataFrame, layers: DataFrame) -> DataFrame:
    """(component, size, kind): CROSS_LAYER if its members have more than one layer, SAME_LAYER if one, MODULE if none. layers: (node, layer)."""
    known = members.join(layers, "node", "left")
    kinds = known.groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("layer").alias("n"))
    return kinds.select("component", "size", F.when(F.col("n") > 1, "CROSS_LAYER").when(F.col("n") == 1, "SAME_LAYER").otherwise("MODULE").alias("kind"))


def ego_net(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """(src, dst) edges that touch a node of centre (node)."""
    e = edges.select("src", "dst").distinct()
    return e.join(centre.select(F.col("node").alias("src")), "src", "left_semi").union(e.join(centre.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")).distinct()


def call_tree(edges: DataFrame, root: object, max_depth: int = 5) -> DataFrame:
    """(path, node, depth): simple paths from root, a node never twice on one; grows with the number of paths, so depth is bounded."""
    hops = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType
    now = saved(edges.sparkSession.range(1).select(F.array(F.lit(root).cast(kind)).alias("path"), F.lit(root).cast(kind).alias("node"), F.lit(0).alias("depth")))
    out = now
    for depth in range(1, max_depth + 1):
        step = now.join(hops, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        now = saved(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(depth).alias("depth")))
        if now.isEmpty():
            break
        out = out.union(now)
    return out


def depth_histogram(reached: DataFrame) -> DataFrame:
    return reached.groupBy("depth").agg(F.count("*").alias("n"))


def _cycle_roots(linked: DataFrame) -> DataFrame:
    """(trace_id, span_id): the least span of each cycle of parents. linked: (trace_id, span_id, parent), each span in a cycle or below one.

    By doubling: after k rounds each span knows the span 2^k steps above it and the least one on the way there. Once 2^k is the number of
    spans or more, the span above lies on the cycle, and for spans on it the way is the whole cycle.
    """
    now, steps, n = saved(linked.select("trace_id", "span_id", F.col("parent").alias("up"), F.least("span_id", "parent").alias("least"))), 1, linked.count()
    while steps < n:
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        now = saved(now.join(above, ["trace_id", "up"]).select("trace_id", "span_id", F.col("_up").alias("up"), F.least("least", "_least").alias("least")))
        steps *= 2
    on_cycle = now.select("trace_id", F.col("up").alias("span_id")).distinct()
    return now.join(on_cycle, ["trace_id", "span_id"], "left_semi").where("least = span_id").select("trace_id", "span_id")


def span_tree(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent, depth): parents inside the trace; a span whose parent is missing is a root, at depth 0.

    A span is there once however many rows it has (the least parent of its trace counts, a missing one last). Where parents form a cycle, its least
    span is a root too, without a parent. Rows without a trace or span id are left out.
    """
    s = saved(spans.where("trace_id is not null and span_id is not null").select("trace_id", "span_id", "parent_span_id").distinct())
    own = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("parent")).distinct()
    linked = saved(s.join(own, ["trace_id", "parent_span_id"], "left").groupBy("trace_id", "span_id").agg(F.min("parent").alias("parent")))

    def below(roots: DataFrame) -> DataFrame:
        now, depth = roots.select("trace_id", "span_id", F.lit(None).cast(linked.schema["parent"].dataType).alias("parent")).withColumn("depth", F.lit(0)), 0
        out = now
        while True:
            depth += 1
            above = now.select("trace_id", F.col("span_id").alias("parent"))
            step = linked.join(above, ["trace_id", "parent"]).join(roots.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")
            now = saved(step.select("trace_id", "span_id", "parent").withColumn("depth", F.lit(depth)))
            if now.isEmpty():
                return out
            out = out.union(now)

    tree = below(linked.where("parent is null"))
    looped = saved(linked.join(tree, ["trace_id", "span_id"], "left_anti"))
    return tree if looped.isEmpty() else tree.union(below(saved(_cycle_roots(looped))))


def _louvain(pdf: pd.DataFrame, resolution: float, most: int, least: int) -> pd.DataFrame:
    weight: dict = {}
    for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        if a != b:
            weight.setdefault(a, {})[b] = weight.setdefault(a, {}).get(b, 0.0) + w
            weight.setdefault(b, {})[a] = weight.setdefault(b, {}).get(a, 0.0) + w
    nodes = sorted(weight)
    place = {v: v for v in nodes}
    level = {v: dict(weight[v]) for v in nodes}
    total = sum(sum(x.values()) for x in level.values()) or 1.0
    while True:
        names = sorted(level)
        rank = {v: k for k, v in enumerate(names)}
        degree = {v: sum(level[v].values()) for v in names}
        home, load, moved = {v: v for v in names}, dict(degree), False
        for _ in range(50):
            changed = False
            for v in names:  # a fixed order, so runs agree
                load[home[v]] -= degree[v]
                near: dict = {}
                for u, w in level[v].items():
                    if u != v:
                        near[home[u]] = near.get(home[u], 0.0) + w
                near.setdefault(home[v], 0.0)
                best = max(near, key=lambda c: (near[c] - resolution * degree[v] * load.get(c, 0.0) / total, c == home[v], -rank[c]))
                load[best] = load.get(best, 0.0) + degree[v]
                if best != home[v]:
                    home[v], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        place = {v: home[c] for v, c in place.items()}
        merged: dict = {}
        for v in names:
            for u, w in level[v].items():
                row = merged.setdefault(home[v], {})
                row[home[u]] = row.get(home[u], 0.0) + w
        level = merged
    while True:  # small communities, then the smallest while there are too many, join the neighbour that they touch most
        size = pd.Series(place).value_counts()
        order = sorted(size.index, key=lambda c: (size[c], str(c)))
        small = [c for c in order if size[c] < least] or (order[:1] if len(order) > most else [])
        for c in small:
            touch: dict = {}
            for v in (x for x in nodes if place[x] == c):
                for u, w in weight[v].items():
                    if place[u] != c:
                        touch[place[u]] = touch.get(place[u], 0.0) + w
            if touch or len(order) > most:
                to = max(touch, key=lambda x: (touch[x], str(x))) if touch else order[1]
                place = {v: to if x == c else x for v, x in place.items()}
                break
        else:
            break
    name = {c: k for k, c in enumerate(sorted(set(place.values()), key=str))}
    return pd.DataFrame({"project": pdf["project"].iloc[0] if len(pdf) else None, "node": nodes, "community": [name[place[v]] for v in nodes]})


def louvain(edges: DataFrame, resolution: float = 0.5, most: int = 20, least: int = 5) -> DataFrame:
    """(project, node, community) of weighted edges (project, src, dst, weight): modularity by local moves in a fixed order, at most 50
    passes a level, ties to the present community, then to the least name; communities under `least` nodes merged, at most `most` of
    them. A project's graph is one group, so it must fit a task."""
    kind = edges.schema["src"].dataType.simpleString()
    project = edges.schema["project"].dataType.simpleString()
    run = lambda pdf: _louvain(pdf.sort_values(["src", "dst"]), resolution, most, least)
    summed = edges.groupBy("project", "src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    return summed.groupBy("project").applyInPandas(run, f"project {project}, node {kind}, community int")


def community_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(drift): share of the nodes of both whose community differs."""
    a, b = before.select("node", F.col("community").alias("a")), after.select("node", F.col("community").alias("b"))
    return a.join(b, "node").agg(F.coalesce(F.avg((F.col("a") != F.col("b")).cast("double")), F.lit(0.0)).alias("drift"))


def domain_confidence(members: DataFrame) -> DataFrame:
    """(domain, confidence): largest community share of a domain's classes, 0.5 if it has none. members: (domain, community)."""
    n = members.groupBy("domain", "community").agg(F.count("community").alias("n"))
    return n.groupBy("domain").agg(F.when(F.sum("n") > 0, F.max("n") / F.sum("n")).otherwise(0.5).alias("confidence"))


def greedy_batches(sizes: DataFrame, most: int = 80_000) -> DataFrame:
    """(grp, item, batch) of (grp, item, size): in item order, a new batch when the next would overflow. A group is one task."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        batch, held, out = 0, 0, []
        for s in pdf["size"]:
            if held and held + s > most:
                batch, held = batch + 1, 0
            held += s
            out.append(batch)
        return pd.DataFrame({"grp": pdf["grp"], "item": pdf["item"], "batch": out})

    kinds = {c: sizes.schema[c].dataType.simpleString() for c in ("grp", "item")}
    return sizes.groupBy("grp").applyInPandas(cut, f"grp {kinds['grp']}, item {kinds['item']}, batch int")


def consecutive(rows: DataFrame, bucket: str, order: list[str], value: str) -> DataFrame:
    """rows with following: value of the next row in the order (bucket, *order), found without one global sort: inside a bucket by a
    window, across buckets by the first row of the next one that has rows."""
    w = Window.partitionBy(bucket).orderBy(*order)
    rows = rows.withColumn("_next", F.lead(F.struct(value)).over(w))
    firsts = rows.groupBy(bucket).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    heads = firsts.select(F.col(bucket).alias("_b"), F.lead("_first").over(Window.orderBy(bucket)).alias("_after"))  # a row a bucket
    return rows.join(heads, F.col(bucket) == F.col("_b")).withColumn("following", F.when(F.col("_next").isNotNull(), F.col(f"_next.{value}")).otherwise(F.col("_after"))).drop("_next", "_b", "_after")


