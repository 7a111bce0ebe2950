"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], a broken line of (t, weight) points that the caller may give. A source
of target T words has demanded T * W(t) / W(1) words by time t, W the schedule's integral. A document whose words begin after c words of
its source is therefore due at the t that solves T W(t) / W(1) = c: demand inverted gives its training position, and documents are
range-sorted by position.

Prefix sums inside a source are split: documents hash into sqrt(n) ranges of a source, ranges are summed, and only a range is ordered
by one task. A source that holds a third of all rows is thus spread over all tasks. Sources are numbered by a range sort, and the level
that shares the excess is found by aggregates, so their number isn't bounded by one task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, numbered, saved, without_clashes
from .sharding import unit_range

#: So many sources at most are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000

Schedule = tuple[tuple[float, float], ...]
#: Taken in turn by sources without a schedule of their own: early, even, late.
SCHEDULES: tuple[Schedule, ...] = (((0, 1.5), (1, 0.5)), ((0, 1.0), (1, 1.0)), ((0, 0.5), (1, 1.5)))


def word_count(text: Column) -> Column:
    """Number of words of a text, JVM-side; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows (source, source_size, n, turn, weight, target) of rows (source, size).

    Sources by code point, null last, take the weights in turn and share `share` times all words by weight. A target stops at cap times
    its source's size; the excess goes to the others by weight until none is above: sum(min(cap * size, weight * level)) = share * all.
    The level rises from step to step as more sources stop, and each step is one aggregate over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    per = saved(per)
    goal = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    most, level, stopped = F.col("source_size") * cap, 0.0, -1
    while True:
        stops = most < F.col("weight") * level
        n, full, free = per.agg(F.count(F.when(stops, 1)), F.sum(F.when(stops, most).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (goal - full) / free
    return per.withColumn("target", F.when(F.lit(not free), most).otherwise(F.least(most, F.col("weight") * level)).cast("double"))


def _pieces(schedule: Schedule) -> Column:
    """The straight pieces of a schedule whose integral is made 1: where each starts, its weight there, its slope and the integral so far."""
    total = sum((w + v) / 2 * (u - t) for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False))
    if schedule[0][0] != 0 or schedule[-1][0] != 1 or total <= 0 or any(u <= t or min(w, v) < 0 for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False)):
        raise ValueError("a schedule runs from t = 0 to 1 over weights that are not negative and not all zero")
    out, done = [], 0.0
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        out.append(F.struct(*[F.lit(float(x)).alias(n) for n, x in (("t", t), ("w", w / total), ("rise", (v - w) / (u - t) / total), ("done", done))]))
        done += (w + v) / 2 * (u - t) / total
    return F.array(*out)


def demand_time(part: Column, pieces: Column) -> Column:
    """The t by which a share of all demand is there: W(t) = part, W the integral of the schedule."""
    at = F.element_at(F.filter(pieces, lambda p: p["done"] <= part), -1)
    left = part - at["done"]
    speed = at["w"] + F.sqrt(F.greatest(F.lit(0.0), at["w"] * at["w"] + 2 * at["rise"] * left))
    return F.least(F.lit(1.0), at["t"] + F.when(speed > 0, 2 * left / speed).otherwise(0.0))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 29, schedules: tuple[Schedule, ...] = SCHEDULES, own: dict[str | None, Schedule] | None = None, whole: bool = False) -> DataFrame:
    """Rows of docs (which has doc_id, source and size long) with source_size, target, copies int, taken long and positions array<double>.

    Documents of a source are passed through in a random order that a hash of doc_id fixes, as often as the target asks. The last pass
    stops at the target, rounded to a word, so that one document of a source may be taken in part; with whole, it stops at the
    document boundary nearest to the target, and every document is taken whole, 0 to ceil(cap) times. positions has the due time of
    each copy, in [0, 1]: `own` has schedules of sources by name, other sources take those of `schedules` in turn.

    Null source: a source of its own, last in order. Size 0: taken 0 words (and as many copies as its neighbours). Equal doc_ids are
    kept apart by the size and then count as ties in any order. Empty table: no rows. Columns of docs called source_size, target,
    copies, taken or positions, or like this operator's own that begin with _, come back with _in added to their name.
    """
    docs = without_clashes(docs, ("source_size", "target", "copies", "taken", "positions", "_source", "_pieces", "_schedule", "_order", "_piece", "_sum", "_p", "_start", "_before"))
    docs = saved(docs)  # sizes are counted once
    targets = saved(source_targets(docs.select("source", "size"), weights, share, cap))
    schedule = F.element_at(F.array(*map(_pieces, schedules)), (F.col("turn") % len(schedules) + 1).cast("int"))
    for name, points in (own or {}).items():
        schedule = F.when(F.col("source").eqNullSafe(F.lit(name)), _pieces(points)).otherwise(schedule)
    plan = targets.select(F.col("source").alias("_source"), "source_size", "target", F.sqrt("n").cast("long").alias("_pieces"), schedule.alias("_schedule"))
    if targets.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("_piece", unit_range(F.col("_order"), F.greatest(F.col("_pieces"), F.lit(1))))
    sums = rows.groupBy("source", "_piece").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_source"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_piece").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_p")), "left").withColumn("_before", F.col("_before") + F.col("_start")).drop("_start", "_source", "_p", "_piece", "_order", "_pieces")
    most = -int(-cap // 1)
    goal = F.round("target") if not whole else F.col("target") + F.col("size") / 2
    due = [F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), goal - F.col("_before") - k * F.col("source_size"))) for k in range(most)]
    begun = sum((F.when((d >= F.col("size")) & (goal - F.col("_before") - k * F.col("source_size") > 0) if whole else d > 0, 1).otherwise(0) for k, d in enumerate(due)), F.lit(0))
    rows = rows.withColumn("copies", begun.cast("int"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size") if whole else sum(due, F.lit(0.0)).cast("long"))
    at = lambda k: demand_time(F.least(F.lit(1.0), (F.col("_before") + k * F.col("source_size")) / F.col("target")), F.col("_schedule"))
    rows = rows.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>")))
    return rows.drop("_before", "_schedule")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row a copy of the rows of mix_sources, with position instead of positions, range-sorted by it and doc_id (nulls first).

    Rows with no copies have no place; a column called position comes back as position_in; an empty table gives no rows.
    """
    mixed = without_clashes(mixed, ("position",))
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", "doc_id")


def in_first_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix_sources themselves, range-sorted by the due time of their first copy, those without one last."""
    return mixed.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
