"""Scores and levels as column expressions. The cuts, points and weights are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(x: Column, cuts: list[tuple[float, float]], above: float) -> Column:
    """The points of the first cut that x does not exceed, else above."""
    out = F.lit(above)
    for most, points in reversed(cuts):
        out = F.when(x <= most, points).otherwise(out)
    return out


def normalized_complexity(x: Column) -> Column:
    """Piecewise linear onto 0..1 with corners at 10, 20 and 50."""
    return (
        F.when(x <= 10, x / 10.0 * 0.25)
        .when(x <= 20, 0.25 + (x - 10) / 10.0 * 0.25)
        .when(x <= 50, 0.50 + (x - 20) / 30.0 * 0.35)
        .otherwise(F.least(F.lit(1.0), 0.85 + (x - 50) / 100.0 * 0.15))
    )


def hotspot_score(complexity: Column, churn_rank: Column, in_degree_rank: Column, in_cycle: Column) -> Column:
    return 0.35 * normalized_complexity(complexity) + 0.35 * churn_rank + 0.20 * in_degree_rank + 0.10 * in_cycle.cast("int")


def ring_risk(breadth: Column, fan: Column, depth: Column) -> Column:
    hundred = F.lit(100.0)
    return 0.5 * F.least(hundred, 20.0 * breadth) + 0.3 * F.least(hundred, 5.0 * fan) + 0.2 * 100.0 / F.greatest(F.lit(1.0), depth.cast("double"))


def level(score: Column, cuts: tuple[float, float, float] = (30, 60, 85)) -> Column:
    return F.when(score < cuts[0], "LOW").when(score < cuts[1], "MEDIUM").when(score < cuts[2], "HIGH").otherwise("CRITICAL")


def blast_level(total: Column) -> Column:
    return F.when(total > 100, "HIGH").when(total > 30, "MEDIUM").otherwise("LOW")


def diff_level(lines: Column, entries: Column) -> Column:
    return F.when((lines > 500) | (entries > 10), "HIGH").when((lines > 100) | (entries > 3), "MEDIUM").otherwise("LOW")


def scope_points(callers: Column) -> Column:
    return steps(callers, [(1, 10), (3, 25), (5, 40), (10, 60), (20, 80)], 95)


def complexity_points(complexity: Column, lines: Column) -> Column:
    return F.least(F.lit(100), steps(complexity, [(5, 0), (10, 10), (15, 20), (20, 30)], 40) + steps(lines, [(50, 0), (100, 10), (200, 20)], 30) + 30)


def coverage_points(percent: Column) -> Column:
    return F.when(percent >= 80, 15).when(percent >= 60, 30).when(percent >= 40, 50).when(percent >= 20, 70).otherwise(90)


def change_points(changes: Column) -> Column:
    return F.when(changes >= 10, 80).when(changes >= 5, 60).when(changes >= 3, 40).when(changes >= 1, 20).otherwise(10)


def dependency_points(n: Column) -> Column:
    return F.when(n >= 10, 80).when(n >= 5, 50).when(n >= 3, 30).when(n >= 1, 20).otherwise(10)


def change_risk(scope: Column, business: Column, complexity: Column, coverage: Column, changes: Column, dependency: Column) -> Column:
    """Weighted by .25 .20 .20 .20 .10 .05 and rounded half up."""
    return F.floor(scope * 0.25 + business * 0.20 + complexity * 0.20 + coverage * 0.20 + changes * 0.10 + dependency * 0.05 + 0.5).cast("int")


def intent_weight(raw: Column, base: Column) -> Column:
    return F.when(raw <= base, 1.0).otherwise(1.0 + 0.5 * F.log(raw / base))


def percentile_or_half(rank: Column, n: Column) -> Column:
    """percent_rank, and 0.5 for a single row."""
    return F.when(n == 1, 0.5).otherwise(rank)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null, unequal lengths or a zero norm: 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def impact_scope(callers: Column) -> Column:
    return steps(callers, [(0, 10), (3, 25), (5, 40), (10, 60), (20, 80)], 100)


def entry_criticality(kinds: Column) -> Column:
    """Points of the entry points' kinds, at most 100; none: 20."""
    points = lambda k: F.when(k == "HTTP_ENDPOINT", 30).when(k == "MQ_CONSUMER", 25).when(k == "SCHEDULED_TASK", 20).otherwise(10)
    return F.when(F.size(kinds) == 0, 20).otherwise(F.least(F.lit(100), F.aggregate(kinds, F.lit(0), lambda s, k: s + points(k))))


def change_complexity(change: Column, characters: Column) -> Column:
    """By the kind of change, and five points for each fifty characters more or less, up to twenty."""
    kind = F.when(change == "DELETE", 40).when(change == "REFACTOR", 30).when(change == "MODIFY", 20).when(change == "ADD", 10).otherwise(0)
    return F.least(F.lit(100), F.lit(30) + kind + F.least(F.lit(20), F.floor(F.abs(characters) / 50).cast("int") * 5))


def snowflake(millis: Column, centre: Column, worker: Column, sequence: Column) -> Column:
    """The id of a time, data centre, worker and sequence; the inverse of snowflake_parts."""
    return F.shiftleft(millis - 1704067200000, 22).bitwiseOR(F.shiftleft(centre.cast("long"), 17)).bitwiseOR(F.shiftleft(worker.cast("long"), 12)).bitwiseOR(sequence.cast("long"))


def snowflake_parts(x: Column) -> dict[str, Column]:
    """Milliseconds since 1970, data centre, worker and sequence of an id (5 + 5 + 12 bits after 1704067200000)."""
    return {"millis": F.shiftright(x, 22) + 1704067200000, "centre": F.shiftright(x, 17).bitwiseAND(31), "worker": F.shiftright(x, 12).bitwiseAND(31), "sequence": x.bitwiseAND(4095)}
