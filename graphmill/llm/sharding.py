"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. The rows' keys and sizes are checkpointed once, which fixes the partitions; a partition's row count is one small aggregate.
2. The driver draws the communication matrix: how many rows of partition p go to shard s. Row p is a multivariate hypergeometric
   draw from what the shards still lack, so the matrix has the law of a uniform random permutation and its column sums are the
   exact shard sizes (counts at most one apart). It has partitions x shards entries, whatever the number of rows.
3. Each partition permutes its rows locally: row k of the permuted order goes to the shard whose range of the matrix row holds k.
4. Rows are exchanged, then permuted again inside their shard: they are ranked by a second random key. Ranks come from key ranges of
   bounded size and the ranges' counts, so no shard is sorted by one task.

All random keys are hashes of (seed, partition, place), so a lost task is rebuilt the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, without_clashes

#: A rank is found among about so many rows.
RANGE_ROWS = 4096
#: Populations that numpy's own draw takes.
NUMPY_BOUND = 10**9


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of partition p (of counts[p] rows) for each shard: int64 [partitions, shards]."""
    total, rng = int(sum(counts)), np.random.default_rng(seed)
    lacking = np.full(shards, total // shards, np.int64)
    lacking[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        left, rest = int(n), int(lacking.sum())
        for s in range(shards):
            if not left:
                break
            rest -= int(lacking[s])
            take = _hypergeometric(rng, int(lacking[s]), rest, left)
            out[p, s] = take
            left -= take
        lacking -= out[p]
    return out


def _log_factorial_step(a: int, b: int) -> float:
    """log(b!) - log(a!), without the cancellation that the difference of two large values has (Stirling's series of both)."""
    if min(a, b) < 1000:
        return math.lgamma(b + 1) - math.lgamma(a + 1)
    step, series = b - a, lambda n: 1 / (12 * n) - 1 / (360 * n**3)
    return step * math.log(a) + (b + 0.5) * math.log1p(step / a) - step + series(b) - series(a)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among draws without replacement: an exact draw at every size.

    numpy draws from populations below its bound; a larger one is drawn by ratio of uniforms (Stadlober, 1989), with the probability
    relative to the mode's as an exact difference of log factorials.
    """
    n = good + bad
    if bad == 0:
        return draws
    if good == 0 or draws == 0:
        return 0
    if n < NUMPY_BOUND:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    parts = lambda k: (k, good - k, draws - k, bad - draws + k)
    mean = draws * (good / n)
    spread = math.sqrt(max(0.0, (n - draws) / (n - 1) * mean * (bad / n)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= -sum(_log_factorial_step(x, y) for x, y in zip(parts(mode), parts(k), strict=True)):
            return k


def unit_range(h: Column, n: Column | int) -> Column:
    """A 64-bit hash scaled to 0 .. n - 1."""
    return F.floor(F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53)) * n).cast("long")


def hypergeometric_shards(rows: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """rows with shard int and slot long, gapless from 0 in each shard; shard sizes differ by one row at most.

    Rows may have any columns with nulls; columns called shard, slot, _pid, _row, _at, _draw, _range, _upto, _n, _start or _k come back
    with _in added to their name. Repeated rows are rows of their own; an empty table gives no rows; with fewer rows than shards some
    shards stay empty. Only the columns that are given travel: join texts later.
    """
    spark = rows.sparkSession
    rows = without_clashes(rows, ("shard", "slot", "_pid", "_row", "_at", "_draw", "_range", "_upto", "_n", "_start", "_k"))
    keyed = saved(rows.withColumn("_pid", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r["_pid"]: r["n"] for r in keyed.groupBy("_pid").agg(F.count("*").alias("n")).collect()}  # one row a partition
    if not counts:
        return keyed.drop("_pid", "_row").withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    pids = sorted(counts)
    upto = communication_matrix([counts[p] for p in pids], shards, seed).cumsum(axis=1)
    matrix = spark.createDataFrame([(p, [int(x) for x in upto[k]]) for k, p in enumerate(pids)], "_pid int, _upto array<long>")
    local = Window.partitionBy("_pid").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "_pid", "_row"), "_row")
    dealt = (
        keyed.withColumn("_at", F.row_number().over(local) - 1)
        .join(F.broadcast(matrix), "_pid")  # partitions x shards numbers
        .withColumn("shard", F.size(F.filter("_upto", lambda c: c <= F.col("_at"))).cast("int"))
        .drop("_upto", "_at")
    )
    n = sum(counts.values())
    pieces = max(1, math.ceil(n / shards / RANGE_ROWS))
    dealt = dealt.withColumn("_draw", F.xxhash64(F.lit(seed), F.lit("shard"), "_pid", "_row")).withColumn("_range", unit_range(F.col("_draw"), pieces))
    dealt = saved(dealt)
    sizes = dealt.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_range").orderBy("_draw", "_pid", "_row")
    ranked = dealt.withColumn("_k", F.row_number().over(within) - 1)
    return ranked.join(starts, ["shard", "_range"]).withColumn("slot", (F.col("_start") + F.col("_k")).cast("long")).drop("_pid", "_row", "_draw", "_range", "_start", "_k")
