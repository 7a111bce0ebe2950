"""What the training-data operators share: session helpers, Arrow text access and vectorised word and window hashing.

Text enters Python as the UTF-8 buffer of an Arrow column, so that no row becomes a Python object unless an operator needs it.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, space and \x09 to \x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a Java regular expression class, and of a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that spark.checkpoint.dir names. Where it is unset, a folder of our own on one machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "graphmill-checkpoints"))


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder: lineage ends there, so a lost executor loses nothing.

    The estimated size of a checkpoint's plan, a product over its joins, would be handed on to what is built on it: over the rounds of a loop it grows
    to a number of millions of digits that fills the driver. So the kept rows are a new frame, without an estimate.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(kept.queryExecution().logical().rdd(), kept.schema(), False), df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Lets go of the plans, broadcasts and shuffle files of steps that are over, on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of saved frames that nothing will read again."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def without_clashes(df: DataFrame, own: Iterable[str]) -> DataFrame:
    """df with columns that an operator's own names would clash with (in any case of letters) called name_in, name_in_in and so on."""
    taken = {c.lower() for c in own}
    names, out = {c.lower() for c in df.columns}, df
    for c in df.columns:
        new = c
        while new.lower() in taken or (new != c and new.lower() in names):
            new += "_in"
        out = out if new == c else out.withColumnRenamed(c, new)
        names.add(new.lower())
    return out


def carried(docs: DataFrame, keep: Iterable[str], own: Iterable[str]) -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, text and the columns keep of docs, and what keep is called here: a name among own, doc_id or text gets _in."""
    keep = list(keep)
    names = without_clashes(docs.select(*[F.col(f"`{c}`") for c in keep]), ["doc_id", "text", *own]).columns
    return docs.select("doc_id", "text", *[F.col(f"`{a}`").alias(b) for a, b in zip(keep, names, strict=True)]), tuple(names)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name long, gapless from 0 in the order, without one task that sees all rows: a range sort, then each range's start."""
    rows = saved(df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, upto = [], 0
    for k in sorted(counts):
        starts.append((k, upto))
        upto += counts[k]
    table = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    return rows.join(F.broadcast(table), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once a context, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_graphmill_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), "graphmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(path)
    sc._graphmill_shipped = True


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch may hold; long texts then reach Python a few at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def release() -> None:
    """Gives freed memory back to the system, at the end of a task's work: workers live on with their peak otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one row that is longer."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words before it (one entry more than rows). Words never cross rows."""
    n = len(data)
    solid = ~is_space[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(33))
        h = h * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H so that span_hash(H, a, b) depends on data[a:b] alone."""
    power, _ = _grow(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [a, b)."""
    _, inverse = _grow(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))


def gram_hash(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of each m consecutive entries of h; ends where fewer than m are left."""
    n = max(0, len(h) - m + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(m):
            out = out * _U(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width entries the place of its least entry, the leftmost among equals. Compares the upper 32 bits."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    key = (values & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    count = n - width + 1
    out = np.minimum(key[:count], key[width - size : width - size + count])
    return (out & _U(0xFFFFFFFF)).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
