"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label are one class with a count, so copies are never compared. A table's code is the signs of a vector on its own
random hyperplanes. Only (label, table, code) hashes and class numbers are shuffled first; what is alone in its bucket goes, and the
vectors are fetched for the buckets that remain. Classes that share a bucket are compared exactly, in double precision. A pair is
counted in the first table where it meets, so nothing is counted twice and no pair list is shuffled: a task sends each class's number
of links and a spanning tree. A bucket of more than BLOCK classes is cut into blocks and each pair of blocks is a cell of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, saved, shuffle_width, small_batches
from .components import components
from .simhash import Forest, reached

#: Classes of one bucket that one task compares with each other.
BLOCK = 2048


def table_shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits and tables for n vectors: so many bits that few unlike vectors meet, and tables until a pair at the threshold meets with probability recall."""
    bits = max(4, min(40, math.ceil(math.log2(max(16, n)) + 4)))
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _vectors(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, label, vec binary: the components as they are; null where the vector is null, zero, or has null or non-finite components."""
    kind, part = df.schema[label].dataType.simpleString(), df.schema[vector].dataType.elementType.simpleString()
    type_ = np.float32 if part == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["vector"]
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.cast(pa.float32() if type_ is np.float32 else pa.float64()).to_numpy(zero_copy_only=False).astype(type_) + type_(0)
            upto = lambda x: np.concatenate([[0], np.cumsum(x)])
            bad, some = upto(~np.isfinite(flat)), upto(flat != 0)
            good = (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            vec = [flat[s:e].tobytes() if ok else None for s, e, ok in zip(off[:-1].tolist(), off[1:].tolist(), good.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], b["label"], pa.array(vec, pa.binary())], names=["key", "label", "vec"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).mapInArrow(run, f"key long, label {kind}, vec binary")


def _matrix(column: pa.Array, type_: type) -> np.ndarray:
    """Unit rows (double) of vectors of one length, scaled first so that no square overflows."""
    data, _ = column_bytes(column)
    x = data.view(type_).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def link_vectors(df: DataFrame, threshold: float = 0.93, recall: float = 0.995, seed: int = 5, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """key, n_links long, component_id long, kept boolean for every row of df.

    Links join rows of equal, non-null labels whose vectors have equal lengths and a cosine of threshold or more. Every pair meets in
    some table with probability recall at the threshold, more above it. Null keys: a row with n_links 0, component_id null and kept
    null. Vectors that are null, zero or hold null or non-finite components link with nothing. Repeated keys are linked like any rows.
    Empty table: no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = saved(_vectors(df, key, label, vector))
    classes = saved(rows.where("vec is not null and label is not null and key is not null").groupBy("label", "vec").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    size = classes.count()
    bits, tables = table_shape(size, threshold, recall)
    type_ = np.float32 if df.schema[vector].dataType.elementType.simpleString() == "float" else np.float64
    kind = df.schema[label].dataType.simpleString()
    planes: dict[int, np.ndarray] = {}

    def codes_of(x: np.ndarray) -> np.ndarray:
        """The code of each row in each table."""
        if x.shape[1] not in planes:
            planes[x.shape[1]] = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], bits * tables))
        return ((x @ planes[x.shape[1]] >= 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(column_bytes(b["vec"])[1])
            for length in np.unique(lengths):
                part = b.filter(pa.array(lengths == length))
                codes = codes_of(_matrix(part["vec"], type_))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part["label"], part["rep"], pa.array(np.full(len(codes), length, np.int32)), lists], names=["label", "rep", "length", "codes"])

    met = classes.select("label", "rep", "vec").mapInArrow(hashed, f"label {kind}, rep long, length int, codes array<long>")
    met = met.select("label", "length", "rep", F.posexplode("codes").alias("tab", "code")).select(F.xxhash64("label", "length", "tab", "code").alias("bucket"), "rep", "tab")
    met = saved(met)
    sizes = met.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    met = met.join(sizes, "bucket")  # those alone in a bucket go
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("facing", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("cell", F.xxhash64("bucket", F.least("block", "facing"), F.greatest("block", "facing"))).select("cell", "tab", "block", F.col("block").eqNullSafe(F.col("facing")).alias("inside"), "rep")
    met = saved(met)
    n_met = met.count()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, ids, times = Forest(), [], []
        for g in _cells(batches):
            names = g["label"].to_pylist()
            lengths = np.diff(column_bytes(g["vec"].combine_chunks())[1])
            kinds: dict = {}  # unlike labels or lengths whose bucket hashes are equal stay apart
            for k, x in enumerate(zip(names, lengths.tolist(), g["tab"].to_pylist(), strict=True)):
                kinds.setdefault(x, []).append(k)
            for (_, _, tab), at in kinds.items():
                if len(at) > 1:
                    part = g.take(pa.array(at))
                    rep, n, block = part["rep"].to_numpy(), part["n"].to_numpy(), part["block"].to_numpy()
                    x = _matrix(part["vec"].combine_chunks(), type_)
                    near = x @ x.T >= threshold
                    near &= ~np.eye(len(x), dtype=bool)
                    if not part["inside"][0].as_py():  # a cell of two blocks, even if one is empty
                        near &= block[:, None] != block[None, :]
                    live = np.flatnonzero(near.any(axis=1))
                    if len(live):
                        near, rep, n, codes = near[np.ix_(live, live)], rep[live], n[live], codes_of(x[live])[:, :tab]
                        for group in reached(len(live), lambda k, rest: near[k, rest]):  # noqa: B023  used at once
                            forest.join(rep[group].tolist())
                        for k in range(len(live)):
                            at_k = np.flatnonzero(near[k])
                            fresh = at_k[~(codes[at_k] == codes[k]).any(axis=1)]
                            ids.append(int(rep[k]))
                            times.append(int(n[fresh].sum()))
        tree = np.array(forest.edges, np.int64).reshape(-1, 2)
        own, of = np.unique(np.array(ids, np.int64), return_inverse=True)
        links = np.bincount(of, np.array(times, np.float64), len(own)).astype(np.int64) if len(own) else own
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([tree[:, 0], own])), pa.array([*tree[:, 1].tolist(), *[None] * len(own)], pa.int64()), pa.array(np.concatenate([np.zeros(len(tree), np.int64), links]))], names=["u", "v", "links"])

    width = max(shuffle_width(spark), math.ceil(n_met / 50_000))
    fetched = met.join(classes, "rep").select("cell", "tab", "block", "inside", "rep", "label", "n", "vec")
    found = saved(fetched.repartition(width, "cell").sortWithinPartitions("cell").mapInArrow(compared, "u long, v long, links long"))
    roots = components(found.where("v is not null").select("u", "v"))
    more = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    known = classes.join(more.withColumnRenamed("u", "rep"), "rep", "left").join(roots.withColumnRenamed("u", "rep"), "rep", "left")
    known = known.select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = rows.join(known, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")) & F.col("key").isNotNull(), "left")
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "key").alias("component_id"), (F.col("key") == F.coalesce("root", "key")).alias("kept"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell of sorted batches; a cell holds two blocks at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cell = b["cell"].to_numpy()
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        if held and len(cell) and held[-1]["cell"][held[-1].num_rows - 1].as_py() != int(cell[0]):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts.tolist():
            held.append(b.slice(at, cut - at))
            if sum(x.num_rows for x in held) > 1:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        if at < len(cell):
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
