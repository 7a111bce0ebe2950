"""Copy-on-write keyed upsert of a folder of sorted Parquet files.

A key's home is the last file that begins at or below it. Changes are reduced to one for each key by a maximum, then dealt to their homes
beside the rows of these files (no other file is read): one partition holds both, sorted by home and key, and merges them as they
stream by, with a pointer into either. So a cogroup of a file's rows and its changes never has to be in memory, however large files are.
The merge gives each home's rows their places, and says at its end how many there are and whether any differs from before. The driver
folds these few numbers (a row a file) into the new list of files; then one task writes each file that changed, and the old ones go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, dropped, numbered, release, saved, ship


@dataclass(frozen=True)
class DataFile:
    """A file of a table: its name in the folder, its least key, and its rows."""

    name: str
    first: int
    n_rows: int


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def table_files(spark: SparkSession, folder: str, key: str) -> list[DataFile]:
    """The folder's files by their least keys: a row a file comes to the driver."""
    path, fs = _path(spark, folder)
    if not any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(path)):
        return []
    rows = spark.read.parquet(folder).select(key, F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    return sorted((DataFile(r["name"], r["first"], r["n"]) for r in rows.collect()), key=lambda f: (f.first is not None, f.first or 0, f.name))


def _write(rows: DataFrame, place: str, files: int, order: list[Column], columns: list[str], folder: str) -> None:
    """One task for each file, numbered by the column place. rows has the columns as c0, c1 and so on, so that their names can't clash."""
    if files:
        named = [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]
        rows.repartitionById(files, F.col(place).cast("int")).sortWithinPartitions(*order).select(*named).write.mode("append").parquet(folder)


def write_table(rows: DataFrame, folder: str, key: str, rows_per_file: int) -> list[DataFile]:
    """Writes rows, sorted by key, into files of rows_per_file rows in folder (the last: the rest), and lists them.

    Rows with a null key come first; rows of one key are ordered by a hash of the row. An empty table gives a folder without data files.
    No task sees more than its range of the sort, or one file.
    """
    spark, columns = rows.sparkSession, rows.columns
    order = [F.col(f"`{key}`").asc_nulls_first(), F.xxhash64(*[F.col(f"`{c}`") for c in columns])]
    inner = rows.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).alias("_row"), F.col(f"`{key}`").alias("_key"), order[1].alias("_hash"))
    placed = numbered(inner, [F.col("_key").asc_nulls_first(), F.col("_hash")], "_place")
    n = placed.agg(F.max("_place")).head()[0]
    flat = placed.select("_place", F.floor(F.col("_place") / rows_per_file).alias("_file"), "_row.*")
    _write(flat, "_file", 0 if n is None else n // rows_per_file + 1, [F.col("_place")], columns, folder)
    path, fs = _path(spark, folder)
    fs.mkdirs(path)
    return table_files(spark, folder, key)


def latest(changes: DataFrame, key: str, by: list[str]) -> DataFrame:
    """One row of changes for each key that isn't null: the highest by the columns by (nulls lowest), then by all others. Combined before the shuffle."""
    rest = [c for c in changes.columns if c != key and c not in by]
    top = F.max(F.struct(*[F.col(f"`{c}`") for c in (*by, *rest)])).alias("_top")
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, "_top.*")


def _homes(firsts: list[int | None]) -> Callable[[Column], Column]:
    """The number of a key's home, and that file's least key."""
    known = np.array([np.iinfo(np.int64).min if f is None else f for f in firsts], np.int64)

    @F.pandas_udf("home int, first long")
    def home(keys: pd.Series) -> pd.DataFrame:
        at = np.maximum(np.searchsorted(known, keys.to_numpy(np.int64), "right") - 1, 0)
        return pd.DataFrame({"home": at.astype(np.int32), "first": known[at]})

    return home


class _Merge:
    """Merges one home's rows and changes, both by ascending key, as they come. A change precedes the rows of its key."""

    def __init__(self, columns: list[str], key: str, sets: list[str], out: pa.Schema):
        self.columns, self.key, self.sets, self.out = columns, key, sets, out
        self.start(-1)

    def start(self, home: int) -> None:
        self.home, self.n, self.dirty, self.held, self.met = home, 0, False, None, False

    def step(self, batch: pa.RecordBatch, last: bool = False) -> pa.RecordBatch | None:
        """The merged rows of what is known by now; the latest change waits, as its row may be still to come."""
        if self.held is not None:
            batch = pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0]
        is_change = batch["_change"].to_numpy(zero_copy_only=False)
        at_change, at_row = np.flatnonzero(is_change), np.flatnonzero(~is_change)
        keys, known = batch["_key"].fill_null(np.iinfo(np.int64).min).to_numpy(), batch["_key"].is_valid().to_numpy(zero_copy_only=False)
        deletes = batch["_delete"].fill_null(False).to_numpy(zero_copy_only=False)
        own = keys[at_change]
        near = np.searchsorted(own, keys[at_row])
        meets = (near < len(own)) & known[at_row]
        meets[meets] = own[near[meets]] == keys[at_row[meets]]
        change = np.full(len(at_row), -1)
        change[meets] = at_change[near[meets]]
        met = np.zeros(len(at_change), bool)
        met[near[meets]] = True
        if self.held is not None:
            met[0] |= self.met
        waits = np.zeros(len(at_change), bool)
        self.held = None
        if len(at_change) and not last and own[-1] == keys[-1]:
            waits[-1], self.held, self.met = True, batch.slice(int(at_change[-1]), 1), bool(met[-1])
        gone = meets & deletes[change]
        fresh = at_change[~met & ~waits & ~deletes[at_change]]
        set_rows, set_by = at_row[meets & ~gone], change[meets & ~gone]
        self.dirty |= bool(gone.any()) or bool(len(fresh)) or self._differs(batch, set_rows, set_by)
        stays = at_row[~gone]
        source = np.concatenate([stays, fresh])
        by = np.concatenate([change[~gone], fresh])
        order = np.argsort(np.where(known[source], keys[source], np.iinfo(np.int64).min), kind="stable")
        source, by = source[order], by[order]
        if not len(source):
            return None
        old = pa.array(np.where(is_change[source], -1, source), pa.int64(), mask=is_change[source])
        taken = pa.array(by < 0, pa.bool_())
        arrays = [pa.array(np.full(len(source), self.home), pa.int32()), pa.array(np.arange(self.n, self.n + len(source)), pa.int64()), pa.nulls(len(source), pa.int64()), pa.nulls(len(source), pa.bool_())]
        for k, c in enumerate(self.columns):
            if c == self.key:
                arrays.append(batch["_key"].take(pa.array(source)).cast(self.out.field(4 + k).type))
                continue
            column = batch[f"o{k}"].take(old)
            if c in self.sets:
                column = pc.if_else(taken, column, batch[f"s{self.sets.index(c)}"].take(pa.array(np.maximum(by, 0))))
            arrays.append(column)
        self.n += len(source)
        return pa.RecordBatch.from_arrays(arrays, schema=self.out)

    def _differs(self, batch: pa.RecordBatch, rows: np.ndarray, by: np.ndarray) -> bool:
        if not len(rows):
            return False
        for k, c in enumerate(self.sets):
            before, after = batch[f"o{self.columns.index(c)}"].take(pa.array(rows)), batch[f"s{k}"].take(pa.array(by))
            if not pc.all(pc.equal(before.is_null(), after.is_null())).as_py():
                return True
            same = pc.equal(before, after)
            if pa.types.is_floating(before.type):
                same = pc.or_(same, pc.and_(pc.is_nan(before), pc.is_nan(after)))
            if not (pc.all(same.fill_null(True)).as_py() in (True, None)):
                return True
        return False

    def end(self) -> list[pa.RecordBatch]:
        """What still waited, and the home's row count and dirty flag."""
        out = []
        if self.held is not None:
            batch, self.held = self.held, None
            if not self.met and (rows := self.step(batch, last=True)) is not None:
                out.append(rows)
        marker = [pa.array([self.home], pa.int32()), pa.nulls(1, pa.int64()), pa.array([self.n], pa.int64()), pa.array([self.dirty], pa.bool_()), *[pa.nulls(1, f.type) for f in list(self.out)[4:]]]
        return [*out, pa.RecordBatch.from_arrays(marker, schema=self.out)]


def merged_homes(rows: DataFrame, changes: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """_home, _place long (from 0), _n long, _dirty boolean and the columns of rows, whose key type is a whole number.

    rows: _home int and a table's columns, whose names don't begin with _. changes: _home, _delete boolean, key (once each) and sets. A change deletes the rows of its key in
    its home, or puts its values of sets into them, or into a new row with nulls elsewhere. For each home also a row with no _place: how many
    rows it has now, and whether any differs (nulls equal, as are NaNs). Nothing but one batch is in memory.
    """
    columns = [c for c in rows.columns if c != "_home"]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    old = [F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(columns) if c != key]
    none = [F.lit(None).cast(kinds[c]).alias(f"o{k}") for k, c in enumerate(columns) if c != key]
    left = rows.select("_home", F.col(f"`{key}`").cast("long").alias("_key"), F.lit(False).alias("_change"), F.lit(None).cast("boolean").alias("_delete"), *old, *[F.lit(None).cast(kinds[c]).alias(f"s{k}") for k, c in enumerate(sets)])
    right = changes.select("_home", F.col(f"`{key}`").cast("long").alias("_key"), F.lit(True).alias("_change"), F.coalesce("_delete", F.lit(False)).alias("_delete"), *none, *[F.col(f"`{c}`").cast(kinds[c]).alias(f"s{k}") for k, c in enumerate(sets)])
    both = left.unionByName(right).repartition(F.col("_home")).sortWithinPartitions("_home", F.col("_key").asc_nulls_first(), F.col("_change").desc())
    head = "_home int, _place long, _n long, _dirty boolean"
    schema = ", ".join([head, *[f"`{c}` {kinds[c].simpleString()}" for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = None
        for batch in batches:
            if merge is None:
                kind = {f.name: f.type for f in batch.schema}
                fields = [pa.field("_home", pa.int32()), pa.field("_place", pa.int64()), pa.field("_n", pa.int64()), pa.field("_dirty", pa.bool_())]
                merge = _Merge(columns, key, sets, pa.schema([*fields, *[pa.field(c, key_type if c == key else kind[f"o{k}"]) for k, c in enumerate(columns)]]))
            homes = batch["_home"].to_numpy()
            cuts = [0, *(np.flatnonzero(homes[1:] != homes[:-1]) + 1).tolist(), len(homes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if homes[a] != merge.home:
                    if merge.home >= 0:
                        yield from merge.end()
                    merge.start(int(homes[a]))
                if (found := merge.step(batch.slice(a, b - a))) is not None:
                    yield found
        if merge is not None and merge.home >= 0:
            yield from merge.end()
        release()

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kinds[key].simpleString())
    if key_type is None:
        raise ValueError(f"{key} isn't a whole number")
    return both.mapInArrow(run, schema)


@dataclass
class Planned:
    """A file of the new list: rows [start, start + n) of the changed homes' rows, laid end to end, or an old file that stays (start < 0)."""

    n: int
    start: int
    name: str | None = None


def folded(files: list[DataFile], found: dict[int, tuple[int, bool]], rows_per_file: int) -> list[Planned]:
    """The new list of files from each home's (rows, dirty): changed homes cut into the fewest files, sizes at most one apart, larger first; then,
    ascending, each such file joins its left neighbour where that is one too and both have at most rows_per_file rows."""
    out: list[Planned] = []
    start = 0
    for k, f in enumerate(files):
        n, dirty = found.get(k, (f.n_rows, False))
        if not dirty:
            out.append(Planned(f.n_rows, -1, f.name))
            continue
        count = -(-n // rows_per_file)
        for i in range(count):
            size = n // count + (i < n % count)
            if out and out[-1].name is None and out[-1].n + size <= rows_per_file:
                out[-1].n += size
            else:
                out.append(Planned(size, start))
            start += size
    return out


def upsert(spark: SparkSession, folder: str, files: list[DataFile], changes: DataFrame, key: str, sets: list[str], rows_per_file: int, ignored: Callable[[Column], Column] | None = None, deleted: Callable[[Column], Column] | None = None) -> list[str]:
    """Applies changes, one row a key (see latest), to the folder's files in place; returns the names of the files that stay as they were.

    ignored and deleted give, from the least key of a change's home, whether it does nothing or deletes (null: no); all others set the
    columns sets, or insert. Only files whose rows differ are written anew. A null key changes nothing; rows with one stay in the first
    file. Without files (an empty table) there is no home, so changes do nothing. No changes: nothing is written. What comes to the
    driver is a row a file. New files are there before old ones go; a failure in between leaves both, and the caller writes anew.
    """
    if not files:
        return []
    ship(spark)
    columns = spark.read.parquet(folder).columns
    at = _homes([f.first for f in files])(F.col(f"`{key}`").cast("long"))
    own = {c: f"c{k}" for k, c in enumerate(columns)}
    dealt = changes.where(F.col(f"`{key}`").isNotNull()).withColumn("_home_of_key", at)
    first = F.col("_home_of_key.first")
    if ignored is not None:
        dealt = dealt.where(~F.coalesce(ignored(first), F.lit(False)))
    delete = F.lit(False) if deleted is None else F.coalesce(deleted(first), F.lit(False))
    dealt = saved(dealt.select(F.col("_home_of_key.home").alias("_home"), delete.alias("_delete"), *[F.col(f"`{c}`").alias(own[c]) for c in (key, *sets)]))
    touched = sorted(r[0] for r in dealt.select("_home").distinct().collect())  # at most a row a file
    if not touched:
        dropped(dealt)
        return [f.name for f in files]
    homes = spark.createDataFrame([(files[k].name, k) for k in touched], "_name string, _home int")
    name = F.col("_metadata.file_name")
    rows = spark.read.parquet(folder).where(name.isin([files[k].name for k in touched])).select(name.alias("_name"), *[F.col(f"`{c}`").alias(own[c]) for c in columns])
    merged = saved(merged_homes(rows.join(F.broadcast(homes), "_name").drop("_name"), dealt, own[key], [own[c] for c in sets]))
    found = {r["_home"]: (r["_n"], r["_dirty"]) for r in merged.where("_place is null").select("_home", "_n", "_dirty").collect()}  # a row a file
    plan = folded(files, found, rows_per_file)
    base, total = np.full(len(files), -1, np.int64), 0
    for k in range(len(files)):
        if found.get(k, (0, False))[1]:
            base[k], total = total, total + found[k][0]
    starts = np.array([p.start for p in plan if p.name is None], np.int64)

    @F.pandas_udf("int")
    def target(home: pd.Series, place: pd.Series) -> pd.Series:
        own = base[home.to_numpy()]
        return pd.Series(np.where(own < 0, -1, np.searchsorted(starts, own + place.to_numpy(), "right") - 1).astype(np.int32))

    new = merged.where("_place is not null").withColumn("_file", target("_home", "_place")).where("_file >= 0")
    _write(new, "_file", len(starts), [F.col("_home"), F.col("_place")], columns, folder)
    for k, (_, dirty) in found.items():
        if dirty:
            path, fs = _path(spark, folder, files[k].name)
            fs.delete(path, False)
    dropped(dealt, merged)
    return [p.name for p in plan if p.name is not None]


def file_digests(spark: SparkSession, folder: str, key: str, numbers: dict[str, Column], columns: list[str], schema: dict[str, str]) -> DataFrame:
    """For each file: path, first_id, n_rows, the sums of numbers (long), ids_sha256 of the keys in file order, and columns. A folder without data files: no rows.

    Each file's rows stream through one task in file order; only key and numbers are read.
    """
    ship(spark)
    out = f"path string, first_id long, n_rows long, {''.join(f'{c} long, ' for c in numbers)}ids_sha256 string"
    path, fs = _path(spark, folder)
    if any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(path)):
        files = spark.read.parquet(folder)
    else:
        files = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in schema.items())).withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).alias("row_index")))
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("_place"), F.col(f"`{key}`").cast("long").alias("_key"), *[v.cast("long").alias(c) for c, v in numbers.items()])
    rows = rows.repartition(F.col("path")).sortWithinPartitions("path", "_place")
    names = list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done() -> pa.RecordBatch:
            path, first, n, sums, digest = now
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([path, first, n, *sums, digest.hexdigest()], [pa.string(), pa.int64(), pa.int64(), *[pa.int64()] * len(sums), pa.string()], strict=True)], ["path", "first_id", "n_rows", *names, "ids_sha256"])

        for batch in batches:
            runs = batch["path"].dictionary_encode()
            code = runs.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                path, ids = runs.dictionary[int(code[a])].as_py(), batch["_key"].slice(a, b - a)
                if now is None or now[0] != path:
                    if now is not None:
                        yield done()
                    now = [path, None, 0, [0] * len(names), hashlib.sha256()]
                text = ",".join("" if k is None else str(k) for k in ids.to_pylist())
                now[4].update((("," if now[2] else "") + text).encode())
                least = pc.min(ids).as_py()
                now[1] = least if now[1] is None else now[1] if least is None else min(now[1], least)
                now[2] += b - a
                now[3] = [s + (pc.sum(batch[c].slice(a, b - a)).as_py() or 0) for s, c in zip(now[3], names, strict=True)]
        if now is not None:
            yield done()

    return rows.mapInArrow(run, out).withColumn("columns", F.lit(",".join(columns)))
