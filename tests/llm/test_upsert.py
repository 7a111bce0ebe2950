"""Copy-on-write upsert against a plain Python version, and its files on disk."""

import glob
import hashlib
import math
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest
from graphmill.llm import queries, upsert
from pyspark.sql import functions as F

SETS = ["source", "segment", "city", "balance"]
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def expected(clients, changes):
    """clients and changes as lists of dicts. The contract's files: list of (rows, rewritten)."""
    m = 1 + len(clients) // 1000
    kept = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [kept[k : k + m] for k in range(0, len(kept), m)]
    wins = {}
    low = lambda v: (v is not None, v if v is not None else 0)
    for c in changes:
        if c["client_id"] is not None:
            order = (low(c["seq"]), low(c["change_id"]))
            if c["client_id"] not in wins or order > wins[c["client_id"]][0]:
                wins[c["client_id"]] = (order, c)
    before = [[dict(r) for r in f] for f in files]
    state = [{r["client_id"]: dict(r) for r in f} for f in files]
    firsts = [f[0]["client_id"] for f in files]
    for key, (_, c) in wins.items():
        if not files:
            break
        home = max([k for k, f in enumerate(firsts) if f <= key], default=0)
        h = crc(firsts[home]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            state[home].pop(key, None)
        else:
            row = state[home].setdefault(key, dict.fromkeys(clients[0]) | {"client_id": key})
            row.update({s: c[s] for s in SETS})
    out = []
    for k, rows in enumerate(state):
        after = [rows[x] for x in sorted(rows)]
        if after == before[k]:
            out.append([after, False])
            continue
        count = -(-len(after) // m)
        at = 0
        for i in range(count):
            size = len(after) // count + (i < len(after) % count)
            piece, at = after[at : at + size], at + size
            if out and out[-1][1] and len(out[-1][0]) + size <= m:
                out[-1][0] += piece
            else:
                out.append([piece, True])
    return out


def digest(rows, rewritten):
    blank = lambda v: v or ""
    return (
        rows[0]["client_id"], len(rows), sum(0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5) for r in rows),
        sum(crc(f"{blank(r['source'])}|{blank(r['segment'])}|{blank(r['city'])}") for r in rows), hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(), ",".join(rows[0]), rewritten,
    )


def check(spark, sf_dir):
    clients, changes = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clients", "client_changes"))
    want = expected([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()])
    got = queries.op11_copy_on_write_upsert(spark, sf_dir).collect()
    columns = ["first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "rewritten"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(digest(*f) for f in want)
    paths = {r["path"].removeprefix("file://").removeprefix("file:"): r for r in got}
    if got:
        assert {os.path.abspath(p) for p in glob.glob(os.path.dirname(next(iter(paths))) + "/**/*.parquet", recursive=True)} == {os.path.abspath(p) for p in paths}
    by_first = {f[0][0]["client_id"]: f[0] for f in want}
    for path, r in paths.items():  # the files hold just these rows, in order, with all columns
        file = pq.read_table(path)
        assert file.column_names == clients.columns
        assert [{**x, "updated_at": None} for x in file.to_pylist()] == [{**x, "updated_at": None} for x in by_first[r["first_id"]]]
    return got


def made(spark, top, n, seed, hot=None, share=1.0):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ü", None])
    clients = [(i, i, word(), None, word(), None, word(), rng.choice([1, None]), word(), rng.choice([None, 1.005, -2.5, float(i)])) for i in range(0, 3 * n, 3)]
    changes = [(k, hot if hot is not None and rng.random() < 0.4 else rng.choice([None, *range(-5, int(3 * n * share) + 5)]), rng.choice([None, 1, 2, k]), rng.choice(["U", "I", "D", None]), None, word(), word(), word(), rng.choice([None, 7.0, -1.25])) for k in range(2 * n)]
    changes += changes[: n // 2]
    spark.createDataFrame(clients, CLIENTS).repartition(3).write.parquet(f"{top}/clients.parquet")
    spark.createDataFrame(changes, CHANGES).repartition(3).write.parquet(f"{top}/client_changes.parquet")
    return str(top)


@pytest.mark.parametrize(("n", "seed", "hot", "share"), [(1500, 1, None, 1.0), (2600, 2, 300, 0.2), (900, 3, None, 3.0), (1, 4, None, 1.0)])
def test_query(spark, tmp_path, n, seed, hot, share):
    check(spark, made(spark, tmp_path, n, seed, hot, share))


def test_given_tables(spark):
    got = check(spark, "/root/testdata/sf0.01")
    assert {r["rewritten"] for r in got} == {True, False}


def test_empty_tables(spark, tmp_path):
    top = made(spark, tmp_path / "a", 40, 5)
    for clients, changes in ((False, True), (True, False), (False, False)):
        there = tmp_path / f"{clients}{changes}"
        for t, full in (("clients", clients), ("client_changes", changes)):
            spark.read.parquet(f"{top}/{t}.parquet").where(F.lit(full)).write.parquet(f"{there}/{t}.parquet")
        got = check(spark, str(there))
        assert bool(got) == clients and not any(r["rewritten"] for r in got)


def test_repeated_keys_null_keys_and_clashing_names(spark, tmp_path):
    """Rows that share a key all change, a null key stays, columns may be called as the operator's own."""
    rows = [(None, "n", 0.0), (1, "a", 1.0), (1, "b", float("nan")), (2, "c", None), (2, "c", None), (5, "d", 5.0), (9, "e", 9.0)]
    folder = str(tmp_path / "t")
    files = upsert.write_table(spark.createDataFrame(rows, "_key int, _home string, _place double").repartition(4), folder, "_key", 3)
    assert [(f.first, f.n_rows) for f in files] == [(1, 3), (2, 3), (9, 1)]
    changes = spark.createDataFrame([(1, 8.0, False), (2, 7.0, True), (3, None, None), (9, 9.0, False), (None, 1.0, True)], "_key int, _place double, gone boolean")
    stay = upsert.upsert(spark, folder, files, changes, "_key", ["_place"], 3, deleted=lambda first: F.col("gone"))
    assert stay == [files[2].name]
    got = sorted(map(str, map(tuple, spark.read.parquet(folder).collect())))
    assert got == sorted(map(str, [(None, "n", 0.0), (1, "a", 8.0), (1, "b", 8.0), (3, None, None), (5, "d", 5.0), (9, "e", 9.0)]))


def test_folded():
    f = [upsert.DataFile(str(k), 10 * k, 4) for k in range(6)]
    plan = upsert.folded(f, {0: (9, True), 1: (0, True), 2: (1, True), 4: (1, True), 5: (2, True), 3: (4, False)}, 4)
    assert [(p.n, p.start, p.name) for p in plan] == [(3, 0, None), (3, 3, None), (4, 6, None), (4, -1, "3"), (3, 10, None)]


@pytest.mark.parametrize("width", [1, 2, 3, 50])
def test_merge_in_any_batches(width):
    """The merge gives the same rows however the stream is cut."""
    import pyarrow as pa

    rng, flags = random.Random(width), set()
    for _ in range(200):
        stream, want, dirty = [], [], False
        for key in sorted(rng.sample(range(30), rng.choice([2, 12]))):
            rows = [(key, False, None, rng.choice([1, None]), None) for _ in range(rng.choice([0, 1, 1, 3]))]
            change = (key, True, rng.random() < 0.3, None, rng.choice([1, 2, None])) if rng.random() < rng.choice([0.1, 0.6]) else None
            stream += ([change] if change else []) + rows
            if not change:
                want += [(key, r[3]) for r in rows]
            elif change[2]:
                dirty |= bool(rows)
            else:
                want += [(key, change[4])] * max(1, len(rows))
                dirty |= not rows or any(r[3] != change[4] for r in rows)
        out = pa.schema([("_home", pa.int32()), ("_place", pa.int64()), ("_n", pa.int64()), ("_dirty", pa.bool_()), ("k", pa.int64()), ("v", pa.int64())])
        merge, got = upsert._Merge(["k", "v"], "k", ["v"], out), []
        merge.start(0)
        names = ["_key", "_change", "_delete", "o1", "s0"]
        for a in range(0, len(stream), width):
            columns = list(zip(*stream[a : a + width], strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names)
            got.append(merge.step(batch))
        got += merge.end()
        flat = [r for b in got if b is not None for r in b.to_pylist()]
        assert [(r["k"], r["v"]) for r in flat if r["_place"] is not None] == want
        assert [r["_place"] for r in flat[:-1]] == list(range(len(want)))
        assert (flat[-1]["_n"], flat[-1]["_dirty"]) == (len(want), dirty)
        flags.add(dirty)
    assert flags == {True, False}
