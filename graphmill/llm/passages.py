"""The exchange that finds repeated windows of a corpus: which windows of a document also start elsewhere.

Both passage operators use it, on windows of words or of bytes, with their own suffix structure as the kernel.

1. Documents are packed into chunks of about CHUNK_BYTES (compressed Arrow), dealt by chunk number and checkpointed. Later joins on the
   chunk number find them in place.
2. Every window has an anchor, the gram of least hash inside it (leftmost if equal), so equal windows have equal anchors at the same
   place. A maximal run of windows with one anchor is a segment. Chunks send 30-bit hashes of their distinct anchors to buckets and get
   back which are repeated. Hash collisions only let a segment through that the exact step then clears.
3. An anchor that stands in very many different segments (a passage with as many surroundings) is hot. Of hot segments the windows
   themselves are asked for in the same way; only runs of repeated windows stay, which are the same wherever the passage is.
4. Chunks send each distinct repeated segment once, whole, to the bucket of its anchor; equal hashes of segments are settled by their
   content. The bucket collapses equal segments and the kernel judges every window of every segment exactly by content.
5. The verdicts go back to the chunks, which mark the covered units.

So texts are shuffled once, and a bucket holds segments, never documents. Memory is bounded by the chunk (about 100 times its bytes
while it is worked on; a text longer than CHUNK_BYTES is a chunk of its own).
"""

from __future__ import annotations

import gc
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _grow, checkpoint_dir, column_bytes, gram_hash, mix, prefix_hash, ranges, release, saved, shuffle_width, sliding_argmin, small_batches, span_hash, word_bounds

_U = np.uint64
CHUNK_BYTES = 1 << 20
#: Different segments in one chunk, or over all chunks (of 256 values of a short hash), from which an anchor is hot.
HOT_IN_CHUNK, HOT_ANYWHERE = 8, 48
#: Units of equal segments that are compared at once.
COMPARED_UNITS = 1 << 19


@dataclass(frozen=True)
class Window:
    units: str  # "words" or "bytes"
    size: int
    gram: int
    across: bool  # True: a window counts as repeated only if it starts in a document with a smaller id; False: anywhere else


#: anchor, content, anchor's place, number of windows, count, least id of each class, grouped by anchor -> a verdict for each window of each class
Kernel = Callable[[list[int], list[bytes], list[int], list[int], list[int], list[int]], list[np.ndarray]]


def _pack(obj: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(obj, protocol=5))


def _unpack(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # noqa: S301  our own shuffle's bytes


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk_id long, chunk_bytes long, chunk binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk_id", "chunk_bytes", "chunk"])

        for b in batches:
            _, off = column_bytes(b["text"])
            at = 0
            while at < b.num_rows:
                stop = int(np.searchsorted(off, off[at] + CHUNK_BYTES - size, "right")) - 1
                stop = min(b.num_rows, max(stop, at + (not size)))
                if stop > at:
                    held.append(b.slice(at, stop - at))
                    size += int(off[stop] - off[at])
                if stop < b.num_rows or size >= CHUNK_BYTES:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
                at = stop
        if held:
            yield flush()

    spark = docs.sparkSession
    packed = docs.mapInArrow(run, "chunk_id long, chunk_bytes long, chunk binary").repartition(shuffle_width(spark), "chunk_id")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan's checkpoint forgets how its rows are dealt
    try:
        checkpoint_dir(spark)
        kept = packed.checkpoint(eager=True)  # not saved(), whose new frame forgets it too: each join would shuffle the chunks again
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    del packed
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # the shuffle's files may go, as the checkpoint has the rows
    return kept


class Segments:
    """A chunk's documents, units, and segments: first window, number of windows, anchor hash and anchor place of each."""

    def __init__(self, chunk: bytes, how: Window):
        self.how = how
        self.rows = pa.ipc.open_stream(chunk).read_all().combine_chunks()
        self.data, self.offsets = column_bytes(self.rows["text"])
        key = self.rows["doc_id"].combine_chunks()
        ids = key.fill_null(np.iinfo(np.int64).max) if key.null_count else key
        self.ids = ids.to_numpy()
        self.prefix = prefix_hash(self.data)
        if how.units == "words":
            self.starts, self.ends, self.bounds = word_bounds(self.data, self.offsets)
            self.unit = span_hash(self.prefix, self.starts, self.ends)
            grams = gram_hash(self.unit, how.gram)
        else:
            self.bounds = self.offsets
            at = np.arange(max(0, len(self.data) - how.gram + 1))
            grams = span_hash(self.prefix, at, at + how.gram)
        self.n, self._run = int(self.bounds[-1]), None
        self.doc = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        anchor = sliding_argmin(grams, how.size - how.gram + 1)
        at = np.flatnonzero(self.doc[: len(anchor)] == self.doc[how.size - 1 : how.size - 1 + len(anchor)])
        place = anchor[at]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        self.first, self.place = at[cut], place[cut]
        self.count = np.diff(np.append(cut, len(at)))
        self.hash = grams[self.place] if len(cut) else np.zeros(0, np.uint64)
        del grams, anchor

    def content(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the units [a, b)."""
        if self.how.units == "bytes":
            return span_hash(self.prefix, a, b)
        power, inverse = _grow(self.n + 1)
        with np.errstate(over="ignore"):
            if self._run is None:
                self._run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.unit * power[: self.n])])
            return mix((self._run[b] - self._run[a]) * inverse[a] + (b - a).astype(np.uint64))

    def _wider(self, of: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        """Which of n keys stand at more than one place, or in more than one document if that is what counts."""
        if not self.how.across:
            return np.bincount(of, minlength=n) > 1
        doc = self.doc[at]
        low, high = np.full(n, 2**31 - 1), np.full(n, -1)
        np.minimum.at(low, of, doc)
        np.maximum.at(high, of, doc)
        return low != high

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors ascending and each segment's place among them."""
        return np.unique(self.hash, return_inverse=True)

    def levels(self, distinct: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor: 0, 1 for repeated, 2 for hot in this chunk; and a short hash of one of its segments."""
        whole = self.content(self.first, self.first + self.count + self.how.size - 1)
        level = self._wider(of, len(distinct), self.first).astype(np.uint32)
        many = np.flatnonzero(np.bincount(of, minlength=len(distinct)) >= HOT_IN_CHUNK)
        if len(many):
            mine = np.flatnonzero(np.isin(of, many))
            pairs = np.unique(np.stack([of[mine].astype(np.uint64), whole[mine]], axis=1), axis=0)[:, 0].astype(np.int64)
            level[(np.bincount(pairs, minlength=len(distinct)) >= HOT_IN_CHUNK) & (level > 0)] = 2
        tag = np.zeros(len(distinct), np.uint8)
        tag[of] = (whole & _U(255)).astype(np.uint8)
        return level, tag

    def hot_windows(self, codes: np.ndarray, of: np.ndarray) -> None:
        """Sets the windows of hot segments: where they start, their segment, their distinct hashes and each one's place among them."""
        self.hot_segments = np.flatnonzero(codes[of] == 2) if len(of) else np.zeros(0, np.int64)
        n = self.count[self.hot_segments]
        self.hot_at = np.repeat(self.first[self.hot_segments], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        self.hot_segment = np.repeat(self.hot_segments, n)
        self.hot_hash, self.hot_of = np.unique(self.content(self.hot_at, self.hot_at + self.how.size), return_inverse=True)

    def hot_levels(self) -> np.ndarray:
        return self._wider(self.hot_of, len(self.hot_hash), self.hot_at).astype(np.uint32)

    def span(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the units under windows first .. first + count - 1."""
        last = first + count + self.how.size - 1
        return (self.starts[first], self.ends[last - 1]) if self.how.units == "words" else (first, last)

    def pieces(self, codes: np.ndarray, of: np.ndarray, hot_codes: np.ndarray) -> None:
        """Sets the segments to send (as `first`, `count`, `place`, `hash`), each one's class, and the classes' representatives."""
        plain = np.flatnonzero(codes[of] == 1) if len(of) else np.zeros(0, np.int64)
        stay = hot_codes[self.hot_of] > 0 if len(self.hot_of) else np.zeros(0, bool)
        at, own = self.hot_at[stay], self.hot_segment[stay]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(at)))
        source = np.concatenate([plain, own[new]])
        self.first, self.count = np.concatenate([self.first[plain], at[new]]), np.concatenate([self.count[plain], size])
        self.place, self.hash = self.place[source], self.hash[source]
        whole = self.content(self.first, self.first + self.count + self.how.size - 1)
        with np.errstate(over="ignore"):
            key = mix(self.hash * _U(0x9FB21C651E98DF25) ^ whole) ^ (self.place - self.first).astype(np.uint64)
        _, self.lead, self.cls, self.times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        unlike = np.flatnonzero(~self._alike(self.lead[self.cls], np.arange(len(self.cls))))
        if len(unlike):  # equal hashes of unequal content: those classes go by the content itself
            names: dict[tuple, int] = {}
            for k in np.flatnonzero(np.isin(self.cls, self.cls[unlike])).tolist():
                at = np.array([k])
                self.cls[k] = len(key) + names.setdefault((int(self.hash[k]), int(self.place[k] - self.first[k]), self._content(at)[0]), len(names))
            _, self.lead, self.cls, self.times = np.unique(self.cls, return_index=True, return_inverse=True, return_counts=True)
        self.least = np.full(len(self.lead), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.cls, self.ids[self.doc[self.first]] if len(self.first) else np.zeros(0, np.int64))

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether segments a[k] and b[k] are the same, unit by unit, with the same anchor."""
        ok = (self.count[a] == self.count[b]) & (self.hash[a] == self.hash[b]) & (self.place[a] - self.first[a] == self.place[b] - self.first[b])
        todo = np.flatnonzero(ok & (a != b))
        size = self.count[a[todo]] + self.how.size - 1
        step = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + COMPARED_UNITS, COMPARED_UNITS))
        for s, e in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            at, n = todo[s:e], size[s:e]
            if not len(at):
                continue
            x, y = ranges(self.first[a[at]], n), ranges(self.first[b[at]], n)
            if self.how.units == "words":
                long, other = self.ends[x] - self.starts[x], self.ends[y] - self.starts[y]
                same = np.logical_and.reduceat(long == other, np.cumsum(n) - n)
                ok[at[~same]] = False
                keep = np.repeat(same, n)
                at, n, x, y, long = at[same], n[same], x[keep], y[keep], long[keep]
                if not len(at):
                    continue
                n = np.add.reduceat(long, np.cumsum(n) - n)
                x, y = ranges(self.starts[x], long), ranges(self.starts[y], long)
            ok[at[~np.logical_and.reduceat(self.data[x] == self.data[y], np.cumsum(n) - n)]] = False
        return ok

    def _content(self, segments: np.ndarray) -> list[bytes]:
        """Of segments, words joined by one space."""
        raw = self.data.tobytes()
        a, b = self.span(self.first[segments], self.count[segments])
        if self.how.units == "words":
            return [b" ".join(raw[x:y].split()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def contents(self) -> list[bytes]:
        return self._content(self.lead)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(bucket) else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[s]]), order[s:e]


def _rows(rows: list[tuple[int, int, bytes]], names: tuple[str, str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=list(names))


def _gathered(x: pa.Scalar | None) -> dict[int, bytes]:
    return {y["bucket"]: y["reply"] for y in (x.as_py() or [])} if x is not None else {}


def repeated_units(docs: DataFrame, how: Window, kernel: Kernel, finish: Callable[[Segments, np.ndarray], pa.RecordBatch], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """finish(segments, covered bool per unit) of every chunk: rows of schema. docs has doc_id long, text and keep.

    A null text is empty; a null doc_id ranks after all others; rows that share a doc_id are documents of their own that have the same
    id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    chunks = _chunks(texts)
    width = max(shuffle_width(spark), math.ceil((chunks.agg(F.sum("chunk_bytes")).first()[0] or 0) / (8 << 20)))

    def questions(cid: int, hashes: np.ndarray, level: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        low = ((hashes & _U((1 << 30) - 1)).astype(np.uint32) << 2) | level
        return _rows([(k, cid, low[at].tobytes() + tag[at].tobytes()) for k, at in _by_bucket(((hashes >> _U(34)) % _U(width)).astype(np.int64))], ("bucket", "chunk_id", "asked"))

    def answers(hashes: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
        codes = np.zeros(len(hashes), np.uint8)
        for k, at in _by_bucket(((hashes >> _U(34)) % _U(width)).astype(np.int64)):
            codes[at] = np.frombuffer(_unpack(replies[k]), np.uint8)
        return codes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, chunk in zip(b["chunk_id"].to_pylist(), b["chunk"], strict=True):
                seg = Segments(chunk.as_buffer(), how)
                distinct, of = seg.anchors()
                yield questions(cid, distinct, *seg.levels(distinct, of))
        release()

    def ask_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, chunk, mask in zip(b["chunk_id"].to_pylist(), b["chunk"], b["mask"], strict=True):
                seg = Segments(chunk.as_buffer(), how)
                distinct, of = seg.anchors()
                seg.hot_windows(answers(distinct, _gathered(mask)), of)
                yield questions(cid, seg.hot_hash, seg.hot_levels(), np.zeros(len(seg.hot_hash), np.uint8))
        release()

    def answer(group: pa.Table) -> pa.Table:
        """0 for unique, 1 for repeated, 2 for hot."""
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in group["asked"]]
        sizes = [len(x) // 5 for x in raw]
        whole, tag = np.concatenate([x[: 4 * n].view(np.uint32) for x, n in zip(raw, sizes, strict=True)]), np.concatenate([x[4 * n :] for x, n in zip(raw, sizes, strict=True)])
        distinct, of, chunks_with = np.unique(whole >> 2, return_inverse=True, return_counts=True)
        most = np.zeros(len(distinct), np.uint32)
        np.maximum.at(most, of, whole & 3)
        code = ((chunks_with > 1) | (most > 0)).astype(np.uint8)
        wide = np.flatnonzero(chunks_with >= HOT_ANYWHERE)
        mine = np.flatnonzero(np.isin(of, wide))
        tags = np.bincount(np.unique((of[mine] << 8) | tag[mine]) >> 8, minlength=len(distinct))
        code[(most > 1) | (tags >= HOT_ANYWHERE)] = 2
        replies = [_pack(x.tobytes()) for x in np.split(code[of], np.cumsum(sizes)[:-1])]
        return pa.table({"chunk_id": group["chunk_id"], "bucket": group["bucket"], "reply": pa.array(replies, pa.binary())})

    reply_schema = "chunk_id long, bucket long, reply binary"
    gather = lambda df, name: df.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
    ask_schema = "bucket long, chunk_id long, asked binary"
    replied = lambda asked, name: saved(gather(asked.groupBy("bucket").applyInArrow(answer, reply_schema), name))
    texts_only = chunks.select("chunk_id", "chunk")
    masked = texts_only.join(replied(texts_only.mapInArrow(ask, ask_schema), "mask"), "chunk_id", "left")
    masked = masked.join(replied(masked.mapInArrow(ask_hot, ask_schema), "hot"), "chunk_id", "left")

    def prepared(chunk: pa.Scalar, mask: pa.Scalar, hot: pa.Scalar) -> Segments:
        seg = Segments(chunk.as_buffer(), how)
        distinct, of = seg.anchors()
        codes = answers(distinct, _gathered(mask))
        seg.hot_windows(codes, of)
        seg.pieces(codes, of, answers(seg.hot_hash, _gathered(hot)))
        return seg

    bucket_of = lambda seg: ((mix(seg.hash[seg.lead]) >> _U(20)) % _U(width)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, chunk, mask, hot in zip(b["chunk_id"].to_pylist(), b["chunk"], b["mask"], b["hot"], strict=True):
                seg = prepared(chunk, mask, hot)
                text, out = seg.contents(), []
                lead = seg.lead
                for k, at in _by_bucket(bucket_of(seg)):
                    at_lead = lead[at]
                    out.append((k, cid, _pack((seg.hash[at_lead], (seg.place - seg.first)[at_lead].astype(np.int32), seg.count[at_lead].astype(np.int32), seg.times[at].astype(np.int64), seg.least[at], [text[x] for x in at.tolist()]))))
                yield _rows(out, ("bucket", "chunk_id", "sent"))
        release()

    def judge(group: pa.Table) -> pa.Table:
        classes: dict[tuple[int, int, bytes], int] = {}
        anchor, place, windows, times, least, text, entries = [], [], [], [], [], [], []
        for x in group["sent"]:
            h, p, n, c, low, contents = _unpack(x.as_buffer())
            mine = []
            for key in zip(h.tolist(), p.tolist(), contents, strict=True):
                mine.append(classes.setdefault(key, len(classes)))
            for k, key, nk, ck, lk in zip(mine, zip(h.tolist(), p.tolist(), contents, strict=True), n.tolist(), c.tolist(), low.tolist(), strict=True):
                if k == len(text):
                    anchor.append(key[0])
                    place.append(key[1])
                    windows.append(nk)
                    times.append(ck)
                    least.append(lk)
                    text.append(key[2])
                else:
                    times[k] += ck
                    least[k] = min(least[k], lk)
            entries.append(mine)
        order = sorted(range(len(text)), key=anchor.__getitem__)
        verdict: list[np.ndarray | None] = [None] * len(text)
        for k, v in zip(order, kernel(*[[x[k] for k in order] for x in (anchor, text, place, windows, times, least)]), strict=True):
            verdict[k] = v
        replies = [_pack(np.concatenate([verdict[k] for k in mine]).tobytes()) for mine in entries]
        del classes, text, entries, verdict
        release()
        return pa.table({"chunk_id": group["chunk_id"], "bucket": group["bucket"], "reply": pa.array(replies, pa.binary())})

    sent = masked.mapInArrow(send, "bucket long, chunk_id long, sent binary")
    verdicts = gather(sent.groupBy("bucket").applyInArrow(judge, reply_schema), "verdict")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, mask, hot, verdict in zip(b["chunk"], b["mask"], b["hot"], b["verdict"], strict=True):
                seg, replies = prepared(chunk, mask, hot), _gathered(verdict)
                covered = np.zeros(seg.n, bool)
                if len(seg.lead):
                    sizes = seg.count[seg.lead]
                    start = np.cumsum(sizes) - sizes
                    found = np.zeros(int(sizes.sum()), np.int64 if how.across else bool)
                    for k, at in _by_bucket(bucket_of(seg)):
                        n = sizes[at]
                        to = np.repeat(start[at], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                        found[to] = np.frombuffer(_unpack(replies[k]), found.dtype)
                    n = seg.count
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    value = found[np.repeat(start[seg.cls], n) + step]
                    at = np.repeat(seg.first, n) + step
                    hit = at[value < np.repeat(seg.ids[seg.doc[seg.first]], n)] if how.across else at[value]
                    change = np.zeros(seg.n + 1, np.int64)
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + how.size, -1)
                    covered = np.cumsum(change[:-1]) > 0
                yield finish(seg, covered)
        release()

    return masked.join(verdicts, "chunk_id", "left").select("chunk", "mask", "hot", "verdict").mapInArrow(close, schema)
