"""Packing tokenised documents into fixed-length sequences: best fit, then swap-based local search.

Lengths are whole numbers up to the sequence length, so the corpus is packed through its length histogram: at most `limit` numbers,
whatever its size. Bins with the same contents are one entry with a multiplicity. Best fit (longest first) fills bins class by class;
local search then takes all underfull bins, class by class, and exchanges one piece for one, two for one, or moves one, whenever the sum
of squared fills rises, until no step does or no bin can go. The finished plan says, for each length, which runs of pieces of that
length go to which bin and offset; every piece finds its place in it by its rank within its length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, column_bytes, ranges, release, row_slices, saved, small_batches, without_clashes
from .sharding import unit_range

Bins = dict[tuple[int, ...], int]
#: Ranks of one length that the join with the plan takes together.
RANK_BLOCK = 4096


def best_fit(histogram: dict[int, int], limit: int) -> Bins:
    """Bins as {contents in descending order: how many}; longest pieces first, each into the fullest bin that holds it."""
    rooms: dict[int, list[list]] = {}  # room left -> [contents, count] entries
    order: list[int] = []  # rooms that occur, ascending
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            k = bisect_left(order, length)
            if k < len(order):
                room = order[k]
                contents, there = rooms[room][-1]
                if there <= count:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        order.pop(k)
                else:
                    rooms[room][-1][1] -= count
                used = min(count, there)
            else:  # as many of this length in new bins as fit
                room, contents, each = limit, (), limit // length
                if count >= each > 1:
                    used, contents, room = count // each, (length,) * (each - 1), limit - length * (each - 1)
                    count -= used * (each - 1)
                else:
                    used = count if each == 1 else 1
            left, contents = room - length, (*contents, length)
            count -= used
            if left not in rooms:
                rooms[left] = []
                insort(order, left)
            rooms[left].append([contents, used])
    out: Bins = Counter()
    for entries in rooms.values():
        for contents, there in entries:
            out[contents] += there
    return out


class LocalSearch:
    """Steps that raise the sum of squared fills, on classes of equal bins: a step is done at once in as many bins as both classes have.

    A step moves one piece, or exchanges one or two for one, from a bin to a fuller one. The pieces that fuller classes could give up
    (or 0 for a move) are one table, so a class is tried on all of them by one search; what failed isn't tried again.
    """

    def __init__(self, bins: Bins | list[list[int]], limit: int):
        self.limit, self.bins = limit, Counter()
        self.number: dict[tuple[int, ...], int] = {}  # of the classes that have bins
        self.names: list[tuple[int, ...]] = []
        self.rows: list[tuple[int, int, int]] = []  # class number, piece, fill
        self.count = self.total = 0
        for contents, n in bins.items() if isinstance(bins, dict) else Counter(tuple(sorted(b, reverse=True)) for b in bins).items():
            self._add(contents, n)

    def run(self, max_steps: int) -> list[list[int]]:
        return [list(c) for c, n in self.search(max_steps).items() for _ in range(n)]

    def search(self, max_steps: int | None = None) -> Bins:
        """Empties the least filled classes into the others again and again, until no bin can go or no step improves."""
        seen: dict[int, int] = {}  # class number -> rows of the table that it has been tried on
        steps, before = 0, -1
        while steps != before:
            before = steps
            self._compact(seen)
            table, alive = np.zeros((0, 3), np.int64), None
            for a in sorted(self.number, key=lambda c: (sum(c), c)):
                while a in self.number:
                    if self.count < 2 or self.total > (self.count - 1) * self.limit or steps == max_steps:
                        return dict(self.bins)
                    if len(table) < len(self.rows):
                        table = np.concatenate([table, np.array(self.rows[len(table) :], np.int64).reshape(-1, 3)])
                    if alive is None:
                        alive = np.zeros(len(self.names), bool)
                        alive[list(self.number.values())] = True
                    own = self.number[a]
                    found = self._step(a, own, table, alive, seen.get(own, 0))
                    if not found:
                        seen[own] = len(table)
                        break
                    b, give, take = found
                    n = min(self.bins[a], self.bins[b]) if a != b else self.bins[a] // 2
                    self._add(a, -n)
                    self._add(b, -n)
                    for old, less, more in ((a, give, take), (b, take, give)):
                        left = Counter(old)
                        left.subtract(less)
                        left.update(more)
                        self._add(tuple(sorted(left.elements(), reverse=True)), n)
                    alive, steps = None, steps + 1
        return dict(self.bins)

    def _add(self, contents: tuple[int, ...], n: int) -> None:
        if not contents:
            return
        fill = sum(contents)
        before = self.bins[contents]
        self.bins[contents] += n
        self.count, self.total = self.count + n, self.total + n * fill
        if not self.bins[contents]:
            del self.bins[contents], self.number[contents]
        elif not before or before == 1:  # a class of one bin hasn't been tried on itself
            self._enter(contents)

    def _enter(self, contents: tuple[int, ...]) -> None:
        self.number[contents] = len(self.names)
        self.names.append(contents)
        if sum(contents) < self.limit:
            self.rows += [(self.number[contents], y, sum(contents)) for y in (0, *sorted(set(contents)))]

    def _compact(self, seen: dict[int, int]) -> None:
        """Leaves the rows of classes without bins out of the table."""
        kept = [self.number.get(self.names[r[0]]) == r[0] for r in self.rows]
        upto = [0, *np.cumsum(kept).tolist()]
        self.rows = [r for r, k in zip(self.rows, kept, strict=True) if k]
        for k in seen:
            seen[k] = upto[seen[k]]

    def _step(self, a: tuple[int, ...], own: int, table: np.ndarray, alive: np.ndarray, start: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]] | None:
        """The fullest class that a step helps, and the pieces of a and of that class in the step that shifts most."""
        fill = sum(a)
        number, piece, fills = table[start:].T
        ok = alive[number] & (fills >= fill)
        if self.bins[a] < 2:
            ok &= number != own
        at = np.flatnonzero(ok)
        if not len(at):
            return None
        number, piece, fills = number[at], piece[at], fills[at]
        values = sorted(set(a))
        sums = {x + y: (x, y) for k, x in enumerate(values) for y in values[k:] if x != y or a.count(x) > 1} | {x: (x,) for x in values}
        gain = np.zeros(len(at), np.int64)
        for kind, gives in ((piece == 0, np.array(values)), (piece > 0, np.array(sorted(sums)))):
            room = self.limit - fills[kind] + piece[kind]
            k = np.searchsorted(gives, room, "right")
            gain[kind] = np.where(k > 0, gives[k - 1] - piece[kind], 0)
        good = np.flatnonzero(gain > 0)
        if not len(good):
            return None
        best = good[np.lexsort((gain[good], fills[good]))[-1]]
        y = int(piece[best])
        return self.names[number[best]], sums[int(gain[best]) + y], (y,) if y else ()


def pack_histogram(histogram: dict[int, int], limit: int) -> Bins:
    """Best fit, then local search over all underfull bins until no step improves. All pieces are packed."""
    bins = best_fit({x: c for x, c in histogram.items() if c and x > 0}, limit)
    loose = {c: n for c, n in bins.items() if sum(c) < limit}
    out = Counter({c: n for c, n in bins.items() if c not in loose})
    out.update(LocalSearch(loose, limit).search())
    return dict(out)


def placement(bins: Bins) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, offset): ranks in [first, end) of a length go to consecutive bins at one offset."""
    rows, next_rank, first_bin = [], Counter(), 0
    for contents, n in sorted(bins.items()):
        offset = 0
        for length in contents:
            rows.append((length, next_rank[length], next_rank[length] + n, first_bin, offset))
            next_rank[length] += n
            offset += length
        first_bin += n
    return rows


def pack_pieces(pieces: DataFrame, limit: int = 2048, key: str = "doc_id") -> DataFrame:
    """pieces (with key, piece and length long, 1 to limit) with sequence_id and offset long.

    Pieces of one length are ranked in hash ranges of about sqrt(n) rows, so a length that most pieces share is ranked by many tasks.
    Repeated keys are pieces of their own. Empty table: no rows. Columns of pieces called sequence_id or offset, or like this
    operator's own that begin with _, come back with _in added to their name.
    """
    spark = pieces.sparkSession
    pieces = without_clashes(pieces, ("sequence_id", "offset", "_tie", "_len", "_pieces", "_order", "_piece", "_n", "_p", "_start", "_k", "_rank", "_f", "_e", "_b", "_block"))
    columns = pieces.columns
    rows = saved(pieces.withColumn("_tie", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit rows
    plan = placement(pack_histogram(histogram, limit))
    split = {x: max(1, int(n**0.5)) for x, n in histogram.items()}
    widths = spark.createDataFrame([(int(x), int(n)) for x, n in split.items()], "_len long, _pieces long")
    rows = rows.join(F.broadcast(widths), F.col("length") == F.col("_len")).drop("_len")  # at most limit rows
    rows = rows.withColumn("_order", F.xxhash64(F.col(key), "piece", "_tie")).withColumn("_piece", unit_range(F.col("_order"), F.col("_pieces"))).drop("_pieces")
    counts = rows.groupBy("length", "_piece").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("_len"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_piece").orderBy("_order", "_tie")
    rows = rows.withColumn("_k", F.row_number().over(within) - 1)
    rows = rows.join(starts, (F.col("length") == F.col("_len")) & (F.col("_piece") == F.col("_p"))).withColumn("_rank", F.col("_start") + F.col("_k")).drop("_len", "_p", "_start", "_k", "_order", "_piece", "_tie")
    # a run of ranks is met in each block of RANK_BLOCK ranks that it touches: an equality join that no length makes hot
    runs = spark.createDataFrame(plan, "_len long, _f long, _e long, _b long, offset long")
    block = lambda rank: F.floor(rank / RANK_BLOCK)
    runs = runs.withColumn("_block", F.explode(F.sequence(block(F.col("_f")), block(F.col("_e") - 1))))
    inside = (F.col("length") == F.col("_len")) & (block(F.col("_rank")) == F.col("_block")) & (F.col("_f") <= F.col("_rank")) & (F.col("_rank") < F.col("_e"))
    return rows.join(runs, inside).withColumn("sequence_id", F.col("_b") + F.col("_rank") - F.col("_f")).drop("_len", "_f", "_e", "_b", "_block", "_rank").select(*columns, "sequence_id", "offset")


#: Bytes of texts that are tokenised at once, or one text.
TEXT_BYTES = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LONE_MARK, _LETTER, _BREAK = (np.isin(np.arange(256), list(c)) for c in (b".,", bytes(range(97, 123)), b" \n"))
#: Lower-case letters of ASCII and Latin-1, then ASCII marks other than the apostrophe and the special tokens' bracket.
_PLAIN = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:;=-@\\[-`{-~]*)")


class WordTokenizer(dict):
    """Token ids of texts by a `tokenizers` file that never joins across ASCII white space: a chunk between white space is encoded once.

    As a mapping it gives a chunk's ids as little-endian unsigned 32-bit numbers. A chunk of plain letters and marks goes to the file's
    model directly if the file is seen to treat such chunks so (lower case, letters apart from marks, bytes as letters); all others go
    through the whole tokenizer. Texts with a "<" aren't lowered first, as special tokens are matched before. The mapping is emptied
    when it has max_cached chunks.
    """

    def __init__(self, path: str, max_cached: int = 600_000):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_cached = Tokenizer.from_file(path), max_cached
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        byte = {b: x for c, two in letters.items() for b, x in zip(c.encode(), two, strict=True)}
        self.bytes_as_letters = "".join(byte.get(b, chr(b)) for b in range(256))
        probe = "ab,zß ÀÖÿ%& the... A.B# #x ab]] Éa"
        self.direct = False
        direct = [self._plainly(c) for c in probe.split()]
        self.direct = None not in direct and b"".join(x for x in direct if x) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _plainly(self, chunk: str) -> bytes | None:
        """By the model alone: the letters, then the marks; several such stretches in turn. None if the chunk has anything else."""
        chunk, at, ids = chunk.lower(), 0, []
        while at < len(chunk):
            m = _PLAIN.match(chunk, at)
            if m.end() == at:
                return None
            at = m.end()
            for part in m.groups():
                if part:
                    ids += [x.id for x in self.model.tokenize(part if part.isascii() else charmap_decode(part.encode(), "strict", self.bytes_as_letters)[0])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.direct and chunk.isalpha() and chunk.islower():  # ASCII letters alone
            ids = [x.id for x in self.model.tokenize(text)]
            out = self[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            return out
        out = self._plainly(text) if self.direct else None
        out = self[chunk] = self._whole(text) if out is None else out
        return out

    def encode(self, text: bytes) -> bytes:
        return self.encode_all(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text (row of data), as bytes. Arrow finds the distinct chunks, so that only these are looked up one by one."""
        if len(self) > self.max_cached:
            self.clear()
        solid = ~IS_SPACE[data]
        first = solid.copy()  # bytes that begin a chunk
        first[1:] &= ~solid[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        first &= solid
        if self.direct:
            low, mark = LOWER[data], _LONE_MARK[data]
            # a full stop or comma between an ASCII letter and white space is a token of its own in any case
            mark[1:] &= _LETTER[low[:-1]]
            mark[:-1] &= _BREAK[data[1:]]
            mark[:1] = mark[-1:] = False
            for k in np.unique(np.searchsorted(offsets, np.flatnonzero(data == ord("<")), "right") - 1).tolist():
                raw = slice(offsets[k], offsets[k + 1])
                low[raw], mark[raw] = data[raw], False
            data, first = low, first | mark
        begins = np.flatnonzero(first)
        upto = np.concatenate([[0], np.cumsum(solid)])
        ends = np.append(upto[begins], upto[-1]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])]).dictionary_encode()
        distinct, at = column_bytes(chunks.dictionary)
        raw, at = distinct.tobytes(), at.tolist()
        ids = [self[raw[a:b]] for a, b in zip(at, at[1:], strict=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        of = chunks.indices.to_numpy()
        flat = np.frombuffer(b"".join(ids), "<u4")[ranges((np.cumsum(sizes) - sizes)[of], sizes[of])]
        stops = np.concatenate([[0], np.cumsum(sizes[of])])[np.searchsorted(begins, offsets)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(stops, stops[1:], strict=False)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece int, start long, length long, ids_crc32 long: each text's ids and end_id, cut every limit ids only if it is longer.

    A null text is empty: a piece of the end_id alone. The ids themselves aren't kept; `WordTokenizer` gives them again.
    tokenizer_path is read by the executors (an installed package's file).
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:  # a worker keeps its cache from task to task
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tok = _tokenizers[tokenizer_path]
        for b in batches:
            data, off = column_bytes(b["text"])
            out = ([], [], [], [], [])
            texts = (ids for x, y in row_slices(off, TEXT_BYTES) for ids in tok.encode_all(data[off[x] : off[y]], off[x : y + 1] - off[x]))
            for k, ids in enumerate(ids + end for ids in texts):
                for piece, a in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[a : a + 4 * limit]
                    for column, x in zip(out, (k, piece, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=[key, "piece", "start", "length", "ids_crc32"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises, cuts and packs docs: key, piece, start, length, ids_crc32, sequence_id, offset.

    Very long texts become as many pieces as they need; null and empty ones a piece of the end_id; repeated rows are packed each.
    """
    return pack_pieces(tokenized_pieces(docs, tokenizer_path, limit, end_id, key, text), limit, key)
