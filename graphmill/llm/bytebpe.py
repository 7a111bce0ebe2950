"""Byte-level BPE as a monoid: a text's ids are the sum of its halves' ids under a join that only looks at the boundary.

An element is an encoded stretch of text: where its units start, and the ids of each. A unit is a match of the splitting pattern, or
several up to a space before a non-space, where a match begins whatever else the text holds. Two neighbours are joined in two steps, and
in both the rest is proved to be what encoding the whole gives.

Matches: a match that ends before its stretch's end, and starts LOOK characters or more before it, has seen all that decides it. So only
the last units of the left stretch are matched again, on into the right stretch, until a match ends where one of the right stretch's
units begins: matching goes by the place alone from there on.

Ids within one match: no merge of the whole crosses the boundary between neighbouring tokens x and y if none does when the bytes of x
and y are merged alone, since the first merge that crosses would be the first there too. So ids are right if every two neighbours stay
apart. In a join only the tokens at the seam are new neighbours: a window over the seam is merged anew and doubles on each side until
its outer tokens stay apart from those outside.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, column_bytes, release, small_batches, without_clashes

#: Characters of a text, and bytes of a match, that are encoded without halving.
LEAF, MATCH_LEAF = 2048, 128
#: A match can depend on so many characters from its start, or on those up to one after its end: "'re" needs three.
LOOK = 3
#: Units and pairs of tokens that a worker remembers; then it starts anew.
REMEMBERED = 1 << 18
_SPACE_AND_SPACE = re.compile(r" \s")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank. All 256 single bytes must be there."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks lack single bytes")
    return ranks


class Stretch:
    """Encoded text: starts of the units (characters), for each the number of ids before it, and the ids."""

    __slots__ = ("firsts", "ids", "starts")

    def __init__(self):
        self.starts, self.firsts, self.ids = array("q"), array("q"), array("I")

    def add(self, start: int, ids: bytes) -> None:
        self.starts.append(start)
        self.firsts.append(len(self.ids))
        self.ids.frombytes(ids)

    def pop(self) -> tuple[int, list[int]]:
        first = self.firsts.pop()
        ids = self.ids[first:].tolist()
        del self.ids[first:]
        return self.starts.pop(), ids


class ByteBpe(dict):
    """Encodes by ranks. As a mapping it gives the ids of a unit (as bytes of unsigned 32-bit numbers), and remembers them.

    The pattern must match at every place, depend on no text before a match and on no more than LOOK tells after it, and begin a match at
    each space before a non-space. Units of at most MATCH_LEAF bytes are encoded by the tiktoken library; what is joined at a seam may be no
    UTF-8, and is merged here.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.library = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, unit: str) -> bytes:
        if len(unit.encode()) > MATCH_LEAF:
            return b"".join(self._match(m) for m in self.pattern.findall(unit))
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[unit] = array("I", self.library.encode_ordinary(unit)).tobytes()
        return ids

    def _match(self, match: str) -> bytes:
        """A token of just these bytes is the match's only one."""
        data = match.encode()
        return self[match] if len(data) <= MATCH_LEAF else array("I", [self.ranks[data]] if data in self.ranks else self._halves(data)).tobytes()

    def _units(self, text: str) -> list[str]:
        if "\0" in text or _SPACE_AND_SPACE.search(text):
            return self.pattern.findall(text)
        units = text.replace(" ", "\0 ").split("\0")
        return units if units[0] else units[1:]

    def _halves(self, data: bytes) -> list[int]:
        if len(data) <= MATCH_LEAF:
            return self.merged(data)
        return self.joined(self._halves(data[: len(data) // 2]), self._halves(data[len(data) // 2 :]))

    def merged(self, data: bytes) -> list[int]:
        """The lowest rank first, the leftmost among equals, until no two neighbours make a token."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
        due = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(due)
        while due:
            rank, i = heapq.heappop(due)
            if not (j := end[i]) or j >= n or ranks.get(data[i : end[j]]) != rank:
                continue  # one of the two is part of another by now
            end[i], end[j] = end[j], 0
            if (stop := end[i]) < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(due, (r, i))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(due, (r, p))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _apart(self, x: int, y: int) -> bool:
        """No merge crosses from x to y."""
        found = self.apart.get((x, y))
        if found is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            found = self.apart[x, y] = self.merged(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of one match, from those of its two parts."""
        a = b = 0
        if left and right and self._apart(left[-1], right[0]):
            return left + right
        wide_a = wide_b = True
        while True:
            a, b = min(len(left), 2 * a or 1) if wide_a else a, min(len(right), 2 * b or 1) if wide_b else b
            window = self.merged(b"".join(self.bytes_of[i] for i in chain(left[len(left) - a :], right[:b])))
            wide_a = a < len(left) and not self._apart(left[len(left) - a - 1], window[0])
            wide_b = b < len(right) and not self._apart(window[-1], right[b])
            if not wide_a and not wide_b:
                return left[: len(left) - a] + window + right[b:]

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        return self._stretch(text, 0, len(text)).ids

    def _stretch(self, text: str, lo: int, hi: int) -> Stretch:
        if hi - lo > LEAF:
            mid = (lo + hi) // 2
            return self._append(text, self._stretch(text, lo, mid), self._stretch(text, mid, hi), mid, hi)
        out, units = Stretch(), self._units(text[lo:hi])
        ids = [self[u] for u in units]
        for ends, found, first in ((out.starts, units, lo), (out.firsts, ids, 0)):
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // (4 if found is ids else 1)
            ends.frombytes((np.cumsum(sizes) - sizes + first).tobytes())
        out.ids.frombytes(b"".join(ids))
        return out

    def _append(self, text: str, left: Stretch, right: Stretch, mid: int, hi: int) -> Stretch:
        """left, grown by right, which begins at mid and ends at hi."""
        at, last = left.pop()
        seam = at if self.pattern.match(text, at, mid).end() == mid else -1  # one match up to mid
        while left.starts and at + LOOK > mid - LOOK:  # starts too near the seam to have seen all that decides it
            at, _ = left.pop()
        k, n = 0, len(right.starts)
        while at < hi and not (k < n and right.starts[k] == at):
            end = self.pattern.match(text, at, hi).end()
            before = k
            while k < n and right.starts[k] < end:
                k += 1
            if at == seam and end - at > MATCH_LEAF and k == before + 1 and end == (right.starts[k] if k < n else hi) and self.pattern.match(text, mid, hi).end() == end:
                data = text[at:end].encode()
                whole = self.ranks.get(data)
                stop = right.firsts[k] if k < n else len(right.ids)
                left.add(at, array("I", [whole] if whole is not None else self.joined(last, right.ids[right.firsts[before] : stop].tolist())).tobytes())
            else:
                left.add(at, self._match(text[at:end]))
            at = end
        if k < n:
            shift = len(left.ids) - right.firsts[k]
            left.starts.extend(right.starts[k:])
            left.firsts.frombytes((np.frombuffer(right.firsts, np.int64)[k:] + shift).tobytes())
            left.ids.extend(right.ids[right.firsts[k] :])
        return left

    def decode(self, ids: array) -> bytes:
        """The bytes of the halves, one after the other. An id that isn't among the ranks is an error."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


_coders: dict[tuple[bytes, str], ByteBpe] = {}


def coder(ranks: bytes, pattern: str) -> ByteBpe:
    """A worker keeps a coder, and what it remembers, from task to task."""
    if (ranks, pattern) not in _coders:
        _coders.clear()
        _coders[ranks, pattern] = ByteBpe(read_ranks(ranks), pattern)
    return _coders[ranks, pattern]


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, read where the driver can: on its own disk or by any path that Spark reads. Its size is the vocabulary's, not the data's."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return bytes(spark.read.format("binaryFile").load(path).head()["content"])


def numbers(data: bytes) -> array:
    """Unsigned 32-bit numbers from little-endian bytes."""
    out = array("I", data)
    if sys.byteorder == "big":
        out.byteswap()
    return out


def number_bytes(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _texts(column: pa.Array) -> Iterator[str]:
    data, offsets = column_bytes(column)
    for k in range(len(column)):
        yield data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit numbers) and the columns keep of docs (doc_id, text, ...), a row a row.

    Each text is encoded whole, by halves. Null and empty texts have no ids; bytes that aren't UTF-8 count as U+FFFD; special tokens are
    plain text. Repeated rows and null doc_ids come back as they are; an empty table gives no rows. A column in keep called doc_id, text or
    ids gets _in added to its name. Memory in a task: about 20 times its longest text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(file_bytes(spark, ranks_path))
    rows, names = carried(docs, keep, ("ids",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value, pattern)
        for batch in batches:
            ids = pa.array([number_bytes(bpe.encode(t)) for t in _texts(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, *[batch[c] for c in names]], ["doc_id", "ids", *names])
        release()

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in names)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id'].simpleString()}, ids binary" + (f", {schema}" if schema else ""))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (with ids as encode_documents gives them) with decoded binary: the tokens' bytes. Null ids count as none; an unknown id is an error.

    A column of encoded that is called decoded gets _in added to its name.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(file_bytes(spark, ranks_path))
    encoded = without_clashes(encoded, ("decoded",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks.value, pattern)
        for batch in batches:
            data, offsets = column_bytes(batch["ids"])
            found = [bpe.decode(numbers(data[offsets[k] : offsets[k + 1]].tobytes())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"])
        release()

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(None).cast("binary")).schema)


def coding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens long, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again."""
    decoded = decode_documents(encode_documents(docs, ranks_path, pattern), ranks_path, pattern)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
