"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most 2 s - 1 bits, cut into only s segments, have one segment that differs in at most one bit. So
every distinct fingerprint is indexed under its one-wildcard variants: each segment with each of its bits blanked. Fingerprints that
link share a variant (equality), candidates are verified, and what is linked forms connected components.

`near_duplicates` takes 64 bits in two segments and links at up to 3 bits; exact copies are one fingerprint from the start. A variant's
fingerprints are streamed in order, and a task reports a spanning tree of what they link, never all pairs. A variant that more than
WIDE_RUN fingerprints share is dealt again over all tasks, by the other segment's own variants; those groups hold at most 2^18.

`near_copies` links texts by the exact Jaccard similarity of their shingle sets. Similarity 0.8 moves 15 % of a fingerprint's bits, so its
fingerprints are longer: segments of about log2 n bits, as many as make a pair at the threshold meet with the stated recall. A variant's
texts are compared by 128 bits in a sliding window, so that a large group never gives all its pairs, and candidates by their whole
shingle sets. Where more texts share a variant than the window holds, `_rest` then compares all of them that are still in different
components, in tasks that hold a part of the shingle sets, stream others past them and give back edges, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from .common import column_bytes, dropped, gram_hash, mix, prefix_hash, ranges, release, row_slices, saved, shuffle_width, small_batches, span_hash, tidy, word_bounds
from .components import components

_U = np.uint64
#: Above so many fingerprints a shared variant is dealt again.
WIDE_RUN = 4096
#: So many texts that share a variant, and one, are compared with each other; a later one with this many neighbours before it.
WINDOW, NEIGHBOURS = 16, 1
#: Members of a larger variant that are compared at once.
BLOCK = 4096
#: Texts that are compared at once with those a task holds.
HOME = 512
#: Of a cluster: texts and bytes of shingle sets that a task holds at most, about; fewer texts, but PART_LEAST, where that costs few copies.
PART_MOST, PART_BYTES, PART_LEAST, PART_COPIES = 16_384, 32 << 20, 64, 16
#: Bytes of shingle sets that are copied to the tasks at once, where the clusters have no more themselves.
COPIED_BYTES = 256 << 20
#: Variants of a text that are shuffled at once, and what one task sorts.
ROUND_VARIANTS, TASK_ROWS = 128, 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit majority of the XXH64 hashes of the word shingles, A-Z lower-cased; no words: 0."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends.tolist()[shingle - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=False)], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp long (the 64 bits, signed) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b["text"])
            raw, at = data.tobytes(), off.tolist()
            fp = np.array([fingerprint(raw[x:y], shingle, seed) for x, y in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


class Forest:
    """Union-find that keeps edges that connect what was linked: few at every node, so no hub arises."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        top = x
        while (y := self.up.setdefault(top, top)) != top:
            top = y
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def join(self, members: list[int]) -> None:
        """All of members are connected: a binary tree of edges."""
        for k in range(1, len(members)):
            self.link(members[(k - 1) // 2], members[k])


def reached(n: int, near) -> Iterator[list[int]]:
    """Components of 0 .. n - 1 with two members or more; near(k, rest) says which of rest link with k. Each takes its neighbours out of those not yet reached."""
    rest = np.arange(n)
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        for k in todo:  # grows
            if not len(rest):
                break
            hit = near(k, rest)
            todo += rest[hit].tolist()
            rest = rest[~hit]
        if len(todo) > 1:
            yield todo


def _walk(fps: np.ndarray, bits: int, out: Forest) -> None:
    """What a small set of distinct fingerprints links."""
    for group in reached(len(fps), lambda k, rest: np.bitwise_count(fps[rest] ^ fps[k]) <= bits):
        out.join(fps[group].tolist())


def variants(classes: DataFrame, length: int, *carried: str, covered: bool = False) -> DataFrame:
    """variant long and carried: the one-wildcard variants of classes.segments (an array of numbers of length bits). With covered, the
    bit under the wildcard is added as the lowest one."""
    parts = classes.select(*carried, F.posexplode("segments").alias("s", "part"))
    blanked = parts.select(*carried, "s", "part", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("w"))
    kept = F.col("part").bitwiseAND(F.expr("~shiftleft(1L, w)"))
    number = F.shiftleft((F.col("s") * length + F.col("w")).cast("long"), length).bitwiseOR(kept)
    number = F.shiftleft(number, 1).bitwiseOR(F.expr("shiftright(part, w) & 1")) if covered else number
    return blanked.select(number.alias("variant"), *carried)


def _dealt(rows: DataFrame, n: int, key: str | Column, *order: str) -> DataFrame:
    """rows dealt by key to tasks that sort about TASK_ROWS each (and spill what they can't hold)."""
    return rows.repartition(max(shuffle_width(rows.sparkSession), math.ceil(n / TASK_ROWS)), key).sortWithinPartitions(key, *order)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """key and the fps of each stretch of equal keys that is longer than one; None for fps if they are more than most."""
    key, held, dropping = None, np.zeros(0, np.uint64), False
    for b in batches:
        keys, fps = b["variant"].to_numpy(), b["fp"].to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        lone = np.diff(cuts) == 1
        for k in range(len(cuts) - 1):
            if lone[k] and 0 < k < len(cuts) - 2:
                continue
            mine, part = int(keys[cuts[k]]), fps[cuts[k] : cuts[k + 1]]
            if mine != key:
                if dropping or len(held) > 1:
                    yield key, None if dropping else held
                key, held, dropping = mine, part, False
            elif not dropping:
                held = np.concatenate([held, part])
            if len(held) > most:
                held, dropping = held[:0], True
    if dropping or len(held) > 1:
        yield key, None if dropping else held


def _linked_runs(rows: DataFrame, n: int, bits: int, most: int) -> DataFrame:
    """u, v: edges among the fps of a variant; u alone: a variant of more than most fps, which are left out."""
    small_batches(rows.sparkSession, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, wide = Forest(), []
        for key, fps in _runs(batches, most):
            if fps is None:
                wide.append(key)
            else:
                _walk(fps, bits, out)
        pairs = np.array(out.edges, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], np.array(wide, np.int64)])), pa.array([*pairs[:, 1].tolist(), *[None] * len(wide)], pa.int64())], names=["u", "v"])

    return _dealt(rows, n, "variant").mapInArrow(run, "u long, v long")


def _other_variants(rows: DataFrame) -> DataFrame:
    """variant, fp of rows (variant, fp): a variant of the other segment's halves is added, of which one differs in at most one bit."""
    other = F.when(F.col("variant") < F.shiftleft(F.lit(32).cast("long"), 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    cut = rows.select("variant", "fp", F.posexplode(F.array(other.bitwiseAND(0xFFFF), F.shiftrightunsigned(other, 16))).alias("half", "part"))
    cut = cut.select("variant", "fp", "half", "part", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("w"))
    mark = F.shiftleft((F.col("half") * 16 + F.col("w")).cast("long"), 16).bitwiseOR(F.col("part").bitwiseAND(F.expr("~shiftleft(1L, w)")))
    return cut.select(F.shiftleft("variant", 21).bitwiseOR(mark).alias("variant"), "fp")


def fingerprint_links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """u, v long: edges between distinct fingerprints (classes.fp) that connect all that differ in 1 to bits (at most 3) bits."""
    if not 0 < bits <= 3:
        raise ValueError("two segments with one wildcard find at most 3 differing bits")
    n = classes.count() * 64
    all_variants = variants(classes.select("fp", F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)).alias("segments")), 32, "fp")
    found = saved(_linked_runs(all_variants, n, bits, WIDE_RUN))
    wide = found.where("v is null and u is not null").select(F.col("u").alias("variant"))
    edges = found.where("v is not null")
    if wide.isEmpty():
        return edges
    again = saved(_other_variants(all_variants.join(wide, "variant", "left_semi")))
    return edges.union(_linked_runs(again, again.count(), bits, 1 << 18))  # 16 free bits and two wildcards: no more than 2^18


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (least key reachable over links, itself included) for every row of docs.

    Null text: as empty, fingerprint zero, which links like any other. Null keys take part but never name a component. Repeated rows
    give repeated results. Empty table: no rows.
    """
    rows = saved(fingerprints(docs, shingle, key=key, text=text))
    classes = saved(rows.groupBy("fp").agg(F.min(key).alias("first")))
    roots = components(fingerprint_links(classes, bits))
    named = classes.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(ids, F.col("fp") == F.col("_fp")).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(column: pa.Array, shingle: int = 5) -> Iterator[np.ndarray]:
    """For each row the distinct hashes of its word shingles; of all words if they are fewer; none without words. A-Z lower-cased."""
    data, off = column_bytes(column)
    for x, y in row_slices(off):
        part = _LOWER[data[off[x] : off[y]]]
        starts, ends, before = word_bounds(part, off[x : y + 1] - off[x])
        words = span_hash(prefix_hash(part), starts, ends)
        grams = gram_hash(words, shingle)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else gram_hash(words[a:b], b - a) if b > a else grams[:0]


def long_fingerprint(grams: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits (as 0 and 1): of a shingle set, the majority of each bit of its hashes."""
    times = mix(np.arange(1, words + 1, dtype=np.uint64)) | _U(1)
    ones = np.zeros(64 * words, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(grams), 255):  # a byte holds the sums of 255 rows
            ones += np.unpackbits(mix(grams[k : k + 255, None] * times).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(grams)).astype(np.uint8)


def segment_shape(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Length and number of segments for n texts: a pair at the similarity differs in at most one bit of some segment with probability recall."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi  # share of bits in which two sets of one size differ
    length = min(40, max(16, math.ceil(math.log2(max(2, n))) + 1))
    meet = min(0.999999, (1 - apart) ** length + length * apart * (1 - apart) ** (length - 1))
    return length, max(math.ceil(128 / length), math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _sketches(docs: DataFrame, shingle: int, length: int, segments: int) -> DataFrame:
    """doc_id, mark (of the text as it is), cls and more long (128 bits of its words), segments array<long> (null without words), a and b long: 128 bits, size int: shingles."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, words = 1 << np.arange(length, dtype=np.int64), math.ceil(length * segments / 64)
        for batch in batches:
            data, off = column_bytes(batch["text"])
            raw, at = data.tobytes(), off.tolist()
            words_of = b"".join([xxhash.xxh3_128_digest(b" ".join(raw[x:y].lower().split())) for x, y in zip(at, at[1:], strict=False)])
            cls = np.frombuffer(words_of, np.int64).reshape(-1, 2)
            sets = list(shingle_sets(batch["text"], shingle))
            bits = np.stack([long_fingerprint(s, words) for s in sets]) if sets else np.zeros((0, 64 * words), np.uint8)
            parts = bits[:, : length * segments].reshape(len(sets), segments, length) @ powers
            check = np.packbits(bits[:, :128], axis=1).view(np.int64)
            none = np.array([not len(s) for s in sets], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * segments), pa.array(parts.ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(cls[:, 0]), pa.array(cls[:, 1]), lists, pa.array(check[:, 0]), pa.array(check[:, 1]), pa.array([len(s) for s in sets], pa.int32())], names=["doc_id", "mark", "cls", "more", "segments", "a", "b", "size"])
        release()

    return _marked(docs).select("doc_id", "mark", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark string, cls long, more long, segments array<long>, a long, b long, size int")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mark", F.coalesce(F.md5("text"), F.lit("")))


def window_pairs(batches: Iterator[pa.RecordBatch], most: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """u, v, differing bits: pairs of equal variant whose 128 bits differ in at most most. All pairs among the first WINDOW + 1 rows of a
    variant, and of a segment's first wildcard each later row with NEIGHBOURS before it (`_rest` decides the others). Rows have their variant's
    number and, as its lowest bit, what the wildcard covers: two equal segments share all variants of length, so that pair is given by the first of
    them alone."""
    names = ("variant", "cls", "a", "b")
    held = [np.zeros(0, np.int64)] * 6
    for batch in batches:
        new = [batch[c].to_numpy() for c in names]
        covered, new[0] = new[0] & 1, new[0] >> 1
        n, old = len(new[0]), len(held[0])
        if not n:
            continue
        begins = np.concatenate([[True], new[0][1:] != new[0][:-1]])
        place = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        if old and held[0][-1] == new[0][0]:
            place[np.cumsum(begins) == 1] += held[4][-1] + 1
        key, cls, a, b, place, covered = (np.concatenate([h, x]) for h, x in zip(held, (*new, place, covered), strict=True))
        at, first = np.arange(len(key)), (key >> length) % length == 0
        for d in range(1, WINDOW + 1):
            at = at[at + d < len(key)]
            at = at[key[at + d] == key[at]]  # keys are sorted: what fails here fails farther on
            if not len(at):
                break
            x = at[(at + d >= old) & ((d <= NEIGHBOURS) & first[at] | (place[at + d] <= WINDOW)) & (first[at] | (covered[at] != covered[at + d]))]
            apart = np.bitwise_count((a[x] ^ a[x + d]).view(np.uint64)).astype(np.int32) + np.bitwise_count((b[x] ^ b[x + d]).view(np.uint64))
            x, apart = x[apart <= most], apart[apart <= most]
            if len(x):
                yield cls[x], cls[x + d], apart
        held = [h[-WINDOW:] for h in (key, cls, a, b, place, covered)]


class WideVariants:
    """The variants that more rows share than the window holds, as blocks of at most BLOCK members: (variant, block, cls, covered)."""

    def __init__(self, length: int) -> None:
        self.length, self.blocks = length, []
        self.held, self.number = [np.zeros(0, np.int64)] * 3, 0

    def watch(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """batches as they are, sorted by variant; their wide variants are noted."""
        for batch in batches:
            numbers = batch["variant"].to_numpy()
            rows = [np.concatenate([h, x]) for h, x in zip(self.held, (numbers >> 1, batch["cls"].to_numpy(), numbers & 1), strict=True)]
            key = rows[0]
            if len(key):
                cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
                for k in np.flatnonzero((np.diff(cuts) > WINDOW + 1) | ((cuts[:-1] == 0) & (self.number > 0)))[: len(cuts) - 1].tolist():
                    if k < len(cuts) - 2:
                        self._note(*[x[cuts[k] : cuts[k + 1]] for x in rows])
                if len(cuts) > 2:
                    self.number = 0
                at = int(cuts[-2])
                while len(key) - at > BLOCK:
                    self._block(*[x[at : at + BLOCK] for x in rows])
                    at += BLOCK
                self.held = [x[at:] for x in rows]
            yield batch
        if len(self.held[0]) > WINDOW + 1 or self.number:
            self._note(*self.held)

    def _note(self, key: np.ndarray, cls: np.ndarray, covered: np.ndarray) -> None:
        """The rest of a variant, which ends here."""
        for x in range(0, len(cls), BLOCK):
            self._block(key[x : x + BLOCK], cls[x : x + BLOCK], covered[x : x + BLOCK])
        self.number = 0

    def _block(self, key: np.ndarray, cls: np.ndarray, covered: np.ndarray) -> None:
        variant = int(key[0])
        if self.number or len(cls) == BLOCK or (variant >> self.length) % self.length == 0 or covered.min() != covered.max():
            self.blocks.append((variant, self.number, cls, covered))  # others are pairs of equal segments, which the first wildcard gives
        self.number += 1

    def taken(self) -> list[tuple]:
        out, self.blocks = self.blocks, []
        return out


def _most_apart(similarity: float) -> int:
    """Bits of 128 in which a pair at the similarity differs at most, but once in a thousand."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(128 * share + 3.1 * math.sqrt(128 * share * (1 - share)))


def _rounds(classes: DataFrame, length: int, segments: int, *carried: str) -> Iterator[tuple[int, DataFrame]]:
    """First segment and dealt variants (of covered kind), a few segments at a time, which bounds what is shuffled at once."""
    n, each = classes.count(), max(1, ROUND_VARIANTS // length)
    for first in range(0, segments, each):
        small_batches(classes.sparkSession, 20_000)
        part = classes.where("segments is not null").select(*carried, F.slice("segments", first + 1, each).alias("segments"))
        yield first, _dealt(variants(part, length, *carried, covered=True), n * length * min(each, segments - first), F.shiftright("variant", 1), "cls")
        tidy(classes.sparkSession)


def _candidates(classes: DataFrame, length: int, segments: int, similarity: float) -> tuple[DataFrame, set[int]]:
    """u, v, apart: distinct pairs of classes that share a variant and whose 128 bits are as near as similarity makes them; and the
    rounds (their first segments) that have wide variants."""
    most = _most_apart(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        wide, any_wide = WideVariants(length), False
        for u, v, apart in window_pairs(wide.watch(batches), most, length):
            found.update(zip(zip(u.tolist(), v.tolist(), strict=True), apart.tolist(), strict=True))
            any_wide |= bool(wide.taken())
            if len(found) > 200_000:
                yield batch_of(found, False)
                found = {}
        yield batch_of(found, any_wide or bool(wide.taken()))
        release()

    def batch_of(found: dict[tuple[int, int], int], any_wide: bool) -> pa.RecordBatch:
        pairs, mark = np.array(list(found), np.int64).reshape(-1, 2), [None] * any_wide
        columns = [pa.array([*x, *mark], t) for x, t in ((pairs[:, 0].tolist(), pa.int64()), (pairs[:, 1].tolist(), pa.int64()), (found.values(), pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v", "apart"])

    rounds = {first: saved(rows.mapInArrow(run, "u long, v long, apart int")) for first, rows in _rounds(classes, length, segments, "cls", "a", "b")}
    wide = {first for first, made in rounds.items() if not made.where("u is null").isEmpty()}
    out = rounds[0]
    for first in [*rounds][1:]:
        out = out.union(rounds[first])
    out = saved(out.where("u is not null").groupBy("u", "v").agg(F.min("apart").alias("apart")))
    dropped(*rounds.values())
    return out, wide


def _home(roots: DataFrame, name: str, root: str) -> DataFrame:
    return roots.select(F.col("u").alias(name), F.col("root").alias(root))


class Home:
    """Texts that are compared with each other's and another home's: root, 128 bits (a, b), segments and shingle set of each; where a text may come on
    both sides, cls and probe."""

    def __init__(self, fields: dict[str, np.ndarray]):
        self.root, self.a, self.b, self.sizes, self.grams = (fields[c] for c in ("root", "a", "b", "sizes", "grams"))
        self.cls, self.probe = fields.get("cls"), fields.get("probe")
        self.segments = fields["segments"].reshape(len(self.root), -1)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def set_of(self, k: int) -> np.ndarray:
        return self.grams[self.starts[k] : self.starts[k] + self.sizes[k]]

    def shared(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of grams each text of at has."""
        if len(at) < 8:
            return np.array([len(np.intersect1d(grams, self.set_of(k), assume_unique=True)) for k in at.tolist()], np.int64)
        if self._index is None:
            order = np.argsort(self.grams, kind="stable")
            values, first = np.unique(self.grams[order], return_index=True)
            self._index = values, np.append(first, len(order)), np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        values, first, texts = self._index
        k = np.searchsorted(values, grams)
        k = k[(k < len(values)) & (values[np.minimum(k, len(values) - 1)] == grams)]
        return np.bincount(texts[ranges(first[k], first[k + 1] - first[k])], minlength=len(self.sizes))[at]


def links_between(x: Home, y: Home, most: int, least: Fraction, forest: Forest | None = None) -> list[tuple[int, int]]:
    """Edges between roots that connect all those with texts in x and y that share a variant, differ in at most most of 128 bits and have shingle
    sets of similarity least: fewer edges than roots, whatever the pairs. Texts of roots that are connected already (in forest, if it is given, which
    takes the edges) aren't decided. Of two probes that come on both sides, x has the one of the lesser cls."""
    forest = Forest() if forest is None else forest
    roots = y.root.tolist()
    for k, own in enumerate(x.root.tolist()):
        apart = np.bitwise_count((y.a ^ x.a[k]).view(np.uint64)).astype(np.int32) + np.bitwise_count((y.b ^ x.b[k]).view(np.uint64))
        ok = (apart <= most) & (y.root != own)
        if x is y:
            ok[: k + 1] = False
        elif y.probe is not None:
            ok &= ~y.probe | (y.cls > x.cls[k])
        at = np.flatnonzero(ok)
        at = at[(np.bitwise_count((y.segments[at] ^ x.segments[k]).view(np.uint64)) <= 1).any(axis=1)]
        if forest.edges:
            top = forest.find(own)
            at = np.array([o for o in at.tolist() if forest.find(roots[o]) != top], np.int64)
        if len(at):
            near = y.shared(x.set_of(k), at) * (least.numerator + least.denominator) >= least.numerator * (x.sizes[k] + y.sizes[at])
            for o in at[near].tolist():
                forest.link(own, roots[o])
    return forest.edges


def _stars(named: DataFrame, length: int, segments: int, wide: set[int]) -> DataFrame:
    """u, v: edges that connect the roots that meet in a wide variant; named has cls, root and segments. A root has an edge a variant and task, however
    many texts it has there. No edge: wide variants lie in one component each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, found, at, first = WideVariants(length), set(), None, None
        watched = shared.watch(batches)
        while True:
            more = next(watched, None)
            for variant, _, roots, _ in shared.taken():
                if variant != at:
                    at, first = variant, int(roots[0])
                found.update((r, first) for r in np.unique(roots).tolist() if r != first)
            if more is None or len(found) > 100_000:
                ends = np.array(list(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])
                found.clear()
            if more is None:
                break
        release()

    as_cls = named.select(F.col("root").alias("cls"), "segments")
    rounds = [saved(rows.mapInArrow(run, "u long, v long")) for first, rows in _rounds(as_cls, length, segments, "cls") if first in wide]
    out = rounds[0]
    for made in rounds[1:]:
        out = out.union(made)
    out = saved(out.distinct())
    dropped(*rounds)
    return out


def _with_sets(nodes: DataFrame, shingle: int) -> DataFrame:
    """nodes with grams binary, the shingle set, for text."""
    small_batches(nodes.sparkSession, 500)
    kept = [c for c in nodes.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(b["text"], shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], sets], names=[*kept, "grams"])
        release()

    return nodes.mapInArrow(run, ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept) + ", grams binary")


def _linked_parts(rows: DataFrame, width: int, most: int, least: Fraction) -> DataFrame:
    """u, v: edges between roots, of rows (cluster, part, second, and Home's): each part's texts are held, then those that come second are compared with them."""
    small_batches(rows.sparkSession, HOME)

    def home_of(parts: list[pa.RecordBatch]) -> Home:
        table = pa.Table.from_batches(parts)
        fields = {c: table[c].to_numpy() for c in ("cls", "probe", "root", "a", "b")}
        data, off = column_bytes(table["grams"])
        flat = table["segments"].combine_chunks().flatten().to_numpy()
        return Home(fields | {"segments": flat, "sizes": np.diff(off) // 8, "grams": np.frombuffer(data.tobytes(), np.uint64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, home, forest, edges = None, [], None, Forest(), []

        def batch_of() -> pa.RecordBatch:
            ends = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

        for b in batches:
            cluster, part, second = (b[c].to_numpy(zero_copy_only=False) for c in ("cluster", "part", "second"))
            cuts = np.flatnonzero((cluster[1:] != cluster[:-1]) | (part[1:] != part[:-1]) | (second[1:] != second[:-1])) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if x == y:
                    continue
                here, rows = (int(cluster[x]), int(part[x])), b.slice(x, y - x)
                if here != at:
                    edges += forest.edges
                    at, held, home, forest = here, [], None, Forest()
                    if len(edges) > 50_000:
                        yield batch_of()
                        edges = []
                if not second[x]:
                    held.append(rows)
                elif held or home:
                    home, held = home or home_of(held), []
                    links_between(home_of([rows]), home, most, least, forest)
        edges += forest.edges
        yield batch_of()
        release()

    return rows.repartition(width, "cluster", "part").sortWithinPartitions("cluster", "part", "second").mapInArrow(run, "u long, v long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots with new links: only the components that these connect are looked at again."""
    ends = links.join(_home(roots, "u", "root_u"), "u", "left").join(_home(roots, "v", "root_v"), "v", "left")
    moved = saved(components(ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))))
    now = roots.join(_home(moved, "_old", "_new"), F.col("root") == F.col("_old"), "left")
    return saved(now.select("u", F.coalesce("_new", "root").alias("root")).union(moved.select("u", "root")))


def _clusters(named: DataFrame, stars: DataFrame) -> DataFrame:
    """root, cluster, probe, parts, copied of the roots that stars connect. The cluster's largest component isn't a probe; parts is the number of tasks
    that its texts are dealt to, copied the bytes that its probes have in all of these."""
    met = saved(components(stars))
    of = met.select(F.col("u").alias("_root"), F.col("root").alias("cluster")).union(met.select("root", "root").distinct())
    sizes = named.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long") * 8).alias("bytes"))
    roots = saved(sizes.join(of.hint("merge"), F.col("root") == F.col("_root")).drop("_root"))
    whole = roots.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("bytes").alias("all_bytes"))
    few = F.least(F.ceil(F.col("all") / PART_LEAST), F.greatest(F.lit(PART_COPIES), F.ceil(F.col("all") / (F.col("all") - F.col("most")))))
    parts = F.greatest(F.ceil(F.col("all_bytes") / PART_BYTES), F.ceil(F.col("all") / PART_MOST), few).cast("int")
    out = saved(roots.join(whole.select(F.col("cluster").alias("_cluster"), "largest", parts.alias("parts")), F.col("cluster") == F.col("_cluster")))
    probe = F.col("root") != F.col("largest")
    out = out.select("root", "cluster", probe.alias("probe"), "parts", "bytes", F.when(probe, F.col("bytes") * F.col("parts")).otherwise(0).alias("copied"))
    dropped(met, roots)
    return out


def _rest(wide: set[int], classes: DataFrame, roots: DataFrame, texts_of, length: int, segments: int, shingle: int, similarity: float) -> DataFrame:
    """roots, after the pairs of wide variants' members that lie in different components are decided too.

    A variant whose members are one component needs nothing. The components that meet in others form clusters. A cluster's texts are dealt to parts,
    each held by one task; the texts outside its largest component (the probes) go to all its parts. A task decides all pairs of its texts and the
    probes that share a variant and lie in two components, and gives back edges that connect these. So neither pairs of texts nor rows by text and
    variant are made, none between components stays undecided, and what is copied at once is bounded: the probes go in several rounds if need be.
    """
    if not wide:
        return roots
    least, spark = Fraction(similarity).limit_denominator(1000), classes.sparkSession
    named = saved(classes.where("segments is not null").select("cls", "segments", "size").join(_home(roots, "_cls", "root"), F.col("cls") == F.col("_cls"), "left").select("cls", "segments", "size", F.coalesce("root", "cls").alias("root")))
    stars = _stars(named, length, segments, wide)
    if stars.isEmpty():
        return roots
    clusters = _clusters(named, stars)
    dropped(stars)
    held, copied = clusters.agg(F.sum("bytes"), F.sum("copied")).first()
    inside = clusters.select(F.col("root").alias("_root"), "cluster", "probe", "parts")
    near = saved(named.select("cls", "root").join(inside, F.col("root") == F.col("_root")).drop("_root"))
    texts = texts_of(near.select("cls"))
    nodes = near.join(classes.select("cls", "a", "b", "segments").hint("merge"), "cls").join(texts.hint("merge"), "cls")
    sets = saved(_with_sets(nodes, shingle))
    dropped(named, near, texts)
    kept = [c for c in sets.columns if c != "parts"]
    members = sets.select(*kept, F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("second"))
    rounds = max(1, math.ceil(copied / max(held, COPIED_BYTES)))
    width = max(shuffle_width(spark), math.ceil(held / PART_BYTES))
    links = []
    for k in range(rounds):
        probes = sets.where(F.col("probe") & (F.pmod(F.xxhash64("cls", F.lit(rounds)), F.lit(rounds)) == k))
        probes = probes.select(*kept, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("second"))
        links.append(saved(_linked_parts(members.union(probes), width, _most_apart(similarity), least)))
        tidy(spark)
    dropped(sets)
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return roots if found.isEmpty() else _merged(roots, found)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u, v of pairs whose texts (cls, text) have shingle sets of the similarity or more."""
    small_batches(pairs.sparkSession, 500)
    least = Fraction(similarity).limit_denominator(1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(shingle_sets(b["tu"], shingle), shingle_sets(b["tv"], shingle), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared * (least.numerator + least.denominator) >= least.numerator * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b["u"], b["v"]], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))
        release()

    both = pairs.select("u", "v").join(texts.select(F.col("cls").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("cls").alias("v"), F.col("text").alias("tv")), "v")
    return saved(both.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"))


def _same(a: str, b: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("mark") == F.col(b))


def _kept_rows(docs: DataFrame, shingle: int, similarity: float, recall: float) -> DataFrame:
    """_id, _mark (doc_id and md5 of the text) and _n (rows that have them) of the rows that near_copies keeps."""
    length, segments = segment_shape(docs.count(), similarity, recall)
    rows = saved(_sketches(docs, shingle, length, segments))
    clash = rows.groupBy("cls").agg(F.min("more").alias("_low"), F.max("more").alias("_high")).where("_low <> _high").select("cls", F.lit(True).alias("_clash"))
    if not clash.isEmpty():  # unequal words whose first 64 bits are equal: another number from all 128
        rows = saved(rows.join(clash, "cls", "left").withColumn("cls", F.when(F.col("_clash"), F.xxhash64("cls", "more")).otherwise(F.col("cls"))).drop("_clash"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = saved(rows.groupBy("cls").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in ("segments", "a", "b", "size")]))
    pairs, wide = _candidates(classes, length, segments, similarity)

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("cls", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")).join(nodes, "cls", "left_semi")
        return saved(_marked(docs).select("doc_id", "mark", "text").join(wanted.hint("merge"), _same("_id", "_mark")).groupBy("cls").agg(F.first("text").alias("text")))

    texts = texts_of(pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct())
    nearest = SqlWindow.partitionBy("v").orderBy("apart", "u")
    ranked = saved(pairs.withColumn("k", F.row_number().over(nearest)))
    links = _verified(ranked.where("k <= 2"), texts, shingle, similarity)
    roots = saved(components(links))
    tidy(docs.sparkSession)
    apart = ranked.where("k > 2").join(_home(roots, "u", "root_u"), "u", "left").join(_home(roots, "v", "root_v"), "v", "left").where("coalesce(root_u, u) <> coalesce(root_v, v)")
    more = _verified(apart, texts, shingle, similarity)
    if not more.isEmpty():
        roots = _merged(roots, more)
    roots = _rest(wide, classes, roots, texts_of, length, segments, shingle, similarity)
    named = classes.select("cls", "first").join(roots, F.col("cls") == F.col("u"), "left")
    best = named.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    counts = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("_n"))
    best = saved(best.join(counts.hint("merge"), _same("_id", "_mark")).select("_id", "_mark", "_n"))
    dropped(pairs, ranked, texts, links, more)
    return best


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The rows of docs (doc_id, text and others) less all but one of each component of near copies: that of the least doc_id (null
    last), then of the least md5 of the text.

    Texts link if their sets of word shingles have a Jaccard similarity of at least `similarity`; texts of equal words (128 bits)
    are one class, those without words too. A pair at the threshold becomes a candidate with probability recall, one above it with more;
    candidates are decided by their whole shingle sets. Each text's two nearest candidates come first, then all candidates that these left
    in different components, then (`_rest`) all pairs of a variant that the window skipped and that are in different components still.
    Null texts are as empty. Rows that share a doc_id are decided by their texts; of rows that share both the one whose hash is least stays.
    Columns may have any names. Empty table: no rows. Joins on two keys are merge joins, so that none
    of their sides is broadcast.
    """
    fields = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select("doc_id", "text", F.struct(*fields).alias("row"))
    best = _kept_rows(rows, shingle, similarity, recall)
    one = _marked(rows).join(best.where("_n = 1").hint("merge"), _same("_id", "_mark"), "left_semi")
    several = _marked(rows).join(best.where("_n > 1").hint("merge"), _same("_id", "_mark"), "left_semi")
    several = several.groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row").union(several.select("row")).select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
