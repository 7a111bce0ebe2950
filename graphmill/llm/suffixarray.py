"""Suffix-array dedup of bytes, with the linear grouping construction (Baier, 2016).

`grouping_suffix_array` sorts suffixes without recursion. Phase 1 works on groups of suffixes that share a Lyndon prefix, from the highest
group down: for each member the previous smaller suffix is found over pointers, those previous suffixes are counted, and they move, by
falling count, to new groups just above their own. Phase 2 emits the order: each sorted suffix puts its predecessors, along the
previous-smaller pointers, at the front of their groups.

For dedup a task gets segments of text that share an anchor (see `passages`), lined up at it. Equal windows lie at equal distances from
their anchor, so the suffixes that begin at every 64th byte from the anchor (a power of two, a third of a window at most) are sorted, on an alphabet of whole blocks. That order
induces all others, one byte at a time: suffixes a byte farther from their block are ordered by (that byte, the order of what follows).
Equal windows are then neighbours, as in a suffix array; neighbours are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import carried, prefix_hash, ranges, span_hash
from .passages import Segments, Window, repeated_units

#: Bytes whose suffixes are sorted together.
SHARD_BYTES = 1 << 20


def grouping_suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of symbols, whose last is smaller than all others and unique."""
    n = len(symbols)
    first: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(symbols):
        first[c].append(i)
    # groups are numbers in a chain from low to high; members stay in text order
    members = [first[c] for c in sorted(first)]
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    smaller, jump, done = [-1] * n, [-1] * n, bytearray(n)
    final: list[list[int]] = []  # from the highest group down

    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]  # the others have moved up
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j, path = i - 1, []
            while j >= 0 and done[j]:
                path.append(j)
                j = jump[j]
            for x in path:
                jump[x] = j
            jump[i] = smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        final.append(own)
        sets: dict[int, dict[int, list[int]]] = {}
        for j, c in times.items():
            sets.setdefault(c, {}).setdefault(group[j], []).append(j)
        for c in sorted(sets, reverse=True):  # each new group goes just above its old one, so a lower count ends lower
            for g, moved in sets[c].items():
                new = len(members)
                members.append(moved)
                below.append(g)
                above.append(above[g])
                below[above[g]] = new
                above[g] = new
                for j in moved:
                    group[j] = new
        now = below[now]

    place, start = [0] * len(members), 0
    for own in reversed(final):
        if own:
            place[group[own[0]]] = start
        start += len(own)
    order, sorted_already = [n - 1] * n, bytearray(n)
    place[group[n - 1]] += 1
    sorted_already[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not sorted_already[j]:
            sorted_already[j] = 1
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            j = smaller[j]
    return order


def repeated_windows(texts: list[bytes], places: list[int], windows: list[int], size: int) -> list[np.ndarray]:
    """For each text which of its windows also start in another of the texts; equal windows lie at equal distances from their places."""
    block = 1 << (size // 3).bit_length() - 1
    lengths = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts) + bytes(block), np.uint8)
    begin = np.cumsum(lengths) - lengths
    # blocks lie on a grid through the anchor
    head = np.array(places) % block
    blocks = np.maximum(0, -(-(lengths - head) // block))
    first = np.cumsum(blocks) - blocks
    at = np.repeat(begin + head, blocks) + block * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    over = np.maximum(0, at + block - np.repeat(begin + lengths, blocks))
    grid = data[at[:, None] + np.arange(block)]
    grid = np.where(np.arange(block)[None, :] >= block - over[:, None], 0, grid).astype(np.uint8)
    _, rank = np.unique(np.ascontiguousarray(grid).view(f"S{block}").ravel(), return_inverse=True)
    # one separator, 1, after each text and 0 at the end
    symbol = np.ones(len(rank) + len(texts) + 1, np.int64)
    symbol[np.arange(len(rank)) + np.repeat(np.arange(len(texts)), blocks)] = rank + 2
    symbol[-1] = 0
    order = np.array(grouping_suffix_array(symbol.tolist()))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))

    # offsets up to the last window, and on to the next block's start
    n = np.array(windows)
    reach = np.minimum(n + block, lengths)
    base = np.cumsum(reach) - reach
    text = np.repeat(np.arange(len(texts)), reach)
    offset = np.arange(reach.sum()) - np.repeat(base, reach)
    ahead = ((head[text] - offset) % block).astype(np.uint8)
    start, window = begin[text] + offset, offset < n[text]
    last = np.zeros(len(text), bool)
    last[base + reach - 1] = True
    by_distance = np.argsort(ahead, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(ahead, minlength=block))])
    rank, order = np.zeros(len(text), np.int64), []
    for distance in range(block):
        at = by_distance[cuts[distance] : cuts[distance + 1]]
        if distance:
            at = at[~last[at]]  # the others are no windows
            key = rank[at + 1] | (data[start[at]].astype(np.int64) << 40)
        else:
            key = position[first[text[at]] + text[at] + (offset[at] - head[text[at]]) // block]
        at = at[np.argsort(key, kind="stable")]
        rank[at] = np.arange(len(at))
        order.append(at[window[at]])
    by = np.concatenate(order)
    prefix = prefix_hash(data)
    value = span_hash(prefix, start[by], start[by] + size)  # equal windows have equal hashes, so only such neighbours are compared
    near = np.flatnonzero(value[1:] == value[:-1])
    return [x[:k] for x, k in zip(np.split(_equal_neighbours(data, start, by[near], by[near + 1], size), base[1:]), n.tolist(), strict=True)]


def _equal_neighbours(data: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Of all places (windows at data[start]) those that belong to a pair a[k], b[k] of equal windows.

    Pairs of consecutive places at one distance are compared together, each byte once.
    """
    hit = np.zeros(len(start), bool)
    x, y = start[a], start[b]
    sort = np.argsort((y - x << 32) + x, kind="stable")
    a, b, x, apart = a[sort], b[sort], x[sort], (y - x)[sort]
    heads = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1] + 1) | (apart[1:] != apart[:-1])])) if len(x) else np.zeros(0, np.int64)
    long = np.diff(np.append(heads, len(x)))
    for k in range(0, len(heads), 20_000):
        own, n = heads[k : k + 20_000], long[k : k + 20_000]
        at = ranges(x[own], n + size - 1)
        unlike = np.concatenate([[0], np.cumsum(data[at] != data[at + np.repeat(apart[own], n + size - 1)])])
        begin = np.repeat(np.cumsum(n + size - 1) - (n + size - 1), n) + ranges(np.zeros(len(n), np.int64), n)
        same = unlike[begin + size] == unlike[begin]
        pairs = slice(own[0], own[0] + n.sum())
        hit[a[pairs][same]] = True
        hit[b[pairs][same]] = True
    return hit


def _kernel(size: int):
    def judge(anchors: list[int], texts: list[bytes], places: list[int], windows: list[int], times: list[int], least: list[int]) -> list[np.ndarray]:
        """Which windows start elsewhere. Equal windows have equal anchors, so shards may end between anchors."""
        out: list[np.ndarray] = []
        start, held = 0, 0
        for k in range(len(texts) + 1):
            if k == len(texts) or (held >= SHARD_BYTES and anchors[k] != anchors[k - 1]):
                if k > start:
                    out.extend(repeated_windows(texts[start:k], places[start:k], windows[start:k], size))
                start, held = k, 0
            if k < len(texts):
                held += len(texts[k])
        return [hit | (t > 1) for hit, t in zip(out, times, strict=True)]

    return judge


def _finish(digest: bool, keep: tuple[str, ...]):
    def finish(seg: Segments, covered: np.ndarray) -> pa.RecordBatch:
        raw, off = seg.data, seg.offsets
        upto = np.concatenate([[0], np.cumsum(covered)])
        edge = covered & ~np.concatenate([[False], covered[:-1]])
        edge[off[:-1][np.diff(off) > 0]] = covered[off[:-1][np.diff(off) > 0]]  # runs end with their document
        runs = np.concatenate([[0], np.cumsum(edge)])
        kept = [raw[a:b][~covered[a:b]].tobytes() for a, b in zip(off, off[1:], strict=False)]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
        count = lambda x: pa.array((x[off[1:]] - x[off[:-1]]).astype(np.int64))
        return pa.RecordBatch.from_arrays([seg.rows["doc_id"].combine_chunks(), pa.array(np.diff(off)), count(upto), count(runs), last, *(seg.rows[c].combine_chunks() for c in keep)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *keep])

    return finish


def remove_repeated_bytes(docs: DataFrame, size: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary and keep of every document.

    A byte goes if a string of size bytes that covers it also starts anywhere else, in the same document or another; all copies go.
    Strings never cross documents and are judged on the input. What is kept may end inside a character, hence binary. Null texts are
    empty; null and repeated doc_ids are documents of their own; an empty table gives no rows. A column of keep that is called like one
    of this result's comes back with _in added to its name.
    """
    docs, keep = carried(docs, keep, ("n_bytes", "n_removed", "n_spans", "kept"))
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return repeated_units(docs, Window("bytes", size, 32, False), _kernel(size), _finish(False, keep), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{more}", keep)


def repeated_byte_digests(docs: DataFrame, size: int = 200) -> DataFrame:
    """As remove_repeated_bytes, with the SHA-256 of the bytes kept as kept_sha256 instead of them."""
    return repeated_units(docs, Window("bytes", size, 32, False), _kernel(size), _finish(True, ()), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string").withColumnRenamed("kept", "kept_sha256")
