"""Substring dedup by suffix automata of reference shards.

A suffix automaton of a shard of reference passages knows, for every substring, the least document id that holds it. Documents are
streamed through it for matching statistics: at each word the longest suffix that the shard holds. Where that reaches the threshold the
window ending there is known with its least document, and every maximal span of such windows goes.

When the reference is the corpus itself, a broadcast of every shard to every document would be quadratic. `passages` therefore deals
the repeated parts of the documents to shards by content; a shard's automaton is built once, in the task that streams what was dealt to it.
`remove_reference` keeps the broadcast for a reference of its own, in shards of a checked size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column_bytes, small_batches
from .passages import Segments, Window, repeated_units

#: Words of one automaton.
SHARD_WORDS = 20_000


class SuffixAutomaton:
    """Generalised over several word sequences; `low` is the least document id of the sequences that hold a state's substrings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [2**63 - 1]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.low.append(2**63 - 1)
        return len(self.link) - 1

    def _split(self, p: int, c: object, q: int) -> int:
        """The state of the substrings of q that end in p's and c."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, document: int) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            if document < self.low[last]:
                self.low[last] = document

    def finish(self) -> SuffixAutomaton:
        """Hands the least ids to the shorter substrings."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.low[s] < self.low[up]:
                self.low[up] = self.low[s]
        return self

    def stream(self, words: list, size: int) -> list[int]:
        """For each window of size words the least document id that holds it, 2^63 - 1 if none does."""
        state, matched, out = 0, 0, []
        following, link, length, low = self.next, self.link, self.length, self.low
        for k, c in enumerate(words):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if c in following[state]:
                state = following[state][c]
                matched += 1
            while state and length[link[state]] >= size:  # only the window itself counts
                state = link[state]
                matched = length[state]
            if k >= size - 1:
                out.append(low[state] if matched >= size else 2**63 - 1)
        return out


def _kernel(size: int):
    def judge(anchors: list[int], texts: list[bytes], places: list[int], windows: list[int], times: list[int], least: list[int]) -> list[np.ndarray]:
        """The least document id of every window. Equal windows have equal anchors, so shards may end between anchors."""
        out: list[np.ndarray] = []
        shard: list[tuple[list[bytes], int]] = []
        held = 0

        def close() -> None:
            automaton = SuffixAutomaton()
            for words, low in shard:
                automaton.add(words, low)
            automaton.finish()
            out.extend(np.array(automaton.stream(words, size), np.int64) for words, _ in shard)
            shard.clear()

        for k, text in enumerate(texts):
            if held >= SHARD_WORDS and anchors[k] != anchors[k - 1]:
                close()
                held = 0
            shard.append((text.split(b" "), least[k]))
            held += len(shard[-1][0])
        close()
        return out

    return judge


def _finish(joined: bool, keep: tuple[str, ...]):
    def finish(seg: Segments, covered: np.ndarray) -> pa.RecordBatch:
        raw, bounds = seg.data.tobytes(), seg.bounds
        upto = np.concatenate([[0], np.cumsum(covered)])
        removed = upto[bounds[1:]] - upto[bounds[:-1]]
        kept = []
        for k, gone in enumerate(removed.tolist()):
            text = raw[seg.offsets[k] : seg.offsets[k + 1]]
            if joined or gone:
                words = slice(bounds[k], bounds[k + 1])
                if joined:
                    parts = text.split() if not gone else [raw[a:b] for a, b in zip(seg.starts[words][~covered[words]].tolist(), seg.ends[words][~covered[words]].tolist(), strict=True)]
                    text = b" ".join(parts)
                else:  # cut each removed run out, up to the next kept word
                    c, edge = covered[words], np.append(seg.starts[words], seg.offsets[k + 1])
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
                    cuts = edge[turn].tolist()
                    at, pieces = int(seg.offsets[k]), []
                    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                        pieces.append(raw[at:a])
                        at = b
                    text = b"".join([*pieces, raw[at : seg.offsets[k + 1]]])
            kept.append(hashlib.sha256(text).hexdigest() if joined else text.decode())
        first = [seg.rows["doc_id"].combine_chunks(), pa.array(np.diff(bounds)), pa.array(removed), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays([*first, *(seg.rows[c].combine_chunks() for c in keep)], names=["doc_id", "n_words", "n_removed", "kept", *keep])

    return finish


def _schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(["doc_id long, n_words long, n_removed long, kept string", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])


def remove_repeats(docs: DataFrame, size: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text without the removed words and the space after them) and keep of every document.

    A word goes if a window of size words that covers it also starts in a document with a smaller id. Windows are judged on the input.
    Null texts are empty; null doc_ids rank last; rows that share a doc_id have the same id. A column of keep that is called like one of
    this result's comes back with _in added to its name.
    """
    docs, keep = carried(docs, keep, ("n_words", "n_removed", "kept"))
    return repeated_units(docs, Window("words", size, 4, True), _kernel(size), _finish(False, keep), _schema(docs, keep), keep)


def repeat_digests(docs: DataFrame, size: int = 13) -> DataFrame:
    """As remove_repeats, with the SHA-256 of the kept words joined by one space as kept_sha256 instead of the text."""
    return repeated_units(docs, Window("words", size, 4, True), _kernel(size), _finish(True, ()), _schema(docs, ())).withColumnRenamed("kept", "kept_sha256")


def remove_reference(docs: DataFrame, reference: DataFrame, size: int = 13, max_shard_words: int = 100_000, max_reference_words: int = 400_000) -> DataFrame:
    """doc_id, n_words, n_removed: words of docs covered by a window that reference.text holds.

    The reference is read in shards of max_shard_words; each shard's automaton is broadcast and all documents are streamed through all
    of them. Its size is counted first (an automaton takes about 600 bytes a word, so 240 MB at most): beyond max_reference_words use
    remove_repeats on the union, which needs no broadcast. Null texts are empty; repeated rows give repeated results.
    """
    from .mixing import word_count

    spark = docs.sparkSession
    small_batches(spark)
    total = reference.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    if total > max_reference_words:
        raise ValueError(f"the reference has {total} words; at most {max_reference_words} are broadcast")
    shards, automaton, held = [], SuffixAutomaton(), 0
    for row in reference.select("text").where("text is not null").toLocalIterator():
        words = row["text"].encode().split()
        automaton.add(words, 0)
        held += len(words)
        if held >= max_shard_words:
            shards.append(spark.sparkContext.broadcast(automaton.finish()))
            automaton, held = SuffixAutomaton(), 0
    shards.append(spark.sparkContext.broadcast(automaton.finish()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b["text"])
            raw, n, gone = data.tobytes(), [], []
            for k in range(len(off) - 1):
                words = raw[off[k] : off[k + 1]].split()
                change = np.zeros(len(words) + 1, np.int64)
                for shard in shards:
                    hit = np.flatnonzero(np.array(shard.value.stream(words, size), np.int64) == 0)
                    np.add.at(change, hit, 1)
                    np.add.at(change, hit + size, -1)
                n.append(len(words))
                gone.append(int((np.cumsum(change[:-1]) > 0).sum()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "n_words", "n_removed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long")
