"""Alignment of two tokenizers' tokens over the same bytes, by elementary intervals.

The end places of both tokenizers' tokens, united, cut a text into elementary intervals. Each interval lies in one token of either side
and each overlapping pair of tokens shares just one interval, so the intervals are the links. Places where both sides end close the
groups: the least stretches that both tokenise apart from the rest. A group's tokens of one side times those of the other are its pairs.

Texts are encoded once. A task writes its documents in blocks: a block holds its distinct id pairs, how many of its documents have
each, and for each document which of these it has, how often. Only the distinct pairs of blocks are then shuffled, to be counted over the
corpus, and come back to their block; links never are.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, column_bytes, release, small_batches

#: A block ends with the document that brings it to so many bytes of text.
BLOCK = 4 << 20
#: A text may be cut before a space that follows none or is followed by none: neither side has a token across it. The text's last
#: character is no part of its own, as the pieces' model adds no space to an empty part.
_CUT = re.compile(r"(?<=[^ ])(?= .)", re.DOTALL)
_SPACE_AND_SPACE = re.compile(r" \s")
#: So many parts, of up to LONG characters, are remembered by a worker; then it starts anew.
REMEMBERED, LONG = 1 << 17, 64
_NONE = np.zeros(0, np.int64)


class Side:
    """Ids of texts, and the bytes of each id."""

    bytes_of: list[bytes]

    def __init__(self):
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        number = [str(k) for k in range(len(self.bytes_of))]
        #: A token's number after a token of its own side, the other side, another group.
        self.written = {mark: np.array([mark + x for x in number], object) for mark in ",|;"}

    def encode(self, parts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class BytePairs(Side):
    """A byte-level file of the `tokenizers` library, given the text with a space before it."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # the letters of byte-level files: these stand for themselves
        letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        byte = {c: b for b, c in letter.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_of[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class SentencePieces(Side):
    """A SentencePiece model, which adds the space before the text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        byte = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.bytes_of = [byte.get(p, p.replace("▁", " ").encode()) for p in pieces]
        #: A piece with a space after something else would cross the places where texts are cut.
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        super().__init__()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in parts], num_threads=1)


def parts_of(text: str) -> list[str]:
    """text, which begins with a space, cut at places that neither side has a token across."""
    if "\0" in text or _SPACE_AND_SPACE.search(text):
        return _CUT.split(text)
    parts = text.replace(" ", "\0 ").split("\0")[1:]
    if parts[-1] == " " and len(parts) > 1:
        parts[-2:] = [parts[-2] + " "]
    return parts


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the elementary intervals, in order: the token of either side that each lies in, and whether a group ends with it."""
    ends = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return of_a, of_b, (ends_a[of_a] == ends) & (ends_b[of_b] == ends)


class Part(NamedTuple):
    """What is known of a part of a text: the ids of either side (bytes of 32-bit numbers), its groups as text (each after a semicolon), how
    many these are, and its links (bytes of 64-bit numbers, the first side's id in the upper half)."""

    a: bytes
    b: bytes
    text: str
    groups: int
    links: bytes


class Aligner(dict):
    """As a mapping, what is known of a part of a text, None where a side doesn't give the part's bytes back. Places where texts are cut end tokens
    of both sides, so parts are aligned apart, all that are new at once."""

    def __init__(self, a: Side, b: Side):
        super().__init__()
        self.a, self.b = a, b

    def parts(self, texts: list[bytes]) -> list[list[Part]]:
        """The parts of each text; none where a side's bytes aren't the space and the text."""
        cut = []
        for t in texts:
            try:
                text = t.decode()
            except UnicodeDecodeError:
                text = ""
            cut.append(([" " + text] if self.b.whole else parts_of(" " + text)) if text else [])
        found = self._learn({p for parts in cut for p in parts})
        out = []
        for parts in cut:
            known = [found[p] if p in found else self[p] for p in parts]
            out.append([] if None in known else known)
        return out

    def _learn(self, parts: set[str]) -> dict[str, Part | None]:
        """The parts that weren't known; short ones are remembered."""
        new = sorted(p for p in parts if p not in self)
        ids_a, ids_b = self.a.encode(new), self.b.encode(new)
        token_a, token_b = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
        same = [b"".join(map(token_a, x)) == b"".join(map(token_b, y)) == p.encode() for p, x, y in zip(new, ids_a, ids_b, strict=True)]
        found = dict.fromkeys(new)
        good = [k for k, ok in enumerate(same) if ok]
        found.update(zip([new[k] for k in good], self._aligned([ids_a[k] for k in good], [ids_b[k] for k in good]), strict=True))
        if len(self) > REMEMBERED:
            found |= {p: self[p] for p in parts if p in self}
            self.clear()
        self.update((p, x) for p, x in found.items() if len(p) <= LONG)
        return found

    def _aligned(self, lists_a: list[list[int]], lists_b: list[list[int]]) -> list[Part]:
        """Parts laid end to end, so that their places are one axis."""
        lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (lists_a, lists_b)]
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int32, int(n.sum())) for x, n in zip((lists_a, lists_b), lengths, strict=True))
        ends_a, ends_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        of_a, of_b, closes = aligned(ends_a, ends_b)
        group = np.cumsum(closes) - closes
        last = lambda of: np.flatnonzero(np.append(of[1:] != of[:-1], True)) if len(of) else _NONE
        text = self._written(ids_a, ids_b, group[last(of_a)], group[last(of_b)])
        links = ids_a[of_a].astype(np.int64) << 32 | ids_b[of_b]
        at = [[0, *np.cumsum(n).tolist()] for n in (*lengths, lengths[0] + lengths[1])]
        stops = np.searchsorted(of_a, np.array(at[0]))  # the first interval of each part
        groups, stops = np.concatenate([[0], np.cumsum(closes)])[stops].tolist(), stops.tolist()
        return [
            Part(ids_a[at[0][k] : at[0][k + 1]].tobytes(), ids_b[at[1][k] : at[1][k + 1]].tobytes(), "".join(text[at[2][k] : at[2][k + 1]]), groups[k + 1] - groups[k], links[stops[k] : stops[k + 1]].tobytes())
            for k in range(len(lists_a))
        ]

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """The tokens group by group, each with its mark: ;a1 ,a2 |b1 ;a3 |b2 ,b3."""
        out = np.empty(len(ids_a) + len(ids_b), object)
        for s, ids, group, mark, before in ((self.a, ids_a, group_a, ";", np.searchsorted(group_b, group_a)), (self.b, ids_b, group_b, "|", np.searchsorted(group_a, group_b, "right"))):
            text, first = s.written[","][ids], np.append(True, group[1:] != group[:-1])[: len(ids)]
            text[first] = s.written[mark][ids[first]]
            out[np.arange(len(ids)) + before] = text
        return out.tolist()


_aligners: dict[tuple, Aligner] = {}


def aligner(a: tuple[type, bytes], b: tuple[type, bytes]) -> Aligner:
    """A worker keeps an aligner, and what it remembers, from task to task."""
    if (a, b) not in _aligners:
        _aligners.clear()
        _aligners[a, b] = Aligner(*[kind(file) for kind, file in (a, b)])
    return _aligners[a, b]


def _block(known: Aligner, texts: list[bytes]) -> dict:
    """What a block keeps of its documents: numbers and digests of each, and their links as places in the block's distinct pairs."""
    n_a, n_b, n_groups, digests, keys, places = [], [], [], [], [], []
    for k, parts in enumerate(known.parts(texts)):
        a, b, text, groups, links = zip(*parts, strict=True) if parts else ((), (), (), (), ())
        n_a.append(len(b"".join(a)) // 4)
        n_b.append(len(b"".join(b)) // 4)
        n_groups.append(sum(groups))
        digests.append(hashlib.sha256("".join(text)[1:].encode()).hexdigest() if parts else "")
        pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
        keys.append(pairs)
        places.append((np.full(len(pairs), k), times))
    flat = np.concatenate(keys) if keys else _NONE
    pairs, at = np.unique(flat, return_inverse=True)
    doc, times = (np.concatenate([p[k] for p in places]) for k in (0, 1)) if places else (_NONE, _NONE)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "digests": digests, "pairs": pairs, "docs": np.bincount(at, minlength=len(pairs)), "doc": doc, "at": at, "times": times}


def _packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    return x.astype(kind).tobytes()


def _blocks(docs: DataFrame, a: tuple[type, bytes], b: tuple[type, bytes]) -> DataFrame:
    """The documents of docs in blocks, a row each."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((a, b))
    schema = f"block long, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, n_a binary, n_b binary, n_groups binary, digests array<string>, pairs array<long>, docs array<int>, doc binary, at binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = aligner(*files.value), 0
        names = [f.split(" ", 1)[0] for f in schema.split(", ")]

        def row(doc_ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
            nonlocal count
            x = _block(known, texts)
            ids = pa.concat_arrays(doc_ids)
            own = TaskContext.get().partitionId() << 32 | count
            count += 1
            columns = [
                pa.array([own], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), *[pa.array([_packed(np.array(x[c]))], pa.binary()) for c in ("n_a", "n_b", "n_groups")],
                pa.array([x["digests"]], pa.list_(pa.string())), pa.ListArray.from_arrays([0, len(x["pairs"])], pa.array(x["pairs"], pa.int64())), pa.ListArray.from_arrays([0, len(x["pairs"])], pa.array(x["docs"], pa.int32())),
                *[pa.array([_packed(x[c])], pa.binary()) for c in ("doc", "at", "times")],
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        doc_ids, texts, size = [], [], 0
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            for k in range(batch.num_rows):
                doc_ids.append(batch["doc_id"].slice(k, 1))
                texts.append(data[offsets[k] : offsets[k + 1]].tobytes())
                size += len(texts[-1]) + 64
                if size >= BLOCK:
                    yield row(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
        if texts:
            yield row(doc_ids, texts)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, read again."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/alignment-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b int, count long (documents that hold the pair linked), best boolean (no pair of the same a has a higher count)."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32).cast("int"))
    highest = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(highest, "a").select("pair", "a", F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a: tuple[type, bytes], b: tuple[type, bytes]) -> tuple[DataFrame, DataFrame]:
    """Two tables: pair_counts of all documents, and per row of docs doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256.

    a and b are a kind of Side and its file's bytes. Null, empty and non-UTF-8 texts, and those whose bytes a side doesn't give back (a
    U+2581 in the text, say), have no tokens: zeros and an empty digest. A row is a document: repeated rows count as often, null doc_ids too;
    other columns of docs are left out. An empty table gives no rows. A text without any space after a non-space is encoded at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = written(_blocks(docs, a, b))
    counts = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    met = asked.join(counts.select("pair", "count", "best"), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("met"))
    answered = blocks.drop("pairs", "docs").join(met, "block", "left")  # a block without links has no pairs
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {c: batch[c].slice(k, 1) for c in batch.schema.names}
                numbers = {c: np.frombuffer(x[c][0].as_buffer(), "<u4").astype(np.int64) for c in ("n_a", "n_b", "n_groups", "doc", "at", "times")}
                met = x["met"].flatten()
                place, count, best = (met.field(f).to_numpy(zero_copy_only=False) for f in ("place", "count", "best"))
                n, size = len(numbers["n_a"]), int(place.max()) + 1 if len(place) else 0
                of_pair, is_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                of_pair[place], is_best[place] = count, best
                sums = []
                for weight in (np.ones(size, np.int64), is_best, of_pair):
                    total = np.zeros(n, np.int64)
                    np.add.at(total, numbers["doc"], numbers["times"] * weight[numbers["at"]])
                    sums.append(total)
                columns = [x["doc_ids"].flatten(), *[pa.array(v, pa.int64()) for v in (numbers["n_a"], numbers["n_b"], numbers["n_groups"], *sums)], x["digests"].flatten()]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
        release()

    return counts.drop("pair"), answered.mapInArrow(run, schema)


def token_groups(docs: DataFrame, a: tuple[type, bytes], b: tuple[type, bytes]) -> DataFrame:
    """doc_id, group int (from 0), a_ids and b_ids array<int>: the groups of each text, in order; texts without tokens have none (as in align_documents)."""
    spark = docs.sparkSession
    small_batches(spark)
    files = spark.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(*files.value)
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            for k in range(batch.num_rows):
                parts = known.parts([data[offsets[k] : offsets[k + 1]].tobytes()])[0]
                groups = [[[int(x) for x in tokens.split(",")] for tokens in g.split("|")] for g in "".join([p.text for p in parts])[1:].split(";")] if parts else []
                ids = pa.concat_arrays([batch["doc_id"].slice(k, 1)] * len(groups)) if groups else batch["doc_id"].slice(0, 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(groups)), pa.int32()), *[pa.array([g[c] for g in groups], pa.list_(pa.int32())) for c in (0, 1)]], ["doc_id", "group", "a_ids", "b_ids"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, group int, a_ids array<int>, b_ids array<int>")


def group_pairs(groups: DataFrame) -> DataFrame:
    """doc_id, group, a, b: each group's product, every token occurrence of one side with every one of the other. groups as token_groups gives them."""
    return groups.select("doc_id", "group", F.explode("a_ids").alias("a"), "b_ids").select("doc_id", "group", "a", F.explode("b_ids").alias("b"))
