"""URL rules by a bit-parallel wildcard automaton (Shift-And over several machine words).

Every rule is a glob over the canonical url (host with A-Z lower-cased, then the path). All globs are laid side by side in one row of
bits; one step per character advances all of them for a whole batch of urls: shift by one with carries between the words, mask by the
character's word row, keep the bits of wildcards that may swallow the character. Accepting bits give the rules that match.

Globs: `?` is one character, `*` any run without a slash, `**` any run; all else is literal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, small_batches

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains and every path that starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


class WildcardAutomaton:
    """All globs at once. Bit k of a glob of n symbols is set when its first k symbols match what was read; bit 0 starts it."""

    def __init__(self, globs: Sequence[str]):
        symbols = [self._parse(g) for g in globs]
        bits = sum(len(s) + 1 for s in symbols)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)  # bits that a character may set
        self.stay = np.zeros((256, self.words), np.uint64)  # bits that a character may keep
        self.begin = np.zeros(self.words, np.uint64)
        self.final = np.zeros(len(globs), np.int64)
        at = 0
        for k, glob in enumerate(symbols):
            self._set(self.begin, at)
            for literal, loops in glob:
                if loops:  # a wildcard run: the bit before it keeps itself
                    for c in range(256):
                        if loops == 2 or c != 0x2F:
                            self._set(self.stay[c], at)
                    continue
                at += 1
                for c in range(256) if literal is None else (literal,):
                    self._set(self.step[c], at)
            self.final[k] = at
            at += 1

    @staticmethod
    def _parse(glob: str) -> list[tuple[int | None, int]]:
        out: list[tuple[int | None, int]] = []
        data, k = glob.encode(), 0
        while k < len(data):
            if data[k : k + 2] == b"**":
                out.append((None, 2))
                k += 2
                continue
            out.append((None, 1) if data[k] == 0x2A else (None, 0) if data[k] == 0x3F else (data[k], 0))
            k += 1
        return out

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= _U(1 << (bit % 64))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """bool [rows, globs]: which globs match the whole of each row."""
        n = len(offsets) - 1
        length = np.diff(offsets)
        state = np.broadcast_to(self.begin, (n, self.words)).copy()
        order = np.argsort(-length, kind="stable")
        live, longest = n, int(length.max(initial=0))
        lengths = length[order]
        for k in range(longest):
            while live and lengths[live - 1] <= k:
                live -= 1
            rows = order[:live]
            c = data[offsets[rows] + k]
            now = state[rows]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            state[rows] = (moved & self.step[c]) | (now & self.stay[c])
        return (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & _U(1) > 0


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (text of the longest rule that fits, else null), verdict (the rule's, else default).

    Host: from after the first `://` to the next `/`, `?`, `#` or the end; path: on to the next `?`, `#` or the end. A null url or
    one without `://` has both empty and fits no rule. Equal lengths: the first rule listed. One narrow pass, no shuffle.
    """
    small_batches(pages.sparkSession, 5000)
    after = F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")
    has = F.col(url).isNotNull() & (F.instr(F.col(url), "://") > 0)
    split = pages.select(F.col(key).alias("key"), F.when(has, after).otherwise("").alias("rest"))
    split = split.select("key", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k].text), k))
    ordered = [rules[k] for k in ranked]
    automaton = WildcardAutomaton([g for r in ordered for g in r.globs()])
    texts, verdicts = pa.array([*(r.text for r in ordered), None], pa.string()), pa.array([*(r.verdict for r in ordered), default], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, off = column_bytes(pa.compute.binary_join_element_wise(b["host"], b["path"], ""))
            hit = automaton.matches(whole, off).reshape(len(b["host"]), len(ordered), 2).any(axis=2)
            best = pa.array(np.where(hit.any(axis=1), hit.argmax(axis=1), len(ordered)) if len(ordered) else np.zeros(len(b["host"]), np.int64))
            yield pa.RecordBatch.from_arrays([b["key"], b["host"], b["path"], texts.take(best), verdicts.take(best)], names=[key, "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string")
