"""Quality rules: text statistics and a learned decision list, all in Spark SQL expressions.

The list is learned by sequential covering. From a bounded sample of labelled rows (split in a growing and a pruning part by a hash of
the id) a conjunction of threshold tests is grown greedily for FOIL gain on histograms that Spark aggregates, its last tests are
pruned while the pruning part gives the shorter rule a better (p - n) / (p + n), rows that it covers leave, and the next one is grown.
The ordered rules become one conditional expression; the default keeps the document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, carried, saved

#: The five statistics of the rules' contract.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the list may test: shares, so that long and short texts compare.
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "word_length", "upper_share", "mark_share", "bar_share", "n_words")
WINDOW = 8


def _count(text: Column, characters: str) -> Column:
    """How many of these ASCII characters the text has: one pass, no regular expression."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: the optimizer can't copy a lambda's variable into each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice; hashes[i] is the window of words i .. i + WINDOW - 1."""
    same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    marked = lambda s: F.filter(F.transform(s, lambda x, j: F.when(same(s, j - 1, x) | same(s, j + 1, x), x["i"])), lambda i: i.isNotNull())
    covered = lambda at: F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y)
    count = lambda h: _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: _let(F.sort_array(marked(s)), covered))
    return _let(hashes, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), count(h)).otherwise(0)).cast("long")


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, BASE and the raw counts behind FEATURES of every whole text (null: as empty).

    Repeated windows are found by sorting the window hashes (64 bits) inside the row; 8-word windows of one text whose hashes
    collide would count as equal, which a text of 20,000 words meets with probability 1e-11. All work is linear (one sort) in the text.
    """
    text = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    hashes = lambda w: F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    stats = _let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            _repeated(hashes(x["w"])).alias("n_repeat_words"),
        ),
    )
    counts = F.struct(_count(text, "#*$%&|<>").alias("n_symbols"), _count(text, ascii_uppercase).alias("n_upper"), _count(text, "!?").alias("n_marks"), _count(text, "|").alias("n_bars"))
    # a generator of one row: predicates on the statistics stay above it, so they are computed once
    return docs.select(key, *keep, F.inline(F.array(F.struct(stats.alias("s"), counts.alias("c"))))).select(key, *keep, "s.*", "c.*")


def features() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"), "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "n_words"),
        "bar_share": share("n_bars", "n_words"), "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _bin(x: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x))


Rules = list[tuple[Test, ...]]


def _all(tests: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def learn_decision_list(rows: DataFrame, max_rules: int = 8, max_tests: int = 3, bins: int = 24, least_precision: float = 0.9, least_cover: int = 5) -> Rules:
    """Ordered conjunctions that reject, learned from rows with FEATURES, _bad int (1: reject) and _grow boolean.

    Candidate thresholds are the quantiles of each feature over the growing rows that are bad, and over those that are not. A rule
    joins the list only if the pruning rows that it covers are bad to least_precision; no labelled rows: no rules.
    """
    names = [c for c in FEATURES]
    rows = saved(rows.select("_bad", "_grow", *[F.col(c).cast("double") for c in names]))
    quantiles = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    cuts = rows.where("_grow").groupBy("_bad").agg(*[F.percentile_approx(c, quantiles, 1000).alias(c) for c in names]).collect()
    edges = {c: sorted({float(x) for r in cuts for x in (r[c] or []) if x is not None}) for c in names}
    if len(cuts) < 2:
        return []
    # a value's bin: how many edges lie below it; then v > edges[k] is bin > k
    table = saved(rows.select("_bad", "_grow", *[_bin(F.col(c), edges[c]).alias(c) for c in names]))
    as_bin = lambda t: Test(t.feature, t.above, edges[t.feature].index(t.threshold))
    rules: Rules = []
    left = F.lit(True)
    for _ in range(max_rules):
        tests: tuple[Test, ...] = ()
        while len(tests) < max_tests:
            now = table.where("_grow").where(left & _all(tuple(map(as_bin, tests))))
            stacked = now.select("_bad", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in names])).alias("x"))
            counts: dict[str, dict[int, tuple[int, int]]] = {c: {} for c in names}
            for r in stacked.groupBy("x.f", "x.b").agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect():  # features x bins rows
                counts[r["f"]][r["b"]] = (r["p"], r["n"])
            p0, n0 = (sum(v[k] for v in counts[names[0]].values()) for k in (0, 1))
            if not p0 or not n0:
                break
            base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
            for c in names:
                for k, e in enumerate(edges[c]):
                    over = [v for b, v in counts[c].items() if b > k]
                    p, n = sum(v[0] for v in over), sum(v[1] for v in over)
                    for above, (pp, nn) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                        if pp >= least_cover and (gain := pp * (math.log2(pp / (pp + nn)) - base)) > best[0] + 1e-9:
                            best = (gain, Test(c, above, e))
            if best[1] is None:
                break
            tests = (*tests, best[1])
        if not tests:
            break
        cover = table.where(left & ~F.col("_grow"))
        prefixes = [tests[:k] for k in range(1, len(tests) + 1)]
        got = cover.agg(*[F.coalesce(F.sum(F.when(_all(tuple(map(as_bin, x))), y)), F.lit(0)) for x in prefixes for y in (F.col("_bad"), 1 - F.col("_bad"))]).first()
        scored = [((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k, k) for k in range(len(prefixes))]
        _, _, k = max(scored)
        p, n = got[2 * k], got[2 * k + 1]
        if not p or p < least_precision * (p + n):
            break
        rules.append(prefixes[k])
        left = left & ~_all(tuple(map(as_bin, prefixes[k])))
    return rules


def rejected_by(rules: Rules) -> Column:
    """The place of the first rule that rejects, from 1; null: none does. One CASE expression over FEATURES."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(_all(rules[k - 1]), k).otherwise(out)
    return out


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def fit_quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how) -> Rules:
    """Learns from at most max_labelled labelled rows, those of the least hashes of doc_id; rows that fail the base rules are left to those.

    Labels that are null or not in {0, 1} are not used; a doc_id that is labelled twice counts with its lower label, one that several
    rows of docs share with its least text.
    """
    good = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    known = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # sample: at most max_labelled rows
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_quality").alias("_quality"))  # and so are these
    rows = text_statistics(known, keep=("_quality",)).where(~base_failed()).select((1 - F.col("_quality")).cast("int").alias("_bad"), (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) > 0).alias("_grow"), *[x.alias(c) for c, x in features().items()])
    return learn_decision_list(rows, **how)


def judge_quality(docs: DataFrame, rules: Rules, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, BASE, base_failed, kept and rule (place of the rule that rejected it) for every row of docs; nothing is shuffled.

    Null text: as empty. Null and repeated doc_ids: a row each. Empty table: no rows. A column of keep that has the name of another
    column of this operator comes back with _in added to its name.
    """
    own = [*BASE, *FEATURES, "base_failed", "kept", "rule", "s", "c", "n_lines", "n_upper", "n_marks", "n_bars"]
    docs, keep = carried(docs, keep, own)
    stats = text_statistics(docs, keep=keep)
    for c, x in features().items():
        if c != "n_words":
            stats = stats.withColumn(c, x)
    stats = stats.withColumn("rule", rejected_by(rules)).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", *keep, *BASE, "base_failed", "kept", "rule")
