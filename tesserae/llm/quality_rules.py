"""Operator 11: quality rules as a learned decision list.

Each text is reduced to counts (words, characters, symbols, repeated lines and
words); ratios of them are the attributes. A decision list is learned from
labelled rows by sequential covering: a conjunction of thresholds is grown by
information gain on two thirds of the rows until it covers no good row, then its
last conditions are pruned as long as that doesn't lower its worth on the other
third; rows that it covers are set aside and the next one is grown from the rest.
A conjunction that isn't precise enough ends the list. Texts that no rule takes
are kept. The list is given out as one conditional expression of Spark over the
counts, in order, and as text.

The base rules come first and are not learned from: under ``MIN_WORDS`` words, or
more than half of the words in repeated windows.

The list is learned from at most ``sample`` labelled rows (those of smallest id
hash), whose ids are broadcast and whose counts come to the driver, a row an id;
counts and verdicts cover all rows and whole texts, in one pass without a shuffle.

Defined results: a null text has zero counts and fails the base rules; rows that
share an id are judged each by its own text; repeated label rows count as bad if
any is; without labels of both kinds the list is empty and the base rules alone
decide; an empty table gives an empty result; columns named like the results are
refused, others pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text_stats import _class, quality_counts
from .words import slices

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: attribute -> its count and the count it is a share of (None: of nothing)
ATTRIBUTES = {
    "words": ("n_words", None),
    "characters a word": ("word_chars", "n_words"),
    "symbols a word": ("n_symbols", "n_words"),
    "share of repeated lines": ("n_dup_lines", "n_lines"),
    "share of repeated words": ("n_repeat_words", "n_words"),
    "words a line": ("n_words", "n_lines"),
    "share of distinct words": ("n_distinct_words", "n_words"),
}


def counts(text: Column) -> Column:
    """struct of ``COUNTS`` of a text."""
    symbols = _class(SYMBOLS)

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        parts = [quality_counts(data, offsets, symbols) for _, _, data, offsets in slices(texts)]
        columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))

    return count(F.coalesce(text, F.lit("")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


@dataclass(frozen=True)
class Condition:
    attribute: str
    above: bool  # over the threshold, or up to it
    threshold: float

    def __str__(self) -> str:
        return f"{self.attribute} {'>' if self.above else '<='} {self.threshold:g}"

    def column(self) -> Column:
        part, whole = ATTRIBUTES[self.attribute]
        value = F.col(part).cast("double") if whole is None else F.col(part) / F.greatest(F.col(whole), F.lit(1)).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.attribute]
        return v > self.threshold if self.above else v <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions are rejected."""

    conditions: tuple[Condition, ...]
    bad: int  # rows it was learned from that it covers
    good: int

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, (c.covers(values) for c in self.conditions))

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} ({self.bad} bad, {self.good} good)"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def kept(self) -> Column:
        """The verdict as one ordered conditional expression over the counts."""
        if not self.rules:
            return F.lit(True)
        first, *rest = [(reduce(lambda x, y: x & y, (c.column() for c in r.conditions)), F.lit(False)) for r in self.rules]
        return reduce(lambda e, r: e.when(*r), rest, F.when(*first)).otherwise(F.lit(True))

    def describe(self) -> str:
        return "\n".join([*map(str, self.rules), "keep the rest"])


def attributes(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {a: rows[x] / (1.0 if y is None else np.maximum(rows[y], 1).astype(float)) for a, (x, y) in ATTRIBUTES.items()}


def short_between(a: float, b: float) -> float:
    """The decimal of fewest digits in the middle half of a to b, so that neither side's rows lie at the threshold."""
    low, high = a + (b - a) / 4, b - (b - a) / 4
    for digits in range(17):
        step = 10.0 ** (digits - 3)
        t = math.ceil(low * step) / step
        if a <= t <= high and t < b:
            return t
    return a


def best_condition(values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain over the rows."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Condition | None] = (0.0, None)
    if not p0 or not n0:
        return best
    before = math.log2(p0 / (p0 + n0))
    for name, v in values.items():
        order = np.argsort(v, kind="stable")
        x, y = v[order], bad[order]
        ends = np.flatnonzero(x[1:] != x[:-1])
        if not len(ends):
            continue
        p_low, n_low = np.cumsum(y)[ends], np.cumsum(~y)[ends]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, short_between(float(x[ends[k]]), float(x[ends[k] + 1]))))
    return best


def grown(values: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    conditions: list[Condition] = []
    rows = np.arange(len(bad))
    while len(conditions) < most and (~bad[rows]).any():
        _, found = best_condition({a: v[rows] for a, v in values.items()}, bad[rows])
        if found is None:
            break
        conditions.append(found)
        rows = rows[found.covers({found.attribute: values[found.attribute][rows]})]
    return conditions


def pruned(conditions: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The beginning of the conjunction of greatest worth (bad - good) / (bad + good) on these rows; the shorter of equals."""
    best, kept, on = -2.0, conditions, np.ones(len(bad), bool)
    for i, c in enumerate(conditions):
        on = on & c.covers(values)
        p, n = int((bad & on).sum()), int((~bad & on).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, conditions[: i + 1]
    return kept


def learned(rows: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = 32, most_conditions: int = 6) -> DecisionList:
    """Sequential covering over rows of counts; ``grow`` marks those that rules are grown on, the others prune."""
    values, left = attributes(rows), np.ones(len(bad), bool)
    found = DecisionList()
    while len(found.rules) < most_rules and (bad & left).any() and (~bad & left).any():
        of = lambda mask: ({a: v[mask] for a, v in values.items()}, bad[mask])
        conditions = grown(*of(left & grow), most_conditions)
        if not conditions:
            break
        conditions = pruned(conditions, *of(left & ~grow))
        on = left & Rule(tuple(conditions), 0, 0).covers(values)
        p, n = int((bad & on).sum()), int((~bad & on).sum())
        if p < least or p < precision * (p + n):
            break
        found.rules.append(Rule(tuple(conditions), p, n))
        left &= ~on
    return found


def learn(docs: DataFrame, labels: DataFrame, sample: int = 50_000, precision: float = 0.95) -> DecisionList:
    """The decision list of docs(doc_id, text) and labels(doc_id, quality)."""
    of = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    ids = written(of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    mine = docs.where("doc_id is not null").select(F.col("doc_id").alias("__d"), "text").join(F.broadcast(ids), F.col("__d") == ids["doc_id"])  # at most ``sample`` ids
    counted = mine.select("doc_id", "bad", counts(F.col("text")).alias("c")).groupBy("doc_id").agg(F.first("bad").alias("bad"), F.min("c").alias("c"))
    rows = counted.select("doc_id", "bad", (F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0).alias("grow"), "c.*")
    rows = rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).toPandas().sort_values("doc_id")
    return learned({c: rows[c].to_numpy() for c in COUNTS}, rows["bad"].to_numpy(bool), rows["grow"].to_numpy(bool), precision)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` with ``COUNTS``, base_failed and kept."""
    if clash := {*COUNTS, "base_failed", "kept", "__c"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    counted = docs.withColumn("__c", counts(docs["text"])).select(*[docs[f"`{c}`"] for c in docs.columns], "__c.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & rules.kept())


