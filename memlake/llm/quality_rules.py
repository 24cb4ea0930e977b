"""Quality rules: whole-text statistics and a learned decision list over them.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has none. The list is learned by sequential
covering: a rule (a conjunction of thresholds) is grown on two thirds of a bounded sample of
labelled documents, pruned on the rest, kept if it is precise there, and the documents that it
covers are taken out before the next rule is grown. The result is an ordered Spark conditional
expression over the statistics.

Defined cases: a null or empty text has zero in every count, so it fails the base rule; every
input row gives one row, repeated rows too; documents without a label, with a null id or with
labels that disagree are not learned from; without labelled documents of both kinds the list
is empty and only the base rule decides; of conditions with the same gain the first stands, by
feature, then threshold, then above before below, and a value that equals a threshold meets
neither of its conditions; very long texts are read whole. Extra columns of documents are not read, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are learned from, taken by a hash of their ids.
SAMPLE_ROWS = 20_000
WINDOW = 8

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits")
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"!?"
_DIGITS = b"0123456789"
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WINDOW)], np.uint64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in an 8-word window found twice or more in the text."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    at = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        at += hashes[i : i + n] * _POWERS[i]
    order = np.sort(at)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, counts = np.unique(at, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(hashes) + 1, np.int32)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of ``STATS``; upper-case letters, marks and digits are ASCII ones."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (
        len(words), len(text) - _without(raw, _SPACE), _without(raw, _SYMBOLS), len(lines) - len(set(lines)), repeated_words(hashes),
        len(lines), len(set(words)), _without(raw, _UPPER), _without(raw, _MARKS), _without(raw, _DIGITS),
    )


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and ``STATS`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(x) for x in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], ["doc_id", *STATS])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ", ".join(["doc_id bigint", *(f"{x} bigint" for x in STATS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Features of the rules as (name, numerator, denominator); the denominator is 1 at least.
FEATURES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("words_per_line", "n_words", "n_lines"),
    ("upper_share", "n_upper", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("digit_share", "n_digits", "word_chars"),
)


def feature(i: int) -> Column:
    _, top, bottom = FEATURES[i]
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def feature_matrix(stats: np.ndarray) -> np.ndarray:
    """The same features from rows of ``STATS``."""
    col = {name: stats[:, i].astype(float) for i, name in enumerate(STATS)}
    return np.stack([col[top] / np.maximum(col[bottom], 1) for _, top, bottom in FEATURES], axis=1)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def test(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v > self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        v = feature(self.feature)
        return v > F.lit(self.threshold) if self.above else v < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A document that meets all conditions is rejected."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out &= c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _covers(conditions: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in conditions:
        out &= c.test(x)
    return out


def _candidates(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Thresholds halfway between neighbours among the bad rows' and all rows' quantiles."""
    out = []
    for f in range(x.shape[1]):
        v = np.unique(np.concatenate([np.quantile(x[:, f], np.linspace(0, 1, 33)), np.quantile(x[bad, f], np.linspace(0, 1, 17))]))
        for t in (v[1:] + v[:-1]) / 2:
            out += [Condition(f, True, float(t)), Condition(f, False, float(t))]
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Condition]:
    """Add the condition of the largest information gain until the rule is pure."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        xs, bs = x[inside], bad[inside]
        before, best, gain = np.log2(bs.mean()), None, 1e-9
        for c in _candidates(xs, bs):
            hit = c.test(xs)
            p = int(bs[hit].sum())
            if p and (g := p * (np.log2(p / hit.sum()) - before)) > gain:
                best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.test(x)
    return rule


def _tightest(rule: list[Condition]) -> list[Condition]:
    """Of conditions on the same side of a feature the last one, which implies the others."""
    return list({(c.feature, c.above): c for c in rule}.values())


def learn(x: np.ndarray, bad: np.ndarray, fold: np.ndarray, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.95, support: int = 3) -> list[Rule]:
    """The decision list. ``fold`` is True for rows that grow rules, False for those that prune.

    Pruning drops final conditions while (bad - good) / (bad + good) on the pruning rows does
    not fall. A rule stays if it covers ``support`` pruning rows with ``precision``; after two
    rules in a row that don't, learning ends.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    failures = 0
    while len(rules) < most_rules and failures < 2:
        grow, prune = left & fold, left & ~fold
        rule = _grow(x[grow], bad[grow], most_conditions) if bad[grow].any() else []
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], x[prune])
            p, n = int(bad[prune][hit].sum()), int((~bad[prune])[hit].sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        value, k, p, n = max(worth)
        rule = _tightest(rule[:-k])
        hit = _covers(rule, x)
        if p + n >= support and p >= precision * (p + n):
            rules.append(Rule(tuple(rule), p / (p + n), p + n))
            left &= ~hit
            failures = 0
        else:
            failures += 1
            left &= ~(hit & fold)  # these rows grow no rule that is worth keeping
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **how) -> list[Rule]:
    """Rules from at most ``sample_rows`` labelled documents; quality 0 is bad.

    Only the sampled documents' numbers reach the driver, some 100 bytes each.
    """
    agreed = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    n = agreed.count()
    if not n:
        return []
    part = min(1.0, 0.95 * sample_rows / n)
    sample = agreed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else agreed
    sample = sample.limit(sample_rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left_semi")  # sample_rows ids at most
    met = with_stats(some).join(F.broadcast(sample), "doc_id")
    one = met.groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("stats"))  # of several texts of an id always the same
    rows = one.select("doc_id", "quality", "stats.*").toPandas().sort_values("doc_id")  # a row per sampled id
    bad = rows.quality.to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    stats = rows[list(STATS)].to_numpy(np.int64)
    return learn(feature_matrix(stats), bad, rows.doc_id.to_numpy() % 3 != 0, **how)


def verdict(rules: list[Rule]) -> Column:
    """False where the base rule or a learned one fires, the first that fires deciding."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """Number of the rule that decided: 0 the base rule, null none."""
    out = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(i))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, ``STATS``, base_failed, rule and kept for every document."""
    rules = learn_rules(docs, labels, **how)
    return with_stats(docs).select("doc_id", *STATS, base_failed().alias("base_failed"), fired(rules).alias("rule"), verdict(rules).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    rules = learn_rules(docs, labels, **how)

    @F.pandas_udf(", ".join(f"{x} bigint" for x in STATS))
    def stats(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(x) for x in text], columns=list(STATS), dtype="int64")

    # not deterministic, so that no optimisation makes it run again for each condition
    counted = docs.select(F.struct("*").alias("doc"), stats.asNondeterministic()("text").alias("stats")).select("doc", "stats.*")
    return counted.filter(verdict(rules)).select("doc.*")
