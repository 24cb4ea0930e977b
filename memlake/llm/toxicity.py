"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 heavily toxic. P(grade > j) = sigmoid(w.x - c_j) with
one weight vector for all thresholds c_0 <= c_1. The output is the expected severity, the sum
of those probabilities, from 0 to 2.

Grades come from the labels. toxic = 0 is grade 0. A toxic document is grade 2 if it holds at
least as many words of the toxic lexicon as the median toxic document with any does and more
than one, else 1; the lexicon is the features in the training sample with a smoothed log odds of
``LEXICON_ODDS`` or more for toxic documents.

So the second cut is set by construction, from the lexicon's words, which are features too: it
orders documents by how much of the lexicon they hold, and no label checks it.

Features are presence of lower-cased words (letters only) and of their beginnings, of those
that ``MIN_DOCS`` sampled documents or more hold: a whole text's length does not dilute a word. The fit is proximal gradient
descent with an L1 penalty, which leaves words without evidence at exactly 0.

Defined cases: a null or empty text has no features and gets the intercepts' severity; labels
that are null, disagree or lack their document are not learned from; without both kinds of
labels every severity is 0; of equally likely grades the lowest is given; very long texts are
read whole; rows are never merged; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import materialize

#: At most so many labelled documents, clean and toxic, are learned from, taken by a hash of
#: their ids.
SAMPLE_BOUNDS = (15_000, 5_000)
#: A document is called toxic if the chance of a grade above 0 reaches this.
THRESHOLD = 0.3
FLUSH_FEATURES = 300_000
MIN_DOCS = 8
LEXICON_ODDS = 3.0
GRADES = 3
#: A feature is fitted if its log odds times the root of its documents reach this.
EVIDENCE = 4.0
#: Lengths of the words' beginnings that are features too.
PREFIXES = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Distinct words of the text, and their beginnings (marked ``^``), which inflected and
    compounded forms of a word share."""
    if not text:
        return set()
    words = set(_WORD.findall(text.lower()))
    return words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in PREFIXES))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    weights: dict[str, float]
    cuts: np.ndarray  # increasing; one for each grade above 0

    def chances(self, text: str | None) -> np.ndarray:
        """P(grade > j) for each threshold."""
        get = self.weights.get
        return _sigmoid(sum(get(w, 0.0) for w in features_of(text)) - self.cuts)


def grade(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grades from the label and the number of lexicon words in the document."""
    some = hits[(toxic == 1) & (hits > 0)]
    heavy = max(2.0, float(np.median(some))) if len(some) else np.inf
    return np.where(toxic == 0, 0, np.where(hits >= heavy, 2, 1))


def fit(names: list[str], odds: np.ndarray, n: np.ndarray, cols: list[np.ndarray], toxic: np.ndarray, steps: int = 600, l1: float = 5e-5) -> Model:
    """Proximal gradient descent on the mean negative log likelihood.

    ``names`` are the features, with their log odds and numbers of documents; ``cols`` holds
    the features of each document by number.
    """
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    flat = np.concatenate(cols).astype(np.int64) if cols else np.empty(0, np.int64)
    lexicon = odds >= LEXICON_ODDS
    y = grade(toxic, np.bincount(rows, lexicon[flat].astype(float), len(cols)))
    above = (y[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    scale = 1 / np.sqrt(n + 1.0)  # rare words move as fast as frequent ones
    w, cuts = np.zeros(len(names)), -np.log((above.mean(axis=0) + 1e-3) / (1 - above.mean(axis=0) + 1e-3))
    rate_w, rate_c, m = 2.0, 0.5, len(cols)
    seen = np.full(len(names), 1e-8)
    for _ in range(steps):
        z = np.bincount(rows, w[flat], m)
        p = _sigmoid(z[:, None] - cuts[None, :])
        # the likelihood of grade k is P(> k-1) - P(> k); its gradient in z and in the cuts
        upper = np.concatenate([np.ones((m, 1)), p], axis=1)[np.arange(m), y]
        lower = np.concatenate([p, np.zeros((m, 1))], axis=1)[np.arange(m), y]
        slope = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / slope, lower * (1 - lower) / slope
        g_z = (dl - du) / m
        g_cut = np.array([(du[y == j + 1].sum() - dl[y == j].sum()) / m for j in range(GRADES - 1)])
        g = np.bincount(flat, g_z[rows], len(names))
        seen += g * g
        step = rate_w * scale / np.maximum(scale.max(), 1e-9) / np.sqrt(seen) * 0.1
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        cuts = np.maximum.accumulate(cuts - rate_c * g_cut)
    return Model({names[i]: float(w[i]) for i in np.flatnonzero(w)}, cuts)


def sample(docs: DataFrame, labels: DataFrame, bounds: tuple[int, int] = SAMPLE_BOUNDS) -> DataFrame:
    """doc_id, text and toxic of at most ``bounds[toxic]`` documents of each label."""
    agreed = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other and toxic in (0, 1)").drop("other")
    counts = {r.toxic: r.n for r in agreed.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for kind, n in sorted(counts.items()):
        share = int(min(1.0, 0.95 * bounds[kind] / n) * (1 << 20))
        part = agreed.filter((F.col("toxic") == kind) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)).limit(bounds[kind])
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("toxic")).limit(0)
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")  # of several texts of an id always the same


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, the documents and the toxic documents that have it; summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0])
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][x] for x in names], pa.int64()), pa.array([counts[1][x] for x in names], pa.int64())], ["feature", "n", "toxic_n"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = features_of(text)
                counts[0].update(found)
                if toxic:
                    counts[1].update(found)
                if len(counts[0]) > FLUSH_FEATURES:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "feature string, n bigint, toxic_n bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic_n").alias("toxic_n"))


def learn(docs: DataFrame, labels: DataFrame, bounds: tuple[int, int] = SAMPLE_BOUNDS) -> Model:
    """The fit on the bounded sample. Features are counted and chosen in Spark; the driver gets
    the chosen ones and each sampled document's numbers of them."""
    rows = materialize(sample(docs, labels, bounds))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, np.full(GRADES - 1, np.inf))
    odds = F.log((F.col("toxic_n") + 0.5) / (sizes[1] + 1)) - F.log((F.col("n") - F.col("toxic_n") + 0.5) / (sizes[0] + 1))
    told = feature_counts(rows).filter(F.col("n") >= MIN_DOCS).withColumn("odds", odds).filter(F.abs("odds") * F.sqrt("n") >= EVIDENCE).toPandas().sort_values("feature", ignore_index=True)
    at = {w: i for i, w in enumerate(told.feature)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(at[w] for w in features_of(x) if w in at) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], ["doc_id", "features", "toxic"])

    each = rows.mapInArrow(run, "doc_id bigint, features array<int>, toxic int").toPandas().sort_values("doc_id", kind="stable")
    return fit(list(told.feature), told.odds.to_numpy(), told.n.to_numpy(), [np.asarray(x, np.int64) for x in each.features], each.toxic.to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade (the likeliest) and toxic (p_toxic >= ``THRESHOLD``)."""
    schema = "doc_id bigint, expected_severity double, p_toxic double, grade int, toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.chances(x) for x in batch.column(1).to_pylist()]).reshape(-1, GRADES - 1)
            each = np.concatenate([np.ones((len(p), 1)), p], axis=1) - np.concatenate([p, np.zeros((len(p), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(each.argmax(axis=1), pa.int32()), pa.array(p[:, 0] >= THRESHOLD)], [x.split()[0] for x in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
