"""Ranked lexical search: the documents' texts are scanned for the terms of a table of items.

A term is a maximal run of ASCII letters and digits and of code points beyond ASCII, A-Z
lower-cased. Every document is scanned twice by an Aho-Corasick automaton of all terms of the
items, each guarded by a boundary on both sides, so only whole terms match: first for the
statistics of the terms (documents that hold each, and length of all documents), then for the
scores. Nothing is kept of a document between the scans and no index of documents is built.
The automaton's outputs lead to the items: a term's postings are the items that hold it. Each
task keeps the best documents of each item in bounded memory.

Items are dealt into blocks of about BLOCK_PAIRS (item, term) pairs by a hash of their id; one
block at a time is broadcast and the documents are scanned for it, so what is broadcast does
not grow with the items. An item is never split: one with more terms makes its block larger.

Defined cases: a null or empty text has no terms; such a document counts in no statistic and is
in no result, such an item has no result. A repeated row of documents is a document of its own
and ranks beside its copy; of equal scores the smaller doc_id comes first, null last. Rows of
items with one item_id (a null one too) are one item with the terms of all its different texts.
Very long texts are scanned whole. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import ascii_lower, materialize
from memlake.llm.topk import NULL_ID, Best

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (item, term) pairs of a block of items, about.
BLOCK_PAIRS = 500_000
#: (document, item, term) triples that a task scores at once.
STEP = 4_000_000
K = 20
#: Parts of an item's candidates that are cut to the best before they meet.
PARTS = 32

#: UTF-8 bytes: separators become spaces, A-Z small letters, all others stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and qtf, its occurrences in the item."""
    terms: Column = F.filter(F.split(ascii_lower(F.col("text")), SEPARATOR), lambda x: x != "")
    apart = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return apart.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


class Block:
    """The terms of a block of items, numbered, with the items that hold each."""

    def __init__(self, rows: list[tuple[int | None, str, int]]):
        self.terms = sorted({term for _, term, _ in rows})
        self.items = sorted({item for item, _, _ in rows}, key=lambda x: (x is None, x))
        number, place = {t: i for i, t in enumerate(self.terms)}, {x: i for i, x in enumerate(self.items)}
        pairs = sorted((number[term], place[item], qtf) for item, term, qtf in rows)
        term, self.posting, self.qtf = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [], [])))
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each worker builds it once

    def count(self, folded: str) -> Counter:
        """Occurrences of the block's terms, by number, in a text of folded bytes, a character each,
        with a space at both ends."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                self._automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
            self._automaton.make_automaton()
        return Counter(map(itemgetter(1), self._automaton.iter(folded)))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, int]]:
    """doc_id, folded text and number of terms of the documents that have terms."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                folded = (text or "").encode().translate(_FOLD)
                if n := len(folded.split()):
                    yield NULL_ID if doc_id is None else doc_id, f" {folded.decode('latin-1')} ", n


def statistics(docs: DataFrame, block: Broadcast[Block]) -> tuple[int, int, np.ndarray]:
    """N, L and each term's df, from sums of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(block.value.terms), np.int64), 0, 0
        for _, folded, n in _documents(batches):
            n_docs, n_terms = n_docs + 1, n_terms + n
            df[np.fromiter(block.value.count(folded), np.int64)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, held]), pa.array(np.r_[n_terms, n_docs, df[held]])], ["term", "n"])

    sums = docs.select("doc_id", "text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(sums.collect())  # a row for each term of the block at most
    df = np.zeros(len(block.value.terms), np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-1, 0), found.get(-2, 0), df


def _score(block: Block, weight: np.ndarray, counts: list[Counter], m: list[int]) -> np.ndarray:
    """Scores of documents (rows) for the block's items (columns)."""
    size = np.array([len(c) for c in counts])
    doc = np.repeat(np.arange(len(counts)), size)
    term = np.fromiter((t for c in counts for t in c), np.int64, len(doc))
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(doc))
    worth = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * np.array(m, np.int64)[doc]))
    many = block.start[term + 1] - block.start[term]
    at = np.arange(many.sum()) + np.repeat(block.start[term] - np.cumsum(many) + many, many)
    out = np.zeros(len(counts) * len(block.items), np.int64)
    np.add.at(out, np.repeat(doc * len(block.items), many) + block.posting[at], np.repeat(worth, many) * block.qtf[at])
    return out.reshape(len(counts), -1)


def _best_of_block(docs: DataFrame, block: Broadcast[Block], k: int) -> DataFrame:
    n_docs, n_terms, df = statistics(docs, block)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    weights = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        best, step = Best(len(own.items), k), max(1, min(256, STEP // max(1, len(own.posting), len(own.items))))
        ids: list[int] = []
        counts: list[Counter] = []
        m: list[int] = []

        def add() -> None:
            scores = _score(own, weights.value, counts, m)
            doc, item = np.nonzero((scores > 0) & (scores >= best.floor))
            best.add(item, scores[doc, item], np.array(ids, np.int64)[doc])
            for x in (ids, counts, m):
                x.clear()

        for doc_id, folded, n in _documents(batches):
            if count := own.count(folded):
                ids.append(doc_id)
                counts.append(count)
                m.append(75 + 25 * n * n_docs // n_terms)
                if len(ids) == step:
                    add()
        if ids:
            add()
        item = pa.array([own.items[i] for i in best.key.tolist()], pa.int64())
        doc = pa.array(best.id, mask=best.id == NULL_ID)
        yield pa.RecordBatch.from_arrays([item, doc, pa.array(best.score)], ["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(items: DataFrame, docs: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items))
    blocks = max(1, math.ceil(terms.count() / block_pairs))
    found = []
    for b in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # block_pairs, about
        if not rows:
            continue
        one = _best_of_block(docs, spark.sparkContext.broadcast(Block([tuple(r) for r in rows])), k)
        found.append(one if blocks == 1 else materialize(one))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    first = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    few = every.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*first)))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*first))
    return few.filter(F.col("place") <= k).withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
