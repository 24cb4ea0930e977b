"""BM25 of a table of queries (V-5).

A query set of at most SMALL_ROWS (query, token) pairs, counted first, goes to every task. The
documents' tokens are read once, in one pass that keeps of each document its length and how
often it has the tokens that some query asks for; that is written down, the statistics are sums
over it, and a second pass over it scores each document for all queries at once. A larger query
set is joined by token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.sources.scratch import ensure_checkpoint_dir

SMALL_ROWS = 500_000
#: (document, query, token) triples that are added up at once.
STEP = 2_000_000
COUNTED = "object_id string, length int, raw int, tokens array<int>, counts array<int>"


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """V-5: (query_id, object_id, bm25) of documents that share a token with a query.

    ``queries`` has (query_id, tokens), ``docs`` (object_id, tokens); statistics are those of
    ``docs``. A token that a query repeats counts again.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    few = asked.limit(SMALL_ROWS + 1).collect()
    return _of_few(few, docs, k1, b) if len(few) <= SMALL_ROWS else _joined(asked, docs, k1, b)


def _of_few(asked: list, docs: DataFrame, k1: float, b: float) -> DataFrame:
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    numbers = {t: i for i, t in enumerate(sorted({r.token for r in asked}))}
    shipped = spark.sparkContext.broadcast(numbers)  # SMALL_ROWS tokens at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shipped.value
        for batch in batches:
            tokens, found = batch.column(1), []
            for row in tokens:
                held = Counter(row.as_py() or ())
                found.append({wanted[t]: n for t, n in held.items() if t in wanted})
            raw = tokens.value_lengths().fill_null(0)
            columns = [batch.column(0), pa.array(np.maximum(raw.to_numpy(), 1).astype(np.int32)), raw.cast(pa.int32())]
            columns += [pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COUNTED.split(", ")])

    counted = docs.select("object_id", "tokens").mapInArrow(count, COUNTED).checkpoint()
    n_docs, mean = counted.agg(F.count(F.lit(1)), F.greatest(F.avg("raw"), F.lit(1.0))).first()
    df = np.zeros(len(numbers))
    for token, n in counted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per token asked for
        df[token] = n
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    ids = sorted({r.query_id for r in asked})
    place = {q: i for i, q in enumerate(ids)}
    postings = sorted((numbers[r.token], place[r.query_id], r.times) for r in asked)
    term, query, times = (np.array(x, np.int64) for x in (zip(*postings) if postings else ([], [], [])))
    start = np.searchsorted(term, np.arange(len(numbers) + 1))
    model = spark.sparkContext.broadcast((np.array(ids, np.int64), idf, start, query, times))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, first, at_query, repeats = model.value
        step = max(1, STEP // max(1, len(at_query)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                size = part.column(3).value_lengths().to_numpy()
                doc, token = np.repeat(np.arange(part.num_rows), size), part.column(3).flatten().to_numpy()
                tf, length = part.column(4).flatten().to_numpy().astype(float), part.column(1).to_numpy()[doc]
                worth = weight[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
                many = first[token + 1] - first[token]
                post = np.arange(many.sum()) + np.repeat(first[token] - np.cumsum(many) + many, many)
                cell = np.repeat(doc, many) * len(names) + at_query[post]
                sums = np.bincount(cell, np.repeat(worth, many) * repeats[post], part.num_rows * len(names))
                hit = np.unique(cell)
                yield pa.RecordBatch.from_arrays([pa.array(names[hit % len(names)]), part.column(0).take(pa.array(hit // len(names))), pa.array(sums[hit])], ["query_id", "object_id", "bm25"])

    return counted.filter("size(tokens) > 0").mapInArrow(score, "query_id bigint, object_id string, bm25 double")


def _joined(asked: DataFrame, docs: DataFrame, k1: float, b: float) -> DataFrame:
    length = F.greatest(F.size("tokens"), F.lit(1)).alias("length")
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg(F.size("tokens")), F.lit(1.0)).alias("mean_length"))
    wanted = asked.select("token").distinct()
    tf = docs.select("object_id", length, F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("object_id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    terms = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    met = tf.join(terms, "token").join(asked, "token")
    return met.groupBy("query_id", "object_id").agg(F.sum(part * F.col("times")).alias("bm25"))
