"""The k nearest rows of a table of queries, by cosine (V-2).

A query set of at most FEW queries, counted first, goes to every task, and the rows stay where
they are: each task keeps the k best rows of each query while its rows go by. A larger one is
joined in cells: the queries of a namespace are dealt into blocks of about FEW, its rows into
blocks of about CELL_ROWS; each pair of blocks is one matrix product in a task of its own, and
gives k rows for a query at most. Either way the rows are read once, and the best of a query are
taken from the bounded lists of tasks or cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to every task, or to a cell, and rows of a cell.
FEW = 2048
CELL_ROWS = 8192
#: A matrix product's rounding, by dimension and lengths; scores that may be among the best are taken
#: again, EXACT at once, each by itself: equal vectors have equal scores wherever they lie.
ROUNDING, EXACT = 4e-16, 2**16
FOUND = "query_id bigint, object_id string, score double"


def unit(vectors) -> np.ndarray:
    """The vectors as rows of length one; zero vectors stay."""
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def fresh(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it can be grouped together with what it stems from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def plain(vectors) -> np.ndarray:
    """The vectors as rows, as they are."""
    return np.array([np.asarray(v, np.float64) for v in vectors])


def first_k(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each query, ties by id."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return order[place < k]


class _Best:
    """The k best rows so far of each query of a namespace."""

    def __init__(self, query_ids: list[int], vectors: np.ndarray, k: int):
        self.query_ids, self.vectors, self.k = np.array(query_ids), vectors, k
        self.query, self.score, self.ids = np.empty(0, int), np.empty(0), np.empty(0, object)
        self.floor = np.full(len(query_ids), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = self.vectors @ rows.T
        slack = ROUNDING * rows.shape[1] * np.linalg.norm(self.vectors, axis=1) * (np.linalg.norm(rows, axis=1).max() if len(rows) else 0.0)
        if scores.shape[1] > self.k:  # what is below a query's k-th best here can't be among its k best
            self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=1)[:, -self.k] - slack)
        query, row = np.nonzero(scores >= (self.floor - slack)[:, None])
        score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", self.vectors[query[at : at + EXACT]], rows[row[at : at + EXACT]]) for at in range(0, len(query), EXACT))])
        query, score, ids = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.ids, ids[row]]
        stay = first_k(query, score, ids.astype(str), self.k)
        self.query, self.score, self.ids = query[stay], score[stay], ids[stay]
        full = np.bincount(self.query, minlength=len(self.floor)) == self.k
        worst = np.full(len(self.floor), np.inf)
        np.minimum.at(worst, self.query, self.score)
        self.floor[full] = np.maximum(self.floor[full], worst[full])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.query_ids[self.query], pa.int64()), pa.array(self.ids, pa.string()), pa.array(self.score)], ["query_id", "object_id", "score"])


def _of_few(queries: list, rows: DataFrame, k: int, read: Callable) -> DataFrame:
    by_space: dict[str, list] = {}
    for q in queries:
        by_space.setdefault(q.namespace, []).append(q)
    packed = {name: ([q.query_id for q in qs], read([q.vector for q in qs])) for name, qs in by_space.items()}
    shipped = rows.sparkSession.sparkContext.broadcast(packed)  # FEW queries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {name: _Best(*part, k) for name, part in shipped.value.items()}
        for batch in batches:
            spaces = np.array(batch.column(0).to_pylist(), object)
            for name in {*spaces} & best.keys():
                at = pa.array(np.flatnonzero(spaces == name))
                best[name].add(np.array(batch.column(1).take(at).to_pylist(), object), read(batch.column(2).take(at).to_pylist()))
        yield from (b.batch() for b in best.values())

    return rows.select("namespace", "object_id", "vector").mapInArrow(run, FOUND)


def _in_cells(queries: DataFrame, rows: DataFrame, k: int, read: Callable) -> DataFrame:
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("namespace").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = blocks(queries, FEW, "query_blocks").join(blocks(rows, CELL_ROWS, "row_blocks"), "namespace")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
        return df.join(sizes, "namespace").withColumns({own: F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"), other: every}).drop("query_blocks", "row_blocks")

    def cell(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(part):
            return pd.DataFrame({"query_id": [], "object_id": [], "score": []})
        best = _Best(asked.query_id.tolist(), read(asked.vector), k)
        best.add(part.object_id.to_numpy(), read(part.vector))
        return best.batch().to_pandas()

    key = ["namespace", "query_block", "row_block"]
    asked = dealt(queries, "query_id", "query_block", "row_block")
    held = fresh(dealt(rows.select("namespace", "object_id", "vector"), "object_id", "row_block", "query_block"))
    return asked.groupBy(key).cogroup(held.groupBy(key)).applyInPandas(cell, FOUND)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, cosine: bool = True) -> DataFrame:
    """V-2: (query_id, object_id, score, rank): the k rows of the query's namespace with the
    largest cosine, or inner product, ties by object_id. ``queries`` has query_id, namespace and
    vector."""
    read = unit if cosine else plain
    asked = queries.select("query_id", "namespace", "vector")
    few = asked.limit(FEW + 1).collect()  # FEW + 1 queries at most
    best = _of_few(few, rows, k, read) if len(few) <= FEW else _in_cells(asked, rows, k, read)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "object_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)
