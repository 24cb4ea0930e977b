"""Pluggable models (K-1 to K-7): callers give plain functions on lists, the defaults are
deterministic. A function gets a batch at a time inside the tasks; one that fails or answers
only in part leaves the captured values of the rest as they were."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

BATCH = 10
#: Rows that are objects of Python at once, some batches; a batch of Arrow may have thousands of long texts.
HELD = 12 * BATCH

Scorer = Callable[[list[tuple[str, str, int]]], dict[str, int] | None]
Inferrer = Callable[[str, str, list[str]], list[str]]


def keep_importance(rows: list[tuple[str, str, int]]) -> dict[str, int]:
    """K-1, default: the captured value."""
    return {i: importance for i, _, importance in rows}


def score_importance(df: DataFrame, scorer: Scorer = keep_importance) -> DataFrame:
    """K-1: importance by the scorer, in batches of ``BATCH`` rows, clamped to 1..10."""

    def one(ids: pa.Array, content: pa.Array, importance: pa.Array) -> pa.Array:
        out: dict[str, int] = {}
        for rows in _held(ids, content, importance):
            for at in range(0, len(rows), BATCH):
                try:
                    out |= scorer(rows[at : at + BATCH]) or {}
                except Exception:  # a failed batch falls back, the others land
                    continue
        return pa.array([min(10, max(1, int(out.get(i, old)))) for i, old in zip(ids.to_pylist(), importance.to_pylist())], pa.int32())

    return df.withColumn("importance", F.arrow_udf(one, IntegerType())("object_id", "content", "importance"))


def _held(*columns: pa.Array) -> Iterator[list[tuple]]:
    """The rows of the columns, HELD at a time."""
    for begin in range(0, len(columns[0]), HELD):
        yield list(zip(*(c.slice(begin, HELD).to_pylist() for c in columns)))


def no_topics(object_id: str, content: str, tags: list[str]) -> list[str]:
    """K-2, default: the tags that name a topic."""
    return [t.removeprefix("topic:") for t in tags if t.startswith("topic:")]


def infer_topics(df: DataFrame, inferrer: Inferrer = no_topics) -> DataFrame:
    """K-2: topics by the inferrer where it finds any."""

    def one(ids: pa.Array, content: pa.Array, tags: pa.Array, topics: pa.Array) -> pa.Array:
        return pa.array([inferrer(i, c, t) or old for rows in _held(ids, content, tags, topics) for i, c, t, old in rows], pa.list_(pa.string()))

    return df.withColumn("topics", F.arrow_udf(one, ArrayType(StringType()))("object_id", "content", "tags", "topics"))


def judge_pairs(pairs: DataFrame, judge: Callable[[str, str], bool]) -> DataFrame:
    """K-4: a verdict on each pair of texts (text_a, text_b); ``judge`` says if they contradict."""

    def one(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["contradictory" if judge(x, y) else "consistent" for x, y in zip(a, b)])

    return pairs.withColumn("verdict", F.pandas_udf(one, StringType())("text_a", "text_b"))


def plain_note(title: str, content: str) -> str:
    """K-5, default."""
    return f"## {title}\n\n{content}"


def render(df: DataFrame, renderer: Callable[[str, str], str] = plain_note) -> DataFrame:
    """K-5: a note's body from title and content."""

    def one(title: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([renderer(t, c) for t, c in zip(title, content)])

    return df.withColumn("body", F.pandas_udf(one, StringType())("title", "content"))


def embed(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "content") -> DataFrame:
    """K-6: vectors of a column, batch by batch."""

    def some(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(embedder(batch.fillna("").tolist()))

    some.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("vector", F.pandas_udf(some, ArrayType(DoubleType()))(text))


def lexical_scorer(query: Column, text: Column) -> Column:
    """K-7, default: twice the share of the query's words in the text, less one."""
    words = F.array_distinct(F.split(F.lower(query), "\\s+"))
    met = F.size(F.array_intersect(words, F.split(F.lower(text), "\\s+")))
    return 2.0 * met / F.greatest(F.size(words), F.lit(1)) - 1.0
