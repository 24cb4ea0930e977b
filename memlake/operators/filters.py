"""Projections, filters and predicates (F-1 to F-13, K-0)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import truncate_grapheme
from memlake.schemas import ARCHIVE_STATES, RANKED_STATES, RECENT_STATES


def in_namespace(df: DataFrame, namespace: str) -> DataFrame:
    """F-1: exactly one namespace."""
    return df.filter(F.col("namespace") == namespace)


def visible_states(mode: str, include_archived: bool = False) -> tuple[str, ...]:
    """F-2: the states that a retrieval mode shows."""
    base = {"recent": RECENT_STATES, "episodic": ("matured",), "concept": RANKED_STATES}.get(mode, RANKED_STATES)
    extra = {"episodic": ("demoted",), "concept": ("synthesized",)}.get(mode, ARCHIVE_STATES)
    return (*base, *extra) if include_archived else base


def in_states(df: DataFrame, mode: str, include_archived: bool = False) -> DataFrame:
    return df.filter(F.col("state").isin(*visible_states(mode, include_archived)))


def holds_at(t: float) -> Column:
    """F-3: whether a row's half-open validity interval holds ``t``."""
    return (F.col("valid_from_epoch").isNull() | (F.col("valid_from_epoch") <= t)) & (F.col("valid_until_epoch").isNull() | (F.lit(t) < F.col("valid_until_epoch")))


def valid_at(df: DataFrame, t: float, state: str | None = None) -> DataFrame:
    """F-3: rows that are valid at ``t``."""
    out = df.filter(holds_at(t))
    return out.filter(F.col("state") == state) if state else out


def known_at(df: DataFrame, supersessions: DataFrame, t: float) -> DataFrame:
    """F-4: rows created by ``t`` that no supersession written by ``t`` names."""
    return df.filter(F.col("created_epoch") <= t).join(supersessions.filter(F.col("written_epoch") <= t).select("object_id"), "object_id", "left_anti")


def has_all_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    """F-5: rows that have every tag."""
    return df.filter(reduce(Column.__and__, (F.array_contains("tags", t) for t in tags), F.lit(True)))


def match_namespace_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """F-6: distinct namespaces that match; ``*`` stands for one whole segment."""
    parts = pattern.split("/")
    if any(not p or ("*" in p and p != "*") for p in parts):
        raise ValueError(f"bad pattern {pattern!r}")
    split = F.split("namespace", "/")
    hit = F.size(split) == len(parts)
    for i, p in enumerate(parts):
        if p != "*":
            hit &= split[i] == p
    return df.filter(hit).select("namespace").distinct()


def resolve_targets(namespaces: DataFrame, patterns: list[str], planes: list[str]) -> DataFrame:
    """F-7: concrete (namespace, plane) targets of patterns. Two segments take every plane,
    three name it; a two-segment pattern needs planes."""
    found = None
    for pattern in patterns:
        parts = pattern.split("/")
        if len(parts) == 2 and not planes:
            raise ValueError(f"{pattern!r} needs planes")
        for plane in dict.fromkeys(planes) if len(parts) == 2 else [parts[2]]:
            one = match_namespace_pattern(namespaces, "/".join([*parts[:2], plane]))
            found = one if found is None else found.unionByName(one)
    return found.distinct().withColumn("plane", F.element_at(F.split("namespace", "/"), -1))


def family_targets(df: DataFrame, family: str, planes: list[str]) -> DataFrame:
    """F-8: distinct namespaces of one family, by plane."""
    plane = F.element_at(F.split("namespace", "/"), -1)
    return df.filter(F.col("identity_family") == family).select("namespace", plane.alias("plane")).filter(F.col("plane").isin(*planes)).distinct()


LAYOUT_COLUMNS = ("point_id", "point_kind", "live_point", "committed_operation_id", "generation")


def identity_rows(df: DataFrame) -> DataFrame:
    """F-9: without content snapshots and the columns of the physical layout."""
    return df.filter(F.col("point_kind").isNull() | (F.col("point_kind") != "content")).drop(*LAYOUT_COLUMNS)


def with_snippet(df: DataFrame, n: int) -> DataFrame:
    """F-10: the text to show, its whole length in code points, and whether it is cut.

    The cut keeps at most ``n`` code points, in whole grapheme clusters. Only texts that are
    longer go through Python.
    """
    text = F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("title"), F.lit(""))
    cut = truncate_grapheme(n, "")(F.substring(text, 1, n + 64))  # no cluster that fits reaches further
    return df.withColumns({"snippet": F.when(F.length(text) > n, cut).otherwise(text), "content_length": F.length(text), "content_truncated": F.length(text) > n})


def with_lineage_summary(df: DataFrame, columns: tuple[str, ...] = ("promoted_to", "promoted_from", "supersedes", "superseded_by")) -> DataFrame:
    """F-11: a map of the lineage columns that are not null."""
    there = [c for c in columns if c in df.columns]
    pairs = F.create_map(*(x for c in there for x in (F.lit(c), F.col(c))))
    return df.withColumn("lineage", F.map_filter(pairs, lambda _, v: v.isNotNull()))


def page_after(df: DataFrame, cursor: str, limit: int) -> DataFrame:
    """F-12: the next page by key."""
    return df.filter(F.col("object_id") > cursor).orderBy("object_id").limit(limit)


def contradictions(df: DataFrame, namespace: str | None = None) -> DataFrame:
    """F-13: concepts that contradict others."""
    out = df.filter(F.size("contradicts") > 0)
    return out if namespace is None else in_namespace(out, namespace)


#: Fixed value: what a namespace looks like.
NAMESPACE = "^[a-z0-9][a-z0-9_-]*/[a-z0-9][a-z0-9_-]*/[a-z0-9][a-z0-9_-]*$"


def validate_captures(df: DataFrame, now: float) -> DataFrame:
    """K-0: the first reason against each capture, null for a valid one."""
    reason = (
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty_content")
        .when(F.length("content") > 16000, "too_many_characters")
        .when(F.octet_length("content") > 32768, "too_many_bytes")
        .when(~F.col("namespace").rlike(NAMESPACE), "bad_namespace")
        .when(F.col("event_at") > now, "future_event")
        .when(~F.col("importance").between(1, 10), "bad_importance")
    )
    return df.withColumn("reason", reason)
