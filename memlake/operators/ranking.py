"""Scoring and ranking of hits (R-1 to R-4, R-7, R-9, R-11 to R-13)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import cosine
from memlake.schemas import HALF_LIFE_DAYS, HALF_LIFE_DEFAULT_DAYS, PROVENANCE, PROVENANCE_DEFAULT, WEIGHTS


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def relevance(rerank: Column, rrf: Column, batch_max: Column) -> Column:
    """R-1a: the sigmoid of a reranker's score, else the fused score's share of the best."""
    return F.when(rerank.isNotNull(), 1 / (1 + F.exp(-rerank))).when(batch_max <= 0, F.lit(0.0)).otherwise(clamp(rrf / batch_max))


def recency(plane: Column, updated_epoch: Column, now: float) -> Column:
    """R-1b: halves with each half-life of the plane; the future counts as now."""
    days = F.coalesce(*(F.when(plane == p, F.lit(d)) for p, d in HALF_LIFE_DAYS.items()), F.lit(HALF_LIFE_DEFAULT_DAYS))
    return F.exp(-F.greatest(F.lit(now) - updated_epoch, F.lit(0.0)) / 3600 * math.log(2) / (days * 24))


def provenance(plane: Column, state: Column, default: float | None = PROVENANCE_DEFAULT) -> Column:
    """R-1c: from the fixed table."""
    return F.coalesce(*(F.when((plane == p) & (state == s), F.lit(v)) for (p, s), v in PROVENANCE.items()), F.lit(default).cast("double"))


def reinforcement(count: Column, access: Column) -> Column:
    return F.when(count > 0, F.least(F.lit(1.0), F.log1p(count) / math.log1p(20))).otherwise(F.least(F.lit(1.0), F.log1p(access) / math.log1p(100)))


def score_hits(hits: DataFrame, now: float, batch_max: Column | None = None, few_queries: bool = False) -> DataFrame:
    """R-1: relevance, recency, importance, provenance and reinforcement, each in [0, 1], and
    their weighted sum; the batch is the query unless ``batch_max`` says otherwise. The query's
    best is summed up before the shuffle and joined, so no task sorts all matches of a query. With
    ``few_queries``, a fixed number, the bests go to every task: hits of one query don't meet in one."""
    if batch_max is None:
        tops = hits.groupBy("query_id").agg(F.max("rrf_score").alias("batch_max"))
        hits, batch_max = hits.join(F.broadcast(tops) if few_queries else tops, "query_id"), F.col("batch_max")
    best = batch_max
    parts = {
        "relevance": relevance(F.col("rerank_score"), F.col("rrf_score"), best), "recency": recency(F.col("plane"), F.col("updated_epoch"), now), "importance_part": clamp(F.col("importance"), 1, 10) / 10,
        "provenance": provenance(F.col("plane"), F.col("state")), "reinforce": reinforcement(F.col("reinforcement_count"), F.col("access_count")),
    }
    total = sum((w * clamp(F.col(p)) for w, p in zip(WEIGHTS, parts)), F.lit(0.0))
    return hits.withColumns(parts).withColumn("score", F.round(total, 12)).drop("batch_max")


def rank_hits(scored: DataFrame) -> DataFrame:
    """R-2: by score, then object_id, then plane."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "object_id", "plane")))


def calibrate(hits: DataFrame) -> DataFrame:
    """R-3: relevance anew against the best fused score over all legs of the query."""
    best = F.max("rrf_score").over(Window.partitionBy("query_id"))
    new = F.when(F.col("rrf_score").isNull(), F.col("relevance")).otherwise(relevance(F.col("rerank_score"), F.col("rrf_score"), F.when(best <= 0, F.lit(1.0)).otherwise(best)))
    return hits.withColumn("calibrated", new).withColumn("score", F.round(F.col("score") + WEIGHTS[0] * (F.col("calibrated") - F.col("relevance")), 12)).withColumn("relevance", F.col("calibrated")).drop("calibrated")


def merge_cross_plane(hits: DataFrame, limit: int) -> DataFrame:
    """R-4: calibrated, then one row per id (the best; of equal ones the smaller plane name)."""
    one = Window.partitionBy("query_id", "object_id").orderBy(F.desc("score"), "plane")
    best = calibrate(hits).withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")
    return rank_hits(best).filter(F.col("rank") <= limit)


def rerank(hits: DataFrame, scorer, top_k: int, few: int = 5) -> DataFrame:
    """R-7: by ``scorer(query_text, text)``; queries with ``few`` candidates or less stay as
    they are, and rows without a score go last by fused score. The text is the title, a blank
    line and the first 2048 characters."""
    text = F.concat_ws("\n\n", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")), F.substring("content", 1, 2048))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    scored = hits.withColumn("rerank_score", F.when(n > few, scorer(F.col("query_text"), text)))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc("rrf_score"), "object_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def recent_retrieve(queries: DataFrame, rows: DataFrame, states: tuple[str, ...], most: int = 50) -> DataFrame:
    """R-9: per query the newest rows of its namespace since a time, with all its tags."""
    q = queries.select("query_id", "namespace", "since", F.col("tags").alias("wanted"), F.least("limit", F.lit(most)).alias("limit"))
    hit = rows.filter(F.col("state").isin(*states)).join(q, "namespace").filter((F.col("created_epoch") >= F.col("since")) & (F.size(F.array_except("wanted", "tags")) == 0))
    out = hit.withColumn("score", F.coalesce("created_epoch", F.lit(0.0)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "object_id")))
    return out.filter(F.col("rank") <= F.col("limit")).withColumn("provenance", provenance(F.col("plane"), F.col("state"), None))


def content_hash() -> Column:
    """What texts have in common whose first 300 characters agree."""
    return F.sha2(F.substring("content", 1, 300), 256)


def content_dedup(hits: DataFrame) -> DataFrame:
    """R-11, hash part: of hits whose first 300 characters agree, the one of the best source
    (curated, concept, matured, provisional), then the best score, then object_id. Hits may have their
    ``content_hash`` instead of their texts."""
    hits = hits if "content_hash" in hits.columns else hits.withColumn("content_hash", content_hash())
    source = F.when(F.col("plane") == "curated", 4).when(F.col("plane") == "concept", 3).when(F.col("state") == "matured", 2).when(F.col("state") == "provisional", 1).otherwise(0)
    w = Window.partitionBy("query_id", "content_hash").orderBy(F.desc(source), F.desc("score"), "object_id")
    return hits.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def thought_history(asked: DataFrame, thoughts: DataFrame, by_similarity: bool = False) -> DataFrame:
    """R-12: (query_id, place, and the thought): for each row of ``asked`` (query_id, namespace, channel,
    presence, min_importance, in_reply_to, limit; null where anything does) the thoughts of its
    namespace that meet it, newest first; or by the
    cosine of the ``vector`` of both, those without one last. ``presence`` is sender or receiver."""
    t = thoughts.alias("t")
    q = asked.withColumnRenamed("namespace", "wanted_namespace").alias("q")
    meets = F.col("t.namespace") == F.col("q.wanted_namespace")
    met = t.join(q, meets).filter(
        (F.col("q.channel").isNull() | (F.col("q.channel") == F.col("t.channel"))) & (F.col("q.min_importance").isNull() | (F.col("t.importance") >= F.col("q.min_importance")))
        & (F.col("q.presence").isNull() | (F.col("q.presence") == F.col("t.from_presence")) | (F.col("q.presence") == F.col("t.to_presence")))
        & (F.col("q.in_reply_to").isNull() | (F.col("q.in_reply_to") == F.col("t.in_reply_to")))
    )
    order = [F.desc_nulls_last("similarity")] if by_similarity else []
    score = {"similarity": F.round(cosine(F.col("q.vector"), F.col("t.vector")), 9)} if by_similarity else {}
    out = met.select("q.query_id", F.col("q.limit").alias("most"), "t.*", *(c.alias(n) for n, c in score.items()))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, F.desc("created_epoch"), "object_id"))
    return out.withColumn("place", place).filter(F.col("most").isNull() | (F.col("place") <= F.col("most"))).drop("most")


def unread_thoughts(thoughts: DataFrame, me: str) -> DataFrame:
    """R-13: sent to me or all, not by me, and not read by me."""
    return thoughts.filter(F.col("to_presence").isin(me, "all") & ~F.array_contains("read_by", me) & (F.col("from_presence") != me))


def merge_best(hits: DataFrame, limit: int) -> DataFrame:
    """The best hit of each id, ranked, without a new calibration."""
    one = Window.partitionBy("query_id", "object_id").orderBy(F.desc("score"), "plane")
    return rank_hits(hits.withColumn("k", F.row_number().over(one)).filter("k = 1").drop("k")).filter(F.col("rank") <= limit)


def fuzzy_dedup(hits: DataFrame, tags_threshold: float = 0.5, cosine_threshold: float = 0.92) -> DataFrame:
    """R-11, deep mode: (query_id, object_id) of the hits that stay when, after ``content_dedup``,
    a hit also goes if an earlier kept one of its query is alike in tags (Jaccard) and in its
    vector (cosine). Earlier is the better source, then score, then object_id. A query's hits
    are a page of retrieval, so a group is small."""
    kept = content_dedup(hits).withColumn("source", F.when(F.col("plane") == "curated", 4).when(F.col("plane") == "concept", 3).when(F.col("state") == "matured", 2).when(F.col("state") == "provisional", 1).otherwise(0))

    def lead(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "score", "object_id"], ascending=[False, False, True])
        leaders: list[tuple[set, np.ndarray, str]] = []
        for tags, vector, object_id in zip(rows.tags, rows.vector, rows.object_id):
            t, v = set(tags), np.asarray(vector, float)
            n = np.linalg.norm(v)
            v = v / n if n else v
            if not any((1.0 if not t | o else len(t & o) / len(t | o)) >= tags_threshold and float(v @ w) >= cosine_threshold for o, w, _ in leaders):
                leaders.append((t, v, object_id))
        return pd.DataFrame({"query_id": key[0], "object_id": [x for _, _, x in leaders]})

    return kept.select("query_id", "object_id", "source", "score", "tags", "vector").groupBy("query_id").applyInPandas(lead, "query_id long, object_id string")
