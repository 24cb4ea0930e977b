"""Similarity operators (V-2 to V-18); vectors are compared in double precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.lexical import SMALL_ROWS, bm25
from memlake.operators.near_pairs import similar_pairs
from memlake.operators.nearest import dense_topk
from memlake.operators.sparse import sparse_topk
from memlake.schemas import DUPLICATE_THRESHOLDS
from memlake.sources.scratch import ensure_checkpoint_dir, stored


__all__ = ["bm25", "dense_topk", "similar_pairs", "sparse_topk"]  # of modules of their own


def if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has SMALL_ROWS rows at most; larger ones are shuffled."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def rrf(channels: list[DataFrame], k: int = 60) -> DataFrame:
    """V-4: (query_id, object_id, rrf_score): the sum of 1 / (k + rank) over channels. The union is dealt
    anew: Spark takes a union of channels dealt by query for one dealt so itself, and where a reused
    shuffle undoes that, its partitions are twice as many as the next join expects."""
    every = channels[0].select("query_id", "object_id", "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select("query_id", "object_id", "rank"))
    return every.repartition("query_id").groupBy("query_id", "object_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def components(pairs: DataFrame) -> DataFrame:
    """(group, node, label): the smallest node of each component within its group, by
    large-star and small-star steps until no edge changes."""
    ensure_checkpoint_dir(pairs.sparkSession)
    edges = pairs.select("group", F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct().checkpoint()
    mark = None
    while True:
        both = edges.unionByName(edges.select("group", F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("group", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, ["group", "u"]).filter("v > u").select("group", F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").checkpoint()
        low = large.groupBy("group", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["group", "u"]).select("group", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("group", "u", F.col("m").alias("v")))
        edges = small.filter("u != v").distinct().checkpoint()
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("group", "u", "v"))).first())
        if now == mark:
            roots = edges.select("group", F.col("v").alias("node")).distinct()
            return edges.select("group", F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("node")))
        mark = now


def clusters(pairs: DataFrame, min_size: int = 3) -> DataFrame:
    """V-8: (group, cluster, object_id): components of the pairs within each group; cluster is
    the smallest id. Components that are the same in several groups are kept for the first
    group."""
    labels = components(pairs)
    sized = labels.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("print")).filter(F.col("n") >= min_size)
    first = sized.groupBy("label", "n", "print").agg(F.min("group").alias("group"))
    return labels.join(first.select("group", "label"), ["group", "label"]).select("group", F.col("label").alias("cluster"), F.col("node").alias("object_id"))


def cluster_groups(df: DataFrame) -> DataFrame:
    """V-9: a row per group that the row belongs to: topics, else its first two tags, else one
    common group."""
    keys = F.when(F.size("topics") > 0, F.array_distinct("topics")).when(F.size("tags") > 0, F.array_distinct(F.slice("tags", 1, 2))).otherwise(F.array(F.lit("_no_tags_")))
    return df.withColumn("group", F.explode(keys))


def cap_cluster(members: DataFrame, most: int = 20) -> DataFrame:
    """V-10: the ``most`` members of each cluster by importance and id."""
    rank = F.row_number().over(Window.partitionBy("group", "cluster").orderBy(F.desc("importance"), "object_id"))
    return members.withColumn("place", rank).filter(F.col("place") <= most)


def best_match(new: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """V-11: the nearest existing row of each new one in its namespace, or null below
    the threshold: (query_id, object_id, score)."""
    top = dense_topk(new, existing, 1).filter(F.col("score") >= threshold).drop("rank")
    return new.select("query_id").join(top, "query_id", "left")


def duplicate_candidate(new: DataFrame, existing: DataFrame, plane: str, match_on: list[str]) -> DataFrame:
    """V-13: (query_id, action, object_id, score): what to do with each new row of a plane.

    The nearest live row of its namespace is a candidate from the plane's threshold on
    (DUPLICATE_THRESHOLDS; planes without one never probe). The new row is merged into it only if
    both agree in ``match_on`` (A-1's key), else it is inserted beside it.
    """
    least = DUPLICATE_THRESHOLDS.get(plane)
    if least is None:
        return new.select("query_id", F.lit("insert").alias("action"), F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("double").alias("score"))
    found = best_match(new, existing, least)
    theirs = existing.select("object_id", *(F.col(c).alias(f"their_{c}") for c in match_on))
    met = new.select("query_id", *match_on).join(found, "query_id").join(theirs, "object_id", "left")
    agrees = F.col("object_id").isNotNull()
    for c in match_on:
        agrees &= F.col(c).eqNullSafe(F.col(f"their_{c}"))
    return met.select("query_id", F.when(agrees, "merge").otherwise("insert").alias("action"), "object_id", "score")


def max_pool_sparse(postings: DataFrame) -> DataFrame:
    """V-16: the largest weight of each (object_id, term) over chunks."""
    return postings.groupBy("object_id", "term").agg(F.max("weight").alias("weight"))


def supersession_candidate(new: DataFrame, matured: DataFrame, threshold: float) -> DataFrame:
    """V-17: the only matured row of the namespace that shares a topic and is similar enough;
    none if there are several. Pairs are searched within each namespace and topic that both have."""

    def by_topic(df: DataFrame) -> DataFrame:
        return df.select("object_id", "vector", "namespace", F.explode("topics").alias("topic")).withColumn("group", F.concat_ws("\x1f", "namespace", "topic"))

    new = stored(by_topic(new))  # read for the groups, their sizes and the pairs
    old = stored(by_topic(matured).join(new.select("group").distinct(), "group", "left_semi"))
    new = new.join(old.select("group").distinct(), "group", "left_semi")
    near = similar_pairs(new, threshold, other=old).filter("a <> b")
    alone = near.groupBy(F.col("a").alias("object_id")).agg(F.min("b").alias("candidate"), F.max("b").alias("last"), F.min("cosine").alias("score"))
    return alone.filter("candidate = last").drop("last")


def cross_plane_max(legs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """V-18: each id's largest weighted score and the planes that have it."""
    weight = F.coalesce(*(F.when(F.col("plane") == p, F.lit(w)) for p, w in weights.items()), F.lit(0.0))
    return legs.groupBy("query_id", "object_id").agg(F.max(F.col("score") * weight).alias("score"), F.array_sort(F.collect_set("plane")).alias("planes"))
