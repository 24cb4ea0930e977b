"""Retrieval of whole batches of queries (R-5, R-6, R-8, R-10) and of memory text (entry)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import ranking as r, similarity as v
from memlake.operators.filters import holds_at, visible_states
from memlake.operators.joins import dedupe_lineage
from memlake.operators.lineage import hydrate_lineage
from memlake.sources.scratch import ensure_checkpoint_dir, stored


#: Columns that say whether a row is shown.
VISIBLE = ("plane", "state", "valid_from_epoch", "valid_until_epoch")


def _shown(mode: str, now: float | None) -> Column:
    visible = F.col("state").isin(*visible_states(mode))
    return visible if now is None else visible & ((F.col("plane") != "curated") | holds_at(now))


def _best_found() -> Column:
    """The best fused score of a query, over the few hits that a search leaves it."""
    return F.max("rrf_score").over(Window.partitionBy("query_id"))


def hybrid_search(queries: DataFrame, terms: DataFrame, rows: DataFrame, postings: DataFrame, limit: int, prefetch: int = 50, mode: str = "fast", now: float | None = None) -> DataFrame:
    """R-5: dense and sparse channels over visible rows, fused; ``limit`` hits per query.

    States and, with ``now``, the validity of curated rows are filtered before the channels, so a
    query never runs short of rows that it may show. Rows without a vector compete in the sparse
    channel alone. ``terms`` and ``postings`` hold the sparse vectors of queries and rows (V-3).
    Postings that have the columns of VISIBLE are filtered by these, others by the rows that are shown.
    """
    visible = _shown(mode, now)
    shown = rows.filter(visible)
    dense = v.dense_topk(queries, shown.filter("vector is not null"), prefetch)
    carried = {*VISIBLE} <= {*postings.columns}
    sparse = v.sparse_topk(terms, postings.filter(visible) if carried else postings.join(shown.select("object_id"), "object_id", "left_semi"), prefetch)
    fused = v.rrf([dense, sparse])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "object_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fast_retrieve(queries: DataFrame, terms: DataFrame, rows: DataFrame, postings: DataFrame, limit: int, now: float) -> DataFrame:
    """R-6: hybrid search with a prefetch of max(20, 2 * limit), scored and ranked."""
    found = hybrid_search(queries, terms, rows, postings, 2 * limit, max(20, 2 * limit), now=now).select("query_id", "object_id", "rrf_score")
    hits = found.join(rows.drop("vector"), "object_id").withColumn("rerank_score", F.lit(None).cast("double"))
    return r.rank_hits(r.score_hits(hits, now, _best_found())).filter(F.col("rank") <= limit)


def deep_retrieve(
    queries: DataFrame, terms: DataFrame, rows: DataFrame, postings: DataFrame, limit: int, now: float, scorer, lineage: dict[str, DataFrame] | None = None
) -> DataFrame:
    """R-8: hybrid search at twice the limit, reranked by ``scorer``, scored and ranked, with the
    lineage (J-3) of the hits where ``lineage`` gives the planes."""
    found = hybrid_search(queries, terms, rows, postings, 2 * limit, now=now).select("query_id", "object_id", "rrf_score")
    hits = found.join(rows.drop("vector"), "object_id").join(queries.select("query_id", "query_text"), "query_id")
    reranked = r.rerank(hits, scorer, 2 * limit).drop("rank")
    ranked = r.rank_hits(r.score_hits(reranked, now, _best_found())).filter(F.col("rank") <= limit)
    return hydrate_lineage(ranked, lineage) if lineage else ranked


def _leg(plane: str) -> Callable[[Column], Column]:
    return lambda namespace: F.struct(F.lit(plane).alias("plane"), namespace.alias("namespace"))


def expand_namespaces(queries: DataFrame, planes: tuple[str, ...], presences: tuple[str, ...]) -> DataFrame:
    """R-10: (query_id, plane, namespace), the legs of a query's namespace. ``tenant/blended`` stands
    for the tenant's shared namespace of each plane and, of memories, for those of the presences;
    any other name for the planes' namespaces beside it."""
    parts = F.split("namespace", "/")
    base = F.when(F.size(parts) >= 3, F.concat_ws("/", parts[0], parts[1])).otherwise(F.col("namespace"))
    legs = []
    for plane in planes:
        of = presences if plane == "episodic" else ("_shared",)
        blended = F.array(*(F.concat_ws("/", parts[0], F.lit(p), F.lit(plane)) for p in of))
        beside = F.array(F.concat_ws("/", base, F.lit(plane)))
        found = F.when(F.col("namespace").endswith("/blended"), blended).otherwise(beside)
        legs.append(F.transform(found, _leg(plane)))
    return queries.select("query_id", F.explode(F.flatten(F.array(*legs))).alias("leg")).select("query_id", "leg.plane", "leg.namespace")


def blended_retrieve(legs: list[DataFrame], limit: int) -> DataFrame:
    """R-10: the best 2 * limit scored hits of each leg as one list: content and lineage duplicates
    dropped, the best of each id, ranked."""
    every = None
    for leg in legs:
        best = r.rank_hits(leg).filter(F.col("rank") <= 2 * limit).drop("rank")
        every = best if every is None else every.unionByName(best, allowMissingColumns=True)
    kept = dedupe_lineage(r.content_dedup(every))
    return r.merge_best(kept, limit)


def blended_search(
    queries: DataFrame, terms: DataFrame, rows: DataFrame, postings: DataFrame, planes: tuple[str, ...], presences: tuple[str, ...], limit: int, now: float, deep: bool = False, texts: bool = True
) -> DataFrame:
    """R-10 from namespaces to a ranked list, for all queries in one job.

    Each query (query_id, namespace, vector; terms and weights) is asked in every leg of its
    namespace, as a query of its own: twice ``limit`` hits, scored within the leg. A query's legs are then one list
    without duplicates of content, in deep mode (``deep``) also of tags and vectors (R-11), and of
    lineage (J-12, by ``promoted_to`` and ``superseded_by``), and the best ``limit`` stay. The rows that
    are shown are stored first, as each channel and the hits read them; without their texts, of which
    duplicates need only the hash. The hits that stay get theirs, and a vector, unless ``texts`` is false.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    contents = rows.select("object_id", "content")
    rows = rows.filter(_shown("fast", now))
    rows = stored((rows if "content_hash" in rows.columns else rows.withColumn("content_hash", r.content_hash())).drop("content"))
    legs = expand_namespaces(queries, planes, presences).withColumn("leg_id", F.xxhash64("query_id", "plane", "namespace")).checkpoint()
    of = legs.select("query_id", "leg_id", "namespace")
    asked = stored(queries.drop("namespace").join(of, "query_id").select(F.col("leg_id").alias("query_id"), "namespace", "vector"))
    words = terms.select("query_id", "terms", "weights").join(of, "query_id").select(F.col("leg_id").alias("query_id"), "namespace", "terms", "weights")
    found = hybrid_search(asked, words, rows, postings, 2 * limit, max(20, 4 * limit), now=now).select("query_id", "object_id", "rrf_score")
    hits = found.join(rows if deep or texts else rows.drop("vector"), "object_id").withColumn("rerank_score", F.lit(None).cast("double"))
    scored = r.score_hits(hits, now, _best_found()).withColumnRenamed("query_id", "leg_id").join(of.select("leg_id", "query_id"), "leg_id").checkpoint()
    kept = r.content_dedup(scored)
    if deep:
        kept = kept.join(r.fuzzy_dedup(scored), ["query_id", "object_id"], "left_semi")
    best = r.merge_best(dedupe_lineage(kept), limit)
    return best.join(contents, "object_id") if texts else best


def lexical_top(queries: DataFrame, rows: DataFrame, now: float, k: int = 10) -> DataFrame:
    """Text queries against visible memories: BM25, scored with recency, importance, provenance
    and reinforcement, the best k per query."""
    ensure_checkpoint_dir(rows.sparkSession)
    matched = v.bm25(queries, rows.select("object_id", "tokens")).withColumn("rrf_score", F.round("bm25", 9)).checkpoint()  # read again for each query's best
    hits = matched.join(rows.drop("tokens"), "object_id").withColumn("rerank_score", F.lit(None).cast("double"))
    return r.rank_hits(r.score_hits(hits, now)).filter(F.col("rank") <= k)
