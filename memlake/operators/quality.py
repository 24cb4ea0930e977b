"""Integrity audit (Q-1 to Q-5) and retrieval metrics (E-1 to E-9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.nearest import dense_topk
from memlake.schemas import ALLOWED_STATES, METRIC_FLOORS, TRANSITIONS


Rule = tuple[str, Column, str]
_HEX = "^[0-9a-f]{64}$"


def invariants(plane: str) -> dict[str, Rule]:
    """What a good row of a plane meets: by name, the column concerned, the condition and what is
    said of a row that fails it."""
    own = {c: F.col(c) for c in ("state", "version", "importance", "updated_epoch", "created_epoch")}
    out: dict[str, Rule] = {}
    if plane in ALLOWED_STATES:
        out["state"] = ("state", own["state"].isin(*ALLOWED_STATES[plane]), f"no state of the plane {plane}")
        out["version"] = ("version", own["version"] >= 1, "below 1")
    if plane in ("episodic", "curated", "concept", "artifact"):
        out["updated_epoch"] = ("updated_epoch", own["updated_epoch"] >= own["created_epoch"], "before created_epoch")
    if plane in ("episodic", "curated", "concept", "thought"):
        out["importance"] = ("importance", own["importance"].between(1, 10), "not in 1 to 10")
        out["content"] = ("content", F.length("content") > 0, "empty")
    if plane == "episodic":
        out["superseded_by"] = ("superseded_by", F.col("superseded_by").isNull() | (F.col("superseded_by") != F.col("object_id")), "names the row itself")
    if plane in ("episodic", "curated"):
        open_ = F.col("valid_until_epoch").isNull() | F.col("valid_from_epoch").isNull()
        out["valid_until"] = ("valid_until_epoch", open_ | (F.col("valid_until_epoch") >= F.col("valid_from_epoch")), "before valid_from_epoch")
    if plane == "curated":
        out["body_hash"] = ("body_hash", F.col("body_hash").rlike(_HEX), "not 64 hexadecimal digits")
    if plane == "concept":
        out["promoted_to"] = ("promoted_to", (own["state"] != "promoted") | F.col("promoted_to").isNotNull(), "absent though promoted")
        out["merged_from"] = ("merged_from", F.size("merged_from") >= 3, "fewer than three")
    if plane == "artifact":
        out["sha256"] = ("sha256", F.col("sha256").rlike(_HEX), "not 64 hexadecimal digits")
        out["size_bytes"] = ("size_bytes", F.col("size_bytes") >= 0, "negative")
        out["failure_reason"] = ("failure_reason", (F.col("artifact_state") != "failed") | F.col("failure_reason").isNotNull(), "absent though failed")
        out["chunk_count"] = ("chunk_count", (F.col("artifact_state") != "indexed") | (F.coalesce("chunk_count", F.lit(0)) >= 1), "none though indexed")
    if plane == "artifact_chunks":
        out["chunk_index"] = ("chunk_index", F.col("chunk_index") >= 0, "negative")
        out["end_offset"] = ("end_offset", F.col("end_offset") >= F.col("start_offset"), "before start_offset")
    if plane == "thought":
        out["from_presence"] = ("from_presence", F.length("from_presence") > 0, "empty")
        out["to_presence"] = ("to_presence", F.length("to_presence") > 0, "empty")
    if plane == "lifecycle_events":
        legal = [f"{kind}:{old}:{new}" for kind, table in TRANSITIONS.items() for old, states in table.items() for new in states]
        out["to_state"] = ("to_state", F.concat_ws(":", "object_type", "from_state", "to_state").isin(*legal), "no legal transition")
        out["reason"] = ("reason", F.length("reason") > 0, "empty")
    return out


#: Columns that may be null in a good row.
OPTIONAL = ("superseded_by", "valid_until_epoch", "promoted_to", "failure_reason", "chunk_count")


def validate_rows(rows: DataFrame, plane: str, checks: dict[str, Rule] | None = None) -> DataFrame:
    """Q-1: (plane, namespace, object_id, loc, type, message): a row per violation, of type
    ``missing`` where the value is null and may not be, else ``invalid``."""
    problems = []
    for name, (column, ok, message) in (checks or invariants(plane)).items():
        missing = F.lit(False) if column in OPTIONAL else F.col(column).isNull()
        said = F.struct(F.lit(name).alias("loc"), F.when(missing, "missing").otherwise("invalid").alias("type"), F.when(missing, "is null").otherwise(message).alias("message"))
        problems.append(F.when(~F.coalesce(ok, F.lit(False)), said))
    found = F.explode(F.array_compact(F.array(*problems))).alias("problem")
    return rows.select(F.lit(plane).alias("plane"), "namespace", "object_id", found).select("plane", "namespace", "object_id", "problem.*")


def validate_planes(planes: dict[str, DataFrame]) -> DataFrame:
    """Q-1 over all planes that there are."""
    found = [validate_rows(rows, plane) for plane, rows in planes.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def audit_pointers(points: DataFrame) -> DataFrame:
    """Q-2: the first problem of each anchor's pointer."""
    content = points.filter("point_kind = 'content'").select(F.col("point_id").alias("live_point"), F.col("object_id").alias("live_object"), F.col("namespace").alias("live_namespace"), F.col("generation").alias("live_generation"), F.col("state").alias("live_state"))
    problem = (
        F.when(F.col("live_object").isNull(), "dangling_live_point").when((F.col("live_object") != F.col("object_id")) | (F.col("live_namespace") != F.col("namespace")), "pointer_identity_mismatch")
        .when(~F.col("generation").eqNullSafe(F.col("live_generation")), "pointer_generation_mismatch").when(F.col("live_state") != F.col("state"), "projection_divergence")
    )
    return points.filter("point_kind = 'anchor'").join(content, "live_point", "left").select("point_id", "object_id", problem.alias("problem")).filter("problem is not null")


def unreferenced_content(points: DataFrame) -> DataFrame:
    """Q-3: content rows that no anchor names."""
    named = points.filter("point_kind = 'anchor'").select(F.col("live_point").alias("point_id"))
    return points.filter("point_kind = 'content'").join(named, "point_id", "left_anti")


def audit_retractions(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Q-4: the first problem of each retraction's evidence (original digest and bytes, kept and
    omitted bytes) against the row and the artifact that holds the original."""
    held = artifacts.select(F.col("object_id").alias("evidence_id"), F.col("sha256").alias("held_digest"), F.col("size_bytes").alias("held_bytes"))
    problem = (
        F.when(F.col("held_digest").isNull(), "evidence_missing").when(F.col("held_digest") != F.col("original_digest"), "digest_mismatch")
        .when(F.col("held_bytes") != F.col("original_bytes"), "size_mismatch").when(F.col("kept_bytes") + F.col("omitted_bytes") != F.col("original_bytes"), "byte_accounting")
        .when(F.octet_length("content") < F.col("kept_bytes"), "prefix_lost")
    )
    return rows.join(held, "evidence_id", "left").select("object_id", problem.alias("problem")).filter("problem is not null")


def audit_verdict(scans: DataFrame, planes: tuple[str, ...]) -> DataFrame:
    """Q-5: (plane, scanned, problems, coverage, integrity) for every expected plane; one that
    was not scanned is never clean."""
    expected = scans.sparkSession.createDataFrame([(p,) for p in planes], "plane string")
    found = scans.groupBy("plane").agg(F.sum("scanned").alias("scanned"), F.sum("total").alias("total"), F.sum("problems").alias("problems"))
    coverage = F.when(F.col("scanned").isNull(), "incomplete").when(F.col("scanned") < F.col("total"), "partial").otherwise("full")
    integrity = F.when(F.col("problems") > 0, "broken").when(coverage == "full", "clean").otherwise("unknown")
    return expected.join(found, "plane", "left").select("plane", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.coalesce("problems", F.lit(0)).alias("problems"), coverage.alias("coverage"), integrity.alias("integrity"))


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def evaluate(queries: DataFrame, hits: DataFrame, labels: DataFrame) -> DataFrame:
    """E-1 to E-3: ndcg@10, mrr, recall@20 and p@1 of every query; one without hits scores 0."""
    ideal = labels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "object_id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= 10, _gain(F.col("grade")) / F.log2(F.col("place") + 1))).alias("ideal"), F.count_if(F.col("grade") > 0).alias("relevant"))
    graded = hits.join(labels, ["query_id", "object_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = graded.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, _gain(F.col("grade")) / F.log2(F.col("rank") + 1))).alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.count_if((F.col("grade") > 0) & (F.col("rank") <= 20)).alias("found"), F.max(F.when(F.col("rank") == 1, (F.col("grade") == 3).cast("double"))).alias("top"),
    )
    def share(top: Column, bottom: Column) -> Column:
        return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.coalesce(top, F.lit(0)) / bottom)

    return queries.join(best, "query_id", "left").join(got, "query_id", "left").select(
        "query_id", "mode", share(F.col("dcg"), F.col("ideal")).alias("ndcg_at_10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        share(F.col("found"), F.col("relevant")).alias("recall_at_20"), F.coalesce("top", F.lit(0.0)).alias("p_at_1"),
    )


METRICS = ("ndcg_at_10", "mrr", "recall_at_20", "p_at_1")


def gate_thresholds(per_query: DataFrame) -> DataFrame:
    """E-4: each mode's mean of each metric, its floor, and whether it passes; a missing or
    non-finite mean fails."""
    floors = per_query.sparkSession.createDataFrame([(m, k, v) for (m, k), v in METRIC_FLOORS.items()], "mode string, metric string, floor double")
    means = per_query.groupBy("mode").agg(*(F.avg(m).alias(m) for m in METRICS)).unpivot("mode", list(METRICS), "metric", "value")
    ok = F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)) & ~F.coalesce(F.isnan("value"), F.lit(False))
    return floors.join(means, ["mode", "metric"], "left").withColumn("passed", ok)


#: The error of a quantile's rank, as a share of the rows.
QUANTILE_ERROR = 1e-4


def compare_runs(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """E-5: by mode, drops of ndcg (over 0.02) and mrr (over 0.03) and growth of p95 latency
    (over a fifth). Quantiles come from mergeable sketches, whose ranks are off by QUANTILE_ERROR
    of the rows at most; tasks send sketches, not latencies."""

    def of(run: DataFrame, k: int) -> DataFrame:
        p95 = F.approx_percentile("latency", 0.95, round(1 / QUANTILE_ERROR))
        return run.groupBy("mode").agg(F.avg("ndcg_at_10").alias(f"n{k}"), F.avg("mrr").alias(f"m{k}"), p95.alias(f"p{k}"))

    met = of(base, 0).join(of(candidate, 1), "mode", "full_outer")
    return met.select("mode", (F.col("n0") - F.col("n1") > 0.02).alias("ndcg_drop"), (F.col("m0") - F.col("m1") > 0.03).alias("mrr_drop"), (F.col("p1") > 1.2 * F.col("p0")).alias("slower"))


#: The least ndcg@10 of a smoke query, and how far it may fall below its baseline.
SMOKE_FLOOR, SMOKE_TOLERANCE = 0.5, 0.02


def smoke_gate(queries: DataFrame, rows: DataFrame, grades: DataFrame, baseline: DataFrame) -> DataFrame:
    """E-8: (query_id, ndcg_at_10, baseline, passed): each query's rows by inner product, judged by
    their grades. A query passes from SMOKE_FLOOR on, if its baseline (query_id, ndcg), where it
    has one, is finite and no more than SMOKE_TOLERANCE above."""
    hits = dense_topk(queries, rows, 10, cosine=False)
    per_query = evaluate(queries.select("query_id").withColumn("mode", F.lit("smoke")), hits, grades)
    ndcg, base = F.col("ndcg_at_10"), F.col("baseline")
    sound = base.isNull() | (~F.isnan(base) & (F.abs(base) != float("inf")) & (ndcg >= base - SMOKE_TOLERANCE))
    out = per_query.join(baseline.select("query_id", F.col("ndcg").alias("baseline")), "query_id", "left")
    return out.select("query_id", "ndcg_at_10", "baseline", ((ndcg >= SMOKE_FLOOR) & sound).alias("passed"))


def lost_top_hits(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """E-5: queries whose first hit is not among the candidate run's first ten."""
    return base.filter("rank = 1").select("query_id", "object_id").join(candidate.filter("rank <= 10").select("query_id", "object_id"), ["query_id", "object_id"], "left_anti")


def metric_delta(base: DataFrame, candidate: DataFrame, floor: float = 0.02) -> DataFrame:
    """E-6: the gain in mean ndcg@10, and whether it reaches the floor."""
    both = base.select("query_id", F.col("ndcg_at_10").alias("b")).join(candidate.select("query_id", F.col("ndcg_at_10").alias("c")), "query_id")
    return both.agg(F.avg(F.col("c") - F.col("b")).alias("delta")).withColumn("passed", F.col("delta") >= floor)


def abstention_rates(hits: DataFrame, threshold: float) -> DataFrame:
    """E-7: noise scored at the threshold or above, and answerable hits below it; 0 on none."""
    high = (F.col("score") >= threshold).cast("double")
    return hits.agg(F.coalesce(F.avg(F.when(F.col("noise"), high)), F.lit(0.0)).alias("false_positive_rate"), F.coalesce(F.avg(F.when(~F.col("noise"), 1 - high)), F.lit(0.0)).alias("false_negative_rate"))


def penalize_contradictions(hits: DataFrame, pairs: DataFrame, penalty: float) -> DataFrame:
    """E-9: both sides of a contradiction that a query returns lose ``penalty``; ranked again."""
    one = hits.select("query_id", F.col("object_id").alias("a"))
    two = hits.select("query_id", F.col("object_id").alias("b"))
    met = pairs.join(one, "a").join(two, ["query_id", "b"])
    marked = met.select("query_id", F.explode(F.array("a", "b")).alias("object_id")).distinct().withColumn("marked", F.lit(True))
    out = hits.join(marked, ["query_id", "object_id"], "left").withColumn("score", F.col("score") - F.when(F.col("marked"), F.lit(penalty)).otherwise(F.lit(0.0)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "object_id"))).drop("marked")


def recalled(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """E-9: whether each query returns its wanted id."""
    return wanted.join(hits.select("query_id", "object_id", F.lit(True).alias("hit")), ["query_id", "object_id"], "left").select("query_id", "object_id", F.coalesce("hit", F.lit(False)).alias("recalled"))
