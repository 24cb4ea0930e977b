"""Synthesis of concepts from memories (L-19) and retraction (L-17)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memlake.functions.models import judge_pairs
from memlake.functions.text import CLUSTER
from memlake.operators import merge as m, similarity as v
from memlake.operators.lifecycle import DAY, candidate_pool
from memlake.sources.scratch import ensure_checkpoint_dir, stored
from memlake.streaming.jobs import after_cursor

#: Bytes of a tombstone at most, and of the original in it at least.
TOMBSTONE_BYTES = 32_768
EXCERPT_BYTES = 256
POOL_TTL = 30 * DAY


#: What a caller's summariser (K-3) takes and gives: the members (object_id, content, importance) of
#: one cluster, most important first; and title, content and rationale, or None where it fails.
Summarizer = Callable[[list[tuple[str, str, int]]], tuple[str, str, str] | None]
SUMMARY = "group string, cluster string, title string, content string, rationale string, vector array<double>, importance int, merged_from array<string>"


def representative(members: list[tuple[str, str, int]]) -> tuple[str, str, str]:
    """K-3, default: the text of the most important member."""
    return members[0][1][:80], members[0][1], f"{len(members)} similar memories"


def summarize(members: DataFrame, summarizer: Summarizer = representative) -> DataFrame:
    """K-3: a row per cluster (capped, so a few rows each) that the summariser made something of;
    it has the most important member's vector. One that fails, or raises, leaves no row."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        try:
            made = summarizer(list(zip(part.object_id, part.content, part.importance.astype(int))))
        except Exception:  # a model's failure is the cluster's, which is tried again in the next run
            made = None
        rows = [(*key, *made, list(part.vector.iloc[0]), int(part.importance.iloc[0]), sorted(part.object_id))] if made else []
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SUMMARY.split(", ")])

    wanted = members.select("group", "cluster", "object_id", "content", F.col("importance").cast("int").alias("importance"), "vector", "place")
    return wanted.groupBy("group", "cluster").applyInPandas(run, SUMMARY)


def decodes() -> Column:
    """Whether a memory can take part: it has a text and a vector of finite numbers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("content").isNotNull() & F.col("vector").isNotNull() & finite, F.lit(False))


def synthesize(
    memories: DataFrame, cursors: DataFrame, pool: DataFrame, existing: DataFrame, now: float, judge: Callable[[str, str], bool],
    threshold: float = 0.70, most: int = 20, low: float = 0.75, match: float = 0.85, summarizer: Summarizer = representative,
) -> dict[str, DataFrame]:
    """L-19: clusters of similar memories, all families at once: ``concepts`` (all of them, with
    the members that they merge), ``cursors`` and ``pool`` after the run, and its ``report``.

    Memories above their family's cursor or in the pool are grouped by topic within the family,
    similar pairs linked, components of three or more capped and summarised (K-3). Memories that
    don't decode take no part and are counted; the members of a cluster that the summariser fails
    on wait in the pool, as do those beyond the cap. A cluster
    reinforces the family's nearest matured or promoted concept from ``match`` on, else it is a
    new concept. Concepts of this run with a similarity in [low, match) are judged, and those
    that contradict are linked. ``existing`` may have null vectors; these match nothing.
    """
    ensure_checkpoint_dir(memories.sparkSession)
    take = ["family", "object_id", "importance", "topics", "tags", "vector", "decodes"]
    own = {"vector": F.when(decodes(), F.col("vector")), "decodes": decodes()}
    seen = stored(memories.select("updated_epoch", *(own[c].alias(c) if c in own else c for c in take)))  # without the texts, which only members need
    new, marks = after_cursor(seen, cursors)
    waiting = seen.join(pool.select("family", "object_id"), ["family", "object_id"], "left_semi")
    every = stored(new.select(take).unionByName(waiting.select(take)).dropDuplicates(["family", "object_id"]))
    failed, chosen = every.filter("not decodes"), every.filter("decodes").drop("decodes")
    grouped = v.cluster_groups(chosen).withColumn("group", F.concat_ws("\x1f", "family", "group"))
    linked = v.clusters(v.similar_pairs(grouped.select("group", "object_id", "vector"), threshold, forest=True))
    members = stored(v.cap_cluster(linked.join(chosen.select("object_id", "family", "importance", "vector"), "object_id"), most))
    texts = memories.join(members.select("family", "object_id").distinct(), ["family", "object_id"], "left_semi").select("family", "object_id", "content")
    members = members.join(texts.dropDuplicates(["family", "object_id"]), ["family", "object_id"])
    sets = members.groupBy("family", "group", "cluster").agg(F.array_sort(F.collect_list("object_id")).alias("ids"))  # `most` at most
    nth = F.row_number().over(Window.partitionBy("family", "ids").orderBy("group", "cluster"))  # the same members by another topic
    members = members.join(sets.withColumn("nth", nth).filter("nth = 1").select("group", "cluster"), ["group", "cluster"], "left_semi")
    made = summarize(members, summarizer).withColumn("family", F.split("group", "\x1f")[0])
    made = stored(made.withColumns({"object_id": F.substring(F.sha2(F.array_join("merged_from", ","), 256), 1, 27), "query_id": F.monotonically_increasing_id()}))
    live = existing.filter(F.col("state").isin("matured", "promoted") & F.col("vector").isNotNull())
    nearest = v.best_match(made.select("query_id", F.col("family").alias("namespace"), "vector"), live.select(F.col("family").alias("namespace"), "object_id", "vector"), match)
    matched = made.join(nearest.select("query_id", F.col("object_id").alias("known")), "query_id").checkpoint()
    evidence = matched.filter("known is not null").select(F.col("known").alias("object_id"), F.explode("merged_from").alias("source_id"))
    created = matched.filter("known is null").join(existing.select("object_id"), "object_id", "left_anti").select(
        "object_id", F.concat("family", F.lit("/shared/concept")).alias("namespace"), "family", F.lit("synthesized").alias("state"), "title", "content", "rationale", "importance",
        "merged_from", "vector", F.lit(0).alias("reinforcement_count"), F.array().cast("array<string>").alias("contradicts"), F.lit(None).cast("double").alias("last_reinforced_epoch"), F.lit(1).alias("version"),
    )
    after = m.reinforce_concepts(existing, evidence, now).unionByName(created, allowMissingColumns=True)
    touched = after.join(evidence.select("object_id").unionByName(created.select("object_id")).distinct(), "object_id", "left_semi").select("family", "object_id", "content", "vector").checkpoint()
    near = v.similar_pairs(touched.withColumnRenamed("family", "group"), low, match)
    for side in ("a", "b"):
        near = near.join(touched.select(F.col("object_id").alias(side), F.col("content").alias(f"text_{side}")), side)
    verdicts = judge_pairs(near, judge).select(F.col("group").alias("family"), "a", "b", "verdict").checkpoint()
    done = matched.select("family", F.explode("merged_from").alias("object_id")).distinct()
    counted = {
        "selected": chosen, "clusters": matched, "created": created, "reinforced": matched.filter("known is not null"), "contradictions": verdicts.filter("verdict = 'contradictory'"),
        "pruned": pool.filter(F.col("first_seen") < now - POOL_TTL).join(done, ["family", "object_id"], "left_anti"), "carried": chosen.join(done, ["family", "object_id"], "left_anti"),
        "decode_failed": failed,
    }
    steps = None
    for step, rows in counted.items():
        one = rows.select("family", F.lit(step).alias("step"))
        steps = one if steps is None else steps.unionByName(one)
    return {
        "concepts": m.link_contradictions(after, verdicts), "cursors": marks, "pool": candidate_pool(pool, chosen.select("family", "object_id"), done, now, POOL_TTL),
        "report": m.report(steps, ["family"], {step: F.col("step") == step for step in counted}),
    }


@F.pandas_udf(StringType())
def _excerpt(text: pd.Series, room: pd.Series) -> pd.Series:
    """The shortest run of whole grapheme clusters with EXCERPT_BYTES (or all) of the text; null if
    it needs more than ``room`` bytes."""

    def one(content: str, most: int) -> str | None:
        need, end, size = min(len(content.encode("utf-8", "surrogatepass")), EXCERPT_BYTES), 0, 0
        for cluster in CLUSTER.finditer(content):
            if size >= need:
                break
            size += len(cluster.group().encode("utf-8", "surrogatepass"))
            end = cluster.end()
        return content[:end] if end and size <= most else None

    return pd.Series([one(x, int(m)) for x, m in zip(text, room)], dtype="object")


def _tombstone(excerpt: Column) -> Column:
    return F.concat(
        F.lit("Withdrawn on "), "asked_on", F.lit(": this memory is wrong, nothing may rest on it.\nReason: "), "because", F.lit("\nIt began:\n"), excerpt,
        F.lit("\nWhat holds instead:\n"), "truth", F.lit("\nIts whole text is kept as artifact "), "evidence_id", F.lit("."),
    )


def retract(rows: DataFrame, requests: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L-17: (rows whose content has become a tombstone with the reason, an excerpt, the corrected
    truth and the artifact's id; artifacts that keep the originals; requests that are refused).

    ``requests`` has object_id, asked_on (a date's text), because and truth. A tombstone has at
    most TOMBSTONE_BYTES bytes; a request whose prose leaves no room for the excerpt is refused.
    """
    evidence = F.substring(F.sha2(F.concat_ws("\x1f", "namespace", "object_id", F.lit("retraction")), 256), 1, 27)
    hit = rows.join(requests.select("object_id", "asked_on", "because", "truth"), "object_id").withColumn("evidence_id", evidence)
    room = F.lit(TOMBSTONE_BYTES) - F.octet_length(_tombstone(F.lit("")))
    hit = hit.withColumn("excerpt", _excerpt("content", room))
    refused = hit.filter("excerpt is null").select("object_id", F.lit("CONTENT_TOO_LARGE").alias("reason"))
    out = hit.filter("excerpt is not null").withColumns({
        "original_digest": F.sha2("content", 256), "original_bytes": F.octet_length("content"), "kept_bytes": F.octet_length("excerpt"),
        "omitted_bytes": F.octet_length("content") - F.octet_length("excerpt"),
    })
    artifacts = out.select(
        F.col("evidence_id").alias("object_id"), "content", F.col("original_digest").alias("sha256"), F.col("original_bytes").alias("size_bytes"),
        F.lit("stored_unindexed").alias("artifact_state"),
    )
    stones = out.withColumns({"content": _tombstone(F.col("excerpt")), "updated_epoch": F.lit(now)}).drop("excerpt", "asked_on", "because", "truth")
    return stones, artifacts, refused
