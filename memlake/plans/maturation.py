"""Maturation of memories with enrichment and supersession (L-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import models
from memlake.functions.text import has_supersession_hint, normalize_tags
from memlake.operators import lifecycle as l, similarity as v
from memlake.sources.scratch import ensure_checkpoint_dir

REASON, BACK_REASON = "maturation-sweep", "maturation-sweep-supersession"


def mature(
    memories: DataFrame, now: float, aliases: dict[str, str] | None = None, scorer: models.Scorer = models.keep_importance,
    inferrer: models.Inferrer = models.no_topics, threshold: float = 0.88,
) -> tuple[DataFrame, DataFrame]:
    """L-3: (memories after the sweep, its events) of all provisional rows past their hour.

    Their tags are normalised (T-1), importance and topics come from the models (K-1, K-2), and
    they mature. A row whose text says that it replaces an earlier one (T-2) supersedes the one
    matured row of its namespace that shares a topic and is similar enough (V-17), if there is
    exactly one: both rows then name each other. Of several rows that would supersede the same
    one, the first by object_id does. ``memories`` has vector, the embedding of the text without
    the hint, and superseded_by; ``supersedes`` is added where it is missing.
    """
    if "supersedes" not in memories.columns:
        memories = memories.withColumn("supersedes", F.array().cast("array<string>"))
    ensure_checkpoint_dir(memories.sparkSession)
    ripe = F.coalesce(l.to_mature(now), F.lit(False))
    chosen, others = memories.filter(ripe), memories.filter(~ripe)
    enriched = models.infer_topics(models.score_importance(chosen, scorer), inferrer).withColumn("tags", normalize_tags(F.col("tags"), aliases))
    hinted = models.infer_topics(chosen.filter(has_supersession_hint(F.col("content"))), inferrer)
    found = v.supersession_candidate(hinted, others.filter("state = 'matured'"), threshold)
    pairs = found.groupBy("candidate").agg(F.min("object_id").alias("object_id")).checkpoint()
    matured, events = l.sweep(enriched, F.lit(True), "matured", REASON, "episodic", now)
    new = matured.join(pairs, "object_id", "left").withColumn("supersedes", F.when(F.col("candidate").isNull(), F.col("supersedes")).otherwise(F.array_union("supersedes", F.array("candidate"))))
    back = pairs.select(F.col("candidate").alias("object_id"), F.col("object_id").alias("successor"))
    linked = others.join(back, "object_id", "left")
    replaced, more = l.sweep(linked, F.col("successor").isNotNull(), "superseded", BACK_REASON, "episodic", now)
    replaced = replaced.withColumn("superseded_by", F.coalesce("successor", "superseded_by"))
    return new.select(memories.columns).unionByName(replaced.select(memories.columns)), events.unionByName(more)
