"""Merges, aggregations and reports (A-1 to A-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Planes whose rows count how often they are delivered.
ACCESSED_PLANES = ("episodic", "concept", "curated")


def merge_duplicates(df: DataFrame, keys: list[str], now: float) -> DataFrame:
    """A-1: one row per key: the first row's id and creation, the longest content (the earlier
    of equal lengths), all tags, and one reinforcement and version per merged row."""
    first = F.struct("created_epoch", "object_id")
    return df.groupBy(*keys).agg(
        F.min_by("object_id", first).alias("object_id"), F.min("created_epoch").alias("created_epoch"),
        F.max_by("content", F.struct(F.length("content"), -F.col("created_epoch"))).alias("content"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        (F.min_by("reinforcement_count", first) + F.count(F.lit(1)) - 1).alias("reinforcement_count"), F.count(F.lit(1)).alias("version"),
        F.when(F.count(F.lit(1)) > 1, F.lit(now)).otherwise(F.min("created_epoch")).alias("updated_epoch"),
    )


def merge_into(existing: DataFrame, new: DataFrame, keys: list[str], now: float) -> DataFrame:
    """A-1 against rows that are there: the existing row's id and creation stay, its content if it is
    no shorter, and each new row counts once in reinforcement and version. ``new`` has been through
    ``merge_duplicates``; ``existing`` has one row per key."""
    columns = ["object_id", "created_epoch", "content", "tags", "reinforcement_count", "version", "updated_epoch"]
    e = existing.select(*keys, F.struct(*columns).alias("e"))
    n = new.select(*keys, F.struct(*columns).alias("n"))
    both = F.col("e").isNotNull() & F.col("n").isNotNull()
    longer = F.length("n.content") > F.length("e.content")
    joined = {
        "content": F.when(longer, F.col("n.content")).otherwise(F.col("e.content")), "tags": F.array_sort(F.array_union("e.tags", "n.tags")),
        "reinforcement_count": F.col("e.reinforcement_count") + F.col("n.version"), "version": F.col("e.version") + F.col("n.version"), "updated_epoch": F.lit(now),
    }
    either = {c: F.coalesce(f"e.{c}", f"n.{c}") for c in columns}
    same = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    met = e.alias("l").join(n.alias("r"), same, "full_outer").select(*(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), "e", "n")
    return met.select(*keys, *(F.when(both, joined[c]).otherwise(either[c]).alias(c) if c in joined else either[c].alias(c) for c in columns))


def upsert_curated(new: DataFrame, existing: DataFrame) -> DataFrame:
    """A-2: what to do for each (namespace, vault_path): noop, update, supersede, insert, or
    keep where nothing new came; with the id, hash and version that result. Two notes without a
    text, whose hashes are null, are the same."""
    key = ["namespace", "vault_path"]
    n = new.select(*key, F.col("object_id").alias("new_id"), F.col("body_hash").alias("new_hash"))
    e = existing.select(*key, F.col("object_id").alias("old_id"), F.col("body_hash").alias("old_hash"), F.col("version").alias("old_version"))
    action = (
        F.when(F.col("new_id").isNull(), "keep").when(F.col("old_id").isNull(), "insert").when(F.col("new_hash").eqNullSafe(F.col("old_hash")), "noop")
        .when(F.col("new_id") == F.col("old_id"), "update").otherwise("supersede")
    )
    kept = F.col("action").isin("keep", "noop")
    return n.join(e, key, "full_outer").withColumn("action", action).select(
        *key, "action", F.when(kept, F.col("old_id")).otherwise(F.col("new_id")).alias("object_id"), F.when(kept, F.col("old_hash")).otherwise(F.col("new_hash")).alias("body_hash"),
        F.when(kept, F.col("old_version")).when(F.col("action") == "update", F.col("old_version") + 1).otherwise(F.lit(1)).alias("version"),
        F.when(F.col("action") == "supersede", F.col("old_id")).alias("supersedes"),
    )


def merge_planes(planes: dict[str, DataFrame]) -> DataFrame:
    """A-13: rows of several planes, tagged, columns that one lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("plane", F.lit(name)) for name, df in planes.items()))


def count_by_namespace(rows: DataFrame) -> DataFrame:
    """A-3: exact counts by namespace and plane."""
    return rows.groupBy("namespace", "plane").agg(F.count(F.lit(1)).alias("n"))


def count_rollup(rows: DataFrame) -> DataFrame:
    """A-3: the same with subtotals by family, plane and state."""
    return rows.rollup("identity_family", "plane", "state").agg(F.count(F.lit(1)).alias("n"))


def capture_summary(rows: DataFrame, planes: list[str], t0: float, t1: float) -> DataFrame:
    """A-4: rows created in [t0, t1) of each plane, 0 where there are none."""
    names = rows.sparkSession.createDataFrame([(p,) for p in planes], "plane string")
    counts = rows.filter((F.col("created_epoch") >= t0) & (F.col("created_epoch") < t1)).groupBy("plane").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(names).join(counts, "plane", "left").select("plane", F.coalesce("n", F.lit(0)).alias("n"))


def account_access(delivered: DataFrame, memories: DataFrame) -> DataFrame:
    """A-5: access counts of memories, concepts and notes raised once per delivery that holds the
    row, and the later of the last accesses; both tables have plane, namespace and object_id."""
    key = ["plane", "namespace", "object_id"]
    once = delivered.filter(F.col("plane").isin(*ACCESSED_PLANES)).groupBy("delivery_id", *key).agg(F.max("delivered_epoch").alias("at"))
    hits = once.groupBy(*key).agg(F.count(F.lit(1)).alias("new_times"), F.max("at").alias("new_at"))
    out = memories.join(hits, key, "left")
    raised = {"access_count": F.col("access_count") + F.coalesce("new_times", F.lit(0)), "last_accessed_epoch": F.greatest("last_accessed_epoch", "new_at")}
    return out.withColumns(raised).drop("new_times", "new_at")


def reinforce_concepts(concepts: DataFrame, evidence: DataFrame, now: float) -> DataFrame:
    """A-6: one reinforcement per source memory, its id added to those merged from."""
    found = evidence.groupBy("object_id").agg(F.count_distinct("source_id").alias("times"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    hit = F.col("times").isNotNull()
    return concepts.join(found, "object_id", "left").withColumns({
        "reinforcement_count": F.col("reinforcement_count") + F.coalesce("times", F.lit(0)), "merged_from": F.when(hit, F.array_union("merged_from", "sources")).otherwise(F.col("merged_from")),
        "last_reinforced_epoch": F.when(hit, F.lit(now)).otherwise(F.col("last_reinforced_epoch")), "version": F.col("version") + hit.cast("int"),
    }).drop("times", "sources")


def record_rejections(concepts: DataFrame, rejections: DataFrame) -> DataFrame:
    """A-7: attempts raised, with the latest reason; promoted rows and empty reasons don't count,
    and rows without a new rejection keep what they have."""
    found = rejections.filter("reason <> ''").groupBy("object_id").agg(
        F.count(F.lit(1)).alias("new_times"), F.max("rejected_epoch").alias("new_epoch"), F.max_by("reason", F.struct("rejected_epoch", "reason")).alias("new_reason")
    )
    counts = F.col("promoted_to").isNull() & F.col("new_times").isNotNull()
    before = {c: F.col(c) if c in concepts.columns else F.lit(None).cast(t) for c, t in (("rejected_epoch", found.schema["new_epoch"].dataType), ("rejected_reason", "string"))}
    return concepts.join(found, "object_id", "left").withColumns({
        "promotion_attempts": F.col("promotion_attempts") + F.when(counts, F.col("new_times")).otherwise(F.lit(0)),
        "rejected_epoch": F.when(counts, F.col("new_epoch")).otherwise(before["rejected_epoch"]),
        "rejected_reason": F.when(counts, F.col("new_reason")).otherwise(before["rejected_reason"]),
    }).drop("new_times", "new_epoch", "new_reason")


def mark_read(thoughts: DataFrame, reads: DataFrame) -> DataFrame:
    """A-8: readers added once; read is true if the receiver is among them."""
    found = reads.groupBy("object_id").agg(F.array_sort(F.collect_set("reader")).alias("readers"))
    after = F.when(F.col("readers").isNull(), F.col("read_by")).otherwise(F.array_union("read_by", "readers"))
    out = thoughts.join(found, "object_id", "left").withColumn("after", after)
    changed = (F.size("after") > F.size("read_by")).cast("int")
    return out.withColumns({"version": F.col("version") + changed, "read": F.array_contains("after", F.col("to_presence"))}).withColumn("read_by", F.col("after")).drop("after", "readers")


def link_contradictions(concepts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A-9: each contradicting pair (a, b) adds either to the other's set."""
    bad = verdicts.filter("verdict = 'contradictory'")
    both = bad.select(F.col("a").alias("object_id"), F.col("b").alias("other")).unionByName(bad.select(F.col("b").alias("object_id"), F.col("a").alias("other")))
    found = both.groupBy("object_id").agg(F.array_sort(F.collect_set("other")).alias("others"))
    out = concepts.join(found, "object_id", "left")
    return out.withColumn("contradicts", F.when(F.col("others").isNull(), F.col("contradicts")).otherwise(F.array_union("contradicts", "others"))).drop("others")


def report(rows: DataFrame, by: list[str], counts: dict[str, Column]) -> DataFrame:
    """A-10, A-11: rows that meet each condition, by group."""
    sums = [F.count_if(c).alias(name) for name, c in counts.items()]
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def patch_rows(df: DataFrame, patches: DataFrame) -> DataFrame:
    """A-12: tags merged (sorted union) or replaced, importance overwritten where given."""
    p = patches.select("object_id", F.col("tags").alias("new_tags"), "tag_mode", F.col("importance").alias("new_importance"))
    tags = F.when(F.col("new_tags").isNull(), F.col("tags")).when(F.col("tag_mode") == "replace", F.col("new_tags")).otherwise(F.array_sort(F.array_union("tags", "new_tags")))
    return df.join(p, "object_id", "left").withColumns({"tags": tags, "importance": F.coalesce("new_importance", "importance")}).drop("new_tags", "tag_mode", "new_importance")
