"""Joins between planes (J-1 to J-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import infer_namespace
from memlake.sources.scratch import ensure_checkpoint_dir

#: Chains are followed for 2**DOUBLINGS hops at most.
DOUBLINGS = 6


def committed_view(points: DataFrame, payload: list[str]) -> DataFrame:
    """J-1: each anchor with the payload of the content row that its ``live_point`` names, in
    the same namespace and of the same object; the anchor's own values win. Anchors whose
    pointer dangles or names another object are dropped; rows without a kind pass through."""
    anchors = points.filter("point_kind = 'anchor'").alias("a")
    content = points.filter("point_kind = 'content'").select("point_id", "namespace", "object_id", *(F.col(c).alias(f"live_{c}") for c in payload)).alias("c")
    joined = anchors.join(content, (F.col("a.live_point") == F.col("c.point_id")) & (F.col("a.namespace") == F.col("c.namespace")) & (F.col("a.object_id") == F.col("c.object_id")))
    live = joined.select(*(F.coalesce(f"a.{c}", f"c.live_{c}").alias(c) if c in payload else F.col(f"a.{c}") for c in points.columns))
    return live.unionByName(points.filter("point_kind is null"))


def committed_chunks(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """J-2: chunks of each head's committed generation and owner."""
    pair = heads.filter("committed_generation is not null and committed_owner is not null").select("artifact_id", F.col("committed_generation").alias("generation"), F.col("committed_owner").alias("owner_token"))
    return chunks.join(pair, ["artifact_id", "generation", "owner_token"])


def successor_paths(df: DataFrame) -> DataFrame:
    """(object_id, path): up to 64 successors in order; a dangling pointer ends the path.

    Each round joins every path with the path of its last row, so paths double: six joins
    serve all rows, not one per hop. A round is checkpointed, for the next one reads it twice;
    the loop ends when no path grows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ids = df.select(F.col("object_id").alias("next"))
    first = df.filter("superseded_by is not null").select("object_id", F.col("superseded_by").alias("next")).join(ids, "next", "left_semi")
    paths = first.select("object_id", F.array("next").alias("path")).checkpoint()
    for _ in range(DOUBLINGS):
        more = paths.select(F.col("object_id").alias("last"), F.col("path").alias("more"))
        joined = paths.withColumn("last", F.element_at("path", -1)).join(more, "last", "left")
        grown = joined.select("object_id", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.col("more").isNotNull().alias("grew")).checkpoint()
        paths = grown.drop("grew")
        if grown.filter("grew").isEmpty():
            break
    return paths.select("object_id", F.slice("path", 1, 2**DOUBLINGS).alias("path"))


def supersession_tip(df: DataFrame) -> DataFrame:
    """J-4: (object_id, tip, hops) for every row; its own tip if nothing supersedes it."""
    paths = successor_paths(df)
    return df.select("object_id").join(paths, "object_id", "left").select("object_id", F.coalesce(F.element_at("path", -1), "object_id").alias("tip"), F.coalesce(F.size("path"), F.lit(0)).alias("hops"))


def supersession_cycle(df: DataFrame, proposed: DataFrame) -> DataFrame:
    """J-5: proposed edges (object_id, target) with ``cyclic``: whether the chain from the
    target leads back to the object. A loop that the object isn't on does not count."""
    paths = successor_paths(df).select(F.col("object_id").alias("target"), "path")
    cyclic = (F.col("object_id") == F.col("target")) | F.coalesce(F.array_contains("path", F.col("object_id")), F.lit(False))
    return proposed.join(paths, "target", "left").select("object_id", "target", cyclic.alias("cyclic"))


def unreferenced_artifacts(artifacts: DataFrame, memories: DataFrame, now: float, days: int = 180) -> DataFrame:
    """J-6: matured artifacts over the age that no memory of any state names as support."""
    named = memories.select(F.explode("supported_by").alias("object_id"))
    return artifacts.filter((F.col("state") == "matured") & (F.col("created_epoch") < now - days * 86400)).join(named, "object_id", "left_anti")


def ghost_rows(curated: DataFrame, files: DataFrame) -> DataFrame:
    """J-7: live notes whose file is gone, in the namespace that their path stands for."""
    path = F.replace(F.col("vault_path"), F.lit("\\"), F.lit("/"))
    live = curated.filter("state = 'matured'").withColumn("path", path)
    return live.filter(F.col("namespace") == infer_namespace(F.col("path"))).join(files.select("path"), "path", "left_anti")


def drifted_files(files: DataFrame, curated: DataFrame) -> DataFrame:
    """J-8: files whose hash is not the one stored for their path."""
    stored = curated.select(F.col("vault_path").alias("path"), F.col("body_hash").alias("stored_hash"))
    return files.join(stored, "path", "left").filter(~F.col("file_hash").eqNullSafe(F.col("stored_hash")))


def suppress_echo(changes: DataFrame, writes: DataFrame) -> DataFrame:
    """J-9: changes that no unconsumed write of our own explains."""
    return changes.join(writes.filter("not consumed").select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def orphan_writes(changes: DataFrame, writes: DataFrame, now: float, seconds: int = 300) -> DataFrame:
    return writes.filter((~F.col("consumed")) & (F.col("written_epoch") < now - seconds)).join(changes.select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def fan_out(thoughts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """J-10: one row per thought and subscription that includes its receiver, ``all`` being an
    ordinary name."""
    wanted = subscriptions.select("subscription_id", "namespace", F.explode(F.array_distinct("includes")).alias("to_presence"))
    return thoughts.join(wanted, ["namespace", "to_presence"])


def reply_chain(thoughts: DataFrame) -> DataFrame:
    """J-11: (object_id, root, depth), following replies to any depth. A reply to a message that
    is not there is a root; messages that reply in a circle, and those below, have none.

    Each round replaces a row's pointer by that of the row it points to, so what is followed
    doubles and the rounds are few. Rows carry their last message and the depth alone.
    """
    ensure_checkpoint_dir(thoughts.sparkSession)
    ids = thoughts.select(F.col("object_id").alias("in_reply_to"))
    up = thoughts.filter("in_reply_to is not null").select("object_id", "in_reply_to").join(ids, "in_reply_to", "left_semi")
    walk = up.select("object_id", F.col("in_reply_to").alias("last"), F.lit(1).alias("depth"), F.lit(True).alias("moved")).checkpoint()
    for _ in range(walk.count().bit_length() + 1):  # after so many only circles still move
        more = walk.select(F.col("object_id").alias("last"), F.col("last").alias("further"), F.col("depth").alias("more"))
        walk = walk.join(more, "last", "left").select(
            "object_id", F.coalesce("further", "last").alias("last"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")
        ).checkpoint()
        if walk.filter("moved").isEmpty():
            break
    out = thoughts.select("object_id").join(walk, "object_id", "left")
    depth = F.coalesce(F.when(~F.col("moved"), F.col("depth")), F.when(F.col("moved").isNull(), 0))
    return out.select("object_id", F.when(F.col("moved").isNull(), F.col("object_id")).when(~F.col("moved"), F.col("last")).alias("root"), depth.alias("depth"))


def dedupe_lineage(hits: DataFrame) -> DataFrame:
    """J-12: without concepts whose promoted note, and rows whose successor, is a hit of the
    same query."""
    kept = hits.select("query_id", F.col("object_id").alias("other"))
    out = hits
    for column in ("promoted_to", "superseded_by"):
        out = out.join(kept.withColumnRenamed("other", column), ["query_id", column], "left_anti")
    return out
