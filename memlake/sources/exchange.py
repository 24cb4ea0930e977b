"""Sources and sinks besides the planes: vaults, ledgers, migrations (IO-3 to IO-11)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import family_of, normalize_tags, strip

_FRONT = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """IO-3: path, frontmatter (text), body and body_hash of a folder's Markdown files; folders
    and files whose name starts with ``.`` or ``_`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    text = F.decode("content", "UTF-8")
    inside = F.regexp_replace("path", "^.*?" + root.split("://")[-1].rstrip("/").replace(".", "\\.") + "/", "")
    rows = files.select(inside.alias("path"), text.alias("text")).filter(~F.col("path").rlike("(^|/)[._]"))
    front, body = F.regexp_extract("text", _FRONT, 1), F.when(F.col("text").rlike(_FRONT), F.regexp_extract("text", _FRONT, 2)).otherwise(F.col("text"))
    stripped = strip(body)
    return rows.select("path", front.alias("frontmatter"), stripped.alias("body"), F.sha2(stripped, 256).alias("body_hash"))


def parse_frontmatter(df: DataFrame) -> DataFrame:
    """IO-3: the frontmatter's values as a map of JSON texts; a bad one gives null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        def one(text: str) -> dict | None:
            try:
                value = yaml.safe_load(text) if text else {}
            except yaml.YAMLError:
                return None
            return {str(k): v if isinstance(v, str) else json.dumps(v, default=str) for k, v in value.items()} if isinstance(value, dict) else None

        for f in frames:
            yield f[["path", "body", "body_hash"]].assign(fields=f.frontmatter.map(one))

    return df.mapInPandas(run, "path string, body string, body_hash string, fields map<string,string>")


#: The fields of a note's frontmatter, and those that are times.
TIMES = ("created_at", "updated_at", "promoted_at", "valid_from", "valid_until")
KNOWN_FIELDS = ("title", "importance", "tags", "topics", "namespace", "object_id", "state", "created_at", "updated_at", "managed", "promoted_from", "promoted_at", "valid_from", "valid_until")


def frontmatter_to_curated(df: DataFrame) -> DataFrame:
    """IO-4: curated columns from the fields, and the first reason against the file, or null."""
    f = F.col("fields")
    title = F.trim(f["title"])
    importance = F.coalesce(F.try_element_at(f, F.lit("importance")).cast("int"), F.lit(7))
    lists = {c: F.coalesce(F.from_json(F.try_element_at(f, F.lit(c)), "array<string>"), F.array().cast("array<string>")) for c in ("tags", "topics")}
    strange = F.filter(F.map_keys("fields"), lambda k: ~k.isin(*KNOWN_FIELDS))
    zoned = [F.coalesce(F.try_element_at(f, F.lit(c)), F.lit("Z")).rlike("(Z|[+-]\\d\\d:?\\d\\d)$") for c in TIMES]
    reason = (
        F.when(f.isNull(), "bad_frontmatter").when(F.array_contains(F.map_keys("fields"), "read_by"), "read_by").when(F.size(strange) > 0, "unknown_key")
        .when(~F.length(F.coalesce(title, F.lit(""))).between(1, 200), "bad_title").when(~importance.between(1, 10), "bad_importance").when(~reduce(and_, zoned), "naive_time")
    )
    return df.select("path", title.alias("title"), importance.alias("importance"), normalize_tags(lists["tags"]).alias("tags"), F.transform(lists["topics"], F.lower).alias("topics"), "body", "body_hash", reason.alias("reason"))


def _quoted(text: Column) -> Column:
    """As a JSON string, which YAML reads as it is."""
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def render_note(rows: DataFrame) -> DataFrame:
    """IO-5: (path, value): one Markdown text per row (path, object_id, title, body): the frontmatter,
    with those of namespace, state, importance, tags and topics that the rows have, and the
    stripped body, as ``read_vault`` reads it back."""
    lines = [F.concat(F.lit("object_id: "), _quoted(F.col("object_id"))), F.concat(F.lit("title: "), _quoted(F.col("title")))]
    lines += [F.concat(F.lit(f"{c}: "), _quoted(F.col(c))) for c in ("namespace", "state") if c in rows.columns]
    lines += [F.concat(F.lit("importance: "), F.col("importance").cast("string"))] if "importance" in rows.columns else []
    lines += [F.concat(F.lit(f"{c}: "), F.to_json(c)) for c in ("tags", "topics") if c in rows.columns]
    return rows.select("path", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), strip(F.col("body"))).alias("value"))


def append_events(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """IO-6: the new events that the ledger lacks, each once, with their date to partition by."""
    return new.dropDuplicates(["event_id"]).join(ledger.select("event_id"), "event_id", "left_anti").withColumn("event_date", F.to_date(F.timestamp_micros("occurred_us")))


def migrate_memories(old: DataFrame, migrated: DataFrame, namespace: str) -> DataFrame:
    """IO-8: legacy memories as matured rows; those without a creation time, and ids already
    migrated, are skipped."""
    agent = F.coalesce("agent", F.lit("legacy"))
    return old.filter("created_at is not null").join(migrated.select("id"), "id", "left_anti").select(
        F.col("id").alias("object_id"), F.lit(namespace).alias("namespace"), F.lit("matured").alias("state"), F.lit(5).alias("importance"), F.array("type").alias("topics"), "content",
        F.coalesce("context", F.concat(F.lit("migrated from "), agent)).alias("source_context"), F.to_timestamp("created_at").cast("double").alias("created_epoch"),
    )


def migration_report(old: DataFrame, migrated: DataFrame) -> DataFrame:
    """IO-8: (outcome, n): rows migrated, and those skipped, by reason."""
    known = migrated.select("id", F.lit(True).alias("known")).distinct()
    outcome = F.when(F.col("created_at").isNull(), "no creation time").when(F.col("known"), "migrated before").otherwise("migrated")
    return old.join(known, "id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def migrate_thoughts(old: DataFrame) -> DataFrame:
    """IO-9: the namespace follows the receiver, ``all`` being the broadcast one."""
    to = F.coalesce("to_presence", F.lit("all"))
    return old.select(F.col("id").alias("object_id"), F.concat(F.when(to == "all", "broadcast").otherwise(to), F.lit("/legacy/thought")).alias("namespace"), F.coalesce("from_presence", F.lit("legacy")).alias("from_presence"), to.alias("to_presence"), "read", "read_by")


def backfill_identity_family(df: DataFrame) -> DataFrame:
    """IO-10"""
    return df.withColumn("identity_family", F.coalesce("identity_family", family_of(F.col("namespace"))))


_TOPICS = ("infra", "music", "food", "travel", "health", "work", "garden", "books")


def synthesize_corpus(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """IO-11: deterministic rows from templates."""
    i = F.col("id")
    topic = F.element_at(F.array(*map(F.lit, _TOPICS)), ((i * 7 + seed) % len(_TOPICS) + 1).cast("int"))
    return spark.range(n).select(
        F.concat(F.lit("S"), F.lpad(i.cast("string"), 26, "0")).alias("object_id"), F.concat(F.lit("load/p"), (i % 4).cast("string"), F.lit("/episodic")).alias("namespace"),
        F.concat(F.lit("note "), i.cast("string"), F.lit(" about "), topic).alias("content"), F.array(topic).alias("topics"), (i % 8 + 2).cast("int").alias("importance"),
    )
