"""Memory planes: reading and writing them, and deriving them from the given tables.

The derivation is integer arithmetic on ids, so the SQL twins repeat it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import body_hash

#: 2024-01-01; ids count hours from it.
EPOCH = 1704067200
#: The fixed "now" of the sweeps' queries, 2024-05-01.
NOW = 1714521600.0
DAY = 86400.0
#: Keys of thoughts are conv_id * TURNS + turn; no conversation has more turns.
TURNS = 10_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_plane(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO-1: a plane by its fixed schema, never inferred."""
    return spark.read.schema(schema).parquet(path)


def write_plane(df: DataFrame, path: str) -> None:
    """IO-2: partitioned by family and state, ordered in the files by time and object_id, so that a
    reader of one family, state or time opens few files and few parts of them."""
    by = ["identity_family", "state"]
    df.repartition(*by, F.floor(F.col("created_epoch") / (30 * DAY))).sortWithinPartitions(*by, "created_epoch", "object_id").write.partitionBy(*by).parquet(path)


def key(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 26, "0"))


def _pick(number: Column, *values: str) -> Column:
    out = F
    for i, v in enumerate(values):
        out = out.when(number % len(values) == i, F.lit(v))
    return out


def episodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured memories, one per document."""
    n = F.col("doc_id")
    created = (F.lit(EPOCH) + n * 3600).cast("double")
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        key("D", n).alias("object_id"), F.concat_ws("/", "lang", "source", F.lit("episodic")).alias("namespace"), F.col("lang").alias("identity_family"), n.alias("number"),
        _pick(n, "provisional", "matured", "matured", "matured", "matured", "demoted", "archived", "superseded").alias("state"), F.lit(1).alias("version"),
        created.alias("created_epoch"), (created + n % 7 * DAY).alias("updated_epoch"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(n % 2 == 0, F.substring("text", 1, 80)).alias("summary"), F.lit(None).cast("string").alias("title"),
        F.array(F.col("source"), F.concat(F.lit("g"), (n % 5).cast("string"))).alias("tags"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (n % 5).cast("string")))).alias("topics"),
        (1 + n % 10).cast("int").alias("importance"), (F.floor(n / 3) % 6).cast("int").alias("reinforcement_count"), (n % 4).cast("int").alias("access_count"),
        F.when(n % 3 == 0, created).alias("valid_from_epoch"), F.when(n % 4 == 0, created + n % 50 * DAY).alias("valid_until_epoch"),
        F.when(n % 20 == 7, key("D", n + 10)).alias("superseded_by"),
        F.when(n % 9 == 0, F.array(key("A", n % 400))).otherwise(F.array().cast("array<string>")).alias("supported_by"),
    )


def concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts, one per document."""
    n = F.col("doc_id")
    created = (F.lit(EPOCH) + n * 3600).cast("double")
    promoted = F.floor(n / 5) % 6 == 3
    return read_table(spark, sf_dir, "documents").select(
        key("C", n).alias("object_id"), F.concat_ws("/", "lang", F.lit("shared"), F.lit("concept")).alias("namespace"), F.col("lang").alias("identity_family"), n.alias("number"),
        _pick(F.floor(n / 5), "synthesized", "matured", "matured", "promoted", "demoted", "superseded").alias("state"), F.lit(1).alias("version"),
        created.alias("created_epoch"), (created + n % 7 * DAY).alias("updated_epoch"), F.coalesce("text", F.lit("")).alias("content"), F.substring("text", 1, 40).alias("title"),
        (1 + n % 10).cast("int").alias("importance"), (F.floor(n / 5) % 6).cast("int").alias("reinforcement_count"), (n % 4).cast("int").alias("promotion_attempts"),
        F.when(n % 35 == 0, F.array(key("C", n + 5))).otherwise(F.array().cast("array<string>")).alias("contradicts"),
        F.when(promoted, key("K", n)).alias("promoted_to"), F.array(F.concat(F.lit("t"), (n % 3).cast("string"))).alias("topics"),
        F.when(n % 2 == 0, created + n % 40 * DAY).alias("last_reinforced_epoch"), F.array(key("D", n), key("D", n + 1), key("D", n + 2)).alias("merged_from"),
    )


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated notes, one per document."""
    n = F.col("doc_id")
    created = (F.lit(EPOCH) + n * 3600).cast("double")
    return read_table(spark, sf_dir, "documents").select(
        key("K", n).alias("object_id"), F.concat_ws("/", "lang", F.lit("shared"), F.lit("curated")).alias("namespace"), F.col("lang").alias("identity_family"), n.alias("number"),
        _pick(n, "matured", "matured", "superseded", "archived").alias("state"), F.lit(1).alias("version"), created.alias("created_epoch"), (created + n % 7 * DAY).alias("updated_epoch"),
        F.col("text").alias("content"), F.substring("text", 1, 40).alias("title"), (1 + n % 10).cast("int").alias("importance"),
        F.concat(F.lit("curated/"), F.col("lang"), F.lit("/"), n.cast("string"), F.lit(".md")).alias("vault_path"), body_hash(F.col("text")).alias("body_hash"),
        F.when(n % 35 == 0, key("C", n)).alias("promoted_from"), F.when(n % 3 == 0, created).alias("valid_from_epoch"), F.when(n % 4 == 0, created + n % 50 * DAY).alias("valid_until_epoch"),
        F.when(n % 2 == 0, created + n % 60 * DAY).alias("last_accessed_epoch"),
    )


def artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts, one per page."""
    n = F.col("page_id")
    created = (F.lit(EPOCH - 200 * 86400) + n * 7200).cast("double")
    return read_table(spark, sf_dir, "pages").select(
        key("A", n).alias("object_id"), F.concat(F.lit("web/site"), (n % 10).cast("string"), F.lit("/artifact")).alias("namespace"), F.lit("web").alias("identity_family"), n.alias("number"),
        _pick(n, "matured", "matured", "matured", "archived").alias("state"), F.lit(1).alias("version"), created.alias("created_epoch"), created.alias("updated_epoch"),
        F.col("url").alias("filename"), F.col("html").alias("content"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"),
    )


def thought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, one per turn of a conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    receiver = F.when(F.col("role") == "system", "all").when(F.col("role") == "user", "assistant").otherwise("user")
    return read_table(spark, sf_dir, "conversations").select(
        key("T", c * TURNS + t).alias("object_id"), F.concat(F.lit("conv"), (c % 10).cast("string"), F.lit("/chat/thought")).alias("namespace"), F.col("role").alias("from_presence"), receiver.alias("to_presence"),
        F.concat(F.lit("c"), (c % 3).cast("string")).alias("channel"), (1 + t % 10).cast("int").alias("importance"), (F.lit(EPOCH) + c * 3600 + t * 60).cast("double").alias("created_epoch"), F.col("text").alias("content"),
        F.when(t % 3 == 0, F.array(receiver)).otherwise(F.array().cast("array<string>")).alias("read_by"), F.when(t > 0, key("T", c * TURNS + t - 1)).alias("in_reply_to"),
        _pick(t, "provisional", "matured", "matured", "archived").alias("state"), F.lit(1).alias("version"),
    )


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes, one per event."""
    kinds = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id"), key("D", F.col("user_id")).alias("object_id"), _pick(kinds, "provisional", "matured", "demoted").alias("from_state"), _pick(kinds, "matured", "demoted", "matured").alias("to_state"),
        F.col("event_type").alias("reason"), F.unix_micros(F.col("ts").cast("timestamp")).alias("occurred_us"), F.col("value"),
    )
