"""Lineage of a page of hits (J-3): every lookup goes from the hits, by plane and namespace.

Hits are few and planes are large. So keys are gathered from the hits and a plane is joined with
them alone (broadcast where they are few, counted first): no step builds anything over a whole
plane. Chains of supersession are walked hop by hop: the frontier, the rows whose successor is not known yet, is
joined with the plane until it is empty, so the number of joins is the longest chain of the hits. Each
hop is a file that the next one reads, as the estimates of plans multiply with the hops else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from memlake.operators.similarity import SMALL_ROWS, if_small
from memlake.sources.scratch import new_folder, stored

#: Hops of a chain that are followed at most.
HOPS = 64
#: Planes whose rows may supersede one another.
CHAINED = ("episodic", "concept", "curated")
KEY = ["plane", "namespace", "object_id"]
TIP = ["tip", "tip_title", "tip_state"]


def sibling(plane: str) -> Column:
    """The hit's namespace, of another plane."""
    return F.replace("namespace", F.concat(F.lit("/"), "plane"), F.lit(f"/{plane}"))


def found(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows that some key names."""
    return rows.join(if_small(keys.select(on).distinct()), on)


def walk_to_tips(hits: DataFrame, chain: DataFrame) -> DataFrame:
    """(plane, namespace, object_id, tip, tip_title, tip_state): the last row that a chain of
    ``superseded_by`` reaches in the hit's own plane and namespace; hits that nothing supersedes, or
    that a missing row does, have none. A chain that comes back to a row ends before it."""
    spark, folder = hits.sparkSession, new_folder(hits.sparkSession)
    found(hits, chain, KEY).select(*KEY, F.col("superseded_by").alias("next"), F.array("object_id").alias("seen"), *(F.lit(None).cast("string").alias(c) for c in TIP)).write.parquet(f"{folder}/hop=0")
    schema = spark.read.parquet(f"{folder}/hop=0").schema
    at = ["plane", "namespace", "next"]
    there = chain.select("plane", "namespace", F.col("object_id").alias("next"), F.col("superseded_by").alias("further"), F.col("title").alias("to_title"), F.col("state").alias("to_state"))
    for hop in range(HOPS):
        walk = spark.read.schema(schema).parquet(f"{folder}/hop={hop}")
        front = walk.filter(F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next")))
        n = front.limit(SMALL_ROWS + 1).count()
        if not n:
            break
        met = there.join(F.broadcast(front) if n <= SMALL_ROWS else front, at)
        met.select(*KEY, F.col("further").alias("next"), F.concat("seen", F.array("next")).alias("seen"), F.col("next").alias("tip"), F.col("to_title").alias("tip_title"), F.col("to_state").alias("tip_state")).write.parquet(f"{folder}/hop={hop + 1}")
    every = spark.read.schema(StructType([*schema, StructField("hop", IntegerType())])).parquet(folder)
    return every.groupBy(KEY).agg(F.max_by(F.struct(*TIP), "hop").alias("last")).select(*KEY, *(F.col(f"last.{c}").alias(c) for c in TIP))


def hydrate_lineage(hits: DataFrame, planes: dict[str, DataFrame]) -> DataFrame:
    """J-3: hits (plane, namespace, object_id, promoted_to, promoted_from, supported_by) with the tip of
    their chain, the ids of what they supersede, the title of the note that a concept was promoted
    to and of the concept that a note was promoted from, and the names of the files that support
    them. Each is looked up in the plane and namespace beside the hit's own; what is not there is
    null, or an empty array. ``planes`` maps names to rows; a plane that is missing has none.
    """
    spark = hits.sparkSession
    hits = stored(hits)

    def rows(plane: str, *columns: str) -> DataFrame:
        df = planes.get(plane)
        if df is None:
            return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("namespace", "object_id", *columns)))
        return df.select("namespace", "object_id", *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))

    chain = None
    for plane in CHAINED:
        one = rows(plane, "superseded_by", "title", "state").withColumn("plane", F.lit(plane))
        chain = one if chain is None else chain.unionByName(one)
    chain = stored(chain)  # read once a hop
    out = hits.join(walk_to_tips(hits, chain), KEY, "left")
    older = chain.filter("superseded_by is not null").select("plane", "namespace", F.col("superseded_by").alias("object_id"), F.col("object_id").alias("older"))
    older = found(hits, older, KEY).groupBy(KEY).agg(F.sort_array(F.collect_set("older")).alias("supersedes"))
    out = out.join(older, KEY, "left")
    for of, to, column, title in (("concept", "curated", "promoted_to", "promoted_title"), ("curated", "concept", "promoted_from", "promoted_from_title")):
        asked = hits.filter((F.col("plane") == of) & F.col(column).isNotNull()).select(sibling(to).alias("beside"), F.col(column))
        there = rows(to, "title").select(F.col("namespace").alias("beside"), F.col("object_id").alias(column), F.col("title").alias(title))
        there = found(asked, there, ["beside", column]).withColumn("plane", F.lit(of))
        out = out.withColumn("beside", sibling(to)).join(there, ["plane", "beside", column], "left").drop("beside")
    refs = hits.select(*KEY, F.explode("supported_by").alias("artifact_id")).withColumn("beside", sibling("artifact"))
    files = rows("artifact", "filename").select(F.col("namespace").alias("beside"), F.col("object_id").alias("artifact_id"), "filename")
    files = refs.join(found(refs, files, ["beside", "artifact_id"]), ["beside", "artifact_id"]).groupBy(KEY).agg(F.sort_array(F.collect_set("filename")).alias("files"))
    out = out.join(files, KEY, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"files": F.coalesce("files", empty), "supersedes": F.coalesce("supersedes", empty)})
