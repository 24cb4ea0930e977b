"""Chat formatting: collapse cumulative snapshots, then render what is left.

Logs often hold a conversation again and again as it grows. A conversation is dropped if its
turns are the first turns of a longer one; of equal ones the smallest conv_id stays. The
maximal ones are rendered in the chat markup.

Rolling prefix hashes. Turn i (its place, role and text) has a SHA-256, read as four numbers
below 2^32; a prefix's hash is the four running sums over its turns. Places make the sums
depend on the order, and running sums can be built in two steps: within blocks of turn numbers
and over the blocks' totals. So a conversation that holds a third of all rows is spread over
tasks; only its block totals meet. A conversation is a snapshot if its whole hash is among the
proper prefixes of others: an anti join on (length, hash) against distinct proper prefixes.

Rendering gives parts of ``PART_TURNS`` turns at most, so no conversation, however long, becomes
one value; the parts in order concatenate to the conversation's markup.

Defined cases: a null role or text is an empty string; turns are ordered by (turn, role, text),
null turns first; turns that share a number are ordered in one task, so numbers are expected to
be shared by few turns; a very long turn is one value, as it is in the table; rows repeated in every column count once; rows with a null conv_id belong to
no conversation and are left out; an empty table gives an empty result; extra columns are not
read. Everything runs on built-in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import materialize

#: Turn numbers per block of the two-step running sums, and turns per rendered part.
BLOCK_TURNS = 256
PART_TURNS = 256
LANES = 4


def _running(by: list[str], order: list, upto: int) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place (from 1) in the conversation, counted block by block."""
    clean = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    distinct = clean.dropDuplicates().withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 60))))
    in_block = distinct.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    return _add_before(in_block, in_block.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("k")), ["k"]).withColumnRenamed("k", "place")


def _add_before(rows: DataFrame, totals: DataFrame, names: list[str]) -> DataFrame:
    """Raise running values inside blocks by the totals of the conversation's earlier blocks."""
    w = _running(["conv_id"], ["block"], -1)
    before = totals.select("conv_id", "block", *(F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"{x}_before") for x in names))
    out = rows.join(before, ["conv_id", "block"])
    return out.withColumns({x: F.col(x) + F.col(f"{x}_before") for x in names}).drop(*(f"{x}_before" for x in names))


def _digest_lane(lane: int) -> Column:
    return F.conv(F.substring("digest", 8 * lane + 1, 8), 16, 10).cast("long")


def prefixes(placed: DataFrame) -> DataFrame:
    """conv_id, place and the hash ``h0..h3`` of each prefix, sums below 2^63 for 2^31 turns."""
    lanes = [f"h{i}" for i in range(LANES)]
    framed = F.concat_ws(":", F.col("place").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text"))
    turns = placed.select("conv_id", "place", F.floor((F.col("place") - 1) / BLOCK_TURNS).alias("block"), F.sha2(F.encode(framed, "UTF-8"), 256).alias("digest"))
    turns = turns.select("conv_id", "place", "block", *(_digest_lane(i).alias(x) for i, x in enumerate(lanes)))
    inside = turns.withColumns({x: F.sum(x).over(_running(["conv_id", "block"], ["place"], 0)) for x in lanes})
    return _add_before(inside, turns.groupBy("conv_id", "block").agg(*(F.sum(x).alias(x) for x in lanes)), lanes).drop("block")


def maximal(turn_prefixes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no snapshot of another."""
    key = ["place", *(f"h{i}" for i in range(LANES))]
    lengths = turn_prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    rows = turn_prefixes.join(lengths, "conv_id")
    whole = rows.filter("place = n_turns").groupBy(key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = rows.filter("place < n_turns").groupBy(key).agg(F.count(F.lit(1)).alias("longer"))  # a hot first turn is one row
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "copies")


def markup(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns of the conversation, part_turns, copies, text."""
    placed = materialize(ordered_turns(turns))
    stay = maximal(materialize(prefixes(placed)))
    part = F.floor((F.col("place") - 1) / PART_TURNS).alias("part")
    kept = placed.join(stay, "conv_id").select("conv_id", part, "n_turns", "copies", F.struct("place", markup(F.col("role"), F.col("text")).alias("text")).alias("turn"))
    grouped = kept.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # PART_TURNS at most
    return grouped.select("conv_id", "part", "n_turns", F.size("turns").cast("long").alias("part_turns"), "copies", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"))
