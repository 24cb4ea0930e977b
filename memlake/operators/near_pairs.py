"""Pairs of similar rows within a group, by metric pruning (V-7, V-12, V-17); exact.

The angle between two vectors is a distance: it obeys the triangle inequality. Rows of a large
group go to the nearest of a few pivots of the group, those of a pivot into blocks of about BLOCK rows, and a
block knows its radius, the largest angle to its pivot. Two blocks whose pivots are
further apart than both radii and the angle asked for can't have a pair and are never compared;
with an upper bound, neither are two that are wholly nearer than that. The others are compared,
each pair of blocks in one matrix product and a task of its own.

Rows that are far from every pivot would make a block's radius large; they lie in blocks of
their own that are always compared, as do zero vectors, which have a cosine of 0 with all others
and no angle. Where little can be skipped, as at a low cosine, a group is dealt into blocks of TILE
rows by a hash instead, so that no row is sent to more blocks than that takes: what each way
would send is counted first, from the blocks' sizes alone.

Where only the pairs that connect are asked for, a large group first meets its hubs, about HUBS rows
drawn by a hash. What has a pair with one of the hubs' largest component is connected with
all else that has one, so only the other rows must meet the whole group. Where these are more than
LEFT of it, as at a high cosine, the group goes the way of all pairs.
Rows that occur twice are two rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from memlake.operators.nearest import fresh, unit
from memlake.sources.scratch import stored

#: Rows of a block, pivots for each of a group's blocks and in all, and rows that are assigned to
#: pivots at once. With more pivots than blocks, few of them stand for several clusters.
BLOCK = 1024
PIVOTS_OF_BLOCK, PIVOTS = 4, 512
ASSIGNED = 8192
#: Rows of a block where nothing is skipped, and of one side that are compared at once.
TILE, STRIP = 8192, 1024
#: Hubs of a group, of groups of more than twice as many rows, and the share of rows without a link to them
#: up to which these alone meet the group.
HUBS, LEFT = 2048, 0.25
#: Beyond that angle no pivot is near: such rows lie in blocks of their own, always compared.
FAR = math.pi / 4
#: What rounding may take from an angle near 0.
SLACK = 1e-6
PAIR = "group string, a string, b string, cosine double"
MET = f"{PAIR}, vector array<double>, main boolean"


def _pairs(x: pd.DataFrame, y: pd.DataFrame, group: str, same: bool, two_sided: bool, threshold: float, below: float | None, forest: bool = False) -> pd.DataFrame:
    def table(a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"group": np.full(len(a), group, object), "a": a.astype(object), "b": b.astype(object), "cosine": cosine})

    if not len(x) or not len(y):
        return table(*(np.empty(0),) * 3)
    u, w, ids, others = unit(x.vector), unit(y.vector).T, x.object_id.to_numpy(), y.object_id.to_numpy()
    links = _Links(ids, others) if forest else None
    out = []
    for begin in range(0, len(u), STRIP):
        scores = u[begin : begin + STRIP] @ w
        hit = scores >= threshold
        if below is not None:
            hit &= scores < below
        if links:
            p, q = links.joined(begin, hit)
        else:
            p, q = np.nonzero(hit)
        a, b, cosine = ids[begin + p], others[q], scores[p, q]
        if not two_sided:
            keep = a != b if links else a < b if same else np.ones(len(a), bool)
            a, b, cosine = np.where(a < b, a, b)[keep], np.where(a < b, b, a)[keep], cosine[keep]
        out.append(table(a, b, cosine))
    return pd.concat(out, ignore_index=True)


class _Links:
    """Components of the ids of two blocks; of the hits, only those that join two of them."""

    def __init__(self, ids: np.ndarray, others: np.ndarray):
        names, number = np.unique(np.r_[ids.astype(str), others.astype(str)], return_inverse=True)
        self.left, self.right = number[: len(ids)], number[len(ids) :]
        self.label = np.arange(len(names))

    def joined(self, begin: int, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = [], []
        for i in np.flatnonzero(hit.any(axis=1)):
            at = np.flatnonzero(hit[i])
            mine = self.label[self.left[begin + i]]
            found, first = np.unique(self.label[self.right[at]], return_index=True)
            new = found != mine
            if new.any():
                rows.append(np.full(new.sum(), i))
                columns.append(at[first[new]])
                self.label[np.isin(self.label, found[new])] = mine
        return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, int), np.empty(0, int))


def _met(group: str, links: list[pd.DataFrame], ids=(), vectors=(), main=False) -> pd.DataFrame:
    """Links, and rows (without ``b``) with their vectors."""
    rows = pd.DataFrame({"group": np.full(len(ids), group, object), "a": pd.Series(list(ids), dtype=object), "b": None, "cosine": 0.0, "vector": pd.Series(list(vectors), dtype=object), "main": main})
    return pd.concat([*(x.assign(vector=None, main=False) for x in links if len(x)), rows], ignore_index=True)


def _hub_links(rows: DataFrame, many: DataFrame, threshold: float, below: float | None) -> DataFrame:
    """Pairs (MET) that connect the rows of each group that have one with its hubs; and, without ``b``,
    the rows that have none with the hubs' largest component."""
    held = rows.join(many, "group")
    drawn = F.pmod(F.xxhash64("object_id", F.lit("hub")), F.lit(1_000_000)) < F.lit(1_000_000) * HUBS / F.col("n")

    def within(key: tuple, hub: pd.DataFrame) -> pd.DataFrame:
        hub = hub.sort_values("object_id").reset_index(drop=True)
        ids, vectors = hub.object_id.to_numpy(), hub.vector
        links = _pairs(hub, hub, key[0], True, False, threshold, below, True)
        names, number = np.unique(ids.astype(str), return_inverse=True)
        label = np.arange(len(names))
        for a, b in zip(np.searchsorted(names, links.a.astype(str)), np.searchsorted(names, links.b.astype(str))):
            label[label == label[b]] = label[a]
        label = label[number]
        return _met(key[0], [links], ids, vectors, label == np.bincount(label).argmax())

    found = stored(held.filter(drawn).groupBy("group").applyInPandas(within, MET))

    def meet(key: tuple, part: pd.DataFrame, hub: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return _met(key[0], [])
        hub = hub.sort_values("a")
        main, others = hub[hub.main], hub[~hub.main].rename(columns={"a": "object_id"})
        ids, names, linked, links = part.object_id.to_numpy(), main.a.to_numpy(), np.zeros(len(part), bool), []
        if len(main):
            u, w = unit(part.vector), unit(main.vector).T
            for begin in range(0, len(u), STRIP):
                scores = u[begin : begin + STRIP] @ w
                hit = scores >= threshold
                if below is not None:
                    hit &= scores < below
                first = hit.argmax(axis=1)
                p = np.flatnonzero(hit[np.arange(len(hit)), first])
                linked[begin + p] = True
                x, y = ids[begin + p], names[first[p]]
                keep = x != y
                links.append(pd.DataFrame({"group": key[0], "a": np.where(x < y, x, y)[keep], "b": np.where(x < y, y, x)[keep], "cosine": scores[p, first[p]][keep]}))
        links.append(_pairs(part, others, key[0], False, False, threshold, below, True))
        return _met(key[0], links, ids[~linked], part.vector[~linked])

    salts = F.ceil(F.col("n") / ASSIGNED).cast("int")
    salted = held.select("group", "object_id", "vector", F.pmod(F.xxhash64("object_id", F.lit("salt")), salts).cast("int").alias("salt"))
    every = found.filter("b is null").join(many, "group").select("group", "a", "vector", "main", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = salted.groupBy("group", "salt").cogroup(fresh(every).groupBy("group", "salt")).applyInPandas(meet, MET)
    return stored(found.filter("b is not null").unionByName(met))


def _by_hubs(rows: DataFrame, large: DataFrame, threshold: float, below: float | None) -> tuple[DataFrame, DataFrame] | None:
    """(pairs that connect the groups that go by hubs, these groups); None if there are none."""
    many = stored(large.filter(F.col("n") > 2 * HUBS))
    if many.isEmpty():
        return None
    found = _hub_links(rows, many, threshold, below)
    alone = found.filter("b is null").groupBy("group").agg(F.count(F.lit(1)).alias("alone"))
    done = many.join(alone, "group", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).filter(F.col("alone") <= LEFT * F.col("n"))
    done = stored(done.select("group", F.ceil(F.col("alone") / TILE).cast("int").alias("left_tiles"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    if done.isEmpty():
        return None
    sides = done.filter("left_tiles > 0")

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(F.broadcast(sides), "group").select("group", "object_id", "vector", _part("object_id", F.col(own)).alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _pairs(x, y, key[0], False, False, threshold, below, True)

    key = ["group", "left_tiles", "tiles"]
    left = side(found.filter("b is null").select("group", F.col("a").alias("object_id"), "vector"), "left_tiles", "tiles")
    links = left.groupBy(key).cogroup(fresh(side(rows.select("group", "object_id", "vector"), "tiles", "left_tiles")).groupBy(key)).applyInPandas(compare, PAIR)
    return links.unionByName(found.filter("b is not null").join(F.broadcast(done.select("group")), "group", "left_semi").select("group", "a", "b", "cosine")), done.select("group")


def _part(key: str | Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), parts).cast("int")


def _assigned(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of large groups with pivot and angle, angles between the pivots of a group)."""
    held = rows.join(large, "group")
    drawn = F.pmod(F.xxhash64("object_id", F.lit("pivot")), F.lit(1_000_000)) < F.lit(1_000_000) * F.least(F.lit(PIVOTS), PIVOTS_OF_BLOCK * F.ceil(F.col("n") / BLOCK)) / F.col("n")
    pivots = held.filter(drawn & (F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x) > 0)).select("group", "n", "object_id", "vector")

    def nearest(part: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        out = part.drop(columns=["n", "salt"]).assign(pivot="", angle=math.pi)
        if len(part) and len(pivot):
            pivot = pivot.sort_values("object_id")
            u = unit(part.vector)
            scores = np.clip(u @ unit(pivot.vector).T, -1, 1)
            some = (np.abs(u).max(axis=1) > 0)
            best = scores.argmax(axis=1)
            angle = np.arccos(scores[np.arange(len(u)), best])
            some &= angle <= FAR
            out["pivot"] = np.where(some, pivot.object_id.to_numpy()[best], "")
            out["angle"] = np.where(some, angle, math.pi)
        return out

    def apart(key: tuple, pivot: pd.DataFrame) -> pd.DataFrame:
        angle = np.arccos(np.clip(unit(pivot.vector) @ unit(pivot.vector).T, -1, 1))
        ids = pivot.object_id.to_numpy()
        return pd.DataFrame({"group": key[0], "pivot_i": np.repeat(ids, len(ids)), "pivot_j": np.tile(ids, len(ids)), "apart": angle.ravel()})

    salts = F.ceil(F.col("n") / ASSIGNED).cast("int")
    salted = held.withColumn("salt", F.pmod(F.xxhash64("object_id", "side"), salts).cast("int"))
    every = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    every = fresh(every)
    near = salted.groupBy("group", "salt").cogroup(every.groupBy("group", "salt")).applyInPandas(nearest, f"group string, side int, object_id string, vector {rows.schema['vector'].dataType.simpleString()}, pivot string, angle double")
    return near, pivots.dropDuplicates(["group", "object_id"]).groupBy("group").applyInPandas(apart, "group string, pivot_i string, pivot_j string, apart double")


def block_pairs(rows: DataFrame, large: DataFrame, two_sided: bool, threshold: float, below: float | None) -> tuple[DataFrame, DataFrame]:
    """(rows with the block that they lie in, all pairs of blocks with ``kept``)."""
    near, angles = _assigned(rows, large)
    near = stored(near.unionByName(rows.join(large, "group", "left_anti").withColumns({"pivot": F.lit(""), "angle": F.lit(math.pi)})))
    cell = ["group", "side", "pivot"]
    parts = near.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = near.join(parts, cell).withColumn("block", F.concat_ws(":", F.col("side").cast("string"), "pivot", _part("object_id", F.col("parts")).cast("string"))).drop("parts")
    blocks = dealt.groupBy("group", "side", "pivot", "block").agg(F.max("angle").alias("radius"))

    def named(i: str) -> DataFrame:
        return blocks.select("group", *(F.col(c).alias(f"{c}_{i}") for c in ("side", "pivot", "block", "radius")))

    which = (F.col("side_i") < F.col("side_j")) if two_sided else (F.col("block_i") <= F.col("block_j"))
    met = named("i").join(named("j"), "group").filter(which).join(angles, ["group", "pivot_i", "pivot_j"], "left")
    reach = F.col("radius_i") + F.col("radius_j") + SLACK
    kept = F.col("apart").isNull() | (F.col("apart") - reach <= math.acos(max(-1.0, min(1.0, threshold))))
    if below is not None:
        kept &= F.col("apart").isNull() | (F.col("apart") + reach >= math.acos(max(-1.0, min(1.0, below))))
    return dealt, met.select("group", "block_i", "block_j", kept.alias("kept"))


def similar_pairs(df: DataFrame, threshold: float, below: float | None = None, other: DataFrame | None = None, forest: bool = False) -> DataFrame:
    """(group, a, b, cosine) with a cosine in [threshold, below), of rows (group, object_id, vector).

    Without ``other`` the pairs are within ``df``, a < b; with it, a is of ``df`` and b of ``other``.
    With ``forest``, without ``other``, only pairs that connect what all of them do: fewer than the
    rows of each two blocks that are compared.
    """
    two_sided = other is not None
    floats = all(x.schema["vector"].dataType == ArrayType(FloatType(), x.schema["vector"].dataType.containsNull) for x in (df, other) if x is not None)
    kind = "array<float>" if floats else "array<double>"  # compared in doubles either way, but half the size on its way

    def side(rows: DataFrame, number: int) -> DataFrame:
        return rows.select(F.col("group").cast("string").alias("group"), F.lit(number).alias("side"), "object_id", F.col("vector").cast(kind).alias("vector"))

    rows = side(df, 0).unionByName(side(other, 1)) if two_sided else side(df, 0)
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides"))
    if two_sided:
        sizes = sizes.filter("sides = 2")
    large = sizes.filter(F.col("n") > BLOCK).select("group", "n")
    small = sizes.filter((F.col("n") > 1) & (F.col("n") <= BLOCK))
    total = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def whole(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for group, of in part.groupby("group", sort=False):
            x, y = (of[of.side == 0], of[of.side == 1]) if two_sided else (of, of)
            found.append(_pairs(x, y, group, True, two_sided, threshold, below, forest))
        return pd.concat(found, ignore_index=True)

    # groups are small, and may be many: about ASSIGNED rows of them at once
    bucket = F.pmod(F.xxhash64("group", F.lit("bucket")), F.lit(max(1, -(-total // ASSIGNED))))
    within = rows.join(small.select("group"), "group", "left_semi").groupBy(bucket).applyInPandas(whole, PAIR)
    if large.isEmpty():
        return within
    rows, large = stored(rows.join(large.select("group"), "group", "left_semi")), stored(large)
    hubs = _by_hubs(rows, large, threshold, below) if forest else None
    if hubs:
        within, large = within.unionByName(hubs[0]), stored(large.join(F.broadcast(hubs[1]), "group", "left_anti"))
        if large.isEmpty():
            return within
        rows = rows.join(F.broadcast(hubs[1]), "group", "left_anti")
    dealt, met = block_pairs(rows, large, two_sided, threshold, below)
    dealt, met = stored(dealt), stored(met)
    held = dealt.groupBy("group", "block").agg(F.count(F.lit(1)).alias("rows"))
    sent = met.filter("kept")
    by = [sent.join(held.withColumnRenamed("block", f"block_{i}"), ["group", f"block_{i}"]).select("group", "rows") for i in "ij"]
    sent = by[0].unionByName(by[1]).groupBy("group").agg(F.sum("rows").alias("sent"))
    tiles = F.ceil(F.col("n") / TILE)
    # groups where skipping sends more rows than comparing all tiles does
    plain = stored(large.join(sent, "group").filter(F.col("sent") > F.col("n") * (tiles + 1)).select("group", tiles.cast("int").alias("tiles")))
    tiled = rows.join(F.broadcast(plain), "group").withColumn("block", F.concat_ws(":", F.col("side").cast("string"), _part("object_id", F.col("tiles")).cast("string"))).drop("tiles")
    dealt = dealt.join(F.broadcast(plain), "group", "left_anti").select("group", "side", "object_id", "vector", "block").unionByName(tiled.select("group", "side", "object_id", "vector", "block"))
    pair = F.col("side_i") < F.col("side_j") if two_sided else F.col("block_i") <= F.col("block_j")
    of_tiles = [tiled.select("group", F.col("side").alias(f"side_{i}"), F.col("block").alias(f"block_{i}")).distinct() for i in "ij"]
    every = of_tiles[0].join(of_tiles[1], "group").filter(pair).select("group", "block_i", "block_j")
    kept = stored(met.filter("kept").join(F.broadcast(plain), "group", "left_anti").select("group", "block_i", "block_j").unionByName(every))

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _pairs(x, y, key[0], key[1] == key[2], two_sided, threshold, below, forest)

    def rows_of(i: str) -> DataFrame:
        return dealt.select("group", F.col("block").alias(f"block_{i}"), "object_id", "vector").join(kept, ["group", f"block_{i}"])

    key = ["group", "block_i", "block_j"]
    return within.unionByName(rows_of("i").groupBy(key).cogroup(fresh(rows_of("j")).groupBy(key)).applyInPandas(compare, PAIR))
