"""Exact deduplication against a history indexed by a minimal perfect hash.

The history's distinct digests are dealt into buckets of bounded size. Each bucket gets a
minimal perfect hash (hash and displace): ``pilots`` maps a digest to one of exactly ``n``
slots; a slot holds the full 32-byte digest, the locator (doc_id) of the row that stays and
the number of copies. A lookup computes the slot and compares all 32 bytes, so a digest
outside the history is never taken for a member. Digests outside it form their own groups.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of
equal texts the largest doc_id stays (null ids rank lowest). Each input row gives one output
row, repeated rows too: they are copies, and every row carrying the id that stays is kept.
A very long text is hashed whole, in the JVM. An empty table gives an empty result, an empty
history an index without rows. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import ascii_lower, materialize, sifted

#: Mean number of digests in a bucket of the index; bounds a task's memory at any input size.
BUCKET_KEYS = 4096
#: A group with more than 1/HOT of all rows is hot; so there are at most HOT hot groups.
HOT = 1024

INDEX_SCHEMA = "bucket bigint, n int, pilots array<int>, digests binary, winners array<bigint>, copies array<bigint>"
GROUP_SCHEMA = "digest binary, keep_id bigint, group_size bigint, member boolean"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(ascii_lower(text), "UTF-8"), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the SHA-256 of each normalised text, 32 bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest; summed on the map side, so a hot digest costs one row per task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def _hashes(digests: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each digest (rows of 32 bytes) among ``n // 4`` groups, and a seed."""
    words = digests.view(">u8").astype(np.uint64)
    return (words[:, 1] % np.uint64(max(1, n // 4))).astype(np.int64), words[:, 2] ^ words[:, 3]


def _displace(seeds: np.ndarray, pilots: np.ndarray | int, n: int) -> np.ndarray:
    """Slot among ``n`` of each seed under its pilot."""
    x = seeds + np.asarray(pilots, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots by group and the slot of each digest; ``digests`` is (n, 32) uint8, distinct.

    Groups are placed from the largest down. A group's pilot is the first displacement that
    sends its digests to free, different slots. A group of one takes a free slot directly,
    stored as a negative pilot.
    """
    n = len(digests)
    group, seeds = _hashes(digests, n)
    pilots, slots, taken = np.zeros(max(1, n // 4), np.int32), np.full(n, -1, np.int64), np.zeros(n, bool)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    members = sorted(np.split(order, cuts), key=len, reverse=True) if n else []
    free = None
    for m in members:
        if len(m) == 1:
            if free is None:
                free = iter(np.flatnonzero(~taken))
            slot = int(next(free))
            pilots[group[m[0]]], slots[m[0]], taken[slot] = -slot - 1, slot, True
            continue
        for first in range(0, 1 << 30, 512):  # many displacements at a time
            tries = _displace(seeds[m][None, :], np.arange(first, first + 512, dtype=np.uint64)[:, None], n)
            fits = ~taken[tries].any(axis=1)
            fits[fits] = (np.diff(np.sort(tries[fits], axis=1), axis=1) > 0).all(axis=1)
            if fits.any():
                break
        else:
            raise ValueError("digests can't be separated")
        pilot = first + int(fits.argmax())
        at = tries[pilot - first]
        pilots[group[m[0]]], slots[m], taken[at] = pilot, at, True
    return pilots, slots


def slot_of(digests: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The only slot in which each digest can be."""
    group, seeds = _hashes(digests, n)
    pilot = pilots[group].astype(np.int64)
    return np.where(pilot < 0, -pilot - 1, _displace(seeds, np.maximum(pilot, 0), n))


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(part.digest)
    pilots, slots = build_mph(digests)
    at = np.argsort(slots)
    winners = [None if pd.isna(x) else int(x) for x in part.winner.iloc[at]]
    return pd.DataFrame([{"bucket": key[0], "n": len(part), "pilots": pilots, "digests": digests[at].tobytes(), "winners": winners, "copies": part.copies.to_numpy()[at]}])


def with_bucket(distinct: DataFrame, buckets: int) -> DataFrame:
    return distinct.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """The index of the history, one row per bucket (``INDEX_SCHEMA``)."""
    return with_bucket(distinct, buckets).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def _look_up(key: tuple, index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    new, ids, sizes = _matrix(fresh.digest), fresh.winner.astype("Int64"), fresh.copies.to_numpy(np.int64)
    if not len(index):
        return pd.DataFrame({"digest": fresh.digest, "keep_id": ids, "group_size": sizes, "member": False})
    row = index.iloc[0]
    held, n = np.frombuffer(row.digests, np.uint8).reshape(-1, 32), int(row.n)
    keep = pd.Series([None if x is None or x != x else int(x) for x in row.winners], dtype="Int64")
    copies = np.array(row.copies, np.int64)
    slots = slot_of(new, np.asarray(row.pilots, np.int32), n) if len(new) else np.empty(0, np.int64)
    member = (held[slots] == new).all(axis=1) if len(new) else np.empty(0, bool)
    at = slots[member]
    copies[at] += sizes[member]
    keep.iloc[at] = pd.concat([keep.iloc[at].reset_index(drop=True), ids[member].reset_index(drop=True)], axis=1).max(axis=1).array
    known = pd.DataFrame({"digest": [x.tobytes() for x in held], "keep_id": keep, "group_size": copies, "member": True})
    rest = pd.DataFrame({"digest": fresh.digest[~member], "keep_id": ids[~member], "group_size": sizes[~member], "member": False})
    return pd.concat([known, rest], ignore_index=True)


def look_up(index: DataFrame, distinct: DataFrame, buckets: int) -> DataFrame:
    """Groups after a batch: the history's, raised by members, and those of nonmembers."""
    return index.groupBy("bucket").cogroup(with_bucket(distinct, buckets).groupBy("bucket")).applyInPandas(_look_up, GROUP_SCHEMA)


def exact_dedup(history: DataFrame, batch: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history for each row of both.

    ``history`` is what earlier runs have indexed and ``batch`` what arrives.
    """
    rows = materialize(digest_rows(history).withColumn("old", F.lit(True)).unionByName(digest_rows(batch).withColumn("old", F.lit(False))))
    old = materialize(distinct_digests(rows.filter("old")))
    new = materialize(distinct_digests(rows.filter("not old")))
    buckets = max(1, math.ceil(max(old.count(), new.count()) / BUCKET_KEYS))  # neither side's are large
    index = materialize(build_index(old, buckets))
    groups = materialize(look_up(index, new, buckets))
    total = rows.count()
    hot = F.col("group_size") * HOT > total
    # at most HOT groups have more than 1/HOT of all rows: a proven bound for the broadcast
    marked = rows.join(F.broadcast(groups.filter(hot)), "digest", "left")
    cold = marked.filter("group_size is null").select("doc_id", "digest").join(groups.filter(~hot), "digest")
    out = marked.filter("group_size is not null").select(cold.columns).unionByName(cold)
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that exact deduplication keeps.

    Even ids take the part of the history. Rows that go are told apart by id, which may be
    null, and digest.
    """
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    gone = exact_dedup(docs.filter(even), docs.filter(~even)).filter("not kept").select(F.col("doc_id").cast("long").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest"))
    told = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), digest_of(F.col("text")).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    gone = materialize(gone.distinct())
    some, rest = sifted(told, F.struct("id", "digest"), gone, F.struct("gone_id", "gone_digest"))
    return some.join(gone, same, "left_anti").unionByName(rest).select("doc.*")
