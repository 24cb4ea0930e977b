"""Hard negatives by rotated one-bit codes, exact.

For every anchor (a row of the stated query set) the best other rows of its label are its
positives; for each positive the negatives are the best rows of other labels whose score lies in
a band of shares of the positive's score. A score is an integer inner product.

How pairs are filtered. A vector is rotated (random signs and Hadamard transforms) and coded by
the signs of its components; with the code c, a unit vector, its alignment t = <c, vector> and
the norm of the residual vector - t*c are stored. The residual is coded again, LEVELS times in
all, each with its own alignment. A query's inner product with a code is a sum of popcounts, as
the query is held in eight bit planes; times the alignments it estimates the score. What is
missing is the query's inner product with the last residual, which is at right angles to its
code, and what the bit planes round off: by Cauchy and Schwarz neither is more than the product
of the norms. That interval holds always, so only pairs whose interval misses what is asked for
are left out, and what survives is scored in integers: the result is exact.

How the work is spread. Coded rows are written once. The anchors are dealt into blocks of
about BLOCK_COMPONENTS components by a hash; a block at a time is broadcast and every row is
compared with it, once for the positives and once for the negatives. Each task keeps the best
rows of each anchor in bounded memory; the best of these are taken after a shuffle by anchor.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no
part; neither do those whose squares of floor(256*x) sum up to 2^62 or more, as their scores
would not fit in 64 bits. Only vectors of the same number of components are compared; vectors
without components score 0. A null vec_id takes part as a row, after all others of its score,
but is no anchor and no anchor's own. Repeated rows each count as rows; anchors equal in id,
label and vector are one, those with one id and other contents are apart. Rows with an anchor's
vec_id are never compared with it. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import materialize
from memlake.llm.topk import NULL_ID, Best

SCALE = 256
LEVELS = 4
#: Components of the anchors of a block, about.
BLOCK_COMPONENTS = 1 << 21
#: Rows that are compared with a block at once, and components that are scored at once.
ROWS, SCORED = 1024, 1 << 22
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: What rounding of doubles may add to an interval, as a share of the product of the norms.
SLACK = 1e-9

CODED = "vec_id bigint, label bigint, dims int, ints binary, codes binary, aligned binary, rest double, norm double"


def rotated(ints: np.ndarray) -> np.ndarray:
    """The rows of ``ints``, padded to a power of two of at least 64, under a fixed rotation."""
    n, dims = ints.shape
    size = max(64, 1 << max(0, dims - 1).bit_length())
    out = np.zeros((n, size))
    out[:, :dims] = ints
    random = np.random.default_rng(size)
    for _ in range(3):
        out *= random.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pairs = out.reshape(n, size // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
            half *= 2
        out /= math.sqrt(size)
    return out


def coded(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign codes (row, level, word), alignments (row, level) and norms of the last residual."""
    rest = rotated(ints)
    n, size = rest.shape
    codes, aligned = np.empty((n, LEVELS, size // 64), np.uint64), np.empty((n, LEVELS))
    for level in range(LEVELS):
        up = rest >= 0
        codes[:, level] = np.packbits(up, axis=1, bitorder="little").view("<u8")
        aligned[:, level] = np.abs(rest).sum(1) / math.sqrt(size)
        rest = rest - np.where(up, 1, -1) * aligned[:, level, None] / math.sqrt(size)
    return codes, aligned, np.linalg.norm(rest, axis=1)


def code_rows(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding -> the rows that take part, with integers, codes and alignments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            start = vectors.offsets.to_numpy()
            dims, flat = np.diff(start), vectors.values.to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                ints = np.floor(SCALE * flat[start[at][:, None] + np.arange(d)].astype(np.float64)).reshape(len(at), d)
                fits = (ints**2).sum(1) < 2.0**62 * (1 - 1e-9)
                at, ints = at[fits], ints[fits]
                codes, aligned, rest = coded(ints)
                own = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32))]
                own += [pa.array([x.tobytes() for x in y], pa.binary()) for y in (ints.astype("<i4"), codes, aligned)]
                own += [pa.array(rest), pa.array(np.linalg.norm(ints, axis=1))]
                yield pa.RecordBatch.from_arrays(own, [x.split()[0] for x in CODED.split(", ")])

    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    usable &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    part = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return part.filter(usable).mapInArrow(run, CODED)


class Group:
    """Rows of one number of components, as arrays."""

    def __init__(self, dims: int, ids: list, labels: list, ints: list[bytes]):
        self.dims, self.ids, self.labels = dims, np.array(ids, np.int64), np.array(labels, np.int64)
        self.ints = np.frombuffer(b"".join(ints), "<i4").reshape(len(ids), dims).astype(np.int64)


class Queries(Group):
    """Anchors with their rotated vectors in eight bit planes."""

    def prepare(self) -> None:
        if hasattr(self, "planes"):
            return
        turned = rotated(self.ints.astype(np.float64))
        self.norm = np.linalg.norm(turned, axis=1)
        self.step = np.maximum(np.abs(turned).max(axis=1, initial=0), 1e-300) / 127
        whole = np.rint(turned / self.step[:, None])
        self.sum = whole.sum(1)
        self.off = np.linalg.norm(turned - whole * self.step[:, None], axis=1)
        shifted = (whole + 128).astype(np.uint8)
        self.planes = np.stack([np.packbits(shifted >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(8)], 1)


class Rows(Group):
    """Rows with their codes."""

    def __init__(self, dims: int, columns: list[list]):
        ids, labels, _, ints, codes, aligned, self.rest, self.norm = columns
        super().__init__(dims, [NULL_ID if x is None else x for x in ids], labels, ints)
        self.codes = np.frombuffer(b"".join(codes), "<u8").reshape(len(ids), LEVELS, -1)
        self.aligned = np.frombuffer(b"".join(aligned)).reshape(len(ids), LEVELS)
        self.rest, self.norm = np.array(self.rest), np.array(self.norm)


def product(planes: np.ndarray, sums: np.ndarray, steps: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of queries held in bit planes with codes, by popcounts of their words."""
    size = 64 * codes.shape[-1]
    ones = np.bitwise_count(codes).sum(-1, dtype=np.int64)
    total = -128 * ones
    for j in range(8):
        total = total + (np.bitwise_count(planes[..., j, :] & codes).sum(-1, dtype=np.int64) << j)
    return (2 * total - sums) * steps / math.sqrt(size)


def survivors(q: Queries, r: Rows, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``asked`` whose interval meets the anchor's [low, high], scored.

    The interval shrinks from level to level, and each level looks only at what is left.
    """
    q.prepare()
    a, b = np.nonzero(asked)
    estimate, below = np.zeros(len(a)), r.norm**2
    for level in range(LEVELS):
        if not len(a):
            break
        t = r.aligned[b, level]
        along = np.concatenate([product(q.planes[a[i:j]], q.sum[a[i:j]], q.step[a[i:j]], r.codes[b[i:j], level]) for i, j in _cuts(len(a), q.planes.shape[-1] * 16)])
        estimate = estimate + t * along
        below = np.maximum(below - r.aligned[:, level] ** 2, 0)  # squared norm of the residual
        left = np.sqrt(below)[b] if level < LEVELS - 1 else r.rest[b]
        across = np.sqrt(np.maximum(q.norm[a] ** 2 - np.maximum(np.abs(along) - q.off[a], 0) ** 2, 0))  # the query's part at right angles to the code
        most = across * left + q.off[a] * (r.norm[b] + left) + SLACK * q.norm[a] * r.norm[b] + 1e-6
        stay = (estimate + most >= low[a]) & (estimate - most <= high[a])
        a, b, estimate = a[stay], b[stay], estimate[stay]
    score = [np.einsum("ij,ij->i", q.ints[a[i:j]], r.ints[b[i:j]]) for i, j in _cuts(len(a), q.dims)]
    return a, b, np.concatenate([np.empty(0, np.int64), *score])


def _cuts(n: int, width: int) -> Iterator[tuple[int, int]]:
    step = max(1, SCORED // max(1, width))
    return ((i, min(n, i + step)) for i in range(0, max(n, 1), step))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            dims = np.array(part.column(2))
            for d in np.unique(dims).tolist():
                yield Rows(d, [c.to_pylist() for c in part.filter(pa.array(dims == d)).columns])


def _scan(rows: DataFrame, block: object, k: int, slots: int, look: Callable, result: Callable, schema: str) -> DataFrame:
    """The best rows of each (anchor, slot) of a block: ``look`` gives (key, score, id) of the
    rows of a group, ``result`` the arrays of a task's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(len(q.ids) * slots, k) for d, q in block.value["queries"].items()}
        for r in _groups(batches):
            if (q := block.value["queries"].get(r.dims)) is not None:
                best[r.dims].add(*look(q, r, best[r.dims], block.value))
        for d, found in best.items():
            yield pa.RecordBatch.from_arrays(result(d, found, block.value), [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


FOUND = "dims int, anchor int, slot int, id bigint, score bigint"


def _arrays(d: int, best: Best, slots: int) -> list[pa.Array]:
    n = len(best.key)
    return [pa.array(np.full(n, d, np.int32)), pa.array((best.key // slots).astype(np.int32)), pa.array((best.key % slots).astype(np.int32)), pa.array(best.id), pa.array(best.score)]


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (dims, anchor, slot), with their rank."""
    order = Window.partitionBy("dims", "anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(q: Queries, r: Rows, best: Best, _: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    asked = (q.labels[:, None] == r.labels[None, :]) & (q.ids[:, None] != r.ids[None, :])
    a, b, score = survivors(q, r, asked, best.floor.astype(np.float64), np.full(len(q.ids), np.inf))
    return a, score, r.ids[b]


def _negatives(q: Queries, r: Rows, best: Best, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = block["bands"][r.dims]  # by anchor and positive; low > high where there is none
    slots = low.shape[1]
    none = low > high
    least = np.where(none, np.inf, np.maximum(low, best.floor.reshape(low.shape).astype(np.float64)))
    most = np.where(none, -np.inf, high)
    asked = (q.labels[:, None] != r.labels[None, :]) & (q.ids[:, None] != r.ids[None, :])
    a, b, score = survivors(q, r, asked, least.min(1), most.max(1))
    pair, slot = np.nonzero((score[:, None] >= low[a]) & (score[:, None] <= high[a]))
    return a[pair] * slots + slot, score[pair], r.ids[b[pair]]


def _of_block(rows: DataFrame, anchors: list, positives: int, negatives: int, percents: tuple[int, int]) -> DataFrame:
    context = rows.sparkSession.sparkContext
    queries = {d: Queries(d, *zip(*((x.vec_id, x.label, x.ints) for x in anchors if x.dims == d))) for d in {x.dims for x in anchors}}
    block = context.broadcast({"queries": queries})
    near = _first(_scan(rows, block, positives, 1, _positives, lambda d, best, _: _arrays(d, best, 1), FOUND), positives).collect()  # `positives` for each anchor
    bands = {d: (np.ones((len(q.ids), positives), np.int64), np.zeros((len(q.ids), positives), np.int64)) for d, q in queries.items()}
    held = []
    for x in near:
        low, high = bands[x.dims]
        low[x.anchor, x["rank"] - 1] = -(-percents[0] * x.score // 100)
        high[x.anchor, x["rank"] - 1] = percents[1] * x.score // 100
        anchor = int(queries[x.dims].ids[x.anchor])
        held.append((x.dims, x.anchor, x["rank"] - 1, anchor, None if x.id == NULL_ID else x.id, x.score))
    both = context.broadcast({"queries": queries, "bands": bands})
    far = _first(_scan(rows, both, negatives, positives, _negatives, lambda d, best, _: _arrays(d, best, positives), FOUND), negatives)
    named = rows.sparkSession.createDataFrame(held, "dims int, anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint")
    negative: Column = F.when(F.col("id") != NULL_ID, F.col("id"))
    return far.join(F.broadcast(named), ["dims", "anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", negative.alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LOW_PERCENT, HIGH_PERCENT),
    block_components: int = BLOCK_COMPONENTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    held = materialize(code_rows(rows))
    anchors = held.filter(is_anchor & F.col("vec_id").isNotNull()).select("vec_id", "label", "dims", "ints").distinct()
    anchors = materialize(anchors.withColumn("spread", F.xxhash64("vec_id", "label", "ints")))
    size = anchors.agg(F.sum(F.col("dims").cast("bigint") + 8)).first()[0]
    blocks = max(1, math.ceil((size or 0) / block_components))
    found = []
    for b in range(blocks):
        own = anchors.filter(F.pmod(F.col("spread"), F.lit(blocks)) == b).collect()  # block_components, about
        if own:
            one = _of_block(held, own, positives, negatives, percents)
            found.append(one if blocks == 1 else materialize(one))
    if not found:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    every = found[0]
    for one in found[1:]:
        every = every.union(one)
    return every
