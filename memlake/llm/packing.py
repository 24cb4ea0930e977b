"""Best-fit packing of tokenised documents into sequences of bounded length.

A document's tokens are its ids and one end id. Only documents longer than a sequence are cut:
into full pieces, of which the first may be shorter. A null text is an empty one and has the
end id alone. Every row is packed, repeated ones too; columns beyond doc_id and text are not
read; an empty table gives an empty result. Pieces of one length are alike to the plan and take
its places in the order of the input, and of equal gaps the plan takes the one made first: ties
never change the number of sequences. A very long text is encoded piece by piece at safe cuts.

How the packing is spread. Only a piece's length matters to a packing, and there are at most
``capacity`` lengths. So the pieces are counted by length, the packing is computed on the
counts (a plan of at most a few thousand patterns, whatever the input's size), and each piece
finds its place in the plan by its rank among the pieces of its length. Ranks come from counts
by (input partition, length) and running sums over them: no key's rows ever meet in one task.

The plan matches large items first: lengths above a third of the capacity lie at most twice in
a sequence, and the largest left always takes the largest partner that fits. Smaller lengths
then go, from the largest down, to the sequence with the smallest gap that holds them.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import bpe
from memlake.llm.common import materialize

CAPACITY = 1024
END_ID = 2
#: Characters of the words in each of the two generations of a worker's cache, each word counting
#: WORD_COST more; words of more than LONG_WORD characters are never kept.
CACHE_CHARS, WORD_COST, LONG_WORD = 30_000_000, 150, 64
_RUN = re.compile(r"^\s|\s\s|\s\Z")

PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token of a byte-level BPE file of ``tokenizers``, special ones left out.

    Such a file writes byte b as the character b where that is printable and not white space,
    and the others, in order, as the characters from 256 on.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a file of ``tokenizers``, which it finds in a text before all else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens", [])
    odd = [x["content"] for x in found if any(x.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"added tokens that are not matched as they stand: {odd}")
    return {x["content"]: x["id"] for x in found}


class WordEncoder:
    """Ids of whole texts as ``tokenizers`` gives them, with a bounded cache of encoded words.

    ``ids`` takes added tokens in a text for plain text; ``document_ids`` gives them their own ids.

    In a byte-level BPE file whose ids follow its merges, merging by id is merging by rank, so
    the merges run in tiktoken, several times as fast; tests hold the ids against
    ``tokenizers`` itself. A text without two white-space characters in a row falls into words
    at its spaces and line ends: there the pattern always ends a match. Words not met before
    are encoded in one call, and two generations bound the cache. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        ranks = byte_level_ranks(path)
        self._bpe = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._length[rank] = len(token)
        added = added_tokens(path)
        self._added = {token: np.array([i], "<u4").tobytes() for token, i in added.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0

    def _whole(self, text: str) -> bytes:
        return np.array(bpe.encode(self._bpe, text), "<u4").tobytes()

    def _add(self, words: list[str]) -> None:
        """Encode words at once: each begins with its one white-space character."""
        spelled = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.array(self._bpe.encode_ordinary("".join(spelled)), "<u4")
        ends = np.searchsorted(np.cumsum(self._length[ids]), np.cumsum([len(w.encode()) for w in spelled])) + 1
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self._young[word] = raw[start:end]
            start = end

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [None if not x or _RUN.search(x) else ("\n" + x).replace("\n", " \n").split(" ")[1:] for x in texts]
        young, old = self._young, self._old
        missing: dict[str, None] = {}
        for words in parts:
            for w in words or ():
                if w not in young:
                    if (known := old.get(w)) is not None:
                        young[w] = known
                        self._held += len(w) + WORD_COST
                    else:
                        missing[w] = None
        if missing:
            self._add(list(missing))
        line_end = 4 * len(self._bpe.encode_ordinary("\n"))
        out = [self._whole(x) if words is None else b"".join(map(young.__getitem__, words))[line_end:] for x, words in zip(texts, parts)]
        for word in missing:
            if len(word) > LONG_WORD:
                del young[word]
            else:
                self._held += len(word) + WORD_COST
        if self._held > CACHE_CHARS:
            self._old, self._young, self._held = young, {}, 0
        return out

    def document_ids(self, texts: list[str]) -> list[bytes]:
        """Like ``ids``, but the text is cut at added tokens first and these have their own ids."""
        if self._split is None:
            return self.ids(texts)
        parts = [self._split.split(x) for x in texts]  # text and added token by turns
        plain = iter(self.ids([x for some in parts for x in some[::2]]))
        return [b"".join(self._added[x] if k % 2 else next(plain) for k, x in enumerate(some)) for some in parts]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32 of the ids) of each piece."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, with the input partition and the rank in it by length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = _encoder(tokenizer_file), {}, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.document_ids([x or "" for x in some.column(1).to_pylist()])):
                    for k, (start, length, crc) in enumerate(cut(ids + end, capacity)):
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        rows.append((doc_id, k, start, length, crc, part, rank))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in PIECES_SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, PIECES_SCHEMA)


@dataclass
class Bins:
    """``count`` sequences with the same contents: (length, how many) in order."""

    count: int
    contents: tuple[tuple[int, int], ...]


def plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Patterns that hold ``counts[length]`` pieces of each length.

    At most two patterns are opened for each length, besides those that a split leaves over,
    so their number is bounded by the capacity and not by the pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    by_gap: dict[int, list[Bins]] = {}

    def put(bins: Bins) -> None:
        if bins.count:
            by_gap.setdefault(capacity - sum(s * k for s, k in bins.contents), []).append(bins)

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:  # the largest first, with the largest partner that fits
        while left[s]:
            partner = next((p for p in large if left[p] and p <= capacity - s and (p != s or left[s] > 1)), None)
            if partner is None:
                put(Bins(left[s], ((s, 1),)))
                left[s] = 0
            elif partner == s:
                put(Bins(left[s] // 2, ((s, 2),)))
                left[s] %= 2
            else:
                n = min(left[s], left[partner])
                put(Bins(n, ((s, 1), (partner, 1))))
                left[s] -= n
                left[partner] -= n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        for gap in sorted(g for g in by_gap if g >= s):
            fit = gap // s
            for bins in by_gap.pop(gap):
                full = min(bins.count, n // fit)
                rest = n - full * fit if full < bins.count else 0
                put(Bins(full, (*bins.contents, (s, fit))))
                if rest:
                    put(Bins(1, (*bins.contents, (s, rest))))
                put(Bins(bins.count - full - bool(rest), bins.contents))
                n -= full * fit + rest
            if not n:
                break
        if n:
            fit = capacity // s
            put(Bins(n // fit, ((s, fit),)))
            put(Bins(int(n % fit > 0), ((s, n % fit),)))
    return [bins for gap in sorted(by_gap) for bins in by_gap[gap]]


def places(patterns: list[Bins]) -> pd.DataFrame:
    """The plan by length and rank: from ``first`` on, ``each`` pieces of the length go to
    each sequence from ``base`` on, from ``offset`` on in it."""
    rows, used, base = [], {}, 0
    for bins in patterns:
        offset = 0
        for s, k in bins.contents:
            rows.append((s, used.get(s, 0), k, base, offset))
            used[s] = used.get(s, 0) + bins.count * k
            offset += s * k
        base += bins.count
    return pd.DataFrame(rows, columns=["length", "first", "each", "base", "offset"]).sort_values(["length", "first"], ignore_index=True)


def place(ranked: DataFrame, table: pd.DataFrame) -> DataFrame:
    """sequence_id and offset for pieces with their rank among those of their length."""
    columns = {c: table[c].to_numpy(np.int64) for c in table}
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(columns["length"], np.arange(columns["length"].max(initial=0) + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(rank), np.int64)
            for s in np.unique(length):
                a, b = edges[s], edges[s + 1]
                row[length == s] = a + np.searchsorted(columns["first"][a:b], rank[length == s], side="right") - 1
            inside = rank - columns["first"][row]
            sequence = columns["base"][row] + inside // columns["each"][row]
            offset = columns["offset"][row] + inside % columns["each"][row] * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [x.split()[0] for x in schema.split(", ")])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # the ranks in a partition hold only for this very reading of it, so it is written down
    cutup = materialize(pieces(docs, tokenizer_file, capacity, end_id))
    counts = materialize(cutup.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranked = cutup.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    return place(ranked, places(plan(total, capacity)))
