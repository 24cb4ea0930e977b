"""Byte-level BPE encoding and decoding with a local rank file.

A null text counts as empty and gives no tokens. Every document gives one row, repeated ones
too; columns beyond doc_id and text are not read. Texts of any length are encoded whole: long
ones are cut at safe boundaries first, so the pattern runs over a piece at a time; a stretch
without a safe boundary is one piece, whatever its length. Runs of RUN_CHARS white-space
characters and more, of any length, are encoded without the pattern, which would go back over
them character by character until its stack ends: such a run is one match of the pattern, but
for its last character where something else follows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: Code points after which a long text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: Before a space between two letters or digits the pattern always starts a match: every
#: alternative takes a space at its start only, or in a run of white space, and no such run
#: covers a space that follows a letter or digit and precedes another.
#: White space as the pattern takes it, in runs that it need not see.
RUN_CHARS = 4096
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN_CHARS)
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces whose concatenation is the text and whose encodings concatenate to its own."""
    out, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a whole text."""
    if len(text) < RUN_CHARS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last one may belong to what follows
        for piece in safe_pieces(text[at : run.start()]):
            out += enc.encode_ordinary(piece)
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    for piece in safe_pieces(text[at:]):
        out += enc.encode_ordinary(piece)
    return out


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip and, if asked for, ids.

    ``rank_file`` must be at the same path on every machine. The ids are hashed as
    little-endian unsigned 32-bit integers.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(enc, text or "")
                raw = enc.decode_bytes(ids)
                values = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == (text or "").encode())
                for col, value in zip(cols, values):
                    col.append(value)
                cols[4].append(ids if with_ids else None)
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[4], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
