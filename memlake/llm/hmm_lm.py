"""Hidden Markov language model, trained on all documents that are not held out.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, then one end
token; a null text is an empty one. The base score is that of add-half unigrams over the
training tokens.

The model. A hidden state follows a Markov chain; each token is emitted in two steps, a word
class by the state and the word by the class:

    P(w | s) = P(k(w) | s) * (c(w) + 1/2) / (C_k + (V_k + 1) / 2)

with c the word's training count and C_k, V_k the class's count and distinct words; the half
left over in each class is the chance of an unseen word. A word with 1/HEAD_SHARE of the
training tokens or more is a class of its own, as is the end token; the others share
``TAIL_CLASSES`` classes by a hash of their last three bytes. So the parameters are bounded by
the class number, whatever the vocabulary, and may go to every task; counts of words are not,
and are joined by shuffles.

The steps, all of them over every document:
1. Blocks of some million tokens number their own words: documents as local numbers, and
   (block, word, training count).
2. Counts are summed over blocks by word (a word is one row per block, so a hot word is
   spread thin) and sent back to the blocks in packed form.
3. Each block turns its documents to class sequences with the sum of log10(c + 1/2).
4. Baum-Welch: expected counts of starts, transitions and emissions are computed per
   partition and summed by class, over whole documents.
5. The scaled forward recursion gives each document's exact likelihood, over its whole length.

Both recursions go through chunks of ``CHUNK_TOKENS`` tokens side by side. What a chunk of a
longer document begins and ends with follows from the chunks' products of transitions and
emissions, small matrices, so cutting changes nothing but the order of the work.

Defined cases: rows are never merged, so repeated ones are scored and trained on repeatedly;
a very long text is one sequence of one block;
rows with a null doc_id belong to the training documents; with no training tokens the model is
uniform over one unseen word, score and base_score being the same formula with zero counts;
an empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import materialize
from memlake.llm.shingles import ascii_lower_words

HEAD_SHARE = 1 << 14
TAIL_CLASSES = 2048
BLOCK_TOKENS = 3_000_000
STATES = 6
ITERATIONS = 6
CHUNK_TOKENS = 1024
#: Steps after which products of chances are brought back to the size of one.
RESCALE = 8
#: Tokens that are taken through a recursion together.
BATCH_TOKENS = 1 << 20
#: A class's prior weight in each state, in tokens, spread by the classes' frequencies.
PRIOR = 10.0
END = b""  # no word is empty


def _arrow(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


_ENCODED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("word", pa.binary()), ("local", pa.int32()), ("n", pa.int64()), ("block_n", pa.int64())])


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Kind 0: documents as local word numbers. Kind 1: a block's words, training counts and
    training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, rows, tokens = TaskContext.get().partitionId() << 32, {}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nothing = [None] * len(rows)
            yield _arrow({"kind": [0] * len(rows), "block": [block] * len(rows), "doc_id": [r[0] for r in rows], "held_out": [r[1] for r in rows], "ids": [r[2].tobytes() for r in rows], "word": nothing, "local": nothing, "n": nothing, "block_n": nothing}, _ENCODED)
            trained = [r[2] for r in rows if not r[1]]
            n = np.bincount(np.concatenate(trained), minlength=len(index)) if trained else np.zeros(len(index), np.int64)
            words, total = list(index), int(n.sum())
            for i in range(0, len(words), 100_000):
                some = words[i : i + 100_000]
                nothing = [None] * len(some)
                yield _arrow({"kind": [1] * len(some), "block": [block] * len(some), "doc_id": nothing, "held_out": nothing, "ids": nothing, "word": some, "local": np.arange(i, i + len(some)), "n": n[i : i + len(some)], "block_n": [total] * len(some)}, _ENCODED)

        for batch in batches:
            for doc_id, text, held_out in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = ascii_lower_words(text)
                words.append(END)
                ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words))
                rows.append((doc_id, held_out, ids))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
                    block, index, rows, tokens = block + 1, {}, [], 0
        if rows:
            yield from flush()

    schema = "kind int, block bigint, doc_id bigint, held_out boolean, ids binary, word binary, local int, n bigint, block_n bigint"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "held_out").mapInArrow(run, schema)


def head_words(vocabulary: DataFrame) -> list[bytes]:
    """At most HEAD_SHARE frequent words, by name. A word with that share of all tokens has it
    in some block, so only such words are summed, over all their blocks."""
    total = vocabulary.groupBy("block").agg(F.max("block_n").alias("n")).agg(F.sum("n")).first()[0] or 0
    # written down, so that Spark knows its size when it picks the join
    named = materialize(vocabulary.filter((F.col("n") * HEAD_SHARE >= F.greatest("block_n", F.lit(1))) & (F.length("word") > 0)).select("word").distinct())
    frequent = vocabulary.select("word", "n").join(named, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    found = frequent.filter(F.col("n") * HEAD_SHARE >= max(total, 1)).collect()
    return sorted(bytes(r.word) for r in found)


@dataclass(frozen=True)
class Classes:
    """Class 0 is the end token's, then the head words' and the shared ones."""

    head: dict[bytes, int]

    @staticmethod
    def of(words: list[bytes]) -> Classes:
        return Classes({END: 0} | {w: i for i, w in enumerate(words, 1)})

    def __len__(self) -> int:
        return len(self.head) + TAIL_CLASSES

    def number(self, word: bytes) -> int:
        found = self.head.get(word)
        return len(self.head) + zlib.crc32(word[-3:]) % TAIL_CLASSES if found is None else found


_COUNTED = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("class", pa.int32()), ("distinct", pa.int64()), ("tokens", pa.int64())])


def counts_by_block(vocabulary: DataFrame, classes: Classes) -> DataFrame:
    """Packed (local number, class, count) of the blocks' words (block, words), and each task's
    distinct words and tokens of a class (class, distinct, tokens), the other columns being null."""
    word = Window.partitionBy("word")
    counted = vocabulary.select("word", "block", "local", F.sum("n").over(word).alias("c"), F.row_number().over(word.orderBy("block")).alias("k"))

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        found = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _COUNTED]
        return pa.RecordBatch.from_arrays(found, schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped, held = Classes(classes.head), {}
        distinct, tokens = np.zeros(len(shipped), np.int64), np.zeros(len(shipped), np.int64)
        for batch in batches:
            words, block, local, c, k = (batch.column(i) for i in range(5))
            number = np.array([shipped.number(w) for w in words.to_pylist()], np.int64)
            block, local, c, k = (x.to_numpy() for x in (block, local, c, k))
            first = (k == 1) & (c > 0)
            distinct += np.bincount(number[first], minlength=len(distinct))
            tokens += np.bincount(number[first], c[first], len(tokens)).astype(np.int64)
            packed = np.stack([local.astype(np.int64), number, c], axis=1)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(part):
                    held.setdefault(int(block[part[0]]), []).append(packed[part])
            if sum(len(x) for parts in held.values() for x in parts) > 1_000_000:
                yield rows_of(block=list(held), words=[_pack(np.concatenate(x)) for x in held.values()])
                held.clear()
        if held:
            yield rows_of(block=list(held), words=[_pack(np.concatenate(x)) for x in held.values()])
        some = np.flatnonzero(distinct)
        yield rows_of(**{"class": some, "distinct": distinct[some], "tokens": tokens[some]})

    return counted.mapInArrow(run, "block bigint, words binary, class int, distinct bigint, tokens bigint")


def _pack(rows: np.ndarray) -> bytes:
    """Rows of three numbers, compressed column by column."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    return zlib.compress(np.concatenate([np.diff(rows[:, 0], prepend=0), rows[:, 1], rows[:, 2]]).astype("<i8").tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    rows = np.frombuffer(zlib.decompress(raw), "<i8").reshape(3, -1).T.copy()
    rows[:, 0] = np.cumsum(rows[:, 0])
    return rows


_CODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, classes binary"


def _code(key: tuple, docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """A block's documents as class sequences."""
    rows = np.concatenate([_unpack(x) for x in words.words]) if len(words) else np.empty((0, 3), np.int64)
    number, c = np.zeros(len(rows), np.uint16), np.zeros(len(rows), np.int64)
    number[rows[:, 0]], c[rows[:, 0]] = rows[:, 1], rows[:, 2]
    log_c = np.log10(c + 0.5)
    ids = [np.frombuffer(x, np.int32) for x in docs.ids]
    return pd.DataFrame({
        "doc_id": docs.doc_id.astype("Int64"), "held_out": docs.held_out.astype("boolean"), "n_tokens": [len(x) for x in ids],
        "n_known": [int((c[x] > 0).sum()) for x in ids], "log_counts": [float(log_c[x].sum()) for x in ids],
        "classes": [number[x].astype("<u2").tobytes() for x in ids],
    })


@dataclass
class Params:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states: P(class | state)


def initial(tokens: np.ndarray, states: int = STATES, seed: int = 7) -> Params:
    """Sticky states with class frequencies that differ by random factors."""
    share = (tokens + 0.5) / (tokens + 0.5).sum()
    emit = share[:, None] * np.random.default_rng(seed).uniform(0.4, 1.6, (len(tokens), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Params(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Layout:
    """Chunks of sequences side by side, the longest first: all their first tokens, then all
    second ones, and so on."""

    def __init__(self, sequences: list[np.ndarray]):
        parts = [(i, j) for i, s in enumerate(sequences) for j in range(0, len(s), CHUNK_TOKENS)]
        chunks = [sequences[i][j : j + CHUNK_TOKENS] for i, j in parts]
        lengths = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths, owner = lengths[order], np.array([i for i, _ in parts], np.int64)[order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0))  # chunks longer than t
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        at = self.offset[np.concatenate([np.arange(n) for n in lengths])] + np.repeat(np.arange(len(lengths)), lengths)
        self.classes, self.sequence = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        self.classes[at] = np.concatenate([chunks[i] for i in order])
        self.sequence[at] = np.repeat(owner, lengths)
        self.last = self.offset[lengths - 1] + np.arange(len(lengths))  # place of a chunk's last token
        chain = np.array([rank[k - 1] if j else -1 for k, (_, j) in enumerate(parts)], np.int64)
        self.before = chain[order]  # the chunk before, or -1
        #: chunks of each sequence of several, in order
        self.chains = [rank[k] for k in np.split(np.arange(len(parts)), np.flatnonzero(chain < 0)[1:]) if len(k) > 1]


def carried(layout: Layout, p: Params, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each chunk begins with (chances of states before its first token, given all tokens
    before it) and ends with (relative chances of all tokens after it, given its last state)."""
    states, n = len(p.start), len(layout.before)
    begin, end = np.tile(p.start, (n, 1)), np.ones((n, states))
    if not layout.chains:
        return begin, end
    some = np.sort(np.concatenate(layout.chains))
    product = np.eye(states) * b[some][:, None, :]
    for t in range(1, len(layout.active)):
        k = np.searchsorted(some, layout.active[t])
        if not k:
            break
        longer = (product[:k].reshape(-1, states) @ p.move).reshape(k, states, states)
        longer *= b[layout.offset[t] + some[:k]][:, None, :]
        if t % RESCALE == 0:
            longer /= longer.max(axis=(1, 2), keepdims=True)
        product[:k] = longer
    place = np.searchsorted(some, np.arange(n))
    for chain in layout.chains:
        x = p.start
        for r in chain:
            begin[r] = x
            x = x @ product[place[r]]
            x = x / x.sum() @ p.move
        x = np.ones(states)
        for r in chain[::-1]:
            end[r] = x
            x = product[place[r]] @ x
            x = p.move @ (x / x.max())
    return begin, end


def forward(layout: Layout, p: Params, keep: bool) -> tuple[np.ndarray, np.ndarray | None, tuple]:
    """Scales of all tokens, whose logs sum to a sequence's log likelihood, to ``keep`` the scaled
    state chances, and the emissions with what the chunks begin and end with."""
    b = p.emit[layout.classes]
    begin, end = carried(layout, p, b)
    scales, kept = np.empty(len(b)), np.empty_like(b) if keep else None
    alpha = None
    for t, n in enumerate(layout.active.tolist()):
        o = layout.offset[t]
        alpha = (begin[:n] if alpha is None else alpha[:n] @ p.move) * b[o : o + n]
        s = alpha.sum(axis=1)
        alpha /= s[:, None]
        scales[o : o + n] = s
        if keep:
            kept[o : o + n] = alpha
    return scales, kept, (b, begin, end)


def expected(layout: Layout, p: Params) -> tuple[Params, float]:
    """Expected counts (not yet chances) of a batch of sequences, and its log likelihood."""
    scales, alpha, (b, begin, end) = forward(layout, p, True)
    states = len(p.start)
    weighed = b / scales[:, None]
    gamma, moves = np.empty_like(alpha), np.zeros_like(p.move)
    beta = np.ones((0, states))
    active = [*layout.active.tolist(), 0]
    for t in range(len(active) - 2, -1, -1):
        o, n, m = layout.offset[t], active[t], active[t + 1]
        if m:
            o2 = layout.offset[t + 1]
            after = weighed[o2 : o2 + m] * beta
            moves += alpha[o : o + m].T @ after
            beta = after @ p.move.T
        if n > m:  # chunks that end here
            closing = end[m:n] / (alpha[o + m : o + n] * end[m:n]).sum(axis=1, keepdims=True)
            beta = np.concatenate([beta, closing]) if m else closing
        gamma[o : o + n] = alpha[o : o + n] * beta
    first, later = gamma[: active[0]], layout.before >= 0
    moves += alpha[layout.last[layout.before[later]]].T @ (first[later] / begin[later])
    emit = np.stack([np.bincount(layout.classes, gamma[:, s], len(p.emit)) for s in range(states)], axis=1)
    return Params(first[~later].sum(axis=0), moves * p.move, emit), float(np.log10(scales).sum())


def _batches(batches: Iterator[pa.RecordBatch], of) -> Iterator[list]:
    """Items of ``of(row)`` in lists of about BATCH_TOKENS tokens (an item's second entry)."""
    out, tokens = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            for item in of(row):
                out.append(item)
                tokens += len(item[1])
                if tokens >= BATCH_TOKENS:
                    yield out
                    out, tokens = [], 0
    if out:
        yield out


def step(coded: DataFrame, p: Params, tokens: np.ndarray) -> tuple[Params, float]:
    """One round of Baum-Welch over all training documents."""
    states, shipped = len(p.start), coded.sparkSession.sparkContext.broadcast(p)
    schema = pa.schema([("class", pa.int64()), *((f"s{i}", pa.float64()) for i in range(states))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total, log_p = shipped.value, None, 0.0
        for items in _batches(batches, lambda row: [(None, np.frombuffer(row["classes"], "<u2"))]):
            got, l = expected(Layout([x for _, x in items]), here)
            total = got if total is None else Params(total.start + got.start, total.move + got.move, total.emit + got.emit)
            log_p += l
        if total is not None:  # classes, then starts, then moves, then the likelihood
            rows = np.concatenate([total.emit, total.start[None], total.move, np.full((1, states), log_p)])
            names = np.concatenate([np.arange(len(total.emit)), -1 - np.arange(states + 2)])
            some = rows.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), *(pa.array(rows[some, i]) for i in range(states))], schema=schema)

    parts = coded.filter("not held_out").select("classes").mapInArrow(run, "class bigint, " + ", ".join(f"s{i} double" for i in range(states)))
    rows = parts.groupBy("class").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(states))).toPandas()  # a row per class
    shipped.destroy()
    at, values = rows["class"].to_numpy(), rows[[f"s{i}" for i in range(states)]].to_numpy()
    full = np.zeros((len(p.emit) + states + 2, states))
    full[np.where(at >= 0, at, len(p.emit) - 1 - at)] = values
    share = (tokens + 0.5) / (tokens + 0.5).sum()
    emit = full[: len(p.emit)] + PRIOR * share[:, None]
    start, move = full[len(p.emit)] + 0.1, full[len(p.emit) + 1 : -1] + 0.1
    return Params(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), float(full[-1, 0])


def score_documents(docs: DataFrame, iterations: int = ITERATIONS, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; ``docs`` has
    doc_id, text and held_out."""
    encoded = materialize(encode_blocks(docs), ["kind"])
    vocabulary = encoded.filter("kind = 1").select("block", "word", "local", "n", "block_n")
    classes = Classes.of(head_words(vocabulary))
    blocks = encoded.filter("kind = 0").select("block", "doc_id", "held_out", "ids")
    counted = materialize(counts_by_block(vocabulary, classes))
    words = counted.filter("words is not null").select("block", "words")
    coded = materialize(blocks.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(_code, _CODED))
    sums = np.zeros((len(classes), 2), np.int64)  # distinct words and tokens by class
    by_class = counted.filter("class is not null").groupBy("class").agg(F.sum("distinct").alias("distinct"), F.sum("tokens").alias("tokens"))
    for row in by_class.collect():  # a row per class
        sums[row["class"]] = row["distinct"], row["tokens"]
    total, kinds, tokens = int(sums[:, 1].sum()), int(sums[:, 0].sum()), sums[:, 1].astype(float)
    p = initial(tokens, states)
    for _ in range(iterations if total else 0):
        p, _ = step(coded, p, tokens)
    # the class's share of log10 P(w | class) goes into the emissions; a class of one word has no other
    p = Params(p.start, p.move, p.emit / _room(sums, len(classes.head))[:, None])
    shipped = coded.sparkSession.sparkContext.broadcast((p, len(classes.head)))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    bottom = np.log10(total + 0.5 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, _ = shipped.value
        for items in _batches(batches, lambda row: [(row, np.frombuffer(row["classes"], "<u2"))]):
            layout = Layout([x for _, x in items])
            found = np.bincount(layout.sequence, np.log10(forward(layout, here, False)[0]), len(items))
            rows = [r for r, _ in items]
            out = {k: [r[k] for r in rows] for k in ("doc_id", "held_out", "n_tokens", "n_known")}
            out |= {"train_tokens": [total] * len(rows), "base_score": [r["log_counts"] - r["n_tokens"] * bottom for r in rows], "score": [r["log_counts"] + s for r, s in zip(rows, found)]}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    return coded.mapInArrow(run, schema)


def _room(sums: np.ndarray, heads: int) -> np.ndarray:
    """C_k + (V_k + 1) / 2; a head class's is its word's count plus 1/2, so the word gets 1."""
    room = sums[:, 1] + 0.5 * (sums[:, 0] + 1)
    room[:heads] = sums[:heads, 1] + 0.5
    return room
