"""Language identification, word first with backoff to character n-grams.

Words are runs of letters, lower-cased. From the training documents (text and a non-null
language) come counts of words and of the words' character n-grams by language. Every word that
a training document has is *known*: it scores the log of its smoothed frequency in each
language. Another word is scored by its n-grams: at each position the longest known one of
n = 5 to 1 counts, by the log of its smoothed frequency in each language; an n-gram is known if
any training word has it. Neither words nor n-grams have a bound, and both are joined by shuffles;
the texts are read twice:

1. Counts of all words are summed up by language. The n-grams are counted from the words known.
2. The words that are not known are dealt into blocks; each asks once for every n-gram that its
   words have, gets the counts of those that are known, and scores its words.
3. Every task has the scores of the HEAD most frequent words and sums them up by document. Blocks
   of some million rarer tokens number their own words: documents as local numbers, many to a
   packed row, and (block, word, local number).
4. The rarer words' scores go back to the blocks in packed form (a word is one row per block),
   and each block completes its documents' sums.

A document takes the language of the largest mean over its words; equal means take the first
name. ``score`` is that language's share after normalising (softmax) the mean log frequencies
times ``SHARPNESS``, which stands for the number of independent words.

Defined cases: null texts and texts without a letter give ``und`` with score 0, as does every
text when nothing can be learned; a very long text is read whole, in one block; rows are never
merged, so repeated ones give repeated results; columns beyond doc_id, text and lang are not
read, and lang only where it trains; an empty table gives an empty result. There is a column of
counts for each learned language, so languages are expected to be some hundreds at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import SALTS, materialize, rows_of, sifted
from memlake.llm.shingles import _mix

LONGEST = 5
#: The most frequent words whose scores every task has.
HEAD = 1 << 17
SHARPNESS = 8.0
#: A block ends at that many rare tokens, or at that many scores (rare words times languages).
BLOCK_TOKENS = 1_500_000
BLOCK_COUNTS = 3_000_000
#: Tokens of the documents that are packed together.
PACKED_TOKENS = 200_000
#: Words that are taken apart together.
WORDS_AT_ONCE = 50_000
#: N-grams that a task sums up before it sends them on.
GRAMS_HELD = 1_000_000
#: Words of a block of unknown ones.
UNSEEN_BLOCK = 20_000
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN_LANGUAGE = "und"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers of 4 bytes, compressed with like bytes side by side."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unsqueeze(raw: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view(dtype).ravel()


def word_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(word, n0 ...) of every word of ``docs`` (text, lang): its counts in the texts of each language;
    words that only texts without one have count 0."""
    at = {lang: i for i, lang in enumerate(languages)}
    names = [f"n{i}" for i in range(len(languages))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(len(names) + 1)]  # the last of texts without a language

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(dict.fromkeys(w for c in held for w in c))
            for i in range(0, len(words), WORDS_AT_ONCE):
                some = words[i : i + WORDS_AT_ONCE]
                numbers = (pa.array([c.get(w, 0) for w in some], pa.int64()) for c in held[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *numbers], ["word", *names])
            for c in held:
                c.clear()

        for text, lang in rows_of(batches):
            held[-1 if lang is None else at[lang]].update(words_of(text))
            if sum(map(len, held)) * len(held) >= BLOCK_COUNTS:
                yield from flush()
        yield from flush()

    parts = docs.select("text", "lang").mapInArrow(run, ", ".join(["word string", *(f"{name} bigint" for name in names)]))
    return parts.groupBy("word").agg(*(F.sum(name).alias(name) for name in names))


def head_words(known: DataFrame, kinds: int) -> list:
    """The rows (word, n0 ...) of the most frequent words, HEAD at most, by steps of an eighth of a
    power of two of their frequency."""
    step = F.floor(8 * F.log2(sum((F.col(f"n{i}") for i in range(kinds)), F.lit(0)))).alias("step")
    sizes = sorted(known.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"])
    room, least = HEAD, None
    for r in sizes:
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    return [] if least is None else known.filter(step >= least).collect()


def encode_blocks(docs: DataFrame, head: list[str], values: np.ndarray) -> DataFrame:
    """Kind 0: documents (doc_ids, digests, numbers of words, sums of the ``values`` of words of
    ``head``, and of the other words their numbers and local numbers), many to a row.
    Kind 1: a block's words that are not in ``head``.

    ``docs`` has doc_id, digest and text.
    """
    fields = [("kind", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary()))]
    fields += [("tokens", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64())), ("lengths", pa.binary()), ("ids", pa.binary())]
    schema = pa.schema([*fields, ("word", pa.string()), ("local", pa.int32())])

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        found = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(found, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {w: i for i, w in enumerate(head)}
        block, index, rows, tokens = TaskContext.get().partitionId() << 32, dict(first), [], 0

        def packed(part: list[tuple]) -> pa.RecordBatch:
            ids = np.concatenate([r[4] for r in part])
            lengths = np.array([len(r[4]) for r in part], np.int32)
            names, digests, counts = ([[r[i] for r in part]] for i in range(3))
            sums = [np.concatenate([r[3] for r in part])]
            return batch_of(1, kind=[0], block=[block], doc_ids=names, digests=digests, tokens=counts, sums=sums, lengths=[squeeze(lengths)], ids=[squeeze(ids)])

        def flush() -> Iterator[pa.RecordBatch]:
            part, held = [], 0
            for row in rows:
                part.append(row)
                held += len(row[4]) + len(row[3]) + 1
                if held >= PACKED_TOKENS:
                    yield packed(part)
                    part, held = [], 0
            if part:
                yield packed(part)
            words = list(index)[len(head) :]
            for i in range(0, len(words), WORDS_AT_ONCE):
                some = words[i : i + WORDS_AT_ONCE]
                numbers = {"kind": np.ones(len(some), np.int32), "block": np.full(len(some), block)}
                yield batch_of(len(some), **numbers, word=some, local=np.arange(i, i + len(some)))

        for doc_id, digest, text in rows_of(batches):
            words = words_of(text)
            ids = np.fromiter([index.setdefault(w, len(index)) for w in words], np.int32, len(words))
            rare = ids[ids >= len(head)] - len(head)
            rows.append((doc_id, digest, len(ids), values[ids[ids < len(head)]].sum(axis=0), rare))
            tokens += len(rare) + values.shape[1] + 1
            if tokens >= BLOCK_TOKENS or (len(index) - len(head)) * values.shape[1] >= BLOCK_COUNTS:
                yield from flush()
                block, index, rows, tokens = block + 1, dict(first), [], 0
        if rows:
            yield from flush()

    names = "kind int, block bigint, doc_ids array<bigint>, digests array<binary>, tokens array<bigint>, sums array<double>"
    return docs.mapInArrow(run, f"{names}, lengths binary, ids binary, word string, local int")


class Spelled:
    """The characters of many words, each between two boundary marks, one after the other."""

    def __init__(self, words: list[str]):
        text = "".join([f"<{w}>" for w in words])
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.owner = np.repeat(np.arange(len(words)), lengths)
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.codes))  # characters to the word's end

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams of ``size`` characters and their 64-bit keys."""
        places = np.flatnonzero(self.left >= size)
        keys = np.full(len(places), size, np.uint64)
        for i in range(size):
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + self.codes[places + i])
        return places, keys.view(np.int64)


def gram_counts(words: DataFrame, kinds: int) -> DataFrame:
    """(size, gram, n0 ...) of the n-grams by key, from the blocks' words with their counts."""
    names = [f"n{i}" for i in range(kinds)]
    schema = pa.schema([("size", pa.int32()), ("gram", pa.int64()), *((name, pa.int64()) for name in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sums = {size: (np.empty(0, np.int64), np.empty((kinds, 0), np.int64)) for size in range(1, LONGEST + 1)}

        def add() -> None:
            """Take the held words apart and add their n-grams to the sums."""
            table = pa.Table.from_batches(held)
            spelled = Spelled(table.column(0).to_pylist())
            n = np.stack([table.column(1 + i).to_numpy() for i in range(kinds)])
            for size, (keys, values) in sums.items():
                places, found = spelled.grams(size)
                some, which = np.unique(np.concatenate([keys, found]), return_inverse=True)
                more = np.concatenate([values, n[:, spelled.owner[places]]], axis=1)
                sums[size] = some, np.stack([np.bincount(which, x, len(some)) for x in more]).astype(np.int64)
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for size, (keys, values) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(keys), size, np.int32), keys, *values)], schema=schema)
                sums[size] = (keys[:0], values[:, :0])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= WORDS_AT_ONCE:
                add()
                if sum(len(keys) for keys, _ in sums.values()) >= GRAMS_HELD:
                    yield from flush()
        if sum(b.num_rows for b in held):
            add()
        yield from flush()

    parts = words.mapInArrow(run, ", ".join(["size int, gram bigint", *(f"{name} bigint" for name in names)]))
    return parts.groupBy("size", "gram").agg(*(F.sum(name).alias(name) for name in names))


def log_shares(n: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Logs of (n + 1/2) / (total + (kinds + 1) / 2), a column per language."""
    return np.log((n + 0.5) / (totals + 0.5 * (kinds + 1)))


@dataclass(frozen=True)
class Model:
    """Languages in name order, the totals of words, and, by size of n-gram, the totals and the numbers
    of kinds in each language; ``floor`` stands for a position without any known one."""

    languages: list[str]
    totals: np.ndarray
    gram_totals: dict[int, np.ndarray]
    gram_kinds: dict[int, np.ndarray]
    floor: np.ndarray

    def unseen(self, words: list[str], size: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores of words by the longest known n-gram at each position but the last; ``size``,
        ``keys`` and ``n`` are those of the known n-grams that the words have."""
        spelled = Spelled(words)
        scores = np.tile(self.floor, (len(spelled.codes), 1))
        open_ = np.ones(len(spelled.codes), bool)
        for k in range(LONGEST, 0, -1):
            own = np.flatnonzero(size == k)
            if not len(own):
                continue
            own = own[np.argsort(keys[own])]
            values = log_shares(n[own], self.gram_totals[k], self.gram_kinds[k])
            places, found = spelled.grams(k)
            at = np.minimum(np.searchsorted(keys[own], found), len(own) - 1)
            hit = (keys[own][at] == found) & open_[places]
            scores[places[hit]] = values[at[hit]]
            open_[places[hit]] = False
        inner = spelled.left > 1
        sums = np.stack([np.bincount(spelled.owner[inner], x[inner], len(words)) for x in scores.T], axis=1)
        return sums / np.bincount(spelled.owner[inner], minlength=len(words))[:, None]


def learn(known: DataFrame, grams: DataFrame, languages: list[str]) -> Model:
    """The model's sums, one row of each size of n-gram, from all words and n-grams known."""
    k = range(len(languages))
    sums = [x for i in k for x in (F.sum(f"n{i}").alias(f"t{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"k{i}"), F.min(f"n{i}").alias(f"m{i}"))]

    def of(row, name: str) -> np.ndarray:
        return np.array([row[f"{name}{i}"] or 0 if row else 0 for i in k], float)

    whole = known.agg(*sums).first()
    by_size = {r["size"]: r for r in grams.groupBy("size").agg(*sums).collect()}
    totals, kinds = {size: of(r, "t") for size, r in by_size.items()}, {size: of(r, "k") for size, r in by_size.items()}
    least = min((log_shares(of(r, "m"), totals[size], kinds[size]).min() for size, r in by_size.items()), default=0.0)
    return Model(languages, of(whole, "t"), totals, kinds, np.full(len(languages), least))


def _unseen_scores(unseen: DataFrame, grams: DataFrame, model: Model) -> DataFrame:
    """(word, s0 ...) of words that no training document has."""
    names, scored = [f"n{i}" for i in range(len(model.languages))], [f"s{i}" for i in range(len(model.languages))]
    blocks = max(1, -(-unseen.count() // UNSEEN_BLOCK))
    dealt = unseen.select("word", F.pmod(F.xxhash64("word"), F.lit(blocks)).alias("part"))

    def ask(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        spelled = Spelled(part.word.tolist())
        found = [np.unique(spelled.grams(size)[1]) for size in range(1, LONGEST + 1)]
        size = np.repeat(np.arange(1, LONGEST + 1, dtype=np.int32), [len(x) for x in found])
        return pd.DataFrame({"part": key[0], "size": size, "gram": np.concatenate(found)})

    def answer(words: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(words):
            return pd.DataFrame({c: [] for c in ("word", *scored)})
        values = model.unseen(words.word.tolist(), part["size"].to_numpy(), part.gram.to_numpy(), part[names].to_numpy(float).reshape(-1, len(names)))
        return pd.DataFrame({"word": words.word.to_numpy(object), **{c: values[:, i] for i, c in enumerate(scored)}})

    met = dealt.groupBy("part").applyInPandas(ask, "part bigint, size int, gram bigint").join(grams, ["size", "gram"])
    schema = ", ".join(["word string", *(f"{c} double" for c in scored)])
    met = met.select(*(F.col(c).alias(c) for c in ("part", "size", "gram", *names)))
    return dealt.groupBy("part").cogroup(met.groupBy("part")).applyInPandas(answer, schema)


def _scores_by_block(words: DataFrame, languages: int) -> DataFrame:
    """(block, words): packed local numbers and scores of the rows (block, local, s0 ...)."""
    schema = pa.schema([("block", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = {}, 0

        def flush() -> pa.RecordBatch:
            parts = []
            for x in held.values():
                rows = np.concatenate(x)
                parts.append(squeeze(rows[np.argsort(rows[:, 0].view(np.int32), kind="stable")].T))
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(parts, pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.empty((batch.num_rows, 1 + languages), np.float32)
            packed[:, 0] = batch.column(1).to_numpy().view(np.float32)  # the number's bits, as it is
            for i in range(languages):
                packed[:, 1 + i] = batch.column(2 + i).to_numpy()
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                held.setdefault(int(block[part[0]]), []).append(packed[part])
            rows += batch.num_rows
            if rows > 1_000_000:
                yield flush()
                held, rows = {}, 0
        if held:
            yield flush()

    return words.mapInArrow(run, "block bigint, words binary")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, digest, lang_pred and score of every whole text of ``docs`` (doc_id, digest, text,
    lang), learned from the rows whose lang is not null."""
    trained = docs.filter("text is not null and lang is not null")
    languages = sorted(r.lang for r in trained.select("lang").distinct().collect())  # a row per language
    if not languages:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", F.lit(UNKNOWN_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    counts, scored = [f"n{i}" for i in range(len(languages))], [f"s{i}" for i in range(len(languages))]
    words = materialize(word_counts(docs.select("text", F.when(F.col("text").isNotNull(), F.col("lang")).alias("lang")), languages))
    found = F.greatest(F.lit(0), F.lit(0), *counts) > 0
    known = words.filter(found)
    grams = materialize(gram_counts(known.select("word", *counts), len(languages)))
    model = learn(known, grams, languages)
    head = head_words(known, len(languages))
    values = np.log((np.array([[r[c] for c in counts] for r in head], float).reshape(-1, len(languages)) + 0.5) / (model.totals + 1))
    encoded = materialize(encode_blocks(docs.select("doc_id", "digest", "text"), [r.word for r in head], values), ["kind"])
    log = [F.log((F.col(c) + 0.5) / (float(model.totals[i]) + 1)).alias(scored[i]) for i, c in enumerate(counts)]
    every = known.select("word", *log).unionByName(_unseen_scores(words.filter(~found).select("word"), grams, model))
    every = every.select("word", *(F.col(c).cast("float").alias(c) for c in scored))
    met = encoded.filter("kind = 1").select("word", "block", "local").join(every, "word")
    packed = _scores_by_block(met.select("block", "local", *scored), len(languages))

    def sum_up(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        read = [unsqueeze(x, "<f4").reshape(1 + len(languages), -1) for x in words.words]
        table = np.empty((sum(x.shape[1] for x in read), len(languages)))
        for x in read:
            table[x[0].view(np.int32)] = x[1:].T
        out: list[tuple] = []
        for names, digests, tokens, sums, lengths, ids in zip(texts.doc_ids, texts.digests, texts.tokens, texts.sums, texts.lengths, texts.ids):
            lengths, ids, sums = unsqueeze(lengths, "<i4"), unsqueeze(ids, "<i4"), np.asarray(sums).reshape(-1, len(languages))
            for doc_id, digest, n, head_sum, part in zip(names, digests, tokens, sums, np.split(ids, np.cumsum(lengths)[:-1])):
                name, share = UNKNOWN_LANGUAGE, 0.0
                if n:
                    mean = (head_sum + table[part].sum(axis=0)) / n
                    best = int(np.argmax(mean))
                    name, share = languages[best], float(1.0 / np.exp(SHARPNESS * (mean - mean[best])).sum())
                out.append((None if pd.isna(doc_id) else int(doc_id), digest, name, share))
        found = pd.DataFrame(out, columns=["doc_id", "digest", "lang_pred", "score"], dtype="object")
        return found.astype({"doc_id": "Int64", "score": "float64"})

    texts = encoded.filter("kind = 0").select("block", "doc_ids", "digests", "tokens", "sums", "lengths", "ids")
    schema = "doc_id bigint, digest binary, lang_pred string, score double"
    return texts.groupBy("block").cogroup(packed.groupBy("block")).applyInPandas(sum_up, schema)


def predict(docs: DataFrame, trains: Column) -> DataFrame:
    """doc_id, lang_pred and score of every whole text, learned from the rows that ``trains``."""
    lang = F.when(trains, F.col("lang").cast("string")).alias("lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "text", lang)
    return scores(rows).drop("digest")


def keep_documents(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has ``least_score`` for a language of the
    table's own; rows are told apart by text, on which alone the score depends."""
    digest = F.unhex(F.sha2(F.col("text"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text", F.col("lang").cast("string").alias("lang"))
    gone = materialize(scores(rows).filter(F.col("digest").isNotNull() & (F.col("score") < least_score)).select("digest").distinct())
    # a text may have many copies, so they are dealt into parts
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("part")
    told = docs.select(F.struct("*").alias("doc"), digest.alias("digest"), part).filter(F.col("digest").isNotNull())
    parts = gone.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
    some, rest = sifted(told, F.col("digest"), gone, F.col("digest"))
    return some.join(parts, ["digest", "part"], "left_anti").unionByName(rest).select("doc.*")
