"""Secrets in texts: three fixed rules, and two character Markov models for what these miss.

The rules' matches are the labels of the training sample: characters inside them follow one
another as in random strings, those of all other words as in ordinary text and identifiers.
Transitions between characters of the candidates' alphabet are counted over all documents, in
every task, and summed up; there are two counts for each pair of characters, however large the
corpus. A candidate, a run of the alphabet of MIN_CHARS characters or more with a letter and a
digit that no rule's match touches, is a secret of kind ``random`` if the log-likelihood ratio of the
two models is RATIO or more in all and PER_CHAR or more for each character on average.

Random strings are smoothed towards an even distribution, as they may hold any character;
ordinary ones towards their transitions between classes (capital, small, digit, sign), so what
is rare there stays rare for a symbol seen seldom. So strings of an alphabet that no rule's
match has (mixed case, base64) are found as well. Candidates that no rule's match touches have
no label and train neither model.

Defined cases: a null or empty text has no spans. Every row gives a row, repeated ones too. Very
long texts are scanned whole. Without a rule's match anywhere the model of random strings is the
even distribution; an empty table gives no rows. Of spans with one start the kinds come in the
order of KINDS. Overlapping spans of different rules all stay. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Least log-likelihood ratio, in nats: odds of a million to one against.
RATIO = 13.8
PER_CHAR = 3.0
#: Weight of the smoothing distribution, in transitions from one symbol.
PRIOR = 50.0
#: Times that weight for random strings, whose sample may be of a few alphabets alone.
EVEN = 60

_SIZE = len(ALPHABET) + 1  # 0: whatever is not in the alphabet
_CLASS = np.array([0, *(1 + ("A" <= c <= "Z") + 2 * ("a" <= c <= "z") + 3 * ("0" <= c <= "9") for c in ALPHABET)])
_SYMBOL = bytes(ALPHABET.index(chr(b)) + 1 if b < 128 and chr(b) in ALPHABET else 0 for b in range(256))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the rules' matches, in code points, ordered."""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _values(text: str) -> list[tuple[int, int]]:
    """What the rules call random: values of assignments, keys and hexadecimal runs; apart."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS] + [m.span() for m in HEX.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def mixed(run: str) -> bool:
    """Whether a run of the alphabet has a letter and a digit."""
    return any(map(str.isdigit, run)) and any(map(str.isalpha, run))


def _transitions(text: str) -> np.ndarray:
    symbols = np.frombuffer(f" {text} ".encode().translate(_SYMBOL), np.uint8).astype(np.int64)
    return np.bincount(symbols[:-1] * _SIZE + symbols[1:], minlength=_SIZE * _SIZE)


def transition_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs of symbols in random strings and in the rest of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _SIZE * _SIZE), np.int64)
        for batch in batches:
            for text in batch.column(0):
                if not (text := text.as_py()):
                    continue
                rest, at = [], 0
                for start, end in _values(text):
                    counts[0] += _transitions(text[start:end])
                    rest.append(text[at:start])
                    at = end
                rest = [CANDIDATE.sub(lambda m: " " if mixed(m[0]) else m[0], x) for x in (*rest, text[at:])]
                counts[1] += _transitions(" ".join(rest))
        random, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(random == 0), pa.array(pair), pa.array(counts[random, pair])], ["random", "pair", "n"])

    found = docs.select("text").mapInArrow(run, "random boolean, pair bigint, n bigint").groupBy("random", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, _SIZE, _SIZE))
    for random, pair, n in found.collect():  # two for each pair of symbols at most
        counts[0 if random else 1, pair // _SIZE, pair % _SIZE] = n
    return counts[0], counts[1]


def ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition; a run's start counts, its end doesn't."""
    inside = ordinary[:, 1:]
    kinds = np.zeros((len(_CLASS), _CLASS.max() + 1))
    kinds[np.arange(len(_CLASS)), _CLASS] = 1
    between = kinds.T @ inside @ kinds[1:] + 0.5
    between /= between.sum(1, keepdims=True)
    own = inside.sum(0) + 0.5
    own /= (own @ kinds[1:])[_CLASS[1:]]  # a symbol's share of its class
    likely = between[_CLASS][:, _CLASS[1:]] * own
    even = np.full(len(ALPHABET), 1 / len(ALPHABET))

    def log(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return np.log((counts + PRIOR * prior) / (counts.sum(1, keepdims=True) + PRIOR * prior.sum(-1, keepdims=True)))

    return log(random[:, 1:], even * EVEN) - log(inside, likely)


def random_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of kind ``random``: candidates of a high ratio that touch none of ``taken``."""
    out, at, reached = [], 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reached = max(reached, taken[at][1])
            at += 1
        run = m[0]
        if reached > start or not mixed(run):
            continue
        symbols = np.frombuffer(f" {run}".encode().translate(_SYMBOL), np.uint8)
        total = ratio[symbols[:-1], symbols[1:] - 1].sum()
        if total >= RATIO and total >= PER_CHAR * len(run):
            out.append((start, end, 3))
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda x: (x[0], x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    model = docs.sparkSession.sparkContext.broadcast(ratios(*transition_counts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = []
            base, every = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = rule_spans(text)
                more = random_spans(text, model.value, own)
                counts.append([sum(x[2] == kind for x in (*own, *more)) for kind in range(4)])
                base.append(hashlib.sha256(spelled(own).encode()).hexdigest())
                every.append(spelled([*own, *more]))
            columns = [pa.array(x, pa.int64()) for x in (zip(*counts) if counts else ([],) * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(every, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
