"""Scalar functions on text, tags and ids (T-1 to T-9, T-15 to T-18)."""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from memlake.schemas import SUPERSESSION_HINTS


#: White space as Python's ``str.strip`` knows it, which is what the store's texts are stripped of.
_WHITE = "[\\s\\x1c-\\x1f]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"(?U)^{_WHITE}+|{_WHITE}+$", "")


def normalize_tags(tags: Column, aliases: dict[str, str] | None = None) -> Column:
    """T-1: trimmed, lower-cased, dashes for spaces, aliases applied, distinct in order."""
    clean = F.transform(tags, lambda t: F.replace(F.lower(strip(t)), F.lit(" "), F.lit("-")))
    if aliases:
        table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        clean = F.transform(clean, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


_HINT = "(?i)^\\s*(" + "|".join(SUPERSESSION_HINTS) + ")\\s*"


def has_supersession_hint(content: Column) -> Column:
    """T-2: whether the text says that it replaces an earlier one."""
    return content.rlike(_HINT)


def strip_supersession_hint(content: Column) -> Column:
    return strip(F.regexp_replace(content, _HINT, ""))


def fold_content(text: Column) -> Column:
    """T-3, built-in part: lower-cased, white space collapsed, trailing ``.!?`` dropped."""
    return F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "\\s+", " ")), "[.!?]+$", ""))


#: Texts that are strings of Python at once; a batch of Arrow may have thousands of long ones.
TEXTS = 128


@F.arrow_udf(StringType())
def normalize_content(text: pa.Array) -> pa.Array:
    """T-3: as ``fold_content``, after NFKC and full case folding."""

    def one(x: str | None) -> str | None:
        return None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()).rstrip(".!?").rstrip()

    parts = (text.slice(begin, TEXTS).to_pylist() for begin in range(0, len(text), TEXTS))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(one, part), pa.string()) for part in parts)])


def content_hash(text: Column) -> Column:
    """T-4: of the first 300 characters."""
    return F.sha2(F.substring(text, 1, 300), 256)


def body_hash(text: Column) -> Column:
    """T-4: of the stripped text, as notes are hashed."""
    return F.sha2(strip(text), 256)


CLUSTER = regex.compile(r"\X")


def truncated(text: str, n: int, suffix: str = "") -> str:
    """At most ``n`` code points of a text in whole grapheme clusters; the suffix, if it has room
    at all, stands for what was cut."""
    if len(text) <= n:
        return text
    room = n - len(suffix) if n > len(suffix) else n
    end = 0
    for cluster in CLUSTER.finditer(text[: room + 64]):  # a cluster beyond that is cut out anyway
        if cluster.end() > room:
            break
        end = cluster.end()
    return text[:end] + (suffix if n > len(suffix) else "")


def truncate_grapheme(n: int, suffix: str = "..."):
    """T-5: a UDF of ``truncated``."""

    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else truncated(x, n, suffix))

    return cut


#: Fixed patterns of personal data, applied in this order.
PII_PATTERNS = (
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
)
#: Fixed patterns of utterances worth capturing.
FACT_PATTERNS = (
    r"\bremember\b",
    r"\bI (?:always )?forget\b",
    r"\b(?:save|store|note) (?:this|that) (?:to|in) memory\b",
    r"\bnever forget\b",
)


def redact_pii(text: Column, unicode_words: bool = True) -> Column:
    """T-6: e-mails, SSNs and phone numbers replaced."""
    for pattern in PII_PATTERNS:
        text = F.regexp_replace(text, ("(?U)" if unicode_words else "") + pattern, "[REDACTED]")
    return text


def interesting_fact(text: Column) -> Column:
    """T-7"""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in FACT_PATTERNS))


def default_context_tags(tags: Column) -> Column:
    """T-8: a kind and a staleness tag where there is none."""


    def add(to: Column, prefix: str, tag: str) -> Column:
        return F.when(F.exists(to, lambda t: t.startswith(prefix)), to).otherwise(F.concat(to, F.array(F.lit(tag))))

    return add(add(tags, "kind:", "kind:episode"), "staleness:", "staleness:episodic")


def family_of(namespace: Column) -> Column:
    """T-9"""
    return F.split(namespace, "/")[0]


def plane_of(namespace: Column) -> Column:
    return F.element_at(F.split(namespace, "/"), -1)


def infer_namespace(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    known = F.concat_ws("/", parts[0], parts[1], F.lit("curated"))
    return F.when(F.size(parts) < 2, F.lit("system/internal/curated")).otherwise(known)


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(LongType())
def ksuid_timestamp(ids: pd.Series) -> pd.Series:
    """T-15: seconds since 1970 of a 27-character id; malformed ones give null."""
    digit = {c: i for i, c in enumerate(_BASE62)}

    def one(x: str | None) -> int | None:
        if x is None or len(x) != 27 or any(c not in digit for c in x):
            return None
        value = 0
        for c in x:
            value = value * 62 + digit[c]
        return (value >> 128) + 1_400_000_000 if value >> 160 == 0 else None

    return ids.map(one).astype("Int64")


def deterministic_id(namespace: Column, key: Column) -> Column:
    """T-16: the same id each time, from namespace and key."""
    return F.substring(F.sha2(F.concat_ws("\x1f", namespace, key), 256), 1, 27)


#: Texts whose words are hashed at once.
HASHED_TEXTS = 128


def hash_embed(dim: int = 64):
    """T-17: a UDF for unit vectors of hashed words, so that near texts get near vectors."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        import xxhash

        out = np.zeros((len(text), dim))
        for begin in range(0, len(text), HASHED_TEXTS):
            words = [(x or "").lower().split() for x in text.iloc[begin : begin + HASHED_TEXTS]]
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(words))), ">u8").astype(np.uint64)
            row = np.repeat(np.arange(len(words)), [len(of) for of in words])
            sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
            place = row * dim + (hashes % np.uint64(dim)).astype(np.int64)
            out[begin : begin + len(words)] = np.bincount(place, sign, len(words) * dim).reshape(len(words), dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(np.divide(out, norm, out=out, where=norm > 0).astype("float32")), dtype=object)

    return embed


def embed_text(plane: str) -> Column:
    """T-18: the text that stands for a row of the plane in an embedding."""
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.col("content")) if plane != "concept" else F.col("content")
    return summary if plane == "episodic" else F.concat_ws("\n", "title", summary)


def tokenize(text: Column) -> Column:
    """V-6: lower-cased ASCII tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_.+-]*"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """V-14: of two arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_overlap(a: Column, b: Column) -> Column:
    """V-15: Jaccard similarity of lower-cased words; 0 if either has none."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda t: t != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def cosine(a: Column, b: Column) -> Column:
    """V-1: in double precision; 0 if either norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
