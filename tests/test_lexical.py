"""BM25 by both ways against the formula."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from memlake.operators import lexical


def by_formula(queries: dict, docs: dict) -> dict:
    n, mean = len(docs), max(sum(map(len, docs.values())) / len(docs), 1.0)
    df = Counter(t for tokens in docs.values() for t in set(tokens))
    out = {}
    for q, asked in queries.items():
        for d, tokens in docs.items():
            held, score, met = Counter(tokens), 0.0, False
            for t in asked:
                if held[t]:
                    met = True
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    score += idf * held[t] * 2.5 / (held[t] + 1.5 * (0.25 + 0.75 * max(len(tokens), 1) / mean))
            if met:
                out[q, d] = score
    return out


@pytest.mark.parametrize("small", [lexical.SMALL_ROWS, 0])
def test_bm25_equals_the_formula(spark, monkeypatch, small):
    monkeypatch.setattr(lexical, "SMALL_ROWS", small)
    monkeypatch.setattr(lexical, "STEP", 50)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = {f"d{i}": rng.choices(words, k=rng.randrange(0, 25)) for i in range(60)} | {"empty": []}
    queries = {i: rng.choices([*words, "nowhere"], k=rng.randrange(0, 8)) for i in range(12)}
    got = lexical.bm25(
        spark.createDataFrame(list(queries.items()), "query_id int, tokens array<string>"), spark.createDataFrame([*docs.items(), ("null", None)], "object_id string, tokens array<string>").filter("tokens is not null")
    )
    have = {(r.query_id, r.object_id): r.bm25 for r in got.collect()}
    want = by_formula(queries, docs)
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    none = spark.createDataFrame([], "query_id int, tokens array<string>")
    assert lexical.bm25(none, spark.createDataFrame(list(docs.items()), "object_id string, tokens array<string>")).collect() == []
