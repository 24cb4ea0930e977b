"""Chat formatting, packing, exact and near deduplication, language model and pipeline."""

from __future__ import annotations

import hashlib
import math
import os
import random
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from memlake.llm import chat_format, common, exact_dedup, hmm_lm, language_id, near_dedup, packing
from memlake.llm.shingles import ascii_lower_words, jaccard, shingle_set
from tests.llm.conftest import LONG, ROWS

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_chats_collapse_snapshots(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", 2)
    monkeypatch.setattr(chat_format, "PART_TURNS", 3)
    base = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", None)]
    chats = {1: base[:2], 2: base, 3: base[:4], 4: base, 5: base[:2] + [("user", "other")], 6: [("user", "b")], 7: base[1:3]}
    rows = [(c, 10 * i, r, t, 1) for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    rows += [rows[0], rows[0], (None, 1, "user", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int")
    got = defaultdict(str)
    for r in sorted(chat_format.format_chats(turns).collect(), key=lambda r: (r.conv_id, r.part)):
        assert r.part_turns <= 3 and r.n_turns == len(chats[r.conv_id])
        assert r.copies == (2 if r.conv_id == 2 else 1)
        got[r.conv_id] += r.text
    want = {c: "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in chats[c]) for c in (2, 5, 6, 7)}
    assert dict(got) == want
    assert chat_format.format_chats(turns.limit(0)).collect() == []


def test_encoder_gives_the_ids_of_tokenizers():
    reference = Tokenizer.from_file(BPE)
    reference.encode_special_tokens = True
    rng = random.Random(5)
    alphabet = [" ", "\n", "a", "B", "1", ".", "'s", "é", "\t", "  ", "漢", "́", "\x1c", "\x85", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + [LONG]
    encoder = packing.WordEncoder(BPE)
    for got, want in zip(encoder.ids(texts), reference.encode_batch(texts, add_special_tokens=False)):
        assert got == np.array(want.ids, "<u4").tobytes()


def test_added_tokens_in_a_text_have_their_ids(spark):
    reference = Tokenizer.from_file(BPE)
    rng = random.Random(6)
    alphabet = [" ", "\n", "a", "B1", ".", "é", "  ", "漢", "<|endoftext|>", "<|endoftext|", "<|endoftext|><|endoftext|>"]
    texts = ["", "foo<|endoftext|> bar", LONG + "<|endoftext|>" + LONG] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    want = [np.array(x.ids, "<u4") for x in reference.encode_batch(texts, add_special_tokens=False)]
    assert want[1].tolist() == [21943, 50256, 2318]
    assert packing.WordEncoder(BPE).document_ids(texts) == [x.tobytes() for x in want]
    docs = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id bigint, text string")
    for r in packing.pack(docs, BPE, capacity=64).collect():
        ids = np.append(want[r.doc_id], packing.END_ID).astype("<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for capacity in (10, 30, 97):
        counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 400))))
        patterns = packing.plan(counts, capacity)
        placed = Counter()
        for b in patterns:
            assert sum(s * k for s, k in b.contents) <= capacity and b.count > 0
            assert sum(k for s, k in b.contents if 3 * s > capacity) <= 2
            for s, k in b.contents:
                placed[s] += k * b.count
        assert placed == Counter(counts)
        bins, least = sum(b.count for b in patterns), math.ceil(sum(s * n for s, n in counts.items()) / capacity)
        assert bins <= math.ceil(11 / 9 * max(least, sum(n for s, n in counts.items() if 2 * s > capacity))) + 1


def test_packing_is_gapless_and_whole(spark, odd_docs, no_docs):
    got = packing.pack(odd_docs, BPE, capacity=64).toPandas()
    reference = Tokenizer.from_file(BPE)
    by_doc = Counter()
    for i, text, _ in ROWS:
        by_doc[i if i is not None else -1] += len(reference.encode(text or "", add_special_tokens=False).ids) + 1
    got["doc_id"] = got.doc_id.fillna(-1)
    assert got.groupby("doc_id").length.sum().to_dict() == dict(by_doc)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        ends = (part.offset + part.length).tolist()
        assert part.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 64
    ids = np.array([*reference.encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    pieces = got[got.doc_id == 4].sort_values("piece")
    assert (pieces.length.iloc[1:] == 64).all()
    for r in pieces.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(no_docs, BPE).collect() == []


@pytest.mark.parametrize("n", [5000, 10**6, 10**7])
def test_ids_of_long_white_space_are_those_of_tokenizers(n):
    reference, encoder = Tokenizer.from_file(BPE), packing.WordEncoder(BPE)
    mixed = "".join(random.Random(3).choices(" \n\t\u3000", k=n))
    for run in (" " * n, "\n" * n, mixed) if n < 10**7 else ("\n" * n,):
        texts = [run, run + "end", "start" + run + " and"] if n < 10**7 else [run + "end"]
        for text, ids in zip(texts, encoder.document_ids(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 3000])
def test_perfect_hash_is_minimal_and_perfect(n):
    digests = np.frombuffer(os.urandom(32 * n), np.uint8).reshape(-1, 32)
    pilots, slots = exact_dedup.build_mph(digests)
    assert sorted(slots) == list(range(n))
    assert (exact_dedup.slot_of(digests, pilots, n) == slots).all()


def test_exact_dedup_equals_grouping(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 2)
    for split in (F.col("doc_id") % 2 == 0, F.lit(True), F.lit(False)):
        old = F.coalesce(split, F.lit(False))
        got = exact_dedup.exact_dedup(odd_docs.filter(old), odd_docs.filter(~old)).collect()
        groups = defaultdict(list)
        for i, text, _ in ROWS:
            groups[hashlib.sha256((text or "").encode().lower()).hexdigest()].append(i)
        assert len(got) == len(ROWS)
        for r in got:
            ids = groups[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
            assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.exact_dedup(no_docs, no_docs).collect() == []
    kept = exact_dedup.keep_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3, 4, 6, 7, 7, 9, 10, 11]


def test_exact_dedup_with_an_empty_history_and_many_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 500)
    rows = spark.range(100_000).selectExpr("id as doc_id", "concat('text ', cast(id % 60000 as string)) as text")
    sizes = []
    look_up = exact_dedup.look_up

    def seen(index, distinct, buckets):
        sizes.append(exact_dedup.with_bucket(distinct, buckets).groupBy("bucket").count().agg({"count": "max"}).first()[0])
        return look_up(index, distinct, buckets)

    monkeypatch.setattr(exact_dedup, "look_up", seen)
    got = exact_dedup.exact_dedup(rows.limit(0), rows)
    assert got.filter("kept").count() == 60_000 and got.filter("group_size = 2").count() == 80_000
    assert got.filter("keep_id % 60000 <> doc_id % 60000 or keep_id < doc_id or in_history").count() == 0
    assert sizes[0] < 800


def test_exact_copies_without_an_id_go(spark):
    rows = [(1, "Same"), (None, "same"), (None, "SAME"), (4, "same"), (None, "only here"), (None, "Only here"), (None, None), (7, "")]
    kept = exact_dedup.keep_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(kept.collect(), key=repr) == sorted([(4, "same"), (None, "only here"), (None, "Only here"), (7, "")], key=repr)


def brute_components(rows: list[tuple], width: int, percent: int) -> dict:
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(ascii_lower_words(t), width)) for i, t in rows]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            inter, union = jaccard(x, y)
            if inter and 100 * inter >= percent * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_shingle_sets_are_sets_of_word_windows():
    words = ascii_lower_words("A b a B a b c")
    assert len(shingle_set(words, 3)) == len({tuple(words[i : i + 3]) for i in range(5)})
    assert len(shingle_set(words[:2], 3)) == 1 and len(shingle_set([], 3)) == 0
    assert ascii_lower_words("É\x0bA B") == ["É".encode(), "a b".encode()]


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    """A hub with variants at all distances, so that some link only through each other."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "FEW", 6)
    monkeypatch.setattr(near_dedup, "HEAVY", 3)
    rng = random.Random(11)
    rows = []
    for family in range(3):
        hub = [f"h{family}w{i}" for i in range(150)]
        rows.append((1000 * family, " ".join(hub)))
        for v in range(60):
            words = list(rows[rng.randrange(len(rows))][1].split() if v % 3 == 0 else hub)
            for _ in range(rng.randrange(1, 9)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(3)] = [f"n{rng.randrange(10**9)}"] * rng.randrange(2)
            rows.append((1000 * family + 1 + v, " ".join(words)))
    rows += [(9000, rows[5][1]), (9001, None), (9002, "a b"), (9003, "A B"), (9004, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs, 3, 85).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(rows, 3, 85)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("percent", [80, 85])
def test_links_that_miss_the_pivot_meet_by_difference(spark, monkeypatch, percent):
    """Each link but those of two in the pivot's component is a candidate or has a common group."""
    monkeypatch.setattr(near_dedup, "HEAVY", 3)
    rng = np.random.default_rng(percent)
    pivot, sets = np.arange(100, dtype=np.int64), set()
    while len(sets) < 250:
        start = pivot if len(sets) < 60 or rng.random() < 0.4 else np.array(sorted(list(sets)[rng.integers(0, len(sets))]))
        x = rng.choice(start, len(start) - rng.integers(0, 14), replace=False)
        x = np.union1d(x, rng.integers(100, 130, rng.integers(0, 9)))
        inter, union = jaccard(pivot, x)
        if len(x) and 2 * inter >= union and inter < union:
            sets.add(tuple(x.tolist()))
    sets = [np.array(x) for x in sorted(sets)]
    rows = []
    for i, x in enumerate(sets):
        inter, union = jaccard(pivot, x)
        rows.append((-1, i, inter, len(pivot), len(x), np.setxor1d(pivot, x).tolist(), i if 100 * inter < percent * union else -1, 100 * inter < percent * union))
    schema = "a bigint, b bigint, inter bigint, size_a bigint, size_b bigint, difference array<bigint>, label bigint, loose boolean"
    pairs, groups = near_dedup.by_difference(spark.createDataFrame(rows, schema), percent)
    pairs = {(r.a, r.b) for r in pairs.collect()}
    keys = defaultdict(set)
    for r in groups.collect():
        keys[r.rep].add(r.key)
        assert r.core != rows[r.rep][-1]
    wanted = 0
    for i, x in enumerate(sets):
        for j in range(i):
            inter, union = jaccard(x, sets[j])
            if 100 * inter >= percent * union and (rows[i][-1] or rows[j][-1]):
                assert (j, i) in pairs or keys[i] & keys[j]
                wanted += 1
    assert wanted > 50 and keys and pairs


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_dedup_of_a_large_family(spark, monkeypatch, width, percent):
    """2,000 documents around two centres and along chains, some of them copies."""
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    rng = random.Random(width)

    def edited(words: list[str], most: int) -> list[str]:
        words = list(words)
        for _ in range(rng.randrange(1, most)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(3)] = [f"n{rng.randrange(400)}"] * rng.randrange(2)
        return words

    first = [f"w{i}" for i in range(150)]
    second = [w if i % 25 else "second" for i, w in enumerate(first)]
    texts = [first, second]
    for i in range(1998):
        texts.append(texts[-1] if i % 97 == 5 else edited(texts[-1], 3) if i % 5 == 4 and i > 1500 else edited(first if i % 2 else second, 12))
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, width, percent).collect()}
    sets = [shingle_set(ascii_lower_words(t), width) for _, t in rows]
    place = {e: k for k, e in enumerate(sorted({int(e) for x in sets for e in x}))}
    held = np.zeros((len(sets), len(place)), np.float32)
    for r, x in enumerate(sets):
        held[r, [place[int(e)] for e in x]] = 1
    inter = held @ held.T
    size = held.sum(axis=1)
    link = 100 * inter >= percent * (size[:, None] + size[None] - inter)
    label, before = np.arange(len(sets)), None
    while before is None or (label != before).any():
        before = label
        label = np.where(link, before[None], len(sets)).min(axis=1)
    assert got == dict(enumerate(label.tolist()))
    assert 1 < len(set(got.values())) < len(rows)


def test_documents_of_one_pivot_are_dealt_evenly(spark, monkeypatch):
    seen = []

    def spied(near, percent, whole=near_dedup._prefixes):
        seen.append([r.n for r in near.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return whole(near, percent)

    monkeypatch.setattr(near_dedup, "_prefixes", spied)
    rows = [(-1, i, 90, 100, 99, [i, -i - 1], i, i % 2 == 0) for i in range(400)]
    schema = "a bigint, b bigint, inter bigint, size_a bigint, size_b bigint, difference array<bigint>, label bigint, loose boolean"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near_dedup.by_difference(spark.createDataFrame(rows, schema), 85)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(seen[0]) == 400 and max(seen[0]) < 200


def test_texts_that_stay_are_not_shuffled(spark, odd_docs):
    """Only what a sieve lets through is joined with the documents to drop, or searched for."""
    rows = spark.range(20_000).withColumn("doc_id", F.when(F.col("id") % 7 > 0, F.col("id")))
    gone = spark.range(0, 20_000, 400)
    some, rest = common.sifted(rows, F.col("doc_id"), gone, F.col("id"))
    found = {r.doc_id for r in some.collect()}
    assert {r.id for r in gone.collect() if r.id % 7} <= found and len(found) < 200
    assert sorted(r.id for r in some.unionByName(rest).collect()) == list(range(20_000))
    kept = (exact_dedup.keep_documents(odd_docs), near_dedup.keep_documents(odd_docs, 5, 80), language_id.keep_documents(odd_docs, 0.4))
    for plan in (df._jdf.queryExecution().optimizedPlan().toString() for df in kept):
        top, dropped = plan.split("LeftAnti")
        assert "Union" in top and "sieve_bits" in dropped


def test_near_dedup_of_odd_rows(spark, odd_docs, no_docs):
    got = near_dedup.near_dedup(odd_docs, 5, 80).collect()
    assert len(got) == len(ROWS)
    named = {r.doc_id: r.component_id for r in got}
    assert named[6] == named[7] == 5 and named[11] == 4 and named[9] == 8 and named[1] == 1 and named[None] is None
    assert near_dedup.near_dedup(no_docs, 5, 80).collect() == []
    assert near_dedup.keep_documents(odd_docs, 5, 80).columns == odd_docs.columns


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_posterior_bound_keeps_pairs_at_the_threshold():
    for n, least in near_dedup.least_matches(0.85, 120):
        missed = sum(math.comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least))
        assert missed < 1e-5


def dense_log10(classes: list[int], p) -> float:
    alpha = p.start * p.emit[classes[0]]
    for k in classes[1:]:
        alpha = alpha @ p.move * p.emit[k]
    return float(np.log10(alpha.sum()))


def test_forward_recursion_is_exact_and_training_improves():
    rng = np.random.default_rng(0)
    p = hmm_lm.initial(np.arange(1, 8, dtype=float), 3)
    sequences = [rng.integers(0, 7, n) for n in (1, 5, 12, 30, 2)]
    layout = hmm_lm.Layout(sequences)
    scales = hmm_lm.forward(layout, p, False)[0]
    got = np.bincount(layout.sequence, np.log10(scales))
    assert got == pytest.approx([dense_log10(list(s), p) for s in sequences])
    last = -math.inf
    for _ in range(5):
        counts, log_p = hmm_lm.expected(layout, p)
        assert log_p > last and counts.emit.sum() == pytest.approx(50) and counts.move.sum() == pytest.approx(45)
        last = log_p
        p = hmm_lm.Params(counts.start / counts.start.sum(), counts.move / counts.move.sum(axis=1, keepdims=True), counts.emit / counts.emit.sum(axis=0))


def test_cutting_sequences_into_chunks_changes_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    p = hmm_lm.initial(np.arange(1, 30, dtype=float), 4)
    sequences = [rng.integers(0, 29, n) for n in (1, 7, 8, 9, 40, 16, 33, 3)]
    whole = hmm_lm.Layout(sequences)
    want, log_p = hmm_lm.expected(whole, p)
    scores = np.bincount(whole.sequence, np.log10(hmm_lm.forward(whole, p, False)[0]))
    for length in (1, 4, 8):
        monkeypatch.setattr(hmm_lm, "CHUNK_TOKENS", length)
        layout = hmm_lm.Layout(sequences)
        got, cut_p = hmm_lm.expected(layout, p)
        assert cut_p == pytest.approx(log_p)
        for part in ("start", "move", "emit"):
            assert getattr(got, part) == pytest.approx(getattr(want, part))
        assert np.bincount(layout.sequence, np.log10(hmm_lm.forward(layout, p, False)[0])) == pytest.approx(scores)


def wide(p):
    """In numbers that hold a long document's likelihood unscaled."""
    return hmm_lm.Params(*(x.astype(np.longdouble) for x in (p.start, p.move, p.emit)))


def dense_model(rows: list[tuple], states: int, share: int) -> dict:
    """Training and scores by one dense recursion per document; rows of (id, text, held_out)."""
    words = [[*ascii_lower_words(text), b""] for _, text, _ in rows]
    counts = Counter(w for found, (_, _, held) in zip(words, rows) if not held for w in found)
    total = sum(counts.values())
    head = {b"": 0} | {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if w and n * share >= total), 1)}
    classes = len(head) + hmm_lm.TAIL_CLASSES

    def number(w: bytes) -> int:
        return head[w] if w in head else len(head) + zlib.crc32(w[-3:]) % hmm_lm.TAIL_CLASSES

    tokens, kinds = np.zeros(classes), np.zeros(classes)
    for w, n in counts.items():
        tokens[number(w)] += n
        kinds[number(w)] += 1
    p = hmm_lm.initial(tokens, states)
    coded = [[number(w) for w in found] for found in words]
    for _ in range(hmm_lm.ITERATIONS):
        p = wide(p)
        start, move, emit = (np.zeros(n, np.longdouble) for n in (states, (states, states), (classes, states)))
        for ks, (_, _, held) in zip(coded, rows):
            if held:
                continue
            alpha, beta = [p.start * p.emit[ks[0]]], [np.ones(states)]
            for k in ks[1:]:
                alpha.append(alpha[-1] @ p.move * p.emit[k])
            for k in ks[:0:-1]:
                beta.append(p.move @ (p.emit[k] * beta[-1]))
            beta, whole = beta[::-1], alpha[-1].sum()
            for t, k in enumerate(ks):
                emit[k] += alpha[t] * beta[t] / whole
                if t:
                    move += np.outer(alpha[t - 1], p.emit[k] * beta[t]) * p.move / whole
            start += alpha[0] * beta[0] / whole
        share_of = (tokens + 0.5) / (tokens + 0.5).sum()
        emit, start, move = emit + hmm_lm.PRIOR * share_of[:, None], start + 0.1, move + 0.1
        p = hmm_lm.Params(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    out = {}
    for ks, found, (i, _, _) in zip(coded, words, rows):
        room = sum(math.log10((counts[w] + 0.5) / (tokens[k] + 0.5 if k < len(head) else tokens[k] + 0.5 * (kinds[k] + 1))) for w, k in zip(found, ks))
        out[i] = dense_log10(ks, wide(p)) + room
    return out


def test_language_model_score_equals_a_dense_model(spark, odd_docs, monkeypatch):
    """The query's score from text, trained on documents longer than a chunk and over many blocks."""
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 600)
    monkeypatch.setattr(hmm_lm, "HEAD_SHARE", 64)
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice('abcd')}{rng.randrange(1 + i % 30)}" for _ in range(rng.randrange(60) if i % 10 else 250 + 10 * i)), i % 4 == 1) for i in range(60)]
    rows += [(900, None, False), (901, "never seen", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r.score for r in hmm_lm.score_documents(docs, states=3).collect()}
    want = dense_model(rows, 3, 64)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_language_model_scores(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", 50)
    rng = random.Random(4)
    de, en = [f"d{i}" for i in range(40)], [f"e{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(de if i % 2 else en) for _ in range(30)), i % 5 == 1) for i in range(200)] + [(900, None, True), (901, "never seen", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean")
    got = {r.doc_id: r for r in hmm_lm.score_documents(docs, states=3).collect()}
    counts = Counter(w for _, t, held in rows if not held for w in [*(t or "").lower().split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, text, held in rows:
        words = [*(text or "").lower().split(), ""]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(words), sum(w in counts for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)
    odd = hmm_lm.score_documents(odd_docs.withColumn("held_out", F.lit(False))).collect()
    assert len(odd) == len(ROWS) and all(math.isfinite(r.score) for r in odd)
    nothing = hmm_lm.score_documents(odd_docs.filter("doc_id < 4").withColumn("held_out", F.lit(True))).collect()
    assert len(nothing) == 3 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)
    assert hmm_lm.score_documents(no_docs.withColumn("held_out", F.lit(False))).collect() == []


def test_head_words_do_not_hang_on_the_blocks(spark):
    share = hmm_lm.HEAD_SHARE
    rows = [(b"over", 0, 150), (b"over", 1, 60), (b"under", 0, 150), (b"under", 1, 40), (b"even", 0, 100), (b"even", 1, 100), (hmm_lm.END, 0, 900), (hmm_lm.END, 1, 900)]
    split = spark.createDataFrame([(*r, 100 * share) for r in rows], "word binary, block bigint, n bigint, block_n bigint")
    whole = split.groupBy("word").agg(F.lit(0).cast("bigint").alias("block"), F.sum("n").alias("n"), F.lit(200 * share).cast("bigint").alias("block_n"))
    assert hmm_lm.head_words(split) == hmm_lm.head_words(whole) == [b"even", b"over"]


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    quality = corpus_pipeline.STAGES[0][1](spark, docs, sf).cache()
    kept = {r.doc_id for r in __spark_entry__.queries()["op5_quality_rules"](spark, sf).collect() if r.kept}
    assert {r.doc_id for r in quality.collect()} == kept and quality.columns == docs.columns
    language = corpus_pipeline.STAGES[1][1](spark, quality, sf).cache()
    assert language.columns == docs.columns and language.count() >= 0.98 * quality.count()
    exact = corpus_pipeline.STAGES[2][1](spark, language, sf).cache()
    last = {}
    for r in sorted(language.collect(), key=lambda r: r.doc_id):
        last[(r.text or "").encode().lower()] = r.doc_id
    assert {r.doc_id for r in exact.collect()} == set(last.values())
    near = corpus_pipeline.STAGES[3][1](spark, exact, sf)
    want = brute_components([(r.doc_id, r.text) for r in exact.collect()], 5, 80)
    stay = {r.doc_id for r in near.collect()}
    assert stay == set(want.values())
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == stay and packed.groupby("sequence_id").length.sum().max() <= 1024


CONTRACTS = {
    "op1_token_count": {},
    "op2_chat_format": {},
    "op3_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_toxicity": {},
    "op5_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_hmm_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_queries_meet_their_contract(spark, name):
    sf = "/root/testdata/sf0.001"
    out = __spark_entry__.queries()[name](spark, sf)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    ids = Counter(r[0] for r in out.select(out.columns[0]).collect())
    if name not in ("op2_chat_format", "op3_packing"):
        assert ids == Counter(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs):
    """Nulls, repeated rows, missing ids and clashing names go through every stage, and so does nothing."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.materialize(stage(spark, docs, sf))
            assert out.columns == docs.columns, name
            assert out.exceptAll(docs).isEmpty(), name  # a stage keeps rows as they are
            docs = odd_docs if name == "quality rules" and docs is not no_docs else out
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, sf)
        assert pieces.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()


def test_tables_of_a_block_go_and_results_stay_until_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(common, "_KEPT", [])

    def folders():
        return len(list(tmp_path.glob("memlake-*")))

    def work():
        with common.scratch():
            common.materialize(spark.range(3))
            with common.scratch():
                common.materialize(spark.range(4))
                inner = common.kept_table(spark.range(5))
            assert inner.count() == 5
            out = common.kept_table(inner)
        return out

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    out = work()
    assert folders() == 4 and out.count() == 5
    common.drop_table(out)
    assert folders() == 3
    common.release()
    assert folders() == 0
