"""Token counts, BPE, quality rules, toxicity and language identification."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

import __spark_entry__
from memlake.llm import bpe, language_id, quality_rules, token_count, toxicity
from tests.llm.conftest import LONG, ROWS

UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def noise(n: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    alphabet = [" ", "\n", "a", "B", "1", ".", "'s", "é", "\t", "  ", "漢", "́", "\x1c", "\x85", "▁", "💥"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_token_count_equals_a_unigram_tokenizer(byte_pieces):
    scores, _ = token_count.read_vocabulary(UNIGRAM)
    pieces = [("<unk>", 0.0), *scores.items(), *([(f"<0x{i:02X}>", 0.0) for i in range(256)] if byte_pieces else [])]
    reference = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_pieces))
    model = token_count.Unigram(scores, byte_pieces)
    for text in [*noise(500), "日本 語 x", "x" * 3000, LONG[:5000]]:
        if "▁" not in text:
            spelled = "▁" + text.replace(" ", "▁") if text else ""
            assert model.count(text)[0] == len(reference.encode(spelled).ids), text


def test_token_count_ties_take_the_longest_last_piece():
    model = token_count.Unigram({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "▁ab": -3.0}, False)
    assert model.solve("▁ab") == (1, -3.0)
    assert model._solve_unknown("▁ab") == (1, -3.0)


def test_token_count_of_odd_rows(spark, odd_docs, no_docs):
    got = token_count.count_tokens(odd_docs, UNIGRAM).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert token_count.count_tokens(no_docs, UNIGRAM).collect() == []


def test_bpe_cuts_long_texts_at_safe_boundaries():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in [LONG, *("".join(noise(40, seed)) for seed in range(50))]:
        pieces = bpe.safe_pieces(text, 50)
        assert "".join(pieces) == text
        assert [t for p in pieces for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def long_runs(n: int) -> list[str]:
    mixed = "".join(random.Random(3).choices(" \n\t\r\u3000\xa0", k=n))
    return [x for run in (" " * n, "\n" * n, mixed) for x in (run, run + "end", "start" + run, "mid" + run + " dle", "a b" + run + "1 2" + run + "!")]


def test_bpe_of_long_white_space_equals_the_pattern():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in long_runs(bpe.RUN_CHARS + 3):
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_bpe_of_ten_million_white_space_characters(spark):
    texts = [x for x in long_runs(10**7) if not x.startswith("a b")]
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in texts:
        assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()
    rows = spark.createDataFrame([(1, " " * 10**6), (2, "x" + "\n" * 10**6 + "y")], "doc_id bigint, text string")
    assert all(r.round_trip for r in bpe.encode_documents(rows, RANKS, public_tokenizers.PATTERN).collect())


def test_caches_are_bounded_by_characters():
    rng = random.Random(1)
    model = token_count._model(UNIGRAM)
    unspaced = "".join(rng.choices("日本語漢字", k=5000))
    before = len(model._young)
    model.count(unspaced)
    assert len(model._young) == before and all(len(w) <= token_count.LONG_WORD for w in model._young)


def test_bpe_round_trip(spark, odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    texts = Counter((i, t or "") for i, t, _ in ROWS)
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, enc.decode(list(r.ids))) for r in got) == texts
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def slow_stats(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_statistics_equal_brute_force():
    rng = random.Random(3)
    texts = [t for _, t, _ in ROWS if t is None or len(t) < 5000]
    texts += [" ".join(rng.choice(["a", "b", "c#", "d\nq", "a\na", "ü|"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    for text in texts:
        assert quality_rules.text_stats(text)[:5] == slow_stats(text)


def test_quality_rules_learn_and_apply(spark, odd_docs, no_docs):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(60)), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(0, 0), (None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(got[i].kept == (q == 1) for i, _, q in good + bad if i)
    kept = {r.doc_id for r in quality_rules.keep_documents(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    odd = quality_rules.quality_rules(odd_docs, labels.limit(0)).collect()
    assert len(odd) == len(ROWS) and all(r.kept != r.base_failed for r in odd)
    assert quality_rules.keep_documents(odd_docs, labels.limit(0)).columns == odd_docs.columns
    assert quality_rules.quality_rules(no_docs, labels.limit(0)).collect() == []


def test_decision_list_is_ordered_and_pruned():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (3000, len(quality_rules.FEATURES)))
    bad = (x[:, 0] > 0.8) | ((x[:, 2] < 0.2) & (x[:, 3] > 0.5))
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3 != 0)
    fired = np.zeros(3000, bool)
    for rule in rules:
        fired |= quality_rules._covers(list(rule.conditions), x)
        assert rule.precision >= 0.95
    assert (fired == bad).mean() > 0.97


def test_toxicity_orders_severity(spark, odd_docs, no_docs):
    rng = random.Random(1)
    plain = [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = rng.sample(plain, 30)
        toxic = int(i % 3 == 0)
        if toxic:
            words += rng.sample(["nasty", "vile", "awful", "rotten"], 1 + 3 * (i % 2))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, i % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([(i, t) for i, t, _ in labels], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, table.filter("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score(docs.filter("doc_id >= 600"), model).collect()}
    assert all(got[i].toxic == bool(t) for i, t, _ in labels if i >= 600)
    mean = {h: np.mean([got[i].expected_severity for i, t, heavy in labels if i >= 600 and t and heavy == h]) for h in (0, 1)}
    assert mean[1] > mean[0] > 0.5
    assert model.cuts[0] <= model.cuts[1] and all(0 <= r.expected_severity <= 2 for r in got.values())
    empty = toxicity.learn(docs, table.limit(0))
    odd = toxicity.score(odd_docs, empty).collect()
    assert len(odd) == len(ROWS) and not any(r.toxic for r in odd)
    assert toxicity.score(no_docs, model).collect() == []


def brute_languages(rows: list[tuple]) -> dict:
    """The method with plain dictionaries; rows of (id, text, lang or None where it does not train)."""
    words = defaultdict(Counter)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            words[lang].update(language_id.words_of(text))
    languages = sorted({lang for _, text, lang in rows if text is not None and lang is not None})
    grams = {lang: defaultdict(Counter) for lang in languages}
    for lang in languages:
        for word, n in words[lang].items():
            spelled = f"<{word}>"
            for size in range(1, 6):
                for i in range(len(spelled) - size + 1):
                    grams[lang][size][spelled[i : i + size]] += n

    def shares(counts: list[Counter], key: str) -> np.ndarray:
        return np.array([math.log((c[key] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))) for c in counts])

    known = {}
    for size in range(1, 6):
        counts = [grams[lang][size] for lang in languages]
        for c in counts:
            known.update({g: shares(counts, g) for g in c if g not in known})
    floor = np.full(len(languages), min((v.min() for v in known.values()), default=0.0))

    def score(word: str) -> np.ndarray:
        if any(words[lang][word] for lang in languages):
            return np.array([math.log((words[lang][word] + 0.5) / (sum(words[lang].values()) + 1)) for lang in languages])
        spelled, found = f"<{word}>", []
        for i in range(len(spelled) - 1):
            fits = [spelled[i:j] for j in range(min(i + 5, len(spelled)), i, -1) if spelled[i:j] in known]
            found.append(known[fits[0]] if fits else floor)
        return np.mean(found, axis=0)

    scored, out = {}, []
    for i, text, _ in rows:
        found = language_id.words_of(text)
        if not found or not languages:
            out.append((i, "und", 0.0))
            continue
        for w in found:
            if w not in scored:
                scored[w] = score(w)
        mean = np.mean([scored[w] for w in found], axis=0)
        best = int(mean.argmax())
        out.append((i, languages[best], 1 / np.exp(language_id.SHARPNESS * (mean - mean[best])).sum()))
    return out


def same_languages(got, want) -> None:
    def by(r):
        return (r[0] is None, r[0] or 0, r[2])

    got, want = sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=by), sorted(want, key=by)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-4)


def test_language_id_of_whole_tables_equals_brute_force(spark, monkeypatch):
    """The registered query, with small blocks."""
    monkeypatch.setattr(language_id, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(language_id, "WORDS_AT_ONCE", 500)
    monkeypatch.setattr(language_id, "PACKED_TOKENS", 700)
    monkeypatch.setattr(language_id, "UNSEEN_BLOCK", 300)
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    got = __spark_entry__.queries()["op10_language_id"](spark, sf)
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(got.columns)
    got = got.collect()
    assert all(r.held_out == held[r.doc_id] for r in got)
    same_languages(got, brute_languages([(i, text, None if held[i] else lang) for i, text, lang in rows]))
    langs = {i: lang for i, _, lang in rows}
    right = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(right) >= 0.95 * len(right)


def test_language_id_sends_rare_words_only(spark, monkeypatch):
    """Frequent words are summed up where the text is read; the rest, known or not, comes by shuffle."""
    monkeypatch.setattr(language_id, "HEAD", 300)
    monkeypatch.setattr(language_id, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(language_id, "BLOCK_COUNTS", 4000)
    sent = []

    def spied(words, *rest, whole=language_id._scores_by_block):
        sent.append(words.count())
        return whole(words, *rest)

    monkeypatch.setattr(language_id, "_scores_by_block", spied)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(200)
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 3 else None) for r in docs.collect()]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    same_languages(got.collect(), brute_languages(rows))
    found = Counter(w for _, text, _ in rows for w in language_id.words_of(text))
    often = sum(n for _, n in found.most_common(100))
    assert len(found) - 300 <= sent[0] < sum(found.values()) - often


def test_language_id_of_odd_rows(spark, odd_docs, no_docs):
    taught = [("der hund und die katze " * 30, "de"), ("le chien et le chat " * 30, "fr"), ("the dog and the cat " * 30, "en"), (None, "xx"), ("x", None)]
    asked = [("und die hunde", "de"), ("chiens et chats", "fr"), ("dogs and cats", "en"), ("12 !?", "und"), (None, "und")]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(taught)] + [(100 + i, text, None) for i, (text, _) in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.predict(docs, F.lit(True)).collect()
    same_languages(got, brute_languages(rows))
    named = {r.doc_id: r.lang_pred for r in got}
    assert [named[100 + i] for i in range(len(asked))] == [lang for _, lang in asked]
    same_languages(language_id.predict(odd_docs, F.lit(True)).collect(), brute_languages(ROWS))
    assert language_id.predict(no_docs, F.lit(True)).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd_docs, F.lit(False)).collect()} == {"und"}
    kept = language_id.keep_documents(odd_docs, 0.4)
    want = Counter(i for i, _, score in brute_languages(ROWS) if score >= 0.4)
    assert kept.columns == odd_docs.columns and Counter(r.doc_id for r in kept.collect()) == want


def test_equal_language_sums_take_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (3, "same", None)], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, F.lit(True)).collect()} == {("a", 0.5)}


def repeated(spark, odd_docs):
    """Documents of sf0.01 with their labels, odd ones, and an id with several texts and labels."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.first().doc_id
    more = spark.createDataFrame([(known, "another text of this id " * 9), (known, None), (known, "")], "doc_id bigint, text string")
    odd = odd_docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    return docs.unionByName(more).unionByName(odd), labels.unionByName(labels.limit(5))


def test_verdicts_of_quality_rules_equal_brute_force(spark, odd_docs):
    """The first rule whose conditions all hold decides, with every statistic counted by hand."""
    docs, labels = repeated(spark, odd_docs)
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and rules == quality_rules.learn_rules(docs.repartition(7), labels.repartition(3))
    got = quality_rules.quality_rules(docs, labels).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    fired = Counter()
    for r in got:
        some = [dict(zip(quality_rules.STATS, quality_rules.text_stats(t))) for t in texts[r.doc_id]]
        stats = next(s for s in some if all(s[k] == r[k] for k in quality_rules.STATS))
        slow = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), slow_stats(next(t for t, s in zip(texts[r.doc_id], some) if s == stats))))
        failed = slow["n_words"] < 20 or 100 * slow["n_repeat_words"] > 30 * slow["n_words"]
        want = 0 if failed else None
        for i, rule in enumerate(rules, 1):
            values = [stats[quality_rules.FEATURES[c.feature][1]] / max(stats[quality_rules.FEATURES[c.feature][2]], 1) for c in rule.conditions]
            if want is None and all(v > c.threshold if c.above else v < c.threshold for v, c in zip(values, rule.conditions)):
                want = i
        assert (r.base_failed, r.rule, r.kept) == (failed, want, want is None)
        fired[want] += 1
    assert fired[0] and fired[None] and sum(n for k, n in fired.items() if k)


def test_severity_equals_brute_force(spark, odd_docs):
    """Sums of weights over distinct words and beginnings, against the ordered cuts, number by number."""
    docs, labels = repeated(spark, odd_docs)
    model = toxicity.learn(docs, labels)
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert model.weights.keys() == again.weights.keys() and model.weights and list(model.cuts) == sorted(model.cuts)
    want = Counter()
    for r in docs.collect():
        words = set(re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        features = words | {f"^{w[:n]}" for w in words for n in (3, 4, 5) if len(w) > n}
        z = sum(model.weights.get(f, 0.0) for f in features)
        above = [1 / (1 + math.exp(-(z - cut))) for cut in model.cuts]
        chance = [1 - above[0], above[0] - above[1], above[1]]
        want[r.doc_id, round(sum(k * p for k, p in enumerate(chance)), 6), above[0] >= toxicity.THRESHOLD] += 1
    assert Counter((r.doc_id, round(r.expected_severity, 6), r.toxic) for r in toxicity.score(docs, model).collect()) == want
