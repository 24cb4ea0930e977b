"""Behaviour that has no SQL twin: text helpers, chunkers, packs, streams, vaults."""

from __future__ import annotations

import datetime
import hashlib
import json
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.functions import chunking as ch
from memlake.functions import text as T
from memlake.operators import context, filters, joins, lifecycle, merge, similarity
from memlake.plans import synthesis
from memlake.schemas import TRANSITIONS
from memlake.sources import exchange, planes
from memlake.sources.scratch import ensure_checkpoint_dir
from memlake.streaming import jobs


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_truncation_keeps_clusters_whole(spark):
    texts = ["plain text that is long", "flag 🇩🇪🇫🇷 end", "family 👨‍👩‍👧‍👦 here", "é" * 10, None, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 5, 7, 8, 12):
        for whole, got in zip(texts, column(df, T.truncate_grapheme(n)("t"))):
            if whole is None:
                assert got is None
                continue
            assert len(got) <= n
            if len(whole) <= n:
                assert got == whole
            else:
                body = got.removesuffix("...") if n > 3 else got
                assert whole.startswith(body)
                clusters = T.CLUSTER.findall(whole)
                assert body in ["".join(clusters[:k]) for k in range(len(clusters) + 1)]


def test_normalize_content_folds_unicode(spark):
    df = spark.createDataFrame([("  Ｓtraße\n IS  Here!?. ",), (None,)], "t string")
    assert column(df, T.normalize_content("t")) == ["strasse is here", None]


def test_ksuid_timestamp(spark):
    df = spark.createDataFrame([("0" * 27,), ("0ujtsYcgvSTl8PAuAdqWYSMnLOv",), ("bad",), ("!" * 27,)], "t string")
    assert column(df, T.ksuid_timestamp("t")) == [1_400_000_000, 1507608047, None, None]


def test_redaction_is_idempotent(spark):
    df = spark.createDataFrame([("mail a.b+c@d-e.org, 123-45-6789 or 555-123-4567 now",)], "t string")
    once = df.select(T.redact_pii(F.col("t")).alias("t"))
    assert column(once, "t") == ["mail [REDACTED], [REDACTED] or [REDACTED] now"] == column(once, T.redact_pii(F.col("t")))


def test_token_windows_overlap_and_end():
    text = " ".join(f"w{i}" for i in range(1000))
    spans = list(ch.token_windows(text, 512, 128))
    chunks = [text[a:b].split() for a, b in spans]
    assert [c[0] for c in chunks] == ["w0", "w384", "w768"] and chunks[-1][-1] == "w999" and [len(c) for c in chunks] == [512, 512, 232]
    assert list(ch.token_windows("", 5, 1)) == [] and len(list(ch.token_windows("a b c", 2, 1))) == 2


def test_markdown_sections_and_json_elements(spark):
    text = "intro\n## One\na\n### Deep\nb\n## Two\nc"
    assert [(text[a:b].split("\n")[0], p) for a, b, p in ch.markdown_sections(text)] == [("intro", "unknown"), ("## One", "One"), ("### Deep", "Deep"), ("## Two", "Two")]
    texts = {"1": '["x1","y", {"k":1,"é":[1,2.50]}, null]', "2": '{"k": 1}', "3": "[broken", "4": "[]", "5": " [1,[2]] "}
    df = spark.createDataFrame(list(texts.items()), "object_id string, content string")
    got = {(r.object_id, r.chunk_index): r.content for r in ch.chunk_json(df).collect()}
    want = {("1", 0): '"x1"', ("1", 1): '"y"', ("1", 2): '{"k": 1, "\\u00e9": [1, 2.5]}', ("1", 3): "null", ("2", 0): '{"k": 1}', ("3", 0): "[broken", ("5", 0): "1", ("5", 1): "[2]"}
    assert got == want


def test_namespace_patterns(spark):
    df = spark.createDataFrame([("a/b/episodic",), ("a/c/episodic",), ("a/b/c/episodic",), ("x/b/episodic",)], "namespace string")
    assert sorted(column(filters.match_namespace_pattern(df, "a/*/episodic"), "namespace")) == ["a/b/episodic", "a/c/episodic"]
    for bad in ("a/**/x", "a/n*/x", "a//x"):
        with pytest.raises(ValueError):
            filters.match_namespace_pattern(df, bad)


def chain(spark, edges):
    return spark.createDataFrame(edges, "object_id string, superseded_by string")


def test_tips_of_chains_loops_and_dangling_tails(spark):
    rows = [(f"c{i}", f"c{i + 1}") for i in range(63)] + [("c63", None), ("d", "gone"), ("x", "y"), ("y", "x")]
    got = {r.object_id: (r.tip, r.hops) for r in joins.supersession_tip(chain(spark, rows)).collect()}
    assert got["c0"] == ("c63", 63) and got["c62"] == ("c63", 1) and got["c63"] == ("c63", 0) and got["d"] == ("d", 0) and got["x"][1] == 64
    proposed = spark.createDataFrame([("c10", "c5"), ("c5", "c10"), ("d", "d"), ("d", "x")], "object_id string, target string")
    cyclic = {(r.object_id, r.target): r.cyclic for r in joins.supersession_cycle(chain(spark, rows), proposed).collect()}
    assert cyclic == {("c10", "c5"): True, ("c5", "c10"): False, ("d", "d"): True, ("d", "x"): False}


def test_every_transition_is_judged_by_the_table(spark):
    states = sorted({s for table in TRANSITIONS.values() for s in table})
    for kind, table in TRANSITIONS.items():
        rows = spark.createDataFrame([(f"{a}-{b}", "a/b/c", a, 1, 0.0, None) for a in table for b in states], "object_id string, namespace string, state string, version int, updated_epoch double, superseded_by string")
        intents = rows.select(F.col("object_id").alias("intent_id"), "object_id", F.split("object_id", "-")[1].alias("to_state"), F.lit(1).alias("expected_version"), F.lit("r").alias("reason"), F.lit("t").alias("actor"), F.lit(None).cast("string").alias("target"), F.lit(0.0).alias("requested_at"))
        _, events, errors = lifecycle.apply_transitions(rows, intents, kind, 9.0, with_targets=False)
        assert {r.object_id for r in events.collect()} == {f"{a}-{b}" for a in table for b in table[a]}
        assert {r.code for r in errors.collect()} <= {"illegal_transition"}


def test_sweeps_are_idempotent(spark):
    e = planes.episodic(spark, "/root/testdata/sf0.001")
    once, events = lifecycle.sweep(e, lifecycle.stale_provisional(planes.NOW), "archived", "ttl", "episodic", planes.NOW)
    _, again = lifecycle.sweep(once, lifecycle.stale_provisional(planes.NOW), "archived", "ttl", "episodic", planes.NOW)
    assert events.count() > 0 and again.count() == 0 and once.count() == e.count()


def test_pack_respects_the_budget(spark):
    rows = []
    rng = random.Random(0)
    for q in range(6):
        for i in range(20):
            rows.append((q, f"o{i:02d}", rng.choice(["recent", "ranked"]), "a/b/episodic", "episodic", "matured", "word " * rng.randrange(1, 120), None, None, ["kind:boundary"] if i % 5 == 0 else [], 100.0 + i, 100.0 + i, 5, 0.5))
    schema = "query_id int, object_id string, lane string, namespace string, plane string, state string, content string, summary string, title string, tags array<string>, created_epoch double, updated_epoch double, importance int, retrieve_score double"
    queries = spark.createDataFrame([(q, "word" if q % 2 else "") for q in range(6)], "query_id int, query_text string")
    packed = context.pack(context.essence_rank(context.with_kind(spark.createDataFrame(rows, schema)), queries), 8, 600, 2)
    by_query = defaultdict(list)
    for r in packed.orderBy("query_id", "item").collect():
        by_query[r.query_id].append(r)
    for items in by_query.values():
        assert len(items) <= 8 and sum(len(r.content) for r in items) <= 600
        recent = [r for r in items if r.lane == "recent"]
        assert len(recent) <= 2 and sum(len(r.content) for r in recent) <= 200
        assert [r.lane for r in items] == sorted((r.lane for r in items), reverse=True)
    text = context.render_pack(packed).collect()
    assert len(text) == 6 and all(r.text.split("\n")[0] in ("Must-Obey:", "Context:") for r in text)


def windows_by_hand(events, length):
    start, out = {}, {}
    for key, at, i in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in start or at >= start[key] + length:
            start[key] = at
        out[i] = start[key]
    return out


def test_anchored_windows_and_captures(spark):
    rng = random.Random(5)
    events = [(f"k{rng.randrange(5)}", rng.randrange(1000), i) for i in range(400)]
    df = spark.createDataFrame(events, "token string, at_us long, event_id long")
    got = {r.event_id: r.window_us for r in jobs.anchored_windows(df, ["token"], 60).collect()}
    assert got == windows_by_hand(events, 60)
    with_body = df.withColumn("body", (F.col("event_id") % 3).cast("string"))
    outcome = {r.event_id: (r.first_id, r.outcome) for r in jobs.idempotent_capture(with_body, ["token"], 60).collect()}
    for i, (first, what) in outcome.items():
        assert what == ("new" if i == first else "replay" if i % 3 == first % 3 else "conflict")


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    """In event time: files that come late, a pause and a replay from the checkpoint change nothing."""
    base = 1_700_000_000_000_000
    events = [("t", "batch-write", 50, base + i * 500_000, i) for i in range(300)] + [("u", "batch-write", 50, base + i * 5_000_000, 1000 + i) for i in range(50)]
    schema = "token string, bucket string, capacity long, at_us long, event_id long"
    table = spark.createDataFrame(events, schema).withColumn("ts", F.timestamp_micros("at_us"))
    source = str(tmp_path / "in")
    for name, rows in (("a", f"at_us < {base + 40_000_000}"), ("b", f"at_us >= {base + 40_000_000}")):
        table.filter(rows).drop("at_us").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.drop("at_us").schema).parquet(source)
        limited = jobs.rate_limit_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        limited.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.event_id: (r.allowed, r.remaining, r.retry_after_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = jobs.rate_limit(spark.createDataFrame(events, schema).withColumn("operator", F.lit(False))).collect()
    assert got == {r.event_id: (r.allowed, r.remaining, r.retry_after_us) for r in batch} and not all(x[0] for x in got.values())


def test_rate_limit_stream_counts_a_late_request_in_its_window(spark, tmp_path):
    files = [[(1, 0), (2, 61)], [(3, 30), (4, 62)]]  # the second file's first request belongs to the first window
    for rows in files:
        table = spark.createDataFrame([("t", "b", 1, 1_700_000_000 + s, i) for i, s in rows], "token string, bucket string, capacity long, s long, event_id long")
        table = table.withColumn("ts", F.timestamp_seconds("s")).drop("s")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        limited = jobs.rate_limit_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        limited.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.event_id: (r.allowed, r.retry_after_us) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 30_000_000), 4: (False, 59_000_000)}


def test_late_rows_go_to_the_side(spark, tmp_path):
    good, side = str(tmp_path / "good"), str(tmp_path / "side")

    def write(rows, late, number):
        rows.write.mode("overwrite").parquet(f"{good}/batch={number}")
        late.write.mode("overwrite").parquet(f"{side}/batch={number}")

    for seconds in ([1000, 5000], [4500, 4300, 9000], [8000]):
        table = spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").alias("ts"), "s")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        jobs.late_rows_stream(stream, str(tmp_path / "cp"), write).awaitTermination(120)
    assert sorted(r.s for r in spark.read.parquet(good).collect()) == [1000, 4500, 5000, 9000]
    assert sorted(r.s for r in spark.read.parquet(side).collect()) == [4300, 8000]


def test_stream_dedup_and_usage(spark, tmp_path):
    rows = [("k", "b", 0), ("k", "b", 10), ("k", "c", 20), ("j", "b", 30)]
    df = spark.createDataFrame(rows, "token string, body string, s int").withColumn("ts", F.timestamp_seconds("s")).withColumn("bucket", F.lit("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.drop_replays(stream, ["token"]).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.token, r.body) for r in spark.table("kept").collect()) == [("j", "b"), ("k", "b"), ("k", "c")]


def test_vault(spark, tmp_path):
    (tmp_path / "curated/en").mkdir(parents=True)
    (tmp_path / "_skip").mkdir()
    (tmp_path / "curated/en/a.md").write_text('---\ntitle: A note\ntags: ["X y", "x y"]\nimportance: 3\n---\n\nBody text\n')
    (tmp_path / "curated/en/.hidden.md").write_text("no")
    (tmp_path / "_skip/b.md").write_text("no")
    (tmp_path / "plain.md").write_text("just text")
    vault = exchange.read_vault(spark, str(tmp_path))
    rows = {r.path: r for r in vault.collect()}
    assert set(rows) == {"curated/en/a.md", "plain.md"} and rows["curated/en/a.md"].body == "Body text" and rows["plain.md"].frontmatter == ""
    got = {r.path: r for r in exchange.frontmatter_to_curated(exchange.parse_frontmatter(vault)).collect()}
    a = got["curated/en/a.md"]
    assert (a.title, a.importance, a.tags, a.reason) == ("A note", 3, ["x-y"], None) and got["plain.md"].reason == "bad_title"


def test_packs_cover_every_document(spark):
    from memlake.queries import QUERIES
    from memlake.queries.auditing import lanes

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    asked = {i // 40 for i in docs}
    assert max(docs) >= 400
    lane = {q: sorted((i for i in docs if i // 40 == q and (i % 4 == 0 or i % 12 == 3)), reverse=True)[:10] for q in asked}
    recent = {i for some in lane.values() for i in some}
    candidates, queries = lanes(spark, sf)
    assert sorted((r.query_id, r.number, r.content) for r in candidates.collect()) == sorted((i // 40, i, t) for i, t in docs.items() if i % 4 or i in recent)
    first = {q: docs[min(i for i in docs if i // 40 == q)] for q in asked}
    assert {r.query_id: r.query_text for r in queries.collect()} == {q: " ".join(t.split(" ")[:4]) for q, t in first.items()}
    assert {r.query_id for r in QUERIES["c05_pack"](spark, sf).collect()} == {r.query_id for r in QUERIES["c06_render_pack"](spark, sf).collect()} == asked


def test_synthesis_reinforces_creates_and_links(spark):
    ensure_checkpoint_dir(spark)
    at = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.8, 0.6]}
    rows = [(f"{p}{i}", f, at[p], [], ["t"], 5, f"text {p}", 10.0) for f, ps in (("en", "abc"), ("de", "a")) for p in ps for i in (f + "1", f + "2", f + "3")]
    rows.append(("lone", "en", [0.0, 0.0, -1.0], [], ["t"], 5, "alone", 10.0))
    rows.append(("odd", "en", [float("nan"), 0.0, 1.0], [], ["t"], 5, "no vector", 10.0))
    memories = spark.createDataFrame(rows, "object_id string, family string, vector array<double>, topics array<string>, tags array<string>, importance int, content string, updated_epoch double")
    cursors = spark.createDataFrame([("en", 0.0), ("de", 0.0)], "family string, cursor double")
    pool = spark.createDataFrame([("en", "old", -1e9, 4)], "family string, object_id string, first_seen double, attempts int")
    known = [("K1", "en", "matured", at["a"], "known a"), ("K2", "en", "demoted", at["b"], "known b"), ("K3", "en", "matured", None, "no vector")]
    existing = spark.createDataFrame([(i, f + "/shared/concept", f, s, "t", c, 5, ["x"], v, 2, [], None, 1) for i, f, s, v, c in known], "object_id string, namespace string, family string, state string, title string, content string, importance int, merged_from array<string>, vector array<double>, reinforcement_count int, contradicts array<string>, last_reinforced_epoch double, version int")
    out = synthesis.synthesize(memories, cursors, pool, existing, 20.0, lambda x, y: True, threshold=0.9)
    got = {r.object_id: r for r in out["concepts"].collect()}
    assert got["K1"].reinforcement_count == 5 and got["K1"].merged_from == ["x", "aen1", "aen2", "aen3"] and got["K1"].last_reinforced_epoch == 20.0
    assert all(got[k].reinforcement_count == 2 and got[k].merged_from == ["x"] for k in ("K2", "K3"))
    made = {tuple(r.merged_from): r for k, r in got.items() if not k.startswith("K")}
    assert set(made) == {tuple(f"{p}{f}{i}" for i in (1, 2, 3)) for p, f in (("b", "en"), ("c", "en"), ("a", "de"))}
    b, c, de = (made[tuple(f"{x}{i}" for i in (1, 2, 3))] for x in ("ben", "cen", "ade"))
    assert (b.contradicts, c.contradicts, de.contradicts, got["K1"].contradicts) == ([c.object_id], [b.object_id], [], [])
    report = {r.family: r.asDict() for r in out["report"].collect()}
    assert report == {
        "en": {"family": "en", "selected": 10, "clusters": 3, "created": 2, "reinforced": 1, "contradictions": 1, "pruned": 1, "carried": 1, "decode_failed": 1},
        "de": {"family": "de", "selected": 3, "clusters": 1, "created": 1, "reinforced": 0, "contradictions": 0, "pruned": 0, "carried": 0, "decode_failed": 0},
    }
    def picky(members):
        if members[0][1] == "text b":
            raise ValueError("no summary")
        return ("T " + members[0][1], "C", "R") if members[0][1] == "text a" else None

    some = synthesis.synthesize(memories, cursors, pool, existing.limit(0), 20.0, lambda x, y: True, threshold=0.9, summarizer=picky)
    assert sorted((r.title, r.content, r.rationale, len(r.merged_from)) for r in some["concepts"].collect()) == [("T text a", "C", "R", 3), ("T text a", "C", "R", 3)]
    waiting = {r.object_id for r in some["pool"].collect() if r.family == "en"}
    assert {"ben1", "ben2", "ben3", "cen1", "cen2", "cen3", "lone"} <= waiting and not waiting & {"aen1", "aen2", "aen3"}
    again = synthesis.synthesize(memories, cursors, pool, out["concepts"], 20.0, lambda x, y: False, threshold=0.9)["concepts"]
    assert again.count() == len(got)


def test_long_chains_are_one_cluster(spark):
    ensure_checkpoint_dir(spark)
    falling = ["s00", *(f"x{i:02d}" for i in range(40, 0, -1)), "t00"]  # a smaller label moves one hop a round
    pairs = [("g", a, b) for a, b in zip(falling, falling[1:])] + [("h", "s00", "x01"), ("h", "x01", "x02"), ("h", "y", "z")]
    got = similarity.clusters(spark.createDataFrame(pairs, "group string, a string, b string")).collect()
    assert sorted((r.group, r.cluster, r.object_id) for r in got) == sorted([("g", "s00", x) for x in falling] + [("h", "s00", x) for x in ("s00", "x01", "x02")])


def test_retraction_writes_a_bounded_tombstone(spark):
    family = "é👨\u200d👩\u200d👧"  # two bytes and one cluster of 18
    rows = [("1", family * 400), ("2", "short"), ("3", "x" * 1000), ("4", "y" * 1000)]
    df = spark.createDataFrame([(i, "a/b/c", text, 0.0) for i, text in rows], "object_id string, namespace string, content string, updated_epoch double")
    asked = spark.createDataFrame([(i, "2024-05-01", "wrong", "t" * n) for i, n in (("1", 10), ("2", 10), ("3", 32_300), ("4", 32_600))], "object_id string, asked_on string, because string, truth string")
    stones, artifacts, refused = synthesis.retract(df, asked, 5.0)
    got, kept, text = {r.object_id: r for r in stones.collect()}, {r.object_id: r for r in artifacts.collect()}, dict(rows)
    assert [(r.object_id, r.reason) for r in refused.collect()] == [("4", "CONTENT_TOO_LARGE")] and sorted(got) == ["1", "2", "3"]
    excerpts = {"1": family * 13, "2": "short", "3": "x" * 256}  # 13 clusters pairs are the first to reach 256 bytes
    for i, r in got.items():
        truth = {"3": 32_300}.get(i, 10)
        want = f"Withdrawn on 2024-05-01: this memory is wrong, nothing may rest on it.\nReason: wrong\nIt began:\n{excerpts[i]}\nWhat holds instead:\n{'t' * truth}\nIts whole text is kept as artifact {r.evidence_id}."
        assert r.content == want and len(want.encode()) <= synthesis.TOMBSTONE_BYTES
        assert r.kept_bytes == len(excerpts[i].encode()) and r.kept_bytes + r.omitted_bytes == r.original_bytes == len(text[i].encode())
        a = kept[r.evidence_id]
        assert (a.content, a.size_bytes, a.sha256) == (text[i], r.original_bytes, hashlib.sha256(text[i].encode()).hexdigest()) and r.original_digest == a.sha256


def test_merges_keep_what_they_do_not_raise(spark):
    rows = spark.createDataFrame([("episodic", "n", "1", 3, 6.0), ("episodic", "n", "2", 0, 2.0), ("episodic", "m", "2", 0, 9.0), ("artifact", "n", "1", 1, None)], "plane string, namespace string, object_id string, access_count int, last_accessed_epoch double")
    seen = spark.createDataFrame([(1, "episodic", "n", "2", 5.0), (1, "episodic", "n", "2", 4.0), (2, "episodic", "m", "2", 3.0), (2, "artifact", "n", "1", 8.0)], "delivery_id long, plane string, namespace string, object_id string, delivered_epoch double")
    got = {(r.plane, r.namespace, r.object_id): (r.access_count, r.last_accessed_epoch) for r in merge.account_access(seen, rows).collect()}
    assert got == {("episodic", "n", "1"): (3, 6.0), ("episodic", "n", "2"): (1, 5.0), ("episodic", "m", "2"): (1, 9.0), ("artifact", "n", "1"): (1, None)}
    concepts = spark.createDataFrame([("1", None, 0), ("2", None, 0), ("3", "k", 1)], "object_id string, promoted_to string, promotion_attempts int")
    bad = spark.createDataFrame([("1", "short", 4.0), ("3", "short", 4.0), ("2", "", 4.0)], "object_id string, reason string, rejected_epoch double")
    once = merge.record_rejections(concepts, bad)
    twice = {r.object_id: (r.promotion_attempts, r.rejected_epoch, r.rejected_reason) for r in merge.record_rejections(once, bad.filter("object_id = '2'")).collect()}
    assert twice == {"1": (1, 4.0, "short"), "2": (0, None, None), "3": (1, None, None)}


def test_replies_are_followed_to_any_depth(spark):
    rows = [(f"m{i:03d}", f"m{i - 1:03d}" if i else None) for i in range(150)] + [("x", "gone"), ("c1", "c2"), ("c2", "c1"), ("below", "c1")]
    got = {r.object_id: (r.root, r.depth) for r in joins.reply_chain(spark.createDataFrame(rows, "object_id string, in_reply_to string")).collect()}
    assert got == {f"m{i:03d}": ("m000", i) for i in range(150)} | {"x": ("x", 0), "c1": (None, None), "c2": (None, None), "below": (None, None)}


def test_paths_of_two_parts_name_their_namespace(spark):
    df = spark.createDataFrame([("a/b.md",), ("b.md",), ("a/b/c/d.md",), ("./a/b.md",)], "path string")
    got = [r[0] for r in df.select(T.infer_namespace(F.col("path"))).collect()]
    assert got == ["a/b.md/curated", "system/internal/curated", "a/b/curated", "a/b.md/curated"]


def test_texts_are_stripped_of_all_white_space(spark):
    df = spark.createDataFrame([(" \u00a0x y\u2003\n\x1c",), ("x y",)], "t string")
    assert df.select(T.body_hash(F.col("t"))).distinct().count() == 1
    assert df.limit(1).select(T.normalize_tags(F.array("t"))).first()[0] == ["x-y"]


def test_fuzzy_dedup_keeps_the_better_source(spark):
    from memlake.operators.ranking import fuzzy_dedup

    rows = [
        (1, "a", "episodic", "matured", 0.9, "text a", ["x", "y"], [1.0, 0.0]), (1, "b", "curated", "matured", 0.1, "text b", ["x"], [0.99, 0.05]),
        (1, "c", "episodic", "matured", 0.8, "text c", ["z"], [1.0, 0.0]), (1, "d", "episodic", "matured", 0.7, "text c", [], [0.0, 1.0]), (2, "a", "episodic", "matured", 0.9, "text a", [], [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "query_id long, object_id string, plane string, state string, score double, content string, tags array<string>, vector array<double>")
    assert sorted((r.query_id, r.object_id) for r in fuzzy_dedup(df).collect()) == [(1, "b"), (1, "c"), (2, "a")]


def test_planes_are_written_and_read_by_their_schema(spark, tmp_path):
    rows = planes.episodic(spark, "/root/testdata/sf0.001")
    planes.write_plane(rows, str(tmp_path / "plane"))
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    back = planes.read_plane(spark, str(tmp_path / "plane"), schema)
    assert back.select(rows.columns).exceptAll(rows).isEmpty() and back.count() == rows.count()
    plan = back.filter("identity_family = 'en'").select("object_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(identity_family" in plan


def test_the_synthetic_corpus_is_the_same_each_time(spark):
    rows = exchange.synthesize_corpus(spark, 500, seed=3)
    assert rows.exceptAll(exchange.synthesize_corpus(spark, 500, seed=3)).isEmpty() and rows.select("object_id").distinct().count() == 500
    assert rows.select("namespace").distinct().count() == 4 and rows.filter("not importance between 2 and 9").isEmpty()
    assert not rows.select("topics").exceptAll(exchange.synthesize_corpus(spark, 500, seed=4).select("topics")).isEmpty() or rows.select("topics").distinct().count() == 8


def test_pluggable_embedder_and_default_scorer(spark):
    from memlake.functions import models

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "a")], "id int, content string")
    got = {r.id: r.vector for r in models.embed(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [1.0, 1.0]}
    asked = spark.createDataFrame([("a b", "b A c", 1.0), ("a b", "x", -1.0), ("a b c d", "a", -0.5)], "q string, t string, want double")
    assert all(r.score == r.want for r in asked.withColumn("score", models.lexical_scorer(F.col("q"), F.col("t"))).collect())


def test_paths_that_meet_get_names_of_their_own(spark):
    def final(wanted, notes):
        w = spark.createDataFrame(wanted, "path string, object_id string")
        n = spark.createDataFrame(notes, "vault_path string, promoted_from string, managed boolean, object_id string")
        return {r.object_id: (r.final_path, r.reuse_id, r.conflict) for r in lifecycle.resolve_path_conflicts(w, n).collect()}

    assert final([("a.md", "x1"), ("a.md", "x2")], [("a-2.md", None, False, "h")]) == {"x1": ("a.md", None, None), "x2": ("a-3.md", None, None)}
    assert final([("a.md", "x1"), ("a-2.md", "x2"), ("a.md", "x3")], []) == {"x1": ("a.md", None, None), "x2": ("a-2.md", None, None), "x3": ("a-3.md", None, None)}
    held = [("a.md", "x1", True, "K1"), ("b.md", None, False, None), ("b-promoted-UPPERid8.md", None, True, "K3"), ("c.md", "x9", True, "K4"), ("c-v2.md", "x8", True, "K5")]
    assert final([("a.md", "x1"), ("b.md", "UPPERid89"), ("c.md", "x7"), ("d.md", "x6")], held) == {
        "x1": ("a.md", "K1", None), "UPPERid89": ("b-promoted-UPPERid8-2.md", None, "human"), "x7": ("c-v2-2.md", None, "managed"), "x6": ("d.md", None, None),
    }


def test_promotion_gives_rows_notes_messages_and_rejections(spark):
    rows = [(i, "t/s/concept", f"Title {i}", [], ["Linked One"], "matured", 4, 8, 0.0, 0.0, 1, [], None, 1) for i in ("c1", "c2", "c3")]
    concepts = spark.createDataFrame(rows, "object_id string, namespace string, title string, topics array<string>, linked_to_topics array<string>, state string, reinforcement_count int, importance int, created_epoch double, updated_epoch double, promotion_attempts int, contradicts array<string>, promoted_to string, version int")
    bodies = spark.createDataFrame([("c1", "## A\n" + "text " * 30 + "\n "), ("c2", "short"), ("c3", "## B\n" + "text " * 30)], "object_id string, body string")
    notes = spark.createDataFrame([("curated/t/s/linked-one/title-c3.md", "c3", True, "old-id"), ("curated/t/s/linked-one/title-c1.md", None, False, None)], "vault_path string, promoted_from string, managed boolean, object_id string")
    out = lifecycle.promote(concepts, bodies, 1e9, notes)
    curated = {r.promoted_from: r for r in out["curated"].collect()}
    assert curated["c3"].object_id == "old-id" and curated["c3"].vault_path == "curated/t/s/linked-one/title-c3.md"
    assert curated["c1"].vault_path == "curated/t/s/linked-one/title-c1-promoted-c1.md" and curated["c1"].namespace == "t/s/curated"
    assert curated["c1"].body_hash == hashlib.sha256(curated["c1"].content.strip().encode()).hexdigest()
    after = {r.object_id: r for r in out["concepts"].collect()}
    assert [(after[i].state, after[i].promoted_to, after[i].promotion_attempts, after[i].version, after[i].rejected_reason) for i in ("c1", "c2", "c3")] == [
        ("promoted", curated["c1"].object_id, 1, 2, None), ("matured", None, 2, 1, "bad_length"), ("promoted", "old-id", 1, 2, None),
    ]
    assert sorted((r.title, r.object_id) for r in out["thoughts"].collect()) == [("Concept promoted", "c1"), ("Concept promoted", "c3"), ("Path conflict", "c1")]
    assert {(r.path, r.object_id) for r in out["notes"].collect()} == {(r.vault_path, r.object_id) for r in curated.values()}
    assert [r.object_id for r in out["rejections"].collect()] == ["c2"] and {r.object_id for r in out["events"].collect()} == {"c1", "c3"}


def test_intents_of_one_object_apply_in_order(spark):
    rows = spark.createDataFrame([("a", "n", "provisional", 1, None, 0.0), ("b", "n", "matured", 1, "c", 0.0), ("c", "n", "matured", 1, None, 0.0)], "object_id string, namespace string, state string, version int, superseded_by string, updated_epoch double")
    steps = [("1", "a", "matured", None), ("2", "a", "demoted", 2), ("3", "a", "matured", 2), ("4", "a", "matured", None), ("5", "a", "archived", None), ("6", "a", "superseded", 4)]
    intents = [(i, o, to, v, "r", "x", "b" if i == "6" else None, float(i)) for i, o, to, v in steps] + [("7", "c", "superseded", None, "r", "x", "b", 1.0), ("8", "c", "demoted", 1, "r", "x", None, 2.0)]
    table = spark.createDataFrame(intents, "intent_id string, object_id string, to_state string, expected_version int, reason string, actor string, target string, requested_at double")
    log = {r.intent_id: (r.code, r.state, r.version) for r in lifecycle.transition_log(rows, table, "episodic").collect()}
    assert log == {
        "1": ("ok", "matured", 2), "2": ("ok", "demoted", 3), "3": ("version_fence_violation", "demoted", 3), "4": ("ok", "matured", 4), "5": ("illegal_transition", "matured", 4),
        "6": ("ok", "superseded", 5), "7": ("circular_supersession", "matured", 1), "8": ("ok", "demoted", 2),
    }
    updated, events, errors = lifecycle.apply_transitions(rows, table, "episodic", 9.0)
    assert {(r.object_id, r.state, r.version, r.superseded_by, r.updated_epoch) for r in updated.collect()} == {("a", "superseded", 5, "b", 9.0), ("b", "matured", 1, "c", 0.0), ("c", "demoted", 2, None, 9.0)}
    assert sorted((r.object_id, r.from_state, r.to_state) for r in events.collect()) == [("a", "demoted", "matured"), ("a", "matured", "demoted"), ("a", "matured", "superseded"), ("a", "provisional", "matured"), ("c", "matured", "demoted")]
    assert {r.intent_id for r in errors.collect()} == {"3", "5", "7"}


def test_windows_end_at_sentences():
    text = " ".join(" ".join(f"s{s}w{w}" for w in range(30)) + "." for s in range(20))
    ends = [len(text[:b].split()) for _, b in ch.token_windows(text, 100, 20, at_sentences=True)]
    assert ends == [90, 150, 210, 270, 330, 390, 450, 510, 570, 600]
    assert [len(text[a:b].split()) for a, b in ch.token_windows(text, 100, 20)][:3] == [100, 100, 100]
    quoted = 'one two three four (five.") six seven'
    assert [quoted[a:b] for a, b in ch.token_windows(quoted, 6, 1, at_sentences=True)] == ['one two three four (five.")', '(five.") six seven']
    assert list(ch.token_windows(" \n ")) == [(3, 3)] and list(ch.token_windows("")) == []
    for window, overlap in ((100, 100), (0, 0), (100, -1)):
        with pytest.raises(ValueError):
            list(ch.token_windows("x", window, overlap))


def test_markdown_sections_and_oversize_ones():
    big = " ".join(f"big{i}" for i in range(800))
    text = f"## Big Section\n\n{big}\n\n### Small Section\n\nshort section body\n"
    got = [(h, text[a:b]) for a, b, h in ch.chunk_markdown_text(text)]
    assert [h for h, _ in got] == ["Big Section", "Big Section", "Small Section"] and got[2][1] == "### Small Section\n\nshort section body"
    assert len(got[0][1].split()) == 512 and got[0][1].startswith("## Big Section") and got[1][1].endswith("big799")
    assert [(h, a, b) for a, b, h in ch.chunk_markdown_text("plain text with no headings at all")] == [("unknown", 0, 34)]
    assert list(ch.chunk_markdown_text("\n \n")) == [] and [h for _, _, h in ch.chunk_markdown_text("  \n## A\nx")] == ["A"]


def test_planes_prune_by_family_state_and_time(spark, tmp_path):
    rows = planes.episodic(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "plane")
    planes.write_plane(rows, path)
    back = planes.read_plane(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("title",)))
    assert back.count() == rows.count()
    some = back.filter("identity_family = 'en' and state = 'matured' and created_epoch >= 1706000000 and created_epoch < 1706600000")
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(identity_family" in plan and "PushedFilters: [IsNotNull(created_epoch)" in plan
    want = rows.filter("identity_family = 'en' and state = 'matured' and created_epoch >= 1706000000 and created_epoch < 1706600000")
    assert sorted(r.object_id for r in some.collect()) == sorted(r.object_id for r in want.collect())


def test_notes_without_a_text_are_the_same(spark):
    columns = "namespace string, vault_path string, object_id string, body_hash string, version int"
    old = spark.createDataFrame([("n", "a", "1", None, 3), ("n", "b", "2", None, 3), ("n", "c", "3", "h", 3)], columns)
    new = spark.createDataFrame([("n", "a", "1", None, 1), ("n", "b", "9", "x", 1), ("n", "c", "3", None, 1)], columns)
    got = {r.vault_path: (r.action, r.version) for r in merge.upsert_curated(new, old).collect()}
    assert got == {"a": ("noop", 3), "b": ("supersede", 1), "c": ("update", 4)}


def test_chunks_are_given_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(ch, "TEXTS", 3)
    made, make = [], ch._chunk_batch
    monkeypatch.setattr(ch, "_chunk_batch", lambda rows: made.append(len({r[0] for r in rows})) or make(rows))
    seen = []

    class Table:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(10)]), pa.array([f"a b {i}" for i in range(10)])], ["object_id", "content"])
            seen.extend(r for b in run([batch]) for r in b.to_pylist())

    ch.chunk_tokens(Table())
    assert max(made) == 3 and [r["content"] for r in seen] == [f"a b {i}" for i in range(10)]


def test_bests_of_few_queries_go_to_the_hits(spark):
    from memlake.queries.searching import hits
    from memlake.operators import ranking

    plan = ranking.score_hits(hits(spark, "/root/testdata/sf0.001"), 0.0, few_queries=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_texts_of_a_batch_are_held_a_few_at_a_time():
    """A batch of Arrow with many long texts is never a list of strings as a whole."""
    import tracemalloc

    import pyarrow as pa

    from memlake.functions import models

    texts = pa.array([f"{i} Some Words!" * 200 for i in range(3000)])  # 8 MB
    tracemalloc.start()
    normal = T.normalize_content.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 and len(normal) == 3000
    assert normal[7].as_py() == "7 some words!" * 199 + "7 some words"
    assert len(T.normalize_content.func(texts.slice(0, 0))) == 0
    held = [len(rows) for rows in models._held(texts, texts)]
    assert max(held) == models.HELD and sum(held) == 3000
