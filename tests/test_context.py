"""Context packs: the rule, item by item, in plain Python, and rows worked out by hand."""

from __future__ import annotations

import random

import regex

from memlake.operators import context
from memlake.schemas import GROUP_ORDER, KIND_GROUP

COLUMNS = (
    "query_id long, object_id string, namespace string, plane string, state string, content string, summary string, title string, tags array<string>, extra map<string,string>, "
    "created_epoch double, updated_epoch double, importance int, retrieve_score double, lane string"
)


def cut(text: str, n: int) -> str:
    if len(text) <= n:
        return text
    room, out = (n - 3 if n > 3 else n), ""
    for cluster in regex.findall(r"\X", text):
        if len(out) + len(cluster) > room:
            break
        out += cluster
    return out + ("..." if n > 3 else "")


def by_hand(rows: list[dict], max_items: int, max_chars: int, reserve: int) -> tuple[list[tuple], int]:
    """(object_id, lane, content, content_truncated) of one query's visible rows, and what was skipped."""
    rows = sorted(rows, key=lambda r: r["place"])
    recent = sorted((r for r in rows if r["lane"] == "recent"), key=lambda r: -r["created_epoch"])
    ranked = [r for r in rows if r["lane"] == "ranked"]
    out, used, skipped = [], 0, 0
    third = max_chars // 3 if recent and ranked and max_items >= 2 else max_chars

    def take(r: dict, room: int) -> bool:
        nonlocal used
        whole = " ".join((r["summary"] or r["content"]).split())
        content = cut(whole, room - used) if room > used else ""
        if not content:
            return False
        out.append((r["object_id"], r["lane"], content, len(whole) > room - used))
        used += len(content)
        return used < max_chars

    for r in recent:
        if len(out) >= min(reserve if ranked else max_items, max_items) or not take(r, third):
            break
    for r in ranked:
        if len(out) >= max_items:
            break
        if r["asked"] and not r["overlap"] and r["staleness"] not in ("durable", "current") and r["kind"] == "episode":
            skipped += 1
            continue
        if not take(r, max_chars):
            break
    return out, skipped


def ranked_rows(spark, rows: list[tuple], text: str):
    candidates = context.with_kind(spark.createDataFrame(rows, COLUMNS))
    queries = spark.createDataFrame([(q, text) for q in {r[0] for r in rows}], "query_id long, query_text string")
    return candidates, context.essence_rank(candidates.filter(context.hidden_reason().isNull()), queries).cache()


def check(spark, rows: list[tuple], text: str, *limits: int) -> dict[int, list[tuple]]:
    candidates, ranked = ranked_rows(spark, rows, text)
    by_query: dict[int, list[dict]] = {}
    for r in ranked.collect():
        by_query.setdefault(r.query_id, []).append(r.asDict() | {"asked": bool(r.query_tokens)})
    got: dict[int, list[tuple]] = {}
    for r in sorted(context.pack(ranked, *limits).collect(), key=lambda r: (r.query_id, r["item"])):
        got.setdefault(r.query_id, []).append((r.object_id, r.lane, r.content, r.content_truncated))
    want = {q: by_hand(some, *limits) for q, some in by_query.items()}
    assert got == {q: items for q, (items, _) in want.items() if items}
    low = {r.query_id: r.n for r in context.suppressed(candidates, ranked, *limits).collect() if r.reason == "low_relevance"}
    assert low == {q: skipped for q, (_, skipped) in want.items() if skipped}
    return got


def row(i: int, lane: str, content: str | None, q: int = 1, state: str = "matured", tags: tuple = (), summary: str | None = None, extra: dict | None = None) -> tuple:
    return (q, f"o{i:03d}", "a/b/episodic", "episodic", state, content, summary, None, list(tags), extra, float(1000 + i), float(1000 + i), 5, 0.5, lane)


def test_lanes_are_judged_before_filler_goes(spark):
    """An off-topic ranked row halves nothing away, but the recent lane has a third of the room."""
    rows = [row(i, "recent", "word " * 41 + "tail") for i in range(5)] + [row(9, "ranked", "unrelated text")]
    got = check(spark, rows, "something else", 8, 600, 2)
    assert [(o, lane, len(c), cut_) for o, lane, c, cut_ in got[1]] == [("o004", "recent", 200, True)] and got[1][0][2].endswith("...")


def test_packs_of_random_rows(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "é́x", "👨‍👩‍👧", "gamma \n delta", "𝒳", "z" * 30, ""]
    rows = []
    for q in range(40):
        for i in range(rng.randrange(1, 16)):
            tags = rng.sample(["kind:boundary", "kind: open-loop ", "kind:nonsense", "staleness:durable", "freshness:current", "staleness:", "kind:correction/suppression"], 2)
            text = " ".join(rng.choices(words, k=rng.randrange(1, 12)))
            rows.append(row(i, rng.choice(["recent", "ranked", "ranked"]), text, q, rng.choice(["matured", "matured", "superseded"]), tags, rng.choice([None, "", "short one"])))
    for limits in ((8, 200, 2), (3, 120, 0), (1, 150, 1), (5, 10_000, 5), (8, 130, 8)):
        check(spark, rows, "alpha delta", *limits)
    check(spark, rows, "", 4, 200, 2)


def test_kinds_from_extra_and_tags(spark):
    rows = [
        row(1, "ranked", "x", tags=("kind:boundary",), extra={"kind": " open-loop "}), row(2, "ranked", "x", tags=("kind:boundary",), extra={"kind": "odd"}),
        row(3, "ranked", "x", tags=("kind:boundary", "freshness: current"), extra={"other": "y"}), row(4, "ranked", "x", state="superseded", tags=("staleness:durable",)),
    ]
    got = {r.object_id: (r.kind, r.staleness, r.reason) for r in context.with_kind(spark.createDataFrame(rows, COLUMNS)).withColumn("reason", context.hidden_reason()).collect()}
    assert got == {"o001": ("open-loop", "episodic", None), "o002": ("episode", "episodic", None), "o003": ("boundary", "current", None), "o004": ("episode", "durable", "superseded")}


def test_rendered_packs(spark):
    rows = [row(i, "ranked", f"text {i}", tags=(f"kind:{kind}",)) for i, kind in enumerate(["episode", "open-loop", "boundary", "operating-rule", "episode"])]
    packed = context.pack(ranked_rows(spark, rows, "text")[1], 8, 1200)
    got = packed.collect()
    lines = []
    for group in GROUP_ORDER:
        own = [r for r in sorted(got, key=lambda r: r["item"]) if KIND_GROUP[r.kind] == group]
        lines += [f"{group}:"] * bool(own) + [f"- [{r.kind}; {r.namespace}/{r.object_id}] {r.content}" for r in own]
    assert [r.text for r in context.render_pack(packed).collect()] == ["\n".join(lines)]
    assert lines[0] == "Must-Obey:" and lines[1] == "- [boundary; a/b/episodic/o002] text 2" and lines[-2].startswith("- [episode;")


def test_registered_packs_follow_the_rule(spark):
    from memlake.queries import QUERIES
    from memlake.queries.auditing import shown

    sf = "/root/testdata/sf0.01"
    by_query: dict[int, list[dict]] = {}
    for r in shown(spark, sf).collect():
        by_query.setdefault(r.query_id, []).append(r.asDict() | {"asked": bool(r.query_tokens)})
    want = {q: by_hand(rows, 8, 1200, 2) for q, rows in by_query.items()}
    got: dict[int, list[tuple]] = {}
    for r in sorted(QUERIES["c05_pack"](spark, sf).collect(), key=lambda r: (r.query_id, r["item"])):
        got.setdefault(r.query_id, []).append((r.object_id, r.lane, r.content, r.content_truncated))
    assert got == {q: items for q, (items, _) in want.items()}
    low = {r.query_id: r.n for r in QUERIES["c03_suppressed"](spark, sf).collect() if r.reason == "low_relevance"}
    assert low == {q: n for q, (_, n) in want.items() if n}
    assert {r.query_id: r.text.count("\n- [") for r in QUERIES["c06_render_pack"](spark, sf).collect()} == {q: len(items) for q, items in got.items()}


def test_a_query_without_tokens_is_ranked_as_its_sql_says(spark, tmp_path):
    import duckdb

    from memlake.queries import QUERIES, SQL

    docs = [(i, "Ö Ö Ö Ö Ö" if i == 0 else f"word{i % 7} of text", "en", "src0", 10) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted((q, i, round(e, 5), p) for q, i, e, p in con.execute(SQL["c04_essence_rank"]).fetchall())
    got = sorted((r.query_id, r.object_id, round(r.essence, 5), r.place) for r in QUERIES["c04_essence_rank"](spark, str(tmp_path)).collect())
    assert got == want


def test_candidates_are_dealt_once(spark):
    """Both lanes, the newest and the ids go by one shuffle of the texts."""
    from pyspark.sql import functions as F

    from memlake.operators.context import context_candidates

    n = F.col("id")
    rows = spark.range(60).select((n % 3).alias("query_id"), F.lit("a").alias("namespace"), F.lit("episodic").alias("plane"), (n % 40).cast("string").alias("object_id"), n.cast("double").alias("created_epoch"), F.lit(0.5).alias("retrieve_score"))
    out = context_candidates(rows.filter("query_id < 2"), rows.filter(n % 2 == 0), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = out.groupBy("query_id", "lane").count().collect()
    assert {(r.query_id, r.lane) for r in got} == {(0, "ranked"), (1, "ranked"), (2, "ranked"), (0, "recent"), (1, "recent")}
    assert all(r["count"] <= 5 for r in got if r.lane == "recent")
