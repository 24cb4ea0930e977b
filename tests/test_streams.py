"""Streams with state of their own: equal to one batch, whatever the files, restarts and kills."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import filters, merge
from memlake.sources.committed import CommittedTable
from memlake.streaming import jobs

AT = datetime.datetime(2024, 1, 1)
CAPTURE = (
    "event_id long, ts timestamp, request string, body string, object_id string, namespace string, content string, tags array<string>, created_epoch double, "
    "reinforcement_count int, importance int, event_at double"
)


def capture(i: int, content: str, namespace: str = "a/b/episodic", tags: tuple = (), request: str | None = None) -> tuple:
    return (i, AT, request or f"r{i}", content, f"o{i}", namespace, content, list(tags), float(i), 0, 5, float(i))


def valid(df):
    return filters.validate_captures(df, 1e6)


def rows_of(plane: CommittedTable) -> list[tuple]:
    return sorted((r.object_id, r.content, tuple(r.tags), r.version, r.reinforcement_count, r.created_epoch, r.updated_epoch) for r in plane.read().collect())


def test_captures_merge_with_the_plane(spark, tmp_path):
    plane = jobs.captured_plane(spark, str(tmp_path / "plane"), ["namespace"], 8)
    batches = [
        [capture(1, "Hello  world", tags=["x"]), capture(2, "hello WORLD.", tags=["y"]), capture(3, "z", "bad"), capture(4, ""), capture(1, "Hello  world", tags=["x"], request="r1")],
        [capture(5, "HELLO   WORLD!!", tags=["z"]), capture(6, "Other"), capture(0, "hello world")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CAPTURE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CAPTURE).parquet(str(tmp_path / "in"))
        jobs.capture_stream(stream, str(tmp_path / "cp"), plane, valid, ["namespace"], 9.0 + k, ["request"]).awaitTermination(180)
    # the row that is there keeps its id and creation, even beside an earlier one; the longest content wins, the first of equals
    assert rows_of(plane) == [("o1", "HELLO   WORLD!!", ("x", "y", "z"), 4, 3, 1.0, 10.0), ("o6", "Other", (), 1, 0, 6.0, 6.0)]


def test_a_batch_that_runs_twice_or_dies_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    plane = jobs.captured_plane(spark, str(tmp_path / "plane"), ["namespace"], 4)

    def batch(rows, number, stream="s"):
        return jobs.capture_batch(plane, spark.createDataFrame(rows, CAPTURE), number, stream, valid, ["namespace"], 50.0)

    assert batch([capture(i, f"text {i % 7}") for i in range(20)], 0)
    first = rows_of(plane)
    assert not batch([capture(i, f"text {i % 7}") for i in range(20)], 0) and rows_of(plane) == first

    def dies(self, head):
        raise RuntimeError("killed before the manifest")

    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "_publish", dies)
        with pytest.raises(RuntimeError):
            batch([capture(100, "text 1"), capture(101, "new")], 1)
    assert rows_of(plane) == first, "files without a manifest are nothing"
    assert batch([capture(100, "text 1"), capture(101, "new")], 1)
    after = {r[0]: r for r in rows_of(plane)}
    assert after["o1"][3:5] == (4, 3) and after["o101"][1] == "new" and len(after) == 8
    assert batch([capture(102, "new")], 0, "another stream") and {r[0]: r for r in rows_of(plane)}["o101"][3] == 2


def test_many_commits_leave_few_files(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"], 4)
    want = {}
    for n in range(12):
        row = (f"k{n % 5}", n)
        rows = spark.createDataFrame([row], "k string, v long")
        touched = table.touched(rows)
        assert table.commit(table.read(touched).filter(F.col("k") != row[0]).unionByName(rows), touched, "s", n)
        want[row[0]] = n
    assert {r.k: r.v for r in table.read().collect()} == want
    assert len(list((tmp_path / "t/commits").glob("v*.json"))) == 2
    assert len(list((tmp_path / "t/data").glob("v*"))) <= 2 * 4


def test_captures_of_a_stream_equal_one_merge(spark, tmp_path):
    rng = random.Random(4)
    rows = [capture(i, f"Text {rng.randrange(9)}" + "." * rng.randrange(3), f"a/n{rng.randrange(2)}/episodic", [f"t{rng.randrange(4)}"]) for i in range(90)]
    plane = jobs.captured_plane(spark, str(tmp_path / "plane"), ["namespace"], 4)
    for k in range(3):
        assert jobs.capture_batch(plane, spark.createDataFrame(rows[30 * k : 30 * k + 30], CAPTURE), k, "s", valid, ["namespace"], 99.0)
    whole = spark.createDataFrame(rows, CAPTURE).withColumn("normal", jobs.normalize_content("content"))
    want = {(r.namespace, r.normal): (r.object_id, tuple(r.tags), r.version, r.reinforcement_count, len(r.content)) for r in merge.merge_duplicates(whole, ["namespace", "normal"], 99.0).collect()}
    assert {(r.namespace, r.normal): (r.object_id, tuple(r.tags), r.version, r.reinforcement_count, len(r.content)) for r in plane.read().collect()} == want


def test_outcomes_on_a_stream_equal_the_batch(spark, tmp_path):
    """Files out of order within the watermark, and a restart between any two of them."""
    rng = random.Random(9)
    base = 1_700_000_000
    events = [(f"k{rng.randrange(3)}", base + rng.randrange(4000), i, f"b{rng.randrange(3)}" if rng.random() < 0.9 else None) for i in range(200)]
    schema = "token string, s long, event_id long, body string"
    order = sorted(events, key=lambda e: e[1] + rng.randrange(250))  # up to 250 s out of order
    closing = [("end", base + 10**6, 999, "x"), ("end", base + 2 * 10**6, 1000, "x")]
    for part in (order[:70], order[70:71], order[71:150], order[150:], closing[:1], closing[1:]):
        table = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        out = jobs.capture_outcomes_stream(stream, ["token"], 500_000_000, "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r.event_id: (r.first_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.event_id < 999}
    batch = jobs.idempotent_capture(spark.createDataFrame(events, schema).withColumn("at_us", F.col("s") * 1_000_000), ["token"], 500_000_000)
    assert got == {r.event_id: (r.first_id, r.outcome) for r in batch.collect()}
    assert {x[1] for x in got.values()} == {"new", "replay", "conflict"}


def test_the_pool_on_a_stream_equals_one_run(spark, tmp_path):
    """Rows wait until three of a topic have come, in whichever batch."""

    def cluster(rows):
        ripe = rows.groupBy("family", "topic").count().filter("count >= 3")
        return rows.join(ripe, ["family", "topic"], "left_semi")

    def state(name):
        return jobs.pool_state(spark, str(tmp_path / name), "topic string", 4)

    schema = "family string, object_id string, updated_epoch double, topic string"
    rows = [(f"f{i % 2}", f"o{i}", float(i), f"t{i % 9 % 5}") for i in range(30)]
    whole = state("whole")
    jobs.pool_batch(whole, spark.createDataFrame(rows, schema), 0, "s", cluster, 100.0, ["topic"])
    parts = state("parts")
    for lot in (rows[:4], rows[4:5], rows[5:20], rows[20:]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.pool_stream(stream, str(tmp_path / "cp"), parts, cluster, 100.0, ["topic"]).awaitTermination(180)

    def cursors(table):
        return sorted((r.family, r.cursor) for r in table.read().filter("object_id is null").collect())

    taken_early = {(r.family, r.topic) for r in parts.read().filter("object_id is not null").collect()}
    assert cursors(parts) == cursors(whole) == [("f0", 28.0), ("f1", 29.0)]
    waiting = {(r.family, r.object_id) for r in whole.read().filter("object_id is not null").collect()}
    left = {(r.family, r.object_id): r for r in parts.read().filter("object_id is not null").collect()}
    assert waiting <= left.keys() and all(sum((f, t) == key for f, _, _, t in rows) >= 1 for key in taken_early for f, t in [key])
    assert all(1 <= r.attempts <= 4 and r.first_seen == 100.0 for r in left.values())
    assert not jobs.pool_batch(parts, spark.createDataFrame(rows, schema), 3, "pool", cluster, 100.0, ["topic"]), "a batch that runs again"


def test_marks_of_late_rows_do_not_grow(spark, tmp_path):
    seen = {"good": [], "late": []}

    def write(rows, late, number):
        seen["good"] += [r.s for r in rows.collect()]
        seen["late"] += [r.s for r in late.collect()]

    want, newest = {"good": [], "late": []}, None
    rng = random.Random(2)
    for n in range(25):
        lot = [1000 * n + rng.randrange(-3000, 1000) for _ in range(4)]
        for s in lot:
            want["late" if newest is not None and s < newest - 600 else "good"].append(s)
        newest = max([*lot, *([newest] if newest is not None else [])])
        table = spark.createDataFrame([(s,) for s in lot], "s long").select(F.timestamp_seconds(F.col("s") + 10**6).alias("ts"), "s")
        table.coalesce(1).write.parquet(str(tmp_path / f"in/lot={n:03d}"))
    stream = spark.readStream.schema("ts timestamp, s long").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    jobs.late_rows_stream(stream, str(tmp_path / "cp"), write).awaitTermination(300)
    assert sorted(seen["good"]) == sorted(want["good"]) and sorted(seen["late"]) == sorted(want["late"])
    assert len(list((tmp_path / "cp/marks/commits").glob("v*.json"))) <= 2 and len(list((tmp_path / "cp/marks/data").glob("v*"))) <= 2
