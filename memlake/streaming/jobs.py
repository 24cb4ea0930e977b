"""Structured Streaming jobs and their batch twins (S-1 to S-9).

Functions that take a DataFrame work on streams and tables alike unless they say otherwise.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from memlake.functions.text import normalize_content
from memlake.operators.joins import fan_out
from memlake.operators.lifecycle import candidate_pool
from memlake.operators.merge import merge_duplicates, merge_into
from memlake.schemas import OPERATOR_FACTOR, RATE_LIMITS
from memlake.sources.committed import CommittedTable

DAY_US = 86_400_000_000


def anchored_windows(events: DataFrame, keys: list[str], length_us: int) -> DataFrame:
    """Batch: ``events`` (keys, at_us, event_id, ...) with ``window_us``, the start of its window.

    A key's window starts at its first event and the next one at the first event after its end.
    Rows stream through in order with one number of state, so no key's rows are held; those of one
    key are in one task.
    """
    schema = StructType([*events.schema.fields, StructField("window_us", LongType())])
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for batch in batches:
            out = []
            for *key, at in zip(*(batch.column(names.index(k)).to_pylist() for k in (*keys, "at_us"))):
                if key != last or at >= start + length_us:
                    last, start = key, at
                out.append(start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "window_us"])

    ordered = events.repartition(*keys).sortWithinPartitions(*keys, "at_us", "event_id")
    return ordered.mapInArrow(run, schema)


def idempotent_capture(requests: DataFrame, keys: list[str], ttl_us: int = DAY_US) -> DataFrame:
    """S-1, batch twin: each request's outcome in its time to live: ``new``, a ``replay`` of the
    first one's body, or a ``conflict`` with it; and the first one's event_id."""
    w = Window.partitionBy(*keys, "window_us").orderBy("at_us", "event_id")
    first = anchored_windows(requests, keys, ttl_us).withColumns({"place": F.row_number().over(w), "first_id": F.first("event_id").over(w), "first_body": F.first("body").over(w)})
    outcome = F.when(F.col("place") == 1, "new").when(F.col("first_body").eqNullSafe(F.col("body")), "replay").otherwise("conflict")
    return first.select("event_id", "first_id", outcome.alias("outcome"))


def capture_outcomes_stream(stream: DataFrame, keys: list[str], ttl_us: int = DAY_US, late: str = "10 minutes") -> DataFrame:
    """S-1 on a stream (keys, ts, event_id, body): the rows of ``idempotent_capture``, in event time.

    A request is judged when the watermark has passed it, as none that came before it can still
    arrive; until then it waits in its key's state, beside the key's open window: its start and
    its first request's id and body (as a hash). So neither the order of arrival nor a restart
    changes an outcome. Requests that come after the watermark are dropped, as everywhere on a stream.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ids, bodies, start, first_id, first_body = state.get if state.exists else ([], [], [], None, None, None)
        waiting = list(zip(at, ids, bodies))
        for frame in frames:
            waiting += zip(frame.at_us.tolist(), frame.event_id.tolist(), frame.digest.tolist())
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort()
        ripe = bisect.bisect_right(waiting, passed, key=lambda x: x[0])
        for when, event_id, body in waiting[:ripe]:
            if start is None or when >= start + ttl_us:
                start, first_id, first_body = when, event_id, body
                out.append((event_id, event_id, "new"))
            else:
                out.append((event_id, first_id, "replay" if body == first_body else "conflict"))
        yield pd.DataFrame(out, columns=["event_id", "first_id", "outcome"])
        waiting = waiting[ripe:]
        over = start is None or start + ttl_us <= passed
        if over and not waiting:
            state.remove()
            return
        state.update((*([list(x) for x in zip(*waiting)] or [[], [], []]), start, first_id, first_body))
        state.setTimeoutTimestamp((waiting[0][0] if waiting else start + ttl_us) // 1000 + 1)

    digest = F.coalesce(F.sha2("body", 256), F.lit(""))
    timed = stream.withWatermark("ts", late).withColumns({"at_us": F.unix_micros("ts"), "digest": digest})
    return timed.groupBy(*keys).applyInPandasWithState(
        step, "event_id long, first_id long, outcome string", "at array<long>, ids array<long>, bodies array<string>, start long, first_id long, first_body string",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def drop_replays(stream: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """One row per key and body within the time to live, without outcomes."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([*keys, "body"])


def deliver_thoughts(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """S-2: live delivery, the same join as for tables."""
    return fan_out(stream, subscriptions)


def replay_since(thoughts: DataFrame, anchor_id: str, anchor_epoch: float, includes: list[str], cap: int = 500) -> DataFrame:
    """S-3: what came after the anchor for these receivers, in order, cut at ``cap``;
    ``truncated`` says whether there was more. A malformed anchor gives nothing."""
    if len(anchor_id) != 27 or not anchor_id.isalnum():
        return thoughts.limit(0).withColumns({"place": F.lit(0), "truncated": F.lit(False)})
    after = thoughts.filter((F.col("object_id") > anchor_id) & F.col("to_presence").isin(*includes) & (F.col("created_epoch") >= anchor_epoch))
    page = after.orderBy("object_id").limit(cap + 1)
    w = Window.partitionBy(F.lit(1)).orderBy("object_id")  # cap + 1 rows at most
    placed = page.withColumns({"place": F.row_number().over(w), "truncated": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > cap})
    return placed.filter(F.col("place") <= cap)


def capacity_of(bucket: Column, operator: Column) -> Column:
    base = F.coalesce(*(F.when(bucket == b, F.lit(n)) for b, n in RATE_LIMITS.items()), F.lit(RATE_LIMITS["default"]))
    return base * F.when(operator, F.lit(OPERATOR_FACTOR)).otherwise(F.lit(1))


def rate_limit(requests: DataFrame, window_us: int = 60_000_000) -> DataFrame:
    """S-4, batch twin: event_id, allowed, remaining and retry_after_us for requests (token,
    bucket, operator, at_us, event_id). Windows hold from a pair's first request on; denied
    requests don't count."""
    nth = F.row_number().over(Window.partitionBy("token", "bucket", "window_us").orderBy("at_us", "event_id"))
    out = anchored_windows(requests, ["token", "bucket"], window_us).withColumns({"nth": nth, "capacity": capacity_of(F.col("bucket"), F.col("operator"))})
    allowed = F.col("nth") <= F.col("capacity")
    return out.select("event_id", allowed.alias("allowed"), F.greatest(F.col("capacity") - F.col("nth"), F.lit(0)).alias("remaining"), F.when(~allowed, F.col("window_us") + window_us - F.col("at_us")).alias("retry_after_us"))


def rate_limit_stream(stream: DataFrame, window_us: int = 60_000_000, late: str = "1 minute") -> DataFrame:
    """S-4 on a stream (token, bucket, capacity, ts, event_id): event_id, allowed, remaining and
    retry_after_us, in event time alone, so that a replay or a pause changes nothing.

    The state of a pair is its windows that the watermark has not passed, with the requests
    allowed in each; a late request counts in the window that holds it. Requests that come
    after the watermark are dropped, as everywhere on a stream.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, used = (list(x) for x in state.get) if state.exists else ([], [])
        passed = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            rows = []
            for at, event_id, most in sorted(zip(frame.at_us.tolist(), frame.event_id.tolist(), frame.capacity.tolist())):
                k = bisect.bisect_right(starts, at) - 1
                if k < 0 or at >= starts[k] + window_us:
                    k += 1
                    starts.insert(k, at)
                    used.insert(k, 0)
                ok = used[k] < most
                used[k] += int(ok)
                rows.append((event_id, ok, max(most - used[k], 0), None if ok else starts[k] + window_us - at))
            out = pd.DataFrame(rows, columns=["event_id", "allowed", "remaining", "retry_after_us"])
            yield out.astype({"retry_after_us": "Int64"})
        open_ = [i for i, start in enumerate(starts) if start + window_us > passed]
        if open_:
            state.update(([starts[i] for i in open_], [used[i] for i in open_]))
            state.setTimeoutTimestamp((starts[open_[-1]] + window_us) // 1000 + 1)
        else:
            state.remove()

    timed = stream.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    return timed.groupBy("token", "bucket").applyInPandasWithState(
        step, "event_id long, allowed boolean, remaining long, retry_after_us long", "starts array<long>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def tumbling_usage(requests: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """S-5: requests by token, bucket and calendar minute."""
    source = requests.withWatermark(ts, late) if requests.isStreaming else requests
    counted = source.groupBy(F.window(ts, "60 seconds"), "token", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("minute"), "token", "bucket", "n")


def debounce_changes(changes: DataFrame, ts: str = "ts", quiet: str = "2 seconds") -> DataFrame:
    """S-6: the last change of each path before a pause."""
    source = changes.withWatermark(ts, quiet) if changes.isStreaming else changes
    last = source.groupBy(F.session_window(ts, quiet), "path").agg(F.max_by("event_id", F.struct(ts, "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))
    return last.select("path", "event_id", "n")


def after_cursor(rows: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-7: (rows above their family's high-water mark, the new marks)."""
    new = rows.join(cursors, "family", "left").filter(F.col("cursor").isNull() | (F.col("updated_epoch") > F.col("cursor"))).drop("cursor")
    marks = new.groupBy("family").agg(F.max("updated_epoch").alias("seen")).join(cursors, "family", "full_outer")
    return new, marks.select("family", F.greatest("seen", "cursor").alias("cursor"))


def split_late(rows: DataFrame, watermark_epoch: float) -> tuple[DataFrame, DataFrame]:
    """S-9: (rows in time, rows for the side table)."""
    late = F.col("event_epoch") < watermark_epoch
    return rows.filter(~late), rows.filter(late)


def late_rows_stream(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, DataFrame, int], None], ts: str = "ts", late_s: int = 600) -> StreamingQuery:
    """S-9 on a stream: each batch's rows in time and its late ones, those ``late_s`` seconds or
    more before the newest row of the batches before; ``write`` takes both with the batch number.

    The newest time is a committed table of one row and the batch before's, so that a batch that
    runs again gets the mark it had, and neither reading nor keeping it grows with the batches.
    """
    spark = stream.sparkSession
    marks = CommittedTable(spark, f"{checkpoint}/marks", "batch long, newest double", ["batch"], 1)

    def batch(df: DataFrame, number: int) -> None:
        before = {r.batch: r.newest for r in marks.read().collect() if r.batch < number}  # two rows at most
        newest = max((x for x in before.values() if x is not None), default=None)
        rows = df.withColumn("event_epoch", F.col(ts).cast("double"))
        good, late = split_late(rows, float("-inf") if newest is None else newest - late_s)
        write(good.drop("event_epoch"), late.drop("event_epoch"), number)
        seen = rows.agg(F.max("event_epoch")).first()[0]
        top = max((x for x in (newest, seen) if x is not None), default=None)
        keep = [(max(before), newest)] if before else []
        marks.commit(spark.createDataFrame([*keep, (number, top)], marks.schema), [0], "marks", number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


PLANE = "object_id string, created_epoch double, content string, tags array<string>, reinforcement_count long, version long, updated_epoch double, normal string"


def captured_plane(spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> CommittedTable:
    """A plane that captures are merged into: one row for each of ``keys`` and normal content."""
    return CommittedTable(spark, path, ", ".join([*(f"{k} string" for k in keys), PLANE]), [*keys, "normal"], buckets)


def capture_batch(plane: CommittedTable, df: DataFrame, number: int, stream: str, valid: Callable[[DataFrame], DataFrame], keys: list[str], now: float) -> bool:
    """S-8, one batch: valid captures, merged (A-1) with one another and with the rows of the plane that
    say the same after normalising (T-3), committed with the batch's number. Only the
    buckets that the batch touches are read and written. False if the batch was there already."""
    if plane.done(stream, number):
        return False
    good = valid(df).filter("reason is null").drop("reason").withColumn("normal", normalize_content("content"))
    new = merge_duplicates(good, [*keys, "normal"], now)
    touched = plane.touched(new)
    return plane.commit(merge_into(plane.read(touched), new, [*keys, "normal"], now), touched, stream, number)


def capture_stream(
    stream: DataFrame, checkpoint: str, plane: CommittedTable, valid: Callable[[DataFrame], DataFrame], keys: list[str], now: float,
    replay_keys: list[str] | None = None, ts: str = "ts", ttl: str = "24 hours", name: str = "captures",
) -> StreamingQuery:
    """S-8: captures into a plane: replays of a request go where ``replay_keys`` name it, and each
    batch is ``capture_batch``. A batch that runs again, or that died half-way, changes nothing
    twice. ``name`` tells the plane's streams apart. Runs through what is there and ends."""
    if replay_keys:
        stream = drop_replays(stream, replay_keys, ts, ttl)

    def batch(df: DataFrame, number: int) -> None:
        capture_batch(plane, df.persist(), number, name, valid, keys, now)
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


POOL = "family string, object_id string, first_seen double, attempts int, cursor double"


def pool_batch(state: CommittedTable, df: DataFrame, number: int, stream: str, cluster: Callable[[DataFrame], DataFrame], now: float, payload: list[str]) -> bool:
    """S-7 and L-20, one batch: rows above their family's cursor and those that wait go to ``cluster``,
    which returns the (family, object_id) that it has taken; the others wait on.

    ``state`` holds both: a family's cursor is a row without object_id, a waiting row carries its
    ``payload`` columns, so the batch needs no other table. One commit changes both.
    """
    if state.done(stream, number):
        return False
    touched = state.touched(df.select("family"))
    held = state.read(touched)
    new, marks = after_cursor(df.select("family", "object_id", "updated_epoch", *payload), held.filter("object_id is null").select("family", "cursor"))
    waiting = held.filter("object_id is not null")
    chosen = new.unionByName(waiting.select("family", "object_id", F.lit(None).cast("double").alias("updated_epoch"), *payload)).dropDuplicates(["family", "object_id"])
    taken = cluster(chosen).select("family", "object_id").distinct()
    pool = candidate_pool(waiting.select("family", "object_id", "first_seen", "attempts"), chosen.select("family", "object_id"), taken, now)
    rows = pool.withColumn("cursor", F.lit(None).cast("double")).join(chosen.select("family", "object_id", *payload), ["family", "object_id"])
    nothing = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in payload]
    lines = marks.select("family", F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("double").alias("first_seen"), F.lit(None).cast("int").alias("attempts"), "cursor", *nothing)
    return state.commit(rows.select(lines.columns).unionByName(lines), touched, stream, number)


def pool_state(spark: SparkSession, path: str, payload: str, buckets: int = 64) -> CommittedTable:
    """The state of ``pool_stream``; ``payload`` is the DDL of the columns that waiting rows carry."""
    return CommittedTable(spark, path, f"{POOL}, {payload}", ["family"], buckets)


def pool_stream(stream: DataFrame, checkpoint: str, state: CommittedTable, cluster: Callable[[DataFrame], DataFrame], now: float, payload: list[str], name: str = "pool") -> StreamingQuery:
    """S-7 and L-20 on a stream: ``pool_batch`` for each batch, through what is there."""

    def batch(df: DataFrame, number: int) -> None:
        pool_batch(state, df, number, name, cluster, now, payload)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
