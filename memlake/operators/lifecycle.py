"""Lifecycle: audited transitions and the sweeps' selections (L-1 to L-18, L-20, D-1 to D-5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import body_hash
from memlake.operators.joins import supersession_cycle
from memlake.operators.merge import record_rejections
from memlake.schemas import TRANSITIONS
from memlake.sources.scratch import ensure_checkpoint_dir

DAY = 86400.0


def transition_table(spark: SparkSession) -> DataFrame:
    """L-2: legal (object_type, from_state, to_state) rows."""
    rows = [(kind, old, new) for kind, table in TRANSITIONS.items() for old, states in table.items() for new in states]
    return spark.createDataFrame(rows, "object_type string, from_state string, to_state string")


def _judged_in_order(intents: DataFrame, legal: dict[str, tuple[str, ...]]) -> DataFrame:
    """``intents`` with ``code`` (null: applied), ``from_state`` and ``at_version``, each judged by
    what the object's earlier ones have made of it. An object's intents stream in order through
    one (state, version); they are never held together."""
    columns = ["object_id", "intent_id", "to_state", "expected_version", "reason", "actor", "target", "requested_at", "namespace", "row_state", "row_version", "cyclic"]
    schema = intents.select(columns).schema.simpleString()[7:-1] + ",code:string,from_state:string,at_version:int"
    at = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, version = None, None, 0
        for batch in batches:
            code, before, reached = [], [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                object_id, to, fence = row[at["object_id"]], row[at["to_state"]], row[at["expected_version"]]
                if object_id != last or last is None:
                    last, state, version = object_id, row[at["row_state"]], row[at["row_version"]]
                if not row[at["reason"]]:
                    found = "missing_reason"
                elif row[at["row_version"]] is None:
                    found = "not_found"
                elif fence is not None and fence != version:
                    found = "version_fence_violation"
                elif to not in legal.get(state, ()):
                    found = "illegal_transition"
                else:
                    found = "circular_supersession" if row[at["cyclic"]] else None
                code.append(found)
                before.append(state)
                reached.append(version)
                if found is None:
                    state, version = to, version + 1
            more = [pa.array(code, pa.string()), pa.array(before, pa.string()), pa.array(reached, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*columns, "code", "from_state", "at_version"])

    ordered = intents.select(columns).repartition("object_id").sortWithinPartitions("object_id", "requested_at", "intent_id")
    return ordered.mapInArrow(run, schema)


def judge(rows: DataFrame, intents: DataFrame, object_type: str, with_targets: bool = True) -> DataFrame:
    """Each intent with its ``code``, or null, and the state and version that it met."""
    have = rows.select("object_id", "namespace", F.col("state").alias("row_state"), F.col("version").cast("int").alias("row_version"))
    met = intents.join(have, "object_id", "left")
    if with_targets:
        cycles = supersession_cycle(rows, intents.filter("target is not null").select("object_id", "target").distinct())
        met = met.join(cycles, ["object_id", "target"], "left")
    else:
        met = met.withColumn("cyclic", F.lit(False))
    return _judged_in_order(met, TRANSITIONS[object_type])


def transition_log(rows: DataFrame, intents: DataFrame, object_type: str) -> DataFrame:
    """L-1: every intent with its code (``ok``: applied) and the state and version after it."""
    hit = F.col("code").isNull()
    return judge(rows, intents, object_type).select(
        "intent_id", "object_id", F.coalesce("code", F.lit("ok")).alias("code"), F.when(hit, F.col("to_state")).otherwise(F.col("from_state")).alias("state"),
        (F.col("at_version") + hit.cast("int")).alias("version"),
    )


def apply_transitions(rows: DataFrame, intents: DataFrame, object_type: str, now: float, with_targets: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L-1: (updated rows, events, errors).

    ``intents`` has intent_id, object_id, to_state, expected_version (or null), reason, actor,
    target (a new superseder, or null) and requested_at. Several intents for one object apply one
    after another by (requested_at, intent_id): each is judged by the state and version that the
    earlier ones have reached. The first error that applies is the intent's code. Chains of
    supersession are those of ``rows``; without targets none is followed.
    """
    judged = judge(rows, intents, object_type, with_targets)
    good = judged.filter("code is null")
    turn = F.struct("requested_at", "intent_id")
    change = good.groupBy("object_id").agg(
        F.max_by("to_state", turn).alias("new_state"), F.count(F.lit(1)).cast("int").alias("steps"),
        F.max_by("target", F.when(F.col("target").isNotNull(), turn)).alias("new_target"),
    )
    hit = F.col("new_state").isNotNull()
    updated = rows.join(change, "object_id", "left").withColumns({
        "state": F.coalesce("new_state", "state"), "version": F.col("version") + F.coalesce("steps", F.lit(0)), "updated_epoch": F.when(hit, F.lit(now)).otherwise(F.col("updated_epoch")),
        "superseded_by": F.coalesce("new_target", "superseded_by"),
    }).drop("new_state", "new_target", "steps")
    event_id = F.sha2(F.concat_ws(":", "object_id", "intent_id", F.lit(str(now))), 256)
    events = good.select(event_id.alias("event_id"), "object_id", F.lit(object_type).alias("object_type"), "namespace", "from_state", "to_state", "actor", "reason", F.lit(now).alias("occurred_epoch"), "intent_id")
    return updated, events, judged.filter("code is not null").select("intent_id", "object_id", "code")


def intents_for(selected: DataFrame, to_state: str, actor: str, reason: str) -> DataFrame:
    """One intent per selected row."""
    nothing = F.lit(None).cast("string")
    return selected.select(F.col("object_id").alias("intent_id"), "object_id", F.lit(to_state).alias("to_state"), F.col("version").alias("expected_version"), F.lit(reason).alias("reason"), F.lit(actor).alias("actor"), nothing.alias("target"), F.lit(0.0).alias("requested_at"))


def sweep(rows: DataFrame, selected: Column, to_state: str, reason: str, object_type: str, now: float) -> tuple[DataFrame, DataFrame]:
    """Select, validate and derive: (updated rows, events). A row has all that its own change
    needs, so this is one projection and one filter, without a join."""
    legal = [old for old, states in TRANSITIONS[object_type].items() if to_state in states]
    hit = F.coalesce(selected & F.col("state").isin(legal), F.lit(False))
    updated = rows.withColumns({
        "state": F.when(hit, F.lit(to_state)).otherwise(F.col("state")), "version": F.col("version") + hit.cast("int"),
        "updated_epoch": F.when(hit, F.lit(now)).otherwise(F.col("updated_epoch")),
    })
    event_id = F.sha2(F.concat_ws(":", "object_id", "object_id", F.lit(str(now))), 256)
    events = rows.filter(hit).select(
        event_id.alias("event_id"), "object_id", F.lit(object_type).alias("object_type"), "namespace", F.col("state").alias("from_state"), F.lit(to_state).alias("to_state"),
        F.lit("lifecycle").alias("actor"), F.lit(reason).alias("reason"), F.lit(now).alias("occurred_epoch"),
    )
    return updated, events


# Selections of the sweeps, as conditions on the planes' columns.


def to_mature(now: float) -> Column:
    """L-3"""
    return (F.col("state") == "provisional") & (F.col("created_epoch") < now - 3600)


def stale_provisional(now: float) -> Column:
    """L-4"""
    return (F.col("state") == "provisional") & (F.col("created_epoch") < now - 7 * DAY)


def unused(now: float) -> Column:
    """L-5"""
    return (F.col("state") == "matured") & (F.col("access_count") == 0) & (F.col("reinforcement_count") == 0) & (F.col("importance") < 4) & (F.col("updated_epoch") < now - 60 * DAY)


def inactive(now: float) -> Column:
    """L-6"""
    return (F.col("state") == "matured") & (F.col("updated_epoch") < now - 30 * DAY)


def concept_ripe(now: float) -> Column:
    """L-7"""
    return (F.col("state") == "synthesized") & (F.col("created_epoch") < now - DAY) & (F.col("reinforcement_count") >= 3) & (F.size("contradicts") == 0)


def concept_idle(now: float) -> Column:
    """L-8"""
    return (F.col("state") == "matured") & (F.coalesce("last_reinforced_epoch", "created_epoch") < now - 30 * DAY)


def promotion_eligible(now: float) -> Column:
    """L-11"""
    return (
        (F.col("state") == "matured") & (F.col("reinforcement_count") >= 3) & (F.col("importance") >= 6) & (F.col("created_epoch") <= now - 2 * DAY)
        & (F.col("promotion_attempts") < 3) & (F.size("contradicts") == 0) & F.col("promoted_to").isNull()
    )


def ops_alerts(events: DataFrame) -> DataFrame:
    """L-8: a message to the operators for each demoted concept."""
    return events.select(F.concat(F.lit("alert-"), "object_id").alias("object_id"), F.lit("ops-alerts").alias("channel"), F.lit("all").alias("to_presence"), F.concat(F.lit("concept demoted: "), "object_id").alias("content"))


def reinstate(rows: DataFrame, ids: DataFrame, object_type: str, now: float) -> tuple[DataFrame, DataFrame]:
    """L-10: demoted rows among ``ids`` back to matured; a concept's clock starts again."""
    chosen = rows.join(ids.select("object_id").distinct(), "object_id", "left_semi").filter("state = 'demoted'")
    updated, events, _ = apply_transitions(rows, intents_for(chosen, "matured", "operator", "reinstated"), object_type, now, with_targets=False)
    if "last_reinforced_epoch" in rows.columns:
        back = events.select("object_id", F.lit(True).alias("back"))
        updated = updated.join(back, "object_id", "left").withColumn("last_reinforced_epoch", F.when(F.col("back"), F.lit(now)).otherwise(F.col("last_reinforced_epoch"))).drop("back")
    return updated, events


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def promotion_path(concepts: DataFrame) -> DataFrame:
    """L-12: where a concept's note goes: by its first topic, else by the first that it is linked to."""
    parts = F.split("namespace", "/")
    topics = F.col("topics")
    if "linked_to_topics" in concepts.columns:
        topics = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.col("linked_to_topics"))
    topic = F.coalesce(slug(F.try_element_at(topics, F.lit(1))), F.lit(""))
    folder = F.when(topic == "", "_misc").otherwise(topic)
    return concepts.withColumn("path", F.concat_ws("/", F.lit("curated"), parts[0], parts[1], folder, F.concat(slug(F.col("title")), F.lit(".md"))))


def resolve_path_conflicts(wanted: DataFrame, notes: DataFrame) -> DataFrame:
    """L-13: ``wanted`` with its final path, the id to reuse where the concept owns the note there
    already, and ``conflict``: ``managed`` or ``human`` where another's note holds the path.

    Beside a managed note goes ``-v2``, beside a human one ``-promoted-`` with the id's first eight
    characters. Paths that are held or given already then get ``-2``, ``-3``, ...: in each round
    the rows without a path number the names of their own stem onwards, by object_id, and every name
    that is free goes to the first that asks for it, until no two agree.
    """
    ensure_checkpoint_dir(wanted.sparkSession)
    held = notes.select(F.col("vault_path").alias("path"), F.col("promoted_from").alias("owner"), "managed", F.col("object_id").alias("held_id"), F.lit(True).alias("there"))
    stem = F.regexp_replace("path", "\\.md$", "")
    own = F.col("held_id").isNotNull() & F.coalesce(F.col("managed"), F.lit(False)) & F.col("owner").eqNullSafe(F.col("object_id"))
    beside = F.when(F.col("managed"), F.concat(stem, F.lit("-v2"))).otherwise(F.concat(stem, F.lit("-promoted-"), F.substring("object_id", 1, 8)))
    conflict = F.when(F.col("there").isNull() | own, F.lit(None)).when(F.col("managed"), "managed").otherwise("human")
    out = wanted.join(held, "path", "left").withColumns({"reuse_id": F.when(own, F.col("held_id")), "conflict": conflict})
    out = out.withColumn("stem", F.when(F.col("conflict").isNull(), stem).otherwise(beside)).drop("owner", "managed", "held_id", "there").checkpoint()
    ids = out.select("object_id", "stem", "reuse_id", F.lit(0).cast("long").alias("tried"))
    settled = ids.filter("reuse_id is not null").select("object_id", F.concat("stem", F.lit(".md")).alias("final_path"))
    taken = notes.select(F.col("vault_path").alias("final_path")).distinct()
    pending = ids.filter("reuse_id is null").drop("reuse_id")
    while not pending.isEmpty():
        number = F.col("tried") + F.row_number().over(Window.partitionBy("stem").orderBy("object_id"))
        name = F.concat("stem", F.when(F.col("number") > 1, F.concat(F.lit("-"), F.col("number"))).otherwise(F.lit("")), F.lit(".md"))
        asked = pending.withColumn("number", number).withColumn("final_path", name)
        last = F.max("number").over(Window.partitionBy("stem"))
        first = F.row_number().over(Window.partitionBy("final_path").orderBy("number", "object_id"))
        asked = asked.withColumns({"last": last, "first": first}).join(taken.withColumn("held", F.lit(True)), "final_path", "left").checkpoint()
        free = (F.col("first") == 1) & F.col("held").isNull()
        given = asked.filter(free).select("object_id", "final_path")
        settled, taken = settled.unionByName(given), taken.unionByName(given.select("final_path"))
        pending = asked.filter(~free).select("object_id", "stem", F.col("last").alias("tried"))
    return out.drop("stem").join(settled, "object_id")


#: What a note's body may not say, and its lengths.
DISCLAIMERS = "as an ai model|as a language model"
BODY_LENGTH = (100, 20_000)


def promotion_verdict(body: Column) -> Column:
    """L-14: the policy reason against a rendered note, or null."""
    return (
        F.when(~F.coalesce(F.length(body), F.lit(0)).between(*BODY_LENGTH), "bad_length").when(~body.contains("##"), "no_section")
        .when(F.lower(body).rlike(DISCLAIMERS), "ai_disclaimer")
    )


def promote(concepts: DataFrame, bodies: DataFrame, now: float, notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """L-14: what a promotion run makes of the eligible concepts that have a rendered body:
    ``curated`` rows, the ``concepts`` after the run, ``events``, ``notes`` to be written (IO-5),
    ``thoughts`` for the operators, and ``rejections``.

    A body against the policy is a rejection, which raises the concept's attempts (A-7). The others
    get a path (L-12) that agrees with no note there (L-13; ``notes`` has vault_path,
    promoted_from, managed, object_id), a curated row, which takes the id of the note that
    the concept has already, and the state promoted. ``body_hash`` is that of the note as it is
    read back (J-8).
    """
    spark = concepts.sparkSession
    ensure_checkpoint_dir(spark)
    if notes is None:
        notes = spark.createDataFrame([], "vault_path string, promoted_from string, managed boolean, object_id string")
    ready = concepts.filter(promotion_eligible(now)).join(bodies, "object_id").withColumn("reason", promotion_verdict(F.col("body")))
    rejections = ready.filter("reason is not null").select("object_id", "reason", F.lit(now).alias("rejected_epoch"))
    placed = resolve_path_conflicts(promotion_path(ready.filter("reason is null")).select("object_id", "path"), notes)
    fresh = F.substring(F.sha2(F.concat_ws("\x1f", F.lit("promotion"), "object_id"), 256), 1, 27)
    good = ready.drop("reason").join(placed.drop("path"), "object_id").withColumn("curated_id", F.coalesce("reuse_id", fresh)).checkpoint()
    extra = [c for c in ("summary", "tags", "topics", "importance") if c in concepts.columns]
    curated = good.select(
        F.col("curated_id").alias("object_id"), F.concat_ws("/", F.split("namespace", "/")[0], F.split("namespace", "/")[1], F.lit("curated")).alias("namespace"),
        F.col("final_path").alias("vault_path"), "title", F.col("body").alias("content"), body_hash(F.col("body")).alias("body_hash"), *extra,
        F.col("object_id").alias("promoted_from"), F.lit(now).alias("promoted_at"), F.lit("matured").alias("state"), F.lit(True).alias("managed"),
    )
    rows = concepts if "superseded_by" in concepts.columns else concepts.withColumn("superseded_by", F.lit(None).cast("string"))
    after, events, _ = apply_transitions(rows, intents_for(good, "promoted", "promotion", "lifecycle-promotion-sweep"), "concept", now, with_targets=False)
    done = good.select("object_id", "curated_id")
    promoted_at = F.col("promoted_at") if "promoted_at" in concepts.columns else F.lit(None).cast("double")
    after = after.join(done, "object_id", "left").withColumns({
        "promoted_to": F.coalesce("curated_id", "promoted_to"), "promoted_at": F.when(F.col("curated_id").isNotNull(), F.lit(now)).otherwise(promoted_at),
    }).drop("curated_id")

    def told(rows: DataFrame, title: str, content: Column) -> DataFrame:
        return rows.select(F.lit("ops-alerts").alias("channel"), F.lit("all").alias("to_presence"), F.lit(title).alias("title"), "object_id", content.alias("content"))

    said = F.concat(F.lit("Concept '"), "title", F.lit("' has become the note "), "final_path", F.lit("."))
    moved = F.concat(F.lit("A "), "conflict", F.lit(" note holds the path; the new one is "), "final_path", F.lit("."))
    return {
        "curated": curated, "concepts": record_rejections(after, rejections), "events": events, "rejections": rejections,
        "notes": good.select(F.col("final_path").alias("path"), F.col("curated_id").alias("object_id"), "title", "body"),
        "thoughts": told(good, "Concept promoted", said).unionByName(told(good.filter("conflict is not null"), "Path conflict", moved)),
    }


#: Seconds after which rows of a plane expire, where the caller says nothing else.
RETENTION = {"thought": 30 * DAY}


def retention_expired(rows: DataFrame, now: float, policy: dict[str, float] | None = None) -> DataFrame:
    """L-15: rows past their plane's time to live, in seconds; planes without one never expire, nor
    do artifacts that only keep evidence (``stored_unindexed``)."""
    policy = RETENTION if policy is None else policy
    if "artifact_state" in rows.columns:
        kept = (F.col("plane") == "artifact") & (F.col("artifact_state") == "stored_unindexed")
        rows = rows.filter(~F.coalesce(kept, F.lit(False)))
    ttl = F.coalesce(*(F.when(F.col("plane") == p, F.lit(t)) for p, t in policy.items() if t > 0), F.lit(None).cast("double"))
    return rows.filter(ttl.isNotNull() & (F.col("updated_epoch") < F.lit(now) - ttl))


def tombstones(rows: DataFrame, now: float) -> DataFrame:
    """L-16: archived rows that may go."""
    return rows.filter((F.col("state") == "archived") & (F.col("updated_epoch") < now - 30 * DAY))


def object_history(events: DataFrame) -> DataFrame:
    """L-18: each event's place by (occurred_us, event_id), the state before it, whether that state
    agrees, and ``in_order``: whether its time is no earlier than those of the object's events
    that were written before it (by event_id)."""
    w = Window.partitionBy("object_id").orderBy("occurred_us", "event_id")
    before = F.lag("to_state").over(w)
    written = Window.partitionBy("object_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("occurred_us").over(written)
    return events.withColumns({
        "place": F.row_number().over(w), "previous": before, "consistent": before.isNull() | (before == F.col("from_state")),
        "in_order": latest.isNull() | (F.col("occurred_us") >= latest),
    })


def candidate_pool(pool: DataFrame, seen: DataFrame, clustered: DataFrame, now: float, ttl: float = 30 * DAY) -> DataFrame:
    """L-20: the pool after a run: clustered rows leave, unclustered ones are counted again,
    and those first seen before the time to live are pruned."""
    key = ["family", "object_id"]
    out = pool.join(seen.select(*key, F.lit(True).alias("again")), key, "full_outer").join(clustered.select(*key), key, "left_anti")
    out = out.select(*key, F.coalesce("first_seen", F.lit(now)).alias("first_seen"), (F.coalesce("attempts", F.lit(0)) + F.coalesce(F.col("again").cast("int"), F.lit(0))).alias("attempts"))
    return out.filter(F.col("first_seen") >= now - ttl)


def events_in_window(events: DataFrame, to_state: str, t0: float, t1: float) -> DataFrame:
    """D-1"""
    return events.filter((F.col("to_state") == to_state) & (F.col("occurred_us") >= int(t0 * 1e6)) & (F.col("occurred_us") < int(t1 * 1e6)))


def at_risk(rows: DataFrame, now: float) -> DataFrame:
    """D-2"""
    return rows.filter((F.col("state") == "matured") & (F.col("importance") <= 4) & (F.col("updated_epoch") < now - 30 * DAY))


def new_contradictions(concepts: DataFrame, t0: float, t1: float) -> DataFrame:
    """D-3"""
    return concepts.filter((F.size("contradicts") > 0) & (F.col("updated_epoch") >= t0) & (F.col("updated_epoch") < t1))


def worth_revisiting(curated: DataFrame, now: float) -> DataFrame:
    """D-4: important notes not read for 30 days, or never; the latter count as 30."""
    days = F.when(F.col("last_accessed_epoch").isNull(), F.lit(30)).otherwise(F.floor((F.lit(now) - F.col("last_accessed_epoch")) / DAY))
    idle = F.col("last_accessed_epoch").isNull() | (F.col("last_accessed_epoch") <= now - 30 * DAY)
    return curated.filter((F.col("state") == "matured") & (F.col("importance") >= 8) & idle).withColumn("days", days.cast("long"))


#: Fixed pattern: an id that a text cites.
_CITED = "\\b([0-9A-Za-z]{27})\\b"


def unverified_citations(texts: DataFrame, known: DataFrame) -> DataFrame:
    """D-5: (text_id, cited): 27-character ids in the text that are not known."""
    cited = texts.select("text_id", F.explode(F.regexp_extract_all("text", F.lit(_CITED), F.lit(1))).alias("cited")).distinct()
    return cited.join(known.select(F.col("object_id").alias("cited")), "cited", "left_anti")


def mark_citations(texts: DataFrame, known: DataFrame) -> DataFrame:
    """D-5: texts with `` (unverified)`` after each 27-character id that is not known.

    A text falls into parts, each an id and what follows it; the parts meet the known ids in a
    join and are put together again. So neither the ids nor a text's citations go to one place.
    """
    whole = F.regexp_replace("text", _CITED, "\x00$1\x00")
    parts = texts.select("text_id", F.posexplode(F.split(whole, "\x00")).alias("place", "part"))  # every other part is an id
    ids = known.select(F.col("object_id").alias("part"), F.lit(True).alias("known")).distinct()
    told = parts.join(ids, "part", "left")
    shown = F.when((F.col("place") % 2 == 1) & F.col("known").isNull(), F.concat("part", F.lit(" (unverified)"))).otherwise(F.col("part"))
    ordered = F.array_sort(F.collect_list(F.struct("place", shown.alias("shown"))))  # the parts of one text
    return told.groupBy("text_id").agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), "").alias("text"))


def daily_digest(sections: list[tuple[str, DataFrame]], date: str) -> DataFrame:
    """D-6: (path, place, section, line) of the date's digest, a row per line, so that no section
    becomes one value; a section without lines says so. A digest replaces the one of its path,
    and its order is that of place and line."""
    out = None
    for place, (name, lines) in enumerate(sections):
        empty = lines.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("Nothing today.").alias("line"))
        one = lines.select("line").unionByName(empty)
        one = one.select(F.lit(f"reflections/{date}.md").alias("path"), F.lit(place).alias("place"), F.lit(name).alias("section"), "line")
        out = one if out is None else out.unionByName(one)
    return out
