"""Lifecycle sweeps and the daily digest over the planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import joins, lifecycle as l
from memlake.plans import maturation
from memlake.queries.combining import TAGGED, tagged
from memlake.queries.registry import STRIPPED, query
from memlake.sources import planes as P
from memlake.sources.scratch import ensure_checkpoint_dir

E_, C_, K_, A_ = ("episodic",), ("concept",), ("curated",), ("artifact",)
NOW = P.NOW


def moved(result):
    updated, events = result[0], result[1]
    return updated.select("object_id", "state", "version", "updated_epoch").join(events.select("object_id", "from_state", "reason"), "object_id", "left")


def swept(plane: str, condition: str, to: str, reason: str) -> str:
    return f"""select object_id, case when {condition} then '{to}' else state end as state, case when {condition} then 2 else 1 end as version, case when {condition} then 1714521600.0 else updated_epoch end as updated_epoch,
      case when {condition} then state end as from_state, case when {condition} then '{reason}' end as reason from {plane}"""


def bare(df):
    return df.withColumn("superseded_by", F.lit(None).cast("string"))


LEGAL = """(s.state = 'provisional' and t.to_state in ('matured', 'archived')) or (s.state = 'matured' and t.to_state in ('demoted', 'superseded'))
  or (s.state in ('demoted', 'archived') and t.to_state = 'matured')"""
TO_STATE = "case ({}) % 5 when 0 then 'matured' when 1 then 'demoted' when 2 then 'superseded' when 3 then 'archived' else 'promoted' end"
INTENTS = f"""i as (select object_id || '-a' as intent_id, object_id, number, {TO_STATE.format("number")} as to_state, case when number % 17 = 0 then '' else 'r' end as reason, case when number % 13 = 0 then 9 end as expected, 0 as asked_at,
    case when number % 20 = 17 then 'D' || lpad(cast(number - 10 as varchar), 26, '0') when number % 5 = 2 then 'D' || lpad(cast(number + 1 as varchar), 26, '0') end as target from episodic),
  all_i as (select * from i union all select object_id || '-b', object_id, number, {TO_STATE.format("number + 1")}, 'r', case when number % 2 = 0 then 2 end, 1, null from i where number % 3 = 0
    union all select object_id || '-c', object_id, number, {TO_STATE.format("number")}, 'r', null, 2, null from i where number % 3 = 0 union all select 'ghost', 'nobody', 1, 'matured', 'r', null, 0, null),
  turns as (select a.*, row_number() over (partition by a.object_id order by asked_at, intent_id) as turn, e.state as row_state, e.version as row_version, e.namespace is not null as found,
      coalesce(target = a.object_id or t.superseded_by = a.object_id, false) as cyclic
    from all_i a left join episodic e on e.object_id = a.object_id left join episodic t on t.object_id = a.target)"""


@query("l01_apply_transitions", f"""with recursive {INTENTS}, step as (
    select object_id, cast(0 as bigint) as turn, cast('' as varchar) as intent_id, row_state as state, row_version as version, cast(null as varchar) as code, cast(null as varchar) as target from turns where turn = 1
    union all select j.object_id, j.turn, j.intent_id, case when j.code is null then j.to_state else j.state end, case when j.code is null then j.version + 1 else j.version end, coalesce(j.code, 'ok'), j.target
    from (select t.object_id, t.turn, t.intent_id, t.to_state, t.target, s.state, s.version, case when t.reason = '' then 'missing_reason' when not t.found then 'not_found' when t.expected is not null and t.expected <> s.version then 'version_fence_violation'
        when not ({LEGAL}) then 'illegal_transition' when t.cyclic then 'circular_supersession' end as code
      from step s join turns t on t.object_id = s.object_id and t.turn = s.turn + 1) j)
  select intent_id, object_id, code, state, version from step where turn > 0""", E_)
def _(spark, d):
    e = P.episodic(spark, d)
    return l.transition_log(e, _intents(spark, d), "episodic").select("intent_id", "object_id", "code", "state", "version")


def _intents(spark, d):
    """Up to three intents for an object, some with fences, some with targets that close a circle."""
    e, n, none = P.episodic(spark, d), F.col("number"), F.lit(None)

    def to(k):
        return F.when(k % 5 == 0, "matured").when(k % 5 == 1, "demoted").when(k % 5 == 2, "superseded").when(k % 5 == 3, "archived").otherwise("promoted")

    target = F.when(n % 20 == 17, P.key("D", n - 10)).when(n % 5 == 2, P.key("D", n + 1))
    one = e.select(F.concat("object_id", F.lit("-a")).alias("intent_id"), "object_id", to(n).alias("to_state"), F.when(n % 13 == 0, 9).alias("expected_version"), F.when(n % 17 == 0, "").otherwise("r").alias("reason"), F.lit("x").alias("actor"), target.alias("target"), F.lit(0.0).alias("requested_at"), n)
    third = one.filter(n % 3 == 0).withColumns({"reason": F.lit("r"), "target": none.cast("string")})
    two = third.withColumns({"intent_id": F.concat("object_id", F.lit("-b")), "to_state": to(n + 1), "expected_version": F.when(n % 2 == 0, 2), "requested_at": F.lit(1.0)})
    three = third.withColumns({"intent_id": F.concat("object_id", F.lit("-c")), "expected_version": none.cast("int"), "requested_at": F.lit(2.0)})
    ghost = one.limit(1).withColumns({"intent_id": F.lit("ghost"), "object_id": F.lit("nobody"), "to_state": F.lit("matured"), "expected_version": none.cast("int"), "reason": F.lit("r"), "target": none.cast("string")})
    return one.unionByName(two).unionByName(three).unionByName(ghost).drop("number")


@query("l01_transition_result", f"""with recursive {INTENTS}, step as (
    select object_id, cast(0 as bigint) as turn, row_state as state, row_version as version from turns where turn = 1
    union all select t.object_id, t.turn, case when t.ok and ({LEGAL}) and (t.expected is null or t.expected = s.version) then t.to_state else s.state end,
      case when t.ok and ({LEGAL}) and (t.expected is null or t.expected = s.version) then s.version + 1 else s.version end
    from step s join (select *, reason <> '' and found and not cyclic as ok from turns) t on t.object_id = s.object_id and t.turn = s.turn + 1)
  select e.object_id, arg_max(s.state, s.turn) as state, max(s.version) as version from episodic e join step s on s.object_id = e.object_id group by e.object_id""", E_)
def _(spark, d):
    """The rows after all intents of ``l01_apply_transitions``."""
    return l.apply_transitions(P.episodic(spark, d), _intents(spark, d), "episodic", NOW)[0].select("object_id", "state", "version")


@query("l03_mature_episodic", swept("episodic", "(state = 'provisional' and created_epoch < 1714521600 - 3600)", "matured", "matured"), E_)
def _(spark, d):
    return moved(l.sweep(P.episodic(spark, d), l.to_mature(NOW), "matured", "matured", "episodic", NOW))


@query("l03_mature_enriched", """with e as (select *, number % 8 = 0 and created_epoch < 1714521600 - 3600 as ripe from episodic)
  select object_id, case when ripe then 'matured' when number % 16 = 1 and (number - 1) % 5 <> 0 and exists (select 1 from e n where n.number = e.number - 1 and n.ripe) then 'superseded' else state end as state,
    case when ripe then array_to_string([tags[1], case when tags[2] = 'g2' then 'two' else tags[2] end], ',') else array_to_string(tags, ',') end as tags,
    case when ripe and number % 3 = 0 then 10 else importance end as importance, case when ripe and number % 5 = 0 then 'found' else 'pair' || cast(number // 2 as varchar) end as topics,
    case when ripe and number % 16 = 0 and number % 5 <> 0 and exists (select 1 from e n where n.number = e.number + 1) then 'D' || lpad(cast(number + 1 as varchar), 26, '0') else '' end as supersedes,
    case when number % 16 = 1 and (number - 1) % 5 <> 0 and exists (select 1 from e n where n.number = e.number - 1 and n.ripe) then 'D' || lpad(cast(number - 1 as varchar), 26, '0') end as superseded_by from e""", E_)
def _(spark, d):
    """Two neighbours share a topic and a vector; every second ripe row says that it is an update."""
    ensure_checkpoint_dir(spark)
    n = F.col("number")
    e = bare(P.episodic(spark, d)).withColumn("namespace", F.lit("a/b/episodic"))
    e = e.withColumn("content", F.when(n % 16 == 0, F.concat(F.lit("Update: "), "content")).otherwise(F.concat(F.lit("x "), "content")))
    e = e.withColumns({"topics": F.array(F.concat(F.lit("pair"), F.floor(n / 2).cast("string"))), "vector": F.array(F.lit(1.0), F.lit(0.0))})
    out, _ = maturation.mature(
        e, NOW, {"g2": "two"}, lambda rows: {i: 99 for i, _, _ in rows if int(i[1:]) % 3 == 0}, lambda i, content, tags: ["found"] if int(i[1:]) % 5 == 0 else []
    )
    lists = [F.array_join(c, ",").alias(c) for c in ("tags", "topics", "supersedes")]
    return out.select("object_id", "state", "importance", "superseded_by", *lists)


@query("l04_archive_stale_provisional", swept("episodic", "(state = 'provisional' and created_epoch < 1714521600 - 7 * 86400)", "archived", "provisional-ttl"), E_)
def _(spark, d):
    return moved(l.sweep(P.episodic(spark, d), l.stale_provisional(NOW), "archived", "provisional-ttl", "episodic", NOW))


@query("l05_demote_unused", swept("episodic", "(state = 'matured' and access_count = 0 and reinforcement_count = 0 and importance < 4 and updated_epoch < 1714521600 - 60 * 86400)", "demoted", "unused"), E_)
def _(spark, d):
    return moved(l.sweep(P.episodic(spark, d), l.unused(NOW), "demoted", "unused", "episodic", NOW))


@query("l06_demote_inactive", swept("episodic", "(state = 'matured' and updated_epoch < 1714521600 - 30 * 86400)", "demoted", "inactive"), E_)
def _(spark, d):
    return moved(l.sweep(P.episodic(spark, d), l.inactive(NOW), "demoted", "inactive", "episodic", NOW))


@query("l07_mature_concepts", swept("concept", "(state = 'synthesized' and created_epoch < 1714521600 - 86400 and reinforcement_count >= 3 and len(contradicts) = 0)", "matured", "ripe"), C_)
def _(spark, d):
    c = P.concept(spark, d).withColumn("reinforcement_count", F.col("reinforcement_count"))
    return moved(l.sweep(bare(c), l.concept_ripe(NOW), "matured", "ripe", "concept", NOW))


@query("l08_demote_concepts", """select 'alert-' || object_id as object_id, 'ops-alerts' as channel, 'all' as to_presence, 'concept demoted: ' || object_id as content from concept
  where state = 'matured' and coalesce(last_reinforced_epoch, created_epoch) < 1714521600 - 30 * 86400""", C_)
def _(spark, d):
    return l.ops_alerts(l.sweep(bare(P.concept(spark, d)), l.concept_idle(NOW), "demoted", "idle", "concept", NOW)[1])


@query("l09_archive_artifacts", """select object_id, 'archived' as to_state from artifact a where state = 'matured' and created_epoch < 1714521600 - 180 * 86400 and not exists (select 1 from episodic e where list_contains(e.supported_by, a.object_id))""", (*A_, *E_))
def _(spark, d):
    a = P.artifact(spark, d)
    chosen = joins.unreferenced_artifacts(a, P.episodic(spark, d), NOW)
    return l.apply_transitions(bare(a), l.intents_for(chosen, "archived", "lifecycle", "unreferenced"), "artifact", NOW, with_targets=False)[1].select("object_id", "to_state")


@query("l10_reinstate", "select object_id, case when state = 'demoted' and number % 2 = 0 then 'matured' else state end as state, case when state = 'demoted' and number % 2 = 0 then 1714521600.0 else last_reinforced_epoch end as last_reinforced_epoch from concept", C_)
def _(spark, d):
    c = bare(P.concept(spark, d))
    return l.reinstate(c, c.filter("number % 2 = 0"), "concept", NOW)[0].select("object_id", "state", "last_reinforced_epoch")


ELIGIBLE = "state = 'matured' and reinforcement_count >= 2 and importance + 5 >= 6 and created_epoch <= 1714521600 - 2 * 86400 and promotion_attempts < 3 and len(contradicts) = 0 and promoted_to is null"


def candidates(spark, d):
    return P.concept(spark, d).withColumns({"reinforcement_count": F.col("reinforcement_count") + 1, "importance": F.col("importance") + 5})


@query("l11_promotion_eligible", f"select object_id from concept where {ELIGIBLE}", C_)
def _(spark, d):
    return candidates(spark, d).filter(l.promotion_eligible(NOW)).select("object_id")


SLUG = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("l12_promotion_path", f"""select object_id, 'curated/' || identity_family || '/shared/' || case when number % 14 = 0 then '_misc' when number % 7 = 0 then 'linked-to-' || cast(number % 4 as varchar) else topics[1] end || '/' || {SLUG} || '.md' as path from concept""", C_)
def _(spark, d):
    """Every seventh concept has no topics of its own, and half of these are linked to none."""
    n = F.col("number")
    linked = F.when(n % 14 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Linked to: "), n % 4)))
    c = P.concept(spark, d).withColumns({"topics": F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("topics")), "linked_to_topics": linked})
    return l.promotion_path(c).select("object_id", "path")


@query("l13_resolve_path_conflicts", """with w as (select 'p' || cast(number % 50 as varchar) as stem, object_id, number from concept), h as (select 'p' || cast(number % 50 as varchar) as stem, min(number) as number from concept where number % 3 = 0 group by number % 50),
  f as (select w.object_id, case when h.number is null then w.stem when h.number % 2 = 0 and h.number = w.number then w.stem when h.number % 2 = 0 then w.stem || '-v2' else w.stem || '-promoted-' || substr(w.object_id, 1, 8) end as stem,
    case when h.number % 2 = 0 and h.number = w.number then 'K' || substr(w.object_id, 2) end as reuse_id from w left join h on h.stem = w.stem),
  held as (select stem from h union select stem || '-2' from h union select stem || '-v2' from h where number % 4 = 0),
  asked as (select *, row_number() over (partition by stem order by object_id) as j, count(*) over (partition by stem) as m from f where reuse_id is null),
  round as (select *, stem || case when j > 1 then '-' || cast(j as varchar) else '' end in (select stem from held) as lost from asked),
  given as (select *, case when not lost then j when m > 1 then m + sum(cast(lost as integer)) over (partition by stem order by object_id) when stem || '-2' in (select stem from held) then 3 else 2 end as k from round)
  select object_id, reuse_id, stem || '.md' as final_path from f where reuse_id is not null
  union all select object_id, null, stem || case when k > 1 then '-' || cast(cast(k as bigint) as varchar) else '' end || '.md' from given""", C_)
def _(spark, d):
    """Fifty stems for all concepts; notes hold many of them, their second names and some ``-v2``."""
    c, n = P.concept(spark, d), F.col("number")
    wanted = c.select(F.concat(F.lit("p"), (n % 50).cast("string"), F.lit(".md")).alias("path"), "object_id")
    held = c.filter(n % 3 == 0).groupBy((n % 50).alias("k")).agg(F.min("number").alias("number"))
    stem, none = F.concat(F.lit("p"), F.col("k").cast("string")), F.lit(None).cast("string")
    notes = held.select(F.concat(stem, F.lit(".md")).alias("vault_path"), P.key("C", n).alias("promoted_from"), (n % 2 == 0).alias("managed"), P.key("K", n).alias("object_id"))
    more = held.select(F.concat(stem, F.lit("-2.md")).alias("vault_path"), none.alias("promoted_from"), F.lit(False).alias("managed"), F.lit("X").alias("object_id"))
    third = held.filter(n % 4 == 0).select(F.concat(stem, F.lit("-v2.md")).alias("vault_path"), none.alias("promoted_from"), F.lit(True).alias("managed"), F.lit("Y").alias("object_id"))
    return l.resolve_path_conflicts(wanted, notes.unionByName(more).unionByName(third)).select("object_id", "reuse_id", "final_path")


BODIES = f"""bodies as (select *, case when number % 3 = 2 then content || repeat('x', 100) else '## A' || chr(10) || chr(10) || content || chr(10) end as body from concept),
  outcome as (select *, case when length(body) not between 100 and 20000 then 'bad_length' when not contains(body, '##') then 'no_section'
    when regexp_matches(lower(body), 'as an ai model|as a language model') then 'ai_disclaimer' else 'promoted' end as outcome from bodies where {ELIGIBLE})"""


def promotion(spark, d):
    c = candidates(spark, d)
    body = F.when(F.col("number") % 3 == 2, F.concat(F.col("content"), F.lit("x" * 100))).otherwise(F.concat(F.lit("## A\n\n"), "content", F.lit("\n")))
    return l.promote(c, c.select("object_id", body.alias("body")), NOW)


@query("l14_promote", f"with {BODIES} select object_id, outcome from outcome", C_)
def _(spark, d):
    out = promotion(spark, d)
    return out["events"].select("object_id", F.lit("promoted").alias("outcome")).unionByName(out["rejections"].select("object_id", F.col("reason").alias("outcome")))


@query("l14_promoted_rows", f"""with {BODIES}, stems as (select *, 'curated/' || identity_family || '/shared/' || topics[1] || '/' || {SLUG} as stem from outcome where outcome = 'promoted'),
  named as (select *, row_number() over (partition by stem order by object_id) as nth from stems)
  select object_id as promoted_from, identity_family || '/shared/curated' as namespace, title, stem || case when nth > 1 then '-' || cast(nth as varchar) else '' end || '.md' as vault_path,
    {STRIPPED.format('body')} as body_hash, substr(sha256('promotion' || chr(31) || object_id), 1, 27) as object_id, importance + 5 as importance, 1714521600.0 as promoted_at from named""", C_)
def _(spark, d):
    return promotion(spark, d)["curated"].select("promoted_from", "namespace", "title", "vault_path", "body_hash", "object_id", "importance", "promoted_at")


@query("l14_concepts_after", f"""with {BODIES}, of as (select b.object_id, o.outcome, b.state, b.reinforcement_count, b.promotion_attempts, b.promoted_to, b.version from bodies b left join outcome o on o.object_id = b.object_id)
  select object_id, case when outcome = 'promoted' then 'promoted' else state end as state, case when outcome = 'promoted' then substr(sha256('promotion' || chr(31) || object_id), 1, 27) else promoted_to end as promoted_to,
    promotion_attempts + case when outcome <> 'promoted' then 1 else 0 end as promotion_attempts, case when outcome <> 'promoted' then outcome end as rejected_reason,
    version + case when outcome = 'promoted' then 1 else 0 end as version from of""", C_)
def _(spark, d):
    return promotion(spark, d)["concepts"].select("object_id", "state", "promoted_to", "promotion_attempts", "rejected_reason", "version")


@query("l15_retention_expired", f"with {TAGGED} select plane, object_id from tagged where (plane = 'episodic' and created_epoch < 1714521600 - 90 * 86400) or (plane = 'artifact' and created_epoch < 1714521600 - 300 * 86400 and substr(object_id, 27, 1) <> '7')", (*E_, *C_, *K_, *A_))
def _(spark, d):
    held = F.when(F.col("object_id").endswith("7"), "stored_unindexed").otherwise("indexed")
    rows = tagged(spark, d).withColumns({"updated_epoch": F.col("created_epoch"), "artifact_state": held})
    return l.retention_expired(rows, NOW, {"episodic": 90 * l.DAY, "artifact": 300 * l.DAY, "curated": 0.0}).select("plane", "object_id")


@query("l16_cleanup_tombstones", "select object_id from episodic where state = 'archived' and updated_epoch < 1714521600 - 30 * 86400", E_)
def _(spark, d):
    return l.tombstones(P.episodic(spark, d), NOW).select("object_id")


@query("l18_object_history", """select event_id, row_number() over w as place, lag(to_state) over w as previous, coalesce(lag(to_state) over w = from_state, true) as consistent,
  coalesce(occurred_us >= max(occurred_us) over (partition by object_id order by event_id rows between unbounded preceding and 1 preceding), true) as in_order
  from (select * exclude (occurred_us), occurred_us - case when event_id % 7 = 0 then 864000000000 else 0 end as occurred_us from lifecycle_events) window w as (partition by object_id order by occurred_us, event_id)""", ("lifecycle_events",))
def _(spark, d):
    """Every seventh event is ten days late."""
    events = P.lifecycle_events(spark, d).withColumn("occurred_us", F.col("occurred_us") - F.when(F.col("event_id") % 7 == 0, 864000000000).otherwise(0))
    return l.object_history(events).select("event_id", "place", "previous", "consistent", "in_order")


@query("l20_candidate_pool", """select family, object_id, first_seen, attempts from (select p.identity_family as family, p.object_id, case when number % 3 = 0 then created_epoch else 1714521600.0 end as first_seen,
  case when number % 3 = 0 then number % 4 else 0 end + case when number % 2 = 0 then 1 else 0 end as attempts from episodic p where (number % 3 = 0 or number % 2 = 0) and number % 10 <> 0) t where first_seen >= 1714521600 - 100 * 86400""", E_)
def _(spark, d):
    e, n = P.episodic(spark, d).withColumn("family", F.col("identity_family")), F.col("number")
    pool = e.filter(n % 3 == 0).select("family", "object_id", F.col("created_epoch").alias("first_seen"), (n % 4).alias("attempts"))
    return l.candidate_pool(pool, e.filter(n % 2 == 0), e.filter(n % 10 == 0), NOW, 100 * l.DAY)


@query("d01_events_in_window", "select event_id, object_id from lifecycle_events where to_state = 'demoted' and occurred_us >= 1704844800000000 and occurred_us < 1704931200000000", ("lifecycle_events",))
def _(spark, d):
    return l.events_in_window(P.lifecycle_events(spark, d), "demoted", 1704844800.0, 1704931200.0).select("event_id", "object_id")


@query("d02_at_risk", "select object_id from episodic where state = 'matured' and importance <= 4 and updated_epoch < 1714521600 - 30 * 86400", E_)
def _(spark, d):
    return l.at_risk(P.episodic(spark, d), NOW).select("object_id")


@query("d03_new_contradictions", "select object_id from concept where len(contradicts) > 0 and updated_epoch >= 1704844800 and updated_epoch < 1706844800", C_)
def _(spark, d):
    return l.new_contradictions(P.concept(spark, d), 1704844800.0, 1706844800.0).select("object_id")


@query("d04_worth_revisiting", """select object_id, case when last_accessed_epoch is null then 30 else cast(floor((1714521600.0 - last_accessed_epoch) / 86400) as bigint) end as days from curated
  where state = 'matured' and importance >= 8 and (last_accessed_epoch is null or last_accessed_epoch <= 1714521600 - 30 * 86400)""", K_)
def _(spark, d):
    return l.worth_revisiting(P.curated(spark, d), NOW).select("object_id", "days")


def citing(spark, d):
    """Every memory's text, citing three ids: one that is known for every third, one for every fifth, one that is none."""
    e, n = P.episodic(spark, d), F.col("number")
    text = F.concat(F.translate("content", "\x00", " "), F.lit(" see "), P.key("D", n + 5), F.lit(", "), P.key("C", n - n % 5), F.lit(". "), F.lit("x" * 27))
    known = e.filter(n % 3 == 0).select("object_id").unionByName(P.concept(spark, d).filter(n % 5 == 0).select("object_id"))
    return e.select(n.alias("text_id"), text.alias("text")), known


CITING = """known as (select object_id from episodic where number % 3 = 0 union select object_id from concept where number % 5 = 0),
  cites as (select number, 'D' || lpad(cast(number + 5 as varchar), 26, '0') as a, 'C' || lpad(cast(number - number % 5 as varchar), 26, '0') as b, repeat('x', 27) as c, replace(content, chr(0), ' ') as body from episodic),
  own as (select number, unnest(regexp_extract_all(body, '\\b([0-9A-Za-z]{27})\\b', 1)) as cited from cites),
  named as (select number, a as cited from cites union select number, b from cites union select number, c from cites union select number, cited from own)"""


@query("d05_unverified_citations", f"with {CITING} select number as text_id, cited from named where cited not in (select object_id from known)", (*E_, *C_))
def _(spark, d):
    return l.unverified_citations(*citing(spark, d))


@query("d05_marked_citations", f"""with {CITING} select number as text_id, sha256(regexp_replace(body, '\\b([0-9A-Za-z]{{27}})\\b', '\\1 (unverified)', 'g') || ' see ' || a || case when a in (select object_id from known) then '' else ' (unverified)' end
  || ', ' || b || case when b in (select object_id from known) then '' else ' (unverified)' end || '. ' || c || ' (unverified)') as text_sha256 from cites""", (*E_, *C_))
def _(spark, d):
    return l.mark_citations(*citing(spark, d)).select("text_id", F.sha2("text", 256).alias("text_sha256"))


@query("d06_daily_digest", """select 'reflections/2024-05-01.md' as path, place, section, line from (
  select 0 as place, 'At risk' as section, '- ' || object_id as line from episodic where state = 'matured' and importance <= 4 and updated_epoch < 1714521600 - 30 * 86400
  union all select 1, 'Contradictions', '- ' || object_id from concept where len(contradicts) > 0 union all select 2, 'Nothing', 'Nothing today.') t""", (*E_, *C_))
def _(spark, d):
    def lines(df):
        return df.select(F.concat(F.lit("- "), "object_id").alias("line"))

    c = P.concept(spark, d)
    sections = [("At risk", lines(l.at_risk(P.episodic(spark, d), NOW))), ("Contradictions", lines(c.filter(F.size("contradicts") > 0))), ("Nothing", lines(c.filter("state = 'none'")))]
    return l.daily_digest(sections, "2024-05-01")
