"""Joins, merges and aggregations over the planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import joins as j, lineage, merge as m
from memlake.queries.registry import query
from memlake.sources import planes as P

E_, C_, K_, A_, T_ = ("episodic",), ("concept",), ("curated",), ("artifact",), ("thought",)


def points(spark, d):
    """The two-row layout of curated notes, with dangling and crossed pointers and old rows."""
    k, n = P.curated(spark, d), F.col("number")
    none = F.lit(None).cast("string")
    live = F.when(n % 21 == 0, F.concat(F.lit("q"), P.key("K", n + 7))).otherwise(F.concat(F.lit("q"), F.col("object_id")))
    base = ["object_id", "namespace", "state"]
    anchors = k.filter(n % 3 != 0).unionByName(k.filter(n % 21 == 0)).select(F.concat(F.lit("p"), "object_id").alias("point_id"), *base, F.lit("anchor").alias("point_kind"), live.alias("live_point"), F.when(n % 2 == 0, F.col("title")).alias("title"), none.alias("body_hash"))
    content = k.filter(n % 10 != 0).select(F.concat(F.lit("q"), "object_id").alias("point_id"), *base, F.lit("content").alias("point_kind"), none.alias("live_point"), F.concat("title", F.lit("!")).alias("title"), "body_hash")
    old = k.filter((n % 3 == 0) & (n % 21 != 0)).select(F.concat(F.lit("p"), "object_id").alias("point_id"), *base, none.alias("point_kind"), none.alias("live_point"), "title", "body_hash")
    return anchors.unionByName(content).unionByName(old)


POINTS_SQL = """points as (
  select 'p' || object_id as point_id, object_id, namespace, state, 'anchor' as point_kind, case when number % 21 = 0 then 'qK' || lpad(cast(number + 7 as varchar), 26, '0') else 'q' || object_id end as live_point,
    case when number % 2 = 0 then title end as title, cast(null as varchar) as body_hash from curated where number % 3 <> 0 or number % 21 = 0
  union all select 'q' || object_id, object_id, namespace, state, 'content', null, title || '!', body_hash from curated where number % 10 <> 0
  union all select 'p' || object_id, object_id, namespace, state, null, null, title, body_hash from curated where number % 3 = 0 and number % 21 <> 0)"""


@query("j01_committed_view", f"""with {POINTS_SQL} select a.object_id, a.point_kind, coalesce(a.title, c.title) as title, coalesce(a.body_hash, c.body_hash) as body_hash
  from points a join points c on a.live_point = c.point_id and a.namespace = c.namespace and a.object_id = c.object_id where a.point_kind = 'anchor' and c.point_kind = 'content'
  union all select object_id, point_kind, title, body_hash from points where point_kind is null""", K_)
def _(spark, d):
    return j.committed_view(points(spark, d), ["title", "body_hash"]).select("object_id", "point_kind", "title", "body_hash")


def chunks(spark, d):
    a, n, i = P.artifact(spark, d), F.col("number"), F.col("chunk_index")
    rows = a.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), (n % 4).cast("int")))).select(F.col("object_id").alias("artifact_id"), "chunk_index", F.concat(F.lit("g"), ((n + i) % 2).cast("string")).alias("generation"), F.lit("w").alias("owner_token"))
    heads = a.select(F.col("object_id").alias("artifact_id"), F.when(n % 5 != 0, F.concat(F.lit("g"), (n % 2).cast("string"))).alias("committed_generation"), F.lit("w").alias("committed_owner"))
    return rows, heads


@query("j02_committed_chunks", """select object_id as artifact_id, i as chunk_index, 'g' || cast((number + i) % 2 as varchar) as generation from (select object_id, number, unnest(range(0, number % 4 + 1)) as i from artifact) t
  where number % 5 <> 0 and (number + i) % 2 = number % 2""", A_)
def _(spark, d):
    return j.committed_chunks(*chunks(spark, d)).select("artifact_id", F.col("chunk_index").cast("long").alias("chunk_index"), "generation")


def lineage_planes(spark, d):
    """Memories in chains of up to four, twenty ids apart, and artifacts in the memories' namespaces."""
    n = F.col("number")
    e = P.episodic(spark, d).withColumn("superseded_by", F.when(F.floor(n / 20) % 4 != 3, P.key("D", n + 20)))
    beside = e.select("number", F.replace("namespace", F.lit("/episodic"), F.lit("/artifact")).alias("namespace"))
    a = P.artifact(spark, d).drop("namespace").join(beside, "number")
    return {"episodic": e, "concept": P.concept(spark, d), "curated": P.curated(spark, d), "artifact": a}


def page_of(df, plane):
    """All rows of a plane as hits."""
    nothing = {"promoted_to": "string", "promoted_from": "string", "supported_by": "array<string>"}
    more = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()]
    return df.select(F.lit(plane).alias("plane"), "namespace", "object_id", *more)


@query("j03_hydrate_lineage", """with recursive chain as (select object_id, namespace, number, title, state, supported_by, case when number // 20 % 4 <> 3 then 'D' || lpad(cast(number + 20 as varchar), 26, '0') end as nxt from episodic),
  walk as (select object_id, namespace, nxt, cast(null as varchar) as tip, 0 as hop from chain union all select w.object_id, w.namespace, c.nxt, c.object_id, w.hop + 1 from walk w join chain c on c.object_id = w.nxt and c.namespace = w.namespace),
  older as (select nxt as object_id, namespace, string_agg(object_id, ',' order by object_id) as supersedes from chain where nxt is not null group by nxt, namespace),
  files as (select a.object_id, replace(e.namespace, '/episodic', '/artifact') as namespace, a.filename from artifact a join episodic e on e.number = a.number),
  tips as (select object_id, arg_max(tip, hop) filter (where hop > 0) as tip from walk group by object_id)
  select c.object_id, t.tip, s.state as tip_state, coalesce(o.supersedes, '') as supersedes, coalesce(f.filename, '') as files from chain c join tips t on t.object_id = c.object_id left join chain s on s.object_id = t.tip
    left join older o on o.object_id = c.object_id and o.namespace = c.namespace left join files f on f.object_id = c.supported_by[1] and f.namespace = replace(c.namespace, '/episodic', '/artifact')""", (*E_, *A_))
def _(spark, d):
    planes = lineage_planes(spark, d)
    out = lineage.hydrate_lineage(page_of(planes["episodic"], "episodic"), planes)
    return out.select("object_id", "tip", "tip_state", F.array_join("supersedes", ",").alias("supersedes"), F.array_join("files", ",").alias("files"))


@query("j03_promoted", """select 'curated' as plane, k.object_id, c.title as promoted_from_title, cast(null as varchar) as promoted_title from curated k left join concept c on c.object_id = k.promoted_from and c.namespace = replace(k.namespace, '/curated', '/concept')
  union all select 'concept', c.object_id, null, k.title from concept c left join curated k on k.object_id = c.promoted_to and k.namespace = replace(c.namespace, '/concept', '/curated')""", (*K_, *C_))
def _(spark, d):
    planes = lineage_planes(spark, d)
    hits = page_of(planes["curated"], "curated").unionByName(page_of(planes["concept"], "concept"))
    return lineage.hydrate_lineage(hits, planes).select("plane", "object_id", "promoted_from_title", "promoted_title")


def chained(spark, d):
    """Memories in chains of ten and one of forty, each row superseded by the next id."""
    n = F.col("number")
    return P.episodic(spark, d).withColumn("superseded_by", F.when((n % 10 != 9) | (n < 39), P.key("D", n + 1)))


@query("j04_supersession_tip", """with recursive p as (select object_id, number, case when number % 10 <> 9 or number < 39 then number + 1 end as nxt from episodic),
  walk as (select object_id, number, nxt, 0 as hops from p union all select w.object_id, p.number, p.nxt, w.hops + 1 from walk w join p on p.number = w.nxt)
  select w.object_id, 'D' || lpad(cast(arg_max(w.number, w.hops) as varchar), 26, '0') as tip, max(w.hops) as hops from walk w group by w.object_id""", E_)
def _(spark, d):
    return j.supersession_tip(chained(spark, d))


@query("j05_supersession_cycle", """select object_id, 'D' || lpad(cast(case when number % 10 = 9 then number - 5 else number + 12 end as varchar), 26, '0') as target, number % 10 = 9 as cyclic
  from episodic""", E_)
def _(spark, d):
    n = F.col("number")
    proposed = P.episodic(spark, d).select("object_id", P.key("D", F.when(n % 10 == 9, n - 5).otherwise(n + 12)).alias("target"))
    return j.supersession_cycle(chained(spark, d), proposed)


@query("j06_unreferenced_artifacts", """select object_id from artifact a where state = 'matured' and created_epoch < 1714521600 - 180 * 86400
  and not exists (select 1 from episodic e where list_contains(e.supported_by, a.object_id))""", (*A_, *E_))
def _(spark, d):
    return j.unreferenced_artifacts(P.artifact(spark, d), P.episodic(spark, d), P.NOW).select("object_id")


def files(spark, d):
    """Files on disk: some notes lack theirs, some have changed."""
    k, n = P.curated(spark, d), F.col("number")
    return k.filter(n % 3 != 1).select(F.col("vault_path").alias("path"), F.when(n % 4 == 0, F.sha2("vault_path", 256)).otherwise(F.col("body_hash")).alias("file_hash"))


@query("j07_ghost_rows", """select object_id, vault_path from curated where state = 'matured' and number % 3 = 1""", K_)
def _(spark, d):
    k = P.curated(spark, d).withColumn("namespace", F.concat(F.lit("curated/"), "identity_family", F.lit("/curated")))
    return j.ghost_rows(k, files(spark, d)).select("object_id", "vault_path")


@query("j08_drifted_files", "select vault_path as path, sha256(vault_path) as file_hash from curated where number % 3 <> 1 and number % 4 = 0", K_)
def _(spark, d):
    return j.drifted_files(files(spark, d), P.curated(spark, d)).select("path", "file_hash")


@query("j09_suppress_echo", """select vault_path as path from curated where number % 3 <> 1 and (number % 4 = 0 or number % 2 = 1)""", K_)
def _(spark, d):
    writes = P.curated(spark, d).select(F.col("vault_path").alias("path"), F.col("body_hash").alias("file_hash"), (F.col("number") % 2 == 1).alias("consumed"))
    return j.suppress_echo(files(spark, d), writes).select("path")


@query("j10_fan_out", """select t.object_id, s.id as subscription_id from thought t join (select distinct namespace, 's-' || namespace || '-' || p as id, p from (select namespace, unnest(['user', 'all']) as p from thought) x) s
  on s.namespace = t.namespace and s.p = t.to_presence""", T_)
def _(spark, d):
    t = P.thought(spark, d)
    subs = t.select("namespace").distinct().select("namespace", F.explode(F.array(F.lit("user"), F.lit("all"))).alias("p"))
    subs = subs.select(F.concat(F.lit("s-"), "namespace", F.lit("-"), "p").alias("subscription_id"), "namespace", F.array("p", "p").alias("includes"))
    return j.fan_out(t, subs).select("object_id", "subscription_id")


@query("j11_reply_chain", """with recursive walk as (select object_id, object_id as cur, in_reply_to as nxt, 0 as depth from thought union all
  select w.object_id, t.object_id, t.in_reply_to, w.depth + 1 from walk w join thought t on t.object_id = w.nxt) select object_id, arg_max(cur, depth) as root, max(depth) as depth from walk group by object_id""", T_)
def _(spark, d):
    return j.reply_chain(P.thought(spark, d))


@query("j12_dedupe_lineage", """select h.query_id, h.object_id from (select number % 10 as query_id, object_id, superseded_by from episodic) h
  where not exists (select 1 from (select number % 10 as query_id, object_id from episodic) o where o.query_id = h.query_id and o.object_id = h.superseded_by)""", E_)
def _(spark, d):
    hits = P.episodic(spark, d).select((F.col("number") % 10).alias("query_id"), "object_id", "superseded_by", F.lit(None).cast("string").alias("promoted_to"))
    return j.dedupe_lineage(hits).select("query_id", "object_id")


@query("a01_merge_duplicates", """select identity_family, sha256(lower(content)) as body, min(object_id) as object_id, arg_min(reinforcement_count, number) + count(*) - 1 as reinforcement_count, count(*) as version,
  array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') as tags, case when count(*) > 1 then 1714521600.0 else min(created_epoch) end as updated_epoch from episodic group by identity_family, sha256(lower(content))""", E_)
def _(spark, d):
    e = P.episodic(spark, d).withColumn("body", F.sha2(F.lower("content"), 256))
    return m.merge_duplicates(e, ["identity_family", "body"], P.NOW).withColumn("tags", F.array_join("tags", ",")).select("identity_family", "body", "object_id", "reinforcement_count", "version", "tags", "updated_epoch")


@query("a02_upsert_curated", """select namespace, vault_path, case when number % 2 = 0 then 'insert' when number % 3 = 0 then 'noop' when number % 3 = 1 then 'update' else 'supersede' end as action,
  case when number % 2 = 1 and number % 3 = 2 then 'N' || object_id else object_id end as object_id, case when number % 2 = 1 and number % 3 = 1 then 2 else 1 end as version from curated where number % 5 <> 0
  union all select namespace, vault_path, 'keep', object_id, 1 from curated where number % 5 = 0 and number % 2 = 1""", K_)
def _(spark, d):
    k, n = P.curated(spark, d), F.col("number")
    new = k.filter(n % 5 != 0).withColumn("body_hash", F.when(n % 3 == 0, F.col("body_hash")).otherwise(F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("#")), 256)))
    new = new.withColumn("object_id", F.when((n % 2 == 1) & (n % 3 == 2), F.concat(F.lit("N"), "object_id")).otherwise(F.col("object_id")))
    return m.upsert_curated(new, k.filter(n % 2 == 1)).select("namespace", "vault_path", "action", "object_id", "version")


def tagged(spark, d):
    cols = ["namespace", "identity_family", "state", "object_id", "created_epoch"]
    return m.merge_planes({"episodic": P.episodic(spark, d).select(cols), "concept": P.concept(spark, d).select(cols), "curated": P.curated(spark, d).select(*cols, "vault_path"), "artifact": P.artifact(spark, d).select(cols)})


TAGGED = """tagged as (select 'episodic' as plane, namespace, identity_family, state, object_id, created_epoch, null as vault_path from episodic union all select 'concept', namespace, identity_family, state, object_id, created_epoch, null from concept
  union all select 'curated', namespace, identity_family, state, object_id, created_epoch, vault_path from curated union all select 'artifact', namespace, identity_family, state, object_id, created_epoch, null from artifact)"""
ALL = (*E_, *C_, *K_, *A_)


@query("a03_count_by_namespace", f"with {TAGGED} select namespace, plane, count(*) as n from tagged group by namespace, plane", ALL)
def _(spark, d):
    return m.count_by_namespace(tagged(spark, d))


@query("a03_count_rollup", f"with {TAGGED} select identity_family, plane, state, count(*) as n from tagged group by rollup(identity_family, plane, state)", ALL)
def _(spark, d):
    return m.count_rollup(tagged(spark, d))


@query("a04_capture_summary", f"""with {TAGGED} select p.plane, count(t.object_id) as n from (select unnest(['episodic', 'artifact', 'thought']) as plane) p
  left join tagged t on t.plane = p.plane and t.created_epoch >= 1704153600 and t.created_epoch < 1704240000 group by p.plane""", ALL)
def _(spark, d):
    return m.capture_summary(tagged(spark, d), ["episodic", "artifact", "thought"], 1704153600.0, 1704240000.0)


@query("a05_account_access", """select e.object_id, e.access_count + coalesce(h.n, 0) as access_count, case when h.at is null or h.at < e.before then e.before else h.at end as last_accessed_us
  from (select *, 1704067200000000 + number * 3600000000 as before from episodic) e left join
  (select 'D' || lpad(cast(user_id as varchar), 26, '0') as object_id, count(distinct event_id // 5) as n, max(epoch_us(ts)) as at from events where event_id % 3 <> 0 group by user_id) h on h.object_id = e.object_id""", E_)
def _(spark, d):
    ev = P.lifecycle_events(spark, d)
    rows = P.episodic(spark, d).withColumns({"plane": F.lit("episodic"), "last_accessed_epoch": (F.lit(P.EPOCH) + F.col("number") * 3600) * 1_000_000})
    plane = F.when(F.col("event_id") % 3 == 0, "artifact").otherwise("episodic")
    delivered = ev.select("object_id", F.floor(F.col("event_id") / 5).alias("delivery_id"), F.col("occurred_us").alias("delivered_epoch"), plane.alias("plane"))
    delivered = delivered.join(rows.select("object_id", "namespace"), "object_id")
    return m.account_access(delivered, rows).select("object_id", "access_count", F.col("last_accessed_epoch").alias("last_accessed_us"))


@query("a06_reinforce_concepts", """select c.object_id, c.reinforcement_count + coalesce(v.n, 0) as reinforcement_count, len(c.merged_from) + coalesce(v.fresh, 0) as n_sources, case when v.n is null then c.last_reinforced_epoch else 1714521600.0 end as last_reinforced_epoch
  from concept c left join (select 'C' || lpad(cast(number - number % 5 as varchar), 26, '0') as object_id, count(*) as n, count(*) filter (where number % 5 > 2) as fresh from episodic where number % 3 = 0 group by number - number % 5) v on v.object_id = c.object_id""", (*C_, *E_))
def _(spark, d):
    n = F.col("number")
    evidence = P.episodic(spark, d).filter(n % 3 == 0).select(P.key("C", n - n % 5).alias("object_id"), F.col("object_id").alias("source_id"))
    return m.reinforce_concepts(P.concept(spark, d), evidence, P.NOW).select("object_id", "reinforcement_count", F.size("merged_from").alias("n_sources"), "last_reinforced_epoch")


@query("a07_record_rejections", """select c.object_id, c.promotion_attempts + case when c.promoted_to is null then coalesce(r.n, 0) else 0 end as promotion_attempts, case when c.promoted_to is null and r.at is not null then r.at else c.number end as rejected_us from concept c left join
  (select 'C' || lpad(cast(user_id as varchar), 26, '0') as object_id, count(*) as n, max(epoch_us(ts)) as at from events where event_id % 4 <> 0 group by user_id) r on r.object_id = c.object_id""", C_)
def _(spark, d):
    ev = P.lifecycle_events(spark, d)
    rejections = ev.select(F.concat(F.lit("C"), F.substring("object_id", 2, 26)).alias("object_id"), F.col("occurred_us").alias("rejected_epoch"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("reason")).alias("reason"))
    before = P.concept(spark, d).withColumns({"rejected_epoch": F.col("number"), "rejected_reason": F.lit("before")})
    return m.record_rejections(before, rejections).select("object_id", "promotion_attempts", F.col("rejected_epoch").alias("rejected_us"))


@query("a08_mark_read", """select object_id, array_to_string(list_sort(list_distinct(list_concat(read_by, r))), ',') as read_by, list_contains(list_concat(read_by, r), to_presence) as read,
  1 + case when len(list_distinct(list_concat(read_by, r))) > len(read_by) then 1 else 0 end as version from (select *, case when length(content) % 2 = 0 then ['user', 'watcher'] else cast([] as varchar[]) end as r from thought) t""", T_)
def _(spark, d):
    t = P.thought(spark, d)
    reads = t.filter(F.length("content") % 2 == 0).select("object_id", F.explode(F.array(F.lit("user"), F.lit("watcher"), F.lit("user"))).alias("reader"))
    return m.mark_read(t, reads).select("object_id", F.array_join(F.array_sort("read_by"), ",").alias("read_by"), "read", "version")


@query("a09_link_contradictions", """with v as (select 'C' || lpad(cast(number as varchar), 26, '0') as a, 'C' || lpad(cast(number + 10 as varchar), 26, '0') as b from concept where number % 15 = 0),
  o as (select a as object_id, b as other from v union select b, a from v)
  select c.object_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(any_value(c.contradicts), list(o.other) filter (where o.other is not null)))), ','), array_to_string(any_value(c.contradicts), ',')) as contradicts from concept c left join o on o.object_id = c.object_id group by c.object_id""", C_)
def _(spark, d):
    c, n = P.concept(spark, d), F.col("number")
    verdicts = c.select(F.col("object_id").alias("a"), P.key("C", n + 10).alias("b"), F.when(n % 15 == 0, "contradictory").otherwise("consistent").alias("verdict"))
    return m.link_contradictions(c, verdicts).select("object_id", F.array_join(F.array_sort("contradicts"), ",").alias("contradicts"))


@query("a10_synthesis_report", "select identity_family, count(*) filter (where state = 'synthesized') as created, count(*) filter (where reinforcement_count >= 3) as reinforced, count(*) filter (where len(contradicts) > 0) as contradicted from concept group by identity_family", C_)
def _(spark, d):
    return m.report(P.concept(spark, d), ["identity_family"], {"created": F.col("state") == "synthesized", "reinforced": F.col("reinforcement_count") >= 3, "contradicted": F.size("contradicts") > 0})


@query("a11_sweep_report", "select count(*) as selected, count(*) filter (where state = 'matured') as transitioned, count(*) filter (where state = 'demoted') as failed from episodic", E_)
def _(spark, d):
    return m.report(P.episodic(spark, d), [], {"selected": F.lit(True), "transitioned": F.col("state") == "matured", "failed": F.col("state") == "demoted"})


@query("a12_patch_rows", """select object_id, case when number % 3 = 0 then array_to_string(list_sort(list_distinct(list_concat(tags, ['a', 'z']))), ',') when number % 3 = 1 then 'a,z' else array_to_string(tags, ',') end as tags,
  case when number % 3 = 0 then 10 else importance end as importance from episodic""", E_)
def _(spark, d):
    e, n = P.episodic(spark, d), F.col("number")
    patches = e.filter(n % 3 < 2).select("object_id", F.array(F.lit("a"), F.lit("z")).alias("tags"), F.when(n % 3 == 0, "merge").otherwise("replace").alias("tag_mode"), F.when(n % 3 == 0, F.lit(10)).alias("importance"))
    return m.patch_rows(e, patches).select("object_id", F.array_join("tags", ",").alias("tags"), "importance")


@query("a13_merge_planes", f"with {TAGGED} select plane, object_id, vault_path from tagged", ALL)
def _(spark, d):
    return tagged(spark, d).select("plane", "object_id", "vault_path")
