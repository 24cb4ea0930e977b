"""Streams' batch twins, sources and sinks, and whole retrieval jobs over the planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import ranking as r
from memlake.plans import retrieval, synthesis
from memlake.queries.registry import STRIPPED, query
from memlake.queries.searching import BM25, HITS, POSTINGS, VECTORS, hits, vector_queries, vectors, word_vectors
from memlake.sources import exchange as x, notes
from memlake.sources import planes as P
from memlake.streaming import jobs

E_, C_, K_, T_, L_ = ("episodic",), ("concept",), ("curated",), ("thought",), ("lifecycle_events",)


def requests(spark, d):
    ev = P.read_table(spark, d, "events")
    return ev.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("token"), F.col("event_type").alias("bucket"), (F.col("user_id") % 50 == 0).alias("operator"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("ts").cast("timestamp").alias("ts"), F.round("value", 0).cast("string").alias("body"))


@query("s01_idempotent_capture")
def _(spark, d):
    return jobs.idempotent_capture(requests(spark, d), ["token", "bucket"])


@query("s02_deliver_thoughts", "select object_id, namespace || '-all' as subscription_id from thought where to_presence = 'all'", T_)
def _(spark, d):
    t = P.thought(spark, d)
    subs = t.select("namespace").distinct().select(F.concat("namespace", F.lit("-all")).alias("subscription_id"), "namespace", F.array(F.lit("all")).alias("includes"))
    return jobs.deliver_thoughts(t, subs).select("object_id", "subscription_id")


@query("s03_replay_since", """with a as (select *, row_number() over (order by object_id) as place, count(*) over () > 50 as truncated from thought where object_id > 'T00000000000000000050000000' and to_presence in ('user', 'all') and created_epoch >= 1704067200)
  select object_id, place, truncated from a where place <= 50""", T_)
def _(spark, d):
    return jobs.replay_since(P.thought(spark, d), "T00000000000000000050000000", 1704067200.0, ["user", "all"], 50).select("object_id", "place", "truncated")


@query("s04_rate_limit")
def _(spark, d):
    return jobs.rate_limit(requests(spark, d), window_us=20 * jobs.DAY_US)


@query("s05_tumbling_usage", "select epoch_us(date_trunc('minute', ts)) as minute_us, 'u' || cast(user_id as varchar) as token, event_type as bucket, count(*) as n from events group by date_trunc('minute', ts), user_id, event_type")
def _(spark, d):
    return jobs.tumbling_usage(requests(spark, d)).select(F.unix_micros("minute").alias("minute_us"), "token", "bucket", "n")


@query("s06_debounce_changes", """with g as (select event_id, user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 7200000000 then 0 else 1 end as fresh from events),
  s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from g) select 'p' || cast(user_id as varchar) as path, arg_max(event_id, (epoch_us(ts) - 1704067200000000) * 100000 + event_id) as event_id, count(*) as n from s group by user_id, session""")
def _(spark, d):
    changes = P.read_table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.debounce_changes(changes, quiet="2 hours")


@query("s07_incremental_cursor", """select lang as family, greatest(max(1704067200 + doc_id * 3600 + doc_id % 7 * 86400), case when lang = 'fr' then 0 else 1706000000 end) as cursor, count(*) filter (where 1704067200 + doc_id * 3600 + doc_id % 7 * 86400 > 1706000000 or lang = 'fr') as fresh from documents group by lang""")
def _(spark, d):
    e = P.episodic(spark, d).withColumn("family", F.col("identity_family"))
    cursors = e.select("family").distinct().filter("family <> 'fr'").withColumn("cursor", F.lit(1706000000.0))
    new, marks = jobs.after_cursor(e, cursors)
    fresh = new.groupBy("family").agg(F.count(F.lit(1)).alias("fresh"))
    return marks.join(fresh, "family", "left").select("family", F.col("cursor").cast("long").alias("cursor"), F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query("s09_split_late", "select event_id, case when event_id % 10 = 0 and epoch_us(ts) - 864000000000 < 1705000000000000 or epoch_us(ts) < 1705000000000000 then 'late' else 'in time' end as side from events")
def _(spark, d):
    rows = requests(spark, d).withColumn("event_epoch", (F.col("at_us") - F.when(F.col("event_id") % 10 == 0, 864000000000).otherwise(0)) / 1e6)
    good, late = jobs.split_late(rows, 1705000000.0)
    return good.select("event_id", F.lit("in time").alias("side")).unionByName(late.select("event_id", F.lit("late").alias("side")))


@query("io04_frontmatter_to_curated", """select vault_path as path, importance, 'a-b' as tags, case when number % 5 = 0 then 'unknown_key' when number % 3 = 0 then 'naive_time' when length(trim(title, ' ')) = 0 then 'bad_title' end as reason from curated""", K_)
def _(spark, d):
    k, n = P.curated(spark, d), F.col("number")
    fields = F.map_concat(
        F.create_map(F.lit("title"), F.col("title"), F.lit("importance"), F.col("importance").cast("string"), F.lit("tags"), F.lit('["A b", "a b"]'), F.lit("created_at"), F.when(n % 3 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z")),
        F.when(n % 5 == 0, F.create_map(F.lit("odd"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    out = x.frontmatter_to_curated(k.select(F.col("vault_path").alias("path"), fields.alias("fields"), F.col("content").alias("body"), "body_hash"))
    return out.select("path", "importance", F.array_join("tags", ",").alias("tags"), "reason")


@query("io05_render_note", f"""select object_id, sha256('---' || chr(10) || 'object_id: "' || object_id || '"' || chr(10) || 'title: "t"' || chr(10) || 'namespace: "' || namespace || '"' || chr(10) || 'importance: ' || importance || chr(10) || 'topics: ["' || topics[1] || '"]'
  || chr(10) || '---' || chr(10) || chr(10) || {STRIPPED.format('content').removeprefix('sha256(')} as note_sha256 from concept""", C_)
def _(spark, d):
    c = P.concept(spark, d)
    out = x.render_note(c.select(F.col("object_id").alias("path"), "object_id", F.lit("t").alias("title"), "namespace", "importance", "topics", F.col("content").alias("body")))
    return out.select(F.col("path").alias("object_id"), F.sha2("value", 256).alias("note_sha256"))


@query("io06_append_events", "select event_id, strftime(ts, '%Y-%m-%d') as event_date from events where event_id % 3 <> 0")
def _(spark, d):
    ev = P.lifecycle_events(spark, d)
    return x.append_events(ev.unionByName(ev), ev.filter("event_id % 3 = 0")).select("event_id", F.col("event_date").cast("string").alias("event_date"))


@query("io07_verify_manifest", "select filename as path, case when number % 4 = 1 then 'missing' when number % 4 = 2 then 'extra' else 'drift' end as problem from artifact where number % 4 > 0", ("artifact",))
def _(spark, d):
    """Pages of one address are files of their own, each in a folder by its id."""
    n = F.col("number")
    a = P.artifact(spark, d).withColumn("path", F.concat_ws("/", "object_id", "filename"))
    changed = F.sha2(F.coalesce("sha256", F.lit("")), 256)
    found = a.filter(n % 4 != 1).select("path", F.when(n % 4 == 3, changed).otherwise(F.col("sha256")).alias("sha256"))
    out = notes.verify_manifest(found, a.filter(n % 4 != 2).select("path", "sha256"))
    return out.select(F.regexp_replace("path", "^[^/]*/", "").alias("path"), "problem")


@query("io08_migrate_memories", """select cast(doc_id as varchar) as object_id, 'old/legacy/episodic' as namespace, 'migrated from ' || case when doc_id % 2 = 0 then source else 'legacy' end as source_context, 1704067200.0 + doc_id % 28 * 86400 as created_epoch
  from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0""")
def _(spark, d):
    old = legacy(spark, d)
    return x.migrate_memories(old, old.filter("cast(id as bigint) % 7 = 0"), "old/legacy/episodic").select("object_id", "namespace", "source_context", "created_epoch")


def legacy(spark, d):
    n = F.col("doc_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))
    return P.read_table(spark, d, "documents").select(n.cast("string").alias("id"), F.col("text").alias("content"), F.lit("note").alias("type"), F.when(n % 2 == 0, F.col("source")).alias("agent"), F.lit(None).cast("string").alias("context"), F.when(n % 5 != 0, day).alias("created_at"))


@query("io08_migration_report", "select case when doc_id % 5 = 0 then 'no creation time' when doc_id % 7 = 0 then 'migrated before' else 'migrated' end as outcome, count(*) as n from documents group by all")
def _(spark, d):
    old = legacy(spark, d)
    return x.migration_report(old, old.filter("cast(id as bigint) % 7 = 0"))


@query("io09_migrate_thoughts", "select object_id, case when to_presence = 'all' then 'broadcast' else to_presence end || '/legacy/thought' as namespace, from_presence, to_presence from thought", T_)
def _(spark, d):
    t = P.thought(spark, d).select(F.col("object_id").alias("id"), "from_presence", "to_presence", F.lit(False).alias("read"), "read_by")
    return x.migrate_thoughts(t).select("object_id", "namespace", "from_presence", "to_presence")


@query("io10_backfill_identity_family", "select identity_family, count(*) as n from episodic group by identity_family", E_)
def _(spark, d):
    e = P.episodic(spark, d).withColumn("identity_family", F.when(F.col("number") % 2 == 0, F.col("identity_family")))
    return x.backfill_identity_family(e).groupBy("identity_family").agg(F.count(F.lit(1)).alias("n"))


def searchable(spark, d):
    """All memories with scoring columns, with a vector where there is one, the words of their texts,
    and the stated queries. Every tenth memory is superseded by the one thirty ids on."""
    n = F.col("number")
    e = P.episodic(spark, d).drop("namespace", "tags", "topics").withColumn("plane", F.when(n % 3 == 0, "curated").otherwise("episodic"))
    e = e.withColumns({"promoted_to": F.lit(None).cast("string"), "promoted_from": P.key("C", n + 1), "superseded_by": F.when(n % 10 == 7, P.key("D", n + 30))})
    v = vectors(spark, d).select("object_id", "namespace", "vector")
    rows = e.join(v, "object_id", "left").withColumn("namespace", F.coalesce("namespace", F.concat(F.lit("ns"), n % 2)))
    p = word_vectors(spark, d).drop("namespace").join(rows.select("object_id", "namespace"), "object_id")
    q = vector_queries(spark, d).withColumn("query_text", F.lit("q"))
    asked = word_vectors(spark, d, "doc_id % 100 = 0").drop("namespace")
    terms = asked.withColumnRenamed("number", "query_id").join(q.select("query_id", "namespace"), "query_id")
    return q, terms.select("query_id", "namespace", "terms", "weights"), rows, p.select("object_id", "namespace", "terms", "weights")


RETRIEVAL = f"""{VECTORS}, {POSTINGS}, spaces as (select e.object_id, e.number, coalesce(v.namespace, 'ns' || cast(e.number % 2 as varchar)) as namespace, v.vector from episodic e left join vectors v on v.object_id = e.object_id),
  shown as (select s.object_id, s.namespace, s.vector, s.number, e.* exclude (object_id, namespace, number), case when s.number % 3 = 0 then 'curated' else 'episodic' end as plane
    from spaces s join episodic e on e.object_id = s.object_id where e.state in ('matured', 'promoted')
    and (s.number % 3 <> 0 or ((e.valid_from_epoch is null or e.valid_from_epoch <= 1714521600) and (e.valid_until_epoch is null or e.valid_until_epoch > 1714521600)))),
  dense as (select q.number as query_id, x.object_id, row_number() over (partition by q.number order by list_cosine_similarity(q.vector, x.vector) desc, x.object_id) as rank
    from vectors q join shown x on x.namespace = q.namespace where q.number % 100 = 0 and x.vector is not null),
  words as (select p.object_id, p.number, s.namespace, p.term, p.weight from postings p join spaces s on s.object_id = p.object_id),
  dots as (select q.number as query_id, p.object_id, round(sum(p.weight * q.weight), 9) as score from words p join words q on q.namespace = p.namespace and q.term = p.term
    where q.number % 100 = 0 and q.number in (select number from vectors) and p.object_id in (select object_id from shown) group by q.number, p.object_id),
  sparse as (select query_id, object_id, row_number() over (partition by query_id order by score desc, object_id) as rank from dots),
  fused as (select query_id, object_id, sum(1.0 / (60 + rank)) as rrf_score from (select * from dense where rank <= PREFETCH union all select * from sparse where rank <= PREFETCH) u group by query_id, object_id),
  found as (select *, row_number() over (partition by query_id order by round(rrf_score, 12) desc, object_id) as rank from fused)"""
@query("r05_hybrid_search", f"with {RETRIEVAL.replace('PREFETCH', '50')} select query_id, object_id, rank, round(rrf_score, 6) as rrf_score from found where rank <= 10", E_)
def _(spark, d):
    return retrieval.hybrid_search(*searchable(spark, d), limit=10, now=P.NOW).select("query_id", "object_id", "rank", F.round("rrf_score", 6).alias("rrf_score"))


@query("r06_fast_retrieve")
def _(spark, d):
    return retrieval.fast_retrieve(*searchable(spark, d), limit=10, now=P.NOW).select("query_id", "object_id", "rank", F.round("score", 6).alias("score"))


@query("r08_deep_retrieve")
def _(spark, d):
    """With the lineage of the hits, in the namespaces of the rows."""
    q, terms, rows, p = searchable(spark, d)
    spaces, n = rows.select("number", "namespace"), F.col("number")
    planes = {x: rows.filter(F.col("plane") == x) for x in ("episodic", "curated")}
    planes["concept"] = P.concept(spark, d).drop("namespace").join(spaces, "number")
    planes["artifact"] = P.artifact(spark, d).withColumn("namespace", F.concat(F.lit("ns"), n % 2))
    out = retrieval.deep_retrieve(q, terms, rows, p, limit=10, now=P.NOW, scorer=lambda q, t: (F.length(t) % 7 - 3).cast("double"), lineage=planes)
    return out.select("query_id", "object_id", "rank", F.round("score", 6).alias("score"), "tip", "promoted_from_title", F.array_join("files", ",").alias("files"), F.array_join("supersedes", ",").alias("supersedes"))


@query("r10_blended_retrieve", f"""with {HITS.format(leg='')}, one as (select *, row_number() over (partition by query_id, sha256(substr(content, 1, 300)) order by case when plane = 'curated' then 4 when plane = 'concept' then 3 when state = 'matured' then 2 when state = 'provisional' then 1 else 0 end desc, score desc, object_id) as k
    from (select * from (select *, row_number() over (partition by query_id, plane order by score desc, object_id) as leg_rank from scored) s where leg_rank <= 40) l)
  select query_id, object_id, rank from (select query_id, object_id, row_number() over (partition by query_id order by score desc, object_id, plane) as rank from one where k = 1) t where rank <= 20""", (*E_, *C_, *K_))
def _(spark, d):
    none = F.lit(None).cast("string")
    scored = r.score_hits(hits(spark, d), P.NOW).withColumns({"promoted_to": none, "superseded_by": none})
    return retrieval.blended_retrieve([scored.filter(F.col("plane") == p) for p in ("episodic", "concept", "curated")], 20).select("query_id", "object_id", "rank")


def blended_vectors(spark, d):
    """All memories, concepts and notes, with vectors (T-17 where there is none), tags and lineage,
    and every hundredth document as a query of its language's blended namespace, or of its own. The
    texts' hashes are taken and the vectors made before rows are dealt, so texts stay where they are."""
    n, none = F.col("number"), F.lit(None).cast("string")
    columns = ["object_id", "plane", "namespace", "number", "state", "content", "tags", "vector", "updated_epoch", "importance", "reinforcement_count", "access_count", "valid_from_epoch", "valid_until_epoch", "promoted_to", "superseded_by"]
    tags, later = F.array(F.concat(F.lit("g"), n % 5)), F.when(n % 3 == 0, P.key("D", n + 20))
    e = P.episodic(spark, d).withColumns({"plane": F.lit("episodic"), "promoted_to": none, "superseded_by": later, "tags": tags})
    c = P.concept(spark, d).withColumns({"plane": F.lit("concept"), "access_count": F.col("promotion_attempts"), "valid_from_epoch": F.lit(None).cast("double"), "valid_until_epoch": F.lit(None).cast("double"), "superseded_by": none, "tags": tags, "content": F.concat(F.lit("Concept: "), "content")})
    k = P.curated(spark, d).withColumns({"plane": F.lit("curated"), "reinforcement_count": F.lit(0), "access_count": F.lit(3), "promoted_to": none, "superseded_by": none, "tags": tags})
    every = None
    for one in (e, c, k):
        one = one.withColumn("namespace", F.replace("namespace", F.lit("/shared/"), F.lit("/_shared/"))).select([c for c in columns if c != "vector"])
        every = one if every is None else every.unionByName(one)
    every = every.withColumn("content_hash", r.content_hash())
    shown = every.select("number", "object_id", "namespace", *retrieval.VISIBLE)
    every = embedded(spark, d, every).select(*columns, "content_hash")
    docs = embedded(spark, d, P.episodic(spark, d).filter(n % 100 == 0))
    asked = docs.select(n.alias("query_id"), F.when(n % 200 == 0, F.concat("identity_family", F.lit("/blended"))).otherwise(F.col("namespace")).alias("namespace"), "vector")
    words = word_vectors(spark, d).drop("object_id", "namespace")
    terms = word_vectors(spark, d, "doc_id % 100 = 0").withColumnRenamed("number", "query_id").select("query_id", "terms", "weights")
    return asked, terms, every, words.join(shown, "number").drop("number")


def blended_inputs(spark, d):
    """The same, with a row per term."""
    asked, terms, every, words = blended_vectors(spark, d)
    terms, words = (df.withColumn("x", F.explode(F.arrays_zip("terms", "weights"))).select(*(c for c in df.columns if c not in ("terms", "weights")), F.col("x.terms").alias("term"), F.col("x.weights").alias("weight")) for df in (terms, words))
    return asked, terms, every, words


@query("r10_blended_search")
def _(spark, d):
    out = retrieval.blended_search(*blended_vectors(spark, d), ("curated", "concept", "episodic"), ("src0", "src3", "src10"), 10, P.NOW, texts=False)
    return out.select("query_id", "object_id", "plane", "rank", F.round("score", 6).alias("score"))


@query("r10_blended_search_deep")
def _(spark, d):
    out = retrieval.blended_search(*blended_vectors(spark, d), ("curated", "concept", "episodic"), ("src0", "src3", "src10"), 10, P.NOW, deep=True, texts=False)
    return out.select("query_id", "object_id", "plane", "rank", F.round("score", 6).alias("score"))


@query("r10_expand_namespaces", """with q as (select number as query_id, case when number % 2 = 0 then identity_family || '/blended' else namespace end as namespace, identity_family, split_part(namespace, '/', 2) as source from episodic)
  select query_id, 'curated' as plane, identity_family || case when query_id % 2 = 0 then '/_shared/curated' else '/' || source || '/curated' end as namespace from q
  union all select query_id, 'episodic', identity_family || '/' || p || '/episodic' from (select *, unnest(['desk', 'car']) as p from q where query_id % 2 = 0) t
  union all select query_id, 'episodic', identity_family || '/' || source || '/episodic' from q where query_id % 2 = 1""", E_)
def _(spark, d):
    e = P.episodic(spark, d)
    asked = F.when(F.col("number") % 2 == 0, F.concat("identity_family", F.lit("/blended"))).otherwise(F.col("namespace"))
    return retrieval.expand_namespaces(e.select(F.col("number").alias("query_id"), asked.alias("namespace")), ("curated", "episodic"), ("desk", "car"))


def lexical(spark, d):
    queries = P.read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("tokens"))
    rows = P.episodic(spark, d).withColumns({"plane": F.lit("episodic"), "tokens": T.tokenize(F.col("content"))})
    cols = ["object_id", "tokens", "plane", "state", "updated_epoch", "importance", "reinforcement_count", "access_count"]
    out = retrieval.lexical_top(queries, rows.filter(F.col("state").isin("matured", "promoted")).select(cols), P.NOW)
    return out.select("query_id", "object_id", "rank", F.round("bm25", 4).alias("bm25"), F.round("score", 6).alias("score"))


@query("flagship_lexical_retrieval", f"""with {BM25.replace("as tokens from episodic)", "as tokens from episodic where state in ('matured', 'promoted'))")},
  h as (select bm.query_id, bm.object_id, bm.bm25, round(bm.bm25, 9) as raw, e.* exclude (object_id) from bm join episodic e on e.object_id = bm.object_id),
  p as (select *, least(greatest(raw / max(raw) over (partition by query_id), 0), 1) as relevance, exp(-greatest(1714521600.0 - updated_epoch, 0) / 3600 * ln(2) / (30 * 24)) as recency,
    case when reinforcement_count > 0 then least(1, ln(1 + reinforcement_count) / ln(21)) else least(1, ln(1 + access_count) / ln(101)) end as reinforce from h),
  s as (select *, round(0.55 * relevance + 0.15 * recency + 0.10 * importance / 10.0 + 0.15 * 0.5 + 0.05 * reinforce, 12) as score from p)
  select query_id, object_id, rank, round(bm25, 4) as bm25, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, object_id) as rank from s) t where rank <= 10""", E_)
def _(spark, d):
    return lexical(spark, d)


@query("l17_retract")
def _(spark, d):
    """Every third request has more prose than a tombstone may have."""
    e = P.episodic(spark, d)
    truth = F.when(F.col("number") % 3 == 0, F.repeat(F.lit("true "), 7000)).otherwise(F.lit("it was not so"))
    requests = e.select("object_id", F.lit("2024-05-01").alias("asked_on"), F.lit("wrong é").alias("because"), truth.alias("truth"))
    stones, artifacts, refused = synthesis.retract(e, requests, P.NOW)
    done = stones.select("object_id", "evidence_id", "content", "kept_bytes", "omitted_bytes", F.lit("retracted").alias("outcome"))
    kept = artifacts.select(F.col("object_id").alias("evidence_id"), F.col("sha256").alias("kept_sha256"))
    return done.join(kept, "evidence_id").unionByName(refused.select("object_id", F.col("reason").alias("outcome")), allowMissingColumns=True)


def embedded(spark, d, rows):
    """Rows with a vector: that of the embeddings, else one of the hashed text (T-17)."""
    given = vectors(spark, d).select("number", F.col("vector").alias("given"))
    made = rows.withColumn("made", T.hash_embed(64)("content"))
    return made.join(given, "number", "left").withColumn("vector", F.coalesce("given", "made").cast("array<double>")).drop("given", "made")


def synthesis_inputs(spark, d):
    """All memories and concepts; every 97th memory doesn't decode."""
    n = F.col("number")
    rows = embedded(spark, d, P.episodic(spark, d).withColumn("family", F.col("identity_family")))
    rows = rows.withColumn("vector", F.when(n % 97 != 5, F.col("vector")))
    cursors = rows.select("family").distinct().withColumn("cursor", F.lit(0.0))
    pool = rows.filter("number % 50 = 0").select("family", "object_id", F.lit(P.NOW - 86400.0).alias("first_seen"), F.lit(1).alias("attempts"))
    concepts = P.concept(spark, d).withColumn("family", F.col("identity_family")).join(vectors(spark, d).select("number", F.col("vector").cast("array<double>").alias("vector")), "number", "left")
    return rows, cursors, pool, concepts


def fails_at_times(members):
    """A summariser that makes nothing of clusters whose first member's id ends in 3."""
    first, content, _ = members[0]
    return None if first.endswith("3") else (content[:10], content, f"{len(members)} members")


def synthesized(spark, d):
    out = synthesis_inputs(spark, d)
    return synthesis.synthesize(*out, P.NOW, lambda x, y: len(x) > len(y), threshold=0.30, low=0.30, match=0.37, summarizer=fails_at_times)


@query("l19_synthesize")
def _(spark, d):
    return synthesized(spark, d)["concepts"].select("object_id", "family", "state", "title", "importance", "reinforcement_count", "merged_from", "contradicts")


@query("l19_report")
def _(spark, d):
    return synthesized(spark, d)["report"]


@query("k01_score_importance", "select object_id, case when number % 4 = 0 then 10 else importance end as importance from episodic", E_)
def _(spark, d):
    from memlake.functions import models

    def scorer(rows):
        return {i: 99 for i, _, _ in rows if int(i[1:]) % 4 == 0}

    return models.score_importance(P.episodic(spark, d), scorer).select("object_id", "importance")


@query("k02_infer_topics", "select object_id, case when number % 2 = 0 then tags[1] else array_to_string(topics, ',') end as topics from episodic", E_)
def _(spark, d):
    from memlake.functions import models

    out = models.infer_topics(P.episodic(spark, d), lambda i, content, tags: [tags[0]] if int(i[1:]) % 2 == 0 else [])
    return out.select("object_id", F.array_join("topics", ",").alias("topics"))


@query("k04_judge_pairs", "select a.object_id as a, b.object_id as b, case when length(a.content) > length(b.content) then 'contradictory' else 'consistent' end as verdict from concept a join concept b on b.number = a.number + 5", C_)
def _(spark, d):
    from memlake.functions import models

    c = P.concept(spark, d).select("number", "object_id", "content")
    pairs = c.select("number", F.col("object_id").alias("a"), F.col("content").alias("text_a")).join(c.select((F.col("number") - 5).alias("number"), F.col("object_id").alias("b"), F.col("content").alias("text_b")), "number")
    return models.judge_pairs(pairs, lambda x, y: len(x) > len(y)).select("a", "b", "verdict")


@query("k05_render", "select object_id, '## ' || title || chr(10) || chr(10) || content as body from concept", C_)
def _(spark, d):
    from memlake.functions import models

    return models.render(P.concept(spark, d)).select("object_id", "body")


_MOVED = "list_concat([q.vector[1] + cast(q.number % 8 as double) / 10], q.vector[2:])"


@query("v13_near_duplicate_candidate", f"""with v as (select 'D' || lpad(cast(vec_id as varchar), 26, '0') as object_id, vec_id as number, 'ns' || cast(label % 2 as varchar) as namespace, cast(embedding as double[]) as vector, vec_id % 20 as content,
    'p' || cast(vec_id % 3 as varchar) as who from embeddings),
  q as (select number as query_id, namespace, {_MOVED} as vector, content, case when number % 15 = 0 then 'other' else who end as who from v q where number % 5 = 0),
  scored as (select q.query_id, x.object_id, list_cosine_similarity(q.vector, x.vector) as score, x.content = q.content and x.who = q.who as agrees from q join v x on x.namespace = q.namespace),
  best as (select *, row_number() over (partition by query_id order by score desc, object_id) as k from scored qualify k = 1)
  select query_id, case when score >= 0.92 and agrees then 'merge' else 'insert' end as action, case when score >= 0.92 then object_id end as object_id, case when score >= 0.92 then round(score, 6) end as score from best""")
def _(spark, d):
    """New captures are every fifth row, moved away from it by steps, some of other participants."""
    from memlake.operators import similarity as v

    n = F.col("number")
    rows = vectors(spark, d).withColumns({"vector": F.col("vector").cast("array<double>"), "content": n % 20, "who": F.concat(F.lit("p"), (n % 3).cast("string"))})
    moved = F.concat(F.array(F.element_at("vector", 1) + n % 8 / 10), F.slice("vector", 2, F.greatest(F.size("vector") - 1, F.lit(0))))
    new = rows.filter(n % 5 == 0).select(n.alias("query_id"), "namespace", moved.alias("vector"), "content", F.when(n % 15 == 0, "other").otherwise(F.col("who")).alias("who"))
    return v.duplicate_candidate(new, rows, "episodic", ["content", "who"]).withColumn("score", F.round("score", 6))


@query("v15_token_overlap", """with w as (select number, list_distinct(list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as words from episodic)
  select a.number, round(case when len(a.words) = 0 or len(b.words) = 0 then 0.0 else cast(len(list_intersect(a.words, b.words)) as double) / len(list_distinct(list_concat(a.words, b.words))) end, 6) as overlap from w a join w b on b.number = a.number + 1""", E_)
def _(spark, d):
    e = P.episodic(spark, d).select("number", "content")
    nxt = e.select((F.col("number") - 1).alias("number"), F.col("content").alias("other"))
    return e.join(nxt, "number").select("number", F.round(T.token_overlap(F.col("content"), F.col("other")), 6).alias("overlap"))


@query("j09_orphan_writes", "select vault_path as path from curated where number % 2 = 0 and number % 3 = 1 and created_epoch < 1714521600 - 300", K_)
def _(spark, d):
    from memlake.operators import joins

    k, n = P.curated(spark, d), F.col("number")
    writes = k.select(F.col("vault_path").alias("path"), F.col("body_hash").alias("file_hash"), (n % 2 == 1).alias("consumed"), F.col("created_epoch").alias("written_epoch"))
    changes = k.filter(n % 3 != 1).select(F.col("vault_path").alias("path"), F.col("body_hash").alias("file_hash"))
    return joins.orphan_writes(changes, writes, P.NOW).select("path")
