"""Similarity, ranking and retrieval over the planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import ranking as r, similarity as v
from memlake.operators.sparse import term_vectors
from memlake.queries.registry import query
from memlake.sources import planes as P

E_, C_, K_, T_ = ("episodic",), ("concept",), ("curated",), ("thought",)


def vectors(spark, d):
    """Rows with a vector: embeddings, in two namespaces by label."""
    e = P.read_table(spark, d, "embeddings")
    return e.select(P.key("D", F.col("vec_id")).alias("object_id"), F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")).alias("namespace"), F.col("vec_id").alias("number"), F.col("embedding").alias("vector"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("group"))


def vector_queries(spark, d):
    """The stated query set: every hundredth row, against all of its namespace."""
    return vectors(spark, d).filter(F.col("number") % 100 == 0).select(F.col("number").alias("query_id"), "namespace", "vector")


VECTORS = """vectors as (select 'D' || lpad(cast(vec_id as varchar), 26, '0') as object_id, 'ns' || cast(label % 2 as varchar) as namespace, vec_id as number, cast(embedding as double[]) as vector, 'l' || cast(label as varchar) as "group" from embeddings)"""


@query("v01_cosine", f"with {VECTORS} select a.number, round(list_cosine_similarity(a.vector, b.vector), 6) as cosine from vectors a join vectors b on b.number = a.number + 1")
def _(spark, d):
    a = vectors(spark, d)
    b = a.select((F.col("number") - 1).alias("number"), F.col("vector").alias("other"))
    return a.join(b, "number").select("number", F.round(T.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


@query("v02_dense_topk", f"""with {VECTORS} select query_id, object_id, rank, round(score, 6) as score from (select q.number as query_id, x.object_id, list_cosine_similarity(q.vector, x.vector) as score,
  row_number() over (partition by q.number order by list_cosine_similarity(q.vector, x.vector) desc, x.object_id) as rank from vectors q join vectors x on x.namespace = q.namespace where q.number % 100 = 0) t where rank <= 50""")
def _(spark, d):
    return v.dense_topk(vector_queries(spark, d), vectors(spark, d), 50).select("query_id", "object_id", "rank", F.round("score", 6).alias("score"))


def postings(spark, d):
    """Words of documents, by language, weighted 1 + ln(tf)."""
    docs = P.read_table(spark, d, "documents")
    words = docs.select("doc_id", F.col("lang").alias("namespace"), F.explode(F.split(F.lower("text"), " ")).alias("term")).filter("term <> ''")
    tf = words.groupBy("doc_id", "namespace", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("weight"))
    return tf.select(P.key("D", F.col("doc_id")).alias("object_id"), F.col("doc_id").alias("number"), "namespace", "term", "weight")


def word_vectors(spark, d, which="true"):
    """The same, a row per document, of some."""
    docs = P.read_table(spark, d, "documents").filter(which)
    return term_vectors(docs.select(P.key("D", F.col("doc_id")).alias("object_id"), F.col("doc_id").alias("number"), F.col("lang").alias("namespace"), "text"))


POSTINGS = """postings as (select 'D' || lpad(cast(doc_id as varchar), 26, '0') as object_id, doc_id as number, lang as namespace, term, 1 + ln(count(*)) as weight
  from (select doc_id, lang, unnest(string_split(lower(text), ' ')) as term from documents) t where term <> '' group by doc_id, lang, term)"""


@query("v03_sparse_topk", f"""with {POSTINGS} select query_id, object_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, object_id) as rank from (
  select q.number as query_id, p.object_id, round(sum(p.weight * q.weight), 9) as score from postings p join postings q on p.namespace = q.namespace and p.term = q.term where q.number % 100 = 0 group by q.number, p.object_id) t) u where rank <= 20""")
def _(spark, d):
    q = word_vectors(spark, d, "doc_id % 100 = 0").withColumnRenamed("number", "query_id")
    return v.sparse_topk(q, word_vectors(spark, d), 20).select("query_id", "object_id", "rank", F.round("score", 6).alias("score"))


def channels(spark, d):
    a = v.dense_topk(vector_queries(spark, d), vectors(spark, d), 20)
    e, n = P.episodic(spark, d), F.col("number")
    b = e.select((F.floor(n / 100) * 100).alias("query_id"), "object_id", (n % 100 + 1).alias("rank")).filter("rank <= 20")
    return a, b


CHANNELS = f"""{VECTORS}, c1 as (select query_id, object_id, rank from (select q.number as query_id, x.object_id, row_number() over (partition by q.number order by list_cosine_similarity(q.vector, x.vector) desc, x.object_id) as rank
  from vectors q join vectors x on x.namespace = q.namespace where q.number % 100 = 0) t where rank <= 20), c2 as (select number // 100 * 100 as query_id, object_id, number % 100 + 1 as rank from episodic where number % 100 < 20),
  fused as (select query_id, object_id, sum(1.0 / (60 + rank)) as rrf_score from (select * from c1 union all select * from c2) u group by query_id, object_id)"""


@query("v04_rrf", f"with {CHANNELS} select query_id, object_id, round(rrf_score, 6) as rrf_score from fused", E_)
def _(spark, d):
    return v.rrf(list(channels(spark, d))).withColumn("rrf_score", F.round("rrf_score", 6))


def bm25_inputs(spark, d):
    b = P.read_table(spark, d, "benchmark")
    queries = b.select(F.col("item_id").alias("query_id"), T.tokenize(F.col("text")).alias("tokens"))
    return queries, P.episodic(spark, d).select("object_id", T.tokenize(F.col("content")).alias("tokens"))


BM25 = """qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.+-]*')) as token from benchmark),
  wanted as (select query_id, token, count(*) as times from qt group by query_id, token),
  dt as (select object_id, regexp_extract_all(lower(content), '[a-z0-9][a-z0-9_.+-]*') as tokens from episodic),
  stats as (select count(*) as n_docs, greatest(avg(len(tokens)), 1.0) as mean_length from dt),
  tf as (select object_id, length, token, count(*) as tf from (select object_id, greatest(len(tokens), 1) as length, unnest(tokens) as token from dt) t where token in (select token from wanted) group by object_id, length, token),
  df as (select token, count(*) as df from tf group by token),
  bm as (select query_id, object_id, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) as bm25
    from tf join df using (token) join wanted using (token) cross join stats group by query_id, object_id)"""


@query("v05_bm25", f"with {BM25} select query_id, object_id, round(bm25, 4) as bm25 from bm", E_)
def _(spark, d):
    return v.bm25(*bm25_inputs(spark, d)).withColumn("bm25", F.round("bm25", 4))


PAIRS = """pairs as (select a."group", a.object_id as a, b.object_id as b, list_cosine_similarity(a.vector, b.vector) as cosine from vectors a join vectors b on a."group" = b."group" and a.object_id < b.object_id
  where list_cosine_similarity(a.vector, b.vector) >= 0.3)"""


@query("v07_similar_pairs", f'with {VECTORS}, {PAIRS} select "group", a, b, round(cosine, 6) as cosine from pairs')
def _(spark, d):
    return v.similar_pairs(vectors(spark, d), 0.3).withColumn("cosine", F.round("cosine", 6))


@query("v08_clusters", f"""with recursive {VECTORS}, {PAIRS}, edges as (select "group", a, b from pairs union all select "group", b, a from pairs),
  walk as (select "group", a as node, a as root from edges union select w."group", e.b, w.root from walk w join edges e on e."group" = w."group" and e.a = w.node),
  labels as (select "group", node as object_id, min(root) as cluster from walk group by "group", node)
  select "group", cluster, object_id from labels l where (select count(*) from labels m where m."group" = l."group" and m.cluster = l.cluster) >= 3""")
def _(spark, d):
    return v.clusters(v.similar_pairs(vectors(spark, d), 0.3, forest=True))


@query("v09_cluster_groups", """select object_id, unnest(case when len(topics) > 0 then topics else tags end) as "group" from episodic""", E_)
def _(spark, d):
    return v.cluster_groups(P.episodic(spark, d)).select("object_id", "group")


@query("v10_cap_cluster", """select cluster, object_id, place from (select identity_family as cluster, object_id, row_number() over (partition by identity_family order by importance desc, object_id) as place from episodic) t where place <= 20""", E_)
def _(spark, d):
    e = P.episodic(spark, d).withColumns({"group": F.lit("g"), "cluster": F.col("identity_family")})
    return v.cap_cluster(e).select("cluster", "object_id", "place")


@query("v11_best_match", f"""with {VECTORS}, best as (select query_id, object_id, score from (select q.number as query_id, x.object_id, list_cosine_similarity(q.vector, x.vector) as score,
  row_number() over (partition by q.number order by list_cosine_similarity(q.vector, x.vector) desc, x.object_id) as k from vectors q join vectors x on x.namespace = q.namespace and x.number % 100 <> 0 where q.number % 100 = 0) t where k = 1 and score >= 0.3)
  select q.number as query_id, b.object_id, round(b.score, 6) as score from vectors q left join best b on b.query_id = q.number where q.number % 100 = 0""")
def _(spark, d):
    x = vectors(spark, d)
    return v.best_match(vector_queries(spark, d), x.filter(F.col("number") % 100 != 0), 0.3).withColumn("score", F.round("score", 6))


@query("v12_contradiction_candidates", f'with {VECTORS}, {PAIRS} select a, b from pairs where cosine < 0.37')
def _(spark, d):
    return v.similar_pairs(vectors(spark, d), 0.3, 0.37).select("a", "b")


@query("v16_max_pool_sparse", f"with {POSTINGS} select namespace as object_id, term, round(max(weight), 6) as weight from postings group by namespace, term")
def _(spark, d):
    return v.max_pool_sparse(postings(spark, d).withColumn("object_id", F.col("namespace"))).withColumn("weight", F.round("weight", 6))


@query("v17_supersession_candidate", f"""with {VECTORS}, near as (select n.object_id, m.object_id as candidate, list_cosine_similarity(n.vector, m.vector) as score from vectors n join vectors m on m.namespace = n.namespace and m.number % 7 = n.number % 7 and m.number % 4 <> 0 and n.number % 4 = 0
  where list_cosine_similarity(n.vector, m.vector) >= 0.3) select object_id, min(candidate) as candidate from near group by object_id having count(*) = 1""")
def _(spark, d):
    x = vectors(spark, d).withColumn("topics", F.array(F.concat(F.lit("t"), (F.col("number") % 7).cast("string"))))
    n = F.col("number")
    return v.supersession_candidate(x.filter(n % 4 == 0), x.filter(n % 4 != 0), 0.3).select("object_id", "candidate")


@query("v18_cross_plane_max", """select query_id, object_id, round(max(score), 6) as score, case when count(distinct plane) = 2 then 'curated,episodic' else max(plane) end as planes from (
  select number % 10 as query_id, number as object_id, 'episodic' as plane, importance * 0.8 as score from episodic union all select number % 10, number, 'curated', importance * 1.0 from curated) t group by query_id, object_id""", (*E_, *K_))
def _(spark, d):
    legs = [df.select((F.col("number") % 10).alias("query_id"), F.col("number").alias("object_id"), F.lit(p).alias("plane"), F.col("importance").cast("double").alias("score")) for p, df in (("episodic", P.episodic(spark, d)), ("curated", P.curated(spark, d)))]
    return v.cross_plane_max(legs[0].unionByName(legs[1]), {"episodic": 0.8, "curated": 1.0}).select("query_id", "object_id", F.round("score", 6).alias("score"), F.array_join("planes", ",").alias("planes"))


def hits(spark, d):
    """Hits of ten queries over three planes."""
    n = F.col("number")
    cols = ["object_id", "state", "updated_epoch", "importance", "reinforcement_count", "access_count", "number", "content"]
    e = P.episodic(spark, d).select(*cols).withColumn("plane", F.lit("episodic"))
    c = P.concept(spark, d).withColumn("access_count", F.col("promotion_attempts")).select(*cols).withColumn("plane", F.lit("concept"))
    k = P.curated(spark, d).withColumns({"reinforcement_count": F.lit(0), "access_count": F.lit(3)}).select(*cols).withColumn("plane", F.lit("curated"))
    every = e.unionByName(c).unionByName(k)
    return every.select("*", (n % 10).alias("query_id"), ((n * 37 % 101) / 1000.0).alias("rrf_score"), F.when(n % 6 == 0, (n % 13 - 6) / 2.0).alias("rerank_score"))


HITS = """every as (select object_id, state, updated_epoch, importance, reinforcement_count, access_count, number, content, 'episodic' as plane from episodic
    union all select object_id, state, updated_epoch, importance, reinforcement_count, promotion_attempts, number, content, 'concept' from concept union all select object_id, state, updated_epoch, importance, 0, 3, number, content, 'curated' from curated),
  hits as (select *, number % 10 as query_id, (number * 37 % 101) / 1000.0 as rrf_score, case when number % 6 = 0 then (number % 13 - 6) / 2.0 end as rerank_score from every),
  best as (select *, max(rrf_score) over (partition by query_id{leg}) as top from hits),
  parts as (select *, case when rerank_score is not null then 1 / (1 + exp(-rerank_score)) when top <= 0 then 0 else least(greatest(rrf_score / top, 0), 1) end as relevance,
    exp(-greatest(1714521600.0 - updated_epoch, 0) / 3600 * ln(2) / (case when plane = 'curated' then 180 else 30 end * 24)) as recency, least(greatest(importance, 1), 10) / 10.0 as importance_part,
    case plane || '/' || state when 'curated/matured' then 1.0 when 'curated/superseded' then 0.6 when 'concept/promoted' then 0.9 when 'concept/matured' then 0.6 when 'concept/synthesized' then 0.35 when 'episodic/matured' then 0.5 when 'episodic/provisional' then 0.2 else 0.1 end as provenance,
    case when reinforcement_count > 0 then least(1, ln(1 + reinforcement_count) / ln(21)) else least(1, ln(1 + access_count) / ln(101)) end as reinforce from best),
  scored as (select *, round(0.55 * relevance + 0.15 * recency + 0.10 * importance_part + 0.15 * provenance + 0.05 * reinforce, 12) as score from parts)"""
ALL = (*E_, *C_, *K_)


@query("r01_score_hits", f"with {HITS.format(leg='')} select object_id, plane, round(relevance, 6) as relevance, round(recency, 6) as recency, importance_part, provenance, round(reinforce, 6) as reinforce, round(score, 6) as score from scored", ALL)
def _(spark, d):
    s = r.score_hits(hits(spark, d), P.NOW)
    return s.select("object_id", "plane", *(F.round(c, 6).alias(c) for c in ("relevance", "recency")), "importance_part", "provenance", F.round("reinforce", 6).alias("reinforce"), F.round("score", 6).alias("score"))


@query("r02_rank_hits", f"with {HITS.format(leg='')} select query_id, object_id, row_number() over (partition by query_id order by score desc, object_id, plane) as rank from scored", ALL)
def _(spark, d):
    return r.rank_hits(r.score_hits(hits(spark, d), P.NOW)).select("query_id", "object_id", "rank")


@query("r04_merge_cross_plane", f"""with {HITS.format(leg=', plane')}, again as (select *, max(rrf_score) over (partition by query_id) as over_all from scored),
  cal as (select *, round(score + 0.55 * (case when rerank_score is not null then relevance else least(greatest(rrf_score / over_all, 0), 1) end - relevance), 12) as final from again),
  one as (select *, row_number() over (partition by query_id, number order by final desc, plane) as k from cal)
  select query_id, number, plane, rank, round(final, 6) as score from (select *, row_number() over (partition by query_id order by final desc, number, plane) as rank from one where k = 1) t where rank <= 25""", ALL)
def _(spark, d):
    from pyspark.sql import Window

    leg = F.max("rrf_score").over(Window.partitionBy("query_id", "plane"))
    h = hits(spark, d).withColumn("object_id", F.col("number"))
    out = r.merge_cross_plane(r.score_hits(h, P.NOW, leg), 25)
    return out.select("query_id", "number", "plane", "rank", F.round("score", 6).alias("score"))


@query("r07_rerank", """with h as (select case when number % 40 < 30 then number // 40 else -1 - number // 4 end as query_id, object_id, (number * 37 % 101) / 1000.0 as rrf_score, content from episodic),
  s as (select *, case when count(*) over (partition by query_id) > 5 then length(substr(content, 1, 2048)) % 97 end as rr from h)
  select query_id, object_id, rank from (select *, row_number() over (partition by query_id order by rr desc nulls last, rrf_score desc, object_id) as rank from s) t where rank <= 5""", E_)
def _(spark, d):
    n = F.col("number")
    asked = F.when(n % 40 < 30, F.floor(n / 40)).otherwise(-1 - F.floor(n / 4))  # some queries have few hits
    h = P.episodic(spark, d).select(asked.alias("query_id"), "object_id", "title", "content", ((n * 37 % 101) / 1000.0).alias("rrf_score"), F.lit("q").alias("query_text"))
    return r.rerank(h, lambda q, t: (F.length(t) % 97).cast("double"), 5).select("query_id", "object_id", "rank")


@query("r09_recent_retrieve", """with q as (select namespace, min(number) as query_id from episodic group by namespace)
  select query_id, object_id, rank from (select q.query_id, e.object_id, row_number() over (partition by q.query_id order by e.created_epoch desc, e.object_id) as rank from episodic e join q on q.namespace = e.namespace
  where e.state in ('provisional', 'matured', 'promoted') and e.created_epoch >= 1705000000 and list_contains(e.tags, split_part(e.namespace, '/', 2))) t where rank <= 5""", E_)
def _(spark, d):
    e = P.episodic(spark, d).withColumn("plane", F.lit("episodic"))
    q = e.groupBy("namespace").agg(F.min("number").alias("query_id")).select("query_id", "namespace", F.lit(1705000000.0).alias("since"), F.array(F.split("namespace", "/")[1]).alias("tags"), F.lit(5).alias("limit"))
    return r.recent_retrieve(q, e, ("provisional", "matured", "promoted")).select("query_id", "object_id", "rank")


@query("r11_content_dedup", f"""with {HITS.format(leg='')} select query_id, object_id, plane from (select *, row_number() over (partition by query_id, sha256(substr(content, 1, 300)) order by
  case when plane = 'curated' then 4 when plane = 'concept' then 3 when state = 'matured' then 2 when state = 'provisional' then 1 else 0 end desc, score desc, object_id) as k from scored) t where k = 1""", ALL)
def _(spark, d):
    return r.content_dedup(r.score_hits(hits(spark, d), P.NOW, few_queries=True)).select("query_id", "object_id", "plane")


ASKED = """asked as (select namespace as wanted, min(object_id) as first, cast(replace(split_part(namespace, '/', 1), 'conv', '') as bigint) as query_id from thought group by namespace),
  q as (select query_id, wanted, case when query_id % 2 = 0 then 'user' end as presence, case when query_id % 3 = 0 then 'c' || (query_id % 3) end as channel, case when query_id % 2 = 1 then 2 end as least,
    case when query_id % 4 = 3 then first end as reply from asked)"""


def asked_history(spark, d):
    """A query for each namespace; some ask for a presence, a channel, an importance or the replies to its first thought."""
    t = P.thought(spark, d).groupBy("namespace").agg(F.min("object_id").alias("first"))
    n = F.col("query_id")
    numbered = t.withColumn("query_id", F.substring_index(F.substring("namespace", 5, 100), "/", 1).cast("long"))  # conv0 to conv9
    return numbered.select(
        "query_id", "namespace", F.when(n % 2 == 0, "user").alias("presence"), F.when(n % 3 == 0, F.concat(F.lit("c"), n % 3)).alias("channel"), F.when(n % 2 == 1, 2).alias("min_importance"),
        F.when(n % 4 == 3, F.col("first")).alias("in_reply_to"), F.when(n % 5 == 0, 25).alias("limit"),
    )


@query("r12_thought_history", f"""with {ASKED}, h as (select q.query_id, t.object_id, row_number() over (partition by q.query_id order by created_epoch desc, object_id) as place from q join thought t on t.namespace = q.wanted
    where (presence is null or from_presence = presence or to_presence = presence) and (q.channel is null or q.channel = t.channel) and (least is null or importance >= least) and (reply is null or in_reply_to = reply))
  select * from h where query_id % 5 <> 0 or place <= 25""", T_)
def _(spark, d):
    return r.thought_history(asked_history(spark, d), P.thought(spark, d)).select("query_id", "object_id", "place")


@query("r12_similar_thoughts", f"""with {ASKED}, s as (select t.*, [length(content) % 7 - 3.0, importance - 5.0, length(content) % 5 - 2.0] as v from thought t),
  h as (select q.query_id, t.object_id, round(list_inner_product(v, [1.0, 2.0, q.query_id - 4.0]) / nullif(sqrt(list_inner_product(v, v)) * sqrt(5 + (q.query_id - 4.0) * (q.query_id - 4.0)), 0), 9) as cosine, created_epoch from q join s t on t.namespace = q.wanted
    where (presence is null or from_presence = presence or to_presence = presence) and (q.channel is null or q.channel = t.channel) and (least is null or importance >= least) and (reply is null or in_reply_to = reply)),
  p as (select query_id, object_id, row_number() over (partition by query_id order by coalesce(cosine, 0.0) desc, created_epoch desc, object_id) as place from h)
  select * from p where query_id % 5 <> 0 or place <= 25""", T_)
def _(spark, d):
    """By the cosine of three numbers of each thought."""
    n, size = F.col("query_id"), F.length("content")
    t = P.thought(spark, d).withColumn("vector", F.array(size % 7 - 3.0, F.col("importance") - 5.0, size % 5 - 2.0))
    asked = asked_history(spark, d).withColumn("vector", F.array(F.lit(1.0), F.lit(2.0), n - 4.0))
    return r.thought_history(asked, t, by_similarity=True).select("query_id", "object_id", "place")


@query("r11_fuzzy_dedup")
def _(spark, d):
    """Pages of 40 ids over three planes: copies of one content, and rows whose vectors and tags are near."""
    return r.fuzzy_dedup(pages(spark, d))


def pages(spark, d):
    n = F.col("number")
    h = r.score_hits(hits(spark, d).withColumn("query_id", F.floor(n / 40)), P.NOW)
    small = F.col("number") % 3
    return h.withColumns({"tags": F.array(F.concat(F.lit("t"), n % 2), F.concat(F.lit("u"), n % 3)), "vector": F.array(1.0 + small, n % 5 - 2.0, F.lit(0.5)), "content": F.concat("plane", F.substring("content", 1, 20))})


@query("r13_unread_thoughts", "select object_id from thought where to_presence in ('user', 'all') and not list_contains(read_by, 'user') and from_presence <> 'user'", T_)
def _(spark, d):
    return r.unread_thoughts(P.thought(spark, d), "user").select("object_id")
