"""Filters, projections and scalar functions over the planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.operators import filters as f
from memlake.queries.registry import WHITE, query
from memlake.sources import planes as P

E_, C_, K_ = ("episodic",), ("concept",), ("curated",)


@query("f01_in_namespace", "select object_id, namespace, state from episodic where namespace = 'en/src0/episodic'", E_)
def _(spark, d):
    return f.in_namespace(P.episodic(spark, d), "en/src0/episodic").select("object_id", "namespace", "state")


@query("f02_visible_states", """select 'fast' as mode, object_id from episodic where state in ('matured', 'promoted')
  union all select 'archive', object_id from episodic where state in ('matured', 'promoted', 'demoted', 'archived', 'superseded')
  union all select 'recent', object_id from episodic where state in ('provisional', 'matured', 'promoted')
  union all select 'episodic', object_id from episodic where state in ('matured', 'demoted')""", E_)
def _(spark, d):
    e, out = P.episodic(spark, d), None
    for name, mode, archived in (("fast", "fast", False), ("archive", "fast", True), ("recent", "recent", False), ("episodic", "episodic", True)):
        one = f.in_states(e, mode, archived).select(F.lit(name).alias("mode"), "object_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("f03_valid_at", """select object_id from curated where (valid_from_epoch is null or valid_from_epoch <= 1706000000)
  and (valid_until_epoch is null or 1706000000 < valid_until_epoch) and state = 'matured'""", K_)
def _(spark, d):
    return f.valid_at(P.curated(spark, d), 1706000000.0, "matured").select("object_id")


@query("f04_known_at", """select object_id from episodic e where created_epoch <= 1706000000 and not exists
  (select 1 from episodic s where s.object_id = e.object_id and s.superseded_by is not null and s.updated_epoch <= 1706000000)""", E_)
def _(spark, d):
    e = P.episodic(spark, d)
    supersessions = e.filter("superseded_by is not null").select("object_id", F.col("updated_epoch").alias("written_epoch"))
    return f.known_at(e, supersessions, 1706000000.0).select("object_id")


@query("f05_has_all_tags", "select object_id from episodic where list_contains(tags, 'src3') and list_contains(tags, 'g3')", E_)
def _(spark, d):
    return f.has_all_tags(P.episodic(spark, d), ["src3", "g3"]).select("object_id")


@query("f06_match_namespace_pattern", "select distinct namespace from episodic where split_part(namespace, '/', 1) = 'en'", E_)
def _(spark, d):
    return f.match_namespace_pattern(P.episodic(spark, d), "en/*/episodic")


@query("f07_resolve_targets", """select distinct namespace, split_part(namespace, '/', 3) as plane from (
  select namespace from episodic where namespace like 'de/%' or namespace = 'fr/src1/episodic' union all select namespace from concept where namespace = 'de/shared/concept') t""", (*E_, *C_))
def _(spark, d):
    names = P.episodic(spark, d).select("namespace").unionByName(P.concept(spark, d).select("namespace"))
    return f.resolve_targets(names, ["de/*", "fr/src1/episodic"], ["episodic", "concept", "episodic"])


@query("f08_family_targets", """select distinct namespace, split_part(namespace, '/', 3) as plane from (select * from (select namespace, identity_family from episodic union all select namespace, identity_family from curated) u) t
  where identity_family = 'es'""", (*E_, *K_))
def _(spark, d):
    rows = P.episodic(spark, d).select("namespace", "identity_family").unionByName(P.curated(spark, d).select("namespace", "identity_family"))
    return f.family_targets(rows, "es", ["episodic", "curated"])


@query("f09_identity_rows", "select object_id, namespace, version from curated", K_)
def _(spark, d):
    k = P.curated(spark, d).select("object_id", "namespace", "version", F.lit(None).cast("string").alias("point_kind"))
    return f.identity_rows(k.unionByName(k.withColumn("point_kind", F.lit("content"))))


@query("f10_snippet", """select object_id, case when length(content) > 200 then left_grapheme(content, cast(list_max(list_filter(range(201), lambda k: length(left_grapheme(content, cast(k as bigint))) <= 200)) as bigint)) else content end as snippet,
  length(content) as content_length, length(content) > 200 as content_truncated from episodic""", E_)
def _(spark, d):
    return f.with_snippet(P.episodic(spark, d), 200).select("object_id", "snippet", "content_length", "content_truncated")


@query("f11_lineage_summary", """select object_id, case when promoted_from is null then 0 else 1 end as n_links, coalesce('promoted_from=' || promoted_from, '') as lineage from curated""", K_)
def _(spark, d):
    out = f.with_lineage_summary(P.curated(spark, d))
    text = F.array_join(F.transform(F.map_entries("lineage"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return out.select("object_id", F.size("lineage").alias("n_links"), text.alias("lineage"))


@query("f12_page_after", "select object_id, state from episodic where object_id > 'D00000000000000000000000100' order by object_id limit 50", E_)
def _(spark, d):
    return f.page_after(P.episodic(spark, d), "D00000000000000000000000100", 50).select("object_id", "state")


@query("f13_contradictions", "select object_id, contradicts[1] as other from concept where len(contradicts) > 0 and namespace = 'en/shared/concept'", C_)
def _(spark, d):
    return f.contradictions(P.concept(spark, d), "en/shared/concept").select("object_id", F.col("contradicts")[0].alias("other"))


@query("k00_validate_captures", """select object_id, case when length(content) = 0 then 'empty_content' when length(content) > 16000 then 'too_many_characters' when strlen(content) > 32768 then 'too_many_bytes'
  when created_epoch > 1706000000 then 'future_event' end as reason from episodic""", E_)
def _(spark, d):
    e = P.episodic(spark, d).withColumn("event_at", F.col("created_epoch"))
    return f.validate_captures(e, 1706000000.0).select("object_id", "reason")


@query("t01_normalize_tags", """select object_id, array_to_string(list_distinct_sorted, ',') as tags from (
  select object_id, case when number % 5 = 2 then ['x-y', 'two', tags[1]] else ['x-y', tags[2], tags[1]] end as list_distinct_sorted from episodic) t""", E_)
def _(spark, d):
    raw = F.array(F.lit(" X y"), F.upper(F.col("tags")[1]), F.col("tags")[0], F.lit("x Y "), F.lit(" "))
    return P.episodic(spark, d).select("object_id", F.array_join(T.normalize_tags(raw, {"g2": "two"}), ",").alias("tags"))


@query("t02_supersession_hint", f"""select object_id, number % 3 = 0 as hinted, regexp_replace(content, '^{WHITE}|{WHITE}$', '', 'g') as needle from episodic""", E_)
def _(spark, d):
    e = P.episodic(spark, d)
    said = F.when(F.col("number") % 3 == 0, F.concat(F.lit(" Update: "), F.col("content"))).otherwise(F.col("content"))
    return e.select("object_id", T.has_supersession_hint(said).alias("hinted"), T.strip_supersession_hint(said).alias("needle"))


@query("t03_normalize_content")
def _(spark, d):
    return P.episodic(spark, d).select("object_id", "content", T.normalize_content("content").alias("normal"))


@query("t04_content_hash", "select object_id, sha256(substr(content, 1, 300)) as content_hash, body_hash from curated", K_)
def _(spark, d):
    return P.curated(spark, d).select("object_id", T.content_hash(F.col("content")).alias("content_hash"), T.body_hash(F.col("content")).alias("body_hash"))


@query("t05_truncate_grapheme")
def _(spark, d):
    return P.episodic(spark, d).select("object_id", T.truncate_grapheme(100)("content").alias("shown"))


@query("t06_redact_pii")
def _(spark, d):
    return P.read_table(spark, d, "documents").select("doc_id", "text", T.redact_pii(F.col("text")).alias("redacted"))


@query("t07_interesting_fact", r"""select doc_id, regexp_matches(text, '(?i)\bremember\b|\bI (?:always )?forget\b|\b(?:save|store|note) (?:this|that) (?:to|in) memory\b|\bnever forget\b') as interesting from documents""")
def _(spark, d):
    return P.read_table(spark, d, "documents").select("doc_id", T.interesting_fact(F.col("text")).alias("interesting"))


@query("t08_default_context_tags", """select object_id, tags[1] || ',' || tags[2] || case when number % 3 = 0 then ',kind:boundary' else ',kind:episode' end || ',staleness:episodic' as tags from episodic""", E_)
def _(spark, d):
    tags = F.when(F.col("number") % 3 == 0, F.concat("tags", F.array(F.lit("kind:boundary")))).otherwise(F.col("tags"))
    return P.episodic(spark, d).select("object_id", F.array_join(T.default_context_tags(tags), ",").alias("tags"))


@query("t09_namespace_parts", """select object_id, split_part(namespace, '/', 1) as family, split_part(namespace, '/', 3) as plane, 'curated/' || split_part(vault_path, '/', 2) || '/curated' as inferred from curated""", K_)
def _(spark, d):
    return P.curated(spark, d).select("object_id", T.family_of(F.col("namespace")).alias("family"), T.plane_of(F.col("namespace")).alias("plane"), T.infer_namespace(F.col("vault_path")).alias("inferred"))


@query("t15_ksuid_timestamp")
def _(spark, d):
    return P.episodic(spark, d).select("object_id", T.ksuid_timestamp(F.concat(F.lit("0"), F.substring("object_id", 2, 26))).alias("seconds"))


@query("t16_deterministic_id", "select object_id, substr(sha256(namespace || chr(31) || object_id), 1, 27) as derived from episodic", E_)
def _(spark, d):
    return P.episodic(spark, d).select("object_id", T.deterministic_id(F.col("namespace"), F.col("object_id")).alias("derived"))


@query("t17_hash_embed")
def _(spark, d):
    return P.episodic(spark, d).select("object_id", T.hash_embed(64)("content").alias("vector"))


@query("t18_embed_text", "select object_id, case when coalesce(summary, '') <> '' then summary else content end as said from episodic", E_)
def _(spark, d):
    return P.episodic(spark, d).select("object_id", T.embed_text("episodic").alias("said"))


@query("v06_tokenize", """select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.+-]*')) as n_tokens from documents""")
def _(spark, d):
    return P.read_table(spark, d, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"))


@query("v14_jaccard", """select a.object_id, round(cast(len(list_intersect(a.tags, b.tags)) as double) / (4 - len(list_intersect(a.tags, b.tags))), 6) as jaccard from episodic a join episodic b on b.number = a.number + 1""", E_)
def _(spark, d):
    e = P.episodic(spark, d)
    nxt = e.select((F.col("number") - 1).alias("number"), F.col("tags").alias("others"))
    return e.join(nxt, "number").select("object_id", F.round(T.jaccard(F.col("tags"), F.col("others")), 6).alias("jaccard"))
