"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, chat_format, exact_dedup, hard_negatives, hmm_lm, language_id, lexical_search, near_dedup, packing, quality_rules, secret_scan, token_count, toxicity
from memlake.llm.common import bucket_of, table


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids stand for the history that earlier runs have indexed, the others arrive."""
    docs = table(spark, sf_dir, "documents")
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    return exact_dedup.exact_dedup(docs.filter(even), docs.filter(~even)).drop("in_history")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("round_trip")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 1, F.lit(False))
    return hmm_lm.score_documents(table(spark, sf_dir, "documents").withColumn("held_out", held_out))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_id.predict(docs, ~held_out).withColumn("held_out", held_out)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every seventh row has another label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_count": op1_token_count,
        "op2_chat_format": op2_chat_format,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_quality_rules": op5_quality_rules,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_bpe": op7_bpe,
        "op8_near_dedup": op8_near_dedup,
        "op9_hmm_lm": op9_hmm_lm,
        "op10_language_id": op10_language_id,
        "op11_lexical_search": op11_lexical_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_secret_scan": op13_secret_scan,
    }


OP2_SQL = """
with d as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), p as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
    count(*) over (partition by conv_id) as n_turns,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (
      partition by conv_id order by turn nulls first, role, text rows between unbounded preceding and current row) as prefix
  from d
), whole as (
  select place, prefix, min(conv_id) as conv_id, count(*) as copies from p where place = n_turns group by place, prefix
), stay as (
  select * from whole w where not exists (select 1 from p where p.place = w.place and p.prefix = w.prefix and p.n_turns > p.place)
)
select p.conv_id, (p.place - 1) // 256 as part, p.n_turns, count(*) as part_turns, s.copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by p.place) as text
from p join stay s on s.conv_id = p.conv_id
group by p.conv_id, (p.place - 1) // 256, p.n_turns, s.copies
"""

OP6_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from d join g using (text_sha256)
"""


OP11_SQL = r"""
with word as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), tf as (select doc_id, term, count(*) as tf from word group by doc_id, term
), doc as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id
), whole as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from doc
), item as (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), weight as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, whole group by term, n_docs
), score as (
  select i.item_id, tf.doc_id,
    cast(sum(w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * doc.n * n_docs) // n_terms)))) as bigint) as score
  from item i join tf using (term) join weight using (term) join doc using (doc_id), whole
  group by i.item_id, tf.doc_id
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from score where score > 0
)
select * from ranked where rank <= 20
"""

OP12_SQL = """
with part as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    cast(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) as bigint) as score
  from part a join part b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), band as (
  select p.*, s.other_id as negative_id, s.score as negative_score,
    cast(row_number() over (partition by anchor_id, positive_id order by s.score desc, s.other_id) as integer) as rank
  from positive p join scored s using (anchor_id)
  where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from band where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
