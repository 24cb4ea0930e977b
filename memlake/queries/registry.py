"""Registration of queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, planes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; its SQL may use the named planes as tables."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            parts = [f"{p} as ({PLANE_SQL[p]})" for p in planes]
            body = sql.strip()
            recursive = "recursive " if body.lower().startswith("with recursive") else ""
            if parts and body.lower().startswith("with"):
                body = ", ".join(parts) + ", " + body[len("with " + recursive) :]
                SQL[name] = f"with {recursive}{body}"
            else:
                SQL[name] = f"with {', '.join(parts)} {body}" if parts else body
        return f

    return add


def _pick(number: str, *values: str) -> str:
    return f"case ({number}) % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def _key(prefix: str, number: str) -> str:
    return f"'{prefix}' || lpad(cast({number} as varchar), 26, '0')"


_NONE = "cast([] as varchar[])"
_CREATED = "cast(1704067200 + doc_id * 3600 as double)"
#: White space of any script, as both engines can name it.
WHITE = "[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+"
#: The hash of a text without white space at its ends.
STRIPPED = "sha256(regexp_replace({}, '^" + WHITE.replace("{", "{{").replace("}", "}}") + "|" + WHITE.replace("{", "{{").replace("}", "}}") + "$', '', 'g'))"
#: The derivation of ``memlake.sources.planes`` in SQL.
PLANE_SQL = {
    "episodic": f"""select {_key('D', 'doc_id')} as object_id, lang || '/' || source || '/episodic' as namespace, lang as identity_family, doc_id as number,
        {_pick('doc_id', 'provisional', 'matured', 'matured', 'matured', 'matured', 'demoted', 'archived', 'superseded')} as state, 1 as version,
        {_CREATED} as created_epoch, {_CREATED} + doc_id % 7 * 86400.0 as updated_epoch, coalesce(text, '') as content,
        case when doc_id % 2 = 0 then substr(text, 1, 80) end as summary, cast(null as varchar) as title, [source, 'g' || cast(doc_id % 5 as varchar)] as tags,
        case when doc_id % 11 = 0 then {_NONE} else ['t' || cast(doc_id % 5 as varchar)] end as topics, 1 + doc_id % 10 as importance,
        (doc_id // 3) % 6 as reinforcement_count, doc_id % 4 as access_count, case when doc_id % 3 = 0 then {_CREATED} end as valid_from_epoch,
        case when doc_id % 4 = 0 then {_CREATED} + doc_id % 50 * 86400.0 end as valid_until_epoch, case when doc_id % 20 = 7 then {_key('D', 'doc_id + 10')} end as superseded_by,
        case when doc_id % 9 = 0 then [{_key('A', 'doc_id % 400')}] else {_NONE} end as supported_by from documents""",
    "concept": f"""select {_key('C', 'doc_id')} as object_id, lang || '/shared/concept' as namespace, lang as identity_family, doc_id as number,
        {_pick('doc_id // 5', 'synthesized', 'matured', 'matured', 'promoted', 'demoted', 'superseded')} as state, 1 as version,
        {_CREATED} as created_epoch, {_CREATED} + doc_id % 7 * 86400.0 as updated_epoch, coalesce(text, '') as content, substr(text, 1, 40) as title,
        1 + doc_id % 10 as importance, (doc_id // 5) % 6 as reinforcement_count, doc_id % 4 as promotion_attempts,
        case when doc_id % 35 = 0 then [{_key('C', 'doc_id + 5')}] else {_NONE} end as contradicts, case when (doc_id // 5) % 6 = 3 then {_key('K', 'doc_id')} end as promoted_to,
        ['t' || cast(doc_id % 3 as varchar)] as topics, case when doc_id % 2 = 0 then {_CREATED} + doc_id % 40 * 86400.0 end as last_reinforced_epoch,
        [{_key('D', 'doc_id')}, {_key('D', 'doc_id + 1')}, {_key('D', 'doc_id + 2')}] as merged_from from documents""",
    "curated": f"""select {_key('K', 'doc_id')} as object_id, lang || '/shared/curated' as namespace, lang as identity_family, doc_id as number,
        {_pick('doc_id', 'matured', 'matured', 'superseded', 'archived')} as state, 1 as version, {_CREATED} as created_epoch, {_CREATED} + doc_id % 7 * 86400.0 as updated_epoch,
        text as content, substr(text, 1, 40) as title, 1 + doc_id % 10 as importance, 'curated/' || lang || '/' || cast(doc_id as varchar) || '.md' as vault_path, {STRIPPED.format('text')} as body_hash,
        case when doc_id % 35 = 0 then {_key('C', 'doc_id')} end as promoted_from, case when doc_id % 3 = 0 then {_CREATED} end as valid_from_epoch,
        case when doc_id % 4 = 0 then {_CREATED} + doc_id % 50 * 86400.0 end as valid_until_epoch,
        case when doc_id % 2 = 0 then {_CREATED} + doc_id % 60 * 86400.0 end as last_accessed_epoch from documents""",
    "artifact": f"""select {_key('A', 'page_id')} as object_id, 'web/site' || cast(page_id % 10 as varchar) || '/artifact' as namespace, 'web' as identity_family, page_id as number,
        {_pick('page_id', 'matured', 'matured', 'matured', 'archived')} as state, 1 as version, cast(1704067200 - 200 * 86400 + page_id * 7200 as double) as created_epoch,
        cast(1704067200 - 200 * 86400 + page_id * 7200 as double) as updated_epoch, url as filename, html as content, sha256(html) as sha256, strlen(html) as size_bytes from pages""",
    "thought": f"""select {_key('T', 'conv_id * 10000000 + turn')} as object_id, 'conv' || cast(conv_id % 10 as varchar) || '/chat/thought' as namespace, role as from_presence,
        case role when 'system' then 'all' when 'user' then 'assistant' else 'user' end as to_presence, 'c' || cast(conv_id % 3 as varchar) as channel, 1 + turn % 10 as importance,
        cast(1704067200 + conv_id * 3600 + turn * 60 as double) as created_epoch, text as content,
        case when turn % 3 = 0 then [case role when 'system' then 'all' when 'user' then 'assistant' else 'user' end] else {_NONE} end as read_by,
        case when turn > 0 then {_key('T', 'conv_id * 10000000 + turn - 1')} end as in_reply_to, {_pick('turn', 'provisional', 'matured', 'matured', 'archived')} as state, 1 as version from conversations""",
    "lifecycle_events": f"""select event_id, {_key('D', 'user_id')} as object_id, {_pick('event_id', 'provisional', 'matured', 'demoted')} as from_state, {_pick('event_id', 'matured', 'demoted', 'matured')} as to_state,
        event_type as reason, epoch_us(ts) as occurred_us, value from events""",
}
