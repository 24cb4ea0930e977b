"""Context packs under a budget (C-1 to C-6)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import strip, tokenize, truncated
from memlake.schemas import GROUP_ORDER, KIND_GROUP, KIND_PRIORITY, STALENESS_PRIORITY


def _lookup(key: Column, table: dict) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()))


def context_candidates(recent: DataFrame, ranked: DataFrame, recent_limit: int = 10) -> DataFrame:
    """C-1: both lanes, one row per (query, namespace, plane, object), the ranked lane's first;
    the newest ``recent_limit`` recent hits of each query, with the score 0. The rows are dealt by
    query once, which serves all that follows."""
    both = ranked.withColumn("lane", F.lit("ranked")).unionByName(recent.withColumns({"lane": F.lit("recent"), "retrieve_score": F.lit(0.0)})).repartition("query_id")
    newest = F.row_number().over(Window.partitionBy("query_id", "lane").orderBy(F.desc("created_epoch"), "object_id"))
    both = both.withColumn("k", newest).filter((F.col("lane") == "ranked") | (F.col("k") <= recent_limit)).drop("k")
    w = Window.partitionBy("query_id", "namespace", "plane", "object_id").orderBy("lane")
    return both.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def _said(df: DataFrame, key: str) -> Column:
    """What a row says of itself: in the column ``extra``, a map, where it has the key, else in the
    first tag with the key as its prefix."""
    found = F.try_element_at(F.filter("tags", lambda t: t.startswith(f"{key}:")), F.lit(1))
    tagged = strip(F.substr(found, F.lit(len(key) + 2)))
    return F.coalesce(strip(F.try_element_at("extra", F.lit(key))), tagged) if "extra" in df.columns else tagged


def with_kind(df: DataFrame) -> DataFrame:
    """C-2: kind and staleness from ``extra`` or the tags, else the defaults."""
    kind, stale = _said(df, "kind"), F.coalesce(F.when(_said(df, "staleness") != "", _said(df, "staleness")), _said(df, "freshness"))
    return df.withColumns({
        "kind": F.when(kind.isin(*KIND_PRIORITY), kind).otherwise("episode"),
        "staleness": F.when(stale.isin(*STALENESS_PRIORITY), stale).when(F.col("state") == "superseded", "superseded").otherwise("episodic"),
    })


def hidden_reason(include_history: bool = False) -> Column:
    """C-3: why a candidate is not shown, or null. Low relevance shows only in packing."""
    if include_history:
        return F.lit(None).cast("string")
    superseded = (F.col("staleness") == "superseded") | F.coalesce(F.col("state") == "superseded", F.lit(False))
    return F.when(superseded, "superseded").when(F.col("kind") == "correction/suppression", "correction/suppression")


def essence_rank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """C-4: candidates with kind and staleness, ranked in each query. Statistics of the text
    relevance are those of the query's own candidates, so each query's candidates are scored
    as documents of their own. Of a text only its length and the counts of the query's tokens
    are kept; its tokens are sent nowhere."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), "content", F.array_join("tags", " "))
    asked = queries.select("query_id", tokenize(F.col("query_text")).alias("query_tokens"))
    met = candidates.join(asked, "query_id").withColumn("tokens", tokenize(text))
    met = met.withColumns({"length": F.size("tokens"), "overlap": F.size(F.array_intersect("tokens", "query_tokens")), "tf": _times("tokens")}).drop("tokens")
    met = met.join(_statistics(met), "query_id").withColumn("bm25", _bm25_within()).drop("length", "tf", "statistics")
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    epoch = F.coalesce("updated_epoch", "created_epoch")
    hint = F.when(epoch <= 0, F.lit(0.0)).otherwise(F.least(F.lit(0.5), F.log10(F.greatest(epoch, F.lit(1.0))) / 20))
    score = (
        _lookup(F.col("kind"), KIND_PRIORITY) + _lookup(F.col("staleness"), STALENESS_PRIORITY) + 2.0 * F.when(best > 0, F.col("bm25") / best).otherwise(F.lit(0.0))
        + 0.6 * F.least(F.greatest("retrieve_score", F.lit(0.0)), F.lit(1.0)) + 0.5 * F.least(F.greatest("importance", F.lit(1)), F.lit(10)) / 10 + hint
        - F.when((F.size("query_tokens") > 0) & (F.col("overlap") == 0) & ~F.col("staleness").isin("durable", "current"), F.lit(2.0)).otherwise(F.lit(0.0))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("essence"), F.desc(_lookup(F.col("staleness"), STALENESS_PRIORITY)), F.desc(_lookup(F.col("kind"), KIND_PRIORITY)), F.desc("created_epoch"), "object_id")
    return met.withColumn("essence", F.round(score, 9)).withColumn("place", F.row_number().over(order))


def _times(tokens: str) -> Column:
    """How often each distinct token of the query is in an array."""
    return F.transform(F.array_distinct("query_tokens"), lambda t: F.size(F.filter(tokens, lambda x: x == t)))


def _statistics(met: DataFrame) -> DataFrame:
    """(query_id, statistics): of the candidates' lengths, then of each distinct token of the query
    in turn: the sum, the number of candidates and of those that have any."""
    numbers = met.select("query_id", F.posexplode(F.concat(F.array("length"), "tf")).alias("at", "n"))
    each = numbers.groupBy("query_id", "at").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("n") > 0, 1)).alias("df"))
    return each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "total", "docs", "df"))).alias("statistics"))  # a query's tokens


def _bm25_within(k1: float = 1.5, b: float = 0.75) -> Column:
    every = F.get("statistics", F.lit(0))
    share = F.greatest("length", F.lit(1)) / F.greatest(every["total"] / every["docs"], F.lit(1.0))

    def part(x: Column) -> Column:
        idf = F.log(1 + (every["docs"] - x["df"] + 0.5) / (x["df"] + 0.5))
        return idf * x["tf"] * (k1 + 1) / (x["tf"] + k1 * (1 - b + b * share)) * x["times"]

    df = F.transform(F.slice("statistics", F.lit(2), F.size("statistics")), lambda x: x["df"])
    tokens = F.arrays_zip(F.col("tf").alias("tf"), _times("query_tokens").alias("times"), df.alias("df"))
    return F.aggregate(tokens, F.lit(0.0), lambda s, x: s + part(x))


def _fold(ranked: DataFrame, max_items: int, max_chars: int, recent_reserve: int) -> DataFrame:
    """The items of each query's pack, and a row with ``item`` 0 whose ``stop`` is the place in the
    ranked lane after which nothing was looked at (null: all was).

    A lane's item is taken, or ends the lane, so only the first max_items of each lane can matter,
    fillers aside: these are dropped before, and each query's rows are few.
    """
    filler = is_filler()
    lane = Window.partitionBy("query_id", "lane")
    newest = F.row_number().over(lane.orderBy(F.desc("created_epoch"), "place"))
    turn = F.when(F.col("lane") == "recent", newest).otherwise(F.row_number().over(lane.orderBy("place")))
    every = Window.partitionBy("query_id")
    has = {f"has_{x}": F.max(F.col("lane") == x).over(every) for x in ("recent", "ranked")}  # of all that is visible, fillers too
    rows = ranked.withColumns(has).filter((F.col("lane") == "recent") | ~filler).withColumn("turn", turn).filter(F.col("turn") <= max_items)
    text = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.col("content")).alias("text")
    rows = rows.select("query_id", "lane", "turn", "place", "object_id", "namespace", "kind", text, "has_recent", "has_ranked")

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("turn")
        both = bool(part.has_recent.iloc[0]) and bool(part.has_ranked.iloc[0])
        third = max_chars // 3 if both and max_items >= 2 else max_chars
        most = min(recent_reserve if part.has_ranked.iloc[0] else max_items, max_items)
        out, used, stop = [], 0, None
        for lane_name, items, room in (("recent", most, third), ("ranked", max_items, max_chars)):
            if lane_name == "ranked" and len(out) >= max_items:
                stop = 0
            for row in part[part.lane == lane_name].itertuples():
                if len(out) >= items:
                    break
                whole = " ".join((row.text or "").split())
                content = truncated(whole, room - used, "...") if room > used else ""
                if content:
                    out.append((key[0], len(out) + 1, row.object_id, row.namespace, row.kind, lane_name, content, len(whole) > room - used, len(whole), None))
                    used += len(content)
                if lane_name == "ranked" and (not content or used >= max_chars or len(out) >= items):
                    stop = int(row.place)
                if not content or used >= max_chars:
                    break
        out.append((key[0], 0, None, None, None, None, None, None, None, stop))
        names = [x.split()[0] for x in PACKED.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"content_length": "Int64", "stop": "Int64"})

    return rows.groupBy("query_id").applyInPandas(fold, PACKED)


PACKED = "query_id long, item long, object_id string, namespace string, kind string, lane string, content string, content_truncated boolean, content_length long, stop long"


def is_filler() -> Column:
    """Off-topic episodes, which don't fill a pack up."""
    return (F.size("query_tokens") > 0) & (F.col("overlap") == 0) & ~F.col("staleness").isin("durable", "current") & (F.col("kind") == "episode")


def pack(ranked: DataFrame, max_items: int, max_chars: int, recent_reserve: int = 0) -> DataFrame:
    """C-5: the items that fit, in order, with what each may show; ``ranked`` holds visible rows.

    The recent lane comes first, newest first: at most ``recent_reserve`` items unless it is
    the only lane, and at most a third of the characters when both lanes exist and two items
    or more fit; off-topic episodes count as a lane. The ranked lane follows without these. An
    item that meets the end of its room is cut at a grapheme cluster, with ``...`` where there
    is room for it. An item without text ends its lane.
    """
    return _fold(ranked, max_items, max_chars, recent_reserve).filter("item > 0").drop("stop")


def suppressed(candidates: DataFrame, ranked: DataFrame, max_items: int, max_chars: int, recent_reserve: int = 0) -> DataFrame:
    """C-3: (query_id, reason, n): candidates that were hidden, and fillers that packing skipped
    before it ended (``low_relevance``)."""
    hidden = candidates.withColumn("reason", hidden_reason()).filter("reason is not null").select("query_id", "reason")
    stops = _fold(ranked, max_items, max_chars, recent_reserve).filter("item = 0").select("query_id", "stop")
    skipped = ranked.filter((F.col("lane") == "ranked") & is_filler()).join(stops, "query_id", "left").filter("stop is null or place < stop")
    every = hidden.unionByName(skipped.select("query_id", F.lit("low_relevance").alias("reason")))
    return every.groupBy("query_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def render_pack(packed: DataFrame) -> DataFrame:
    """C-6: one text per query: groups in fixed order, a line for its title and one per item."""
    group = _lookup(F.col("kind"), KIND_GROUP)
    place = _lookup(group, {g: i for i, g in enumerate(GROUP_ORDER)})
    line = F.concat(F.lit("- ["), "kind", F.lit("; "), "namespace", F.lit("/"), "object_id", F.lit("] "), "content")
    lines = packed.select("query_id", place.alias("place"), "item", line.alias("line"))
    titles = packed.select("query_id", place.alias("place"), F.lit(0).cast("long").alias("item"), F.concat(group, F.lit(":")).alias("line")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("place", "item", "line")))  # max_items lines and their titles
    return lines.unionByName(titles).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
