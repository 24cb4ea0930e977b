"""Nearest rows and similar pairs against brute force, in one block and in many."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from memlake.operators import near_pairs, nearest, similarity

ROWS = "group string, namespace string, object_id string, vector array<double>"


def clustered(n: int, dims: int, seed: int, spread: float = 0.35, centres: int = 12) -> np.ndarray:
    """Vectors around a few centres; every 17th is a copy of an earlier one, every 50th is zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    x[::17] = x[n // 17 // 2]
    x[::50] = 0
    return x


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return nearest.unit(x) @ nearest.unit(y).T


@pytest.mark.parametrize("few", [nearest.FEW, 7])
def test_top_k_of_queries(spark, monkeypatch, few):
    monkeypatch.setattr(nearest, "FEW", few)
    monkeypatch.setattr(nearest, "CELL_ROWS", 40)
    x = clustered(300, 6, 1)
    space = [f"n{i % 3}" if i % 3 else "big" for i in range(300)]
    rows = spark.createDataFrame([("g", space[i], f"o{i:03d}", x[i].tolist()) for i in range(300)], ROWS).repartition(5)
    asked = list(range(0, 300, 9)) + [1]
    queries = spark.createDataFrame([(i, space[i], x[i].tolist()) for i in asked] + [(999, "nowhere", [1.0] * 6)], "query_id bigint, namespace string, vector array<double>")
    for k in (1, 4, 500):
        got = {(r.query_id, r["rank"]): (r.object_id, round(r.score, 9)) for r in similarity.dense_topk(queries, rows, k).collect()}
        want = {}
        for q in asked:
            score = cosines(x[[q]], x)[0]
            near = sorted((i for i in range(300) if space[i] == space[q]), key=lambda i: (-round(score[i], 12), i))
            want |= {(q, rank): (f"o{i:03d}", round(score[i], 9)) for rank, i in enumerate(near[:k], 1)}
        assert got.keys() == want.keys()
        assert all(got[key][1] == pytest.approx(want[key][1], abs=1e-8) for key in want)
    plan = similarity.dense_topk(queries, rows, 4)._jdf.queryExecution().toString()
    assert "Window [row_number() windowspecdefinition(query_id" in plan or "row_number" in plan


def test_top_k_of_nothing(spark):
    rows = spark.createDataFrame([("g", "n", "o", [1.0])], ROWS)
    queries = spark.createDataFrame([(1, "n", [1.0])], "query_id bigint, namespace string, vector array<double>")
    assert similarity.dense_topk(queries.limit(0), rows, 3).collect() == []
    assert similarity.dense_topk(queries, rows.limit(0), 3).collect() == []


def brute(rows: list[tuple], threshold: float, below: float | None, other: list[tuple] | None = None) -> set:
    out = set()
    for group in {r[0] for r in rows}:
        left = [r for r in rows if r[0] == group]
        right = left if other is None else [r for r in other if r[0] == group]
        if not right:
            continue
        score = cosines(np.array([r[3] for r in left]), np.array([r[3] for r in right]))
        for i, j in zip(*np.nonzero((score >= threshold) & (score < (np.inf if below is None else below)))):
            if other is not None or left[i][2] < right[j][2]:
                out.add((group, left[i][2], right[j][2]))
    return out


@pytest.mark.parametrize(("threshold", "below"), [(0.9, None), (0.3, 0.5), (-0.5, None), (0.75, 0.85)])
def test_similar_pairs_by_pruned_blocks(spark, monkeypatch, threshold, below):
    monkeypatch.setattr(near_pairs, "BLOCK", 16)
    monkeypatch.setattr(near_pairs, "PIVOTS", 12)
    monkeypatch.setattr(near_pairs, "ASSIGNED", 64)
    x = clustered(360, 5, 3)
    rows = [("small" if i < 9 else "g" if i % 3 else "h", "n", f"o{i:03d}", x[i].tolist()) for i in range(360)]
    left, right = rows[::2], rows[1::2]
    one = near_pairs.similar_pairs(spark.createDataFrame(rows, ROWS), threshold, below)
    got = [tuple(r)[:3] for r in one.collect()]
    assert len(got) == len({*got}) and {*got} == brute(rows, threshold, below)
    two = near_pairs.similar_pairs(spark.createDataFrame(left, ROWS), threshold, below, spark.createDataFrame(right, ROWS))
    got = [tuple(r)[:3] for r in two.collect()]
    assert len(got) == len({*got}) and {*got} == brute(left, threshold, below, right)


def test_pruning_skips_blocks_of_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(near_pairs, "BLOCK", 16)
    x = clustered(600, 24, 4, spread=0.12)
    rows = spark.createDataFrame([("g", 0, f"o{i:03d}", x[i].tolist()) for i in range(600)], "group string, side int, object_id string, vector array<double>")
    large = rows.groupBy("group").count().withColumnRenamed("count", "n")
    kept = [r.kept for r in near_pairs.block_pairs(rows, large, False, 0.85, None)[1].collect()]
    assert sum(kept) < 0.4 * len(kept)


def test_supersession_needs_exactly_one_candidate(spark):
    def table(rows):
        return spark.createDataFrame(rows, "object_id string, namespace string, topics array<string>, vector array<double>")

    new = table([("a", "n", ["t", "u"], [1.0, 0.0]), ("b", "n", ["v"], [0.0, 1.0]), ("c", "n", [], [1.0, 0.0]), ("d", "m", ["t"], [1.0, 0.0])])
    old = table([("x", "n", ["t", "u"], [0.99, 0.1]), ("a", "n", ["t"], [1.0, 0.0]), ("y", "n", ["v"], [0.1, 1.0]), ("z", "n", ["v", "w"], [0.0, 1.0])])
    assert [(r.object_id, r.candidate) for r in similarity.supersession_candidate(new, old, 0.88).collect()] == [("a", "x")]


def test_duplicates_merge_only_where_they_agree(spark):
    new = spark.createDataFrame([(1, "n", [1.0, 0.0], "c"), (2, "n", [1.0, 0.0], "other"), (3, "n", [0.6, 0.8], "c"), (4, "m", [1.0, 0.0], "c"), (5, "n", [1.0, 0.0], None)], "query_id bigint, namespace string, vector array<double>, body string")
    old = spark.createDataFrame([("x", "n", [0.99, 0.02], "c")], "object_id string, namespace string, vector array<double>, body string")
    got = {r.query_id: (r.action, r.object_id) for r in similarity.duplicate_candidate(new, old, "episodic", ["body"]).collect()}
    assert got == {1: ("merge", "x"), 2: ("insert", "x"), 3: ("insert", None), 4: ("insert", None), 5: ("insert", "x")}
    assert {r.action for r in similarity.duplicate_candidate(new, old, "thought", ["body"]).collect()} == {"insert"}


@pytest.mark.parametrize("tile", [16, 8192])
def test_few_pairs_connect_what_all_do(spark, monkeypatch, tile):
    monkeypatch.setattr(near_pairs, "BLOCK", 16)
    monkeypatch.setattr(near_pairs, "TILE", tile)
    x = clustered(240, 4, 5)
    rows = [("g" if i % 3 else "h", "n", f"o{i:03d}", x[i].tolist()) for i in range(240)]
    table = spark.createDataFrame(rows, ROWS)
    every = {tuple(r)[:3] for r in near_pairs.similar_pairs(table, 0.3).collect()}
    few = {tuple(r)[:3] for r in near_pairs.similar_pairs(table, 0.3, forest=True).collect()}
    assert every == brute(rows, 0.3, None) and few < every and len(few) < len(every) / 2
    wanted, got = ({tuple(r) for r in similarity.components(spark.createDataFrame(sorted(pairs), "group string, a string, b string")).collect()} for pairs in (every, few))
    assert got == wanted


@pytest.mark.parametrize(("block", "step"), [(8192, 2_000_000), (7, 50)])
def test_sparse_top_k_of_queries(spark, monkeypatch, block, step):
    from memlake.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK_QUERIES", block)
    monkeypatch.setattr(sparse, "STEP", step)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        terms = sorted({f"t{int(t)}" for t in rng.zipf(1.5, 12) if t < 60})
        rows.append((f"o{i:03d}", None if i % 29 == 0 else f"n{i % 2}", terms, [1.0 + (i * 7 + j) % 5 / 3 for j in range(len(terms))]))
    table = spark.createDataFrame(rows, "object_id string, namespace string, terms array<string>, weights array<double>")
    asked = [(i, *rows[i][1:]) for i in range(0, 150, 5)]
    queries = spark.createDataFrame(asked, "query_id bigint, namespace string, terms array<string>, weights array<double>")
    got = {(r.query_id, r.rank): (r.object_id, r.score) for r in sparse.sparse_topk(queries, table.repartition(3), 4).collect()}
    wanted = {}
    for q, space, terms, weights in asked:
        of, scores = dict(zip(terms, weights)), []
        for o, n, ts, ws in rows:
            if n is not None and n == space and of.keys() & {*ts}:
                scores.append((-round(sum(of[t] * w for t, w in zip(ts, ws) if t in of), 9), o))
        wanted |= {(q, k + 1): (o, -s) for k, (s, o) in enumerate(sorted(scores)[:4])}
    assert got == wanted


def test_fused_channels_are_dealt_anew(spark):
    """Channels that are dealt by query give a union that must not pass for one dealt so."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def channel(seed):
        x = spark.range(400).select((F.col("id") % 7).alias("query_id"), F.concat(F.lit("D"), F.col("id") % 50).alias("object_id"), (F.col("id") * seed % 97).alias("score")).distinct()
        return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "object_id")))

    fused = similarity.rrf([channel(37), channel(53)])
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("Union")
    assert fused.groupBy("query_id", "object_id").count().filter("count > 1").isEmpty()


def test_candidates_are_searched_in_shared_topics(spark, monkeypatch):
    """Topics that only one side has are no groups of the search."""
    from pyspark.sql import functions as F

    groups = []

    def recorded(rows, threshold, other):
        groups.append([{r.topic for r in df.collect()} for df in (rows, other)])
        return near_pairs.similar_pairs(rows, threshold, other=other)

    monkeypatch.setattr(similarity, "similar_pairs", recorded)
    n = F.col("id")
    rows = spark.range(40).select(F.concat(F.lit("D"), n).alias("object_id"), F.lit("a").alias("namespace"), F.array(F.lit(1.0), n / 100).alias("vector"), F.array(F.concat(F.lit("t"), F.floor(n / 2))).alias("topics"))
    found = similarity.supersession_candidate(rows.filter("id in (0, 9)"), rows.filter("id % 2 = 1 and id <> 9"), 0.5).collect()
    assert groups == [[{"t0"}, {"t0"}]]
    assert [(r.object_id, r.candidate) for r in found] == [("D0", "D1")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equal_vectors_rank_by_id(seed):
    """Copies have one score wherever they lie in a matrix product, so their ids decide."""
    rng = np.random.default_rng(seed)
    copy = rng.normal(size=64)
    x = nearest.unit(np.where(rng.random(9000)[:, None] < 0.2, copy, rng.normal(size=(9000, 64))))
    copies = np.flatnonzero((x == nearest.unit([copy])[0]).all(axis=1))
    queries = nearest.unit(copy + rng.normal(size=(321, 64)) * 0.3)
    best = nearest._Best(list(range(321)), queries, 40)
    for begin in range(0, 9000, 4111):
        best.add(np.array([f"{i:04d}" for i in range(begin, min(9000, begin + 4111))], object), x[begin : begin + 4111])
    assert len(copies) > 1000
    assert all(list(best.ids[best.query == i]) == [f"{j:04d}" for j in copies[:40]] for i in range(321))


def test_sparse_blocks_read_rows_of_their_namespaces(spark, monkeypatch):
    """Queries of several namespaces that need several blocks: no row is read by more blocks than the
    queries of its namespace need, and rows that nobody asks for by none."""
    from memlake.operators import sparse

    read, of_block = [], sparse._of_block

    def recorded(queries, rows, k):
        read.append(({*queries["namespace"].to_pylist()}, [(r.namespace, r.object_id) for r in rows.collect()]))
        return of_block(queries, rows, k)

    monkeypatch.setattr(sparse, "_of_block", recorded)
    monkeypatch.setattr(sparse, "BLOCK_QUERIES", 10)
    rows = [(f"o{i:03d}", f"n{i % 7}", [f"t{i % 3}", f"u{i % 4}"], [1.0 + i % 5, 2.0]) for i in range(140)]
    table = spark.createDataFrame(rows, "object_id string, namespace string, terms array<string>, weights array<double>")
    asked = [(i, *rows[i][1:]) for i in range(140) if i % 7 < 2 or i % 7 < 6 and i < 30]
    asked += [(1000 + i, "empty", ["t0"], [1.0]) for i in range(12)]
    got = sparse.sparse_topk(spark.createDataFrame(asked, "query_id bigint, namespace string, terms array<string>, weights array<double>"), table, 3).collect()
    wanted = set()
    for q, space, terms, weights in asked:
        of = dict(zip(terms, weights))
        scores = sorted((-sum(of[t] * w for t, w in zip(ts, ws) if t in of), o) for o, n, ts, ws in rows if n == space and of.keys() & {*ts})
        wanted |= {(q, o, k, -s) for k, (s, o) in enumerate(scores[:3], 1)}
    assert {(r.query_id, r.object_id, r.rank, r.score) for r in got} == wanted
    times = Counter(name for _, of in read for name in {n for n, _ in of})
    assert times == {"n0": 2, "n1": 2, "n2": 1, "n3": 1, "n4": 1, "n5": 1}
    assert not any("empty" in names for names, _ in read)


def test_texts_stay_where_they_are(spark):
    """Rows meet the given vectors with their texts' hashes and made vectors, not with the texts."""
    from memlake.queries.flowing import blended_vectors, synthesis_inputs

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    d = "/root/testdata/sf0.001"
    for rows in (blended_vectors(spark, d)[2].drop("content"), synthesis_inputs(spark, d)[0].select("family", "object_id", "vector")):
        joins = [p for p in nodes(rows._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Join"]
        assert joins
        for side in (s for j in joins for s in (j.left(), j.right())):
            assert not any(name in side.output().toString() for name in ("content#", "text#"))


@pytest.mark.parametrize(("threshold", "below"), [(0.3, None), (0.3, 0.9), (0.97, None)])
def test_hubs_connect_what_all_pairs_do(spark, monkeypatch, threshold, below):
    """Most rows meet the hubs alone; those without a link to them meet all rows of their group."""
    for name, value in {"BLOCK": 16, "TILE": 50, "HUBS": 24, "ASSIGNED": 64, "STRIP": 20}.items():
        monkeypatch.setattr(near_pairs, name, value)
    by_hubs, went = near_pairs._by_hubs, []

    def recorded(*args):
        went.append(by_hubs(*args))
        return went[-1]

    monkeypatch.setattr(near_pairs, "_by_hubs", recorded)
    x = np.r_[clustered(260, 12, 5, centres=3), np.random.default_rng(1).normal(size=(40, 12))]
    rows = [("g" if i % 5 else "h", "n", f"o{i:03d}", x[i].tolist()) for i in range(300)]
    few = {tuple(r)[:3] for r in near_pairs.similar_pairs(spark.createDataFrame(rows, ROWS), threshold, below, forest=True).collect()}
    every = brute(rows, threshold, below)
    assert few < every and (threshold > 0.9 or len(few) < len(every) / 2)
    wanted, got = ({tuple(r) for r in similarity.components(spark.createDataFrame(sorted(pairs), "group string, a string, b string")).collect()} for pairs in (every, few))
    assert got == wanted
    assert [w is not None for w in went] == [threshold < 0.9]
