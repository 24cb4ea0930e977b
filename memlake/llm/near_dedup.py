"""MinHash near-deduplication with sequential Bayesian verification.

Documents link when the Jaccard similarity of their sets of word shingles reaches a threshold;
a document's component is what links reach. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
lower-cased; a text of fewer words than a shingle is one shingle; one without words has an
empty set and links with nothing. Shingles are 64-bit fingerprints.

1. Documents with the same set form a class; its smallest doc_id stands for it from here on,
   so copies are never compared or expanded.
2. Signatures in bands give buckets of candidates. The number of bands is such that a pair at
   the threshold shares fewer than two bands with the chosen miss probability only.
3. In small buckets all pairs are candidates; their size is bounded, so the pairs are linear in
   the documents. In larger ones every member is compared with one pivot, the member that lies
   in most large buckets. Members known to be in one component need no comparison with each
   other. Other pairs are found by what they do not share with the pivot:

   Let D(x) be the symmetric difference of x and the pivot p, t the threshold, and
   K = (1 - t) / (1 + t) * (|x| + |y|): x and y link exactly if |x ^ y| <= K. Since
   |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, a link needs at least
   m = (|D(x)| + |D(y)| - K) / 2 common elements, and |D(x)| and |D(y)| at most K apart. So
   the two differences meet among the first |D| - m + 1 elements of either, in an order from
   rare to frequent ones. Differences are keyed by such an element and by both levels (ranges
   of |D|), so that only those that can link meet. If x and y do not both link with p, m > 0.
   Keys that many documents share on both sides become groups with a pivot of their own.
   Documents too far from the pivot to be judged so stay in their bucket, split once by a
   second band, for another pivot.
4. Candidates are verified in batches of signature values: a pair is dropped as soon as the
   posterior chance (uniform prior) that its similarity reaches the threshold falls below the
   miss probability. Survivors are verified exactly on their full sets.
5. Components come from alternating large-star and small-star steps on the links.

Each turn takes the pivots and all they judge out of a group, so turns end; from the third on a
group has ``MORE_PIVOTS`` times as many each turn. Nothing is capped: groups of any size lose no
pair, except by the two miss probabilities. Groups whose members are many, far from each other
and yet share two bands would take the comparisons of all pairs, spread over the turns.

Defined cases: rows are never merged, so repeated rows are copies and share a component, in
large buckets too; rows with one doc_id and several texts are one node that links as any of
them does; rows with a null doc_id link with nothing and are kept; very long texts are hashed
whole, a block of shingles at a time; of pivots that lie in as many buckets the smallest doc_id
is taken, which never changes the components; columns beyond doc_id and text are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import hot_from_counts, hot_keys, join_hot, kept_table, materialize, rows_of, scratch, sifted
from memlake.llm.shingles import MinHash, ascii_lower_words, jaccard, shingle_set

ROWS = 5
#: Chance that a pair at the threshold shares fewer than two bands, and that one is dropped by a posterior.
MISS = 1e-6
#: Signature values per step of the sequential verification.
STEP = 20
#: Buckets up to this size give all their pairs, and groups left after a turn up to that size.
SMALL = 16
FEW = 128
#: Keys of differences that more documents than that share on both sides become groups.
HEAVY = 256
#: Similarity to a pivot from which a document is judged by its difference to it.
NEAR = 0.5
#: Shingles after which a task forgets the sets it has made.
CACHE_SHINGLES = 100_000
#: From the third turn on a group has so many times the pivots of the turn before.
MORE_PIVOTS = 8
#: Ranges of the size of a difference, for each K.
LEVELS = 4
#: A class with more than 1/HOT of all rows is hot; so there are at most HOT hot classes.
HOT = 1024
#: Values of the hash that keeps texts of other documents out of the verification.
SIEVE = 1 << 19


def bands_for(threshold: float) -> int:
    """Bands of ROWS values such that a pair at the threshold shares fewer than two with chance MISS."""
    match, bands = threshold**ROWS, 2
    while (1 - match) ** bands + bands * match * (1 - match) ** (bands - 1) > MISS:
        bands += 1
    return bands


def least_matches(threshold: float, values: int) -> list[tuple[int, int]]:
    """(values compared, matches needed) for each step.

    With a uniform prior, the posterior chance of similarity >= t after m of n matches is
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, values + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append((n, m))
    return out


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the whole set), signature and band keys."""
    bands = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands, ROWS)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows: list[list] = [[], [], [], []]
                for text in some.column(1).to_pylist():
                    shingles = shingle_set(ascii_lower_words(text), width)
                    signature = hasher.signature(shingles) if len(shingles) else np.empty(0, np.uint32)
                    rows[0].append(len(shingles))
                    rows[1].append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    rows[2].append(signature.tobytes())
                    rows[3].append(hasher.band_keys(signature) if len(shingles) else [])
                types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                columns = [some.column(0), *(pa.array(r, kind) for r, kind in zip(rows, types))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "signature", "bands"])

    schema = "doc_id bigint, n_shingles bigint, set_key binary, signature binary, bands array<bigint>"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def prune(pairs: DataFrame, hot: DataFrame | None, signed: DataFrame, threshold: float, bands: int) -> DataFrame:
    """The pairs (a, b) that sequential verification does not drop; ``hot`` are their hot keys by a."""
    steps = least_matches(threshold, bands * ROWS)
    side_a = signed.select(F.col("rep").alias("a"), F.col("signature").alias("sig_a"))
    side_b = signed.select(F.col("rep").alias("b"), F.col("signature").alias("sig_b"))
    met = pairs.select("a", "b").join(side_b, "b")
    both = join_hot(met, side_a, ["a"], "b", hot).select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(n, -1) for i in (2, 3))
            left, matches, done = np.arange(n), np.zeros(n, np.int64), 0
            for end, least in steps:
                matches = matches + (x[left, done:end] == y[left, done:end]).sum(axis=1)
                stay = matches >= least
                left, matches, done = left[stay], matches[stay], end
            some = pa.array(left)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def sieved(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and text of the documents of the pairs, and of few others."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sieve = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).alias("sieve")
    some = ids.select(sieve).distinct()  # SIEVE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", sieve)
    return texts.join(F.broadcast(some), "sieve", "left_semi").drop("sieve")


def compare(
    pairs: DataFrame, hot: DataFrame | None, texts: DataFrame, width: int, percent: int, near: float | None = None
) -> DataFrame:
    """Exact set sizes of the pairs (a, b) that link: a, b, inter, size_a, size_b. With ``near`` those of that similarity or more, with b's difference to a."""
    met = pairs.select("a", "b").join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    side_a = texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"})
    rows = join_hot(met, side_a, ["a"], "b", hot).select("a", "b", "text_a", "text_b")
    names = ["a", "b", "inter", "size_a", "size_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # sets of the last texts, which come back as pivots
        held = 0
        for batch in batches:
            out: list[tuple] = []
            for a, b, text_a, text_b in rows_of(iter([batch])):
                if text_a not in known:
                    if held > CACHE_SHINGLES:
                        known, held = {}, 0
                    known[text_a] = shingle_set(ascii_lower_words(text_a), width)
                    held += len(known[text_a])
                x, y = known[text_a], shingle_set(ascii_lower_words(text_b), width)
                inter, union = jaccard(x, y)
                if near is None:
                    if 100 * inter >= percent * union:
                        out.append((a, b, inter, len(x), len(y)))
                elif inter >= near * union:
                    out.append((a, b, inter, len(x), len(y), np.setxor1d(x, y, assume_unique=True).view(np.int64)))
            arrays = [pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))]
            if near:
                arrays.append(pa.array([r[-1] for r in out], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, [*names, *(["difference"] if near else [])])

    schema = ", ".join([*(f"{n} bigint" for n in names), *(["difference array<bigint>"] if near else [])])
    return rows.mapInArrow(run, schema)


def linked(percent: int) -> Column:
    return 100 * F.col("inter") >= percent * (F.col("size_a") + F.col("size_b") - F.col("inter"))


def all_pairs(members: DataFrame) -> DataFrame:
    """Pairs a < b of each small group's members (key, rep, label) that have different labels."""
    x = members.select("key", F.col("rep").alias("a"), F.col("label").alias("label_a"))
    y = members.select("key", F.col("rep").alias("b"), F.col("label").alias("label_b"))
    return x.join(y, "key").filter("a < b and label_a != label_b").select("a", "b").distinct()


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with ``label``: the component that ``rep`` is known to be in."""
    if labels is None:
        return rows.withColumn("label", F.col("rep"))
    roots = labels.select(F.col("node").alias("rep"), "root")
    return rows.join(roots, "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")


def _counted(rows: DataFrame) -> DataFrame:
    """The rows (key, rep, label ...) of the groups with two labels or more, and their size n."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.join(sizes.filter("low != high").select("key", "n"), "key")


def _prefixes(near: DataFrame, percent: int) -> DataFrame:
    """The elements by which documents near a pivot can meet ones that do not link with it: one
    row for each level of the other side for which the element is early enough."""
    t, c = percent / 100, (100 - percent) / (100 + percent)
    rows = near.select(
        F.col("a").alias("pivot"), F.col("b").alias("rep"), F.col("size_a").alias("p"), F.col("size_b").alias("s"),
        F.size("difference").alias("d"), "loose", "label", F.explode("difference").alias("element"),
    )
    # an element that no loose document shares meets nothing: such ones come first and only count as places
    counts = rows.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("n"), F.max("loose").alias("some"))
    shared = materialize(counts.filter("n > 1 and some").select("pivot", "element", "n"))
    hot = hot_from_counts(shared, ["pivot", "element"])
    met = join_hot(rows, shared, ["pivot", "element"], "rep", hot)
    by_doc = Window.partitionBy("pivot", "rep")
    met = met.withColumn("place", F.col("d") - F.count(F.lit(1)).over(by_doc) + F.row_number().over(by_doc.orderBy("n", "element")))
    met = met.withColumn("g", F.expr(f"greatest(cast(floor({2 * c / LEVELS} * p) as bigint), 1L)"))
    room = f"{c} * (s + s / {t})"
    levels = F.expr(f"sequence(greatest(cast(floor((d - {room}) / g) as bigint), 0L), cast(floor((d + {room}) / g) as bigint))")
    least = f"greatest(ceil((greatest(g * l, 1) + d - {c} * (s + least(s / {t}, p + g * l + g - 1))) / 2 - 1e-9), 1)"
    fits = F.expr(f"filter(levels, l -> {least} <= g * l + g - 1 and place <= d - {least} + 1)")
    return met.withColumn("levels", levels).withColumn("other", F.explode(fits)).drop("levels")


def by_difference(near: DataFrame, percent: int, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) among the documents near each pivot (step 3 above), one of them not known
    to be in its component, and the keys that are frequent on both sides, as groups (key, rep, core).

    ``near`` has label and loose (not that of the pivot); ``hot`` are its hot pivots. Documents are
    dealt out anew before their differences are taken apart, as one pivot may have most of them.
    """
    t, c = percent / 100, (100 - percent) / (100 + percent)
    hubs = near.filter("loose").select("a").distinct()
    dealt = join_hot(near, hubs, ["a"], "b", hot)
    met = materialize(_prefixes(dealt.repartition("a", "b"), percent))
    level = F.floor(F.col("d") / F.col("g"))
    # a loose y does not link with the pivot: |D(y)| > K(p, y), so levels below that have none
    x = met.filter(f"g * other + g - 1 > {c} * (p + {t} * s) - 1e-9").select(
        F.xxhash64("pivot", "element", level.alias("lx"), F.col("other").alias("ly")).alias("key"), F.col("rep").alias("x"),
        F.col("d").alias("dx"), F.col("s").alias("sx"), F.col("place").alias("px"), F.col("label").alias("label_x"), (~F.col("loose")).alias("core"),
    )
    y = met.filter("loose").select(
        F.xxhash64("pivot", "element", F.col("other").alias("lx"), level.alias("ly")).alias("key"), F.col("rep").alias("y"),
        F.col("d").alias("dy"), F.col("s").alias("sy"), F.col("place").alias("py"), F.col("label").alias("label_y"),
    )
    counts = x.groupBy("key").agg(F.count(F.lit(1)).alias("nx")).join(y.groupBy("key").agg(F.count(F.lit(1)).alias("ny")), "key")
    heavy = materialize(counts.filter(F.least("nx", "ny") > HEAVY).select("key"))
    light_x, light_y = x, y
    members = x.select("key", F.col("x").alias("rep"), "core")
    groups = members.limit(0)
    if not heavy.isEmpty():
        light_x, light_y = (side.join(heavy, "key", "left_anti") for side in (x, y))
        members = members.unionByName(y.select("key", F.col("y").alias("rep"), F.lit(False).alias("core")))
        groups = members.join(heavy, "key", "left_semi").groupBy("key", "rep").agg(F.min("core").alias("core"))
    common = f"greatest(ceil((dx + dy - {c} * (sx + sy)) / 2 - 1e-9), 1)"
    fits = F.expr(f"label_x != label_y and px <= dx - {common} + 1 and py <= dy - {common} + 1")
    pairs = light_x.join(light_y, "key").filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.distinct(), groups


def with_pivots(groups: DataFrame, count: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Up to ``count`` pivots of each group (key, pivot), and, given them, every other member's
    meetings with them (key, rep, core, pivot). Members outside the core go first, then those in
    most groups."""
    reach = groups.groupBy("rep").agg(F.count(F.lit(1)).alias("reach"))
    slot = F.pmod(F.xxhash64("rep"), F.lit(count)).alias("slot")
    first = F.struct(~F.col("core"), "reach", -F.col("rep"))
    pivots = groups.join(reach, "rep").groupBy("key", slot).agg(F.max_by("rep", first).alias("pivot")).select("key", "pivot")
    return pivots, lambda chosen: groups.join(chosen, "key").filter("rep != pivot")


def labels_of(known: DataFrame) -> DataFrame:
    """(node, root) from the links of pivots (a) with others (b): equal roots mean one component.

    Pivots take the least label of their members, and those the least of their pivots, twice;
    what is only joined by longer ways keeps several labels, which costs work and no links.
    """
    low = known.groupBy("b").agg(F.min("a").alias("m"))
    hubs = known.join(low, "b").groupBy("a").agg(F.least(F.min("m"), F.col("a")).alias("m"))
    members = known.join(hubs, "a").groupBy("b").agg(F.min("m").alias("m"))
    every = hubs.select(F.col("a").alias("node"), "m").unionByName(members.select(F.col("b").alias("node"), "m"))
    return every.groupBy("node").agg(F.min("m").alias("root"))


def with_labels(near: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``near`` with the label of b, and whether a, which may be hot, has another one."""
    rows = labelled(near.withColumnRenamed("b", "rep"), labels).withColumnRenamed("rep", "b")
    pivots = near.select("a").distinct()
    hubs = labelled(pivots.withColumnRenamed("a", "rep"), labels).select(F.col("rep").alias("a"), F.col("label").alias("hub_label"))
    met = join_hot(rows, hubs, ["a"], "b", hot)
    return met.withColumn("loose", F.col("label") != F.col("hub_label")).drop("hub_label")


def turn_of(
    large: DataFrame, n: int, known: DataFrame | None, texts: DataFrame, signed: DataFrame, width: int, percent: int, turn: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One turn of pivots over the ``n`` rows of large groups (key, rep, core), with the links known:
    links known after it, further candidates, and the large groups that are left."""
    threshold = percent / 100
    bands = bands_for(threshold)
    resolved = 1 - threshold + NEAR  # what links with such a document is itself near the pivot
    with scratch():
        count = MORE_PIVOTS ** max(0, turn - 1)
        pivots, meetings = with_pivots(large, count)
        pivots, n = materialize(pivots, rows=n), n * count
        seats = materialize(meetings(pivots), rows=n)
        star = materialize(seats.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), rows=n)
        hot = hot_keys(star, ["a"])
        near = compare(prune(star, hot, signed, NEAR, bands), hot, texts, width, percent, NEAR)
        near = materialize(near.withColumn("links", linked(percent)), rows=n)
        found = near.filter("links").select("a", "b")
        known = kept_table(known.unionByName(found).distinct() if known else found, rows=n)
        labels = materialize(labels_of(known), rows=n)
        met, heavy = by_difference(with_labels(near, labels, hot), percent, hot)
        judged = near.filter(F.col("inter") >= resolved * (F.col("size_a") + F.col("size_b") - F.col("inter")))
        judged = judged.select(F.col("a").alias("pivot"), F.col("b").alias("rep"))
        settled = seats.join(judged, ["pivot", "rep"], "left_semi").select("key", "rep")
        settled = settled.unionByName(pivots.withColumnRenamed("pivot", "rep")).distinct()
        rest = labelled(large.join(settled, ["key", "rep"], "left_anti"), labels)
        if not turn:  # linked documents share two bands, but for the miss probability
            rest = materialize(_counted(rest), rows=n)
            split = rest.filter(F.col("n") > FEW).join(signed.select("rep", F.explode("bands").alias("other")), "rep")
            both = F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key")
            split = split.filter("key != other").select(both, "rep", "core", "label").distinct()
            rest = rest.filter(F.col("n") <= FEW).drop("n").unionByName(split)
        groups = materialize(_counted(rest.unionByName(labelled(heavy, labels))))
        few = all_pairs(groups.filter(F.col("n") <= FEW))
        more = kept_table(met.unionByName(few).distinct())
        return known, more, kept_table(groups.filter(F.col("n") > FEW).select("key", "rep", "core"))


def links(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes that connect each component."""
    bands = bands_for(percent / 100)
    keys = labelled(signed.select("rep", F.explode("bands").alias("key")), None)
    members = materialize(_counted(keys))
    pairs, known = all_pairs(members.filter(F.col("n") <= SMALL)), None
    large, turn = members.filter(F.col("n") > SMALL).select("key", "rep", F.lit(False).alias("core")), 0
    crowd = materialize(large.select("rep").distinct())
    some, _ = sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("doc_id"), crowd, F.col("rep"))
    texts = materialize(some.join(crowd, F.col("doc_id") == F.col("rep"), "left_semi"))
    signs = materialize(signed.join(crowd, "rep", "left_semi"))
    while n := large.count():
        known, more, large = turn_of(large, n, known, texts, signs, width, percent, turn)
        pairs, turn = pairs.unionByName(more), turn + 1
    pairs = materialize(pairs.distinct())
    hot, n = hot_keys(pairs, ["a"]), pairs.count()
    pruned = materialize(prune(pairs, hot, signed, percent / 100, bands), rows=n)
    out = materialize(compare(pruned, hot, sieved(docs, pruned), width, percent).select("a", "b"), rows=n)
    return out.unionByName(known) if known else out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by large-star and small-star steps.

    A hub's neighbours never meet in a task: minima are summed up before the shuffle, and the
    hubs' are joined back with their neighbours dealt out.
    """
    edges = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v")
    edges = materialize(edges.distinct(), rows=edges.count())
    mark, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), rows=2 * n)
        met = join_hot(both, low.select("u", "m"), ["u"], "v", hot_from_counts(low, ["u"]))
        large = materialize(met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), rows=2 * n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")  # each u has its neighbours' minima here, few ones
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u != v").distinct(), rows=2 * n)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, n = now, now[0]


def near_dedup(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = materialize(signatures(docs, width, percent / 100))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    with scratch():
        reps = full.withColumnRenamed("doc_id", "rep").join(classes.select("set_key", "rep"), ["rep", "set_key"], "left_semi")
        reps = materialize(reps.select("rep", "set_key", "signature", "bands").dropDuplicates(["rep", "set_key"]).drop("set_key"))
        edges = links(docs, reps, width, percent)
        roots = kept_table(components(edges), rows=edges.count())
    total = signed.count()
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = materialize(named.filter("copies > 1 or root != rep").select("set_key", "root", "copies"))
    hot = F.col("copies") * HOT > total
    rows = signed.select("doc_id", "n_shingles", "set_key", (F.col("n_shingles") > 0).alias("full"))
    # at most HOT classes have more than 1/HOT of all rows: a proven bound for the broadcast
    marked = rows.join(F.broadcast(named.filter(hot)), "set_key", "left")
    cold = marked.filter("root is null").drop("root", "copies").join(named.filter(~hot), "set_key", "left")
    out = marked.filter("root is not null").unionByName(cold)
    component = F.when(F.col("full") & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``docs``, all columns, of the document that stays of each component."""
    found = near_dedup(docs, width, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = found.filter("not kept").select(F.col("doc_id").alias("id"))
    told = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"))
    gone = materialize(gone)
    some, rest = sifted(told, F.col("id"), gone, F.col("id"))
    return some.join(gone, "id", "left_anti").unionByName(rest).select("doc.*")
