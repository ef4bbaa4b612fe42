"""Exact Jaccard join of word shingle sets by signature trees.

A document's set is its distinct shingles; documents of equal sets are one class, told apart by a 64-bit hash. Before any tree, two exact bounds
leave out classes that cannot have a partner. A partner lacks a fifth of a set's shingles at most, so a class goes if more are in
no other class: first counted among the shingles whose hash is in the lowest third, then, of what is left, among all. The rest
have their shingles in one order, the rarest first: two similar sets share one of the first fifth and one (less those that
no other class has).

The trees: classes are leaves, with a bitmap of their shingles and their size. A directory of lists, one per shingle of those first
ones, proposes a centre per list, the member with the most company; classes linked to a centre (verified) make a cluster.
A cluster is a tree: its classes by size, ``FAN`` to a node, nodes ``FAN`` to a node, and so on; each node holds the bitwise OR of its
bitmaps, the range of its sizes, and the least overlap of bits that any of its classes needs (alone, and for a size of the other side). Roots of clusters that share
a list meet; a dual traversal follows pairs of nodes down, one side after the other, and leaves out each pair whose sizes
are too far apart or whose bitmaps share fewer bits than the maximum overlap would have to: what remains at the leaves is verified on whole
sets. Pairs within a cluster need no look, as they are linked; before clusters of more than a class meet in full, one pair of their classes is tried, which
joins most clusters that belong together.

Near copies, however many, thus cost a comparison each. What can cost a comparison a pair is a crowd of classes of like size that share
the rarest fifth of their shingles and most bits, and yet are not similar: then the leaves of the traversal are pairs, in
tasks of their own, and none is dropped.

Defined cases: words are split at ASCII white space, A-Z count as a-z; a text of fewer words than a shingle is one shingle; a text
without words (null, too) has an empty set, is linked with nothing and is its own component; a component's id is its least
doc_id, null only if all its ids are; equal rows keep a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, numbered, parts, sized, table, written
from .components import components

#: Least similarity as a fraction.
OVER, UNDER = 4, 5
FAN_BITS, LONGS = 4, 32
#: The share of hashes counted first.
LOW = np.uint64((1 << 64) // 3)
BITS = [f"b{k}" for k in range(LONGS)]
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles: polynomials over 64-bit hashes of the words."""
    ws = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII separators only
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n, k = max(1, len(ws) - words + 1), min(words, len(ws))
    out = h[:n].copy()
    for t in range(1, k):
        out *= _BASE
        out += h[t : t + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[(h % np.uint64(64 * LONGS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _sampled(words: int):
    """text to (n, id, some): the size, the class and the hashes in the lowest third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            some = [h[: np.searchsorted(h, LOW)].view(np.int64) for h in sets]
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([set_id(h) if len(h) else None for h in sets], pa.int64()), pa.array(some, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "t", "n", "id", "some"])

    return run


def _whole(words: int):
    """text to (id, n, pop, all, bits): the whole set and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            bits = np.array([bitmap(h) for h in sets]).reshape(-1, LONGS)
            pop = np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=1, dtype=np.int64)
            columns = [pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(pop), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
            columns += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LONGS)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "pop", "all", *BITS])

    return run


def _not_alone(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``classes`` (id, n) of whose shingles no more than a fifth can be in no other class, by the sample in ``rows`` (id, some)."""
    seen = rows.filter("n > 0").select("id", F.explode("some").alias("h")).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    lone = seen.filter("id = other").groupBy("id").agg(F.count("*").alias("lone"))
    return classes.join(lone, "id", "left").filter(UNDER * F.coalesce("lone", F.lit(0)) <= (UNDER - OVER) * F.col("n")).drop("lone")


def _posted(sets: DataFrame) -> DataFrame:
    """(h, id): each class under the rarest of its shingles, as many as one of them must be shared."""
    tokens = sets.select("id", "n", F.explode("all").alias("h"))
    often = written(tokens.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    own = tokens.join(often, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("shared"))
    # a set of n may lack n / 5; those that no other class has are among the first of its order
    first = F.floor(F.col("n") / UNDER).cast("int") + 1 - (F.col("n").cast("int") - F.size("shared"))
    posts = own.filter(first > 0).select("id", F.explode(F.slice("shared", F.lit(1), first)).alias("x")).select("x.h", "id")
    out = written(posts, "posts")
    drop(often)
    return out


def _sizes_allow(a: str, b: str) -> Column:
    return (UNDER * F.col(f"{a}.hi") >= OVER * F.col(f"{b}.lo")) & (UNDER * F.col(f"{b}.hi") >= OVER * F.col(f"{a}.lo"))


def _may(a: str, b: str) -> Column:
    """Whether some class of node ``a`` can be similar to one of node ``b``, by sizes and bitmaps.

    A set of n with a partner of m lacks (5 n - 4 m) / 9 of its shingles there at most, so as many of its bits may be missing
    from the bits that the two nodes share."""
    both = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{k}").bitwiseAND(F.col(f"{b}.{k}"))) for k in BITS])
    enough = [both >= F.col(f"{x}.need") for x in (a, b)] + [(UNDER + OVER) * both >= F.col(f"{x}.least") + OVER * F.col(f"{y}.lo") for x, y in ((a, b), (b, a))]
    return _sizes_allow(a, b) & reduce(Column.__and__, enough)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of the distinct ``pairs`` whose sets are similar. A written table."""
    u = sets.select(F.col("id").alias("u"), F.col("all").alias("x"))
    v = sets.select(F.col("id").alias("v"), F.col("all").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(u, "u").join(v, "v").withColumn("same", same)
    return written(joined.filter(UNDER * F.col("same") >= OVER * (F.size("x") + F.size("y") - F.col("same"))).select("u", "v"), "similar")


def _nodes(leaves: DataFrame, level: int | None) -> DataFrame:
    """Summaries of the nodes at ``level`` of the clusters' trees (None: their roots) over ``leaves`` (g, at, …)."""
    node = F.lit(0).cast("long") if level is None else F.shiftright("at", FAN_BITS * level)
    return leaves.groupBy("g", node.alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("need").alias("need"), F.min("least").alias("least"), *[F.bit_or(b).alias(b) for b in BITS])


def _traversed(tops: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(u, v): the pairs of classes that a dual traversal from the pairs ``tops`` (g, other) of clusters leaves. Written."""
    now = tops.select(F.col("g").alias("ag"), F.lit(0).cast("long").alias("an"), F.col("other").alias("bg"), F.lit(0).cast("long").alias("bn"))
    above = written(_nodes(leaves, None), "nodes")
    for level in range(depth, -1, -1):
        nodes = written(_nodes(leaves, level) if level else leaves.withColumn("node", F.col("at")), "nodes")
        parent = F.lit(0).cast("long") if level == depth else F.shiftright("node", FAN_BITS)
        kids = nodes.withColumn("parent", parent)
        # one side after the other: the children of a against b, then those that are left against the children of b
        a, b = kids.alias("a"), above.alias("b")
        left = now.join(a, (F.col("ag") == F.col("a.g")) & (F.col("an") == F.col("a.parent"))).join(b, (F.col("bg") == F.col("b.g")) & (F.col("bn") == F.col("b.node"))).filter(_may("a", "b"))
        left = written(left.select("ag", F.col("a.node").alias("an"), "bg", "bn"), "left")
        own, other = nodes.alias("a"), kids.alias("b")
        both = left.join(own, (F.col("ag") == F.col("a.g")) & (F.col("an") == F.col("a.node"))).join(other, (F.col("bg") == F.col("b.g")) & (F.col("bn") == F.col("b.parent"))).filter(_may("a", "b"))
        found = both.select("ag", F.col("a.node").alias("an"), "bg", F.col("b.node").alias("bn")) if level else both.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
        found = written(found, "traversed")
        drop(left)
        drop(above)
        if level < depth:
            drop(now)
        now, above = found, nodes
    drop(above)
    return now


def _clusters(links: DataFrame) -> DataFrame:
    """(id, g) of the classes with a link. Written."""
    return written(components(links).select(F.col("node").alias("id"), F.col("root").alias("g")), "clusters")


def similar_classes(sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, root) of the classes that are linked; ``sets``: (id, n, pop, all, bits), distinct ids, written. ``known``: links
    (u, v) that are verified already and written; no pair of classes that they join is looked at again."""
    posted = _posted(sets)
    sizes = posted.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = written(sizes, "lists")
    members = written(posted.join(sizes, "h"), "members")
    drop(posted)
    drop(sizes)
    company = written(members.groupBy("id").agg(F.sum("size").alias("company")).join(sets.select("id", "n"), "id"), "company")
    ranked = members.join(company, "id")
    centre = ranked.groupBy("h").agg(F.min_by(F.struct("id", "n"), F.struct((-F.col("company")).alias("c"), "id")).alias("centre"))
    centre = written(centre.select("h", F.col("centre.id").alias("centre"), F.col("centre.n").alias("m")), "centres")
    star = members.join(company.select("id", "n"), "id").join(centre, "h").filter("id <> centre").filter(UNDER * F.least("n", "m") >= OVER * F.greatest("n", "m"))
    star = star.select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()
    joined = _clusters(known) if known is not None else None
    if known is not None:
        mine, its = joined.select(F.col("id").alias("u"), F.col("g").alias("mine")), joined.select(F.col("id").alias("v"), F.col("g").alias("its"))
        star = star.join(mine, "u", "left").join(its, "v", "left").filter(F.coalesce(F.col("mine") != F.col("its"), F.lit(True))).select("u", "v")
    star = written(star, "star")
    links = _verified(star, sets)
    if known is not None:
        links = links.union(known)
        drop(joined)
    clusters = _clusters(links)

    # lists of several clusters, and the leaves of their trees
    named = members.select("h", "id").join(clusters, "id", "left").select("h", "id", F.coalesce("g", "id").alias("g"))
    entries = written(named.groupBy("h", "g").agg(F.min("id").alias("id")), "entries")
    several = written(entries.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "several")
    if not several.isEmpty():
        own = entries.join(several, "h", "left_semi")
        held = written(own.select("g").distinct(), "held")
        need = [(F.col("pop") - F.floor(F.col("n") / UNDER)).alias("need"), ((UNDER + OVER) * F.col("pop") - UNDER * F.col("n")).alias("least")]
        leaves = company.select("id").join(clusters, "id", "left").select("id", F.coalesce("g", "id").alias("g")).join(held, "g", "left_semi")
        leaves = leaves.join(sets, "id").select("g", "id", F.col("n").alias("lo"), F.col("n").alias("hi"), *need, *BITS)
        leaves = numbered(leaves, ["g", "lo", "id"], "at")
        roots = written(_nodes(leaves, None).drop("node"), "roots")
        met = written(own.join(roots, "g"), "met")
        a, b = met.alias("a"), met.alias("b")
        tops = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.g") < F.col("b.g")) & _may("a", "b"))
        tops = tops.select(F.col("a.g").alias("g"), F.col("b.g").alias("other"), F.col("a.id").alias("u"), F.col("b.id").alias("v"))
        tops = written(tops.groupBy("g", "other").agg(F.min(F.struct("u", "v")).alias("x")).select("g", "other", "x.u", "x.v"), "tops")
        # one pair of classes is tried first
        tried = _verified(tops.select("u", "v"), sets)
        links = links.union(tried)
        merged = _clusters(tried.join(tops, ["u", "v"]).select(F.col("g").alias("u"), F.col("other").alias("v")))
        left = tops.join(merged.select(F.col("id").alias("g"), F.col("g").alias("mine")), "g", "left").join(merged.select(F.col("id").alias("other"), F.col("g").alias("its")), "other", "left")
        left = left.filter(F.coalesce("mine", "g") != F.coalesce("its", "other")).select("g", "other")
        # a pair of single classes has been tried
        size = written(leaves.groupBy("g").agg(F.count("*").alias("size")), "sizes")
        left = left.join(size, "g").join(size.select(F.col("g").alias("other"), F.col("size").alias("n")), "other").filter("size > 1 OR n > 1")
        left = written(left.select("g", "other"), "open")
        if not left.isEmpty():
            most, depth = size.agg(F.max("size")).first()[0], 0
            while most > 1 << FAN_BITS * (depth + 1):
                depth += 1
            pairs = _traversed(left, leaves, depth)
            links = links.union(_verified(pairs, sets))
            drop(pairs)
        for gone in (held, leaves, roots, met, tops, merged, size, left):
            drop(gone)
        found = _clusters(links)
        drop(clusters)
        clusters = found
    for gone in (members, company, centre, star, entries, several, links):
        drop(gone)
    return clusters.select("id", F.col("g").alias("root"))


def _proposed(proposals: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of similar classes among those of the rows that ``proposals`` (doc_id, other) names. Written."""
    own = rows.filter("n > 0").select("doc_id", F.col("id").alias("a"))
    pairs = proposals.join(own, "doc_id").join(own.select(F.col("doc_id").alias("other"), F.col("a").alias("b")), "other").filter("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "proposed")
    found = _verified(pairs, sets)
    drop(pairs)
    return found


def similar_documents(docs: DataFrame, words: int = 5, proposals: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text). Runs all its jobs but the last join.

    ``proposals``: pairs of rows (doc_id, other) that another method takes for near copies. They are verified first, and the
    trees look for the links that these do not give; the result is the same with and without them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    rows = written(docs.mapInArrow(_sampled(words), "doc_id long, t long, n long, id long, some array<long>"), "rows")
    classes = rows.filter("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "t")).alias("row"))
    classes = written(classes, "classes")
    kept = written(_not_alone(rows, classes).select("id", "row.doc_id", "row.t"), "kept")
    # of each class left, the text of one row
    picked = kept.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    texts = docs.join(sized(picked, kept.count()), (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    schema = f"id long, n long, pop long, all array<long>, {', '.join(f'{b} long' for b in BITS)}"
    sets = written(texts.mapInArrow(_whole(words), schema), "sets")
    if sets.agg((F.count("id") > F.count_distinct("id")).alias("more")).first().more:  # rows alike in id and text
        single = written(sets.dropDuplicates(["id"]), "sets")
        drop(sets)
        sets = single
    known = None if proposals is None else _proposed(proposals, rows, sets)
    linked = similar_classes(sets, known)
    least = linked.join(classes.select("id", "least"), "id")
    roots = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    own = classes.join(least.select("id", "root").join(roots, "root").select("id", "component_id"), "id", "left")
    own = written(own.select("id", F.coalesce("component_id", "least").alias("component_id")), "named")
    for gone in (classes, kept, sets, linked, roots):
        drop(gone)
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").select("doc_id", "n", "id").join(own, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def similar_groups(docs: DataFrame, words: int = 5, proposals: DataFrame | None = None) -> DataFrame:
    """(key, group) of each row of ``docs`` (key of 0 and more, text); texts without words are one group. ``proposals``: (key, other)."""
    pairs = None if proposals is None else proposals.select(F.col("key").alias("doc_id"), "other")
    found = similar_documents(docs.select(F.col("key").alias("doc_id"), "text"), words, pairs)
    return found.select(F.col("doc_id").alias("key"), F.when(F.col("n_shingles") == 0, F.lit(-1)).otherwise(F.col("component_id")).alias("group"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
