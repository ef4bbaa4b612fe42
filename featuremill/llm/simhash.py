"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in ``max_bits`` bits differ in as many bytes
at most, so they share ``8 - max_bits`` positional bytes at least: the guaranteed minimum matches. Posting lists of a
single (position, byte) grow with the corpus, so the index posts combinations of positions, one fewer than the minimum:
any pair that reaches the minimum meets there. For each pair that meets, the shared positional bytes are tallied; pairs
below the minimum are dropped, the others are reported in one list (that of their first matching positions) and
verified by counting the differing bits.

Copies have the same fingerprint and count once. Lists up to ``LIST`` are joined with themselves. The members of longer
lists are posted again by one position more, which any pair with the minimum shares, too. Lists of the minimum that are
still longer are dense, and their members are linked through shared points instead: each dense fingerprint meets all
points within half of ``max_bits``, two of them are within ``max_bits`` exactly if they share a point, and every point
links its members to the least of them. That is linear in the members, however large the list.

Defined cases: null or empty text has fingerprint zero and is linked like any other; a component's id is its least
doc_id (null only if all its ids are); equal rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, parts, sized, table, written
from .components import components

SEED = 42
#: The longest posting list whose pairs are compared one by one. A dense fingerprint costs 2,081 points instead.
LIST = 256
#: Lists (two numbers each) up to which those of three and more are broadcast; beyond it the join shuffles.
BROADCAST_LISTS = 500_000


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit fingerprint of ``text`` as an unsigned number."""
    ws = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six ASCII separators only
    if not ws:
        return 0
    shingles = list(map(b" ".join, zip(*[ws[k:] for k in range(words)]))) if len(ws) >= words else [b" ".join(ws)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(h), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << 8 * p for p in positions))


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _tally(a: Column, b: Column) -> Column:
    """How many positional bytes the two share."""
    same = [F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(_byte_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)]
    return reduce(lambda x, y: x + y, same)


def _first_shared(a: Column, b: Column, n: int) -> Column:
    """The mask of the first ``n`` positions at which the two agree."""
    mask, tally = F.lit(0).cast("long"), F.lit(0)
    for p in range(8):
        same = a.bitwiseXOR(b).bitwiseAND(F.lit(_byte_mask((p,)))) == 0
        mask = F.when(same & (tally < n), mask.bitwiseOR(F.lit(_byte_mask((p,))))).otherwise(mask)
        tally = F.when(same, tally + 1).otherwise(tally)
    return mask


def meetings(members: DataFrame, positions: int) -> DataFrame:
    """(u, v) of the pairs of each list of ``members`` (mask, key, fp), each in the list of its first ``positions`` shared bytes."""
    a, b = members.select("mask", "key", F.col("fp").alias("u")), members.select("mask", "key", F.col("fp").alias("v"))
    return a.join(b, ["mask", "key"]).filter("u < v").filter(F.col("mask") == _first_shared(F.col("u"), F.col("v"), positions)).select("u", "v")


def _posted(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): ``fps`` (fp) in the lists of all ``masks``."""
    return fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _members(posted: DataFrame) -> DataFrame:
    """(mask, key, fp, n) of the lists of two and more."""
    lists = posted.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.max("fp").alias("last"))
    lists = written(lists.filter("n > 1"), "lists")
    # the members of a list of two are its least and largest
    two = lists.filter("n = 2").select("mask", "key", F.explode(F.array("fp", "last")).alias("fp"), "n")
    long = lists.filter("n > 2").select("mask", "key", "n")
    out = written(two.union(posted.join(sized(long, long.count(), BROADCAST_LISTS), ["mask", "key"]).select("mask", "key", "fp", "n")), "members")
    drop(lists)
    return out


def near_links(distinct: DataFrame, max_bits: int = 4, longest: int = LIST) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp). Pairs of dense lists may be joined by way of others."""
    if max_bits not in (2, 4):
        raise ValueError("max_bits is 2 or 4")
    least = 8 - max_bits
    masks = lambda n: [_byte_mask(c) for c in combinations(range(8), n)]
    lists = _members(_posted(distinct, masks(least - 1)))
    met = [meetings(lists.filter(F.col("n") <= longest), least - 1)]
    dense, links = lists.filter(F.col("n") > longest).select("mask", "fp"), []
    if not dense.isEmpty():
        # the masks of one position more that hold the list's mask
        more = F.filter(F.array(*[F.lit(m) for m in masks(least)]), lambda m: m.bitwiseAND(F.col("mask")) == F.col("mask"))
        again = dense.select("fp", F.explode(more).alias("mask")).distinct().select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        lists = _members(written(again, "posted"))
        met.append(meetings(lists.filter(F.col("n") <= longest), least))
        dense = lists.filter(F.col("n") > longest).select("fp").distinct()
        if not dense.isEmpty():
            links.append(_through_points(dense, max_bits))
    u, v = F.col("u"), F.col("v")
    links.append(reduce(DataFrame.union, met).filter(_tally(u, v) >= least).filter(_near(u, v, max_bits)))
    return reduce(DataFrame.union, links)


def _through_points(dense: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): links that join any two of ``dense`` (fp) within ``max_bits``, by way of the points half as far from both."""
    bits = [0, *(_signed(1 << i) for i in range(64))]
    points = [reduce(lambda x, y: x ^ y, c) for c in ([(x,) for x in bits] if max_bits == 2 else [(0,), *combinations(bits, 2)])]
    near = dense.select("fp", F.explode(F.array(*[F.lit(p) for p in dict.fromkeys(points)])).alias("p")).select("fp", F.col("fp").bitwiseXOR(F.col("p")).alias("z"))
    centres = near.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return near.join(centres, "z").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    found = written(fingerprints(docs, words), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # dealt out anew, as what is written comes in few files and each row is posted many times
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = written(components(near_links(classes.select("fp").repartition(n, "fp"), max_bits)), "roots")
    # only linked fingerprints pass through the joins by component; the others are their own component
    linked = written(roots.join(classes, roots.node == classes.fp).select("node", "root", "least"), "linked")
    ids = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = linked.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    own = written(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    for gone in (classes, roots, linked, ids):
        drop(gone)
    return found.join(own, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
