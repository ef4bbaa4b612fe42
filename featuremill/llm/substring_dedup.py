"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

Every document is a reference block: a factor is a run of words of a document that a block holds at some place, written
(block, position, length). The index holds every window of ``SPAN`` words that occurs twice, with the least place and the
largest one where it stands, so that each occurrence has a place elsewhere. Blocks are the texts with repeated seeds,
numbered densely; a place is one number, the block's, then the position, up to ``MOST_AT`` (later ones are written as it).
A document is parsed greedily from the left:
a factor starts at the first window that the index knows, copies from that window's place, and grows by a word as long as
the window that ends with that word is known at the following position of the same block; where it is known in another
place, the next factor begins. Windows across such a boundary are in the index like all others, so none is missed: a
factor's window may reach back into the words of the one before it. Words that a factor covers are the duplicate spans.

Following every block's own longest match would need all places of a window, which are as many as its copies; one place
elsewhere tells the same words, as a word goes if any window that covers it occurs elsewhere.

Rows are known by their texts alone (two hashes of 64 bits), as rows of one text have one result, whatever their ids; such a
text is indexed once: all its windows occur elsewhere. Three steps keep the index small for the
others. (1) Every window picks its least hashed ``SEED``-word seed; windows with equal
words pick equal seeds, so that a window can only occur twice if its seed is chosen at two places. About one word in
fifteen is a chosen seed; seeds are counted by a grouped sum. (2) Documents with repeated seeds emit the 96-bit hashes
of the windows that picked those seeds, two polynomials over two independent hashes of each word, which stand for the words; hashes met twice are
joined back to their places. (3) Places are gathered per document and the document is parsed. Common passages are
counted before any shuffle and joined from written tables, where Spark splits skewed keys; no step holds more than one
document's places together.

Defined cases: null text has no words; documents of fewer than ``SPAN`` words keep everything; equal rows are two
documents and lose their windows both; null and shared ids change nothing; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, numbered, sized, table, written

SPAN, SEED = 35, 8
#: Bits of a position; the other 36 of a place are the block's number.
AT_BITS = 28
MOST_AT = (1 << AT_BITS) - 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes.split: the six ASCII separators only


def _rolled(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of every run of ``k`` entries of ``h``."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for t in range(1, k):
        out *= base
        out += h[t : t + n]
    return out ^ (out >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = best(x[:-size], x[size:]), 2 * size
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def _other_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def seeds(h: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(the seed picked by each window, the seeds at all places that some window picks) for word hashes ``h``."""
    grams = _rolled(h, seed, _BASES[0]) * np.uint64(0xFF51AFD7ED558CCD)
    grams ^= grams >> np.uint64(33)
    width = span - seed + 1
    picked = _sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate([edge, picked, edge]), width, np.maximum) == grams
    return picked, grams[chosen]


def _emit_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, counts, owners = [], [], []
        for k, text in enumerate(batch.column(2)):
            ws = _words(text.as_py())
            if len(ws) < SPAN:
                continue
            value, count = np.unique(seeds(_hashes(ws))[1], return_counts=True)
            values.append(value)
            counts.append(count * (2 if batch.column(3)[k].as_py() else 1))
            owners.append(np.full(len(value), k))
        if values:
            owner = pa.array(np.concatenate(owners))
            columns = [pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32)), batch.column(0).take(owner), batch.column(1).take(owner)]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "n", "x", "mark"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (text, known) in enumerate(zip(batch.column(1), batch.column(2))):
            ws = _words(text.as_py())
            h = _hashes(ws)
            at = np.flatnonzero(np.isin(seeds(h)[0], np.asarray(known.values.to_numpy(zero_copy_only=False)).view(np.uint64)))
            if not len(at):
                continue
            a, b = (_rolled(x, SPAN, base)[at] for x, base in zip((h, _other_hashes(ws)), _BASES))
            owner = pa.array(np.full(len(at), k))
            columns = [pa.array(a.view(np.int64)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(owner), pa.array(at.astype(np.int32)), batch.column(3).take(owner)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "block", "at", "copied"])


Factor = tuple[int, int, int, int]


def factors(places: list[tuple[int, int]], span: int = SPAN) -> list[Factor]:
    """(block, position in it, start, length) of the greedy factors; ``places``: (start, place elsewhere) of the known windows."""
    out: list[Factor] = []
    for at, place in sorted(places):
        block, position = place >> AT_BITS & (1 << 64 - AT_BITS) - 1, place & MOST_AT
        if out:
            b, p, s, n = out[-1]
            # the last window of the factor before starts one word earlier, here and in the block
            if b == block and at == s + n - span + 1 and position == p + n - span + 1:
                out[-1] = (b, p, s, n + 1)
                continue
        out.append((block, position, at, span))
    return out


def covered(found: list[Factor]) -> list[tuple[int, int]]:
    """(start, length) of the runs of words that the factors cover."""
    out: list[tuple[int, int]] = []
    for _, _, s, n in found:
        if out and s <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), s + n) - out[-1][0])
        else:
            out.append((s, n))
    return out


def copied_texts(rows: DataFrame) -> DataFrame:
    """(x, mark, first): hashes of the texts that several rows have, and the least doc_id."""
    copies = rows.filter(F.col("text").isNotNull()).groupBy("x", "mark").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return written(copies.filter("copies > 1").select("x", "mark", "first"), "copies")


def repeated_windows(rows: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((x, mark, block), (block, places)): the blocks of texts, and of each block with repeats its windows that occur
    elsewhere, too: (at, place elsewhere).

    All windows of a copied text do; the rows of it with the least doc_id stand for them in the index and need no places."""
    joined = rows.join(sized(copies.withColumn("copied", F.lit(True)), copies.count()), ["x", "mark"], "left")
    rows = joined.filter(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select("x", "mark", "text", F.coalesce("copied", F.lit(False)).alias("copied"))
    found = written(rows.mapInArrow(_emit_seeds, "seed long, n int, x long, mark long"), "seeds")
    again = written(found.groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed"), "again")
    # equal rows have the same seeds: a set
    owned = numbered(found.join(again, "seed").groupBy("x", "mark").agg(F.collect_set("seed").alias("known")), [], "block")
    drop(found)
    seen = rows.join(owned, ["x", "mark"]).select("block", "text", "known", "copied")
    windows = written(seen.mapInArrow(_emit_windows, "a long, b int, block long, at int, copied boolean"), "windows")
    blocks = written(owned.select("x", "mark", "block"), "blocks")
    drop(owned)
    place = F.shiftleft("block", AT_BITS).bitwiseOR(F.least("at", F.lit(MOST_AT)).cast("long"))
    twice = windows.groupBy("a", "b").agg(F.sum(F.when(F.col("copied"), 2).otherwise(1)).alias("n"), F.min(place).alias("least"), F.max(place).alias("last"))
    twice = written(twice.filter("n > 1").select("a", "b", "least", "last"), "twice")
    places = windows.filter(~F.col("copied")).join(twice, ["a", "b"])
    other = F.when(place == F.col("least"), F.col("last")).otherwise(F.col("least"))
    places = written(places.select("block", "at", other.alias("other")), "places")
    drop(windows)
    drop(twice)
    out = written(places.groupBy("block").agg(F.collect_set(F.struct("at", "other")).alias("places")), "factors")
    drop(places)
    return blocks, out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, block long, factors array<struct<block:long,position:int,start:int,length:int>>"
_FACTOR = pa.struct([("block", pa.int64()), ("position", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])


def _parse(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, places, copied, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ws = _words(text.as_py())
                found: list[Factor] = []
                if copied and len(ws) >= SPAN:
                    found = [(block, 0, 0, len(ws))]
                elif places.is_valid:
                    found = factors(list(zip(*(x.to_pylist() for x in places.values.flatten()))))
                keep, at = [], 0
                for s, n in covered(found):
                    keep += ws[at:s]
                    at = s + n
                keep += ws[at:]
                kept = b" ".join(keep)
                row = {"doc_id": doc_id, "n_words": len(ws), "n_removed": len(ws) - len(keep), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                out.append(row | ({"kept": kept.decode(), "block": block, "factors": [dict(zip(("block", "position", "start", "length"), f)) for f in found]} if full else {}))
            schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
            schema += [("kept", pa.string()), ("block", pa.int64()), ("factors", pa.list_(_FACTOR))] * full
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(schema))

    return run


def dedup_substrings(docs: DataFrame, full: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; with ``full`` also the kept text, the text's block (null: it has no
    repeated seed) and the factors.

    A factor's block is the ``block`` of rows that hold its words at ``position``. A copied text is one factor of its own block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(SEED), "text").alias("mark"), "text")
    copies = copied_texts(rows)
    blocks, found = repeated_windows(rows, copies)
    known = blocks.join(found, "block", "left").select("x", "mark", "block", "places")
    marked = copies.select("x", "mark", F.lit(True).alias("copied"))
    joined = rows.join(known, ["x", "mark"], "left").join(sized(marked, copies.count()), ["x", "mark"], "left")
    return joined.select("doc_id", "text", "places", "copied", "block").mapInArrow(_parse(full), RESULT if full else RESULT.split(", kept string")[0])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), full=False)
