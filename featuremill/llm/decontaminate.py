"""Benchmark decontamination by CGK embedding and bit sampling, with exact edit verification.

Items and documents are lower-cased words; an item of ``n`` words is found in a document if some stretch of it is at
word edit distance ``0.2 n`` at most. A CGK random walk embeds a window of ``n`` words as ``3 n`` words such that edit
distance becomes Hamming distance: the walk copies the current word and a random bit of (word, step) tells whether to
move on. Bit-sampling LSH compares a few random places of the embeddings, over and over with fresh walks; the number of
repetitions is raised until simulated edits of items at the full distance are found with the target recall. Pairs
of window and item that agree in a repetition are verified by the exact edit distance; where ``MOST_REPETITIONS`` do not
reach the target, every window is.

Which windows. A run is ``r`` successive words (three; fewer in items of up to five words). Each of ``k`` edits spoils
``r`` runs of an item at most, so of any ``r k + 1`` of its runs a stretch within the distance keeps one. Documents give
their runs that pass a sieve of all items' runs; runs are counted over the corpus, and each item is sought by its
``r k + 1`` rarest runs alone, in one join: one pass over the documents, whatever the number of items, and common phrases
lead nowhere. In the documents so found, places with as many runs of the item as any stretch within the distance keeps,
``n - r + 1 - r k`` inside ``n + k`` words, give the item-sized windows to embed, one for each start that a run implies.
This loses nothing and keeps the walk off the rest of the text.

Defined cases: null texts have no words; items without words or without an id are not searched; equal items count once;
equal rows each get their rows; null ids are kept; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, parts, sized, table, written
from .sieve import Sieve

RATE, RUN, SAMPLES, RECALL, MOST_REPETITIONS = 0.2, 3, 2, 0.995, 256
#: Items whose edits are simulated; words and items that a worker holds; groups that a document's items are cut into.
SIMULATED, HELD_WORDS, HELD_ITEMS, GROUPS = 32, 300_000, 5_000, 64
OUT = "doc_id long, item_id long, n_words long, distance long"
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w.encode())


class Hasher:
    """Word hashes of texts, with a bounded table."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        if new := set(ws).difference(self.known):
            if len(self.known) + len(new) > HELD_WORDS:
                self.known, new = {}, set(ws)
            self.known.update(zip(new, map(_hash, new)))
        return np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))


def run_length(n: int) -> int:
    """Words of a run of an item of ``n`` words, such that ``int(RATE * n)`` edits cannot spoil all runs."""
    return RUN if n > 5 else 2 if n == 5 else min(n, RUN)


def runs(h: np.ndarray, r: int) -> np.ndarray:
    """A hash of every ``r`` successive words."""
    n = max(0, len(h) - r + 1)
    out = np.full(n, r, np.uint64)
    for k in range(r):
        out = _mix(out + h[k : k + n])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def signatures(windows: np.ndarray, repetitions: int, samples: int = SAMPLES) -> np.ndarray:
    """(windows, repetitions): hashes of the sampled places of the walks over ``windows`` (rows of equal length)."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    rng = np.random.default_rng(n)
    places = rng.integers(0, 3 * n, (repetitions, samples))
    salt = _mix(np.arange(1, repetitions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, out, each = np.zeros((rows, repetitions), np.int64), np.zeros((rows, repetitions), np.uint64), np.arange(rows)[:, None]
    for step in range(int(places.max()) + 1):
        here = padded[each, at]
        for s in range(samples):
            if len(hit := np.flatnonzero(places[:, s] == step)):
                out[:, hit] = _mix(out[:, hit] + here[:, hit] * np.uint64(2 * s + 3))
        move = _mix(here + salt + np.uint64(step * 0xD6E8FEB86659FD93 % (1 << 64))) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), n)
    return out


def edit_search(item: list[int], text: list[int]) -> int:
    """The least edit distance of ``item`` and any stretch of ``text``, by bit vectors."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << n - 1
    equal: dict[int, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, now = full, 0, n
    best = n
    for c in text:
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh & full
        now += (ph & top > 0) - (mh & top > 0)
        best = min(best, now)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return best


def _edited(rng: np.random.Generator, item: np.ndarray, k: int) -> np.ndarray:
    out = item.tolist()
    for _ in range(k):
        i, kind, new = int(rng.integers(0, len(out))), rng.integers(0, 3), int(rng.integers(1, 1 << 62))
        out[i : i + 1] = {0: [new], 1: [new, out[i]], 2: []}[int(kind)]
    out = (out + rng.integers(1, 1 << 62, len(item)).tolist())[: len(item)]  # the text goes on after it
    return np.array(out, np.uint64)


def needed_repetitions(items: list[np.ndarray], target: float = RECALL, copies: int = 24) -> int | None:
    """Repetitions after which a share of ``target`` of simulated copies at the full distance agrees at least once; None
    if ``MOST_REPETITIONS`` are not enough."""
    rng = np.random.default_rng(7)
    found = []
    for item in items:
        windows = np.array([item, *[_edited(rng, item, int(RATE * len(item))) for _ in range(copies)]])
        s = signatures(windows, MOST_REPETITIONS)
        agree = s[1:] == s[0]
        found.append(np.where(agree.any(axis=1), agree.argmax(axis=1), MOST_REPETITIONS) + 1)
    if not found:
        return 1
    needed = int(np.quantile(np.concatenate(found), target, method="higher"))
    return needed if needed <= MOST_REPETITIONS else None


class Item:
    """An item, ready for the search."""

    def __init__(self, h: np.ndarray, repetitions: int | None):
        self.h, self.n = h, len(h)
        self.k, self.r = int(RATE * self.n), run_length(self.n)
        own = runs(h, self.r)
        order = np.argsort(own, kind="stable")
        self.runs, self.at = own[order], order
        self.need = self.n - self.r + 1 - self.r * self.k
        self.signed = None if repetitions is None else signatures(h[None, :], repetitions)[0]

    def starts(self, text_runs: np.ndarray) -> np.ndarray:
        """Starts of the windows where enough of the item's runs stand together."""
        first = np.searchsorted(self.runs, text_runs, "left")
        many = np.searchsorted(self.runs, text_runs, "right") - first
        place = np.flatnonzero(many)
        if len(place) < self.need:
            return place[:0]
        last = np.arange(len(place)) + self.need - 1
        inside = np.minimum(last, len(place) - 1)
        dense = np.flatnonzero((last < len(place)) & (place[inside] - place <= self.n + self.k - self.r))
        cover = np.zeros(len(place) + 1, np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, last[dense] + 1, -1)
        place = place[np.cumsum(cover[:-1]) > 0]
        m = many[place]
        rows = np.repeat(first[place], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        return np.unique(np.maximum(np.repeat(place, m) - self.at[rows], 0))


class Search:
    """Searches texts for given items; keeps a bounded number of items ready."""

    def __init__(self, repetitions: int | None):
        self.repetitions, self.hashes, self.ready = repetitions, Hasher(), {}

    def item(self, text: str) -> Item:
        if text not in self.ready:
            if len(self.ready) >= HELD_ITEMS:
                self.ready.clear()
            self.ready[text] = Item(self.hashes(words(text)), self.repetitions)
        return self.ready[text]

    def __call__(self, rows: list[tuple[str, list[str]]]) -> Iterator[tuple[int, int, int, int]]:
        """rows: (text, items). (number of the row, number of the item in it, its words, distance) of every item found."""
        held: dict[int, list[tuple[int, int, Item, np.ndarray, np.ndarray]]] = {}
        for t, (text, items) in enumerate(rows):
            h = self.hashes(words(text))
            of_length: dict[int, np.ndarray] = {}
            for j, item in enumerate(map(self.item, items)):
                if item.r not in of_length:
                    of_length[item.r] = runs(h, item.r)
                for start in item.starts(of_length[item.r]).tolist():
                    window = h[start : start + item.n]
                    window = np.concatenate([window, np.zeros(item.n - len(window), np.uint64)]) if len(window) < item.n else window
                    held.setdefault(item.n, []).append((t, j, item, window, h[max(0, start - item.k) : start + item.n + item.k]))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, found in held.items():
            for at in range(0, len(found), 512):
                part = found[at : at + 512]
                agree = [True] * len(part)
                if self.repetitions is not None:
                    own = signatures(np.array([w for *_, w, _ in part]), self.repetitions)
                    agree = (own == np.array([item.signed for _, _, item, _, _ in part])).any(axis=1).tolist()
                for (t, j, item, _, around), a in zip(part, agree):
                    if a and best.get((t, j), (n, n))[1] > 0:
                        d = edit_search(item.h.tolist(), around.tolist())
                        if d <= item.k:
                            best[t, j] = n, min(d, best.get((t, j), (n, n))[1])
        yield from ((t, j, n, d) for (t, j), (n, d) in sorted(best.items()))


def _item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hasher()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = hashes(words(text))
            r = run_length(len(h))
            own = np.unique(runs(h, r)).view(np.int64) if r else np.zeros(0, np.int64)
            size = len(own)
            # the runs that have to be sought
            yield pa.RecordBatch.from_arrays([pa.array([key] * size, pa.int64()), pa.array([r] * size, pa.int32()), pa.array([r * int(RATE * len(h)) + 1] * size, pa.int32()), pa.array(own)], names=["item", "r", "sought", "run"])


def _met(docs: DataFrame, item_runs: DataFrame) -> DataFrame:
    """(doc_id, mark, run): the distinct runs of each document that pass a sieve of the items' runs."""
    share = docs.sparkSession.sparkContext.broadcast
    sieve = share(Sieve(item_runs.select("run").distinct()))
    lengths = [x.r for x in item_runs.select("r").distinct().collect()]  # three at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher()
        for batch in parts(batches, 4096):
            found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, text in enumerate(batch.column(2)):
                h = hashes(words(text.as_py()))
                for r in lengths:
                    own = runs(h, r).view(np.int64)
                    own = np.unique(own[sieve.value.passes(own)])
                    found.append(own)
                    owners.append(np.full(len(own), k))
            owner = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate(found))], names=["doc_id", "mark", "run"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, run long")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, mark, item): the documents (doc_id, mark, text) and items (item, text) that share a run which is sought."""
    item_runs = written(items.select("item", "text").mapInArrow(_item_runs, "item long, r int, sought int, run long"), "item-runs")
    met = written(_met(docs, item_runs), "met")
    counts = met.groupBy("run").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "run")
    keys = item_runs.join(counts, "run", "left").withColumn("place", F.row_number().over(rarest)).filter("place <= sought").select("run", "item")
    keys = written(keys, "keys")
    pairs = written(met.join(sized(keys, keys.count()), "run").select("doc_id", "mark", "item").distinct(), "pairs")
    for gone in (item_runs, met, keys):
        drop(gone)
    return pairs


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, distance): the items (item_id, text) found in each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("item_id IS NOT NULL").distinct()
    items = written(items.withColumn("item", F.xxhash64("item_id", "text")), "items")
    sample = items.orderBy(F.xxhash64("item", F.lit("sample"))).limit(SIMULATED).collect()
    repetitions = needed_repetitions([h for r in sample if len(h := np.array([_hash(w) for w in words(r.text)], np.uint64))])
    pairs = candidates(docs, items)
    with_text = pairs.join(items.withColumnRenamed("text", "item_text"), "item").withColumn("group", F.pmod("item", F.lit(GROUPS)))
    groups = with_text.groupBy("doc_id", "mark", "group").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    groups = written(groups.select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), "items"), "groups")
    own = (docs.mark == F.col("g_mark")) & docs.doc_id.eqNullSafe(F.col("g_id"))
    keys = groups.select("g_id", "g_mark").distinct()
    texts = docs.join(sized(keys, groups.count()), own, "left_semi")
    own = (texts.mark == F.col("g_mark")) & texts.doc_id.eqNullSafe(F.col("g_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(repetitions)
        for batch in parts(batches, 4096):
            for at in range(0, batch.num_rows, 256):
                ids, texts, listed = (c.to_pylist() for c in batch.slice(at, 256).columns)
                found = [(ids[t], listed[t][j]["item_id"], n, d) for t, j, n, d in search([(x, [i["item_text"] for i in y]) for x, y in zip(texts, listed)])]
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in OUT.split(", ")])

    return texts.join(groups, own).select("doc_id", "text", "items").mapInArrow(run, OUT)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
