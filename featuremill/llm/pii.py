"""Personal data: patterns for entities, and information-theoretic sanitisation of the terms that reveal them.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value is a protected
entity. Terms are the words of a text outside all entities. Co-occurrence in whole texts over the whole corpus, counted
in distinct texts, estimates how much of an entity ``e`` a term ``t`` tells:

    disclosure(e; t) = log(df(e, t) N / (df(e) (df(t) + 1))) / log(N / df(e))

that is, their pointwise mutual information over the entity's own information, with one text more added to the term's
count: near 1 means that ``t`` occurs with ``e`` alone. On that scale a term of several texts, one of them with the entity, still
tells much of a rare entity in a large corpus, though whoever sees the term would mostly be wrong; so the share of the term's texts that have the
entity, bounded below by the same text more, df(e, t) / (df(t) + 1), must reach ``SURE``, too. An
entity of a single text is protected, too. Where both hold, the term is a span of its own wherever it
stands in any document: ``sanitise`` replaces it by ``[term]`` and from ``REMOVE`` on takes it out. A term has
the largest of its disclosures. Pairs that cannot reach them, as the term is in too many texts, are left out by
an exact bound before they are counted. Copies of a text count once, so that mere copying reveals nothing.

The words of the corpus are counted in each task before any shuffle; entities of the same texts are one. Sieves of fixed
size, sent to the tasks, keep most words that cannot matter out of the shuffles; joins decide. Terms and entities are
held as 64-bit hashes.

Defined cases: digit runs of any length are compared as text; null text counts as empty; equal rows each get a row; null ids are kept; an entity in every text has no
information and nothing reveals it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, sized, table, written
from .sieve import Sieve

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSE, REMOVE = 0.8, 0.95
#: Least share of a term's texts that have the entity, as the number of texts (and one more) to each with the entity.
SURE = 3
#: Words that a worker holds at a time.
HELD_WORDS = 300_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # the @ itself is in no later match
        at = text.find("@", max(done, at + 1))


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(_part(p) for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                yield m.start(), m.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.start(), m.end()


_HAS_DIGIT = re.compile("[0-9]")


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    if _HAS_DIGIT.search(text):
        found += [(s, k, e) for k, find in ((1, ips), (2, cards), (3, phones)) for s, e in find(text)]
    return sorted(found)


def free_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that lie outside all entities."""
    starts = [s for s, _, _ in spans]
    reach = 0  # the furthest end so far, by entity: spans of different kinds may overlap
    ends = [reach := max(reach, e) for _, _, e in spans]
    for m in _WORD.finditer(text):
        k = bisect_left(starts, m.end())
        if k == 0 or ends[k - 1] <= m.start():
            yield m[0].lower(), m.start(), m.end()


FOUND = "doc_id long, mark long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, entities array<long>, terms array<long>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def term_hash(word: str) -> int:
    """A term's 64-bit hash, signed; terms are counted and joined by it."""
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(term_hash, words), np.int64, len(words))


def _words(text: str) -> set[str]:
    return set(map(str.lower, _WORD.findall(text)))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, base, named, terms = [], [], [], [], []
        for text in batch.column(2):
            t = text.as_py()
            spans = entities(t)
            n = Counter(k for _, k, _ in spans)
            counts.append([n[k] for k in range(4)])
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            named.append(list({term_hash(f"{k}:{t[s:e]}") for s, k, e in spans}))
            terms.append(list({term_hash(w) for w in {w for w, _, _ in free_words(t, spans)}}) if spans else [])
        columns = [batch.column(0), batch.column(1), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(digests, pa.string()), pa.array(base, pa.list_(_SPAN)), pa.array(named, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms"])


def _counts(texts: DataFrame, copied: Broadcast, wanted: Broadcast) -> DataFrame:
    """(h, n): in how many of ``texts`` (mark, text), but for copied ones, each of the wanted terms is."""

    def flushed(n: Counter) -> pa.RecordBatch:
        h = _hashes(list(n))
        keep = wanted.value.passes(h)
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(np.fromiter(n.values(), np.int64, len(n))[keep])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            several = copied.value.passes(batch.column(0).to_numpy())
            for text, skip in zip(batch.column(1), several.tolist()):
                if not skip:
                    n.update(_words(text.as_py()))
                    if len(n) > HELD_WORDS:
                        yield flushed(n)
                        n.clear()
        yield flushed(n)

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Lookup:
    """Which words of a text pass a sieve; keeps the answers of up to ``HELD_WORDS`` words."""

    def __init__(self, sieve: Sieve):
        self.sieve, self.known = sieve, {}

    def __call__(self, text: str) -> list[str]:
        words = _words(text)
        if new := words.difference(self.known):
            if len(self.known) + len(new) > HELD_WORDS:
                self.known, new = {}, words
            fresh = list(new)
            self.known.update(zip(fresh, self.sieve.passes(_hashes(fresh)).tolist()))
        return [w for w in words if self.known[w]]


def _counts_in_copies(texts: DataFrame, copied: Broadcast, wanted: Broadcast) -> DataFrame:
    """(h, n) as ``_counts``, of the copied texts: each text counts once, however many rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, seen = Lookup(wanted.value), set()
        for batch in batches:
            marks = batch.column(0).to_numpy()
            for k in np.flatnonzero(copied.value.passes(marks)).tolist():
                if marks[k] in seen:
                    continue
                if len(seen) >= HELD_WORDS:
                    seen.clear()
                seen.add(marks[k])
                h = _hashes(look(batch.column(1)[k].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), marks[k]))], names=["h", "mark"])

    return texts.mapInArrow(run, "h long, mark long").distinct().groupBy("h").agg(F.count("*").alias("n"))


def _occurrences(rows: DataFrame, wanted: Broadcast) -> DataFrame:
    """(doc_id, mark, h, start, end) of the words of ``rows`` outside entities whose terms pass the sieve."""
    kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "h": pa.int64(), "start": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(wanted.value)
        for batch in batches:
            found = []
            for doc, mark, text in zip(*batch.columns):
                t = text.as_py()
                if hits := {w: term_hash(w) for w in look(t)}:
                    found += [(doc.as_py(), mark.as_py(), hits[w], s, e) for w, s, e in free_words(t, entities(t)) if w in hits]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return rows.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, h long, start int, end int")


def protected(held: DataFrame, n_texts: int) -> DataFrame:
    """(entity, n_entity): one entity for each set of texts that some entity is in, with the number of these texts.

    Entities of the same texts (equal counts and sums of hashes) are told by the same terms equally."""
    sums = held.select("mark", F.explode("entities").alias("entity")).groupBy("entity")
    sums = sums.agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("mark")).alias("a"), F.bit_xor(F.xxhash64("mark", F.lit(1))).alias("b"))
    return sums.filter(F.col("n_entity") < n_texts).groupBy("n_entity", "a", "b").agg(F.min("entity").alias("entity")).select("entity", "n_entity")


def revealing_terms(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(h, disclosure) of the terms that reveal an entity."""
    share = rows.sparkSession.sparkContext.broadcast
    texts = rows.select("mark", "text")
    marks = written(found.groupBy("mark").agg(F.count("*").alias("n")), "marks")
    n_texts = marks.count()
    copied = share(Sieve(marks.filter("n > 1").select("mark")))
    held = written(found.filter(F.size("entities") > 0).select("mark", "entities", "terms").dropDuplicates(["mark"]), "held")
    alone = written(protected(held, n_texts), "entities")
    most = alone.agg(F.max("n_entity")).first()[0] or 0

    def may(n: Column, n_entity: Column) -> Column:
        """No term in n texts reveals an entity in n_entity unless this holds (the rest is for rounding)."""
        return (n + 1 <= SURE * n_entity) & (n + 1 <= F.pow(F.lit(float(max(n_texts, 1))), 1 - DISCLOSE) * F.pow(n_entity.cast("double"), DISCLOSE) * (1 + 1e-9))

    terms = written(held.select(F.explode("terms").alias("h")).distinct(), "terms")
    once = _counts(texts, copied, share(Sieve(terms)))
    some = terms.join(once, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n")).filter(may(F.col("n"), F.lit(most)))
    some = written(some, "rare")
    more = _counts_in_copies(texts, copied, share(Sieve(some.select("h")))).withColumnRenamed("n", "more")
    rare = some.join(more, "h", "left").select("h", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).filter(may(F.col("n"), F.lit(most)))
    rare = written(rare, "counts")
    of_text = held.select("mark", F.explode("entities").alias("entity")).join(alone, "entity")
    of_text = of_text.groupBy("mark").agg(F.collect_list(F.struct("entity", "n_entity")).alias("named"), F.max("n_entity").alias("most"))
    in_text = written(held.select("mark", F.explode("terms").alias("h")).join(sized(rare, rare.count()), "h"), "in-text")
    both = in_text.join(of_text, "mark").filter(may(F.col("n"), F.col("most"))).select("h", "n", F.explode("named").alias("x")).select("h", "n", "x.*")
    both = both.filter(may(F.col("n"), F.col("n_entity"))).groupBy("entity", "n_entity", "h", "n").agg(F.count("*").alias("n_both"))
    told = F.log(F.col("n_both") * F.lit(float(n_texts)) / (F.col("n_entity") * (F.greatest("n", "n_both") + 1))) / F.log(F.lit(float(n_texts)) / F.col("n_entity"))
    revealing = both.select("h", "n", "n_both", told.alias("disclosure")).filter((F.col("disclosure") >= DISCLOSE) & (F.greatest("n", "n_both") + 1 <= SURE * F.col("n_both")))
    revealing = written(revealing.groupBy("h").agg(F.max("disclosure").alias("disclosure")), "revealing")
    for gone in (marks, held, alone, terms, some, rare, in_text):
        drop(gone)
    return revealing


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark, counts, base_sha256, base and terms: arrays of spans; a term has its disclosure, too."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = written(rows.mapInArrow(_find, FOUND), "found")
    revealing = revealing_terms(rows, found)
    places = written(_occurrences(rows, rows.sparkSession.sparkContext.broadcast(Sieve(revealing.select("h")))), "places")
    spans = places.join(sized(revealing, revealing.count()), "h").groupBy("doc_id", "mark", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = spans.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "disclosure"))).alias("terms"))
    t = written(terms, "spans").select(F.col("doc_id").alias("t_id"), F.col("mark").alias("t_mark"), "terms")
    drop(places)
    return found.drop("entities", "terms").join(t, found.doc_id.eqNullSafe(t.t_id) & (found.mark == t.t_mark), "left").drop("t_id", "t_mark")


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): entities replaced by ``[kind]``, revealing terms generalised to ``[term]`` or removed."""
    docs = docs.select("doc_id", "text")
    spans = find_personal_data(docs).select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), "base", "terms").dropDuplicates(["s_id", "s_mark"])
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(spans, docs.doc_id.eqNullSafe(spans.s_id) & (mark == spans.s_mark)).select("doc_id", "text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, base, terms in zip(*(c.to_pylist() for c in batch.columns[1:])):
                out, at = [], 0
                for x in sorted((base or []) + (terms or []), key=lambda x: (x["start"], x["kind"])):
                    if x["start"] >= at:
                        out += [text[at : x["start"]], "" if x.get("disclosure", 0) >= REMOVE else f"[{KINDS[x['kind']]}]"]
                    at = max(at, x["end"])
                texts.append(None if text is None else "".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "base", "terms").mapInArrow(run, "doc_id long, text string")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    terms = F.transform(F.coalesce("terms", F.array()), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    every = F.transform(F.array_sort(F.concat("base", terms)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    n_base, n_terms = F.size("base").cast("long"), F.size(terms).cast("long")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(every, ",").alias("spans"), n_base.alias("n_base"), n_terms.alias("n_terms"))
