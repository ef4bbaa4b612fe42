"""Language identification by a linear-chain conditional random field over the words of a text.

Each word (a run of letters, lower-cased) has features: affixes of one to three letters, letter bigrams and trigrams
with word bounds, and its entry in a lexicon of the sample's frequent words. A weight per feature and language and a
weight per pair of successive languages are learned together by gradient ascent on the likelihood; training sequences
are spans of sampled documents, half of them spliced from two documents, so that transitions between languages occur.
Forward-backward gives each word of a text its probabilities; a document's language is the one with the largest mean,
its score that mean. Every word of every text counts.

The fit uses a bounded sample, ``SAMPLE_DOCS`` documents of each language on average (twice that at most), picked by
a hash of text and id among documents of ``SAMPLE_CHARS`` characters at most whose ``crc32(doc_id) mod 3`` is not 1. It
learns the ``LANGUAGES`` most frequent languages, each from ``SEQUENCES`` spans of the sample at most. Prediction is one pass without shuffle.

Defined cases: null text or text without letters is ``und`` with score 0; a null doc_id counts as the empty string for
the split; without any labelled document all is ``und``; runs of over 48 letters (scripts without spaces)
are cut into words of 48, each a position of the chain; equal rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import parts, table, tidy

#: Documents of a language in the sample, characters of the longest one in it, training sequences of a language, and the
#: languages learned at most (the most frequent ones): together they bound what the fit reads and takes.
SAMPLE_DOCS, SAMPLE_CHARS, SEQUENCES, LANGUAGES = 150, 1 << 17, 2000, 500
BUCKETS, LEXICON, LONG_WORD = 1 << 16, 2000, 48
SEQUENCE, BATCH, EPOCHS, RATE, DECAY = 32, 128, 4, 0.2, 1e-6
#: Entries a worker keeps of word -> scores; characters and words handled at a time.
CACHE_WORDS, GROUP_CHARS, GROUP_WORDS = 400_000, 1 << 22, 1 << 16
LETTERS = regex.compile(rf"\p{{L}}{{1,{LONG_WORD}}}")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """(words, features) of bucket numbers; 0 stands for no feature."""
    size = max(map(len, words), default=1)
    raw = np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.zeros((len(words), size + 2), np.uint64)
    ends[:, 1:-1] = raw
    ends[:, 0] = 1
    ends[np.arange(len(words)), n + 1] = 2
    out = []

    def add(kind: int, code: np.ndarray, ok: np.ndarray):
        x = (code + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(np.where(ok, LEXICON + 1 + (x >> np.uint64(40)) % np.uint64(BUCKETS - LEXICON - 1), 0).astype(np.int32))

    p = np.uint64(0x110000)
    rows = np.arange(len(words))
    for k in (1, 2, 3):
        ok = n >= k
        head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for j in range(k):
            head = head * p + ends[:, min(1 + j, size + 1)]
            tail = tail * p + ends[rows, np.maximum(n - k + 1 + j, 0)]
        add(k, head[:, None], ok[:, None])
        add(3 + k, tail[:, None], ok[:, None])
    for k in (2, 3):
        span = size + 2 - k + 1
        if span > 0:
            code = ends[:, :span].copy()
            for j in range(1, k):
                code = code * p + ends[:, j : j + span]
            add(5 + k, code, np.arange(span)[None, :] + k <= (n + 2)[:, None])
    out.append(np.array([[lexicon.get(w, 0)] for w in words], np.int32).reshape(-1, 1))
    return np.concatenate(out, axis=1)


@dataclass
class Crf:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (BUCKETS, langs)
    steps: np.ndarray  # (langs, langs): from, to

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.langs)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(words), 4096):
            part = order[at : at + 4096]
            out[part] = self.weights[features([words[i] for i in part.tolist()], self.lexicon)].sum(axis=1)
        return out


def messages(scores: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(emissions, transitions, forward, backward messages), each scaled. ``scores``: of all sequences one after the
    other, which begin at ``starts`` (the last entry is the total), the longest sequence first."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(steps - steps.max())
    sizes, first = np.diff(starts), starts[:-1]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    alpha, beta = np.empty_like(e), np.ones_like(e)
    if not longest:
        return e, move, alpha, beta
    now = e[first]
    alpha[first] = now = now / now.sum(axis=1, keepdims=True)
    for t in range(1, longest):
        at = first[: active[t]] + t
        now = e[at] * (now[: active[t]] @ move)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    back = move.T
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (e[at + 1] * beta[at + 1]) @ back
        beta[at] = b / b.sum(axis=1, keepdims=True)
    return e, move, alpha, beta


def forward_backward(scores: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Probabilities (words, langs)."""
    _, _, alpha, beta = messages(scores, starts, steps)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, starts: np.ndarray, steps: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the labels ``y`` (words, langs; one is 1): by each word's scores, and by the transitions.

    Observed less expected counts, of labels and of pairs of successive labels."""
    e, move, alpha, beta = messages(scores, starts, steps)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.setdiff1d(np.arange(len(scores)), starts[1:] - 1)  # words with a successor
    pair = alpha[inner][:, :, None] * move[None] * (e * beta)[inner + 1][:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return y - p, y[inner].T @ y[inner + 1] - pair.sum(axis=0)


def fit(texts: list[str], labels: list[str], seed: int = 0) -> Crf | None:
    """A CRF fitted to whole labelled texts; None without words."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    docs: dict[str, list[list[str]]] = {k: [] for k in langs}
    counts: dict[str, int] = {}
    for text, lang in zip(texts, labels):
        words = LETTERS.findall(text.lower())
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        docs[lang] += [words[at : at + SEQUENCE] for at in range(0, len(words), SEQUENCE)]
    langs = [k for k in langs if docs[k]]
    if not langs:
        return None
    lexicon = {w: i + 1 for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:LEXICON])}
    per = min(SEQUENCES, max(64, *(len(docs[k]) for k in langs)))
    sequences, gold = [], []
    for y, lang in enumerate(langs):
        for j in rng.integers(0, len(docs[lang]), per):
            ws = list(docs[lang][j])
            ys = [y] * len(ws)
            if rng.random() < 0.5:
                z = int(rng.integers(0, len(langs)))
                other = docs[langs[z]][int(rng.integers(0, len(docs[langs[z]])))]
                cut = int(rng.integers(0, len(ws) + 1))
                ws, ys = ws[:cut] + other[cut:], ys[:cut] + [z] * len(other[cut:])
            if ws:
                sequences.append(ws)
                gold.append(ys)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
    width, rows = 0, []
    names = sorted(vocabulary, key=len)
    vocabulary = {w: i for i, w in enumerate(names)}
    for at in range(0, len(names), 4096):
        rows.append(features(names[at : at + 4096], lexicon))
        width = max(width, rows[-1].shape[1])
    known = np.zeros((len(names), width), np.int32)
    for k, r in enumerate(rows):
        known[k * 4096 : k * 4096 + len(r), : r.shape[1]] = r
    n = len(langs)
    crf = Crf(langs, lexicon, np.zeros((BUCKETS, n), np.float32), np.zeros((n, n), np.float32))
    square, square_steps = np.full((BUCKETS, n), 1e-3, np.float32), np.full((n, n), 1e-3, np.float32)
    eye = np.eye(n, dtype=np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), BATCH):
            part = sorted(order[at : at + BATCH].tolist(), key=lambda i: -len(sequences[i]))
            starts = np.concatenate([[0], np.cumsum([len(sequences[i]) for i in part])])
            words = np.array([vocabulary[w] for i in part for w in sequences[i]])
            y = eye[np.array([v for i in part for v in gold[i]])]
            f = known[words]
            by_score, by_step = gradients(crf.weights[f].sum(axis=1), starts, crf.steps, y)
            grad = np.zeros_like(crf.weights)
            np.add.at(grad, f, by_score[:, None, :])
            grad[0] = 0
            grad = grad / len(part) - DECAY * crf.weights
            square += grad * grad
            crf.weights += RATE * grad / np.sqrt(square)
            g = by_step / len(part) - DECAY * crf.steps
            square_steps += g * g
            crf.steps += RATE * g / np.sqrt(square_steps)
    crf.weights[0] = 0
    return crf


class Predictor:
    """Labels whole texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, crf: Crf):
        self.crf, self.known, self.rows = crf, {}, np.empty((0, len(crf.langs)), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.rows, new = {}, self.rows[:0], list(words)
        at = len(self.known)
        self.known.update(zip(new, range(at, at + len(new))))
        if at + len(new) > len(self.rows):
            grown = np.empty((max(2 * len(self.rows), at + len(new)), len(self.crf.langs)), np.float32)
            grown[:at] = self.rows[:at]
            self.rows = grown
        if new:
            self.rows[at : at + len(new)] = self.crf.scores(new)

    def _group(self, texts: list[str]) -> list[tuple[str, float]]:
        scores: list[np.ndarray] = []
        held: list[list[str]] = []

        def flush():
            self._learn({w for ws in held for w in ws})
            for ws in held:
                scores.append(self.rows[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))])
            held.clear()

        size = 0
        for t in texts:
            held.append(LETTERS.findall(t.lower()))
            size += len(held[-1])
            if size > GROUP_WORDS:
                flush()
                size = 0
        flush()
        sizes = np.array([len(s) for s in scores])
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i]]
        for part in _cut(order, sizes):
            starts = np.concatenate([[0], np.cumsum(sizes[part])])
            p = forward_backward(np.concatenate([scores[i] for i in part]), starts, self.crf.steps)
            mean = np.add.reduceat(p.astype(np.float64), starts[:-1], axis=0) / sizes[part][:, None]
            for i, m in zip(part, mean):
                k = int(m.argmax())
                out[i] = (self.crf.langs[k], float(min(1.0, max(0.0, m[k]))))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out, at, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= GROUP_CHARS:
                out += self._group(texts[at : k + 1])
                at, size = k + 1, 0
        return out + self._group(texts[at:])


def _cut(order: list[int], sizes: np.ndarray) -> Iterator[list[int]]:
    """Runs of documents of similar length."""
    at = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or 3 * sizes[order[k]] < sizes[order[at]]:
            yield order[at:k]
            at = k


_predictors: dict[bytes, Predictor] = {}


def label(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """``docs`` with lang_pred and score (which replace columns of these names); with no model all is ``und``."""
    docs = docs.drop("lang_pred", "score")
    if crf is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    tidy(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    key, at = crf.weights.tobytes()[:4096] + crf.steps.tobytes(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _predictors:
            _predictors.clear()
            _predictors[key] = Predictor(shared.value)
        for part in parts(batches, 4096):
            found = list(zip(*_predictors[key]([t or "" for t in part.column(at).to_pylist()]))) or [[], []]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf | None:
    """Fit on about ``sample_docs`` documents of each language; reads the counts of languages, then the sample."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    usable = usable.filter(F.length("text") <= SAMPLE_CHARS)
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_docs / n))])
    rows = usable.filter(draw < share[F.col("lang")]).select("lang", "text").limit(2 * sample_docs * len(counts)).collect()
    rows = sorted((r.lang, r.text) for r in rows)
    return fit([t for _, t in rows], [k for k, _ in rows])


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with the predicted language of each row and its score."""
    return label(docs, train(docs, sample_docs))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = label(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
