"""Every stage of the pipeline against plain Python, on what the stage before it kept."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from featuremill.llm.common import written
from featuremill.llm.decontaminate import RATE, edit_search, words
from featuremill.llm.langid import Predictor, train
from featuremill.llm.line_dedup import MIN_WORDS
from featuremill.llm.signature_tree import similar_groups
from featuremill.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and what comes out at the end."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return [sorted(d.collect(), key=lambda r: (r.doc_id, r)) for d in out]


def test_language_id(spark, stages):
    crf = train(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = Predictor(crf)([r.text or "" for r in stages[0]])
    want = [r.doc_id for r, (lang, score) in zip(stages[0], labels) if lang != "und" and score >= corpus_pipeline.MIN_SCORE]
    assert [r.doc_id for r in stages[1]] == want and 0 < len(want)
    assert all(r.lang is not None for r in stages[1])


def repeats(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_line_dedup(stages):
    seen, first_at, want = [], {}, {}
    for r in stages[1]:
        kept, lines = [], r.text.split("\n")
        for n, line in enumerate(lines):
            w = tuple(line.split())
            if not w:
                kept.append(line)
                continue
            if w not in first_at:
                first_at[w] = any(repeats(w, v) for v in seen if abs(len(v) - len(w)) < 2)
                seen.append(w)
                gone = first_at[w]
            else:
                gone = True
            kept += [] if gone else [line]
        text = "\n".join(kept)
        if len(kept) == len(lines) or text.split():
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_dedup(stages):
    def grams(t):
        ws = t.lower().split()
        return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}

    root, sets = {}, []
    for r in stages[2]:
        root[r.doc_id] = r.doc_id
        own = grams(r.text)
        for other, x in sets:
            if 5 * len(own & x) >= 4 * len(own | x):
                a, b = r.doc_id, other
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
        sets.append((r.doc_id, own))
    assert [r.doc_id for r in stages[3]] == [k for k, v in root.items() if k == v]


def test_decontamination(spark, stages):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [r.doc_id for r in stages[3] if not any(edit_search(i, words(r.text)) <= int(RATE * len(i)) for i in items)]
    assert [r.doc_id for r in stages[4]] == want


def test_bpe(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r.doc_id for r in stages[5]] == [r.doc_id for r in stages[4]]
    for r, d in zip(stages[5], stages[4]):
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[5])


def test_near_dedup_goes_through_the_index_of_fingerprints(spark, monkeypatch):
    """Rows within four bits of each other are proposed, and only those; a proposal of unlike texts removes nothing."""
    base = " ".join(f"w{k}" for k in range(400))
    often = "a b c d e " * 60  # repeats of five shingles outweigh all others, so fingerprints are alike and sets are not
    texts = [base, base + " x", " ".join(f"v{k}" for k in range(50)), often + " ".join(f"p{k}" for k in range(40)), often + " ".join(f"q{k}" for k in range(40))]
    prints = [fingerprint(t, corpus_pipeline.SHINGLE_WORDS) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert near == {(0, 1), (3, 4)}
    proposed = []

    def spied(docs, words, proposals):
        ids = {r.key: texts.index(r.text) for r in docs.collect()}
        proposed.extend(tuple(sorted((ids[r.key], ids[r.other]))) for r in proposals.collect())
        return similar_groups(docs, words, proposals)

    monkeypatch.setattr(corpus_pipeline, "similar_groups", spied)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF).collect()
    assert set(proposed) == near and sorted(r.doc_id for r in kept) == [0, 2, 3, 4]
