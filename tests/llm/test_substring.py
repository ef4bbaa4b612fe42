"""Substring dedup against a count of all windows."""

import hashlib
import random
from collections import Counter

from featuremill.llm.substring_dedup import AT_BITS, SPAN, covered, dedup_substrings, factors


def brute(rows):
    docs = [[w for w in (t or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w] for _, t in rows]
    seen = Counter(tuple(ws[i : i + SPAN]) for ws in docs for i in range(len(ws) - SPAN + 1))
    out = []
    for (doc_id, _), ws in zip(rows, docs):
        gone = {j for i in range(len(ws) - SPAN + 1) if seen[tuple(ws[i : i + SPAN])] > 1 for j in range(i, i + SPAN)}
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, places string")
    got = [tuple(r)[:4] for r in dedup_substrings(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_against_all_windows(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4)))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    rows = []
    for k in range(40):
        ws = []
        for _ in range(rng.randrange(6)):
            ws += [word() for _ in range(rng.randrange(50))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            ws += rng.choice([p, p[a:], p[:a]])
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(100, None), (101, ""), (102, "a " * 34), (103, "a " * 35), (104, "b " * 36), (105, "a b " * 300), rows[0], (None, rows[1][1])]
    check(spark, rows)


def test_equal_rows_and_nothing(spark):
    text = " ".join(map(str, range(50)))
    check(spark, [(1, text), (1, text), (2, "x " + text[5:]), (3, " ".join(map(str, range(100, 160))))])
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_factors_are_greedy_copies_of_their_blocks():
    assert factors([]) == []
    # at 5 the window is known elsewhere than where the one before would go on: a boundary, whose window is looked up, too
    at = lambda block, position: block << AT_BITS | position
    found = factors([(4, at(7, 1)), (3, at(7, 0)), (5, at(9, 40)), (100, at(9, 0))])
    assert found == [(7, 0, 3, 36), (9, 40, 5, 35), (9, 0, 100, 35)] and covered(found) == [(3, 37), (100, 35)]
    assert covered([(1, 0, 0, 35), (1, 0, 36, 35)]) == [(0, 35), (36, 35)]


def test_factors_hold_the_words_of_their_blocks(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (40, 90, 200)]
    rows = []
    for k in range(30):
        ws = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            ws += [word() for _ in range(rng.randrange(30))] + p[a : a + rng.randrange(35, 120)]
        rows.append((k, " ".join(ws)))
    rows += [(50, rows[3][1]), (51, " ".join(passages[2] * 2))]
    words = {i: t.split() for i, t in rows}
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n, ids = 0, {r.block: r.doc_id for r in got}
    assert all(words[ids[r.block]] == words[r.doc_id] for r in got if r.block is not None)
    for r in got:
        for f in r.factors:
            block = ids[f.block]
            assert f.length >= SPAN and words[r.doc_id][f.start : f.start + f.length] == words[block][f.position : f.position + f.length]
            assert (f.block, f.position) != (r.block, f.start) or words[50] == words[r.doc_id]
            n += 1
        assert sum(length for _, length in covered([(f.block, f.position, f.start, f.length) for f in r.factors])) == r.n_removed
    assert n > 20


def test_null_and_shared_ids_with_any_texts(spark, monkeypatch):
    """Rows are told apart by their texts; texts whose first hash collides, too."""
    from pyspark.sql import functions as F

    from featuremill.llm import substring_dedup

    words = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    rows = [(None, words("a", 41)), (None, words("b", 41)), (7, words("a", 40) + " end"), (7, words("c", 41)), (7, words("d", 50)), (8, "x " + words("d", 50)), (None, None), (None, words("b", 34)), (8, words("e", 36)), (8, words("e", 36)), (None, words("e", 36))]
    check(spark, rows)
    # one of the two hashes is the same for all texts
    hashed = F.xxhash64
    monkeypatch.setattr(substring_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long") if len(c) == 1 else hashed(*c))
    check(spark, rows)
