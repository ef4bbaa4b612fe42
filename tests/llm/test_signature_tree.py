"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuremill.llm import signature_tree as st


def grams(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def brute(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [grams(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in st.similar_documents(df).collect()), key=repr)


def edited(rng, base, edits, vocabulary):
    ws = list(base)
    for _ in range(edits):
        i = rng.randrange(len(ws))
        ws[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [ws[i], rng.choice(vocabulary)]])
    return ws


def test_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 7, 12, 40, 150, 600]))]
        for _ in range(12):
            rows.append(" ".join(edited(rng, base, rng.randrange(1 + len(base) // 18), vocabulary)))
    # a group of many copies with edits of their own; chains; texts of shared passages
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows += [" ".join(edited(rng, base, 2, vocabulary)) for _ in range(120)]
    for _ in range(40):
        base = edited(rng, base, 3, vocabulary)
        rows.append(" ".join(base))
    passages = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(6)]
    rows += [" ".join(rng.sample(passages, 4)) for _ in range(60)]
    rows += [None, None, "", " \n\t", rows[0].upper(), "two words", "Two  words", "É é", "é é", "one", "x " * 5000]
    numbered = [(k, t) for k, t in enumerate(rows)]
    rng.shuffle(numbered)
    numbered += [(None, rows[3]), (None, rows[3] + " more"), (None, "own text of null id"), (7, rows[40]), (7, rows[40]), (7, "another text")]
    df = spark.createDataFrame(numbered, "doc_id long, text string").select("text", F.lit(1).alias("n"), "doc_id", F.lit("x").alias("id")).repartition(5)
    assert result(df) == brute(numbered)


def test_clusters_meet_by_their_trees(spark):
    """Two large clusters with a single similar pair between them, which the try of one pair misses."""
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    far = list(base)
    for k in range(0, 200, 28):
        far[k] = "far"
    rows = [" ".join(edited(rng, base, 1, vocabulary)) for _ in range(40)] + [" ".join(edited(rng, far, 1, vocabulary)) for _ in range(40)]
    between = list(base)
    for k in range(0, 100, 28):
        between[k] = "far"
    for extra in ([], [" ".join(between)]):
        numbered = list(enumerate(rows + extra))
        assert result(spark.createDataFrame(numbered, "doc_id long, text string")) == brute(numbered)


def test_traversal_keeps_every_similar_pair(spark):
    """Without clusters: each class a tree of one, and trees of mixed classes."""
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(500)]
    texts = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 100]))]
        texts += [" ".join(edited(rng, base, rng.randrange(4), vocabulary)) for _ in range(5)]
    sets = {st.set_id(h): set(h.tolist()) for h in (st.shingle_set(t, 5) for t in texts)}
    ids = sorted(sets)
    want = {(u, v) for u in ids for v in ids if u < v and 5 * len(sets[u] & sets[v]) >= 4 * len(sets[u] | sets[v])}
    schema = f"id long, n long, pop long, all array<long>, {', '.join(f'{b} long' for b in st.BITS)}"
    rows = spark.createDataFrame([(t,) for t in texts], "text string").mapInArrow(st._whole(5), schema).dropDuplicates(["id"])
    leaves = rows.withColumn("g", F.pmod("id", F.lit(3))).selectExpr("g", "id", "n AS lo", "n AS hi", "pop - floor(n / 5) AS need", "9 * pop - 5 * n AS least", *st.BITS)
    leaves = st.numbered(leaves, ["g", "lo", "id"], "at")
    tops = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "g long, other long")
    for depth in (0, 1, 2):
        got = {tuple(sorted((r.u, r.v))) for r in st._traversed(tops, leaves, depth).collect()}
        assert {(u, v) for u, v in want if u % 3 != v % 3} <= got
        assert len(got) < len(ids) ** 2 / 8  # and most others are pruned


def test_empty_and_missing(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df([])) == []
    assert result(df([(None, None), (3, "")])) == [(3, 0, 3), (None, 0, None)]


@pytest.mark.parametrize("text", ["a", "a b c d", "a b c d e", "A b C d e f a b c d e"])
def test_sets(text):
    assert len(st.shingle_set(text, 5)) == len(grams(text))
    assert (st.shingle_set(text, 5) == st.shingle_set(text.upper(), 5)).all()
    h = st.shingle_set(text, 5)
    assert np.unpackbits(st.bitmap(h).view(np.uint8)).sum() == len(h)
