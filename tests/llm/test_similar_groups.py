"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random

from featuremill.llm.signature_tree import similar_groups


def grams(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def brute(rows):
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(k, grams(t)) for k, t in rows]
    for i, (k, a) in enumerate(sets):
        for m, b in sets[:i]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(k), find(m)))
                root[y] = x
    return {k: find(k) for k, _ in rows}


def partition(group):
    out = {}
    for k, g in group.items():
        out.setdefault(g, set()).add(k)
    return sorted(map(sorted, out.values()))


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 30, 120, 900]))]
        for _ in range(9):
            ws = list(base)
            for _ in range(rng.randrange(1 + len(ws) // 25)):
                i = rng.randrange(len(ws))
                ws[i : i + 1] = rng.choice([[], ["x"], [ws[i], "y"]])
            rows.append((len(rows), " ".join(ws)))
    notice = " ".join(vocabulary[:40])
    rows += [(len(rows) + k, notice + " " + " ".join(rng.choice(vocabulary) for _ in range(30))) for k in range(20)]
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", rows[0][1].upper(), "two words", "two words"])]
    got = {r.key: r.group for r in similar_groups(spark.createDataFrame(rows, "key long, text string")).collect()}
    assert partition(got) == partition(brute(rows))


def test_pipeline_stage_keeps_one_of_copies_at_0_8(spark):
    from corpus_pipeline import simhash_dedup

    base = [f"w{k}" for k in range(200)]
    edited = list(base)
    edited[50] = edited[120] = "x"  # 186 of 206 shingles
    less = list(base)
    for k in range(10, 200, 20):
        less[k] = "y"  # 146 of 246 shingles
    text = " ".join(base)
    rows = [(2, text), (1, " ".join(edited)), (3, " ".join(less)), (None, text), (7, "same id"), (7, "same id"), (7, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash_dedup(spark, docs, "").collect())
    assert got == sorted([rows[1], rows[2], rows[4], rows[6]])
    assert simhash_dedup(spark, docs.limit(0), "").count() == 0


def test_pipeline_drops_short_repeated_lines(spark):
    from corpus_pipeline import line_dedup

    rows = [(1, "Home  page\nfirst text of its own\n\nMenu"), (2, " Home page\nsecond one is not alike\n\nMenu"), (3, "Home pages\n\none two three four five"), (4, "one two three four six")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in line_dedup(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "second one is not alike\n", 3: rows[2][1]}


def test_columns_with_the_operators_names_pass_through(spark):
    from corpus_pipeline import STAGES

    text = "the quick brown fox jumps over the lazy dog and sleeps in the sun\nanother line of words that is here"
    learned = [k for k in range(3, 12)]
    rows = [(k, f"{text} {'abcdefghijkl'[k]} " * (1 + k), "en", "s", 5, -7.0, "mine", -3, "row", 8) for k in learned]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_removed int, _row_key string, key long")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all((r.score, r.lang_pred, r.n_removed, r._row_key, r.key) == (-7.0, "mine", -3, "row", 8) for r in kept), name


def test_decontamination_decides_by_row(spark):
    from corpus_pipeline import decontamination

    sf = "/root/testdata/sf0.001"
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    rows = [(None, f"before {item} after"), (None, "clean text"), (1, f"say {item}"), (1, "other clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in decontamination(spark, docs, sf).collect()} == {rows[1], rows[3]}


def test_proposals_do_not_change_the_groups(spark):
    """Right, wrong, repeated and unknown pairs of rows: links come from the sets alone."""
    rng = random.Random(8)
    rows = []
    for _ in range(10):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.choice([4, 60, 200]))]
        for k in range(6):
            ws = list(base)
            if k > 1:
                ws[rng.randrange(len(ws))] = "x"
            rows.append((len(rows), " ".join(ws)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    pairs = [(a, b) for a in range(0, 60, 6) for b in range(a + 1, a + 5)] + [(0, 7), (0, 7), (1, 60), (60, 61), (3, 999)]
    docs, proposals = spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame(pairs, "key long, other long")
    got = {r.key: r.group for r in similar_groups(docs, 5, proposals).collect()}
    assert partition(got) == partition(brute(rows))
