"""The Merkle manifest against plain hashing of whole trees."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from featuremill.llm import merkle
from featuremill.llm.sha_state import START, bytes_to_words, compress, hex_blocks, last_blocks, words_to_bytes


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(levels from the leaves to the single node)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[k : k + 16]) for k in range(0, len(now), 16)])
    return levels


def siblings(levels, at):
    """Per level: those left and right of the node."""
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for at, r in enumerate(groups[s]):
            steps = siblings(trees[s], at) + siblings(top, i)
            changed = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                changed = (*r[:4], "".join(c.lower() if c in merkle.UPPER else c for c in r[4]))
            now = leaf(changed)
            for left, right in steps:
                now = h(*left, now, *right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(d for left, right in steps for d in left + right)), now, now == root))
    return sorted(map(repr, out))


def result(spark, monkeypatch, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.select("text", F.lit(1).alias("tree"), "n_chars", F.lit("x").alias("digest"), "lang", F.lit(2).alias("idx"), "source", "doc_id")
    monkeypatch.setattr(merkle, "table", lambda *_: docs)
    got = merkle.op11_merkle_manifest(spark, "").collect()
    return sorted(repr((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)) for r in got)


def test_against_whole_trees(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "Ä ÖB", "lower only", "x" * 70000, "Mixed Case ☃"]
    rows = [(k, "hot", "en", 3, f"Text {k}") for k in range(700)]
    rows += [(rng.randrange(300), rng.choice([f"s{j}" for j in range(40)] + ["", None, "é", "null"]), rng.choice([None, "de"]), rng.choice([None, 5]), rng.choice(texts)) for _ in range(500)]
    rows += [(7, "hot", "en", 3, "Text 7")] * 40 + [(None, None, None, None, None)] * 20 + [(None, "hot", None, None, "Null")] * 3
    rows += [(k, f"alone{k}", None, None, "One") for k in range(20)] + [(-5, "seventeen", None, 1, "A")] * 17
    rng.shuffle(rows)
    assert result(spark, monkeypatch, rows) == brute(rows)


def test_small_tables(spark, monkeypatch):
    for rows in ([], [(1, "a", None, None, "T")], [(k, "a", None, None, "T") for k in range(16)]):
        assert result(spark, monkeypatch, rows) == (brute(rows) if rows else [])


def test_a_stored_state_resumes(spark):
    """The states of a run's table, resumed with a new child and the right siblings, are the whole run's hash."""
    rows = [(k, "a", None, None, f"T{k}") for k in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(docs)
    run = m.runs.filter("level = 0").first()
    digests = [bytes.fromhex(leaf(r)) for r in rows]
    assert [bytes(x) for x in run.kids] == digests and len(run.states) == 11
    new = hashlib.sha256(b"new").digest()
    for slot in range(11):
        import numpy as np

        state = bytes_to_words(np.frombuffer(bytes(run.states[slot]), np.uint8).reshape(1, 32))
        for d in [new, *digests[slot + 1 :]]:
            state = compress(state, hex_blocks(np.frombuffer(d, np.uint8).reshape(1, 32)))
        got = words_to_bytes(compress(state, last_blocks(np.array([11]))))[0].tobytes().hex()
        assert got == h(*(d.hex() for d in digests[:slot]), new.hex(), *(d.hex() for d in digests[slot + 1 :]))
    assert bytes(run.states[0]) == words_to_bytes(START[:, None])[0].tobytes()
    merkle.drop_manifest(m)


def test_other_changes_fold(spark):
    """The general interface: any other version of a row; rows that keep theirs verify."""
    rows = [(k, f"s{k % 3}", None, None, f"t{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    other = F.when(F.col("doc_id") == 17, merkle.leaf_digest({c: F.lit("changed") if c == "text" else F.col(c) for c in merkle.COLUMNS}))
    got = {r.doc_id: r for r in merkle.prove(merkle.manifest(docs, other)).collect()}
    again = {r.doc_id: r for r in merkle.prove(merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 17, "changed").otherwise(F.col("text"))))).collect()}
    assert got[17].folded_root == again[17].root != got[17].root
    assert all(r.folded_root == r.root for k, r in got.items() if k != 17)
