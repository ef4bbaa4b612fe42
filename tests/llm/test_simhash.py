"""SimHash groups against all pairs."""

import random

import pytest

from featuremill.llm import simhash
from featuremill.llm.simhash import fingerprint, near_duplicates, near_links


def groups(values, max_bits):
    left, out = set(values), {}
    while left:
        seed = min(left)
        group, todo = {seed}, [seed]
        left.discard(seed)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= max_bits}
            left -= near
            group |= near
            todo += near
        out |= {x: frozenset(group) for x in group}
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("longest", [1, 5, 256])
@pytest.mark.parametrize("max_bits", [2, 4])
def test_links_give_the_groups_of_all_pairs(spark, longest, max_bits):
    rng = random.Random(7)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in near_links(df, max_bits, longest).collect()]
    assert all((u ^ v).bit_count() <= max_bits for u, v in links)
    from featuremill.llm.components import components

    roots = {}
    for r in components(spark.createDataFrame([(signed(u), signed(v)) for u, v in links], "u long, v long")).collect():
        roots[r.node & (1 << 64) - 1] = r.root
    want = groups(values, max_bits)
    for v in values:
        same = {w for w in values if w == v or (v in roots and roots.get(w) == roots[v])}
        assert same == set(want[v])


def test_the_tally_rejects_pairs_below_the_minimum(spark):
    from pyspark.sql import functions as F

    from featuremill.llm.simhash import _byte_mask, _members, _posted, _tally, meetings

    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = set()
    for _ in range(60):  # three to six bytes of one fingerprint, the others at random
        keep = rng.sample(range(8), rng.randrange(3, 7))
        values.add(sum((base >> 8 * p & 255 if p in keep else rng.getrandbits(8)) << 8 * p for p in range(8)))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    from itertools import combinations

    met = meetings(_members(_posted(df, [_byte_mask(c) for c in combinations(range(8), 3)])), 3).withColumn("tally", _tally(F.col("u"), F.col("v"))).collect()
    shared = lambda u, v: sum((u ^ v) >> 8 * p & 255 == 0 for p in range(8))
    want = {(signed(u), signed(v)): shared(u, v) for u in values for v in values if signed(u) < signed(v) and shared(u, v) >= 3}
    assert {(r.u, r.v): r.tally for r in met} == want and len(met) == len(want)
    assert sum(t < 4 for t in want.values()) > 10 and sum(t >= 4 for t in want.values()) > 10
    kept = {(r.u, r.v) for r in near_links(df, 4).collect()}
    assert kept == {(u, v) for u, v in want if ((u ^ v) & (1 << 64) - 1).bit_count() <= 4}


def test_whole_operator(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)) for _ in range(6)]
    rows = [(10 * k + j, t if j == 0 else t.replace(" ", "\n", j)) for k, t in enumerate(base) for j in range(3)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "two words"), (103, "two words"), (None, "solo text")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {fingerprint(t, 4) for _, t in rows}
    want = groups(fps, 4)
    least = {}
    for i, t in rows:
        for x in want[fingerprint(t, 4)]:
            least[x] = min(v for v in (least.get(x), i) if v is not None) if (least.get(x), i) != (None, None) else None
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((i or -1, least[fingerprint(t, 4)] or -1) for i, t in rows)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    text = "One two THREE\tfour five one two three four É"
    ws = "one two three four five one two three four É".split()
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42) for k in range(len(ws) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert fingerprint(text, 4) == want
    assert fingerprint("é x", 4) == xxhash.xxh64_intdigest("é x".encode(), 42) and fingerprint(None, 4) == 0
    with pytest.raises(ValueError):
        near_links(None, 3)
    assert simhash.LIST == 256
