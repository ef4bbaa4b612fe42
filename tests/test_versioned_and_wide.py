"""Table versions, containment, wide correlations and long decays against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuremill.operators import assemble, profile, series
from featuremill.sources.scratch import scratch
from featuremill.sources.versions import Conflict, VersionedTable


def test_delete_rewrites_only_files_with_matches(spark):
    held = VersionedTable(spark, scratch(spark, "versions"))
    assert held.versions() == []
    df = spark.createDataFrame([(k, k % 4 if k % 9 else None) for k in range(80)], "k long, part int")
    held.create(df, by=["part"])
    before = held.files()
    held.delete(F.col("part") == 2)
    after = held.files()
    assert held.versions() == [1, 2] and held.read().filter("part = 2").count() == 0 and held.read(1).count() == 80
    assert {r.k for r in held.read().collect()} == {r.k for r in df.collect() if r.part != 2}  # nulls stay
    touched = {r.f for r in held.read(1).select(F.col("_metadata.file_path").alias("f"), "part").filter("part = 2").select("f").distinct().collect()}
    assert set(before) & set(after) == {f for f in before if f.rsplit("/", 1)[1] not in {x.rsplit("/", 1)[1] for x in touched}}
    held.delete(F.col("part") == 77)
    assert held.files() == after and held.versions() == [1, 2, 3]
    held.add_field("note", "string")
    held.append(spark.createDataFrame([(500, "x")], "k long, note string"))
    assert held.files(4) == after and {r.note for r in held.read().filter("k < 500").collect()} == {None}
    assert held.read().filter("k = 500").collect()[0].asDict() == {"k": 500, "part": None, "note": "x"} and "note" not in held.read(3).columns
    with pytest.raises(Conflict):
        held._commit(5, df.schema, [])
    with pytest.raises(ValueError):
        held.add_field("note", "int")
    held.delete(F.lit(True))
    assert held.read().count() == 0 and held.read(5).count() == held.read(4).count() + 1
    # both writers read version 6: the second starts over
    assert held.append(df.limit(1)) == 7


def test_containment_against_all_pairs(spark):
    rng = random.Random(2)
    name = lambda n: "".join(rng.choice("abñ ") for _ in range(n))
    known = [name(rng.randrange(12)) for _ in range(60)] + [None, "aaa"]
    new = [name(rng.randrange(6)) for _ in range(150)] + [None, "", "a", "aaaa", known[3], "100%_"]
    a = spark.createDataFrame([(k, x) for k, x in enumerate(new)], "k long, name string")
    b = spark.createDataFrame([(x,) for x in known], "name string")
    got = {r.k for r in assemble.uncontained_rows(a, b, "name").collect()}
    assert got == {k for k, x in enumerate(new) if x is None or not any(y is not None and x in y for y in known)}
    assert assemble.uncontained_rows(a, b.limit(0), "name").count() == len(new)


def test_wide_correlations_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 50)) @ rng.standard_normal((50, 50)) + 1e6
    x[:, 7] = 3.5
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [[None if np.isnan(c) and k % 2 else float(c) for k, c in enumerate(r)] for r in x]
    names = [f"c.{k}" for k in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(5)
    for wide in (profile.WIDE, 20):
        got = {(r.a, r.b): r.r for r in profile.wide_correlations(df, names, wide).collect()}
        assert len(got) == 50 * 49 // 2
        for i in range(50):
            for j in range(i + 1, 50):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                r = got.get((names[i], names[j]), got.get((names[j], names[i])))
                assert (r is None) if 7 in (i, j) else abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9


def test_groups_of_correlated_features_against_all_pairs(spark):
    rng = random.Random(9)
    names = [f"f{k}" for k in range(14)]
    pairs = [(a, b, rng.choice([None, round(rng.uniform(-1, 1), 1)])) for i, a in enumerate(names) for b in names[i + 1 :]]
    got = assemble.correlation_groups(spark.createDataFrame(pairs, "a string, b string, r double"), 4, 5)
    order = sorted((p for p in pairs if p[2] is not None), key=lambda p: (-abs(p[2]), p[0], p[1]))
    want, used = [], set()
    for f in sorted(names):
        partners = [b if a == f else a for a, b, _ in order if f in (a, b)]
        group = [f, *partners][:4]
        if partners and len(want) < 5 and sum(g in used for g in group) < 3:
            want.append(group)
            used |= set(group)
    assert got == want


def brute_average(rows, rate, lag):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == g)
        for i, (_, day, _) in enumerate(own):
            past = [(d, v) for _, d, v in own[: max(0, i - lag + 1)] if v is not None]
            last = past[-1][0] if past else 0
            w = [rate ** (last - d) for d, _ in past]
            out[g, day] = sum(a * v for a, (_, v) in zip(w, past)) / sum(w) if past else None
    return out


@pytest.mark.parametrize("rate", [0.5, 0.97, 1.0])
def test_decays_over_any_length(spark, rate):
    rng = random.Random(7)
    rows = [("long", d, rng.uniform(-5, 5)) for d in sorted(rng.sample(range(20000), 300))]
    # nulls for longer than any weight lasts, then values again
    rows += [("gap", d, None if 100 < d < 9000 else rng.uniform(1, 2)) for d in range(0, 12000, 53)] + [("none", 3, None), ("none", 9000, None), ("one", 5, 2.0)]
    rows += [(None, 1, 4.0), (None, 2, 6.0)]
    df = spark.createDataFrame(rows, "g string, n int, v double").select("g", F.date_add(F.lit("1970-01-01").cast("date"), F.col("n")).alias("day"), "v", "n")
    for lag in (0, 2):
        got = {(r.g, r.n): r.avg for r in series.lagged_weighted_average(df, ["g"], "v", rate, "day", lag, "avg").collect()}
        want = brute_average([("" if g is None else g, n, v) for g, n, v in rows], rate, lag)
        assert len(got) == len(rows)
        for (g, n), v in got.items():
            w = want["" if g is None else g, n]
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-9)
    final = {r.g: r[1] for r in series.weighted_average(df, ["g"], "v", rate, "day").collect()}
    last = brute_average([("" if g is None else g, n, v) for g, n, v in rows], rate, 0)
    for g, v in final.items():
        w = last["" if g is None else g, max(n for h, n, _ in rows if h == g)]
        assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-9)
