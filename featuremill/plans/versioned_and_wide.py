"""Queries: table versions and new fields, containment in incremental loads, wide correlations, decays over long histories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assemble, profile, series
from ..sources import tables
from ..sources.scratch import scratch, stored
from ..sources.versions import VersionedTable
from .catalog import query, rounded


def _removed(t, path: str) -> None:
    p = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@query(
    "io14_versions",
    """SELECT 1 AS version, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, NULL::BIGINT AS notes, true AS files_kept FROM orders GROUP BY 2
    UNION ALL SELECT 2, o_orderstatus, count(*), sum(o_orderkey)::BIGINT, NULL, true FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 2
    UNION ALL SELECT 4, o_orderstatus, count(*), sum(o_orderkey)::BIGINT, nullif(sum(note), 0)::BIGINT, true FROM (SELECT o_orderstatus, o_orderkey, 0 AS note FROM orders WHERE o_orderstatus NOT IN ('F', 'P') UNION ALL SELECT 'new', c_custkey, 1 FROM customer) GROUP BY 2""",
)
def io14_versions(t):
    path = scratch(t.spark, "orders")
    held = VersionedTable(t.spark, path)
    held.create(t("orders").select("o_orderkey", "o_orderstatus"), by=["o_orderstatus"])
    before = set(held.files())
    held.delete(F.col("o_orderstatus").isin("F", "P"))
    # files without a deleted status are the same ones; the others are in no later version
    kept = {f for f in before if f in set(held.files())}
    left = held.read(1).withColumn("file", F.col("_metadata.file_name")).filter(~F.col("o_orderstatus").isin("F", "P")).select("file").distinct().collect()
    hit = held.read(1).withColumn("file", F.col("_metadata.file_name")).filter(F.col("o_orderstatus").isin("F", "P")).select("file").distinct().collect()
    as_expected = {f.rsplit("/", 1)[1] for f in kept} == {r.file for r in left} - {r.file for r in hit}
    held.add_field("note", "long")
    held.append(t("customer").select(F.col("c_custkey").alias("o_orderkey"), F.lit("new").alias("o_orderstatus"), F.lit(1).alias("note")))
    parts = []
    for version in (1, 2, 4):
        rows = held.read(version)
        notes = F.sum("note") if "note" in rows.columns else F.lit(None).cast("long")
        parts.append(rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), notes.alias("notes")).select(F.lit(version).alias("version"), "*", F.lit(as_expected).alias("files_kept")))
    out = stored(assemble.union_all(parts), "rows")
    _removed(t, path)
    return out


@query("io15_added_field", "SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::DOUBLE AS gdp FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey * 1.5 FROM region")
def io15_added(t):
    name = f"fields_{uuid.uuid4().hex}"
    tables.append_table(t("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), name)
    tables.add_field(t.spark, name, "gdp", "double")
    tables.append_table(t("region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 1.5).cast("double").alias("gdp")), name)
    out = stored(t.spark.table(name), "rows")
    t.spark.sql(f"DROP TABLE {name}")
    return out


@query(
    "j12_contained_names",
    """WITH n AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part), k AS (SELECT DISTINCT p_type || ' ' || p_name || ' ' || p_brand AS name FROM part WHERE p_size = 1)
    SELECT p_partkey, name FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE contains(k.name, n.name))""",
)
def j12_contained(t):
    new = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    known = t("part").filter("p_size = 1").select(F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("name"))
    return assemble.uncontained_rows(new, known, "name").select("p_partkey", "name")


WIDE = 64


def _entries(t):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t("embeddings").select(*[F.when(F.abs(e(k)) > F.lit(0.02).cast("float"), e(k)).alias(f"e{k}") for k in range(WIDE)])


@query(
    "q10_wide_correlations",
    f"""WITH x AS (SELECT list_transform(embedding, lambda c: CASE WHEN abs(c) > 0.02::FLOAT THEN c::DOUBLE END) AS e FROM embeddings)
    SELECT 'e' || i AS a, 'e' || j AS b, round(corr(e[i + 1], e[j + 1]), 4) AS r FROM x, range({WIDE}) p(i), range({WIDE}) q(j) WHERE i < j GROUP BY i, j""",
)
def q10_wide(t):
    return rounded(profile.correlations(_entries(t), [f"e{k}" for k in range(WIDE)]))


@query("f06_wide_groups")
def f06_wide(t):
    groups = assemble.correlation_groups(profile.correlations(_entries(t), [f"e{k}" for k in range(WIDE)]))
    return t.spark.createDataFrame([(i, f) for i, g in enumerate(groups) for f in g], "group_no int, feature string")


@query(
    "t05_long_history",
    """WITH d AS (SELECT o_orderpriority AS g, o_orderdate::DATE + (datediff('day', DATE '1992-01-01', o_orderdate::DATE) * 7)::INT AS day, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY day) AS n, lag(day) OVER (PARTITION BY g ORDER BY day) AS last FROM d)
    SELECT a.g, a.day, round(sum(b.v * pow(0.5, a.last - b.day)) / sum(pow(0.5, a.last - b.day)), 2) AS wg FROM r a LEFT JOIN r b ON a.g = b.g AND b.n <= a.n - 1 AND b.n > a.n - 40 GROUP BY 1, 2""",
)
def t05_long(t):
    """Days stretched to eight times their distance, at rate 0.5: far more than one double's range of weights."""
    day = F.date_add(F.to_date("o_orderdate"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) * 7)
    daily = t("orders").filter("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("g"), day.alias("day")).agg(F.sum("o_totalprice").alias("v"))
    out = series.lagged_weighted_average(daily, ["g"], "v", 0.5, "day", 1, "wg")
    return out.select("g", "day", F.round("wg", 2).alias("wg"))
