"""Reading and writing tables, feature stores, catalog tables and text formats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import safe_name
from ..operators.ranges import numbered


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def write_parts(df: DataFrame, path: str, parts: int) -> None:
    df.repartition(parts).write.mode("overwrite").parquet(path)


def read_parts(spark: SparkSession, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(pattern)
    return df.select(*columns) if columns else df


def save_features(df: DataFrame, key: str, target: str, path: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Keyed float features, split by ``is_train``, a folder each below ``path``; those that are there are left alone. One
    scan writes all. Returns registry rows (feature, path)."""
    names = [c for c in df.columns if c not in (key, target, *ignore)]
    there = {f.removeprefix("feature=") for f in _folders(df.sparkSession, path)}
    new = [c for c in names if safe_name(c) not in there]
    if new:
        values = F.array(*[F.struct(F.lit(safe_name(c)).alias("feature"), F.col(f"`{c}`").cast("float").alias("value")) for c in new])
        long = df.select(key, F.col(target).isNotNull().cast("int").alias("is_train"), F.explode(values).alias("x")).select(key, "x.value", "x.feature", "is_train")
        # whole partitions of a feature, split where they are large
        long.hint("rebalance", "feature").write.mode("append").partitionBy("feature", "is_train").parquet(path)
    return df.sparkSession.createDataFrame([(c, path) for c in names], "feature string, path string")


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def load_features(spark: SparkSession, registry: DataFrame, key: str) -> DataFrame:
    """The registered features (a bounded list of names) beside the key: one pruned scan a store, one pivot."""
    rows = registry.collect()
    stores: dict[str, list[str]] = {}
    for r in rows:
        stores.setdefault(r.path, []).append(safe_name(r.feature))
    parts = [spark.read.option("basePath", p).parquet(p).filter(F.col("feature").isin(names)).select(key, F.col("feature").cast("string").alias("feature"), "value") for p, names in stores.items()]
    wide = reduce(DataFrame.union, parts).groupBy(key).pivot("feature", [safe_name(r.feature) for r in rows]).agg(F.first("value"))
    return wide.select(key, *[F.col(f"`{safe_name(r.feature)}`").alias(r.feature) for r in rows])


def select_named(df: DataFrame, key: str, marker: str = "@", prefix: str = "", only: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """The key and the columns with ``marker`` in their names, all but ``ignore`` or ``only`` some; names made safe and prefixed."""
    names = [c for c in df.columns if marker in c and (only is None or c in only) and c not in (key, *ignore)]
    return df.select(key, *[F.col(f"`{c}`").alias(prefix + safe_name(c)) for c in names])


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def schema_of(columns: Sequence[tuple[str, str, bool]]) -> StructType:
    """(name, type, whether null is allowed) of each column."""
    return StructType.fromDDL(", ".join(f"`{name}` {kind}{'' if nullable else ' NOT NULL'}" for name, kind, nullable in columns))


def insert_csv(spark: SparkSession, path: str, name: str, schema: StructType, header: bool = True) -> None:
    """Append the CSV files at ``path`` to a table; with ``header`` each file's first row is skipped."""
    spark.read.csv(path, header=header, schema=schema).write.mode("append").saveAsTable(name)


def list_tables(spark: SparkSession, database: str, prefix: str = "") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.name.startswith(prefix))


def drop_database(spark: SparkSession, name: str) -> None:
    """With all its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def create_table(spark: SparkSession, name: str, schema: StructType) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def table_from_query(spark: SparkSession, name: str, query: str) -> DataFrame:
    spark.sql(query).write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def without_rows(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """The table after DELETE … WHERE column IN values: nulls stay."""
    return df.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def with_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def add_field(spark: SparkSession, name: str, column: str, kind: str) -> None:
    """A nullable column more in a catalog table: files from before read as null there."""
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`{column}` {kind})")


def drop_tables(spark: SparkSession, database: str, prefix: str) -> list[str]:
    names = list_tables(spark, database, prefix)
    for n in names:
        spark.sql(f"DROP TABLE {database}.{n}")
    return names


def field_codes(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(field, value, code) of each category's values, as text; fields and codes are numbered after those of ``numbers``."""
    codes = df.sparkSession.createDataFrame([], "field int, value string")
    for i, c in enumerate(categories, len(numbers)):
        codes = codes.union(df.select(F.lit(i).alias("field"), F.col(f"`{c}`").cast("string").alias("value")).filter("value IS NOT NULL").distinct())
    return numbered(codes, ["field", "value"], "code").withColumn("code", F.col("code") - 1 + len(numbers))


def with_field_codes(df: DataFrame, codes: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """``df`` with ``_c_{c}``, the code of each category's value: null where it has none."""
    out = df
    for i, c in enumerate(categories, len(numbers)):
        own = codes.filter(F.col("field") == i).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out


def ffm_lines(df: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """``line``: label and field:feature:value of every row. Numbers take the first codes; then each (field, value)."""
    fields = {c: i for i, c in enumerate([*numbers, *categories])}
    out = with_field_codes(df, field_codes(df, numbers, categories), numbers, categories)
    items = [F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(str(fields[c])), F.lit(str(fields[c])), F.col(c).cast("string"))) for c in numbers]
    items += [F.when(F.col(f"_c_{c}").isNotNull(), F.concat_ws(":", F.lit(str(fields[c])), F.col(f"_c_{c}").cast("string"), F.lit("1"))) for c in categories]
    return out.select(*df.columns, F.concat_ws(" ", F.col(target).cast("string"), *items).alias("line"))


def labelled_lines(df: DataFrame, label: str, text: str) -> DataFrame:
    """``line``: ``__label__{label}, `` and the text's words."""
    words = F.array_join(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return df.select(*df.columns, F.concat(F.lit("__label__"), F.col(label).cast("string"), F.lit(", "), words).alias("line"))


def map_chunks(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A user's function of pandas frames over chunks of rows, in parallel."""
    return df.mapInPandas(lambda frames: (function(f) for f in frames), schema)


