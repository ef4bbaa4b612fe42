"""Joins that build a feature matrix, set operations, and the feature registry with its selection rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranges import numbered


def feature_matrix(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """``base`` with every part's columns by key; shuffles partition by the key once and are reused."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, base)


def stack_predictions(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One ``oof_{model}`` column a model, rows of every key that some model has."""
    rows = [d.select(key, F.lit(m).alias("_m"), F.col("prediction").alias("_p")) for m, d in parts.items()]
    wide = reduce(DataFrame.union, rows).groupBy(key).pivot("_m", list(parts)).agg(F.first("_p"))
    return wide.select(key, *[F.col(m).alias(f"oof_{m}") for m in parts])


def nearest(df: DataFrame, name: str, distance: str) -> DataFrame:
    """The row, or rows if tied, at the least distance for each name; a grouped minimum, so names may be hot."""
    least = df.groupBy(name).agg(F.min(distance).alias("_d"))
    return df.join(least, name).filter(F.col(distance) == F.col("_d")).drop("_d")


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.join(dimension, key)


def reindexed(df: DataFrame, value: str, where: Column) -> DataFrame:
    """The whole grid; ``value`` only where the condition holds."""
    return df.withColumn(value, F.when(where, F.col(value)))


def compare_predictions(pred: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    both = pred.join(actual, key)
    return both.withColumn("diff", F.col("prediction") - F.col("target")).orderBy(F.desc("diff"), key)


def contained(name: Column, parts: Sequence[str]) -> Column:
    """The distinct ``parts`` (a short list) that ``name`` contains."""
    return F.filter(F.array(*map(F.lit, dict.fromkeys(parts))), lambda p: name.contains(p))


def combinations_made(groups: Sequence[Sequence[str]], features: DataFrame) -> DataFrame:
    """All combinations of three short name lists with ``made``: whether some feature's name contains all three.

    Each feature is looked at once and gives the combinations that it makes."""
    name, axes = F.col("feature"), ("x", "y", "z")
    made = features.select(*[contained(name, g).alias(f"_{a}") for a, g in zip(axes, groups)])
    grid = features.sparkSession.range(1).select(*[F.array(*map(F.lit, dict.fromkeys(g))).alias(f"_{a}") for a, g in zip(axes, groups)])
    for a in axes:
        made = made.select("*", F.explode(f"_{a}").alias(a)).drop(f"_{a}")
        grid = grid.select("*", F.explode(f"_{a}").alias(a)).drop(f"_{a}")
    found = made.distinct().withColumn("made", F.lit(1))
    return grid.join(found, list(axes), "left").select(*axes, F.coalesce("made", F.lit(0)).alias("made"))


def column_usage(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dataset, column, n): in how many features' names a column's name occurs; a name counts once a feature."""
    pairs = features.select("feature", "dataset", F.explode(contained(F.col("feature"), columns)).alias("column"))
    return pairs.distinct().groupBy("dataset", "column").agg(F.count("*").alias("n"))


def new_rows(df: DataFrame, known: DataFrame, name: str) -> DataFrame:
    return df.join(known, name, "left_anti")


#: Characters of a gram.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))


def uncontained_rows(df: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``df`` without the rows whose name is part of a known name; null names stay, an empty name is part of any.

    An inverted index of the known names' grams: a name contained in another has all its grams there, so one with a gram
    that no known name has stays at once, and the others meet the list of their rarest gram only, where ``contains`` decides. Names
    shorter than ``GRAM`` look among grams of their own length."""
    wanted = stored(df.select(F.col(name).alias("_new")).filter("_new IS NOT NULL").distinct(), "names")
    had = stored(known.select(F.col(name).alias("_known")).filter("_known IS NOT NULL").distinct(), "known")
    size = F.least(F.length("_new"), F.lit(GRAM))
    sizes = [r.size for r in wanted.filter("_new <> ''").select(size.alias("size")).distinct().collect()]
    found = [wanted.filter("_new = ''").select("_new") if not had.isEmpty() else wanted.limit(0)]
    for k in sizes:
        posts = stored(had.filter(F.length("_known") >= k).select("_known", F.explode(_grams(F.col("_known"), k)).alias("_gram")), "posts")
        counts = posts.groupBy("_gram").agg(F.count("*").alias("_n"))
        asked = wanted.filter((size == k) & (F.col("_new") != "")).select("_new", F.explode(_grams(F.col("_new"), k)).alias("_gram"))
        rated = asked.join(counts, "_gram", "left").groupBy("_new").agg(F.count_if(F.col("_n").isNull()).alias("_missing"), F.min(F.struct("_n", "_gram")).alias("_x"))
        rarest = stored(rated.filter("_missing = 0").select("_new", F.col("_x._gram").alias("_gram")), "rarest")
        found.append(posts.join(rarest, "_gram").filter(F.contains("_known", "_new")).select("_new").distinct())
    gone = reduce(DataFrame.union, found)
    return df.join(gone, F.col(name) == F.col("_new"), "left_anti")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def counts_of_top(parts: dict[str, DataFrame], column: str, n: int, alphabetic: bool = False) -> DataFrame:
    """(value, place, a count per frame): the ``n`` most frequent values of the first frame, in the order of their counts
    there or of the alphabet, with their counts in each frame side by side."""
    first = next(iter(parts.values()))
    top = top_values(first.filter(F.col(column).isNotNull()), column, n)
    out = numbered(top, [column] if alphabetic else [F.desc("n"), column], "place").select(column, "place")
    for name, df in parts.items():
        counts = df.join(F.broadcast(top.select(column)), column, "left_semi").groupBy(column).agg(F.count("*").alias(name))
        out = out.join(counts, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def select_features(importance: DataFrame, rank: int | None = None, gain: float | None = None) -> DataFrame:
    out = importance if rank is None else importance.filter(F.col("rank") <= rank)
    return out if gain is None else out.filter(F.col("importance") >= gain)


def ranked(importance: DataFrame) -> DataFrame:
    """1 to n by falling importance, then name."""
    return numbered(importance, [F.desc("importance"), "feature"], "rank")


def demote(registry: DataFrame, importance: DataFrame, rank: int, keys: Sequence[str], tier: str = "third_valid") -> DataFrame:
    named = reduce(lambda a, b: a | b, [F.col("feature").contains(k) for k in keys], F.lit(False))
    joined = registry.join(importance.select("feature", "rank"), "feature", "left")
    return joined.withColumn("tier", F.when((F.col("rank") >= rank) & named, F.lit(tier)).otherwise(F.col("tier"))).drop("rank")


def promote(registry: DataFrame, best: DataFrame, tier: str = "winner") -> DataFrame:
    marked = best.select("feature").distinct().withColumn("_in", F.lit(True))
    return registry.join(marked, "feature", "left").withColumn("tier", F.when(F.col("_in"), F.lit(tier)).otherwise(F.col("tier"))).drop("_in")


def move_named(registry: DataFrame, part: str, tier: str) -> DataFrame:
    return registry.withColumn("tier", F.when(F.col("feature").contains(part), F.lit(tier)).otherwise(F.col("tier")))


def not_containing(names: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Names that contain none of ``parts`` (a short list)."""
    return names.filter(F.size(contained(F.col("feature"), parts)) == 0)


def parity(registry: DataFrame) -> DataFrame:
    """Features that only one of train and test has."""
    return registry.filter(F.col("has_train") != F.col("has_test")).select("feature", F.when(F.col("has_train"), "train").otherwise("test").alias("side"))


def first_per_combination(xs: Sequence[str], ys: Sequence[str], registry: DataFrame, method: str) -> DataFrame:
    """The first feature, by name, that contains x, y and ``method``; each feature is looked at once."""
    name = F.col("feature")
    pairs = registry.filter(name.contains(method)).select("feature", F.explode(contained(name, xs)).alias("x"), contained(name, ys).alias("_y"))
    return pairs.select("feature", "x", F.explode("_y").alias("y")).groupBy("x", "y").agg(F.min("feature").alias("feature"))


def matrix_features(registry: DataFrame, importance: DataFrame | None = None, rank: int = 50_000, gain: float = 0.0, limit: int = 3000) -> DataFrame:
    """(feature, in_train): the features of a matrix, from ``registry`` (feature, has_train, has_test, is_valid).

    With ``importance`` (feature, rank, importance) the train side keeps those of ``gain`` and more, or without a gain those
    up to ``rank``, the test side those up to ``rank``; valid ones are kept whatever their importance. The test side
    takes the first ``limit`` by name; the train side has no feature that the test side lacks."""
    chosen = registry.withColumns({"_tr": F.col("has_train"), "_te": F.col("has_test")})
    if importance is not None:
        i = importance.select(F.col("feature").alias("_f"), F.col("rank").alias("_rank"), F.col("importance").alias("_gain"))
        by_rank = F.coalesce(F.col("_rank") <= rank, F.lit(False))
        by_gain = F.coalesce(F.col("_gain") >= gain, F.lit(False)) if gain else by_rank
        chosen = registry.join(i, F.col("feature") == F.col("_f"), "left")
        chosen = chosen.withColumns({"_tr": F.col("has_train") & (by_gain | F.col("is_valid")), "_te": F.col("has_test") & (by_rank | F.col("is_valid"))})
    return chosen.filter("_te").orderBy("feature").limit(limit).select("feature", F.col("_tr").alias("in_train"))


def correlation_groups(pairs: DataFrame, size: int = 5, most: int = 11) -> list[list[str]]:
    """Greedy groups of the strongest partners; of each feature its ``size - 1`` strongest reach the driver."""
    known = pairs.filter("r IS NOT NULL").select("a", "b", F.abs("r").alias("s"))
    both = known.select("a", "b", "s", F.col("a").alias("of"), F.col("b").alias("other")).union(known.select("a", "b", "s", F.col("b").alias("of"), F.col("a").alias("other")))
    place = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("s"), "a", "b"))
    rows = both.withColumn("place", place).filter(F.col("place") < size).select("of", "place", "other").orderBy("of", "place").collect()
    partners: dict[str, list[str]] = {}
    for r in rows:
        partners.setdefault(r.of, []).append(r.other)
    used: set[str] = set()
    groups = []
    for f in sorted(partners):
        group = [f, *partners[f]][:size]
        if len(groups) < most and sum(x in used for x in group) < 3:
            groups.append(group)
            used |= set(group)
    return groups


def similar(vectors: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """(doc_id, similarity): the ``n`` documents with the largest cosine to a sparse query vector (category, weight).

    ``vectors``: (doc_id, categories map). An equi-join on the category; documents without any in common have none."""
    long = vectors.select("doc_id", F.explode("categories").alias("category", "w"))
    norm = long.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = query.select("category", F.col("weight").alias("q"))
    own = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"))
    dots = long.join(q, "category").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    scored = dots.join(norm, "doc_id").crossJoin(F.broadcast(own))
    return scored.select("doc_id", F.try_divide("dot", F.col("norm") * F.col("q_norm")).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(n)


def changed_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, side, n_rows): the columns that only one of two frames has, with that frame's rows."""
    made = []
    for side, df, other in (("before", before, after), ("after", after, before)):
        names = [c for c in df.columns if c not in other.columns]
        rows = df.agg(F.count("*").alias("n_rows"))
        made.append(rows.select(F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("column"), F.lit(side).alias("side"), "n_rows"))
    return made[0].union(made[1])


def mapped(df: DataFrame, functions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``df`` with a function of Column to Column applied to each named column."""
    return df.select(*[functions[c](F.col(c)).alias(c) if c in functions else F.col(c) for c in df.columns])
