"""Composite data sets: cleansing of a loan application's tables, count features, model-ready sets, the store set.

The column names, sentinels and limits below are fixed values of these data sets; every one is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from .aggregate import label_frequencies
from .assemble import lookup, nearest, union_all
from .cleanse import cap, conditional_copies, drop_named, keep_where, last_per_key, not_equal, numerics, regularise, standardise, strings
from .encode import count_encode, label_encode, one_hot, ordinal_codes
from .profile import correlations, unusable

# Fixed values.
REVOLVING, UNKNOWN = "Revolving loans", "XNA"
SPLIT_MARKS = ("is_train", "is_test", "valid_no")
APPLICATION_AMOUNTS = ("AMT_ANNUITY", "AMT_CREDIT", "AMT_GOODS_PRICE")
BUREAU_DAYS = ("DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE")
PREVIOUS_AMOUNTS = ("AMT_CREDIT", "AMT_ANNUITY", "AMT_APPLICATION", "CNT_PAYMENT", "AMT_DOWN_PAYMENT", "RATE_DOWN_PAYMENT")
PREVIOUS_DAYS = ("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION")
PREVIOUS_KEYS = ("SK_ID_CURR", "SK_ID_PREV", "NAME_CONTRACT_TYPE", "NAME_CONTRACT_STATUS")
PREVIOUS_FILLED = ("NAME_TYPE_SUITE", "PRODUCT_COMBINATION")
UNFINISHED = ("Signed", "Approved", "XNA")


def clean_application(df: DataFrame, amounts: Sequence[str] = APPLICATION_AMOUNTS, most_income: float = 1e6) -> DataFrame:
    """Without split flags; income capped (null: the cap), gender XNA as F, null strings as XNA, revolving-only amounts beside."""
    for mark in SPLIT_MARKS:
        df = drop_named(df, mark)
    df = cap(df, {"AMT_INCOME_TOTAL": most_income}).replace("XNA", "F", ["CODE_GENDER"])
    df = df.fillna(UNKNOWN, strings(df))
    return conditional_copies(df, F.col("NAME_CONTRACT_TYPE") == REVOLVING, "revo_", [c for c in df.columns if c not in amounts])


def clean_bureau(df: DataFrame, days: Sequence[str] = BUREAU_DAYS, least: int = -36000) -> DataFrame:
    return keep_where(df, {c: (">", least) for c in days})


def clean_previous(df: DataFrame) -> DataFrame:
    """Amounts above zero, days below the sentinel, area capped; revolving-only copies of every column but the keys; null strings of two columns as XNA."""
    rules = {c: (">", 0) for c in PREVIOUS_AMOUNTS} | {c: ("<", 100_000) for c in PREVIOUS_DAYS}
    df = cap(keep_where(df, rules), {"SELLERPLACE_AREA": 200})
    df = conditional_copies(df, F.col("NAME_CONTRACT_TYPE") == REVOLVING, "revo_", PREVIOUS_KEYS)
    return df.fillna(UNKNOWN, list(PREVIOUS_FILLED))


def clean_monthly(df: DataFrame) -> DataFrame:
    """Finished statuses only: running months as they are, and per loan the earliest month without instalments to come, as completed.

    Completed months that still have instalments are active; rows without a number of instalments go."""
    status, future = F.col("NAME_CONTRACT_STATUS"), F.col("CNT_INSTALMENT_FUTURE")
    for s in UNFINISHED:
        df = df.filter(not_equal(status, s))
    df = df.withColumn("NAME_CONTRACT_STATUS", F.when((status == "Completed") & not_equal(future, 0), "Active").otherwise(status))
    done = last_per_key(df.filter(future == 0), "SK_ID_PREV", F.asc("MONTHS_BALANCE")).withColumn("NAME_CONTRACT_STATUS", F.lit("Completed"))
    return union_all([done, df.filter(future > 0)])


def clean_instalments(df: DataFrame) -> DataFrame:
    return df.filter(F.col("AMT_INSTALMENT") > 0)


def clean_card(df: DataFrame) -> DataFrame:
    """Nulls of amounts and counts as zero."""
    return df.fillna(0, [c for c in numerics(df) if "AMT" in c or "CNT" in c])


def count_features(base: DataFrame, df: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """``base`` (key) with the counts of every categorical of ``df`` beside its key's rows, but for constant ones."""
    for c in strings(df, [key, *ignore]):
        df = count_encode(df, c)
    made = [c for c in df.columns if c.startswith("cnt_")]
    joined = lookup(base.select(key), df.select(key, *made), key)
    flat = joined.agg(*[F.coalesce((F.var_pop(c) == 0) & (F.count_if(F.col(c).isNull()) == 0), F.lit(False)).alias(c) for c in made]).first()
    return joined.drop(*[c for c in made if flat[c]])


def model_ready(df: DataFrame, predictions: dict[str, DataFrame], key: str, ignore: Sequence[str] = (), scale: str = "max") -> DataFrame:
    """Numbers regularised (infinities to null, mean, scaled, float), and a column for each model's prediction by ``key``."""
    out = regularise(df, numerics(df, [key, *ignore]), scale)
    for name, p in predictions.items():
        out = out.join(p.select(key, F.col("prediction").alias(name)), key, "left")
    return out


def prediction_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return correlations(df, names)


def checked(train: DataFrame, test: DataFrame, target: str, encode: str = "", ignore: Sequence[str] = (), most: int = 1000) -> tuple[DataFrame, list[str]]:
    """Train and test rows with the categoricals encoded (``label``, ``dummie`` or ``ordinal``), and the columns to leave
    out: dates, and what has at most one distinct value in the test rows."""
    df = union_all([train, test.withColumn(target, F.lit(None).cast(dict(train.dtypes)[target])) if target not in test.columns else test])
    for c in strings(df, [target, *ignore]):
        if encode == "label":
            df = label_encode(df, c).drop(c).withColumnRenamed(f"{c}_code", c)
        elif encode == "dummie":
            df = one_hot(df, c, most=most)
        elif encode == "ordinal":
            codes = ordinal_codes(df, c, [c])
            df = df.join(codes.select(F.col("value").alias(c), F.col("code").alias("_code")), c, "left").withColumn(c, F.coalesce("_code", F.lit(0))).drop("_code")
    tested = df.filter(F.col(target).isNull()).drop(target)
    return df, [c for c in unusable(df.drop(target), tested) if c not in ignore]


def clean_stores(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Without repeated header rows (``seat`` in ``seat``), numbers cast (else null), rate 0 and repeated rows gone."""
    df = df.filter(not_equal(F.col("seat"), "seat"))
    df = df.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in df.columns])
    return df.filter(not_equal(F.col("rate"), 0.0)).distinct()


def store_set(df: DataFrame, stations: DataFrame, numbers: Sequence[str] = ("rate", "review"), encode: bool = True) -> DataFrame:
    """The stores' model set: cleaned, opening month, distance to the station, each name at its nearest station, seats as
    numbers, genre frequencies; with ``encode`` the numbers are standardised and the texts go."""
    rows = clean_stores(df, numbers).withColumn("open_date", fn.japanese_month(F.col("open_date")))
    rows = lookup(rows, stations, "station")
    rows = rows.withColumn("distance_station", fn.cosine_law_km(F.col("station_longitude"), F.col("station_latitude"), F.col("longitude"), F.col("latitude")))
    rows = nearest(rows, "name", "distance_station").withColumn("seat", fn.half_width_digits(F.col("seat")).try_cast("double"))
    if not encode:
        return rows
    genres = label_frequencies(rows, "name", "genre", "、").select("name", F.col("n_parts").alias("n_genres"), F.col("frequency").alias("genre_frequency"))
    rows = rows.join(genres, "name", "left").distinct()
    rows = rows.drop("genre", "pr_comment", "local", "street", "station", "longitude", "latitude", "station_longitude", "station_latitude")
    return standardise(rows, [c for c in numerics(rows) if c != "name"])


def ward_dummies(df: DataFrame, column: str, ward: str = "港") -> DataFrame:
    """Rows of ``ward`` only (rows without any count as its), with a 0 / 1 column for each street behind the ward's name."""
    text = F.col(column)
    kept = df.withColumn("_ward", fn.ward(text, default=ward)).filter(F.col("_ward") == ward)
    kept = kept.withColumn("street", F.when(text.contains("区"), F.split(text, "区")[1]).otherwise(text)).drop("_ward", column)
    return one_hot(kept, "street")


def page_fields(html: Column, patterns: dict[str, str], flags: dict[str, str], linked: dict[str, str], numbers: Sequence[str] = ()) -> list[Column]:
    """One column per rule. ``patterns``: the first group of a regex, null if absent or empty; ``flags``: 1 if a keyword
    occurs, else 0; ``linked``: a JSON path into the page's first JSON-LD block. ``numbers`` are cast, absent ones are 0;
    of a budget only the digits count."""
    block = F.regexp_extract(html, r"(?s)<script[^>]*ld\+json[^>]*>(.*?)</script>", 1)
    made = {n: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")) for n, p in patterns.items()}
    made |= {n: F.nullif(F.get_json_object(block, p), F.lit("")) for n, p in linked.items()}
    for n in numbers:
        made[n] = F.coalesce(F.nullif(F.regexp_replace(made[n], r"[^0-9.]", ""), F.lit("")).try_cast("double"), F.lit(0.0))
    made |= {n: html.contains(k).cast("int") for n, k in flags.items()}
    return [c.alias(n) for n, c in made.items()]


def point_of(url: Column, name: str = "center") -> tuple[Column, Column]:
    """(latitude, longitude) of a query string's ``name=latitude,longitude``; null if there is none."""
    pair = F.split(F.regexp_extract(url, rf"[?&]{name}=([-0-9.]+,[-0-9.]+)", 1), ",")
    return F.get(pair, 0).try_cast("double"), F.get(pair, 1).try_cast("double")
