"""The same features over streams: trailing statistics and daily counts with a watermark, decayed means in keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


#: Aggregates that a stream can keep by name.
METHODS = {"min": F.min, "mean": F.avg, "max": F.max, "count": F.count, "std": F.stddev_samp, "skew": F.skewness}


def trailing_stream(df: DataFrame, ts: str, entity: Sequence[str], value: str, days: int = 7, late: str = "1 day", methods: Sequence[str] = ("min", "mean", "max", "count")) -> DataFrame:
    """Per entity and day, statistics of the last ``days`` days."""
    rows = _timed(df, ts).withWatermark(ts, late).groupBy(F.window(ts, f"{days} days", "1 day"), *entity)
    return rows.agg(*[METHODS[m](value).alias(m) for m in methods]).select(F.col("window.end").alias("until"), *entity, *methods)


def daily_counts_stream(df: DataFrame, ts: str, category: str, late: str = "1 day") -> DataFrame:
    rows = _timed(df, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day"), category).agg(F.count("*").alias("n"))
    return rows.select(F.to_date("window.start").alias("day"), category, "n")


STATE = "top double, low double, day int, n long"


def decayed_stream(df: DataFrame, ts: str, entity: Sequence[str], value: str, rate: float, salt: int = 16, keep: int | None = None, late: str = "1 day") -> DataFrame:
    """Sums behind a decayed mean, per entity and salt, whenever rows come: (entity, salt, top, low, day, n).

    ``top`` and ``low`` are the sums of value and of one, each times ``rate`` to the days before ``day``, the latest day seen;
    ``n`` counts values (a null value adds to ``low`` only, as in the batch). The state is a few numbers, does not depend on
    the order of rows, and takes rows of any lateness. An entity's rows are dealt over ``salt`` states, so that a hot one is
    not one task; ``merged_decays`` adds them up. ``keep``: a state without rows for so many days of event time goes, and
    rows later than the watermark are then left out."""
    if not 0 < rate <= 1:
        raise ValueError("the rate is above 0 and at most 1")
    rows = _timed(df, ts)
    if keep is not None:
        rows = rows.withWatermark(ts, late)
    rows = rows.select(*entity, F.pmod(F.xxhash64(ts, value), F.lit(salt)).cast("int").alias("salt"), F.unix_date(F.to_date(ts)).alias("_day"), F.col(value).cast("double").alias("_value"), *([ts] if keep is not None else []))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        top, low, day, n = state.get if state.exists else (0.0, 0.0, None, 0)
        for rows in batches:
            days, values = rows["_day"].to_numpy(dtype=float), rows["_value"].to_numpy(dtype=float)
            newest = int(days.max()) if day is None else max(day, int(days.max()))
            if day is not None:
                top, low = top * rate ** (newest - day), low * rate ** (newest - day)
            weights = rate ** (newest - days)
            top, low, day, n = top + float(np.nansum(values * weights)), low + float(weights.sum()), newest, n + int((~np.isnan(values)).sum())
        state.update((top, low, day, n))
        if keep is not None:
            until = (day + 1 + keep) * 86_400_000
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{c: [k] for c, k in zip([*entity, "salt"], key)}, "top": [top], "low": [low], "day": [day], "n": [n]})

    kinds = dict(rows.dtypes)
    out = ", ".join([*[f"`{e}` {kinds[e]}" for e in entity], "salt int", STATE])
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    return rows.filter(F.col("_day").isNotNull()).groupBy(*entity, "salt").applyInPandasWithState(step, out, STATE, "update", timeout)


def run_into(stream: DataFrame, folder: str, checkpoint: str, seconds: int | None = None) -> DataFrame:
    """Runs ``stream`` on all that is there, each batch written to its own folder; the rows with their ``batch``.

    A batch that is run again after a failure replaces its folder."""
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    run = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not run.awaitTermination(seconds) and seconds:
        run.stop()
        raise TimeoutError(f"the stream did not end within {seconds} seconds")
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(folder)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key, what the last batch that had it said."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def merged_decays(states: DataFrame, entity: Sequence[str], rate: float, name: str = "mean") -> DataFrame:
    """(entity, mean) of the last states of ``decayed_stream``: their sums as of the entity's latest day, null without values."""
    ends = states.groupBy(*entity).agg(F.max("day").alias("_end"))
    ends = ends.select(*[F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)], "_end")
    same = F.lit(True)
    for i, e in enumerate(entity):
        same = same & F.col(e).eqNullSafe(F.col(f"_e{i}"))
    aged = F.pow(F.lit(rate), F.col("_end") - F.col("day"))
    mean = F.when(F.sum("n") > 0, F.try_divide(F.sum(F.col("top") * aged), F.sum(F.col("low") * aged)))
    return states.join(ends, same).groupBy(*entity).agg(mean.alias(name))
