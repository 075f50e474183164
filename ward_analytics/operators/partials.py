"""Daily partial states of the period summary: a table by day whose rows merge, so that a look-back reads days instead of score rows.

A partial is one row per patient and day: number of rows, first and last row, and per vital the lowest and highest value and the number
of values. Partials of disjoint rows merge by sums, extremes and ``min_by``/``max_by`` with buffers of a fixed size.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ward_analytics.catalogue import VITALS
from ward_analytics.functions.numeric import at_time
from ward_analytics.operators.latest import time_key
from ward_analytics.operators.serving import to_celsius

ENDS = ("window_start", "news2_score", *VITALS)
SIDES = (("first", F.min, F.min_by), ("last", F.max, F.max_by))
SPREAD = (("lowest", F.min), ("highest", F.max), ("values", F.sum))


def daily_partials(scores: DataFrame) -> DataFrame:
    """Partials of score rows, values in °C; a NaN counts as no value."""
    rows = to_celsius(scores).select(
        "patient_id", F.col("window_start").cast("date").alias("day"), "window_start", "news2_score", time_key().alias("key"),
        *(F.nanvl(F.col(v), F.lit(None).cast("double")).alias(v) for v in VITALS),
    )
    parts = rows.select(
        "patient_id", "day", F.lit(1).cast("long").alias("n_rows"),
        *(F.col("key").alias(f"{side}_key") for side, _, _ in SIDES),
        *(F.col(c).alias(f"{side}_{c}") for side, _, _ in SIDES for c in ENDS),
        *(F.col(v).alias(f"{v}_{name}") for v in VITALS for name in ("lowest", "highest")),
        *(F.col(v).isNotNull().cast("long").alias(f"{v}_values") for v in VITALS),
    )
    return merge(parts, "patient_id", "day")


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Partials of the same keys as one."""
    return parts.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        *(extreme(f"{side}_key").alias(f"{side}_key") for side, extreme, _ in SIDES),
        *(pick(f"{side}_{c}", f"{side}_key").alias(f"{side}_{c}") for side, _, pick in SIDES for c in ENDS),
        *(agg(f"{v}_{name}").alias(f"{v}_{name}") for v in VITALS for name, agg in SPREAD),
    )


def summary(parts: DataFrame) -> DataFrame:
    """One row per patient, as ``assess.period_summary`` gives it but for the risks."""
    merged = merge(parts, "patient_id")
    ends = (F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ENDS)).alias(side) for side, _, _ in SIDES)
    kept = [c for c in merged.columns if not c.startswith(("first_", "last_"))]
    return merged.select(*kept, *ends)


def write_partials(parts: DataFrame, path: str) -> None:
    """A folder per day; days that are written anew are replaced, others stay."""
    (
        parts.hint("rebalance", "day").sortWithinPartitions("day", "patient_id")
        .write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)
    )


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def add_scores(spark: SparkSession, path: str, scores: DataFrame) -> None:
    """Merge new score rows into the table: the days they fall on are read, merged and replaced. The rows must be new; the same rows given twice
    count twice."""
    arrived = daily_partials(scores)
    days = [r.day for r in arrived.select("day").distinct().collect()]  # a look-back's days, not rows
    if not days:
        return
    stored = read_partials(spark, path).where(F.col("day").isin(*days))
    write_partials(merge(stored.unionByName(arrived), "patient_id", "day"), path)


def look_back(parts: DataFrame, scores: DataFrame, as_of: Column | datetime | str, hours: int) -> DataFrame:
    """The summary of the rows not older than ``hours`` before ``as_of``: whole days from their partials, and only of the day that the limit cuts
    the rows themselves. Of a score table by date that is one folder."""
    limit = at_time(as_of) - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    cut_day = limit.cast("date")
    whole = parts.where(F.col("day") > cut_day)
    rest = scores.where((F.col("window_start") >= limit) & (F.col("window_start") < F.date_add(cut_day, 1).cast("timestamp_ntz")))
    if "window_date" in scores.columns:
        rest = rest.where(F.col("window_date") == cut_day)
    return summary(whole.unionByName(daily_partials(rest)))
