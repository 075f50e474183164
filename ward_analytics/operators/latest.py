"""Newest rows, look-back filters and orderings of the score table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ward_analytics.catalogue import RISK_BOUNDS, TOP_RISK
from ward_analytics.functions.numeric import at_time

#: Newest first; a window that was written twice resolves to its higher score.
NEWEST = ("window_start", "news2_score")


def time_key(window_start: str = "window_start", score: str = "news2_score") -> Column:
    """Time, then score, as one integer. Aggregates by it have buffers of a fixed size, so they hash instead of sorting all rows."""
    points = F.coalesce(F.col(score), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("score outside of 0 to 31: "), points.cast("string"))).cast("long")
    micros = F.unix_micros(F.col(window_start).cast("timestamp"))
    return F.when(points.between(0, 31), micros * 32 + points).otherwise(bad)


_LEVELS = [risk for _, risk in RISK_BOUNDS] + [TOP_RISK]
_KNOWN_RISKS = [*_LEVELS, *map(str.lower, _LEVELS), *map(str.capitalize, _LEVELS)]


def with_key(scores: DataFrame) -> DataFrame:
    """The table with its key, and the risk as a number, which has a fixed size, too."""
    risks = F.array(*map(F.lit, _KNOWN_RISKS))
    coded = {"risk_level": F.array_position(risks, F.col("risk_level"))} if "risk_level" in scores.columns else {}
    return scores.withColumns({"_key": time_key(), **coded})


def unknown_risks(scores: DataFrame) -> DataFrame:
    """Risk texts that ``with_key`` has no number for, one for each patient and key. Of scores that were just computed Catalyst finds this
    empty while it plans; of a stored table it is one more pass over the rows whose risk is another text."""
    other = scores.where(F.find_in_set("risk_level", F.lit(",".join(_KNOWN_RISKS))) == 0)
    return other.select("patient_id", time_key().alias("_key"), "risk_level").groupBy("patient_id", "_key").agg(F.min("risk_level").alias("_risk"))


def with_risk(found: DataFrame, scores: DataFrame, key: str, code: str) -> DataFrame:
    """The risk text behind the number in column ``code``; of a text without a number the one that the scores hold at that patient and key. The rows
    without a patient, which no score table holds, lose such a text."""
    other = unknown_risks(scores).select(F.col("patient_id").alias("_patient"), F.col("_key").alias("_at"), "_risk")
    same = (F.col("patient_id") == F.col("_patient")) & (F.col(key) == F.col("_at"))
    known = F.get(F.array(*map(F.lit, _KNOWN_RISKS)), (F.col(code) - 1).cast("int"))
    joined = found.join(other, same, "left")
    text = F.when(F.col(code) > 0, known).when(F.col(code) == 0, F.col("_risk"))
    return joined.withColumn(code, text).drop("_patient", "_at", "_risk")


def at_end(columns: list[str], pick: Callable[..., Column], prefix: str = "") -> list[Column]:
    """The columns of the row with the lowest or highest key, by ``F.min_by`` or ``F.max_by``.

    Of two rows with the same time and score either may give its columns.
    """
    return [pick(c, "_key").alias(prefix + c) for c in columns]


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest row of each patient; of two rows of a window the one with the higher score.

    One hash aggregation: a row per patient and task reaches the shuffle, however many rows a patient has.
    """
    rest = [c for c in scores.columns if c != "patient_id"]
    newest = with_key(scores).groupBy("patient_id").agg(F.max("_key").alias("_newest"), *at_end(rest, F.max_by))
    if "risk_level" in rest:
        newest = with_risk(newest, scores, "_newest", "risk_level")
    return newest.select(*scores.columns)


def latest_scores_ranked(scores: DataFrame) -> DataFrame:
    """The same by rank 1; Spark prunes to the first rank before the shuffle as well."""
    newest_first = Window.partitionBy("patient_id").orderBy(*(F.desc(c) for c in NEWEST))
    ranked = scores.withColumn("_rank", F.row_number().over(newest_first))
    return ranked.filter("_rank = 1").drop("_rank")


def in_id_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """Both ends included."""
    return df.filter(F.col("patient_id").between(low, high))


def last_hours(
    df: DataFrame,
    as_of: Column | datetime | str,
    hours: int = 6,
    time_column: str = "window_start",
) -> DataFrame:
    """Rows not older than ``hours`` before ``as_of``; there is no upper bound.

    On the written score table the condition also goes to its ``window_date`` folders.
    """
    cutoff = at_time(as_of) - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    recent = df.filter(F.col(time_column) >= cutoff)
    if "window_date" in df.columns:
        recent = recent.filter(F.col("window_date") >= cutoff.cast("date"))
    return recent
