"""From readings to score rows; the same code serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.catalogue import VITALS
from ward_analytics.functions.numeric import f_to_c, risk_level, score_vital
from ward_analytics.session import require_utc


def window_vitals(
    readings: DataFrame, window: str = "5 minutes", watermark: str | None = None
) -> DataFrame:
    """Highest value of each vital per patient and tumbling window: ``window, patient_id, <vitals>``.

    One aggregation with five conditional maxima instead of a pivot: a single shuffle (and a
    single state store in a stream), with map-side maxima, so that a patient with many readings
    sends few rows. A vital sign outside the catalogue still makes its row.
    """
    if watermark is not None:
        readings = readings.withWatermark("event_time", watermark)
    highest = [
        F.max(F.when(F.col("vital_sign") == v, F.col("value"))).alias(v) for v in VITALS
    ]
    return readings.groupBy(F.window("event_time", window).alias("window"), "patient_id").agg(
        *highest
    )


def score_windows(
    wide: DataFrame, temperature_unit: str = "as_is", missing: str = "reference"
) -> DataFrame:
    """Score rows of ``window_vitals``.

    The bands for temperature are in °C; ``temperature_unit="F"`` converts for the score (the
    stored value stays). Window times lose their zone, so the session must be in UTC. A patient id that is no integer becomes null, for ``split_valid`` to find.
    """
    require_utc(wide.sparkSession)
    if temperature_unit not in ("as_is", "F"):
        raise ValueError(f"temperature_unit must be 'as_is' or 'F', not {temperature_unit!r}")
    points = []
    for vital in VITALS:
        value = F.col(vital)
        if vital == "temperature" and temperature_unit == "F":
            value = f_to_c(value)
        points.append(score_vital(vital, value, missing))
    total = points[0]
    for p in points[1:]:
        total = total + p
    return wide.select(
        F.col("patient_id").try_cast("int").alias("patient_id"),
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        total.alias("news2_score"),
        *VITALS,
    ).select(
        "patient_id",
        "window_start",
        "news2_score",
        risk_level(F.col("news2_score")).alias("risk_level"),
        *VITALS,
    )


def score_readings(readings: DataFrame, window: str = "5 minutes", **options: str) -> DataFrame:
    return score_windows(window_vitals(readings, window), **options)
