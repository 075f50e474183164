"""Keyed JSON messages: the form in which readings travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.schemas import READING


def encode_messages(readings: DataFrame) -> DataFrame:
    """``(key, value)`` as bytes: the patient, and the reading as a JSON object."""
    return readings.select(
        F.col("patient_id").cast("string").cast("binary").alias("key"),
        F.to_json(F.struct(*READING.names)).cast("binary").alias("value"),
    )


def decode_messages(messages: DataFrame) -> DataFrame:
    """Readings of a message table or stream; a malformed message gives a row of nulls."""
    reading = F.from_json(F.col("value").cast("string"), READING)
    return messages.select(reading.alias("v")).select("v.*")


def with_event_time(readings: DataFrame) -> DataFrame:
    """Add ``event_time``; a text that is no timestamp gives null and later meets no window."""
    event_time = F.try_to_timestamp(F.col("timestamp")).cast("timestamp")
    return readings.withColumn("event_time", event_time)
