"""Kafka by options only: servers, topic and credentials come from the caller."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_vitals_stream(
    spark: SparkSession, options: Mapping[str, str], source: str = "kafka"
) -> DataFrame:
    """A message stream with a ``value`` column.

    For Kafka, give ``kafka.bootstrap.servers`` and ``subscribe``; it starts at the newest offsets
    unless told otherwise. ``source="text"`` reads a folder of files with one message per line.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("startingOffsets", "latest")
    return reader.options(**options).load()


def write_messages(messages: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Publish ``(key, value)`` messages; equal keys meet in one partition of the topic."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "all")
        .options(**options)
        .save()
    )
