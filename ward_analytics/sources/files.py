"""Files and tables: readings as CSV, score and patient tables, JSON results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ward_analytics.functions.text import iso_date, iso_timestamp
from ward_analytics.schemas import READING, SCORES, as_nullable


def _only_numbers(readings: DataFrame) -> DataFrame:
    """The four columns of a reading; a value that is missing or no number fails the job."""
    value = F.coalesce(F.col("value").try_cast("double"), F.raise_error("value is not a number"))
    return readings.withColumn("value", value).select(*READING.names)


def read_vitals_csv(spark: SparkSession, path: str) -> DataFrame:
    """Readings of CSV files with a header. Columns are found by name and others are ignored; all
    files must share one header."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return _only_numbers(raw)


def replay_vitals_csv(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same readings as a stream, file after file in the order of their modification times.
    A stream has a fixed schema, so the files hold just the four columns, as texts."""
    texts = T.StructType([T.StructField(name, T.StringType()) for name in READING.names])
    raw = (
        spark.readStream.schema(texts)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(path)
    )
    return _only_numbers(raw)


def write_vitals_csv(readings: DataFrame, path: str) -> None:
    readings.select(*READING.names).write.mode("overwrite").option("header", True).csv(path)


def read_table(
    spark: SparkSession,
    source: str | Mapping[str, str],
    where: Column | None = None,
) -> DataFrame:
    """A table by name, by path (with a slash), or over JDBC (options as a mapping).

    The condition goes to the scan: Catalyst pushes it to Parquet and to the database.
    """
    if isinstance(source, Mapping):
        df = spark.read.format("jdbc").options(**source).load()
    elif "/" in source:
        df = spark.read.parquet(source)
    else:
        df = spark.table(source)
    return df if where is None else df.filter(where)


def read_scores(spark: SparkSession, path: str, status: str = "valid") -> DataFrame:
    """The score table that the stream sink writes, or with ``status="rejected"`` what it set aside. ``window_date`` is a partition
    column, which ``last_hours`` uses to skip folders."""
    schema = as_nullable(SCORES).add("status", T.StringType()).add("window_date", T.DateType()).add("batch_id", T.LongType())
    return spark.read.schema(schema).parquet(path).filter(F.col("status") == status).drop("status", "batch_id")


def inline_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A small table from literal rows, checked against its schema."""
    return spark.createDataFrame(list(rows), schema)


def iso_times(df: DataFrame) -> DataFrame:
    """Dates and times as ISO texts, the form in which results leave."""
    forms = {T.DateType: iso_date, T.TimestampType: iso_timestamp, T.TimestampNTZType: iso_timestamp}
    shown = {f.name: forms[type(f.dataType)](F.col(f.name)) for f in df.schema if type(f.dataType) in forms}
    return df.withColumns(shown) if shown else df


def to_json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """Every row as one JSON object, nulls kept."""
    shown = iso_times(df)
    return shown.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    iso_times(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
