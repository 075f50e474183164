"""Reading the given tables, and where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from all learning: crc32 of its id as text, modulo 5, is 0."""
    return fold(doc_id) == 0


def fold(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset (tests) one below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def cut(frame: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder."""
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see the driver's files; a cluster gets it by --py-files."""
    from pathlib import Path

    home = str(Path(__file__).resolve().parents[2])
    seen = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in seen.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{seen}".rstrip(":")
