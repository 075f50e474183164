"""Merged dates of the score table that readers switch to at once.

The catalogue has a table with a partition for each merged date; its location holds the merged rows. A reader takes a merged date from
there and every other row from the batch folders of the sink. One statement of the catalogue, adding the partition or setting its location,
makes all readers that plan from then on see the merged rows, and until then they see the batches. Nothing moves. What has
been merged is removed later, when no reader that planned before is left.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ward_analytics.schemas import SCORES, as_nullable
from ward_analytics.streaming.score_stream import VALID, _Files

MERGED = "_merged"
_FULL = as_nullable(SCORES).add("status", T.StringType()).add("window_date", T.DateType()).add("batch_id", T.LongType())


def _table(spark: SparkSession, name: str, path: str) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCORES)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, window_date DATE) USING parquet PARTITIONED BY (window_date) LOCATION '{path}/{MERGED}'"
    )


def _published(spark: SparkSession, name: str) -> dict[str, tuple[str, int]]:
    """Location and last merged batch of each date in the catalogue: one row for each day."""
    found = {}
    for r in spark.sql(f"SHOW PARTITIONS {name}").collect():
        day = r.partition.removeprefix("window_date=")
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name} PARTITION (window_date = '{day}')").where("col_name = 'Location'").collect()
        location = rows[0].data_type
        found[day] = location, int(location.rsplit("upto=", 1)[1].split("/")[0])
    return found


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FULL).parquet(path).where("status = 'valid'").drop("status")


def _after(published: dict[str, tuple[str, int]]):
    """Rows of batches that are not among the merged ones of their date."""
    if not published:
        return F.lit(True)
    upto = F.create_map(*(F.lit(x) for day, (_, batch) in published.items() for x in (date.fromisoformat(day), batch)))
    return F.col("batch_id") > F.coalesce(upto[F.col("window_date")], F.lit(-(2**62)))


def read_published(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The score table: merged dates from where the catalogue says, all else from the batch folders."""
    _table(spark, name, path)
    published = _published(spark, name)
    open_rows = _batches(spark, path).where(_after(published)).drop("batch_id")
    if not published:
        return open_rows
    merged = spark.read.schema(as_nullable(SCORES)).parquet(*(location for location, _ in published.values()))
    return merged.withColumn("window_date", F.col("window_start").cast("date")).select(*open_rows.columns).unionByName(open_rows)


def merge_dates(spark: SparkSession, name: str, path: str, days: list[str]) -> dict[str, str]:
    """Write the merged rows of dates beside the table, not yet seen by any reader; the locations of those that have batches not merged yet. Cut
    short and done again, it writes the same places anew."""
    _table(spark, name, path)
    files, published = _Files(spark, path), _published(spark, name)
    batches = {day: [int(f.removeprefix("batch_id=")) for f in files.folders(f"{VALID}/window_date={day}")] for day in days}
    todo = [day for day in days if any(b > published.get(day, ("", -(2**62)))[1] for b in batches[day])]
    if not todo:
        return {}
    upto = max(b for day in todo for b in batches[day])
    rows = read_published(spark, name, path).where(F.col("window_date").isin(*(date.fromisoformat(day) for day in todo)))
    (
        rows.hint("rebalance", "window_date").sortWithinPartitions("window_date", "patient_id", "window_start")
        .write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("window_date").parquet(f"{path}/{MERGED}/upto={upto}")
    )
    return {day: f"{path}/{MERGED}/upto={upto}/window_date={day}" for day in todo}


def publish_date(spark: SparkSession, name: str, day: date | str, location: str) -> None:
    """Let readers see a date at this location: one statement."""
    partition = f"PARTITION (window_date = '{str(day)[:10]}')"
    if spark.sql(f"SHOW PARTITIONS {name} {partition}").take(1):
        spark.sql(f"ALTER TABLE {name} {partition} SET LOCATION '{location}'")
    else:
        spark.sql(f"ALTER TABLE {name} ADD {partition} LOCATION '{location}'")


def publish_before(spark: SparkSession, name: str, path: str, before: date | str) -> list[str]:
    """Merge and publish all dates before ``before`` that have batches not merged yet; the dates."""
    days = [f.removeprefix("window_date=") for f in _Files(spark, path).folders(VALID)]
    found = merge_dates(spark, name, path, [day for day in days if day < str(before)[:10]])
    for day, location in found.items():
        publish_date(spark, name, day, location)
    return list(found)


def vacuum(spark: SparkSession, name: str, path: str) -> int:
    """Remove batches that are merged and merged rows that were replaced; how many folders. For a time when no reader that planned before the last
    switch is left. Cut short anywhere, the next call goes on."""
    files, removed = _Files(spark, path), 0
    published = _published(spark, name)
    for day, (_, upto) in published.items():
        gone = [f"{VALID}/window_date={day}/{b}" for b in files.folders(f"{VALID}/window_date={day}") if int(b.removeprefix("batch_id=")) <= upto]
        gone += [f"{MERGED}/{u}/window_date={day}" for u in files.folders(MERGED) if u != f"upto={upto}" and files.there(f"{MERGED}/{u}/window_date={day}")]
        for folder in gone:
            files.remove(folder)
        removed += len(gone)
    return removed
