"""The score stream: messages in, score rows out, safe to restart."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ward_analytics.functions.numeric import at_time
from ward_analytics.operators.scoring import score_windows, window_vitals
from ward_analytics.operators.tables import apply_defaults, ensure_columns, mark_valid
from ward_analytics.schemas import SCORES, required
from ward_analytics.sources.files import read_scores
from ward_analytics.session import require_utc
from ward_analytics.sources.messages import decode_messages, with_event_time

WATERMARK = "1 minute"
WINDOW = "5 minutes"
LAYOUT = ("status", "window_date", "batch_id")
VALID = "status=valid"
#: Where compaction works; readers leave out folders that begin with an underscore.
WORK = "_compaction"
NEW, OLD = f"{WORK}/new", f"{WORK}/old"
#: The batch of merged rows.
MERGED = -1


def score_stream(
    messages: DataFrame,
    window: str = WINDOW,
    watermark: str = WATERMARK,
    **options: str,
) -> DataFrame:
    """Score rows of a message stream; a window leaves once the watermark has passed its end."""
    require_utc(messages.sparkSession)
    readings = with_event_time(decode_messages(messages))
    return score_windows(window_vitals(readings, window, watermark), **options)


def _stored(scores: DataFrame, batch_id: int, as_of: Column | datetime | str | None) -> DataFrame:
    """Score rows as the table holds them: with defaults, and by status, date and batch."""
    created = F.localtimestamp() if as_of is None else at_time(as_of)
    complete = apply_defaults(ensure_columns(scores, SCORES), created).select(*SCORES.names)
    return mark_valid(complete, required(SCORES)).withColumns(
        {"window_date": F.col("window_start").cast("date"), "batch_id": F.lit(batch_id).cast("long")}
    )


def lookup_options(patients: int, row_group_bytes: int | None = None) -> dict[str, str]:
    """Options of a Parquet write that keep a Bloom filter of the patients with each row group: a lookup by patient reads only groups that may hold them,
    also where a group's range of ids spans all. ``patients``: different ones that a row group may hold."""
    options = {"parquet.bloom.filter.enabled#patient_id": "true", "parquet.bloom.filter.expected.ndv#patient_id": str(patients)}
    # A column with a dictionary gets no filter, for the dictionary serves as one.
    options["parquet.enable.dictionary#patient_id"] = "false"
    return options if row_group_bytes is None else {**options, "parquet.block.size": str(row_group_bytes)}


def _write(stored: DataFrame, path: str, order: tuple[str, ...] = ("patient_id", "window_start"), **options: str) -> None:
    """One write, sorted inside files, so that a lookup by patient skips most row groups. Folders that are written anew are replaced, others stay."""
    (
        stored.sortWithinPartitions(*LAYOUT, *order)
        .write.options(**options).option("partitionOverwriteMode", "dynamic").mode("overwrite")
        .partitionBy(*LAYOUT).parquet(path)
    )


def write_scores_batch(
    batch: DataFrame,
    batch_id: int,
    target: str | Mapping[str, str],
    as_of: Column | datetime | str | None = None,
) -> None:
    """Append one micro-batch to the score table.

    A path gives Parquet, by status, date and batch: a repeated batch replaces its own folders, and rows without a
    required value are kept as ``status=rejected``. The stateful plan runs once. A mapping gives JDBC options; there a repeated batch
    appends again, and a row without a required value fails the batch.
    """
    stored = _stored(batch, batch_id, as_of)
    if isinstance(target, str):
        _write(stored, target)
        return
    valid = F.col("status") == "valid"
    checked = F.when(valid, F.col("patient_id")).otherwise(F.raise_error("a score row lacks a required value").cast("int"))
    rows = stored.withColumn("patient_id", checked).select(*SCORES.names)
    rows.write.format("jdbc").options(**target).mode("append").save()


def write_score_table(
    scores: DataFrame,
    path: str,
    batch_id: int = 0,
    as_of: Column | datetime | str | None = None,
    by_time: bool = False,
    **options: str,
) -> None:
    """Write a whole table of scores in the layout of the sink. Tasks are dealt dates by size, a large date to several. Rows of a file go by patient, or
    with ``by_time`` by time, for look-backs within a date; then ``lookup_options`` among the options serve lookups by patient."""
    order = ("window_start", "patient_id") if by_time else ("patient_id", "window_start")
    _write(_stored(scores, batch_id, as_of).hint("rebalance", "window_date"), path, order, **options)


def start_score_sink(
    scores: DataFrame,
    target: str | Mapping[str, str],
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Run the stream into the score table; the checkpoint folder makes it restartable."""
    return (
        scores.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .foreachBatch(lambda batch, batch_id: write_scores_batch(batch, batch_id, target))
        .start()
    )


def compact_scores(spark: SparkSession, path: str, before: date | str) -> list[str]:
    """Merge the batch folders of each date before ``before`` into one; the dates that were merged.

    Only for dates that get no more batches. All merged rows are written beside the table first; then date by date the old folder
    moves out and the new one in. Cut short at any point, the next call ends or undoes what was begun, and no row is
    lost or doubled; a reader may miss a date for the moment between its two moves.
    """
    files = _Files(spark, path)
    files.recover()
    dates = [d for d in files.folders(VALID) if d < f"window_date={str(before)[:10]}" and len(files.folders(f"{VALID}/{d}")) > 1]
    if dates:
        days = [d.removeprefix("window_date=") for d in dates]
        rows = read_scores(spark, path).where(F.col("window_date").isin(*[date.fromisoformat(d) for d in days]))
        (
            rows.withColumn("batch_id", F.lit(MERGED).cast("long")).hint("rebalance", "window_date")
            .sortWithinPartitions("window_date", "batch_id", "patient_id", "window_start")
            .write.mode("overwrite").partitionBy("window_date", "batch_id").parquet(f"{path}/{NEW}")
        )
        for day in dates:
            files.swap(day)
        files.remove(WORK)
    return dates


def table_there(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at a path."""
    return _Files(spark, path).there(".")


class _Files:
    """Folders of a table, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self._path = path, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def there(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def folders(self, name: str) -> list[str]:
        found = self._fs.listStatus(self._at(name)) if self.there(name) else []
        return sorted(f.getPath().getName() for f in found if f.isDirectory())

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._at(target).getParent())
        if not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"{source} could not be moved")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def swap(self, day: str) -> None:
        self.move(f"{VALID}/{day}", f"{OLD}/{day}")
        self.move(f"{NEW}/{day}", f"{VALID}/{day}")

    def recover(self) -> None:
        """End the swaps that were begun; merged rows of other dates are given up and merged again."""
        for day in self.folders(OLD):
            if not self.there(f"{VALID}/{day}"):
                self.move(f"{NEW}/{day}", f"{VALID}/{day}")
        self.remove(WORK)
