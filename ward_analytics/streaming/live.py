"""Keyed state that outlives batches: newest rows as a live table, windows that account for late readings, look-backs that age.

Each operator is a processor for ``transformWithState`` over rows grouped by patient. State and timers lie in the stream's checkpoint, so a run that is
started again goes on where the last one ended. A patient's rows pass one task one at a time; what is held of them is the state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ward_analytics.catalogue import VITALS
from ward_analytics.functions.numeric import f_to_c
from ward_analytics.operators.scoring import score_windows
from ward_analytics.session import require_utc
from ward_analytics.sources.messages import decode_messages, with_event_time
from ward_analytics.streaming.score_stream import WATERMARK

_VALUES = [T.StructField(v, T.DoubleType()) for v in VITALS]
#: A score row inside state: times as microseconds.
_ROW = T.StructType(
    [T.StructField("start", T.LongType()), T.StructField("score", T.IntegerType()), T.StructField("risk", T.StringType()), *_VALUES]
)
_SCORE_ROW = T.StructType([T.StructField("patient_id", T.IntegerType()), *_ROW.fields])


def _row(schema: T.StructType, *values: object) -> Row:
    return Row(**dict(zip(schema.names, values, strict=True)))


def _rows_in(scores: DataFrame) -> DataFrame:
    """Score rows in the form that state holds; a row without a patient takes part in nothing."""
    start = F.unix_micros(F.col("window_start").cast("timestamp"))
    return scores.where(F.col("patient_id").isNotNull()).select(
        "patient_id", start.alias("start"), F.col("news2_score").alias("score"), F.col("risk_level").alias("risk"), *VITALS
    )


def _rows_out(rows: DataFrame) -> DataFrame:
    start = F.timestamp_micros("start").cast("timestamp_ntz")
    return rows.select("patient_id", start.alias("window_start"), F.col("score").alias("news2_score"), F.col("risk").alias("risk_level"), *VITALS)


def _state(spark: SparkSession, checkpoint: str, name: str, **options: object) -> DataFrame:
    """A state variable of a stream, as its last finished batch left it: the key's column and the variable's."""
    operators = spark.read.format("state-metadata").load(checkpoint).where(F.lower("operatorName").contains("transformwithstate"))
    operator = operators.select("operatorId").distinct().collect()  # one row for each stateful operator of the query
    reader = spark.read.format("statestore").option("operatorId", operator[-1][0]).option("stateVarName", name)
    return reader.options(**options).load(checkpoint)


class NewestScore(StatefulProcessor):
    """One score row per patient: the newest, and of two of a window the one with the higher score."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", _ROW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._newest.get()
        best = before
        for r in rows:
            row = tuple(r)[1:]
            if best is None or (row[0], row[1] or 0) > (best[0], best[1] or 0):
                best = row
        if best is not before:
            self._newest.update(best)
            yield _row(_SCORE_ROW, key[0], *best)

    def close(self) -> None:
        pass


def newest_changes(scores: DataFrame) -> DataFrame:
    """A stream of score rows as changes of the live table: a patient's row whenever a newer one arrives."""
    changes = _rows_in(scores).groupBy("patient_id").transformWithState(NewestScore(), _SCORE_ROW, "Append", "None")
    return _rows_out(changes)


def newest_scores(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The live table behind ``newest_changes``: read from the state, without a look at any score row."""
    found = _state(spark, checkpoint, "newest")
    return _rows_out(found.select(F.col("key.patient_id").alias("patient_id"), "value.*"))


class WindowsAndLate(StatefulProcessor):
    """Highest values of each open window of a patient; windows leave when the watermark reaches their end, and a reading that comes after
    that leaves at once, with the time it is late by.

    Each call of the state costs far more than a reading does. So windows lie in blocks of ``BLOCK`` consecutive ones, which are read and
    written once for all readings of a batch, and each block has one timer, for its earliest window."""

    OUT = T.StructType([
        T.StructField("patient_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), *_VALUES,
        T.StructField("at", T.LongType()), T.StructField("vital_sign", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("late_by", T.LongType()),
    ])
    #: Starts of a block's windows, and the values of each vital in the same order.
    HELD = T.StructType(
        [T.StructField("start", T.ArrayType(T.LongType())), *(T.StructField(v, T.ArrayType(T.DoubleType())) for v in VITALS)]
    )
    #: Windows of a block, and how many a task holds of a patient before it puts them back.
    BLOCK, MOST = 4096, 1 << 18

    def __init__(self, window_ms: int):
        self._window = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState("open", "block long", self.HELD)

    def _block(self, start: int) -> int:
        return start // self._window // self.BLOCK

    def _get(self, block: int) -> dict[int, list]:
        """The open windows of a block: values by start."""
        held = self._open.getValue((block,))
        return {} if held is None else {start: list(values) for start, *values in zip(*held, strict=True)}

    def _put(self, block: int, windows: dict[int, list], first: int | None) -> None:
        """Keep a block, with a timer for its earliest window unless that one, ``first``, has it."""
        if not windows:
            self._open.removeKey((block,))
            return
        self._open.updateValue((block,), (list(windows), *map(list, zip(*windows.values(), strict=True))))
        earliest = min(windows)
        if earliest != first:
            self._handle.registerTimer(earliest + self._window)

    def _put_all(self, blocks: dict[int, tuple[dict[int, list], int | None]]) -> None:
        for block, (windows, first) in blocks.items():
            self._put(block, windows, first)
        blocks.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark, blocks, n = timerValues.getCurrentWatermarkInMs(), {}, 0
        for r in rows:
            start = r.at // 1000 // self._window * self._window
            if start + self._window <= watermark:
                late_by = watermark * 1000 - r.at
                yield _row(self.OUT, key[0], "late", start * 1000, *[None] * len(VITALS), r.at, r.vital_sign, r.value, late_by)
                continue
            block = self._block(start)
            if block not in blocks:
                if n >= self.MOST:
                    self._put_all(blocks)
                    n = 0
                windows = self._get(block)
                blocks[block] = windows, min(windows, default=None)
                n += len(windows)
            windows = blocks[block][0]
            if start not in windows:
                windows[start] = [None] * len(VITALS)
                n += 1
            if r.vital_sign in VITALS and r.value is not None:
                i = VITALS.index(r.vital_sign)
                held = windows[start][i]
                windows[start][i] = r.value if held is None or _above(r.value, held) else held
        self._put_all(blocks)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, block = timerValues.getCurrentWatermarkInMs(), self._block(expiredTimerInfo.getExpiryTimeInMs() - self._window)
        windows = self._get(block)
        closed = sorted(start for start in windows if start + self._window <= watermark)
        values = [windows.pop(start) for start in closed]
        if closed:  # else an earlier window came after this timer, and took its window along
            self._put(block, windows, None)
        for start, highest in zip(closed, values, strict=True):
            yield _row(self.OUT, key[0], "window", start * 1000, *highest, None, None, None, None)

    def close(self) -> None:
        pass


def _above(a: float, b: float) -> bool:
    """Whether a value counts as higher; NaN is the highest, as in Spark."""
    return a > b or (a != a and b == b)


def windows_and_late(messages: DataFrame, window_minutes: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """A message stream as closed windows and late readings in one stream, told apart by ``kind``. Every reading with a time and a patient is
    either in a window or a late row. A window that ends at or before the watermark is closed, as in the built-in aggregation, which drops
    late rows without a word."""
    require_utc(messages.sparkSession)
    readings = with_event_time(decode_messages(messages)).withWatermark("event_time", watermark)
    # The time as a number: on the column with the watermark Spark would drop late rows before the processor sees them.
    kept = readings.where("event_time is not null and patient_id is not null").select(
        "patient_id", F.unix_micros("event_time").alias("at"), "vital_sign", "value"
    )
    processor = WindowsAndLate(window_minutes * 60_000)
    return kept.groupBy("patient_id").transformWithState(processor, WindowsAndLate.OUT, "Append", "EventTime")


def start_accounted(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run ``windows_and_late`` into a folder by kind and batch; a repeated batch replaces its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.option("partitionOverwriteMode", "dynamic")
            .mode("overwrite").partitionBy("kind", "batch_id").parquet(path)
        )

    return _run(stream, write, checkpoint)


#: Keyed state with timers needs this store; a query keeps the settings it was started with.
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        run = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return run.foreachBatch(write).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def _accounted(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = T.StructType([f for f in WindowsAndLate.OUT if f.name != "kind"]).add("kind", T.StringType()).add("batch_id", T.LongType())
    return spark.read.schema(schema).parquet(path).where(F.col("kind") == kind)


def accounted_scores(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Score rows of the closed windows."""
    start = F.timestamp_micros("start")
    wide = _accounted(spark, path, "window").select(F.struct(start.alias("start")).alias("window"), "patient_id", *VITALS)
    return score_windows(wide, **options)


def late_readings(spark: SparkSession, path: str) -> DataFrame:
    """What came too late: the reading, the window it would have been in, and by how much the watermark had passed its time, in seconds."""
    return _accounted(spark, path, "late").select(
        "patient_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("event_time"), "vital_sign", "value",
        F.timestamp_micros("start").cast("timestamp_ntz").alias("window_start"), (F.col("late_by") / 1e6).alias("late_by"),
    )


class LookBack(StatefulProcessor):
    """Score rows of a patient's last hours. A row leaves when the watermark is more than the hours past it; each change gives the summary of
    what is left."""

    OUT = T.StructType(
        [T.StructField("patient_id", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("n_rows", T.LongType())]
        + [T.StructField(f"{v}_{name}", T.LongType() if name == "values" else T.DoubleType()) for v in VITALS for name in ("lowest", "highest", "values")]
        + [T.StructField("first", _ROW), T.StructField("last", _ROW)]
    )

    def __init__(self, hours: int):
        self._kept = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", _ROW)
        self._seq = handle.getValueState("seq", "seq long")

    def _leaves(self, start: int) -> int:
        """The first millisecond at which a row is too old."""
        return start // 1000 + self._kept + 1

    def _changed(self, key, rows: list[tuple]) -> Iterator[Row]:
        if rows:
            self._rows.put(rows)
        else:
            self._rows.clear()
        seq = (self._seq.get() or (0,))[0] + 1
        self._seq.update((seq,))
        order = sorted(rows, key=lambda r: (r[0], r[1] or 0))
        spread = []
        for i in range(len(VITALS)):
            values = [r[3 + i] for r in rows if r[3 + i] is not None and r[3 + i] == r[3 + i]]
            spread += [min(values, default=None), max(values, default=None), len(values)]
        ends = [_row(_ROW, *r) for r in (order[0], order[-1])] if order else [None, None]
        yield _row(self.OUT, key[0], seq, len(rows), *spread, *ends)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark, new = timerValues.getCurrentWatermarkInMs(), []
        for r in rows:
            row = tuple(r)[1:]
            if self._leaves(row[0]) > watermark:
                new.append(row)
                self._handle.registerTimer(self._leaves(row[0]))
        if new:
            yield from self._changed(key, [tuple(r) for r in self._rows.get()] + new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = [tuple(r) for r in self._rows.get()]
        after = [r for r in before if self._leaves(r[0]) > timerValues.getCurrentWatermarkInMs()]
        if len(after) < len(before):
            yield from self._changed(key, after)

    def close(self) -> None:
        pass


def look_back_changes(scores: DataFrame, hours: int = 6) -> DataFrame:
    """A stream of score rows as summaries of each patient's last ``hours`` before the watermark, in °C, whenever they change."""
    rows = _rows_in(scores.withColumn("temperature", f_to_c(F.col("temperature"))))
    return rows.groupBy("patient_id").transformWithState(LookBack(hours), LookBack.OUT, "Append", "EventTime")


def start_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream of changes into a folder by batch; a repeated batch replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(changes, write, checkpoint)


def look_back_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary of each patient who has rows left, in the form of ``assess.period_summary``."""
    changes = spark.read.schema(T.StructType([*LookBack.OUT.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    last = changes.groupBy("patient_id").agg(F.max("seq").alias("seq"))
    found = changes.join(last, ["patient_id", "seq"]).where("n_rows > 0")
    end = lambda side: F.struct(
        F.timestamp_micros(f"{side}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{side}.score").alias("news2_score"),
        F.col(f"{side}.risk").alias("risk_level"), *(F.col(f"{side}.{v}").alias(v) for v in VITALS),
    ).alias(side)
    return found.drop("seq", "batch_id").withColumns({"first": end("first"), "last": end("last")})
