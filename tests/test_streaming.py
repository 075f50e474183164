"""The score stream: late, malformed and unknown readings, restart, repeated batches."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from ward_analytics.catalogue import VITALS
from ward_analytics.operators import scoring
from ward_analytics.operators.latest import last_hours
from ward_analytics.operators.scoring import score_windows
from ward_analytics.sources import files, kafka, messages
from ward_analytics.streaming import score_stream as st


def message(patient, time, vital, value):
    stamp = f"2024-01-01 {time}" if time else ""
    return json.dumps(
        {"patient_id": patient, "timestamp": stamp, "vital_sign": vital, "value": value}
    )


FILES = [
    [
        message("1", "00:00:10", "heart_rate", 70.0),
        message("1", "00:01:10", "heart_rate", 95.0),
        message("1", "00:01:10", "spo2", 98.0),
        "{oops",
        message("1", "", "spo2", 1.0),
    ],
    [message("1", "00:07:00", "heart_rate", 71.0), message("2", "00:06:00", "heart_rate", 150.0)],
    [message("1", "00:05:30", "spo2", 90.0)],
    [message("1", "00:02:00", "spo2", 99.0), message("3", "00:08:00", "glucose", 5.0)],
    [message("1", "00:20:00", "heart_rate", 60.0)],
]

CLOSED = {
    ("00:00", 1): {"heart_rate": 95.0, "spo2": 98.0},
    ("00:05", 1): {"heart_rate": 71.0, "spo2": 90.0},
    ("00:05", 2): {"heart_rate": 150.0},
    ("00:05", 3): {},
}


def drop_files(folder, batches, first=1):
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(batches, start=first):
        path = f"{folder}/{i:03d}.txt"
        with open(path, "w") as out:
            out.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)


def run(spark, source, target, checkpoint):
    options = {"path": str(source), "maxFilesPerTrigger": "1"}
    arriving = kafka.read_vitals_stream(spark, options, source="text")
    sink = st.start_score_sink(
        st.score_stream(arriving), str(target), str(checkpoint), trigger={"availableNow": True},
    )
    sink.awaitTermination()
    return sink


def found(scores):
    rows = scores.collect()
    result = {
        (r.window_start.strftime("%H:%M"), r.patient_id): {
            v: r[v] for v in VITALS if r[v] is not None
        }
        for r in rows
    }
    assert len(result) == len(rows)
    return result


def test_late_malformed_and_unknown_readings(spark, tmp_path):
    drop_files(f"{tmp_path}/in", FILES)
    sink = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    assert found(files.read_scores(spark, f"{tmp_path}/out")) == CLOSED
    dropped = sum(
        op["numRowsDroppedByWatermark"] for p in sink.recentProgress for op in p["stateOperators"]
    )
    assert dropped == 1


def test_reading_before_the_watermark_moves_is_accepted(spark, tmp_path):
    early = [FILES[0], FILES[1], FILES[2] + FILES[3], FILES[4]]
    drop_files(f"{tmp_path}/in", early)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    scores = found(files.read_scores(spark, f"{tmp_path}/out"))
    assert scores == {**CLOSED, ("00:00", 1): {"heart_rate": 95.0, "spo2": 99.0}}


def test_many_batches_give_the_windows_of_one(spark, tmp_path):
    """A time-ordered replay, cut inside windows: state carries over and nothing is late."""
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(seconds=37 * i) for i in range(600)]
    lines = [
        json.dumps({
            "patient_id": str(i % 7), "timestamp": str(t), "vital_sign": VITALS[i * 3 % 5],
            "value": float(40 + i * 13 % 90),
        })
        for i, t in enumerate(times)
    ]
    cuts = [0, 101, 333, 334, 500, 600]
    drop_files(f"{tmp_path}/in", [lines[a:b] for a, b in zip(cuts, cuts[1:])])
    sink = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    assert len([p for p in sink.recentProgress if p["numInputRows"]]) == len(cuts) - 1

    table = spark.createDataFrame([(line.encode(),) for line in lines], "value binary")
    batch = scoring.score_readings(messages.with_event_time(messages.decode_messages(table)))
    closed = times[-1] - dt.timedelta(minutes=6)
    expected = [r for r in batch.collect() if r.window_start <= closed]
    stored = files.read_scores(spark, f"{tmp_path}/out").select(*batch.columns)
    assert sorted(stored.collect(), key=key) == sorted(expected, key=key)
    assert len(expected) < batch.count()


def key(row):
    return row.patient_id, row.window_start


def test_restart_keeps_open_windows(spark, tmp_path):
    drop_files(f"{tmp_path}/in", FILES[:2])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    drop_files(f"{tmp_path}/in", FILES[2:], first=3)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    assert found(files.read_scores(spark, f"{tmp_path}/out")) == CLOSED


def test_crash_after_a_write_leaves_no_duplicates(spark, tmp_path):
    drop_files(f"{tmp_path}/in", FILES)
    out = f"{tmp_path}/out"

    def crash(batch, batch_id):
        st.write_scores_batch(batch, batch_id, out)
        if files.read_scores(spark, out).count():
            raise RuntimeError("lost before the batch was committed")

    options = {"path": f"{tmp_path}/in", "maxFilesPerTrigger": "1"}
    scores = st.score_stream(kafka.read_vitals_stream(spark, options, source="text"))
    first = (
        scores.writeStream.option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).foreachBatch(crash).start()
    )
    with pytest.raises(Exception, match="lost before"):
        first.awaitTermination()
    written = files.read_scores(spark, out).count()
    assert 0 < written < len(CLOSED)
    run(spark, tmp_path / "in", out, tmp_path / "cp")
    assert found(files.read_scores(spark, out)) == CLOSED


def test_patients_without_a_number_are_set_aside(spark, tmp_path):
    drop_files(
        f"{tmp_path}/in",
        [
            [message("p1", "00:00:10", "spo2", 90.0), message(None, "00:00:20", "spo2", 91.0)],
            [message("7", "00:00:30", "spo2", 92.0), message("7", "00:30:00", "spo2", 92.0)],
        ],
    )
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    assert found(files.read_scores(spark, f"{tmp_path}/out")) == {("00:00", 7): {"spo2": 92.0}}
    rejected = files.read_scores(spark, f"{tmp_path}/out", status="rejected").collect()
    assert sorted(r.spo2 for r in rejected) == [90.0, 91.0]
    assert {r.patient_id for r in rejected} == {None}


def wide(spark, rows):
    schema = "window struct<start timestamp, end timestamp>, patient_id string, " + ", ".join(
        f"{v} double" for v in VITALS
    )
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([((start, start), p, *values) for p, *values in rows], schema)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/out"
    batch = score_windows(wide(spark, [("1", 72.0, 16.0, 98.0, 118.0, 37.0), ("2", *[None] * 5)]))
    st.write_scores_batch(batch, 0, path, as_of="2024-01-02 00:00:00")
    first = sorted(files.read_scores(spark, path).collect())
    st.write_scores_batch(batch, 0, path, as_of="2024-01-02 00:00:00")
    assert sorted(files.read_scores(spark, path).collect()) == first
    assert [(r.patient_id, r.news2_score, r.risk_level) for r in first] == [
        (1, 0, "LOW"), (2, 11, "HIGH"),
    ]
    st.write_scores_batch(batch, 1, path, as_of="2024-01-02 00:00:00")
    assert files.read_scores(spark, path).count() == 4


def test_empty_batch_adds_no_rows(spark, tmp_path):
    batch = score_windows(wide(spark, [("1", *[None] * 5)])).filter("patient_id < 0")
    st.write_scores_batch(batch, 0, f"{tmp_path}/out")
    assert files.read_scores(spark, f"{tmp_path}/out").count() == 0


def days(spark, path, n_batches=3, n_days=4):
    for number in range(n_batches):
        rows = [(str(p), 70.0 + number, 16.0, 98.0, 118.0, 37.0) for p in range(5)]
        batch = score_windows(wide(spark, rows))
        for day in range(n_days):
            shifted = batch.withColumn("window_start", F.col("window_start") + F.make_dt_interval(days=F.lit(day)))
            st.write_scores_batch(shifted, 10 * day + number, path, as_of="2024-02-01 00:00:00")
    return sorted(files.read_scores(spark, path).collect())


def test_look_back_lists_only_its_days(spark, tmp_path):
    path = f"{tmp_path}/out"
    days(spark, path)
    recent = last_hours(files.read_scores(spark, path), "2024-01-05 00:00:00", 24)
    assert {f.split("window_date=")[1][:10] for f in recent.inputFiles()} == {f"2024-01-0{d}" for d in range(1, 5)}
    scan = [n for n in recent._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in n][0]
    assert "window_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    day = F.regexp_extract(F.input_file_name(), "window_date=([0-9-]+)", 1)
    assert [r[0] for r in recent.select(day).distinct().collect()] == ["2024-01-04"]


def test_compaction_keeps_every_row(spark, tmp_path):
    path = f"{tmp_path}/out"
    before = days(spark, path)
    assert st.compact_scores(spark, path, "2024-01-03") == ["window_date=2024-01-01", "window_date=2024-01-02"]
    assert sorted(files.read_scores(spark, path).collect()) == before
    assert os.listdir(f"{path}/status=valid/window_date=2024-01-01") == ["batch_id=-1"]
    assert len(os.listdir(f"{path}/status=valid/window_date=2024-01-03")) == 3
    assert st.compact_scores(spark, path, "2024-01-03") == []
    assert sorted(files.read_scores(spark, path).collect()) == before


@pytest.mark.parametrize("moves", [0, 1, 2, 3])
def test_compaction_cut_short(spark, tmp_path, monkeypatch, moves):
    path = f"{tmp_path}/out"
    before = days(spark, path)
    move, left = st._Files.move, [moves]

    def failing(self, source, target):
        if not left[0]:
            raise RuntimeError("lost")
        left[0] -= 1
        move(self, source, target)

    monkeypatch.setattr(st._Files, "move", failing)
    with pytest.raises(RuntimeError, match="lost"):
        st.compact_scores(spark, path, "2024-01-03")
    monkeypatch.undo()
    st.compact_scores(spark, path, "2024-01-03")
    assert sorted(files.read_scores(spark, path).collect()) == before
    assert not os.path.exists(f"{path}/_compaction")


def test_another_session_zone_is_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            st.score_stream(spark.createDataFrame([(b"{}",)], "value binary"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_replay_of_csv_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for i, rows in enumerate([["1,2024-01-01 00:01:00,spo2,97"], ["1,2024-01-01 00:20:00,spo2,96"]]):
        path = f"{tmp_path}/in/{i}.csv"
        with open(path, "w") as out:
            out.write("patient_id,timestamp,vital_sign,value\n" + "\n".join(rows) + "\n")
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    replay = messages.encode_messages(files.replay_vitals_csv(spark, f"{tmp_path}/in"))
    sink = st.start_score_sink(
        st.score_stream(replay), f"{tmp_path}/out", f"{tmp_path}/cp", trigger={"availableNow": True}
    )
    sink.awaitTermination()
    assert found(files.read_scores(spark, f"{tmp_path}/out")) == {("00:00", 1): {"spo2": 97.0}}


def test_kafka_source_is_chosen_by_default(spark):
    with pytest.raises(Exception, match="kafka"):
        kafka.read_vitals_stream(spark, {"kafka.bootstrap.servers": "none:1", "subscribe": "vitals"})
