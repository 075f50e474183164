"""Messages, CSV, tables and JSON."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ward_analytics.operators import scoring, tables
from ward_analytics.operators.scoring import score_readings
from ward_analytics.operators.latest import last_hours
from ward_analytics.schemas import PATIENTS, READING, SCORES, required
from ward_analytics.session import work_folder
from ward_analytics.sources import adapter, files, kafka, messages
from ward_analytics.streaming.score_stream import write_scores_batch


def decoded(spark, *texts):
    df = spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    return messages.with_event_time(messages.decode_messages(df))


def test_malformed_json_gives_nulls(spark):
    row = decoded(spark, "{oops").first()
    assert set(row.asDict().values()) == {None}


def test_a_number_in_quotes_is_no_number(spark):
    text = '{"patient_id":"1","timestamp":"2024-01-01 00:00:00","vital_sign":"spo2","value":"7"}'
    row = decoded(spark, text).first()
    assert (row.patient_id, row.vital_sign, row.value) == ("1", "spo2", None)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-01 10:11:12", "2024-01-01 10:11:12"),
        ("2024-01-01T00:00:00+02:00", "2023-12-31 22:00:00"),
        ("bad", None),
        ("", None),
        ("01/02/2024", None),
    ],
)
def test_event_times(spark, text, expected):
    df = spark.createDataFrame([("1", text, "spo2", 1.0)], READING)
    row = messages.with_event_time(df).select(F.col("event_time").cast("string")).first()
    assert row[0] == expected


def test_reading_without_time_meets_no_window(spark):
    readings = messages.with_event_time(
        spark.createDataFrame([("1", "bad", "spo2", 1.0), ("1", "2024-01-01 00:00:01", "spo2", 9.0)], READING)
    )
    assert [r.spo2 for r in scoring.window_vitals(readings).collect()] == [9.0]


def test_message_key_and_value(spark):
    row = messages.encode_messages(
        spark.createDataFrame([("12", "2024-01-01 00:00:00", "spo2", 97.5)], READING)
    ).first()
    assert bytes(row.key) == b"12"
    assert json.loads(bytes(row.value)) == {
        "patient_id": "12", "timestamp": "2024-01-01 00:00:00", "vital_sign": "spo2", "value": 97.5,
    }


def test_connectors_without_their_jars_say_so(spark):
    """Neither connector is part of this environment; the calls must get as far as asking for it."""
    sent = messages.encode_messages(
        spark.createDataFrame([("1", "2024-01-01 00:00:00", "spo2", 1.0)], READING)
    )
    with pytest.raises(Exception, match="Failed to find.*kafka|kafka.*deploy"):
        kafka.write_messages(sent, "none:1", "vitals")
    jdbc = {"url": "jdbc:postgresql://none/x", "dbtable": "t"}
    with pytest.raises(Exception, match="No suitable driver"):
        files.read_table(spark, jdbc)
    readings = messages.with_event_time(messages.decode_messages(sent))
    with pytest.raises(Exception, match="No suitable driver"):
        write_scores_batch(scoring.score_readings(readings), 0, jdbc)


def write_lines(path, *lines):
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    return str(path)


def test_csv_columns_go_by_name(spark, tmp_path):
    path = write_lines(tmp_path / "a.csv", "value,ward,vital_sign,timestamp,patient_id", "7.5,B,spo2,t,007")
    df = files.read_vitals_csv(spark, path)
    assert df.columns == READING.names
    assert tuple(df.first()) == ("007", "t", "spo2", 7.5)


@pytest.mark.parametrize("bad", ["x", ""])
def test_csv_value_must_be_a_number(spark, tmp_path, bad):
    path = write_lines(tmp_path / "a.csv", "patient_id,timestamp,vital_sign,value", f"1,t,spo2,{bad}")
    with pytest.raises(Exception, match="value is not a number"):
        files.read_vitals_csv(spark, path).collect()


def test_score_table_lookups_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/scores"
    readings = spark.range(0, 4000).select(
        (F.col("id") % 20).alias("patient_id"),
        (
            F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))
        ).alias("event_time"),
        F.lit("spo2").alias("vital_sign"),
        F.lit(97.0).alias("value"),
    )
    write_scores_batch(scoring.score_readings(readings), 0, path, as_of="2024-02-01 00:00:00")
    table = files.read_scores(spark, path)
    recent = last_hours(table, "2024-01-03 12:00:00")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = recent.filter("patient_id = 3").select("news2_score")._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][-1]
    assert "isnotnull(window_date" in scan.split("PartitionFilters: [")[1] and ">= 2024-01-03" in scan
    assert "EqualTo(patient_id,3)" in scan and "GreaterThanOrEqual(window_start" in scan
    assert "heart_rate" not in scan
    everything = table.filter(F.col("window_start") >= F.lit("2024-01-03 06:00:00").cast("timestamp_ntz"))
    assert recent.count() == everything.count() > 0


def test_read_table_by_name_and_path(spark, tmp_path):
    df = spark.range(5)
    df.write.parquet(f"{tmp_path}/t")
    df.createOrReplaceTempView("numbers")
    for source in (f"{tmp_path}/t", "numbers"):
        assert files.read_table(spark, source, F.col("id") > 2).count() == 2


def test_inline_patients_follow_their_schema(spark):
    row = (
        101, "John Doe", "4A-12", dt.date(1965, 3, 12), "M", ["Penicillin — anaphylaxis"], [], None,
        [], None, None, dt.datetime(2024, 1, 1),
    )
    df = files.inline_rows(spark, [row], PATIENTS)
    assert df.schema == PATIENTS
    assert required(PATIENTS) == [
        "patient_id", "full_name", "allergies", "past_medical_conditions", "current_medications",
        "updated_at",
    ]
    with pytest.raises(Exception):
        files.inline_rows(spark, [(None, *row[1:])], PATIENTS).collect()


def test_json_keeps_nulls_and_writes_iso_times(spark, tmp_path):
    row = (1, None, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5))
    df = spark.createDataFrame([row], "a int, b string, c date, d timestamp_ntz")
    expected = '{"a":1,"b":null,"c":"2024-01-02","d":"2024-01-02T03:04:05"}'
    assert files.to_json_rows(df).first().json == expected
    files.write_json(df, f"{tmp_path}/j")
    assert spark.read.text(f"{tmp_path}/j").first().value == expected
    assert files.to_json_rows(df.select("a")).first().json == '{"a":1}'


def test_ensure_table_twice(spark):
    tables.ensure_table(spark, "ward_scores_test", SCORES)
    try:
        spark.createDataFrame([], SCORES).write.insertInto("ward_scores_test")
        tables.ensure_table(spark, "ward_scores_test", SCORES)
        assert spark.table("ward_scores_test").columns == SCORES.names
    finally:
        spark.sql("DROP TABLE ward_scores_test")


def test_work_folder_uses_the_shared_setting(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    a, b = work_folder(spark, "x"), work_folder(spark, "x")
    assert a != b and a.startswith(f"{shared}/x-")


def test_a_renamed_column_is_refused(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("event"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    with pytest.raises(ValueError, match="lacks event_id, ts, user_id, event_type, props"):
        adapter.load(spark, str(tmp_path), "events")


def test_scores_need_a_session_in_utc(spark):
    readings = spark.createDataFrame([(1, "spo2", 95.0)], "patient_id int, vital_sign string, value double").withColumn("event_time", F.current_timestamp())
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="must be UTC"):
            score_readings(readings)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
