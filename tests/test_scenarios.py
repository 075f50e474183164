"""The five scenario courses as static readings, from messages to verdicts."""

import datetime as dt

import pytest

from ward_analytics.catalogue import VITALS
from ward_analytics.operators import checks, scoring
from ward_analytics.schemas import EXPECTATIONS, READING
from ward_analytics.sources import messages

START = dt.datetime(2024, 1, 1)
STEADY = (72.0, 16.0, 98.0, 118.0, 98.6)


def course(n, start, end):
    """Readings per minute; the step count makes the last one overshoot the end."""
    for m in range(n):
        yield tuple(
            round(a + (b - a) * m / (n - 2), 2 if v == "temperature" else 1)
            for v, a, b in zip(VITALS, start, end)
        )


COURSES = {
    99001: list(course(21, (75, 18, 97, 118, 98.8), (125, 32, 84, 118, 98.8))),
    99002: list(course(12, (80, 16, 96, 120, 98.6), (135, 26, 96, 88, 103.6))),
    99003: [(145.0, 28.0, 91.0, 85.0, 98.6)] * 5,
    99004: [STEADY] * 21,
    99005: [(140.0, *STEADY[1:]), (75.0, *STEADY[1:])] + [STEADY] * 19,
}
EXPECTED = [
    (99001, "Respiratory Failure", "HIGH", 7, None),
    (99002, "Sepsis Pattern", "HIGH", 7, None),
    (99003, "Cardiac Event", "HIGH", 7, None),
    (99004, "Stable Patient", "LOW", None, 4),
    (99005, "False Alarm", "LOW", None, 4),
]


def readings(spark):
    rows = [
        (str(p), str(START + dt.timedelta(minutes=m)), vital, value)
        for p, minutes in COURSES.items()
        for m, values in enumerate(minutes)
        for vital, value in zip(VITALS, values)
    ]
    sent = messages.encode_messages(spark.createDataFrame(rows, READING))
    return messages.with_event_time(messages.decode_messages(sent))


@pytest.mark.parametrize("unit", ["as_is", "F"])
def test_expectations_hold(spark, unit):
    scores = scoring.score_readings(readings(spark), temperature_unit=unit)
    checked = checks.scenario_check(scores, spark.createDataFrame(EXPECTED, EXPECTATIONS))
    assert {r.report.split(":")[0] for r in checked.collect()} == {
        f"PASS — {name} (patient {p})" for p, name, *_ in EXPECTED
    }
    assert tuple(checks.check_summary(checked).first()) == (5, 0)


@pytest.mark.parametrize("unit, cardiac, stable, alarm", [("as_is", 14, 2, [5, 2]), ("F", 12, 0, [3, 0])])
def test_scores_by_unit(spark, unit, cardiac, stable, alarm):
    scores = scoring.score_readings(readings(spark), temperature_unit=unit).orderBy("window_start")
    by_patient = {}
    for r in scores.collect():
        by_patient.setdefault(r.patient_id, []).append(r.news2_score)
    assert by_patient[99003] == [cardiac]
    assert set(by_patient[99004]) == {stable}
    assert by_patient[99005][:2] == alarm


def test_failures_name_their_reasons(spark):
    scores = scoring.score_readings(readings(spark))
    wrong = [(99003, "A", "LOW", None, 4), (99004, "B", "HIGH", 7, None), (99009, "C", "LOW", None, None)]
    expectations = spark.createDataFrame(wrong, EXPECTATIONS)
    checked = checks.scenario_check(scores, expectations)
    assert {r.patient_id: r.report for r in checked.collect()} == {
        99003: "FAIL — A (patient 99003): score=14, risk=HIGH "
        "(expected risk LOW, got HIGH; expected score <= 4, got 14)",
        99004: "FAIL — B (patient 99004): score=2, risk=LOW "
        "(expected risk HIGH, got LOW; expected score >= 7, got 2)",
        99009: "FAIL — C (patient 99009): no score in Postgres",
    }
    assert tuple(checks.check_summary(checked).first()) == (3, 3)
    assert [r.patient_id for r in checks.missing_scores(scores, expectations).collect()] == [99009]


def test_unknown_vital_still_makes_a_row(spark):
    rows = spark.createDataFrame([("3", "2024-01-01 00:08:00", "glucose", 5.0)], READING)
    row = scoring.score_readings(messages.with_event_time(rows)).first()
    assert (row.patient_id, row.news2_score, row.risk_level, row.spo2) == (3, 11, "HIGH", None)
