"""Goldens of every band edge, gap and missing value."""

import pytest
from pyspark.sql import functions as F

from ward_analytics.catalogue import VITALS
from ward_analytics.functions.numeric import (
    age_years,
    assess_vital,
    f_to_c,
    risk_level,
    round_binary,
    score_vital,
    severity,
)
from ward_analytics.operators.scoring import score_windows

SCORES = {
    "respiratory_rate": {
        8: 3, 8.5: 3, 9: 1, 11: 1, 11.5: 3, 12: 0, 20: 0, 20.5: 3, 21: 2, 24: 2, 25: 3, None: 3,
    },
    "spo2": {91: 3, 91.5: 0, 92: 2, 93: 2, 93.5: 0, 94: 1, 95: 1, 95.5: 0, 96: 0, None: 0},
    "systolic_bp": {
        90: 3, 90.5: 3, 91: 2, 100: 2, 100.5: 3, 101: 1, 110: 1, 110.5: 3, 111: 0, 219: 0,
        219.5: 3, None: 3,
    },
    "heart_rate": {
        40: 3, 40.5: 3, 41: 1, 50: 1, 51: 0, 90: 0, 90.5: 3, 91: 1, 110: 1, 111: 2, 130: 2,
        131: 3, None: 3,
    },
    "temperature": {
        35.0: 3, 35.05: 2, 35.1: 1, 36.0: 1, 36.1: 0, 38.0: 0, 38.05: 2, 38.1: 1, 39.0: 1,
        39.5: 2, None: 2,
    },
}

LADDERS = {
    "heart_rate": {
        40: (3, "Severe bradycardia"), 40.5: (1, "Bradycardia"), 50: (1, "Bradycardia"),
        50.5: (0, None), 90: (0, None), 90.5: (1, "Mild tachycardia"), 110: (1, "Mild tachycardia"),
        110.5: (2, "Tachycardia"), 130: (2, "Tachycardia"), 130.5: (3, "Severe tachycardia"),
    },
    "respiratory_rate": {
        8: (3, "Bradypnea"), 8.5: (1, "Low respiratory rate"), 11: (1, "Low respiratory rate"),
        11.5: (0, None), 20: (0, None), 20.5: (2, "Tachypnea"), 24: (2, "Tachypnea"),
        24.5: (3, "Severe tachypnea"),
    },
    "spo2": {
        91: (3, "Hypoxemia"), 91.5: (2, "Low SpO₂"), 93: (2, "Low SpO₂"),
        93.5: (1, "Mild hypoxemia"), 95: (1, "Mild hypoxemia"), 95.5: (0, None),
    },
    "systolic_bp": {
        90: (3, "Hypotension"), 90.5: (2, "Low blood pressure"), 100: (2, "Low blood pressure"),
        100.5: (1, "Mild hypotension"), 110: (1, "Mild hypotension"), 110.5: (0, None),
        219: (0, None), 219.5: (3, "Hypertensive crisis"),
    },
    "temperature": {
        35.0: (3, "Hypothermia"), 35.05: (1, "Low temperature"), 36.0: (1, "Low temperature"),
        36.05: (0, None), 38.0: (0, None), 38.05: (1, "Fever"), 39.0: (1, "Fever"),
        39.05: (2, "High fever"),
    },
}


def values(spark, numbers):
    return spark.createDataFrame([(None if v is None else float(v),) for v in numbers], "v double")


@pytest.mark.parametrize("vital", VITALS)
def test_score_bands(spark, vital):
    grid = SCORES[vital]
    df = values(spark, grid).select("v", score_vital(vital, F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == grid


@pytest.mark.parametrize("vital", VITALS)
def test_missing_may_count_as_zero(spark, vital):
    df = values(spark, SCORES[vital]).select("v", score_vital(vital, F.col("v"), "zero").alias("s"))
    assert {r.v: r.s for r in df.collect()} == {**SCORES[vital], None: 0}


def test_unknown_options_are_refused(spark):
    with pytest.raises(ValueError):
        score_vital("spo2", F.col("v"), "none")
    with pytest.raises(ValueError):
        score_windows(spark.range(1), temperature_unit="K")


@pytest.mark.parametrize("vital", VITALS)
def test_assessment_ladders(spark, vital):
    grid = LADDERS[vital]
    points, problem = assess_vital(vital, F.col("v"))
    rows = values(spark, [*grid, None]).select("v", points.alias("s"), problem.alias("p")).collect()
    found = {r.v: (r.s, r.p and r.p.split(" — ")[0]) for r in rows}
    assert found == {**grid, None: (None, None)}


@pytest.mark.parametrize("vital", VITALS)
def test_bands_and_ladders_agree_between_the_gaps(spark, vital):
    """Whole numbers, and tenths of a degree, lie in no gap: there both rule sets give one score."""
    step = 0.1 if vital == "temperature" else 1.0
    df = spark.range(0, 450).select(F.round(F.col("id") * step, 1).alias("v"))
    pair = df.select(
        "v",
        score_vital(vital, F.col("v")).alias("banded"),
        assess_vital(vital, F.col("v"))[0].alias("laddered"),
    )
    assert pair.filter("banded != laddered").collect() == []


def test_risk_and_severity(spark):
    df = spark.range(0, 9).select("id", risk_level(F.col("id")).alias("r"), severity(F.col("id")).alias("s"))
    rows = df.orderBy("id").collect()
    assert [r.r for r in rows] == ["LOW"] * 5 + ["MEDIUM"] * 2 + ["HIGH"] * 2
    assert [r.s for r in rows][:4] == ["normal", "warning", "critical", "critical"]


def test_fahrenheit(spark):
    df = values(spark, [98.6, 103.6, None]).select(f_to_c(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == [37.0, 39.8, None]


@pytest.mark.parametrize(
    "dob, as_of, age",
    [
        ("1965-03-12", "2024-03-11", 58),
        ("1965-03-12", "2024-03-12", 59),
        ("1964-02-29", "2023-02-28", 58),
        ("1964-02-29", "2023-03-01", 59),
        (None, "2024-01-01", None),
    ],
)
def test_age(spark, dob, as_of, age):
    df = spark.range(1).select(age_years(F.lit(dob).cast("date"), as_of).alias("age"))
    assert df.first().age == age


def test_celsius_equals_python(spark):
    """Every hundredth of 0 to 120 °F, and their negatives."""
    values = [i / 100 for i in range(12_001)] + [-i / 100 for i in range(1, 12_001)]
    df = spark.createDataFrame([(v,) for v in values], "f double").select("f", f_to_c(F.col("f")).alias("c"))
    got = {r.f: r.c for r in df.collect()}
    assert all(got[v] == round((v - 32) * 5 / 9, 1) for v in values)
    plain = {r.f: r.c for r in df.select("f", F.round((F.col("f") - 32) * 5 / 9, 1).alias("c")).collect()}
    assert sum(plain[v] != got[v] for v in values) > 100


@pytest.mark.parametrize("digits", [1, 2])
def test_display_equals_python(spark, digits):
    values = [i / 1000 for i in range(0, 100_000, 5)] + [72.25, 72.35, 72.05, 0.05, 0.25, 0.35, 1e15 + 0.5, 2.0**53, 0.0, 99.95, 9.995]
    values += [-v for v in values if v]
    shown = F.format_string(f"%.{digits}f", round_binary(F.col("v"), digits))
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", shown.alias("s")).collect()
    assert [r.s for r in rows] == [f"{r.v:.{digits}f}" for r in rows]


def test_rounding_keeps_what_is_no_number(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    got = [r[0] for r in df.select(round_binary(F.col("v"), 1)).collect()]
    assert got[0] is None and got[1] != got[1] and got[2] == float("inf")
