"""Texts and small arrays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ward_analytics.functions import text
from ward_analytics.operators import serving
from ward_analytics.schemas import PATIENTS


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def strings(*items):
    return F.array(*(F.lit(i) for i in items)).cast("array<string>")


def test_split_problem(spark):
    pair = lambda s: one(spark, *text.split_problem(F.lit(s)))
    assert pair("Fever — body — hot") == ("Fever", "body — hot")
    assert pair("Fever") == ("Fever", "Fever")


def test_unique_ignoring_case_keeps_first_spelling(spark):
    items = strings("Pneumonia", "pain", "pneumonia", "PAIN", "sepsis")
    assert one(spark, text.unique_ignoring_case(items))[0] == ["Pneumonia", "pain", "sepsis"]
    assert one(spark, text.unique_ignoring_case(strings()))[0] == []


def test_cause_items(spark):
    items = one(spark, text.cause_items(F.lit("Likely causes: a,  b ,, c (x)")))[0]
    assert items == ["a", "b", "c (x)"]
    assert one(spark, text.cause_items(F.lit(None).cast("string")))[0] == []


@pytest.mark.parametrize(
    "clauses, expected",
    [
        ([], None),
        (["A"], "Patient presents with A."),
        (["A", "B"], "Patient presents with A and B."),
        (["A", "B", "C"], "Patient presents with A, B, and C."),
        (["A", "B", "C", "D"], "Patient presents with A, B, C, and D."),
    ],
)
def test_opening(spark, clauses, expected):
    assert one(spark, text.opening(strings(*clauses)))[0] == expected


def test_plain_sentence(spark):
    sentence = lambda s, t: one(spark, text.plain_sentence(F.lit(s), F.lit(t).cast("string")))[0]
    assert sentence("body temperature elevated", None) == "Body temperature elevated."
    assert sentence("systolic BP low", "worsening") == "Systolic BP low and getting worse."
    assert sentence("low", "improving") == "Low but improving."


def test_causes_summary(spark):
    assert one(spark, text.causes_summary(strings("a", "b")))[0] == "a; b"
    assert one(spark, text.causes_summary(strings()))[0] is None


def test_context_keeps_its_separators(spark):
    none = F.lit(None)
    context = text.profile_context(strings("COPD", "Asthma"), none.cast("string"), strings("Beta"))
    assert one(spark, context)[0] == "copd asthma  beta"
    empty = text.profile_context(none.cast("array<string>"), none.cast("string"), strings())
    assert one(spark, empty)[0] == "  "
    assert one(spark, text.has_term(F.lit("former smoker"), "Smok", "x"))[0] is True
    assert one(spark, text.has_term(F.lit("former smoker"), "copd"))[0] is False


def test_values_and_times(spark):
    when = F.lit("2024-01-05 06:07:08").cast("timestamp_ntz")
    assert one(
        spark,
        text.format_vital_value("temperature", F.lit(36.8)),
        text.format_vital_value("spo2", F.lit(97.25)),
        text.format_vital_value("spo2", F.lit(None).cast("double")),
        text.detail(F.lit(36.8), "°C"),
        text.format_timestamp(when),
        text.format_timestamp(F.lit(None).cast("timestamp_ntz")),
        text.format_date(when),
        text.format_date(F.lit(None).cast("date")),
        text.iso_timestamp(when),
        text.iso_timestamp(F.lit("2024-01-05 06:07:08.5").cast("timestamp_ntz")),
        text.iso_date(F.lit(None).cast("date")),
    ) == (
        "36.80", "97.2", "nan", "36.8 °C", "2024-01-05 06:07:08 UTC", "—", "05 Jan 2024", "—",
        "2024-01-05T06:07:08", "2024-01-05T06:07:08.500000", None,
    )


def test_lists_and_labels(spark):
    assert one(
        spark,
        text.list_or_label(strings("a", "b"), "none"),
        text.list_or_label(strings(), "none"),
        text.list_or_label(F.lit(None).cast("array<string>"), "none"),
        text.or_label(F.lit(""), "none"),
        text.or_label(F.lit(None).cast("string"), "none"),
        text.or_label(F.lit("x"), "none"),
    ) == ("a, b", "none", "none", "none", "none", "x")


def patients(spark):
    now = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [
            (1, "Ann", "4A", dt.date(1965, 3, 12), "F", ["Latex"], ["COPD"], "CABG", [], "Home", "Baker", now),
            (2, "Bob", None, None, None, [], [], None, [], None, None, now),
        ],
        PATIENTS,
    )


def test_background(spark):
    ann, bob = serving.patient_background(patients(spark)).orderBy("patient_id").collect()
    assert ann.meta == "Patient ID: 1 · Room: 4A · DOB: 12 Mar 1965 · Sex: F"
    assert (ann.allergies, ann.current_medications) == ("Latex", "No current medications on file.")
    assert bob.meta == "Patient ID: 2"
    assert bob.allergies == "No known drug allergies (NKDA)"
    assert bob.medical_history == "No additional medical history documented."


def test_profile_lookup(spark):
    ids = spark.createDataFrame([(1,), (5,)], "patient_id int")
    profiles = serving.patient_profile(patients(spark), ids)
    assert {r.patient_id: (r.found, r.full_name) for r in profiles.collect()} == {
        1: (True, "Ann"), 5: (False, None),
    }
    texts = {r.patient_id: r.json for r in serving.profile_json(profiles).collect()}
    assert texts[5] == '{"patient_id":5,"found":false}'
    assert texts[1].startswith('{"patient_id":1,"full_name":"Ann","room_number":"4A","date_of_birth":"1965-03-12"')


def test_display_defaults(spark):
    active = spark.createDataFrame(
        [(7, None, None, None, None, None)],
        "patient_id int, full_name string, news2_score int, risk_level string, "
        "window_start timestamp_ntz, room_number string",
    )
    assert tuple(serving.ward_cards(active).first()) == (7, "—", "—", "LOW", "—")
    assert tuple(serving.roster(active).first()) == (7, "Patient 7 (—)", "LOW")
