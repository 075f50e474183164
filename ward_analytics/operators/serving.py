"""What the ward asks for: active patients, histories, profiles, roster, background."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ward_analytics.catalogue import DASH, EMPTY_LABELS, REVIEW_RISKS
from ward_analytics.functions.numeric import f_to_c
from ward_analytics.functions.text import (
    format_date,
    format_timestamp,
    list_or_label,
    or_label,
)
from ward_analytics.operators.latest import latest_scores
from ward_analytics.sources.files import iso_times


def to_celsius(scores: DataFrame) -> DataFrame:
    return scores.withColumn("temperature", f_to_c(F.col("temperature")))


def active_patients(scores: DataFrame, patients: DataFrame) -> DataFrame:
    """Newest score of every patient with a profile, by id.

    The scores shrink to one row per patient before they meet the profiles, so the join has no
    skewed key and shuffles little.
    """
    newest = latest_scores(
        scores.select("patient_id", "window_start", "news2_score", "risk_level")
    )
    profiles = patients.select("patient_id", "full_name", "room_number")
    return (
        newest.join(profiles, "patient_id")
        .select(
            "patient_id", "full_name", "news2_score", "risk_level", "window_start", "room_number"
        )
        .orderBy("patient_id")
    )


def ward_cards(active: DataFrame) -> DataFrame:
    """Display texts of the active patients."""
    return active.select(
        "patient_id",
        F.coalesce(F.nullif("room_number", F.lit("")), F.lit(DASH)).alias("room"),
        F.coalesce(F.col("news2_score").cast("string"), F.lit(DASH)).alias("news2"),
        F.upper(F.coalesce("risk_level", F.lit("LOW"))).alias("risk"),
        format_timestamp(F.col("window_start")).alias("last_updated"),
    )


def roster(active: DataFrame) -> DataFrame:
    """``name (score)`` labels by id."""
    name = F.coalesce(
        F.nullif("full_name", F.lit("")),
        F.concat(F.lit("Patient "), F.col("patient_id").cast("string")),
    )
    score = F.coalesce(F.col("news2_score").cast("string"), F.lit(DASH))
    return active.select(
        "patient_id",
        F.concat(name, F.lit(" ("), score, F.lit(")")).alias("label"),
        F.upper(F.coalesce("risk_level", F.lit("LOW"))).alias("risk_level"),
    ).orderBy("patient_id")


def needs_review(df: DataFrame) -> DataFrame:
    return df.filter(F.upper("risk_level").isin(*REVIEW_RISKS))


def vitals_history(
    scores: DataFrame, patient_ids: Iterable[int] | DataFrame | None = None
) -> DataFrame:
    """All rows of the patients asked for (of all by default), °C, in time order. The ids are a
    short list, or a table with ``patient_id`` of any length.

    The order is global by patient and time, so a long history spreads over many range partitions.
    """
    if isinstance(patient_ids, DataFrame):
        scores = scores.join(patient_ids, "patient_id", "left_semi")
    elif patient_ids is not None:
        scores = scores.filter(F.col("patient_id").isin(*patient_ids))
    return to_celsius(scores).orderBy("patient_id", "window_start")


def patient_profile(patients: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each id asked for, with ``found``; unknown ids have no other values."""
    known = patients.withColumn("found", F.lit(True))
    joined = ids.select("patient_id").join(known, "patient_id", "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def profile_json(profiles: DataFrame) -> DataFrame:
    """Profiles as JSON objects with ISO times; an unknown id has only the two fields."""
    options = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(*profiles.columns), options)
    unknown = F.to_json(F.struct("patient_id", "found"), options)
    return iso_times(profiles).select(
        "patient_id", F.when(F.col("found"), full).otherwise(unknown).alias("json")
    )


def patient_background(patients: DataFrame) -> DataFrame:
    """Title, meta line and the six sections, with a label where nothing is known."""
    optional = [
        ("Room: ", F.nullif("room_number", F.lit(""))),
        ("DOB: ", F.when(F.col("date_of_birth").isNotNull(), format_date(F.col("date_of_birth")))),
        ("Sex: ", F.nullif("sex", F.lit(""))),
    ]
    meta = [F.concat(F.lit("Patient ID: "), F.col("patient_id").cast("string"))]
    meta += [F.concat(F.lit(name), value) for name, value in optional]
    texts = {c: or_label(F.col(c), label) for c, label in EMPTY_LABELS.items()}
    for c in ("allergies", "past_medical_conditions", "current_medications"):
        texts[c] = list_or_label(F.col(c), EMPTY_LABELS[c])
    title = F.coalesce("full_name", F.concat(F.lit("Patient "), F.col("patient_id").cast("string")))
    return patients.select(
        "patient_id",
        title.alias("title"),
        F.concat_ws(" · ", *meta).alias("meta"),
        *(text.alias(c) for c, text in texts.items()),
    )
