"""Assessment of every patient's newest vitals, with trends and likely causes.

The look-back shrinks to one row per patient in a single aggregation with map-side partials. All
that follows happens inside that row: five vitals are columns or an array of at most five entries,
so nothing else is shuffled but the profiles that join by patient.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ward_analytics.catalogue import (
    CAUSE_RULES,
    CAUSES_PREFIX,
    MULTI_SYSTEM,
    NO_DATA_TEXT,
    NORMAL_TEXT,
    SHOWN_CAUSES,
    VITAL_CATALOGUE,
    VITALS,
    Cause,
)
from ward_analytics.functions.numeric import assess_vital, severity, trend
from ward_analytics.functions.text import (
    detail,
    format_timestamp,
    format_vital_value,
    has_term,
    profile_context,
    unique_ignoring_case,
)
from ward_analytics.operators.latest import at_end, last_hours, with_key, with_risk
from ward_analytics.operators.serving import to_celsius


def unpivot_vitals(scores: DataFrame, ids: tuple[str, ...] = ("patient_id", "window_start")) -> DataFrame:
    """One row per vital that has a value."""
    long = scores.unpivot(list(ids), list(VITALS), "vital_sign", "value")
    return long.filter(F.col("value").isNotNull())


def vital_catalogue(spark: SparkSession) -> DataFrame:
    """The five catalogue rows as a table."""
    entries = [
        F.struct(
            F.lit(order).alias("vital_order"),
            F.lit(vital.name).alias("vital_sign"),
            *(F.lit(getattr(vital, f)).alias(f) for f in ("label", "low", "high", "description")),
        )
        for order, vital in enumerate(VITAL_CATALOGUE, start=1)
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def vital_catalogue_join(readings: DataFrame) -> DataFrame:
    """Label and range of each reading's vital; the catalogue has five rows, so it is broadcast."""
    return readings.join(F.broadcast(vital_catalogue(readings.sparkSession)), "vital_sign")


def period_summary(history: DataFrame) -> DataFrame:
    """One row per patient: number of rows, first and last row, and per vital the lowest and
    highest value and the number of values."""
    vitals = {v: F.nanvl(F.col(v), F.lit(None).cast("double")) for v in VITALS}
    rows = history.select(
        "patient_id", "window_start", "news2_score", "risk_level",
        *(c.alias(v) for v, c in vitals.items()),
    )
    ends = ["window_start", "news2_score", "risk_level", *VITALS]
    spread = [
        agg(v).alias(f"{v}_{name}")
        for v in VITALS
        for name, agg in (("lowest", F.min), ("highest", F.max), ("values", F.count))
    ]
    found = with_key(rows).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("_key").alias("first__key"),
        F.max("_key").alias("last__key"),
        *at_end(ends, F.min_by, "first_"),
        *at_end(ends, F.max_by, "last_"),
        *spread,
    )
    for side in ("first", "last"):
        found = with_risk(found, rows, f"{side}__key", f"{side}_risk_level")
    row = lambda side: F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ends)).alias(side)
    kept = [c for c in found.columns if not c.startswith(("first_", "last_"))]
    return found.select(*kept, row("first"), row("last"))


def _trend_columns() -> dict[str, Column]:
    return {
        f"{v}_trend": trend(v, F.col("n_rows"), F.col(f"first.{v}"), F.col(f"last.{v}"))
        for v in VITALS
    }


def _by_vital(summary: DataFrame, **fields: str) -> DataFrame:
    """Long form of a patient row: for each catalogue vital the fields named by a pattern."""
    entries = [
        F.struct(
            F.lit(order).alias("vital_order"),
            F.lit(vital.name).alias("vital_sign"),
            *(F.col(pattern.format(v=vital.name)).alias(f) for f, pattern in fields.items()),
        )
        for order, vital in enumerate(VITAL_CATALOGUE, start=1)
    ]
    return summary.select("patient_id", F.inline(F.array(*entries)))


def recent_celsius(scores: DataFrame, as_of: Column | datetime | str, hours: int) -> DataFrame:
    return to_celsius(last_hours(scores, as_of, hours))


def trends(history: DataFrame) -> DataFrame:
    """Trend of every vital between the first and last row of each patient."""
    return trends_of(period_summary(history))


def trends_of(summary: DataFrame) -> DataFrame:
    return _by_vital(summary.withColumns(_trend_columns()), trend="{v}_trend")


def vital_coverage(history: DataFrame) -> DataFrame:
    """Number of values per patient and vital; a vital without any has the status ``No data``."""
    return vital_coverage_of(period_summary(history))


def vital_coverage_of(summary: DataFrame) -> DataFrame:
    long = _by_vital(summary, n_values="{v}_values")
    return long.withColumn("status", F.when(F.col("n_values") == 0, NO_DATA_TEXT))


def _domains() -> dict[str, Column]:
    columns = {}
    for v in VITAL_CATALOGUE:
        low = F.least(F.col(f"{v.name}_lowest") * 0.9, F.lit(v.low * 0.85))
        high = F.greatest(F.col(f"{v.name}_highest") * 1.1, F.lit(v.high * 1.15))
        known = F.col(f"{v.name}_values") > 0
        columns[f"{v.name}_y_min"] = F.when(known, low)
        columns[f"{v.name}_y_max"] = F.when(known, high)
    return columns


def axis_domain(history: DataFrame) -> DataFrame:
    """Chart range per patient and vital with data."""
    return axis_domain_of(period_summary(history))


def axis_domain_of(summary: DataFrame) -> DataFrame:
    long = _by_vital(summary.withColumns(_domains()), y_min="{v}_y_min", y_max="{v}_y_max")
    return long.filter(F.col("y_min").isNotNull())


TERM_SETS = tuple(
    dict.fromkeys(
        c.terms for rule in CAUSE_RULES.values() for c in rule.above + rule.otherwise if c.terms
    )
)


def patient_contexts(patients: DataFrame) -> DataFrame:
    context = profile_context(
        F.col("past_medical_conditions"), F.col("medical_history"), F.col("current_medications")
    )
    return patients.select("patient_id", context.alias("context"))


def _term_column(terms: tuple[str, ...]) -> str:
    return "mentions_" + "_".join(terms).replace(" ", "_")


def _findings() -> dict[str, Column]:
    """What causes depend on: abnormal vitals of the row, and each set of profile terms once."""
    abnormal = {v: F.coalesce(F.col(f"{v}_score") > 0, F.lit(False)) for v in VITALS}
    number = reduce(add, (a.cast("int") for a in abnormal.values()))
    fever, multi = abnormal["temperature"], number >= MULTI_SYSTEM
    return {
        "n_abnormal": number,
        "is_multi": multi,
        "has_fever": fever,
        "has_hypoxia": abnormal["spo2"],
        "fever_or_multi": fever | multi,
        "fever_and_multi": fever & multi,
        **{_term_column(terms): has_term(F.col("context"), *terms) for terms in TERM_SETS},
    }


def _always(cause: Cause) -> bool:
    return not cause.needs and not cause.terms


def _can_show(causes: tuple[Cause, ...]) -> list[Cause]:
    """The causes that may be among the first few: none behind as many that always apply."""
    kept, certain = [], set()
    for cause in causes:
        if len(certain) == SHOWN_CAUSES:
            break
        kept.append(cause)
        if _always(cause):
            certain.add(cause.text.lower())
    return kept


def _listed(causes: tuple[Cause, ...]) -> Column:
    """The first causes that apply, as a text."""
    candidates = _can_show(causes)
    if all(_always(c) for c in candidates):
        return F.lit(CAUSES_PREFIX + ", ".join(c.text for c in candidates))
    items = [
        F.lit(c.text) if _always(c) else F.when(F.col(c.needs or _term_column(c.terms)), c.text)
        for c in candidates
    ]
    applying = F.array_compact(F.array(*items))
    if len({c.text.lower() for c in candidates}) < len(candidates):
        applying = unique_ignoring_case(applying)
    shown = F.slice(applying, 1, SHOWN_CAUSES)
    return F.concat(F.lit(CAUSES_PREFIX), F.array_join(shown, ", "))


def _causes(vital: str) -> Column:
    """Likely causes of an abnormal vital, null for a normal one."""
    rule, abnormal = CAUSE_RULES[vital], F.col(f"{vital}_score") > 0
    if not rule.above:
        return F.when(abnormal, _listed(rule.otherwise))
    above = F.col(f"last.{vital}") > rule.split
    return F.when(abnormal & above, _listed(rule.above)).when(abnormal, _listed(rule.otherwise))


def patient_assessments(
    scores: DataFrame,
    patients: DataFrame | None,
    as_of: Column | datetime | str,
    hours: int = 6,
) -> DataFrame:
    """One row per patient with rows in the look-back: the newest score, ``n_rows``, the period
    columns, and ``assessments``, an array with an entry for each vital of the newest row."""
    return assess_summary(period_summary(recent_celsius(scores, as_of, hours)), patients)


def assess_summary(summary: DataFrame, patients: DataFrame | None) -> DataFrame:
    """The same from a period summary, wherever it comes from."""
    if patients is None:
        summary = summary.withColumn("context", F.lit(""))
    else:
        summary = summary.join(patient_contexts(patients), "patient_id", "left")
    ladder = {}
    for v in VITALS:
        ladder[f"{v}_score"], ladder[f"{v}_problem"] = assess_vital(v, F.col(f"last.{v}"))
    assessed = (
        summary.withColumns({**ladder, **_trend_columns()})
        .withColumns(_findings())
        .withColumns({f"{v}_causes": _causes(v) for v in VITALS})
    )
    entries = []
    for order, vital in enumerate(VITAL_CATALOGUE, start=1):
        v, value = vital.name, F.col(f"last.{vital.name}")
        points, problem = F.col(f"{v}_score"), F.col(f"{v}_problem")
        entry = F.struct(
            F.lit(order).alias("vital_order"),
            F.lit(v).alias("vital_sign"),
            F.lit(vital.label).alias("label"),
            value.alias("value"),
            points.alias("score"),
            severity(points).alias("severity"),
            problem.alias("problem"),
            F.when(problem.isNotNull(), detail(value, vital.unit)).alias("detail"),
            F.col(f"{v}_trend").alias("trend"),
            F.col(f"{v}_causes").alias("causes"),
        )
        entries.append(F.when(value.isNotNull(), entry))
    return assessed.withColumn("assessments", F.array_compact(F.array(*entries)))


def assessments(
    scores: DataFrame,
    patients: DataFrame | None,
    as_of: Column | datetime | str,
    hours: int = 6,
) -> DataFrame:
    """One row per patient and vital of the newest row.

    The outer form and a filter behind it: for the inner one Spark would test the array for
    entries below the generator, and so work out all of it twice.
    """
    rows = patient_assessments(scores, patients, as_of, hours)
    long = rows.select("patient_id", F.inline_outer("assessments"))
    return long.filter(F.col("vital_order").isNotNull())


def likely_causes(
    scores: DataFrame,
    patients: DataFrame | None,
    as_of: Column | datetime | str,
    hours: int = 6,
) -> DataFrame:
    long = assessments(scores, patients, as_of, hours)
    return long.select("patient_id", "vital_sign", "score", "causes")


def abnormal_vitals(long: DataFrame) -> DataFrame:
    return long.filter(F.col("score") > 0)


def abnormal_summary(rows: DataFrame) -> DataFrame:
    """The abnormal vitals of each patient in catalogue order, their number, and whether several
    systems are affected."""
    names = F.transform(
        F.filter("assessments", lambda a: a["score"] > 0), lambda a: a["vital_sign"]
    )
    return rows.select(
        "patient_id",
        F.array_join(names, ", ").alias("abnormal"),
        F.col("n_abnormal").alias("n_abnormal"),
        F.col("is_multi").alias("multi_system"),
        F.col("has_fever").alias("fever"),
        F.col("has_hypoxia").alias("hypoxia"),
    )


def vital_cards(rows: DataFrame) -> DataFrame:
    """A card per patient and catalogue vital.

    A vital without a value in the period shows ``No data``; one without a value in the newest row
    shows ``nan`` and counts as normal, without a trend or a status.
    """
    cards = []
    for order, vital in enumerate(VITAL_CATALOGUE, start=1):
        v, value = vital.name, F.col(f"last.{vital.name}")
        known, present = F.col(f"{v}_values") > 0, value.isNotNull()
        level = F.when(present, severity(F.col(f"{v}_score"))).otherwise("normal")
        cards.append(
            F.struct(
                F.lit(order).alias("vital_order"),
                F.lit(v).alias("vital_sign"),
                F.lit(vital.description).alias("description"),
                F.lit(vital.label).alias("label"),
                F.when(known, format_vital_value(v, value))
                .otherwise(NO_DATA_TEXT)
                .alias("value_text"),
                F.when(known & present, F.col(f"{v}_trend")).alias("trend"),
                F.when(known, level).alias("severity"),
                F.when(present, F.coalesce(f"{v}_problem", F.lit(NORMAL_TEXT))).alias("status"),
                F.col(f"{v}_causes").alias("causes"),
                F.col(f"{v}_y_min").alias("y_min"),
                F.col(f"{v}_y_max").alias("y_max"),
            )
        )
    updated = format_timestamp(F.col("last.window_start")).alias("last_updated")
    return rows.withColumns(_domains()).select("patient_id", updated, F.inline(F.array(*cards)))
