"""Reports: problems in words, vitals as text tables, prompts for a clinical reviewer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ward_analytics.catalogue import (
    BULLET,
    DASH,
    FACTORS_HEADING,
    NO_PROBLEMS_TEXT,
    NO_VITALS_TEXT,
    NONE_DOCUMENTED,
    PROMPT_BACKGROUND,
    PROMPT_NO_AGE,
    PROMPT_NO_RISK,
    PROMPT_NO_SEX,
    PROMPT_QUESTION,
    PROMPT_ROLE,
    PROMPT_SCORE,
    PROMPT_VITALS,
    PROMPT_YEARS,
    VITALS_TABLE_HEAD,
)
from ward_analytics.functions.numeric import age_years, f_to_c
from ward_analytics.functions.text import (
    cause_items,
    causes_summary,
    join_lines,
    opening,
    plain_sentence,
    split_problem,
    unique_ignoring_case,
)
from ward_analytics.operators.latest import NEWEST, last_hours
from ward_analytics.operators.serving import needs_review


def split_problems(long: DataFrame) -> DataFrame:
    """Medical and plain half of each problem text."""
    medical, plain = split_problem(F.col("problem"))
    return long.withColumns({"medical": medical, "plain": plain})


def _most_severe_first(assessments: Column) -> Column:
    """Problems by falling score; equal scores stay in catalogue order."""

    def entry(a: Column) -> Column:
        medical, plain = split_problem(a["problem"])
        return F.struct(
            (-a["score"]).alias("rank"),
            a["vital_order"].alias("vital_order"),
            F.concat(medical, F.lit(" ("), a["detail"], F.lit(")")).alias("clause"),
            plain_sentence(plain, a["trend"]).alias("sentence"),
            cause_items(a["causes"]).alias("causes"),
        )

    problems = F.filter(assessments, lambda a: a["problem"].isNotNull())
    return F.array_sort(F.transform(problems, entry))


def _narrated(rows: DataFrame) -> DataFrame:
    """Each patient's row with opening, causes and plain sentences; arrays of at most five."""
    problems = rows.select(
        "patient_id", "last", _most_severe_first(F.col("assessments")).alias("problems")
    )
    return problems.select(
        "patient_id",
        "last",
        F.size("problems").alias("n_problems"),
        opening(F.transform("problems", lambda p: p["clause"])).alias("opening"),
        unique_ignoring_case(
            F.flatten(F.transform("problems", lambda p: p["causes"]))
        ).alias("causes"),
        join_lines(F.transform("problems", lambda p: p["sentence"])).alias("plain"),
    )


def unique_causes(rows: DataFrame) -> DataFrame:
    """All different causes of a patient's problems, the most severe problem's first."""
    return _narrated(rows).select("patient_id", causes_summary(F.col("causes")).alias("causes"))


def medical_narrative(rows: DataFrame) -> DataFrame:
    """Opening sentence and bulleted factors; null for a patient without problems."""
    bullets = join_lines(F.transform("causes", lambda c: F.concat(F.lit(BULLET), c)))
    with_factors = F.concat("opening", F.lit(f"\n{FACTORS_HEADING}\n"), bullets)
    text = F.when(F.size("causes") > 0, with_factors).otherwise(F.col("opening"))
    return _narrated(rows).select("patient_id", text.alias("narrative"))


def plain_english(rows: DataFrame) -> DataFrame:
    return _narrated(rows).select("patient_id", F.col("plain").alias("plain_english"))


def active_problems(rows: DataFrame) -> DataFrame:
    """The problem panel of each patient."""
    none = F.col("n_problems") == 0
    heading = F.concat(
        F.lit("Active Problem (NEWS2 "),
        F.coalesce(F.col("last.news2_score").cast("string"), F.lit(DASH)),
        F.lit(" — "),
        F.upper(F.coalesce("last.risk_level", F.lit("UNKNOWN"))),
        F.lit(")"),
    )
    return _narrated(rows).select(
        "patient_id",
        F.col("last.news2_score").alias("news2_score"),
        F.upper("last.risk_level").alias("risk_level"),
        "n_problems",
        F.when(none, NO_PROBLEMS_TEXT).otherwise(heading).alias("heading"),
        F.col("opening").alias("medical"),
        causes_summary(F.col("causes")).alias("causes"),
        F.when(~none, F.col("plain")).alias("plain_english"),
    )


def _printed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def vitals_text_lines(
    scores: DataFrame, as_of: Column | datetime | str, hours: int = 6
) -> DataFrame:
    """One text line per score row of the look-back, with its place in time; temperature in °C.

    Needs no shuffle. It is also the form to write when a look-back is too long for one text.
    """
    recent = last_hours(scores, as_of, hours)
    line = F.concat_ws(
        " | ",
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"),
        _printed(F.col("heart_rate")),
        _printed(F.col("respiratory_rate")),
        _printed(F.col("spo2")),
        _printed(F.col("systolic_bp")),
        F.coalesce(f_to_c(F.col("temperature")).cast("string"), F.lit(DASH)),
        _printed(F.col("news2_score")),
        _printed(F.col("risk_level")),
    )
    return recent.select("patient_id", *NEWEST, "risk_level", line.alias("line"))


def vitals_text_table(
    scores: DataFrame, as_of: Column | datetime | str, hours: int = 6
) -> DataFrame:
    """The look-back of each patient as one text, with the newest score.

    The text of a patient has one line per score window of the look-back (73 for six hours of
    five-minute windows): the number of readings behind them does not matter.
    """
    lines = vitals_text_lines(scores, as_of, hours)
    entry = F.struct(*NEWEST, "risk_level", "line")
    collected = lines.groupBy("patient_id").agg(
        F.array_sort(F.collect_list(entry)).alias("rows")
    )
    newest = F.element_at("rows", -1)
    body = join_lines(F.transform("rows", lambda r: r["line"]))
    return collected.select(
        "patient_id",
        F.concat(F.lit("\n".join(VITALS_TABLE_HEAD) + "\n"), body).alias("vitals_table"),
        newest["news2_score"].alias("news2_score"),
        newest["risk_level"].alias("risk_level"),
    )


def clinical_prompts(
    scores: DataFrame,
    patients: DataFrame,
    as_of: datetime | str,
    hours: int = 6,
) -> DataFrame:
    """A review prompt for each patient with a profile."""
    tables = vitals_text_table(scores, as_of, hours)
    return _prompts(_prompt_profiles(patients).join(tables, "patient_id", "left"), as_of, hours)


def review_prompts(
    scores: DataFrame,
    patients: DataFrame,
    as_of: datetime | str,
    hours: int = 6,
) -> DataFrame:
    """The prompts of the patients whose newest risk in the look-back calls for a review."""
    tables = needs_review(vitals_text_table(scores, as_of, hours))
    return _prompts(_prompt_profiles(patients).join(tables, "patient_id"), as_of, hours)


def _prompt_profiles(patients: DataFrame) -> DataFrame:
    return patients.select(
        "patient_id", "date_of_birth", "sex", "past_medical_conditions", "current_medications"
    )


def _prompts(joined: DataFrame, as_of: datetime | str, hours: int) -> DataFrame:
    age = age_years(F.col("date_of_birth"), as_of)
    documented = lambda c: F.coalesce(
        F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(NONE_DOCUMENTED)
    )
    prompt = F.concat(
        F.lit(PROMPT_ROLE + PROMPT_BACKGROUND),
        F.coalesce(F.concat(age.cast("string"), F.lit(PROMPT_YEARS)), F.lit(PROMPT_NO_AGE)),
        F.lit(", "),
        F.coalesce(F.nullif("sex", F.lit("")), F.lit(PROMPT_NO_SEX)),
        F.lit(", "),
        documented("past_medical_conditions"),
        F.lit(", "),
        documented("current_medications"),
        F.lit(PROMPT_VITALS.format(hours=hours)),
        F.coalesce("vitals_table", F.lit(NO_VITALS_TEXT.format(hours=hours))),
        F.lit(PROMPT_SCORE),
        F.coalesce(F.col("news2_score").cast("string"), F.lit(DASH)),
        F.lit(" - "),
        F.upper(F.coalesce("risk_level", F.lit(PROMPT_NO_RISK))),
        F.lit(". " + PROMPT_QUESTION),
    )
    return joined.select("patient_id", prompt.alias("prompt"))
