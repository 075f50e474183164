"""Scores, bands, units, ages and trends."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ward_analytics.catalogue import (
    ASSESS_LADDERS,
    RISES_WHEN_WORSE,
    RISK_BOUNDS,
    SCORE_BANDS,
    SEVERITIES,
    TOP_RISK,
    TREND_STEP,
)


def band_column(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first case that holds, else ``default``; one CASE expression."""
    result = F
    for condition, answer in cases:
        result = result.when(condition, answer)
    return result.otherwise(default)


def score_vital(vital: str, c: Column, missing: str = "reference") -> Column:
    """Early-warning points of one vital.

    A value between two bands takes the fallback points, and so does a missing one unless
    ``missing="zero"``.
    """
    bands, fallback = SCORE_BANDS[vital]
    cases = [
        (c <= high if low is None else c.between(low, high), points)
        for low, high, points in bands
    ]
    if missing == "zero":
        cases.insert(0, (c.isNull(), 0))
    elif missing != "reference":
        raise ValueError(f"missing must be 'reference' or 'zero', not {missing!r}")
    return band_column(cases, fallback)


def risk_level(c: Column) -> Column:
    return band_column([(c <= bound, risk) for bound, risk in RISK_BOUNDS], TOP_RISK)


def assess_vital(vital: str, c: Column) -> tuple[Column, Column]:
    """(points, problem text) of a value on the gap-free ladder; both null for a null value."""
    *steps, last = ASSESS_LADDERS[vital]
    missing = (c.isNull(), None)
    points = band_column([missing] + [(c <= s.upper, s.score) for s in steps], last.score)
    problem = band_column([missing] + [(c <= s.upper, s.problem) for s in steps], last.problem)
    return points.cast("int"), problem.cast("string")


def severity(points: Column) -> Column:
    normal, warning, critical = SEVERITIES
    return band_column([(points == 0, normal), (points == 1, warning)], critical)


def round_binary(c: Column, digits: int) -> Column:
    """Rounded to decimals by the exact value of the double, ties to the even digit.

    ``F.round`` and ``format_string`` round the shortest decimal that prints like the double, which is
    often a tie where the double is none. Here the fraction, which is exact in a double, is compared with the tie
    points between two results. Where it equals the double next to a tie point, it is known beforehand
    on which side of it that double lies, or that it is the tie itself.
    """
    scale = 10**digits
    ties = [Fraction(2 * k + 1, 2 * scale) for k in range(scale)]
    at_tie = "".join("1" if Fraction(float(t)) > t or (Fraction(float(t)) == t and k % 2 == 1) else "0" for k, t in enumerate(ties))
    size = F.abs(c)
    whole = F.floor(size)
    fraction = size - whole
    step = F.least(F.floor(fraction * scale), F.lit(scale - 1)).cast("int")
    tie = (step * 2 + 1) / F.lit(2.0 * scale)  # divided exactly, so the double next to the tie point
    up = (fraction > tie) | ((fraction == tie) & (F.substring(F.lit(at_tie), step + 1, F.lit(1)) == "1"))
    rounded = (whole * scale + step + up.cast("int")) / F.lit(float(scale))
    exact = F.isnan(c) | (size >= 2.0**53 / scale)  # no decimals left to round
    return F.when(c.isNull() | exact, c).otherwise(F.when(c < 0, -1.0).otherwise(1.0) * rounded)


def f_to_c(c: Column) -> Column:
    return round_binary((c - 32) * 5 / 9, 1)


def trend(vital: str, rows: Column, first: Column, last: Column) -> Column:
    """``worsening`` or ``improving`` between the ends of a period; null when neither."""
    worse = last > first if vital in RISES_WHEN_WORSE else last < first
    moved = (rows >= 2) & (F.abs(last - first) >= TREND_STEP)
    return F.when(moved, F.when(worse, "worsening").otherwise("improving"))


def age_years(dob: Column, as_of: Column | date | datetime | str) -> Column:
    """Completed calendar years; a birthday on 29 February counts from 1 March."""
    today = as_of if isinstance(as_of, Column) else F.lit(str(as_of)[:10]).cast("date")
    before_birthday = F.struct(F.month(today), F.dayofmonth(today)) < F.struct(
        F.month(dob), F.dayofmonth(dob)
    )
    return F.year(today) - F.year(dob) - before_birthday.cast("int")


def at_time(as_of: Column | datetime | str) -> Column:
    """A literal time without zone, so that comparisons reach the file scan."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")
