"""Texts, dates and small arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ward_analytics.catalogue import CAUSES_PREFIX, DASH, PROBLEM_SEPARATOR, TREND_NOTES
from ward_analytics.functions.numeric import round_binary


def profile_context(conditions: Column, history: Column, medications: Column) -> Column:
    """Lower-cased conditions, history and medications; a missing part stays as an empty one."""
    parts = (F.array_join(conditions, " "), history, F.array_join(medications, " "))
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def has_term(context: Column, *terms: str) -> Column:
    found = [context.contains(t.lower()) for t in terms]
    result = found[0]
    for other in found[1:]:
        result = result | other
    return result


def split_problem(problem: Column) -> tuple[Column, Column]:
    """(medical, plain) halves at the first separator; the whole text twice when there is none."""
    halves = F.split(problem, PROBLEM_SEPARATOR, 2)
    has_two = F.size(halves) > 1
    pick = lambda i: F.when(has_two, F.btrim(F.get(halves, F.lit(i)))).otherwise(problem)
    return pick(0), pick(1)


def unique_ignoring_case(items: Column) -> Column:
    """The items in order, each only where it occurs first; for short arrays."""
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda kept, item: F.when(
            F.exists(kept, lambda k: F.lower(k) == F.lower(item)), kept
        ).otherwise(F.array_append(kept, item)),
    )


def cause_items(causes: Column) -> Column:
    """The single causes of a "Likely causes" text; no causes give an empty array."""
    parts = F.split(F.replace(causes, F.lit(CAUSES_PREFIX), F.lit("")), ",")
    trimmed = F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def causes_summary(items: Column) -> Column:
    return F.nullif(F.array_join(items, "; "), F.lit(""))


def detail(value: Column, unit: str) -> Column:
    return F.concat_ws(" ", value.cast("string"), F.lit(unit))


def format_vital_value(vital: str, value: Column) -> Column:
    """Two decimals for temperature, one for the others; a missing value prints ``nan``."""
    digits = 2 if vital == "temperature" else 1
    shown = F.format_string(f"%.{digits}f", round_binary(value, digits))
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(shown)


def format_timestamp(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit(DASH))


def format_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd MMM yyyy"), F.lit(DASH))


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_timestamp(c: Column) -> Column:
    """ISO form; the fraction is left out when it is zero."""
    whole = F.date_trunc("second", c) == c
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def or_label(c: Column, label: str) -> Column:
    """The text, or the label when it is missing or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def list_or_label(items: Column, label: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, label).otherwise(
        F.array_join(items, ", ")
    )


def opening(clauses: Column) -> Column:
    """"Patient presents with A, B, and C." for any number of clauses; null for none."""
    n = F.size(clauses)
    last = F.get(clauses, n - 1)
    before = F.slice(clauses, F.lit(1), F.greatest(n - 1, F.lit(0)))
    listed = (
        F.when(n == 1, last)
        .when(n == 2, F.concat(F.get(clauses, F.lit(0)), F.lit(" and "), last))
        .when(n > 2, F.concat(F.array_join(before, ", "), F.lit(", and "), last))
    )
    return F.concat(F.lit("Patient presents with "), listed, F.lit("."))


def plain_sentence(plain: Column, trend: Column) -> Column:
    """The plain half with its first letter in upper case and a note on the trend."""
    note = F.lit("")
    for name, text in TREND_NOTES.items():
        note = F.when(trend == name, text).otherwise(note)
    first = F.upper(F.substring(plain, 1, 1))
    return F.concat(first, F.substring(plain, 2, 2_147_483_647), note, F.lit("."))


def join_lines(lines: Column | Sequence[Column]) -> Column:
    return F.array_join(lines if isinstance(lines, Column) else F.array(*lines), "\n")
