"""Upkeep of tables: who wins, and that doing it twice changes nothing."""

import datetime as dt

from ward_analytics.operators import tables
from ward_analytics.schemas import PATIENTS, SCORES


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_absent_keeps_old_rows_and_first_new_ones(spark):
    target = spark.createDataFrame([(1, "old"), (2, None)], "id int, name string")
    new = spark.createDataFrame(
        [(1, "x", 0), (3, "late", 2), (3, "early", 1), (4, None, 3), (4, "later", 4)],
        "id int, name string, n int",
    )
    once = tables.insert_absent(target, new, "id", ["n"])
    assert once.columns == ["id", "name"]
    assert sorted(rows(once), key=str) == [(1, "old"), (2, None), (3, "early"), (4, None)]
    assert sorted(rows(tables.insert_absent(once, new, "id", ["n"])), key=str) == sorted(rows(once), key=str)


def test_insert_absent_fills_columns_the_rows_lack(spark):
    target = spark.createDataFrame([(1, "a", "r")], "id int, name string, room string")
    new = spark.createDataFrame([(2, "b", 0)], "id int, name string, n int")
    assert rows(tables.insert_absent(target, new, "id", ["n"])) == [(1, "a", "r"), (2, "b", None)]


def test_backfill_sets_only_nulls(spark):
    target = spark.createDataFrame([(1, None), (2, "kept"), (3, None)], "id int, room string")
    updates = spark.createDataFrame(
        [(1, "second", 2), (1, "first", 1), (1, None, 0), (2, "new", 1), (9, "none", 1)],
        "id int, room string, n int",
    )
    once = tables.backfill(target, updates, "id", "room", "n")
    assert {r.id: r.room for r in once.collect()} == {1: "first", 2: "kept", 3: None}
    twice = tables.backfill(once, updates, "id", "room", "n")
    assert {r.id: r.room for r in twice.collect()} == {1: "first", 2: "kept", 3: None}


def test_backfill_with_single_updates(spark):
    target = spark.createDataFrame([(1, None), (2, "kept")], "id int, room string")
    updates = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, room string, n int")
    assert rows(tables.backfill(target, updates, "id", "room", "n")) == [(1, "a"), (2, "kept")]


TWICE = [(1, "b", None), (1, "a", None), (1, "c", 5), (1, "d", 5), (2, "e", None), (None, "f", 1)]


def test_updates_never_change_the_number_of_rows(spark):
    target = spark.createDataFrame([(1, None), (2, None), (2, "kept"), (None, None)], "id int, room string")
    updates = spark.createDataFrame(TWICE, "id int, room string, n int")
    filled = tables.backfill(target, updates, "id", "room", "n")
    assert sorted(map(tuple, filled.collect()), key=str) == sorted([(1, "c"), (2, "e"), (2, "kept"), (None, None)], key=str)
    written = tables.overwrite_columns(target, updates, "id", ["room"], "n")
    assert sorted(map(tuple, written.collect()), key=str) == sorted([(1, "d"), (2, "e"), (2, "e"), (None, None)], key=str)


def test_insert_needs_a_key(spark):
    target = spark.createDataFrame([(1, "a")], "id int, room string")
    new = spark.createDataFrame([(None, "x", 1), (3, "late", None), (3, "first", 2), (4, "only", None)], "id int, room string, n int")
    added = tables.insert_absent(target, new, "id", ["n"])
    assert sorted(map(tuple, added.collect())) == [(1, "a"), (3, "first"), (4, "only")]


def test_overwrite_sets_nulls_too_and_the_last_update_stays(spark):
    target = spark.createDataFrame(
        [(1, "a", "x", 1.0), (2, "b", "y", 2.0)], "id int, home string, job string, v double"
    )
    updates = spark.createDataFrame(
        [(1, "new", "job", 1), (1, None, "last", 2), (7, "q", "q", 1)],
        "id int, home string, job string, n int",
    )
    once = tables.overwrite_columns(target, updates, "id", ["home", "job"], "n")
    assert once.columns == target.columns
    assert rows(once) == [(1, None, "last", 1.0), (2, "b", "y", 2.0)]
    assert rows(tables.overwrite_columns(once, updates, "id", ["home", "job"], "n")) == rows(once)


def test_ensure_columns_twice(spark):
    df = spark.createDataFrame([(1,)], "patient_id int")
    once = tables.ensure_columns(df, PATIENTS)
    assert once.columns == PATIENTS.names
    assert tables.ensure_columns(once, PATIENTS).columns == PATIENTS.names
    assert once.schema["allergies"].dataType.simpleString() == "array<string>"


def test_defaults_fill_only_gaps(spark):
    old, now = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    bare = spark.createDataFrame(
        [(1, ["a"], old), (2, None, None)],
        "patient_id int, allergies array<string>, updated_at timestamp_ntz",
    )
    filled = tables.apply_defaults(bare, "2024-01-01 00:00:00")
    assert rows(filled) == [(1, ["a"], old), (2, [], now)]
    assert rows(tables.apply_defaults(filled, "2025-01-01 00:00:00")) == rows(filled)


def test_split_loses_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "patient_id int, risk_level string")
    valid, rejected = tables.split_valid(df, ["patient_id", "risk_level"])
    assert rows(valid) == [(1, "a")]
    marked = tables.mark_valid(df, ["patient_id", "risk_level"])
    assert sorted(r.status for r in marked.collect()) == ["rejected", "rejected", "valid"]
    assert sorted(rejected.collect(), key=str) == sorted([(None, "b"), (2, None)], key=str)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "patient_id int")
    assert rows(tables.duplicate_keys(df, "patient_id")) == [(1, 2)]


def test_replace_cohort(spark, tmp_path):
    cohort = spark.createDataFrame([(99001, 67)], "patient_id int, age int")
    path = f"{tmp_path}/patients"
    for day in ("2024-01-01", "2024-01-02"):
        tables.overwrite_table(tables.replace_cohort(cohort, day), path)
    born = dt.date(2024, 1, 2) - dt.timedelta(days=67 * 365)
    assert rows(spark.read.parquet(path)) == [(99001, born)]


def test_ensure_columns_completes_scores(spark):
    df = spark.createDataFrame([(1, None)], "patient_id int, news2_score int")
    assert set(tables.ensure_columns(df, SCORES).columns) == set(SCORES.names)


def test_whole_upkeep_twice_is_once(spark):
    """Add columns, insert, backfill rooms, overwrite addresses: a second pass changes nothing."""
    old = spark.createDataFrame([(101, "Ann"), (104, "Dora")], "patient_id int, full_name string")
    seed = spark.createDataFrame(
        [(101, "Ann Smith", "4A-12", 1), (102, "Bea", None, 2), (102, "Bea again", "9", 3)],
        "patient_id int, full_name string, room_number string, n int",
    )
    rooms = spark.createDataFrame([(101, "4A-12", 1), (102, "4A-15", 2)], "patient_id int, room_number string, n int")
    homes = spark.createDataFrame(
        [(101, "Oak Lane", "Engineer", 1), (102, "Birch Court", None, 2)],
        "patient_id int, home_address string, occupation string, n int",
    )

    def upkeep(table):
        table = tables.ensure_columns(table, PATIENTS)
        table = tables.insert_absent(table, seed, "patient_id", ["n"])
        table = tables.backfill(table, rooms, "patient_id", "room_number", "n")
        table = tables.overwrite_columns(table, homes, "patient_id", ["home_address", "occupation"], "n")
        return tables.apply_defaults(table, "2024-01-01 00:00:00")

    shown = ["patient_id", "full_name", "room_number", "home_address", "occupation", "allergies"]
    once = upkeep(old)
    assert rows(once.select(shown[:4])) == [
        (101, "Ann", "4A-12", "Oak Lane"), (102, "Bea", "4A-15", "Birch Court"),
        (104, "Dora", None, None),
    ]
    assert {r.patient_id: r.allergies for r in once.collect()} == {101: [], 102: [], 104: []}
    twice = upkeep(once)
    assert twice.columns == once.columns
    assert sorted(twice.collect(), key=str) == sorted(once.collect(), key=str)
