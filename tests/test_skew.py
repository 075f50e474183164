"""One patient holds a third of all readings, one window another third: results against brute
force, and shuffles that stay small."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ward_analytics.catalogue import VITALS
from ward_analytics.operators import assess, checks, latest, narrative, scoring, tables
from ward_analytics.plans.queries import REGISTRY
from ward_analytics.schemas import PATIENTS

N = 60_000


@pytest.fixture(scope="module")
def readings(spark):
    i = F.col("id")
    minutes = F.when(i % 3 == 1, F.lit(7)).otherwise(i % 2880)
    return (
        spark.range(0, N, 1, 6)
        .select(
            F.when(i % 3 == 0, F.lit(1)).otherwise(i % 97 + 2).alias("patient_id"),
            (
                F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))
            ).alias("event_time"),
            F.element_at(F.array(*(F.lit(v) for v in VITALS)), (i * 7 % 5 + 1).cast("int")).alias("vital_sign"),
            (F.pmod(F.hash("id"), F.lit(1500)) / 10 + 30).alias("value"),
        )
        .cache()
    )


@pytest.fixture(scope="module")
def brute(readings):
    """Highest values per (patient, minute of window start)."""
    wide = defaultdict(dict)
    for r in readings.collect():
        minute = (r.event_time.day - 1) * 1440 + r.event_time.hour * 60 + r.event_time.minute
        cell = wide[r.patient_id, minute // 5 * 5]
        cell[r.vital_sign] = max(cell.get(r.vital_sign, r.value), r.value)
    return wide


def minute_of(row):
    t = row.window_start
    return (t.day - 1) * 1440 + t.hour * 60 + t.minute


def shuffled_records(df):
    """Rows written to the shuffles of a finished query, by shuffle."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo.extend(children.apply(k) for k in range(children.size()))
    return found


def test_windows_equal_brute_force(readings, brute):
    rows = scoring.window_vitals(readings).withColumn("window_start", F.col("window.start")).collect()
    found = {(r.patient_id, minute_of(r)): {v: r[v] for v in VITALS if r[v] is not None} for r in rows}
    assert found == dict(brute)


def test_hot_keys_shrink_before_the_shuffle(readings, brute):
    """Each task sends one row per key, also of the hot ones."""
    keys = (F.spark_partition_id().alias("task"), "patient_id", F.window("event_time", "5 minutes"))
    per_task = readings.select(*keys).distinct().groupBy("patient_id").count().collect()
    sent = sum(r["count"] for r in per_task)
    assert shuffled_records(scoring.score_readings(readings)) == [sent]
    assert sent < N / 2
    assert next(r["count"] for r in per_task if r.patient_id == 1) < N / 3 / 5
    patients = len({p for p, _ in brute})
    by_patient = shuffled_records(latest.latest_scores(scoring.score_readings(readings)))
    assert min(by_patient) <= 4 * patients


def test_latest_and_text_equal_brute_force(readings, brute):
    scores = scoring.score_readings(readings).cache()
    newest = {}
    for p, m in brute:
        newest[p] = max(newest.get(p, m), m)
    assert {r.patient_id: minute_of(r) for r in latest.latest_scores(scores).collect()} == newest
    assert {r.patient_id: minute_of(r) for r in latest.latest_scores_ranked(scores).collect()} == newest
    as_of = "2024-01-03 00:00:00"
    lines = defaultdict(int)
    for p, _ in brute:
        lines[p] += 1
    tables_ = narrative.vitals_text_table(scores, as_of, 48).collect()
    assert {r.patient_id: r.vitals_table.count("\n") - 1 for r in tables_} == lines
    for r in tables_:
        times = [line[:19] for line in r.vitals_table.split("\n")[2:]]
        assert times == sorted(times)
    assert narrative.vitals_text_lines(scores, as_of, 48).count() == len(brute)
    scores.unpersist()


def test_period_summary_equals_brute_force(readings, brute):
    rows = assess.period_summary(scoring.score_readings(readings)).collect()
    for r in rows:
        history = sorted((m, c) for (p, m), c in brute.items() if p == r.patient_id)
        assert r.n_rows == len(history)
        for v in VITALS:
            values = [c[v] for _, c in history if v in c]
            assert r[f"{v}_values"] == len(values)
            assert r[f"{v}_lowest"] == min(values, default=None)
            assert r[f"{v}_highest"] == max(values, default=None)
            assert r["first"][v] == history[0][1].get(v)
            assert r["last"][v] == history[-1][1].get(v)


def test_large_profiles_cost_one_more_shuffle(spark, readings):
    """With profiles too large to broadcast, the rows per patient stay where the aggregation put
    them; only the profiles move."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        profiles = spark.createDataFrame([], PATIENTS)
        scores = scoring.score_readings(readings)
        rows = assess.patient_assessments(scores, profiles, "2024-01-03 00:00:00", 48)
        plan = narrative.active_problems(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 3


def test_upkeep_with_a_hot_key(spark, readings, brute):
    target = spark.createDataFrame([(2, "known")], "patient_id bigint, name string")
    arrivals = readings.select("patient_id", F.lit("new").alias("name"), F.monotonically_increasing_id().alias("n"))
    added = tables.insert_absent(target, arrivals, "patient_id", ["n"]).collect()
    assert sorted(r.patient_id for r in added) == sorted({p for p, _ in brute} | {2})
    updates = arrivals.withColumn("name", F.col("n").cast("string"))
    last = updates.groupBy("patient_id").agg(F.max("n").alias("n")).collect()
    updated = tables.overwrite_columns(
        readings.select("patient_id", F.lit("x").alias("name")).distinct(), updates, "patient_id", ["name"], "n"
    )
    assert {r.patient_id: r.name for r in updated.collect()} == {r.patient_id: str(r.n) for r in last}
    expected = spark.createDataFrame([(1, "hot"), (999, "none")], "patient_id bigint, scenario string")
    missing = checks.missing_scores(scoring.score_readings(readings), expected)
    assert [r.patient_id for r in missing.collect()] == [999]


@pytest.mark.parametrize("name", ["latest_scores", "latest_in_range", "active_patients", "needs_review", "trend", "assessments", "clinical_prompts", "scenario_check"])
def test_newest_and_period_rows_hash(spark, name):
    """Aggregates over scores have buffers of a fixed size: no task sorts its rows to aggregate them."""
    plan = REGISTRY[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan
    assert name == "clinical_prompts" or "SortAggregate" not in plan
