"""Stored tables: updates by range, buckets, key filters, daily partials, published dates, gates."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ward_analytics.operators import assess, checks, latest, partials, stored, tables
from ward_analytics.schemas import SCORES
from ward_analytics.sources import files
from ward_analytics.streaming import published
from ward_analytics.streaming import score_stream as st

COLUMNS = "patient_id int, window_start timestamp_ntz, news2_score int, risk_level string, heart_rate double, respiratory_rate double, spo2 double, systolic_bp double, temperature double"


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def scores(spark, n=600, patients=9, days=6, seed=1):
    rng = random.Random(seed)
    vital = lambda: rng.choice([None, round(rng.uniform(30, 180), 2)])
    out = {}
    for _ in range(n):
        start = f"2024-01-{rng.randint(1, days):02d} {rng.randint(0, 23):02d}:{rng.choice([0, 5, 30]):02d}:00"
        patient = 1 if rng.random() < 0.4 else rng.randint(1, patients)  # one patient has far more rows
        score = rng.randint(0, 20)
        out[patient, start] = (patient, start, score, "LOW" if score < 5 else "HIGH", vital(), vital(), vital(), vital(), vital())
    table = spark.createDataFrame(list(out.values()), COLUMNS.replace("timestamp_ntz", "string"))
    return table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stamps(folder):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(folder) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


def test_updates_leave_other_ranges_alone(spark, tmp_path):
    table = spark.createDataFrame([(i, None if i % 2 else f"r{i}") for i in range(100)], "id int, room string")
    path = f"{tmp_path}/table"
    stored.write_by_range(table, path, "id", 10)
    updates = spark.createDataFrame([(13, "a", 1), (13, "b", 0), (14, "c", 1), (57, "d", 1), (None, "e", 1)], "id int, room string, n int")
    fill = lambda t, u: tables.backfill(t, u, "id", "room", "n")
    before = stamps(path)
    assert stored.update_ranges(spark, path, updates, "id", fill, 10) == [1, 5]
    after = stamps(path)
    kept = {f for f in before if "key_range=1/" not in f and "key_range=5/" not in f}
    assert len(kept) >= 8 and {f: after[f] for f in kept} == {f: before[f] for f in kept} and set(after) != set(before)
    want = rows(tables.backfill(table, updates, "id", "room", "n"))
    assert rows(stored.read_by_range(spark, path)) == want
    stored.update_ranges(spark, path, updates, "id", fill, 10)
    assert rows(stored.read_by_range(spark, path)) == want
    new = spark.createDataFrame([(205, "x", 1), (13, "y", 1)], "id int, room string, n int")
    insert = lambda t, u: tables.insert_absent(t, u, "id", ["n"])
    assert stored.update_ranges(spark, path, new, "id", insert, 10) == [1, 20]
    assert rows(stored.read_by_range(spark, path)) == sorted([*want, str((205, "x"))])
    assert stored.update_ranges(spark, path, new.where("id is null"), "id", insert, 10) == []


def test_small_ranges_are_dealt_to_all_tasks(spark, tmp_path):
    """Each folder costs the same, however few its bytes are; rows without a key are dealt, too."""
    path = f"{tmp_path}/table"
    table = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 4 > 0, F.col("id")).cast("int").alias("id"), F.col("id").alias("n"))
    stored.write_by_range(table, path, "id", 100)
    written = [f.split(os.sep)[-2:] for f in stamps(path)]
    assert len({folder for folder, _ in written}) == 41
    assert len({file.split("-")[1] for folder, file in written if folder != "key_range=__HIVE_DEFAULT_PARTITION__"}) >= 4
    assert len([1 for folder, _ in written if folder == "key_range=__HIVE_DEFAULT_PARTITION__"]) >= 2
    assert rows(stored.read_by_range(spark, path)) == rows(table)


def test_buckets_join_without_moving_rows(spark):
    table = scores(spark)
    profiles = spark.createDataFrame([(i, ["COPD"], None, ["Thiazide"]) for i in range(1, 12)], "patient_id int, past_medical_conditions array<string>, medical_history string, current_medications array<string>")
    stored.write_bucketed(table, "bucketed_scores", "patient_id", 4)
    stored.write_bucketed(profiles, "bucketed_profiles", "patient_id", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = assess.assessments(spark.table("bucketed_scores"), spark.table("bucketed_profiles"), "2024-01-07 00:00:00", 90)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == rows(assess.assessments(table, profiles, "2024-01-07 00:00:00", 90))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE bucketed_scores")
        spark.sql("DROP TABLE bucketed_profiles")


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_key_filter_finds_every_repeated_key(spark, broadcast):
    table = spark.range(0, 5000, 3).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    bits = stored.filter_bits(table.count())
    halves = [stored.key_filter(table.where(f"k % 2 = {i}"), ["k", "name"], bits) for i in (0, 1)]
    merged = stored.merge_filters(*halves)
    assert rows(merged) == rows(stored.key_filter(table, ["k", "name"], bits))
    arrivals = spark.range(0, 20_000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    arrivals = arrivals.unionByName(spark.createDataFrame([(9, "n9"), (7, "n7"), (None, "n"), (None, "n"), (12, "other")], "k long, name string"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        passed = stored.passing(arrivals, merged, ["k", "name"], bits)
        assert 1668 <= passed.count() <= 1668 + 0.15 * 20_000
        found = {(r.k, r.name): (r.n_arrived, r.in_table) for r in stored.repeated_keys(arrivals, table, merged, ["k", "name"], bits).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {(k, f"n{k}"): (1, True) for k in range(0, 5000, 3)}
    want |= {(9, "n9"): (2, True), (7, "n7"): (2, False), (None, "n"): (2, False)}
    assert found == want


def test_partials_equal_the_rows_of_any_look_back(spark, tmp_path):
    table = scores(spark, 900)
    path = f"{tmp_path}/partials"
    first = F.col("news2_score") % 3 > 0
    partials.write_partials(partials.daily_partials(table.where(first)), path)
    partials.add_scores(spark, path, table.where(~first & (F.col("patient_id") < 5)))
    partials.add_scores(spark, path, table.where(~first & (F.col("patient_id") >= 5)))
    partials.add_scores(spark, path, table.where("patient_id < 0"))
    for hours in (6, 24, 31, 77, 200):
        history = assess.recent_celsius(table, "2024-01-07 00:00:00", hours)
        found = partials.look_back(partials.read_partials(spark, path), table, "2024-01-07 00:00:00", hours)
        for plain, merged in ((assess.trends, assess.trends_of), (assess.axis_domain, assess.axis_domain_of), (assess.vital_coverage, assess.vital_coverage_of)):
            assert rows(merged(found)) == rows(plain(history))


def test_partials_read_days_and_rows_of_one_date(spark, tmp_path):
    table = scores(spark)
    st.write_score_table(table, f"{tmp_path}/scores", as_of="2024-01-07 00:00:00")
    partials.write_partials(partials.daily_partials(table), f"{tmp_path}/partials")
    found = partials.look_back(partials.read_partials(spark, f"{tmp_path}/partials"), files.read_scores(spark, f"{tmp_path}/scores"), "2024-01-07 00:00:00", 77)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "day#" in plan and "PartitionFilters: [isnotnull(day" in plan and "window_date#" in plan
    assert rows(assess.trends_of(found)) == rows(assess.trends(assess.recent_celsius(table, "2024-01-07 00:00:00", 77)))


def test_readers_see_old_or_new_rows_at_each_step(spark, tmp_path):
    table, name, path = scores(spark), "published_scores", f"{tmp_path}/scores"
    parts = [table.where(f"patient_id % 3 = {i}") for i in range(3)]
    shown = lambda: rows(published.read_published(spark, name, path).select(*table.columns))
    for i in (0, 1):
        st.write_scores_batch(parts[i], i, path, as_of="2024-01-07 00:00:00")
    two = rows(parts[0].unionByName(parts[1]))
    assert shown() == two
    reader = published.read_published(spark, name, path).select(*table.columns)  # planned before any switch
    merged = published.merge_dates(spark, name, path, ["2024-01-02"])
    assert shown() == two  # cut short here, nothing is seen of it
    assert published.merge_dates(spark, name, path, ["2024-01-02"]) == merged
    published.publish_date(spark, name, "2024-01-02", merged["2024-01-02"])
    assert shown() == two and rows(reader) == two
    assert published.merge_dates(spark, name, path, ["2024-01-02"]) == {}
    st.write_scores_batch(parts[2], 2, path, as_of="2024-01-07 00:00:00")  # late rows of a merged date
    every = rows(table)
    assert shown() == every
    again = published.merge_dates(spark, name, path, ["2024-01-02"])
    assert shown() == every and again != merged
    published.publish_date(spark, name, "2024-01-02", again["2024-01-02"])
    assert shown() == every
    assert published.publish_before(spark, name, path, "2024-01-05") == ["2024-01-01", "2024-01-03", "2024-01-04"]
    assert shown() == every and published.publish_before(spark, name, path, "2024-01-05") == []
    assert published.vacuum(spark, name, path) == 3 * 4 + 1 and published.vacuum(spark, name, path) == 0
    assert shown() == every and len(st._Files(spark, path).folders(f"{st.VALID}/window_date=2024-01-02")) == 0
    spark.sql(f"DROP TABLE {name}")


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    table = scores(spark, 6000, patients=3000, days=2).withColumn("patient_id", F.col("patient_id") * 7)
    wide = table.select("*", F.lit(None).cast("timestamp_ntz").alias("created_at"))
    plain, filtered = f"{tmp_path}/plain", f"{tmp_path}/filtered"
    small = {"parquet.block.size": "8192", "parquet.page.size": "1024", "parquet.block.row.count.limit": "200"}
    for path, options in ((plain, {"parquet.enable.dictionary#patient_id": "false"}), (filtered, st.lookup_options(200))):
        st.write_score_table(wide, path, as_of="2024-01-07 00:00:00", by_time=True, **options, **small)
    wanted = [r.patient_id for r in table.where("patient_id > 70").select("patient_id").orderBy("patient_id").limit(6).collect()]

    def read(path):
        df = files.read_scores(spark, path).where(F.col("patient_id").isin(*wanted)).select(*table.columns)
        got = rows(df)
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return got, scan.metrics().apply("numOutputRows").value()

    (found, few), (every, many) = read(filtered), read(plain)
    assert found == every == rows(table.where(F.col("patient_id").isin(*wanted)))
    assert few < 0.5 * many


def test_a_failing_check_leaves_no_table(spark, tmp_path):
    table = scores(spark)
    path = f"{tmp_path}/gated"
    bad = {"high": F.col("news2_score") > 18, "no_rate": F.col("heart_rate") < 0}
    high = table.where("news2_score > 18").count()
    with pytest.raises(checks.CheckFailed, match=f"high: {high}") as failed:
        checks.gated_write(table, path, bad)
    assert failed.value.counts == {"n_rows": table.count(), "high": high, "no_rate": 0} and os.listdir(tmp_path) == []
    counts = checks.gated_write(table.where("news2_score <= 18"), path, bad)
    assert counts["high"] == 0 and rows(spark.read.parquet(path)) == rows(table.where("news2_score <= 18"))
    with pytest.raises(FileExistsError):
        checks.gated_write(table, path, {})


def test_a_passing_gate_takes_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = scores(spark).mapInArrow(count, COLUMNS)
    n = checks.gated_write(table, f"{tmp_path}/gated", {"none": F.lit(False)})["n_rows"]
    assert n == seen.value


@pytest.mark.parametrize("texts", [("critical", "LOW"), ("low,risk", ""), ("LOW", None)])
def test_newest_rows_keep_any_risk_text(spark, texts):
    table = scores(spark).withColumn("risk_level", F.when(F.col("news2_score") > 9, texts[0]).otherwise(F.lit(texts[1]).cast("string")))
    assert rows(latest.latest_scores(table)) == rows(latest.latest_scores_ranked(table))
    summary = assess.period_summary(table).select("patient_id", F.col("last.risk_level").alias("risk_level"))
    assert rows(summary) == rows(latest.latest_scores_ranked(table).select("patient_id", "risk_level"))


def test_scores_that_were_just_computed_need_no_look_at_other_risks(spark):
    from ward_analytics.operators.scoring import score_readings

    readings = spark.createDataFrame([(1, "spo2", 95.0)], "patient_id int, vital_sign string, value double").withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    plan = latest.latest_scores(score_readings(readings))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_required_columns_are_those_of_the_table(spark):
    assert {f.name for f in SCORES} <= {f.name for f in published._FULL}
