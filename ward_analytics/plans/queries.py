"""One registered query per operator, each over whole tables.

Readings come from ``events`` and patients from ``customer``. Score queries run on five-minute
windows, the ones that explain vitals on one-day windows and a look-back over the whole time span.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ward_analytics.operators import assess, checks, latest, narrative, partials, scoring, serving, stored, tables
from ward_analytics.functions.numeric import age_years
from ward_analytics.functions.text import has_term, profile_context
from ward_analytics.schemas import PATIENTS
from ward_analytics.session import work_folder
from ward_analytics.sources import adapter, files, messages
from ward_analytics.streaming import live, published, score_stream

AS_OF = "2024-01-31 00:00:00"
LOOK_BACK = 720
ID_RANGE = (5, 75)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapter.load(spark, d, "events")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return adapter.readings(_events(spark, d))


def _patients(spark: SparkSession, d: str) -> DataFrame:
    return adapter.patients(adapter.load(spark, d, "customer"))


def _expectations(spark: SparkSession, d: str) -> DataFrame:
    return adapter.expectations(adapter.load(spark, d, "customer"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_readings(_readings(spark, d))


def _daily(spark: SparkSession, d: str, **options: str) -> DataFrame:
    return scoring.score_readings(_readings(spark, d), "1 day", **options)


def _mild(spark: SparkSession, d: str) -> DataFrame:
    """Daily scores without points for missing vitals, so that all three risks occur."""
    return _daily(spark, d, missing="zero")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return assess.recent_celsius(_daily(spark, d), AS_OF, LOOK_BACK)


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return assess.patient_assessments(_daily(spark, d), _patients(spark, d), AS_OF, LOOK_BACK)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return assess.assessments(_daily(spark, d), _patients(spark, d), AS_OF, LOOK_BACK)


def _unnumbered(spark: SparkSession, d: str) -> DataFrame:
    """Readings, those above a level without a patient number."""
    number = F.col("user_id").cast("string")
    labelled = _events(spark, d).withColumn(
        "patient", F.when(F.col("value") > 50, F.concat(F.lit("p"), number)).otherwise(number)
    )
    return adapter.readings(labelled.withColumn("user_id", F.col("patient")))


def _lists_as_text(patients: DataFrame) -> DataFrame:
    lists = ("allergies", "past_medical_conditions", "current_medications")
    return patients.withColumns({c: F.array_join(c, "; ") for c in lists})


# Scores ------------------------------------------------------------------------------------------


@query
def window_vitals(spark, d):
    wide = scoring.window_vitals(_readings(spark, d))
    return wide.select(
        "patient_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *assess.VITALS,
    )


@query
def scores(spark, d):
    return _scores(spark, d)


@query
def scores_daily(spark, d):
    return _daily(spark, d)


@query
def scores_daily_celsius(spark, d):
    return _daily(spark, d, temperature_unit="F")


@query
def scores_daily_missing_zero(spark, d):
    return _daily(spark, d, missing="zero")


# Sources, sinks and streams ----------------------------------------------------------------------


@query
def message_roundtrip(spark, d):
    sent = messages.encode_messages(adapter.raw_readings(_events(spark, d)))
    received = messages.with_event_time(messages.decode_messages(sent))
    return received.select(
        "patient_id",
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        "vital_sign",
        "value",
    )


@query
def decode_malformed(spark, d):
    """Readings mixed with whole texts that are no messages: how many of each survive decoding."""
    good = messages.encode_messages(adapter.raw_readings(_events(spark, d))).select("value")
    bad = adapter.load(spark, d, "documents").select(F.col("text").cast("binary").alias("value"))
    decoded = messages.with_event_time(messages.decode_messages(good.unionByName(bad)))
    usable = tables.valid_rows(["patient_id", "event_time", "vital_sign", "value"])
    return decoded.groupBy(F.when(usable, "reading").otherwise("malformed").alias("status")).agg(
        F.count(F.lit(1)).alias("n_messages")
    )


@query
def csv_roundtrip(spark, d):
    path = work_folder(spark, "readings") + "/csv"
    files.write_vitals_csv(adapter.raw_readings(_events(spark, d)), path)
    return files.read_vitals_csv(spark, path)


@query
def stream_scores(spark, d):
    """The score stream over ``events`` as files: only windows that the watermark closed."""
    folder = work_folder(spark, "stream")
    arriving = messages.encode_messages(adapter.raw_readings(adapter.event_stream(spark, d)))
    run = score_stream.start_score_sink(
        score_stream.score_stream(arriving),
        f"{folder}/scores",
        f"{folder}/checkpoint",
        trigger={"availableNow": True},
    )
    run.awaitTermination()
    return files.read_scores(spark, f"{folder}/scores").drop("created_at", "window_date")


def _three_runs(spark: SparkSession, d: str, folder: str, run: Callable[[DataFrame], object]) -> None:
    """``events`` as messages in three parts, each followed by a run: the first half but for a tenth, the second half but for
    its last day, and then that day with the tenth that was held back, whose windows the watermark has closed."""
    events, held = _events(spark, d), F.col("event_id") % 10 == 0
    half, day = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-16 00:00:00", "2024-01-30 00:00:00"))
    early, late = F.col("ts") < half, F.col("ts") >= day
    for number, part in enumerate((early & ~held, ~early & ~late, early & held | late)):
        arriving = messages.encode_messages(adapter.raw_readings(events.filter(part)))
        arriving.write.parquet(f"{folder}/in/part={number}")
        run(spark.readStream.schema("key binary, value binary").parquet(f"{folder}/in/part=*")).awaitTermination()


@query
def stream_late(spark, d):
    """The score stream in three runs over one checkpoint, the last with readings whose windows are closed."""
    folder = work_folder(spark, "late")
    _three_runs(spark, d, folder, lambda source: score_stream.start_score_sink(
        score_stream.score_stream(source), f"{folder}/scores", f"{folder}/checkpoint", trigger={"availableNow": True}
    ))
    return files.read_scores(spark, f"{folder}/scores").drop("created_at", "window_date")


@query
def live_newest(spark, d):
    """The live table of newest scores after three runs, read from the state of the stream."""
    folder = work_folder(spark, "newest")
    _three_runs(spark, d, folder, lambda source: live.start_changes(
        live.newest_changes(score_stream.score_stream(source)), f"{folder}/changes", f"{folder}/checkpoint"
    ))
    return live.newest_scores(spark, f"{folder}/checkpoint")


def _accounted(spark: SparkSession, d: str) -> str:
    folder = work_folder(spark, "accounted")
    _three_runs(spark, d, folder, lambda source: live.start_accounted(
        live.windows_and_late(source), f"{folder}/out", f"{folder}/checkpoint"
    ))
    return f"{folder}/out"


@query
def accounted_scores(spark, d):
    """Scores of the windows that the accounting stream closed in three runs."""
    return live.accounted_scores(spark, _accounted(spark, d))


@query
def late_readings(spark, d):
    """The readings that came too late, with their window and by how much."""
    return live.late_readings(spark, _accounted(spark, d))


@query
def live_assessments(spark, d):
    """Assessments of the six hours before the watermark, after three runs of a stream whose look-back ages."""
    folder = work_folder(spark, "look-back")
    _three_runs(spark, d, folder, lambda source: live.start_changes(
        live.look_back_changes(score_stream.score_stream(source)), f"{folder}/changes", f"{folder}/checkpoint"
    ))
    rows = assess.assess_summary(live.look_back_summary(spark, f"{folder}/changes"), _patients(spark, d))
    return rows.select("patient_id", F.inline("assessments"))


@query
def csv_replay(spark, d):
    """Readings written as CSV, replayed as a stream file after file."""
    folder = work_folder(spark, "replay")
    files.write_vitals_csv(adapter.raw_readings(_events(spark, d)).repartition(4), f"{folder}/csv")
    run = files.replay_vitals_csv(spark, f"{folder}/csv").writeStream.format("parquet").option("path", f"{folder}/out")
    run.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def score_table(spark, d):
    """The score table written whole, and read back from its date folders."""
    folder = work_folder(spark, "scores") + "/table"
    score_stream.write_score_table(_scores(spark, d), folder, as_of=AS_OF)
    return files.read_scores(spark, folder).drop("window_date")


@query
def score_table_rejected(spark, d):
    """What the score table sets aside: readings above a level come without a patient number."""
    folder = work_folder(spark, "rejected") + "/table"
    score_stream.write_score_table(scoring.score_readings(_unnumbered(spark, d)), folder, as_of=AS_OF)
    return files.read_scores(spark, folder, status="rejected").drop("window_date")


@query
def score_table_compacted(spark, d):
    """The score table from two batches, with the dates of its first half merged."""
    folder = work_folder(spark, "compacted") + "/table"
    odd = F.col("patient_id") % 2 == 1
    for number, part in enumerate((odd, ~odd)):
        score_stream.write_scores_batch(_scores(spark, d).filter(part), number, folder, as_of=AS_OF)
    score_stream.compact_scores(spark, folder, "2024-01-16")
    return files.read_scores(spark, folder).drop("window_date")


@query
def scores_published(spark, d):
    """The score table from three batches, of which dates are merged and published in the catalogue, some of them twice."""
    folder = work_folder(spark, "published") + "/table"
    name = f"published_{uuid.uuid4().hex}"
    for number in range(3):
        if number == 2:
            published.publish_before(spark, name, folder, "2024-01-16")
        part = _scores(spark, d).filter(F.col("patient_id") % 3 == number)
        score_stream.write_scores_batch(part, number, folder, as_of=AS_OF)
    published.publish_before(spark, name, folder, "2024-01-08")
    published.vacuum(spark, name, folder)
    return published.read_published(spark, name, folder).drop("window_date")


@query
def scores_by_filter(spark, d):
    """A lookup of a few patients in files that go by time, where Bloom filters tell which row groups to read."""
    folder = work_folder(spark, "filtered") + "/table"
    score_stream.write_score_table(_scores(spark, d), folder, as_of=AS_OF, by_time=True, **score_stream.lookup_options(1000))
    wanted = files.read_scores(spark, folder).where(F.col("patient_id").isin(1, 2, 3, 5, 8, 13))
    return wanted.drop("created_at", "window_date")


@query
def gated_scores(spark, d):
    """Scores written behind a gate that all rows pass."""
    path = work_folder(spark, "gated") + "/scores"
    bad = {"no_key": F.col("patient_id").isNull() | F.col("window_start").isNull(), "no_score": ~F.col("news2_score").between(0, 20)}
    checks.gated_write(_scores(spark, d), path, bad)
    return files.read_table(spark, path)


@query
def gate_refused(spark, d):
    """What the gate counts when checks of scenarios fail, and whether it leaves a table."""
    path = work_folder(spark, "refused") + "/checked"
    checked = checks.scenario_check(_mild(spark, d), _expectations(spark, d))
    try:
        counts = checks.gated_write(checked, path, {"n_failures": F.col("verdict") == "FAIL"})
    except checks.CheckFailed as failed:
        counts = failed.counts
    kept = score_stream.table_there(spark, path)
    return spark.createDataFrame([(counts["n_rows"], counts["n_failures"], kept)], "n_checks long, n_failures long, kept boolean")


@query
def scores_by_key(spark, d):
    """A managed table that is created, filled and read for a few patients; the condition goes to its scan."""
    name = f"scores_{uuid.uuid4().hex}"
    wanted = _scores(spark, d)
    tables.ensure_table(spark, name, wanted.schema)
    wanted.write.insertInto(name)
    return files.read_table(spark, name, F.col("patient_id").isin(1, 2, 3, 5, 8, 13))


# Upkeep of tables --------------------------------------------------------------------------------


@query
def ensure_columns(spark, d):
    old = _patients(spark, d).drop("room_number", "home_address", "occupation")
    return _lists_as_text(tables.ensure_columns(old, PATIENTS))


@query
def insert_absent(spark, d):
    line = adapter.load(spark, d, "lineitem")
    arrivals = line.select(
        F.col("l_partkey").cast("int").alias("patient_id"),
        F.concat(F.lit("Arrival "), F.col("l_orderkey").cast("string")).alias("full_name"),
        "l_orderkey",
        "l_linenumber",
    )
    target = _patients(spark, d).select("patient_id", "full_name", "room_number")
    return tables.insert_absent(target, arrivals, "patient_id", ["l_orderkey", "l_linenumber"])


@query
def backfill_null(spark, d):
    orders = adapter.load(spark, d, "orders")
    updates = orders.select(
        F.col("o_custkey").cast("int").alias("patient_id"),
        F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("room_number"),
        "o_orderkey",
    )
    target = _patients(spark, d).select("patient_id", "room_number")
    return tables.backfill(target, updates, "patient_id", "room_number", "o_orderkey")


@query
def keyed_update(spark, d):
    orders = adapter.load(spark, d, "orders")
    updates = orders.select(
        F.col("o_custkey").cast("int").alias("patient_id"),
        F.concat(F.lit("Ward "), F.col("o_orderkey").cast("string")).alias("home_address"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("occupation"),
        "o_orderkey",
    )
    target = _patients(spark, d).select("patient_id", "full_name", "home_address", "occupation")
    return tables.overwrite_columns(
        target, updates, "patient_id", ["home_address", "occupation"], "o_orderkey"
    )


def _stored_update(spark: SparkSession, df: DataFrame, updates: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The table by key range, with the ranges that updates touch replaced."""
    path = work_folder(spark, "ranges") + "/table"
    stored.write_by_range(df, path, "patient_id", 100)
    stored.update_ranges(spark, path, updates, "patient_id", change, 100)
    return stored.read_by_range(spark, path)


def _orders(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    """Updates of every patient whose number lies in an even hundred."""
    patient = F.col("o_custkey").cast("int")
    wanted = adapter.load(spark, d, "orders").where(F.floor(patient / 100) % 2 == 0)
    return wanted.select(patient.alias("patient_id"), "o_orderkey", *columns)


@query
def stored_insert(spark, d):
    line = adapter.load(spark, d, "lineitem")
    name = F.concat(F.lit("Arrival "), F.col("l_orderkey").cast("string")).alias("full_name")
    arrivals = line.select(F.col("l_partkey").cast("int").alias("patient_id"), name, "l_orderkey", "l_linenumber")
    insert = lambda table, rows: tables.insert_absent(table, rows, "patient_id", ["l_orderkey", "l_linenumber"])
    return _stored_update(spark, _patients(spark, d).select("patient_id", "full_name", "room_number"), arrivals, insert)


@query
def stored_backfill(spark, d):
    updates = _orders(spark, d, F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("room_number"))
    fill = lambda table, rows: tables.backfill(table, rows, "patient_id", "room_number", "o_orderkey")
    return _stored_update(spark, _patients(spark, d).select("patient_id", "room_number"), updates, fill)


@query
def stored_update(spark, d):
    updates = _orders(
        spark, d, F.concat(F.lit("Ward "), F.col("o_orderkey").cast("string")).alias("home_address"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("occupation"),
    )
    update = lambda table, rows: tables.overwrite_columns(table, rows, "patient_id", ["home_address", "occupation"], "o_orderkey")
    return _stored_update(spark, _patients(spark, d).select("patient_id", "full_name", "home_address", "occupation"), updates, update)


@query
def arrivals_repeated(spark, d):
    """Customers of orders against a stored filter of the customers of every third number: who is there already, and who comes more than once."""
    table = _patients(spark, d).select("patient_id").where("patient_id % 3 = 0")
    bits = stored.filter_bits(table.count())
    path = work_folder(spark, "filter")
    stored.key_filter(table, ["patient_id"], bits).write.parquet(path)
    arrivals = adapter.load(spark, d, "orders").select(F.col("o_custkey").cast("int").alias("patient_id"))
    return stored.repeated_keys(arrivals, table, spark.read.parquet(path), ["patient_id"], bits)


@query
def quarantine_invalid(spark, d):
    """Readings above a level come from devices without a patient number; their rows are marked."""
    return tables.mark_valid(
        scoring.score_readings(_unnumbered(spark, d)), ["patient_id", "window_start", "news2_score"]
    )


@query
def apply_defaults(spark, d):
    bare = _patients(spark, d).select("patient_id", "full_name", "sex")
    filled = tables.apply_defaults(tables.ensure_columns(bare, PATIENTS), AS_OF)
    return _lists_as_text(filled)


@query
def duplicate_keys(spark, d):
    return tables.duplicate_keys(_readings(spark, d), ["patient_id", "vital_sign"])


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return adapter.load(spark, d, "customer").select(
        F.col("c_custkey").cast("int").alias("patient_id"),
        F.col("c_name").alias("full_name"),
        (20 + F.col("c_custkey") % 70).cast("int").alias("age"),
    )


@query
def cohort_dob(spark, d):
    return tables.replace_cohort(_cohort(spark, d), AS_OF)


@query
def cohort_replaced(spark, d):
    """A table of all patients, replaced by a cohort of every third."""
    path = work_folder(spark, "cohort") + "/patients"
    tables.overwrite_table(_patients(spark, d).select("patient_id", "full_name", "date_of_birth"), path)
    cohort = _cohort(spark, d).filter("patient_id % 3 = 0")
    tables.overwrite_table(tables.replace_cohort(cohort, AS_OF), path)
    return files.read_table(spark, path)


# Serving -----------------------------------------------------------------------------------------


@query
def latest_scores(spark, d):
    return latest.latest_scores(_scores(spark, d))


@query
def latest_scores_ranked(spark, d):
    return latest.latest_scores_ranked(_scores(spark, d))


@query
def latest_in_range(spark, d):
    """Newest scores of an id range, both ends included."""
    in_range = latest.in_id_range(_scores(spark, d), *ID_RANGE)
    newest = latest.latest_scores(in_range)
    return newest.select("patient_id", "news2_score", "risk_level", "window_start").orderBy(
        "patient_id"
    )


@query
def last_six_hours(spark, d):
    """The six-hour look-back. No window starts after its readings, so the condition may also go
    to the reading times, and from there to the file scan."""
    recent = latest.last_hours(_readings(spark, d), AS_OF, time_column="event_time")
    return latest.last_hours(scoring.score_readings(recent), AS_OF)


@query
def vitals_history(spark, d):
    return serving.vitals_history(_scores(spark, d))


@query
def history_json(spark, d):
    return files.to_json_rows(serving.to_celsius(_scores(spark, d)))


@query
def active_patients(spark, d):
    return serving.active_patients(_scores(spark, d), _patients(spark, d))


@query
def ward_cards(spark, d):
    return serving.ward_cards(active_patients(spark, d))


@query
def roster(spark, d):
    return serving.roster(active_patients(spark, d))


@query
def needs_review(spark, d):
    return serving.needs_review(latest.latest_scores(_mild(spark, d)))


def _profiles(spark, d):
    ids = adapter.load(spark, d, "part").select(F.col("p_partkey").cast("int").alias("patient_id"))
    return serving.patient_profile(_patients(spark, d), ids)


@query
def patient_profile(spark, d):
    return _lists_as_text(_profiles(spark, d))


@query
def profile_json(spark, d):
    return serving.profile_json(_profiles(spark, d))


@query
def patient_background(spark, d):
    return serving.patient_background(_patients(spark, d))


@query
def patient_age(spark, d):
    age = age_years(F.col("date_of_birth"), AS_OF)
    return _patients(spark, d).select("patient_id", age.alias("age"))


@query
def patient_context(spark, d):
    context = profile_context(
        F.col("past_medical_conditions"), F.col("medical_history"), F.col("current_medications")
    )
    return _patients(spark, d).select(
        "patient_id",
        context.alias("context"),
        has_term(context, "copd", "asthma").alias("has_airway_disease"),
        has_term(context, "Smok", "pneumonia").alias("has_lung_risk"),
        has_term(context, "heart failure").alias("has_heart_failure"),
    )


# Assessment --------------------------------------------------------------------------------------


@query
def unpivot_vitals(spark, d):
    return assess.unpivot_vitals(_daily(spark, d))


@query
def vital_catalogue_join(spark, d):
    return assess.vital_catalogue_join(_readings(spark, d))


@query
def trend(spark, d):
    return assess.trends(_history(spark, d))


@query
def vital_coverage(spark, d):
    return assess.vital_coverage(_history(spark, d))


@query
def axis_domain(spark, d):
    return assess.axis_domain(_history(spark, d))


@query
def assessments(spark, d):
    return _long(spark, d)


@query
def abnormal_vitals(spark, d):
    return assess.abnormal_vitals(_long(spark, d)).select(
        "patient_id", "vital_sign", "value", "score", "severity", "problem"
    )


@query
def abnormal_summary(spark, d):
    return assess.abnormal_summary(_assessed(spark, d))


@query
def likely_causes(spark, d):
    return assess.likely_causes(_daily(spark, d), _patients(spark, d), AS_OF, LOOK_BACK)


@query
def vital_cards(spark, d):
    return assess.vital_cards(_assessed(spark, d))


CUT_LOOK_BACK = 500


def _partial_summary(spark: SparkSession, d: str) -> DataFrame:
    """Daily partials stored in two steps, and a look-back that begins within a day."""
    path = work_folder(spark, "partials")
    scores = _scores(spark, d)
    later = F.col("patient_id") % 4 == 0
    partials.write_partials(partials.daily_partials(scores.where(~later)), path)
    partials.add_scores(spark, path, scores.where(later))
    return partials.look_back(partials.read_partials(spark, path), scores, AS_OF, CUT_LOOK_BACK)


@query
def partial_trend(spark, d):
    return assess.trends_of(_partial_summary(spark, d))


@query
def partial_axis_domain(spark, d):
    return assess.axis_domain_of(_partial_summary(spark, d))


@query
def partial_coverage(spark, d):
    return assess.vital_coverage_of(_partial_summary(spark, d))


@query
def bucketed_assessments(spark, d):
    """Assessments from score and patient tables in buckets by patient: neither side moves."""
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("scores", "patients")]
    for name, df in zip(names, (_daily(spark, d), _patients(spark, d)), strict=True):
        stored.write_bucketed(df, name, "patient_id", 8)
    return assess.assessments(spark.table(names[0]), spark.table(names[1]), AS_OF, LOOK_BACK)


# Reports -----------------------------------------------------------------------------------------


@query
def split_problem(spark, d):
    return narrative.split_problems(assess.abnormal_vitals(_long(spark, d))).select(
        "patient_id", "vital_sign", "medical", "plain"
    )


@query
def unique_causes(spark, d):
    return narrative.unique_causes(_assessed(spark, d))


@query
def medical_narrative(spark, d):
    return narrative.medical_narrative(_assessed(spark, d))


@query
def plain_english(spark, d):
    return narrative.plain_english(_assessed(spark, d))


@query
def active_problems(spark, d):
    return narrative.active_problems(_assessed(spark, d))


@query
def vitals_text_lines(spark, d):
    return narrative.vitals_text_lines(_scores(spark, d), AS_OF, LOOK_BACK).select(
        "patient_id", "window_start", "line"
    )


@query
def vitals_text_table(spark, d):
    return narrative.vitals_text_table(_daily(spark, d), AS_OF, LOOK_BACK)


@query
def clinical_prompts(spark, d):
    return narrative.clinical_prompts(_daily(spark, d), _patients(spark, d), AS_OF, LOOK_BACK)


@query
def review_prompts(spark, d):
    return narrative.review_prompts(_mild(spark, d), _patients(spark, d), AS_OF, LOOK_BACK)


# Checks ------------------------------------------------------------------------------------------


@query
def scenario_check(spark, d):
    return checks.scenario_check(_mild(spark, d), _expectations(spark, d))


@query
def missing_scores(spark, d):
    return checks.missing_scores(_scores(spark, d), _expectations(spark, d))


@query
def scenario_check_summary(spark, d):
    return checks.check_summary(scenario_check(spark, d))
