"""The given tables in the shape of the ward: ``events`` as readings, ``customer`` as patients.

Values have two decimals, as bedside devices send them (cut, not rounded).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ward_analytics.functions.numeric import band_column

#: Columns of the given tables. Fixed schemas save the job that would read one from a file.
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

# event type -> (vital sign, lowest value, span of values); temperature in °F
EVENT_VITALS = {
    "click": ("heart_rate", 35, 115),
    "view": ("respiratory_rate", 6, 26),
    "purchase": ("spo2", 86, 14),
    "error": ("systolic_bp", 80, 150),
    "signup": ("temperature", 94, 12),
}


@lru_cache(maxsize=256)
def _check_columns(session: str, path: str, table: str) -> None:
    """A fixed schema would read a renamed column as null; each table's own names are looked at once a session."""
    there = SparkSession.active().read.parquet(path).columns
    missing = [c for c in StructType.fromDDL(TABLES[table]).names if c not in there]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    _check_columns(spark.sparkContext.applicationId, path, table)
    return spark.read.schema(TABLES[table]).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files; the glob takes a single file as well as a folder."""
    return spark.readStream.schema(TABLES["events"]).parquet(f"{sf_dir}/events.parquet*")


def _reading_columns() -> tuple[Column, Column]:
    kind = F.col("event_type")
    vital = band_column([(kind == e, v) for e, (v, _, _) in EVENT_VITALS.items()], None)
    raw = band_column(
        [(kind == e, lo + F.col("value") % span) for e, (_, lo, span) in EVENT_VITALS.items()],
        None,
    )
    return vital, F.floor(raw * 100) / 100


def readings(events: DataFrame) -> DataFrame:
    """Decoded readings: ``patient_id, event_time, vital_sign, value``."""
    vital, value = _reading_columns()
    return events.select(
        F.col("user_id").alias("patient_id"),
        F.col("ts").alias("event_time"),
        vital.alias("vital_sign"),
        value.alias("value"),
    )


def raw_readings(events: DataFrame) -> DataFrame:
    """Readings as they arrive: texts but for the value."""
    return readings(events).select(
        F.col("patient_id").cast("string").alias("patient_id"),
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "vital_sign",
        "value",
    )


def _texts(*items: str) -> Column:
    return F.array(*(F.lit(i) for i in items)).cast("array<string>")


def patients(customer: DataFrame) -> DataFrame:
    """Patient records with every term the cause lists look for, and with gaps."""
    key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    group, half = nation % 5, key % 4
    room = F.concat(F.substring(segment, 1, 2), F.lit("-"), (key % 40).cast("string"))
    born = F.date_add(F.lit("1930-01-01").cast("date"), (key * 37 % 25000).cast("int"))
    return customer.select(
        key.cast("int").alias("patient_id"),
        F.col("c_name").alias("full_name"),
        F.when(segment != "HOUSEHOLD", room).alias("room_number"),
        F.when(key % 13 != 0, born).alias("date_of_birth"),
        F.when(key % 11 != 0, F.when(key % 2 == 0, "F").otherwise("M")).alias("sex"),
        band_column(
            [(nation % 3 == 0, _texts()), (nation % 3 == 1, _texts("Penicillin — anaphylaxis"))],
            _texts("Latex — contact dermatitis", "Aspirin — GI bleed"),
        ).alias("allergies"),
        band_column(
            [
                (group == 0, _texts()),
                (group == 1, _texts("COPD", "Asthma")),
                (group == 2, _texts("Coronary artery disease", "Heart failure")),
                (group == 3, _texts("Hypertension", "Type 2 diabetes")),
            ],
            _texts("Asthma"),
        ).alias("past_medical_conditions"),
        band_column(
            [
                (half == 1, "Former smoker. CABG 2019."),
                (half == 2, "Prior stay for pneumonia."),
                (half == 3, "No prior stays."),
            ],
            None,
        ).alias("medical_history"),
        band_column(
            [
                (half == 0, _texts()),
                (half == 1, _texts("Carvedilol 6.25mg BD", "Furosemide 40mg OD")),
                (half == 2, _texts("Beta blocker", "Metformin 500mg BD")),
            ],
            _texts("Thiazide diuretic"),
        ).alias("current_medications"),
        F.when(nation % 2 == 0, F.concat(F.lit("Street "), nation.cast("string"))).alias(
            "home_address"
        ),
        F.when(segment != "MACHINERY", F.lower(segment)).alias("occupation"),
        (
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(mins=(key % 1000).cast("int"))
        ).alias("updated_at"),
    )


def expectations(customer: DataFrame) -> DataFrame:
    """An expected risk and score range for every patient."""
    key = F.col("c_custkey")
    risk = band_column([(key % 3 == 0, "LOW"), (key % 3 == 1, "MEDIUM")], "HIGH")
    return customer.select(
        key.cast("int").alias("patient_id"),
        F.col("c_name").alias("scenario"),
        risk.alias("risk_level"),
        F.when(key % 3 == 2, 7).when(key % 6 == 1, 5).cast("int").alias("min_score"),
        F.when(key % 3 == 0, 4).when(key % 6 == 1, 6).cast("int").alias("max_score"),
    )
