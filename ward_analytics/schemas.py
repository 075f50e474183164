"""Fixed schemas. Table times carry no zone; only the stream, which needs one for its
watermark, works on zoned timestamps."""

from __future__ import annotations

from pyspark.sql import types as T

from ward_analytics.catalogue import VITALS

READING = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("vital_sign", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

SCORES = T.StructType(
    [
        T.StructField("patient_id", T.IntegerType(), False),
        T.StructField("window_start", T.TimestampNTZType(), False),
        T.StructField("news2_score", T.IntegerType(), False),
        T.StructField("risk_level", T.StringType(), False),
    ]
    + [T.StructField(v, T.DoubleType()) for v in VITALS]
    + [T.StructField("created_at", T.TimestampNTZType(), False)]
)

_TEXTS = T.ArrayType(T.StringType(), containsNull=False)

PATIENTS = T.StructType([
    T.StructField("patient_id", T.IntegerType(), False),
    T.StructField("full_name", T.StringType(), False),
    T.StructField("room_number", T.StringType()),
    T.StructField("date_of_birth", T.DateType()),
    T.StructField("sex", T.StringType()),
    T.StructField("allergies", _TEXTS, False),
    T.StructField("past_medical_conditions", _TEXTS, False),
    T.StructField("medical_history", T.StringType()),
    T.StructField("current_medications", _TEXTS, False),
    T.StructField("home_address", T.StringType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

EXPECTATIONS = T.StructType([
    T.StructField("patient_id", T.IntegerType(), False),
    T.StructField("scenario", T.StringType(), False),
    T.StructField("risk_level", T.StringType(), False),
    T.StructField("min_score", T.IntegerType()),
    T.StructField("max_score", T.IntegerType()),
])


def required(schema: T.StructType) -> list[str]:
    """Names of the columns that may not be null."""
    return [f.name for f in schema if not f.nullable]


def as_nullable(schema: T.StructType) -> T.StructType:
    """The same columns, all nullable: what a file or a stream can promise."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])
