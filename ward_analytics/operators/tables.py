"""Upkeep of the score and patient tables.

Joins carry no broadcast hint: updates may be as large as the table, and Spark broadcasts by
itself a side it measures below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ward_analytics.functions.numeric import at_time


def ensure_table(
    spark: SparkSession, name: str, schema: T.StructType, partition_by: Sequence[str] = ()
) -> None:
    """Create the table unless it is there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    layout = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{layout}")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns that are missing, filled with null; applying it twice changes nothing."""
    missing = [f for f in schema if f.name not in df.columns]
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in missing))


def _in_order(ordinal: Sequence[str]) -> Column:
    """Ordinals as a value that sorts a missing one last."""
    return F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in ordinal))


def _first_per_key(rows: DataFrame, key: str, ordinal: Sequence[str]) -> DataFrame:
    """The first row of each key by the ordinal columns. ``min`` keeps one row per key and task
    before the shuffle, so a key with many copies stays cheap. Texts in the row make this a sorted aggregation; to find the ordinals
    first and join back would read and shuffle the rows twice."""
    rest = [c for c in rows.columns if c != key and c not in ordinal]
    first = F.min(F.struct(_in_order(ordinal), *ordinal, *rest)).alias("_first")
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(first)
    return found.select(key, *(F.col(f"_first.{c}").alias(c) for c in (*ordinal, *rest))).select(*rows.columns)


def insert_absent(
    target: DataFrame, rows: DataFrame, key: str, ordinal: Sequence[str]
) -> DataFrame:
    """The target plus the rows with new keys. Rows already there win, then the first new one by
    ``ordinal``, whose columns are left out of the result unless the target has them. A row without a key isn't inserted."""
    new = _first_per_key(rows, key, ordinal).join(target.select(key), key, "left_anti")
    extra = [c for c in ordinal if c not in target.columns]
    return target.unionByName(new.drop(*extra), allowMissingColumns=True)


def backfill(target: DataFrame, updates: DataFrame, key: str, col: str, ordinal: str) -> DataFrame:
    """Set ``col`` only where it is null; the number of rows stays. Several updates of a key apply in the order of
    ``ordinal``, so the first value that is not null stays; one without ordinal comes last, equal ones go by value."""
    known = updates.filter(F.col(col).isNotNull() & F.col(key).isNotNull())
    order = F.struct(F.col(ordinal).isNull(), F.col(ordinal), F.col(col))
    new = known.groupBy(key).agg(F.min_by(col, order).alias("_new"))
    joined = target.join(new, key, "left").withColumn(col, F.coalesce(F.col(col), F.col("_new")))
    return joined.select(*target.columns)


def overwrite_columns(
    target: DataFrame, updates: DataFrame, key: str, cols: Sequence[str], ordinal: str
) -> DataFrame:
    """Set ``cols`` of matching rows, to null too where the update says so; the number of rows stays. Of several updates of
    a key the last one by ``ordinal`` stays; one without ordinal counts as the earliest, of equal ones the greater values stay."""
    values = F.struct(*(F.col(c).alias(c) for c in cols))
    order = F.struct(F.col(ordinal).isNotNull(), F.col(ordinal), values)
    new = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(values, order).alias("_new"))
    joined = target.join(new, key, "left")
    set_column = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c))
    return joined.select(*(set_column(c).alias(c) if c in cols else c for c in target.columns))


def valid_rows(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def mark_valid(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add ``status``: one pass where both parts are wanted, also as the partitions of a write."""
    status = F.when(valid_rows(required), "valid").otherwise("rejected")
    return df.withColumn("status", status)


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every required column, the others)."""
    valid = valid_rows(required)
    return df.filter(valid), df.filter(~valid)


def apply_defaults(df: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    """Creation and update times default to ``as_of``, arrays to empty ones."""
    result = {}
    for f in df.schema:
        if f.name in ("created_at", "updated_at"):
            result[f.name] = F.coalesce(F.col(f.name), at_time(as_of))
        elif isinstance(f.dataType, T.ArrayType):
            result[f.name] = F.coalesce(F.col(f.name), F.array().cast(f.dataType))
    return df.withColumns(result)


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def replace_cohort(rows: DataFrame, as_of: date | str) -> DataFrame:
    """Patients given by age: the date of birth lies 365 days per year before ``as_of``."""
    today = F.lit(str(as_of)[:10]).cast("date")
    born = F.date_sub(today, (F.col("age") * 365).cast("int"))
    return rows.withColumn("date_of_birth", born).drop("age")


def overwrite_table(df: DataFrame, path: str) -> None:
    """Replace all rows of the table at a path, which ``df`` itself must not read from."""
    df.write.mode("overwrite").parquet(path)
