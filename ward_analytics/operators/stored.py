"""Stored tables that are kept up in place: by key range, by bucket, and with a filter of their keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of one partition of a table by key range.
RANGE = 4096
RANGE_COLUMN = "key_range"


def key_range(key: str, size: int = RANGE) -> Column:
    return F.floor(F.col(key) / size).cast("long")


def write_by_range(df: DataFrame, path: str, key: str, size: int = RANGE) -> None:
    """A folder per range of an integer key. Ranges that are written anew are replaced, others keep their files.

    A small folder costs its opening and closing, whatever it holds: ranges are dealt to tasks by number, where a deal by bytes gives all folders of
    a small table to one task. Rows without a key share a folder but not a task."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    nowhere = F.when(F.col(key).isNull(), F.spark_partition_id())
    (
        df.withColumn(RANGE_COLUMN, key_range(key, size)).repartition(tasks, RANGE_COLUMN, nowhere).sortWithinPartitions(RANGE_COLUMN, key)
        .write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(RANGE_COLUMN).parquet(path)
    )


def read_by_range(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(RANGE_COLUMN)


def update_ranges(
    spark: SparkSession, path: str, updates: DataFrame, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], size: int = RANGE
) -> list[int]:
    """Apply ``change(table, updates)`` to the ranges in which updates lie, and replace those; the ranges. Neither the rows nor the files of others are
    read. ``change`` works key by key, like the updates of ``operators.tables``; updates without a key are left out. Doing it again with
    the same updates gives the same table if ``change`` does. Readers see each range old or new once its folder is moved."""
    keyed = updates.where(F.col(key).isNotNull())
    touched = sorted(r[0] for r in keyed.select(key_range(key, size)).distinct().collect())  # folders, not keys
    if touched:
        here = spark.read.parquet(path).where(F.col(RANGE_COLUMN).isin(*touched))
        write_by_range(change(here.drop(RANGE_COLUMN), keyed), path, key, size)
    return touched


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A managed table dealt by a hash of the key and sorted by it: joins and aggregations by the key with a table of as many buckets move no rows."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


# A filter of keys ---------------------------------------------------------------------------------

#: Bits per key: about one stranger in ten passes.
BITS_PER_KEY = 10


def _bit(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def key_filter(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """A bitmap over the hashes of the keys, in rows of 4 KB: ``bucket, bitmap``. Bitmaps of more rows merge by ``merge_filters``."""
    bit = _bit(keys, bits)
    return (
        rows.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    )


def merge_filters(*filters: DataFrame) -> DataFrame:
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def filter_bits(n_keys: int) -> int:
    """Bits for a table of that many keys, with room to double."""
    return max(32_768, 1 << (2 * n_keys * BITS_PER_KEY - 1).bit_length())


def passing(arrivals: DataFrame, stored: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The arrivals whose key may be in the table: all that are, and a few that are not. Spark sends the filter to all tasks where it is small enough for
    that, and the arrivals stay where they are; else both go by bucket."""
    bit = _bit(keys, bits)
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = arrivals.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).join(
        stored.withColumnRenamed("bucket", "_bucket"), "_bucket"
    )
    return found.withColumn("_byte", byte).where("shiftright(_byte, cast(_at % 8 as int)) & 1 = 1").select(*arrivals.columns)


def repeated_keys(arrivals: DataFrame, table: DataFrame, stored: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Keys of arrivals that the table has already, or that arrive more than once: ``keys, n_arrived, in_table``. Only arrivals that pass the filter meet
    the table. A key with a null is in no table, but may arrive twice."""
    counted = arrivals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_arrived"))
    whole = arrivals.select(*keys).dropna(subset=keys)
    known = passing(whole, stored, keys, bits).distinct().join(table.select(*keys), keys, "left_semi").withColumn("in_table", F.lit(True))
    twice = counted.where("n_arrived > 1").withColumn("in_table", F.lit(False))
    once = known.join(counted, keys).select(*keys, "n_arrived", "in_table")
    return once.unionByName(twice.join(known.select(*keys), keys, "left_anti"))
