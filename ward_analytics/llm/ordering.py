"""Places of rows in an order, group by group, without any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ward_analytics.llm.tables import cut


def placed(rows: DataFrame, group: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """Adds ``place``, the weight (rows, if none is given) that comes before a row in its group, and ``n``, the weight of the group.

    Rows are dealt by ranges of group and order, so that a large group lies in many ranges; each range adds what the ranges before it hold of
    its group. The group's columns must not be null; in the order a null comes first. Rows that are equal in group and order
    take places one after another by where they are stored, and may lie in different ranges, so ``rows`` must come from storage
    (a table or a checkpoint): only there does a task that is run again see them at the same place. An empty table stays empty.
    """
    ranged = cut(
        rows.withColumns({"_weight": F.lit(1).cast("long") if weight is None else weight, "_row": F.monotonically_increasing_id()})
        .repartitionByRange(*group, *order, "_row")
        .withColumn("_part", F.spark_partition_id())
    )
    key = ["_part", *group]
    slices = ranged.groupBy(*key).agg(F.sum("_weight").alias("_slice"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*key, F.coalesce(F.sum("_slice").over(earlier), F.lit(0)).alias("_before"), F.sum("_slice").over(whole).alias("n"))
    inside = Window.partitionBy(*key).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.col("_before") + F.sum("_weight").over(inside) - F.col("_weight")
    return ranged.join(slices, key).withColumn("place", place).drop("_part", "_row", "_before", "_weight")
