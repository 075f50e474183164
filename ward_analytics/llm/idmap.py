"""Documents by id without a shuffle of their texts: a bit map of fixed size sent to all tasks.

The map misses no id that is asked for and may let others pass, the more the fuller it is; an exact join over what passes follows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB.
MAP_BITS = 26


def bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2**MAP_BITS))


def bit_map(ids: DataFrame) -> np.ndarray:
    """The bits of all ids in the column doc_id, as 64-bit words."""
    words = (
        ids.select(bit("doc_id").alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toPandas()
    )
    out = np.zeros(2 ** (MAP_BITS - 6), np.int64)
    out[words["word"]] = words["bits"]
    return out.view(np.uint64)


def among(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (words[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def without(documents: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows whose id isn't among the ids (column doc_id, read twice). Rows without id stay."""
    sent = documents.sparkSession.sparkContext.broadcast(bit_map(ids))

    @F.pandas_udf("boolean")
    def maybe(bits: pd.Series) -> pd.Series:
        return pd.Series(among(bits.to_numpy(np.int64), sent.value))

    packed = documents.select(F.struct(*documents.columns).alias("row"), F.col(doc_id).alias("id"))
    marked = packed.withColumn("maybe", F.col("id").isNotNull() & maybe(F.coalesce(bit("id"), F.lit(0))))
    gone = ids.select(F.col("doc_id").alias("id")).distinct()
    left = marked.where("maybe").join(gone, "id", "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(left.select("row.*"))
