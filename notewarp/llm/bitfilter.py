"""A filter of fixed size over hashed ids, to keep rows that a join would drop out of its shuffle.

It only saves work: rows whose bit is set by another id still meet the exact join. Its size does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value

by_value(__name__)

BITS = 1 << 22


def build(ids: DataFrame, column: str) -> np.ndarray:
    """The packed bits of a column of uniformly hashed longs; at most BITS small integers reach the driver."""
    at = ids.select(F.col(column).bitwiseAND(F.lit(BITS - 1)).cast("int").alias("at")).distinct().toPandas()["at"]
    bits = np.zeros(BITS, np.uint8)
    bits[at.to_numpy(np.int64)] = 1
    return np.packbits(bits)


def hit(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & (BITS - 1)
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)


def rows(bits: np.ndarray, column: str):
    """For mapInArrow: the rows whose ``column`` hits."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(hit(bits, batch[column].to_numpy(zero_copy_only=False).astype(np.int64))))

    return run


def parted(table: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``table`` in two, by DataFrame operations only: the rows whose ``column`` may be in ``ids`` (of the same column name), and those whose is not.

    The column has uniformly hashed longs. The bits are longs beside the number of their word, at most BITS / 64 rows, so they are broadcast.
    """
    word = F.col(column).bitwiseAND(F.lit(BITS // 64 - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(column, 58).cast("int"))
    words = F.broadcast(ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    both = table.join(words, word == F.col("_word"), "left").withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
    return tuple(both.where(x).drop("_word", "_bits", "_may") for x in (F.col("_may"), ~F.col("_may")))
