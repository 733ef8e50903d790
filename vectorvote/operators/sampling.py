"""Reservoir sampling in parallel: the sample of the sequential algorithm, from a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.random import bounded_column
from .order import numbered


def reservoir(df: DataFrame, size: int, seed: int, order: str) -> DataFrame:
    """The rows that a sequential reservoir of `size` holds after all rows in the order of a column, with their slot.

    Row i >= size draws a slot among i + 1 with the (i - size + 1)-th number of the generator and replaces what is there if the
    slot exists.  So slot j ends with the last row that drew j, or else with row j.
    """
    rows = numbered(df, order)
    draw = bounded_column(seed, F.col("place") - size + 1, F.col("place") + 1)
    slot = F.when(F.col("place") < size, F.col("place")).otherwise(draw)
    claims = rows.withColumn("slot", slot).where(F.col("slot") < size)
    last = claims.groupBy("slot").agg(F.max("place").alias("place"))
    return rows.join(last, "place").drop("place")
