"""Positions within groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], coarse: list[str], order: list[str]) -> DataFrame:
    """Add ``position`` (from 1) within ``keys`` by ``coarse`` and then ``order``.

    Rows are numbered inside ``keys + coarse`` only, and shifted by the number of rows
    that come before, which is a running sum over counts. So one hot group is spread
    over as many tasks as it has coarse values.
    """
    counts = df.groupBy(*keys, *coarse).agg(F.count("*").alias("_n"))
    ahead = (
        Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    ).drop("_n")
    local = Window.partitionBy(*keys, *coarse).orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, *coarse])
        .withColumn("position", (F.col("_offset") + F.col("_local")).cast("int"))
        .drop("_offset", "_local")
    )


def first_of_each(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark cuts each task to ``n`` before it shuffles."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(at)).filter(F.col("position") <= n)
