"""Window-shaped operators that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key. Spark limits each map task to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rn"
) -> DataFrame:
    """The first ``n`` rows per key; map tasks keep at most ``n`` rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_of: Column,
    name: str = "previous",
) -> DataFrame:
    """``value`` of the row before, per key.

    The rows of a key are cut into order-preserving slices (``slice_of``), so a key with a third
    of the rows is spread over many tasks. Only the last value of each slice travels between
    slices.
    """
    sliced = df.withColumn("_slice", slice_of)
    inner = sliced.withColumn(
        "_inside",
        F.lag(F.struct(value)).over(Window.partitionBy(*keys, "_slice").orderBy(*order)),
    )
    ends = sliced.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("_last")
    )
    carry = ends.select(
        *keys, "_slice",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
    )
    return (
        inner.join(carry, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce(F.col("_inside"), F.col("_carried"))[value])
        .drop("_slice", "_inside", "_carried")
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_of: Column, name: str = "position"
) -> DataFrame:
    """0-based position per key, computed slice by slice: offset of the slice + rank inside it."""
    sliced = df.withColumn("_slice", slice_of)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
        .drop("_slice", "_rn", "_offset")
    )


def fixed_batches(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, slice_of: Column
) -> DataFrame:
    """Batch number and index in the batch, within each key."""
    return (
        numbered(df, keys, order, slice_of, "_pos")
        .withColumn("batch_no", F.floor(F.col("_pos") / size).cast("bigint"))
        .withColumn("idx", (F.col("_pos") % size).cast("bigint"))
        .drop("_pos")
    )
