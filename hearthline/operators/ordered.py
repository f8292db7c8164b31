"""Ordered results: files written in a total order, and each row's position read back from them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.session import checkpoint_dir, cut_lineage


def write_ordered(df: DataFrame, path: str, order: Sequence[Column | str], tables: Sequence[str] = ()) -> None:
    """Write rows in order: range partitions by ``order``, sorted files, one folder per value of ``tables``.

    ``order`` should end with a key: rows that are equal in it stand in any order and in one task.
    """
    df.orderBy(*tables, *order).write.mode("overwrite").partitionBy(*tables).parquet(path)


def read_positions(spark: SparkSession, path: str, tables: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Rows of ``write_ordered`` with their 0-based position within their table.

    A row's place in its file is known to the scan; only the number of rows of each file is added up, files going by
    their number. That table of files is written, so its join is a broadcast only where its size allows.
    """
    file = F.col("_metadata.file_path")
    number = lambda pattern: F.regexp_extract(F.element_at(F.split("_file", "/"), -1), pattern, 1).try_cast("long")
    rows = spark.read.parquet(path).select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy(*tables, "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*tables).orderBy(number("^part-([0-9]+)"), number("[.]c([0-9]+)"), "_file").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return rows.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def positions(df: DataFrame, order: Sequence[Column | str], tables: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based position in ``order`` within its table; rows are written once in between."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ordered/{uuid.uuid4().hex}"
    write_ordered(df, path, order, tables)
    return read_positions(df.sparkSession, path, tables, name).select(*df.columns, name)
