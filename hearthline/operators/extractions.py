"""Results of an external extractor, applied to listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hearthline import lexicons as lx
from hearthline.functions.numeric import bounded_cast


def zip_results(rows: DataFrame, results: DataFrame, batch_keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Join results by position; ``accepted`` is false for a whole batch whose sizes differ.

    Batches have a fixed small size, so the window per batch is bounded.
    """
    per_batch = Window.partitionBy(*batch_keys)
    sized = rows.withColumn("_rows", F.count(F.lit(1)).over(per_batch))
    values = [n for n in results.columns if n not in (*batch_keys, idx)]
    named = results.withColumn("_results", F.count(F.lit(1)).over(per_batch)).select(
        *batch_keys, idx, "_results", *[F.col(n).alias(f"ext_{n}") for n in values]
    )
    return (
        sized.join(named, [*batch_keys, idx], "left")
        .withColumn("accepted", F.coalesce(F.col("_rows") == F.col("_results"), F.lit(False)))
        .drop("_rows", "_results")
    )


def apply_extractions(zipped: DataFrame, bounds: dict | None = None) -> DataFrame:
    """Fill NULL fields from accepted results: numbers within their bounds, flags as given."""
    out = zipped
    for name in [*lx.NUMBER_BOUNDS, *lx.EXTRACTED_FLAGS]:
        if f"ext_{name}" not in zipped.columns or name not in zipped.columns:
            continue
        value = F.col(f"ext_{name}")
        if name in lx.NUMBER_BOUNDS:
            value = bounded_cast(value, name, bounds)
        out = out.withColumn(name, F.coalesce(F.col(name), F.when(F.col("accepted"), value)))
    return out.drop(*[n for n in out.columns if n.startswith("ext_")])
