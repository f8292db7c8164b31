"""Spatial tiling of a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Box = tuple[float, float, float, float]  # lat_min, lon_min, lat_max, lon_max


def grid_tiles(spark: SparkSession, box: Box, n: int) -> DataFrame:
    """The n x n tiles of a box."""
    lat0, lon0, lat1, lon1 = box
    dlat, dlon = (lat1 - lat0) / n, (lon1 - lon0) / n
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    return spark.range(n * n).select(
        i.cast("int").alias("tile_i"), j.cast("int").alias("tile_j"),
        (F.lit(lat0) + i * dlat).alias("lat_min"), (F.lit(lon0) + j * dlon).alias("lon_min"),
        (F.lit(lat0) + (i + 1) * dlat).alias("lat_max"), (F.lit(lon0) + (j + 1) * dlon).alias("lon_max"),
    )


def assign_tile(lat: Column, lon: Column, box: Box, n: int) -> tuple[Column, Column]:
    """Tile of a point by arithmetic; the outer edge belongs to the last tile, NULL outside."""
    lat0, lon0, lat1, lon1 = box
    inside = lat.between(lat0, lat1) & lon.between(lon0, lon1)
    cell = lambda v, lo, hi: F.least(F.floor((v - lo) / ((hi - lo) / n)).cast("int"), F.lit(n - 1))
    return F.when(inside, cell(lat, lat0, lat1)), F.when(inside, cell(lon, lon0, lon1))


def tile_counts(df: DataFrame, box: Box, n: int, marker_cap: int = 200) -> DataFrame:
    """Points per tile and whether the tile exceeds what one call returns."""
    i, j = assign_tile(F.col("lat"), F.col("lon"), box, n)
    return (
        df.withColumns({"tile_i": i, "tile_j": j}).filter(F.col("tile_i").isNotNull())
        .groupBy("tile_i", "tile_j").agg(F.count(F.lit(1)).alias("markers"))
        .withColumn("over_cap", F.col("markers") > marker_cap)
    )
