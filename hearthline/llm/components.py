"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthline.llm.files import saved


def large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of long nodes -> (u, v): every node with an edge and its smallest reachable node.

    Roots themselves have no row. Edge rows with a null end or two equal ends are ignored. Each round
    is a written table; rounds grow with the square of the logarithm of a component at most.
    """
    now = saved(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = saved(small_star(large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
    ).first())
