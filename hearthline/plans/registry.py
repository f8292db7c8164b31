"""Registry of the runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from hearthline.session import tune
from hearthline.sources.tables import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "valuation", "filters", "texts", "scalars", "scores", "state", "resolve", "tracker",
    "alerts", "feeds", "pages", "streams",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views obs, listings, deals, history, texts, posts."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def half_even_sql(value: str, digits: int) -> str:
    """Check-SQL twin of ``half_even``: exact ties in units of 10^-(digits+4)."""
    return (
        f"list_transform([round(({value}) * 1e{digits + 4})::BIGINT], lambda v: "
        f"((v - ((v % 10000) + 10000) % 10000) // 10000 + CASE WHEN ((v % 10000) + 10000) % 10000 > 5000 "
        f"OR (((v % 10000) + 10000) % 10000 = 5000 AND ((v - ((v % 10000) + 10000) % 10000) // 10000) % 2 <> 0) "
        f"THEN 1 ELSE 0 END) / 1e{digits})[1]"
    )


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        import_module(f"hearthline.plans.queries_{module}")
    return QUERIES, ORACLES
