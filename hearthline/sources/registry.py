"""Extension points: feeds and deal providers (M1, M2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeedSpec:
    """One listing source: raw pages -> canonical rows, and its order of reject rules."""

    name: str
    parse: Callable[[DataFrame], DataFrame]
    details: Callable[[DataFrame], DataFrame] | None = None
    rule_order: list[str] = field(default_factory=list)
    always_enrich: bool = False
    detail_rules: dict[str, str] | None = None


@dataclass(frozen=True)
class DealSpec:
    """One provider of closed deals: raw pages -> deal rows."""

    name: str
    parse: Callable[[DataFrame], DataFrame]


FEEDS: dict[str, FeedSpec] = {}
DEALS: dict[str, DealSpec] = {}


def register_feed(spec: FeedSpec) -> FeedSpec:
    if spec.name in FEEDS:
        raise ValueError(f"feed {spec.name!r} is registered twice")
    FEEDS[spec.name] = spec
    return spec


def register_deals(spec: DealSpec) -> DealSpec:
    if spec.name in DEALS:
        raise ValueError(f"deal provider {spec.name!r} is registered twice")
    DEALS[spec.name] = spec
    return spec
