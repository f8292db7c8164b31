"""Effective values, distances, percentages and bounded casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline import lexicons as lx


def half_even(c: Column, digits: int) -> Column:
    """Round half to even; the inner rounding removes floating-point noise at ties."""
    return F.bround(F.round(c, digits + 4), digits)


def effective(user: Column, scraped: Column, *fallback: Column) -> Column:
    """User override, else the scraped value, else a fallback column."""
    return F.coalesce(user, scraped, *fallback)


def price_per_area(price: Column, area: Column, stored: Column | None = None) -> Column:
    """Half-even rounded price per unit of area; the stored value when it cannot be computed."""
    ratio = F.bround(price.cast("double") / F.when(area > 0, area).cast("double")).cast("bigint")
    value = F.when(price != 0, ratio)
    return value if stored is None else F.coalesce(value, stored)


def effective_values(prefix_user: str = "_user") -> dict[str, Column]:
    """The seven derived columns of a listing row (E-M1)."""
    c = F.col
    built = effective(c(f"sqm_build{prefix_user}"), c("sqm_build"), c("sqm"))
    return {
        "rooms_eff": effective(c(f"rooms{prefix_user}"), c("rooms")),
        "sqm_eff": effective(c(f"sqm{prefix_user}"), c("sqm")),
        "sqm_build_eff": built,
        "units_count_eff": effective(c(f"units_count{prefix_user}"), c("units_count")),
        "garden_sqm_eff": effective(c(f"garden_sqm{prefix_user}"), c("garden_sqm")),
        "lot_sqm_eff": effective(c(f"lot_sqm{prefix_user}"), c("lot_sqm")),
        "price_per_sqm_eff": price_per_area(c("price"), built, c("price_per_sqm")),
    }


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = (
        F.pow(F.sin(dphi / 2), F.lit(2))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), F.lit(2))
    )
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def drop_percent(before: Column, now: Column) -> Column:
    """Percentage by which the price fell, NULL unless it fell."""
    return F.when(before > now, (before - now).cast("double") / before.cast("double") * 100)


def bounded_cast(c: Column, field: str, bounds: dict | None = None) -> Column:
    """E-M5: number within the sane range of the field, else NULL."""
    lo, hi = (bounds or lx.NUMBER_BOUNDS)[field]
    value = c.cast("string").try_cast("double")
    if field != "rooms":
        value = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")
    return F.when(value.between(lo, hi), value)
