"""Canonical table schemas and additive schema migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_DATE, _TS, _STRS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SCORE_REASONS = _struct(
    market_band=T.ArrayType(_L), market_band_source=_S,
    price_vs_market=_S, price_vs_market_delta=_D, price_per_sqm_used=_L,
    description_unit_hit=_B, matched_unit_phrases=_STRS, description_unit_adjustment=_D,
    description_unit_source=_S, units_count_used=_I,
    garden_bonus=_D, garden_bonus_source=_S, matched_garden_phrases=_STRS, garden_sqm_used=_I,
    seller_channel=_S, seller_adjustment=_D,
    school_distance_km=_D, school_distance_bonus=_D,
    parking=_B, balcony=_B, renovated=_B, features_bonus=_D,
    price_drop_pct=_D, price_drop_bonus=_D,
    year_built=_I, building_age=_I, building_age_label=_S, building_age_adjustment=_D,
    risk_liquidity=_B, final=_D,
)

LISTING = _struct(
    source=_S, source_id=_S, url=_S,
    city=_S, neighborhood=_S, street=_S, house_number=_S, address=_S,
    rooms=_D, sqm=_I, sqm_build=_I, floor=_I,
    price=_L, price_before=_L, price_per_sqm=_L,
    listing_type=_S, is_agent=_B,
    parking=_B, elevator=_B, balcony=_B, ac=_B, mamad=_B, renovated=_B,
    description=_S, images=_STRS, tags=_STRS, lat=_D, lon=_D,
    publish_date=_DATE, first_listed_date=_DATE, first_seen_at=_TS, last_seen_at=_TS,
    created_at=_DATE, updated_at=_DATE, ends_at=_DATE, rebounced_at=_DATE,
    canonical_id=_S,
    fair_price_estimate=_L, fair_price_low=_L, fair_price_high=_L,
    score=_D, score_reasons=SCORE_REASONS, source_payload=T.MapType(_S, _S),
    is_favorite=_B, user_notes=_S,
    units_count=_I, garden_sqm=_I, lot_sqm=_I, year_built=_I,
    rooms_user=_D, sqm_user=_I, sqm_build_user=_I,
    units_count_user=_I, garden_sqm_user=_I, lot_sqm_user=_I,
)

COMP = _struct(
    provider=_S, address_hash=_S, deal_date=_DATE, price=_L, sqm=_I, rooms=_D,
    city=_S, neighborhood=_S, street=_S, house_number=_S, year_built=_I,
    raw=T.MapType(_S, _S), fetched_at=_TS,
)

PRICE_HISTORY = _struct(source=_S, source_id=_S, ts=_TS, price=_L)

SCAN_LOG = _struct(
    ts=_TS, source=_S, fetched=_L, new=_L, updated=_L, price_drops=_L, alerted=_L,
    duration_sec=_D, errors=_STRS,
)

FREE_ITEM = _struct(
    source=_S, source_id=_S, watch_label=_S, title=_S, city=_S, condition=_I,
    url=_S, image_url=_S, posted_at=_DATE, first_seen_at=_TS, last_seen_at=_TS, alerted_at=_TS,
)

LISTING_KEY = ("source", "source_id")
COMP_KEY = ("provider", "address_hash", "deal_date", "price")
HISTORY_KEY = ("source", "source_id", "ts")

USER_OWNED = (
    "is_favorite", "user_notes", "rooms_user", "sqm_user", "sqm_build_user",
    "units_count_user", "garden_sqm_user", "lot_sqm_user",
)

# columns that are never NULL in the canonical table
NOT_NULL_DEFAULTS = {
    "city": "", "neighborhood": "", "street": "", "house_number": "", "address": "",
    "listing_type": "", "description": "", "user_notes": "",
    "is_agent": False, "parking": False, "elevator": False, "balcony": False,
    "ac": False, "mamad": False, "renovated": False, "is_favorite": False,
}


def align_to_schema(
    df: DataFrame, schema: T.StructType, defaults: dict | None = None
) -> DataFrame:
    """Project to ``schema``: missing columns become typed NULLs (or their default), extras drop."""
    defaults = defaults or {}
    present = set(df.columns)
    columns = []
    for field in schema.fields:
        fallback = F.lit(defaults.get(field.name)).cast(field.dataType)
        value = F.col(field.name).cast(field.dataType) if field.name in present else fallback
        if field.name in present and field.name in defaults:
            value = F.coalesce(value, fallback)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def canonical(df: DataFrame) -> DataFrame:
    """Align to the listing schema with its never-NULL defaults."""
    return align_to_schema(df, LISTING, NOT_NULL_DEFAULTS)
