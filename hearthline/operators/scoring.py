"""Rule score of a listing, 1-10, with its reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import lexicons as lx
from hearthline.functions.mining import HEBREW_UNITS, UnitLexicon, units_count_plain
from hearthline.functions.numeric import (
    drop_percent, effective, half_even, haversine_km, price_per_area,
)
from hearthline.functions.text import let, phrase_hits, search_text, standalone_word
from hearthline.schema import SCORE_REASONS


def _add(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


@dataclass(frozen=True)
class UnitWords:
    """Words that hint at several units when no number is known."""

    # fixed values: word and points
    plain: tuple[tuple[str, float], ...] = (("יחידות דיור", 0.38), ("יחידת דיור", 0.38))
    either: tuple[tuple[str, float], ...] = (("מחולקת", 0.32), ("מחולק", 0.28))
    latin: tuple[tuple[str, float], ...] = (("apartment", 0.28),)
    alone: tuple[tuple[str, str, float], ...] = (
        ("יחידות דיור", "יחידות", 0.22), ("יחידת דיור", "יחידה", 0.22),
    )
    cap: float = 2.0


@dataclass(frozen=True)
class ScoreConfig:
    bands: Sequence[tuple[str, str, int, int]] = field(default_factory=lambda: list(lx.MARKET_BANDS))
    fallback_band: tuple[int, int] = lx.FALLBACK_BAND
    poi: tuple[float, float] = lx.POI
    units: UnitLexicon = HEBREW_UNITS
    unit_words: UnitWords = UnitWords()
    garden_phrases: Sequence[str] = field(default_factory=lambda: list(lx.GARDEN_PHRASES))
    liquidity_limit: int = 5_000_000


def market_band(city: Column, neighborhood: Column, bands, fallback) -> Column:
    """STRUCT(lo, hi) of the first row whose texts occur in city and neighbourhood."""
    make = lambda lo, hi: F.struct(F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
    out = make(*fallback)
    for city_part, area_part, lo, hi in reversed(list(bands)):
        hit = city.contains(city_part)
        if area_part:
            hit = hit & neighborhood.contains(area_part)
        out = F.when(hit, make(lo, hi)).otherwise(out)
    return out


def reference_band(fair: Column, sqm: Column, fallback: Column) -> Column:
    """+-10 % of the fair price per area, truncated; else the market band."""
    per_area = fair.cast("double") / sqm.cast("double")
    usable = (fair != 0) & (sqm > 0)
    cut = lambda f: F.floor(per_area * F.lit(f)).cast("bigint")
    return F.when(usable, F.struct(cut(0.90).alias("lo"), cut(1.10).alias("hi"))).otherwise(fallback)


def market_delta(per_area: Column, lo: Column, hi: Column) -> Column:
    """+3..+2 below the band, +2..0 inside, 0..-2 above; NULL without a price per area."""
    lo, hi = lo.cast("double"), hi.cast("double")
    below = F.lit(3.0) - F.least(per_area, lo) / F.greatest(lo, F.lit(1.0))
    inside = F.lit(2.0) - (per_area - lo) / F.greatest(hi - lo, F.lit(1.0)) * 2.0
    above = F.least(per_area - hi, hi * 0.2) / F.greatest(hi * 0.2, F.lit(1.0)) * -2.0
    return F.when(
        per_area > 0,
        half_even(F.when(per_area <= lo, below).when(per_area <= hi, inside).otherwise(above), 2),
    )


def market_label(per_area: Column, lo: Column, hi: Column) -> Column:
    return F.when(
        per_area > 0,
        F.when(per_area <= lo, "below band").when(per_area <= hi, "in band").otherwise("above band"),
    )


def unit_hits(text: Column, words: UnitWords) -> Column:
    """The hint words a text contains, in rule order."""
    hits: list[tuple[str, Column]] = [(w, text.contains(w)) for w, _ in words.plain]
    taken = F.lit(False)
    for w, _ in words.either:
        hits.append((w, text.contains(w) & ~taken))
        taken = taken | text.contains(w)
    hits += [(w, text.contains(w)) for w, _ in words.latin]
    # the plain test first: most texts do not contain the word at all
    hits += [(w, text.contains(w) & ~text.contains(full) & standalone_word(text, w)) for full, w, _ in words.alone]
    return F.array_compact(F.array(*[F.when(hit, w) for w, hit in hits]))


def unit_bonus(hits: Column, units: Column, counted: Column, words: UnitWords) -> Column:
    """STRUCT(points, source, phrases) from the known number, the number in the text or hints."""
    per_count = lambda n: F.least(F.lit(2.5), F.lit(0.5) * (n - 1))
    worth = {w: p for w, p in (*words.plain, *words.either, *words.latin)}
    worth.update({w: p for _, w, p in words.alone})
    table = F.create_map(*[F.lit(x) for pair in worth.items() for x in pair])
    points = F.aggregate(hits, F.lit(0.0), lambda total, w: total + F.try_element_at(table, w))
    structured, from_text = units >= 2, counted >= 2
    label = lambda n, how: F.array(F.concat(n.cast("string"), F.lit(f" יחידות ({how})")))
    return F.struct(
        F.when(structured, per_count(units)).when(from_text, per_count(counted))
        .otherwise(F.least(F.lit(words.cap), points)).alias("points"),
        F.when(structured, "structured").when(from_text, "description_count")
        .otherwise("description").alias("source"),
        F.when(structured, label(units, "מפורש")).when(from_text, label(counted, "מהטקסט"))
        .otherwise(hits).alias("phrases"),
    )


def garden_bonus(text: Column, garden: Column, phrases: Sequence[str]) -> Column:
    """STRUCT(points, source, phrases)."""
    known = garden > 0
    ramp = F.when(garden <= 30, 0.0).when(
        garden <= 300, F.lit(1.5) * (garden - 30) / 270
    ).otherwise(1.5)
    return let(phrase_hits(text, phrases), lambda found: F.struct(
        F.when(known, ramp).otherwise(F.least(F.lit(0.42), F.lit(0.14) * F.size(found))).alias("points"),
        F.when(known, "structured").otherwise("description").alias("source"),
        F.when(known, F.array(F.concat(F.lit("גינה "), garden.cast("string"), F.lit(' מ"ר'))))
        .otherwise(found).alias("phrases"),
    ))


def seller_points(is_agent: Column) -> Column:
    return F.when(_flag(is_agent), lx.SELLER_POINTS["agent"]).otherwise(lx.SELLER_POINTS["private"])


def distance_points(km: Column) -> Column:
    """banded points, NULL without a position."""
    out = F.when(km < lx.POI_BANDS[0][0], lx.POI_BANDS[0][1])
    for below, points in lx.POI_BANDS[1:]:
        out = out.when(km < below, points)
    return F.when(km.isNotNull(), out.otherwise(lx.POI_FAR))


def feature_points() -> Column:
    total = F.lit(0.0)
    for flag, points in lx.FEATURE_POINTS.items():
        total = total + F.when(_flag(F.col(flag)), points).otherwise(0.0)
    return total


def drop_points(before: Column, price: Column) -> Column:
    drop = drop_percent(before, price)
    return F.when(drop.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), drop / 5.0)))


def age_points(age: Column) -> Column:
    out = F.when(age <= lx.AGE_BANDS[0][0], lx.AGE_BANDS[0][1])
    for upto, points, _ in lx.AGE_BANDS[1:]:
        out = out.when(age <= upto, points)
    return F.when(age.isNotNull(), out.otherwise(lx.AGE_OLDEST[0]))


def age_label(age: Column) -> Column:
    out = F.when(age <= lx.AGE_BANDS[0][0], lx.AGE_BANDS[0][2])
    for upto, _, label in lx.AGE_BANDS[1:]:
        out = out.when(age <= upto, label)
    return F.when(age.isNotNull(), out.otherwise(lx.AGE_OLDEST[1]))


def liquidity_points(price: Column, limit: int = 5_000_000) -> Column:
    return F.when(price > limit, -0.3).otherwise(0.0)


def clamp_score(total: Column) -> Column:
    """base 5, one decimal, within 1..10."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), half_even(F.lit(5.0) + total, 1)))


def score_parts(df: DataFrame, as_of: Column, config: ScoreConfig | None = None) -> DataFrame:
    """Add the intermediate columns the score and its reasons share."""
    config = config or ScoreConfig()
    c = F.col
    built = effective(c("sqm_build_user"), c("sqm_build"), c("sqm"))
    return (
        df.withColumns({
            "_ppsqm": F.coalesce(price_per_area(c("price"), built, c("price_per_sqm")), F.lit(0)).cast("double"),
            "_text": search_text(c("description"), c("tags")),
            "_n_units": effective(c("units_count_user"), c("units_count")),
            "_n_garden": effective(c("garden_sqm_user"), c("garden_sqm")),
            "_from_comps": F.coalesce((c("fair_price_estimate") != 0) & (c("sqm") > 0), F.lit(False)),
            "_band": reference_band(
                c("fair_price_estimate"), c("sqm"),
                market_band(c("city"), c("neighborhood"), config.bands, config.fallback_band),
            ),
            "_km": haversine_km(c("lat"), c("lon"), F.lit(config.poi[0]), F.lit(config.poi[1])),
            "_drop": drop_percent(c("price_before"), c("price")),
            "_age": F.when(c("year_built") != 0, F.year(as_of) - c("year_built")),
        })
        # columns of their own, so that the texts are searched once however often a rule asks
        .withColumns({
            "_counted": units_count_plain(c("_text"), config.units), "_hits": unit_hits(c("_text"), config.unit_words),
        })
        .withColumns({
            "_units": unit_bonus(c("_hits"), c("_n_units"), c("_counted"), config.unit_words),
            "_garden": garden_bonus(c("_text"), c("_n_garden"), config.garden_phrases),
            "_market": market_delta(c("_ppsqm"), c("_band.lo"), c("_band.hi")),
        })
    )


def score(df: DataFrame, as_of: Column, config: ScoreConfig | None = None) -> DataFrame:
    """Add ``score`` and ``score_reasons`` to canonical listing rows."""
    config = config or ScoreConfig()
    c = F.col
    parts = score_parts(df, as_of, config)
    two = lambda x: F.bround(x, 2)
    feature = feature_points()
    total = (
        _add(c("_market")) + _add(c("_units.points")) + _add(c("_garden.points"))
        + seller_points(c("is_agent")) + _add(distance_points(c("_km"))) + feature
        + _add(drop_points(c("price_before"), c("price"))) + _add(age_points(c("_age")))
        + _add(liquidity_points(c("price"), config.liquidity_limit))
    )
    scored = parts.withColumn("score", clamp_score(total))
    unit_hit, garden_hit = c("_units.points") > 0, c("_garden.points") > 0
    values = {
        "market_band": F.array(c("_band.lo"), c("_band.hi")),
        "market_band_source": F.when(c("_from_comps"), "comps").otherwise("market_refs"),
        "price_vs_market": market_label(c("_ppsqm"), c("_band.lo"), c("_band.hi")),
        "price_vs_market_delta": c("_market"),
        "price_per_sqm_used": F.when(c("_ppsqm") > 0, c("_ppsqm").cast("bigint")),
        "description_unit_hit": unit_hit,
        "matched_unit_phrases": F.when(unit_hit, c("_units.phrases")),
        "description_unit_adjustment": F.when(unit_hit, two(c("_units.points"))),
        "description_unit_source": F.when(unit_hit, c("_units.source")),
        "units_count_used": F.when(unit_hit, c("_n_units")),
        "garden_bonus": F.when(garden_hit, F.bround(c("_garden.points"), 3)),
        "garden_bonus_source": F.when(garden_hit, c("_garden.source")),
        "matched_garden_phrases": F.when(garden_hit, c("_garden.phrases")),
        "garden_sqm_used": c("_n_garden"),
        "seller_channel": F.when(_flag(c("is_agent")), "agent").otherwise("private"),
        "seller_adjustment": seller_points(c("is_agent")),
        "school_distance_km": two(c("_km")),
        "school_distance_bonus": distance_points(c("_km")),
        "parking": F.when(_flag(c("parking")), True),
        "balcony": F.when(_flag(c("balcony")), True),
        "renovated": F.when(_flag(c("renovated")), True),
        "features_bonus": F.when(feature > 0, two(feature)),
        "price_drop_pct": two(c("_drop")),
        "price_drop_bonus": two(drop_points(c("price_before"), c("price"))),
        "year_built": F.when(c("_age").isNotNull(), c("year_built")),
        "building_age": c("_age"),
        "building_age_label": age_label(c("_age")),
        "building_age_adjustment": age_points(c("_age")),
        "risk_liquidity": F.when(c("price") > config.liquidity_limit, True),
        "final": c("score"),
    }
    reasons = F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in SCORE_REASONS.fields])
    extra = [name for name in scored.columns if name.startswith("_")]
    return scored.withColumn("score_reasons", reasons).drop(*extra)
