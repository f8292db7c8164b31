"""Score components and the full rule score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline import lexicons as lx
from hearthline.functions import numeric as num
from hearthline.operators import scoring as sc
from hearthline.operators.ordered import positions
from hearthline.plans.registry import half_even_sql, query
from hearthline.sources.tables import listings, texts

c = F.col
AS_OF = "2001-08-01"
BANDS = [
    ("NATION_1", "ECONOMY", 9_000, 14_000), ("NATION_1", "", 8_000, 12_000),
    ("NATION_2", "SMALL", 11_000, 16_000), ("_7", "", 6_000, 9_000),
]
BAND_SQL = """
CASE WHEN contains(city, 'NATION_1') AND contains(neighborhood, 'ECONOMY') THEN {lo_or_hi[0]}
     WHEN contains(city, 'NATION_1') THEN {lo_or_hi[1]}
     WHEN contains(city, 'NATION_2') AND contains(neighborhood, 'SMALL') THEN {lo_or_hi[2]}
     WHEN contains(city, '_7') THEN {lo_or_hi[3]} ELSE {lo_or_hi[4]} END
"""
LO_SQL = BAND_SQL.format(lo_or_hi=[9000, 8000, 11000, 6000, 25000])
HI_SQL = BAND_SQL.format(lo_or_hi=[14000, 12000, 16000, 9000, 40000])


@query("market_band", f"SELECT source, source_id, {LO_SQL} AS lo, {HI_SQL} AS hi FROM listings")
def market_band(spark, folder):
    band = sc.market_band(c("city"), c("neighborhood"), BANDS, lx.FALLBACK_BAND)
    return listings(spark, folder).withColumn("b", band).select("source", "source_id", "b.lo", "b.hi")


KM_SQL = """
6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a))
"""
DIST_SQL = f"""
SELECT *, {KM_SQL} AS km FROM (SELECT *,
  pow(sin(radians(32.025982::DOUBLE - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(32.025982::DOUBLE)) * pow(sin(radians(34.864421::DOUBLE - lon) / 2), 2) AS a
  FROM listings)
"""
POI_SQL = """
CASE WHEN km < 0.5 THEN 1.5 WHEN km < 1.0 THEN 1.0 WHEN km < 1.5 THEN 0.6 WHEN km < 2.5 THEN 0.2
     WHEN km < 4.0 THEN 0.0 ELSE -0.5 END::DOUBLE
"""


@query("poi_distance_band", f"SELECT source, source_id, round(km, 3) AS km, {POI_SQL} AS points FROM ({DIST_SQL})")
def poi_distance_band(spark, folder):
    km = num.haversine_km(c("lat"), c("lon"), F.lit(lx.POI[0]), F.lit(lx.POI[1]))
    return listings(spark, folder).withColumn("km", km).select(
        "source", "source_id", F.round("km", 3).alias("km"), sc.distance_points(c("km")).alias("points")
    )


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Listings with every column the score reads."""
    flag = lambda k: c("line_no") % k == 0
    return listings(spark, folder).withColumns({
        "price_per_sqm": F.lit(None).cast("bigint"),
        "sqm_build": F.when(c("part_id") % 4 == 0, c("sqm") - 3).cast("int"),
        "sqm_build_user": F.when(c("part_id") % 10 == 0, c("sqm") + 5).cast("int"),
        "units_count": F.when(c("part_id") % 9 == 0, c("line_no")).cast("int"),
        "units_count_user": F.lit(None).cast("int"),
        "garden_sqm": F.when(c("part_id") % 6 == 0, c("sqm") * 2).cast("int"),
        "garden_sqm_user": F.lit(None).cast("int"),
        "parking": flag(2), "balcony": flag(3), "renovated": flag(5),
        "fair_price_estimate": F.when(c("supplier_id") % 3 == 0, c("price") + 50_000),
        "tags": F.array("street"),
        "description": F.when(c("part_id") % 7 == 0, "נמכר: בית עם יחידת דיור וגם חצר גדולה")
        .when(c("part_id") % 7 == 1, "בית מחולק ל-3 דירות, שטח גינה ומגרש גדול")
        .when(c("part_id") % 7 == 2, "Apartment מחולקת")
        .when(c("part_id") % 7 == 3, "יש יחידה").otherwise(""),
    })


MARKET_SQL = half_even_sql("""CASE
       WHEN ppsqm <= lo THEN 3.0::DOUBLE - least(ppsqm::DOUBLE, lo) / greatest(lo, 1.0::DOUBLE)
       WHEN ppsqm <= hi THEN 2.0::DOUBLE - (ppsqm - lo) / greatest(hi - lo, 1.0::DOUBLE) * 2.0::DOUBLE
       ELSE least(ppsqm - hi, hi * 0.2::DOUBLE) / greatest(hi * 0.2::DOUBLE, 1.0::DOUBLE) * -2.0::DOUBLE END""", 2)
TOTAL_SQL = half_even_sql("""5.0::DOUBLE + (coalesce(market, 0) + unit_points + garden_points + seller_points + poi_points
  + feature_points + coalesce(drop_points, 0) + age_points + liquidity_points)""", 1)

SCORE_SQL = f"""
, base AS (SELECT *, part_id % 7 AS kind,
     CASE WHEN part_id % 10 = 0 THEN sqm + 5 WHEN part_id % 4 = 0 THEN sqm - 3 ELSE sqm END AS built,
     CASE WHEN part_id % 9 = 0 THEN line_no END AS units,
     CASE WHEN part_id % 6 = 0 THEN sqm * 2 END AS garden,
     CASE WHEN supplier_id % 3 = 0 THEN price + 50000 END AS fair,
     2001 - year_built AS age FROM ({DIST_SQL})),
 bands AS (SELECT *, round_even(price::DOUBLE / built::DOUBLE, 0)::BIGINT AS ppsqm,
     CASE WHEN fair IS NOT NULL THEN floor(fair::DOUBLE / sqm::DOUBLE * 0.9::DOUBLE) ELSE {LO_SQL} END::DOUBLE AS lo,
     CASE WHEN fair IS NOT NULL THEN floor(fair::DOUBLE / sqm::DOUBLE * 1.1::DOUBLE) ELSE {HI_SQL} END::DOUBLE AS hi
     FROM base),
 parts AS (SELECT *,
     CASE WHEN ppsqm > 0 THEN {MARKET_SQL} END AS market,
     CASE WHEN units >= 2 THEN least(2.5, 0.5 * (units - 1)) WHEN kind = 1 THEN 1.0
          WHEN kind = 0 THEN 0.38 WHEN kind = 2 THEN 0.32 + 0.28 WHEN kind = 3 THEN 0.22 ELSE 0 END::DOUBLE AS unit_points,
     CASE WHEN garden > 0 THEN CASE WHEN garden <= 30 THEN 0.0::DOUBLE WHEN garden <= 300 THEN 1.5::DOUBLE * (garden - 30) / 270 ELSE 1.5::DOUBLE END
          WHEN kind = 0 THEN 0.14::DOUBLE WHEN kind = 1 THEN 0.14::DOUBLE * 2 ELSE 0::DOUBLE END AS garden_points,
     CASE WHEN is_agent THEN -0.48 ELSE 0.72 END::DOUBLE AS seller_points,
     {POI_SQL} AS poi_points,
     0.0::DOUBLE + CASE WHEN line_no % 2 = 0 THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN line_no % 3 = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END
       + CASE WHEN line_no % 5 = 0 THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS feature_points,
     CASE WHEN price_before > price THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (price_before - price)::DOUBLE / price_before::DOUBLE * 100 / 5.0::DOUBLE)) END AS drop_points,
     CASE WHEN age <= 5 THEN 0.3 WHEN age <= 15 THEN 0.1 WHEN age <= 35 THEN 0.0 WHEN age <= 50 THEN -0.2 ELSE -0.4 END::DOUBLE AS age_points,
     CASE WHEN price > 1000000 THEN -0.3 ELSE 0.0 END::DOUBLE AS liquidity_points
     FROM bands)
"""
CONFIG = sc.ScoreConfig(bands=BANDS, liquidity_limit=1_000_000)


@query("score_components", SCORE_SQL + """
SELECT source, source_id, round(market, 2) AS market, round(unit_points, 2) AS unit_points,
       round(garden_points, 3) AS garden_points, seller_points, poi_points, round(feature_points, 2) AS feature_points,
       round(drop_points, 4) AS drop_points, age_points, liquidity_points FROM parts
""")
def score_components(spark, folder):
    parts = sc.score_parts(scored_rows(spark, folder), F.lit(AS_OF).cast("date"), CONFIG)
    return parts.select(
        "source", "source_id", F.round("_market", 2).alias("market"),
        F.round("_units.points", 2).alias("unit_points"), F.round("_garden.points", 3).alias("garden_points"),
        sc.seller_points(c("is_agent")).alias("seller_points"), sc.distance_points(c("_km")).alias("poi_points"),
        F.round(sc.feature_points(), 2).alias("feature_points"),
        F.round(sc.drop_points(c("price_before"), c("price")), 4).alias("drop_points"),
        sc.age_points(c("_age")).alias("age_points"),
        sc.liquidity_points(c("price"), CONFIG.liquidity_limit).alias("liquidity_points"),
    )


@query("rule_score", SCORE_SQL + f"""
SELECT source, source_id,
       greatest(1.0::DOUBLE, least(10.0::DOUBLE, {TOTAL_SQL})) AS score,
       CASE WHEN fair IS NOT NULL THEN 'comps' ELSE 'market_refs' END AS band_source,
       lo::BIGINT::VARCHAR || '-' || hi::BIGINT::VARCHAR AS band,
       CASE WHEN unit_points > 0 THEN CASE WHEN units >= 2 THEN 'structured' WHEN kind = 1 THEN 'description_count' ELSE 'description' END END AS unit_source,
       CASE WHEN age <= 5 THEN 'new_construction' WHEN age <= 15 THEN 'modern' WHEN age <= 35 THEN 'standard'
            WHEN age <= 50 THEN 'older' ELSE 'very_old' END AS age_label
FROM parts
""")
def rule_score(spark, folder):
    rows = sc.score(scored_rows(spark, folder), F.lit(AS_OF).cast("date"), CONFIG)
    r = "score_reasons."
    return rows.select(
        "source", "source_id", "score", c(r + "market_band_source").alias("band_source"),
        F.array_join(F.transform(c(r + "market_band"), lambda x: x.cast("string")), "-").alias("band"),
        c(r + "description_unit_source").alias("unit_source"),
        c(r + "building_age_label").alias("age_label"),
    )


@query("top_scores", SCORE_SQL + f"""
SELECT source, source_id, score FROM (SELECT source, source_id, observed_at,
  greatest(1.0::DOUBLE, least(10.0::DOUBLE, {TOTAL_SQL})) AS score FROM parts)
ORDER BY score DESC NULLS LAST, observed_at DESC, source, source_id LIMIT 100
""")
def top_scores(spark, folder):
    """O1/O3: best scores, newest first; TakeOrderedAndProject keeps 100 rows per task."""
    rows = sc.score(scored_rows(spark, folder), F.lit(AS_OF).cast("date"), CONFIG)
    return rows.orderBy(
        F.desc_nulls_last("score"), F.desc("observed_at"), "source", "source_id"
    ).limit(100).select("source", "source_id", "score")


@query("scores_in_order", SCORE_SQL + f"""
SELECT source, source_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, observed_at DESC, source, source_id) - 1 AS position
FROM (SELECT source, source_id, observed_at, greatest(1.0::DOUBLE, least(10.0::DOUBLE, {TOTAL_SQL})) AS score FROM parts)
""")
def scores_in_order(spark, folder):
    """O1: all scores with their place in the list, best and newest first."""
    rows = sc.score(scored_rows(spark, folder), F.lit(AS_OF).cast("date"), CONFIG)
    placed = positions(rows.select("source", "source_id", "score", "observed_at"),
                       [F.desc_nulls_last("score"), F.desc("observed_at"), "source", "source_id"])
    return placed.drop("observed_at")
