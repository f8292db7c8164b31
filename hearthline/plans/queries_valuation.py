"""Fair price and the flagship scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions.numeric import price_per_area
from hearthline.operators.filters import SearchConfig, search_filter
from hearthline.operators.scoring import clamp_score, market_delta, market_label, reference_band, seller_points
from hearthline.operators.valuation import PROFILE, RESULT, fair_price, start_estimates, update_estimates, with_estimates
from hearthline.plans.registry import half_even_sql, query
from hearthline.session import cut_lineage
from hearthline.sources.tables import deals, listings

AS_OF = "2001-08-01"
UPDATED = "2001-07-15"
SEARCH = SearchConfig(rooms_min=1.5, rooms_max=5.0, price_min=300_000, price_max=2_500_000, min_sqm=40)

PRICED_SQL = f"""
, cand AS (
  SELECT l.source, l.source_id, l.sqm, d.price, d.sqm AS csqm, d.deal_date, d.address_hash,
         d.neighborhood = l.neighborhood AS near
  FROM listings l JOIN deals d ON d.city = l.city
   AND d.deal_date >= date_trunc('month', DATE '{AS_OF}' - INTERVAL 540 DAY)
   AND d.sqm * 10 BETWEEN l.sqm * 8 AND l.sqm * 12
   AND (l.rooms IS NULL OR d.rooms IS NULL OR abs(d.rooms - l.rooms) <= 0.5)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, source_id, near
              ORDER BY deal_date DESC, price, address_hash, csqm) AS rn_near,
         row_number() OVER (PARTITION BY source, source_id
              ORDER BY deal_date DESC, price, address_hash, csqm) AS rn_city
  FROM cand
), sets AS (
  SELECT source, source_id, any_value(sqm) AS sqm,
         list_sort(list(price::DOUBLE / csqm::DOUBLE) FILTER (near AND rn_near <= 50)) AS near_list,
         list_sort(list(price::DOUBLE / csqm::DOUBLE) FILTER (rn_city <= 50)) AS city_list
  FROM ranked GROUP BY ALL
), chosen AS (
  SELECT source, source_id, sqm, coalesce(len(near_list), 0) >= 3 AS is_near,
         CASE WHEN coalesce(len(near_list), 0) >= 3 THEN near_list ELSE city_list END AS r FROM sets
), priced AS (
  SELECT source, source_id, len(r)::BIGINT AS comps_used,
         CASE WHEN is_near THEN 'neighborhood' ELSE 'city' END AS comps_scope,
         floor(r[len(r) // 2 + 1] * sqm)::BIGINT AS fair_price_estimate,
         floor(r[len(r) // 4 + 1] * sqm)::BIGINT AS fair_price_low,
         floor(r[least(len(r) - 1, 3 * len(r) // 4) + 1] * sqm)::BIGINT AS fair_price_high
  FROM chosen WHERE len(r) >= 3
)
"""


@query("fair_price", PRICED_SQL + """
SELECT l.source, l.source_id, l.price, comps_used, comps_scope,
       fair_price_estimate, fair_price_low, fair_price_high
FROM listings l LEFT JOIN priced p USING (source, source_id)
""")
def fair_price_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = listings(spark, folder).select("source", "source_id", "city", "neighborhood", "rooms", "sqm", "price")
    return fair_price(rows, deals(spark, folder), F.lit(AS_OF).cast("date")).select(
        "source", "source_id", "price", "comps_used", "comps_scope",
        "fair_price_estimate", "fair_price_low", "fair_price_high",
    )


@query("fair_price_update", PRICED_SQL + """
SELECT l.source, l.source_id, comps_used, comps_scope, fair_price_estimate, fair_price_low, fair_price_high
FROM listings l LEFT JOIN priced p USING (source, source_id)
""")
def fair_price_update(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates of an earlier day, brought up to date with the deals since then; equals a run over all deals."""
    rows = cut_lineage(listings(spark, folder).select("source", "source_id", "city", "neighborhood", "rooms", "sqm"))
    profiles = cut_lineage(rows.filter(F.col("sqm") > 0).select(*PROFILE).distinct())
    comps, day = deals(spark, folder), F.lit(UPDATED).cast("date")
    before = start_estimates(profiles, comps.filter(F.col("deal_date") < day), day)
    after = update_estimates(before, profiles, comps.filter(F.col("deal_date") >= day), F.lit(AS_OF).cast("date"))
    return with_estimates(rows, after).select("source", "source_id", *RESULT)


@query("fair_price_score", PRICED_SQL + """
, base AS (
  SELECT l.source, l.source_id, l.price, l.is_agent, p.fair_price_estimate,
         round_even(l.price::DOUBLE / l.sqm::DOUBLE, 0)::BIGINT AS ppsqm,
         CASE WHEN p.fair_price_estimate <> 0 THEN floor(p.fair_price_estimate::DOUBLE / l.sqm::DOUBLE * 0.9::DOUBLE) ELSE 25000 END::DOUBLE AS lo,
         CASE WHEN p.fair_price_estimate <> 0 THEN floor(p.fair_price_estimate::DOUBLE / l.sqm::DOUBLE * 1.1::DOUBLE) ELSE 40000 END::DOUBLE AS hi
  FROM listings l LEFT JOIN priced p USING (source, source_id)
  WHERE l.rooms BETWEEN 1.5 AND 5.0 AND l.price BETWEEN 300000 AND 2500000 AND l.sqm >= 40
), delta AS (
  SELECT *, CASE WHEN ppsqm > 0 THEN """ + half_even_sql("""CASE
      WHEN ppsqm <= lo THEN 3.0::DOUBLE - least(ppsqm::DOUBLE, lo) / greatest(lo, 1.0::DOUBLE)
      WHEN ppsqm <= hi THEN 2.0::DOUBLE - (ppsqm - lo) / greatest(hi - lo, 1.0::DOUBLE) * 2.0::DOUBLE
      ELSE least(ppsqm - hi, hi * 0.2::DOUBLE) / greatest(hi * 0.2::DOUBLE, 1.0::DOUBLE) * -2.0::DOUBLE END""", 2) + """ END AS market_delta
  FROM base
)
SELECT source, source_id, price, fair_price_estimate, ppsqm AS price_per_sqm, round(market_delta, 2) AS market_delta,
       CASE WHEN ppsqm > 0 THEN CASE WHEN ppsqm <= lo THEN 'below band' WHEN ppsqm <= hi THEN 'in band' ELSE 'above band' END END AS market_label,
       greatest(1.0::DOUBLE, least(10.0::DOUBLE, """ + half_even_sql("5.0::DOUBLE + (coalesce(market_delta, 0) + CASE WHEN is_agent THEN -0.48::DOUBLE ELSE 0.72::DOUBLE END)", 1) + """)) AS score
FROM delta
""")
def fair_price_score(spark: SparkSession, folder: str) -> DataFrame:
    """Latest sightings -> search filter -> fair price -> band, market delta and score, best first."""
    rows = search_filter(listings(spark, folder), SEARCH).select(
        "source", "source_id", "city", "neighborhood", "rooms", "sqm", "price", "is_agent"
    )
    priced = fair_price(rows, deals(spark, folder), F.lit(AS_OF).cast("date"))
    fallback = F.struct(F.lit(25000).cast("bigint").alias("lo"), F.lit(40000).cast("bigint").alias("hi"))
    c = F.col
    banded = priced.withColumns({
        "price_per_sqm": price_per_area(c("price"), c("sqm")),
        "band": reference_band(c("fair_price_estimate"), c("sqm"), fallback),
    })
    ppsqm = c("price_per_sqm").cast("double")
    return (
        banded.withColumn("market_delta", market_delta(ppsqm, c("band.lo"), c("band.hi")))
        .withColumn("market_label", market_label(ppsqm, c("band.lo"), c("band.hi")))
        .withColumn("score", clamp_score(F.coalesce(c("market_delta"), F.lit(0.0)) + seller_points(c("is_agent"))))
        .select("source", "source_id", "price", "fair_price_estimate", "price_per_sqm",
                "market_delta", "market_label", "score")
        .orderBy(F.desc_nulls_last("score"), "source", "source_id")
    )
