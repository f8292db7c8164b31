"""Filters, reject reasons, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions.text import title_of
from hearthline.operators import filters as flt
from hearthline.plans.registry import query
from hearthline.sources.tables import listings, posts, texts

c = F.col
AS_OF = "1999-06-01"
CFG = flt.SearchConfig(
    rooms_min=1.5, rooms_max=5.0, price_min=300_000, price_max=2_500_000, min_sqm=40,
    max_listing_age_days=900, exclude_ground_floor=True,
    property_types=["ECONOMY", "STANDARD", "SMALL", "LARGE"],
)
ORDER = ["no_token", "rooms_out_of_range", "property_type_filtered", "ground_floor",
         "price_out_of_range", "sqm_too_small", "too_old"]

REASON_SQL = f"""
CASE WHEN source_id = '' THEN 'no_token'
     WHEN rooms NOT BETWEEN 1.5 AND 5.0 THEN 'rooms_out_of_range'
     WHEN neighborhood NOT IN ('ECONOMY','STANDARD','SMALL','LARGE') THEN 'property_type_filtered'
     WHEN floor = 0 THEN 'ground_floor'
     WHEN price NOT BETWEEN 300000 AND 2500000 THEN 'price_out_of_range'
     WHEN sqm < 40 THEN 'sqm_too_small'
     WHEN observed_at < DATE '{AS_OF}' - INTERVAL 900 DAY THEN 'too_old' END
"""


def _with_reason(spark: SparkSession, folder: str) -> DataFrame:
    rules = flt.rule_set(
        CFG, F.lit(AS_OF).cast("date"), ORDER,
        listing_type=c("neighborhood"), publish_date=c("observed_at"),
    )
    return listings(spark, folder).withColumn("reject_reason", flt.reject_reason(rules))


@query("search_filter", """
SELECT source, source_id, rooms, price, sqm FROM listings
WHERE (rooms IS NULL OR rooms BETWEEN 1.5 AND 5.0) AND price BETWEEN 300000 AND 2500000 AND sqm >= 40
""")
def search_filter(spark, folder):
    return flt.search_filter(listings(spark, folder), CFG).select("source", "source_id", "rooms", "price", "sqm")


@query("reject_reason", f"SELECT source, source_id, {REASON_SQL} AS reject_reason FROM listings")
def reject_reason(spark, folder):
    return _with_reason(spark, folder).select("source", "source_id", "reject_reason")


@query("reject_histogram", f"""
SELECT source, reject_reason, count(*) AS n FROM (SELECT source, {REASON_SQL} AS reject_reason FROM listings)
WHERE reject_reason IS NOT NULL GROUP BY ALL
""")
def reject_histogram(spark, folder):
    return flt.reject_histogram(_with_reason(spark, folder))


CITY_GROUPS = [["NATION 1", "NATION-2"], ["NATION 20", "NATION־21", "NATION-22"]]
CITY_NAMES = ["NATION 0", "NATION-1", "NATION־7", "NATION 20"]


@query("allowed_cities", """
SELECT source, source_id, replace(city, '_', '-') AS city FROM listings
WHERE city IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_7', 'NATION_20', 'NATION_21', 'NATION_22')
""")
def allowed_cities(spark, folder):
    rows = listings(spark, folder).withColumn("city", F.translate("city", "_", "-"))
    return flt.allow_cities(rows, CITY_NAMES, groups=CITY_GROUPS).select("source", "source_id", "city")


@query("city_keys", """
SELECT source, source_id,
       CASE WHEN city = 'NATION_2' THEN 'NATION 1' WHEN city IN ('NATION_21','NATION_22') THEN 'NATION 20'
            ELSE replace(city, '_', ' ') END AS city_key,
       (city IN ('NATION_0','NATION_1','NATION_2','NATION_7','NATION_20','NATION_21','NATION_22'))::INTEGER AS allowed
FROM listings
""")
def city_keys(spark, folder):
    spelled = F.concat(F.lit(" "), F.translate("city", "_", "־"), F.lit(" "))
    return listings(spark, folder).select(
        "source", "source_id", flt.city_key(spelled, CITY_GROUPS).alias("city_key"),
        flt.city_allowed(spelled, CITY_NAMES, CITY_GROUPS).cast("int").alias("allowed"),
    )


@query("expected_city_and_type", """
SELECT source, source_id FROM listings WHERE city = 'NATION_7' AND neighborhood IN ('ECONOMY', 'SMALL')
""")
def expected_city_and_type(spark, folder):
    return listings(spark, folder).filter(
        (c("city") == "NATION_7") & c("neighborhood").isin("ECONOMY", "SMALL")
    ).select("source", "source_id")


@query("floor_gates", """
SELECT source, source_id, floor, (floor IS NULL OR floor <= 2)::INTEGER AS low_floor,
       coalesce(floor = 0, false)::INTEGER AS ground_floor FROM listings
""")
def floor_gates(spark, folder):
    return listings(spark, folder).select(
        "source", "source_id", "floor", flt.low_floor().cast("int").alias("low_floor"),
        F.coalesce(c("floor") == 0, F.lit(False)).cast("int").alias("ground_floor"),
    )


@query("kind_gate", """
SELECT source, source_id FROM listings
WHERE NOT is_agent AND source <> 'R' AND (line_no % 3 = 0 OR line_no % 3 = 1)
""")
def kind_gate(spark, folder):
    option = F.when(c("is_agent"), "rent").otherwise("buy")
    currency = F.when(c("source") == "R", "USD").when(c("source") == "A", "").otherwise("ILS")
    entity = F.when(c("line_no") % 3 == 1, "property").when(c("line_no") % 3 == 2, "unit")
    return listings(spark, folder).filter(flt.kind_gate(option, currency, entity)).select("source", "source_id")


@query("young_listings", f"""
SELECT source, source_id, observed_at::VARCHAR AS observed_at FROM listings
WHERE observed_at >= DATE '{AS_OF}' - INTERVAL 30 DAY
""")
def young_listings(spark, folder):
    return listings(spark, folder).filter(
        flt.young_enough(c("observed_at"), F.lit(AS_OF).cast("date"), 30)
    ).select("source", "source_id", c("observed_at").cast("string").alias("observed_at"))


@query("single_source", "SELECT source, source_id, price FROM obs WHERE source = 'N'")
def single_source(spark, folder):
    from hearthline.sources.tables import observations

    return observations(spark, folder).filter(c("source") == "N").select("source", "source_id", "price")


@query("needs_enrichment", """
SELECT source, source_id FROM listings
WHERE floor IS NULL OR part_id % 5 = 0 OR line_no = 3
""")
def needs_enrichment(spark, folder):
    rows = listings(spark, folder).withColumns({
        "garden_sqm": F.when(c("part_id") % 5 != 0, c("sqm")),
        "lot_sqm": F.when(c("line_no") != 3, c("sqm")),
    })
    return rows.filter(flt.any_null(["floor", "garden_sqm", "lot_sqm", "rooms", "sqm"])).select("source", "source_id")


SPACES = r"[\s\x{0B}\x{85}\p{Z}]"
TITLE_SQL = f"""
coalesce(list_filter(list_transform(regexp_split_to_array(description, '\\r\\n|\\r|\\n'),
  lambda x: trim(regexp_replace(x, '{SPACES}+', ' ', 'g'))), lambda x: x <> '')[1], '')
"""


@query("title_tokens", f"""
SELECT doc_id FROM (SELECT doc_id, {TITLE_SQL} AS line FROM texts)
WHERE contains(CASE WHEN length(line) > 160 THEN line[1:159] || '…' ELSE line END, 'the')
  AND contains(CASE WHEN length(line) > 160 THEN line[1:159] || '…' ELSE line END, 'an')
""")
def title_tokens(spark, folder):
    return texts(spark, folder).filter(
        flt.title_has_all(title_of(c("description")), ["the", "an"])
    ).select("doc_id")


TOPICS = [
    flt.Topic("motion", [r"tion\b", r"mouve"]),
    flt.Topic("language", [r"\bque\b", r"\bund\b"]),
    flt.Topic("accents", [r"É[a-z]+", r"ñ"]),
]


@query("topic_match", r"""
SELECT post_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '(?i)tion([^\p{L}\p{M}\p{N}_]|$)|mouve') THEN 'motion' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])(que|und)([^\p{L}\p{M}\p{N}_]|$)') THEN 'language' END,
  CASE WHEN regexp_matches(text, '(?i)É[a-z]+|ñ') THEN 'accents' END], lambda x: x IS NOT NULL), ', ') AS topics
FROM posts WHERE regexp_matches(text, '(?i)tion([^\p{L}\p{M}\p{N}_]|$)|mouve')
  OR regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])(que|und)([^\p{L}\p{M}\p{N}_]|$)')
  OR regexp_matches(text, '(?i)É[a-z]+|ñ')
""")
def topic_match(spark, folder):
    tagged = posts(spark, folder).withColumn("topics", flt.match_topics(c("text"), TOPICS))
    return tagged.filter((F.size("topics") > 0) & flt.has_identity(c("group_id"), c("post_id"))).select(
        "post_id", F.array_join("topics", ", ").alias("topics")
    )


@query("city_mismatch_rejects", """
SELECT source, source_id, CASE WHEN rooms NOT BETWEEN 1.5 AND 5.0 THEN 'rooms_out_of_range' WHEN price NOT BETWEEN 300000 AND 2500000 THEN 'price_out_of_range'
  WHEN city <> 'NATION_7' THEN 'city_mismatch' WHEN sqm < 40 THEN 'sqm_too_small' END AS reject_reason FROM listings
""")
def city_mismatch_rejects(spark, folder):
    """C4: a feed asked for one city rejects what it returns from others, in the rule order of the nested feed."""
    cfg = flt.SearchConfig(rooms_min=1.5, rooms_max=5.0, price_min=300_000, price_max=2_500_000, min_sqm=40)
    rules = flt.rule_set(cfg, F.lit("1997-01-31").cast("date"), flt.FEED_RULES["nested"],
                         expected_city=F.lit("NATION_7"), publish_date=F.lit("1997-01-31").cast("date"))
    return listings(spark, folder).select("source", "source_id", flt.reject_reason(rules).alias("reject_reason"))
