"""JSON feeds, detail merge and tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import filters as flt, runs
from hearthline.plans import bronze
from hearthline.plans.registry import query
from hearthline.sources import details, json_feeds as jf, tiles
from hearthline.sources.tables import listings, texts

c = F.col


@query("json_flatten", """
SELECT source || '-' || source_id AS token, CASE WHEN is_agent THEN 'agency' ELSE 'private' END AS section, price FROM listings
""")
def json_flatten(spark, folder):
    flat = jf.flatten_sections(bronze.nested_pages(spark, folder))
    return flat.select(c("item.token").alias("token"), "section", c("item.price").alias("price"))


@query("json_normalize", """
SELECT source || '-' || source_id AS source_id, city, neighborhood, street || ' ' || house_number AS street, house_number,
  street || ' ' || house_number || ', ' || neighborhood || ', ' || city AS address, rooms, sqm,
  CASE WHEN line_no % 2 = 0 THEN sqm - 3 END AS sqm_build, floor, price, price_before,
  round_even(price::DOUBLE / (CASE WHEN line_no % 2 = 0 THEN sqm - 3 ELSE sqm END)::DOUBLE, 0)::BIGINT AS price_per_sqm,
  neighborhood AS listing_type, is_agent::INTEGER AS is_agent, (line_no % 3 = 0)::INTEGER AS parking,
  'בית & ' || street || ' נבנה בשנת ' || year_built AS description,
  'https://img.example/cover.jpg,https://img.example/a.jpg' AS images, lat, lon, observed_at::VARCHAR AS publish_date, year_built
FROM listings
""")
def json_normalize(spark, folder):
    rows = jf.normalize_nested(jf.flatten_sections(bronze.nested_pages(spark, folder)), 2001)
    return rows.select(
        "source_id", "city", "neighborhood", "street", "house_number", "address", "rooms", "sqm", "sqm_build", "floor",
        "price", "price_before", "price_per_sqm", "listing_type", c("is_agent").cast("int").alias("is_agent"),
        c("parking").cast("int").alias("parking"), "description", F.array_join("images", ",").alias("images"), "lat", "lon",
        c("publish_date").cast("string").alias("publish_date"), "year_built",
    )


@query("json_bilingual", """
SELECT source || '-' || source_id AS source_id,
  'https://homes.example/' || CASE WHEN line_no % 2 = 0 THEN 'p/' ELSE 'property/' END || source || '-' || source_id AS url,
  city, street || ' ' || house_number AS street, rooms, sqm, floor, price, round_even(price::DOUBLE / sqm::DOUBLE, 0)::BIGINT AS price_per_sqm,
  (line_no % 3 <> 0)::INTEGER AS parking, CASE WHEN line_no % 2 = 0 THEN 'g.jpg' ELSE 'f.jpg' END || ',t2.jpg' AS images, street || ',' || city AS tags,
  (CASE WHEN line_no = 5 THEN observed_at - 3 ELSE observed_at + 2 END)::VARCHAR AS publish_date, (observed_at - 3)::VARCHAR AS first_listed_date
FROM listings
""")
def json_bilingual(spark, folder):
    rows = jf.parse_bilingual(bronze.bilingual_pages(spark, folder))
    return rows.select(
        "source_id", "url", "city", "street", "rooms", "sqm", "floor", "price", "price_per_sqm",
        c("parking").cast("int").alias("parking"), F.array_join("images", ",").alias("images"), F.array_join("tags", ",").alias("tags"),
        c("publish_date").cast("string").alias("publish_date"), c("first_listed_date").cast("string").alias("first_listed_date"),
    )


@query("json_agency", """
SELECT (order_id * 10 + line_no)::VARCHAR AS source_id, city, CASE WHEN line_no % 2 = 0 THEN street || ' ' || city ELSE street || ', ' || neighborhood || ', ' || city END AS address,
  rooms, sqm, floor, price, CASE WHEN line_no = 1 THEN 'קוטג''' ELSE neighborhood END AS listing_type, (line_no % 2)::INTEGER AS parking,
  CASE WHEN line_no % 3 = 0 THEN 600 END::INTEGER AS lot_sqm, CASE WHEN line_no % 3 <> 0 THEN sqm END AS garden_sqm,
  CASE WHEN line_no % 3 <> 0 THEN 2 END::INTEGER AS units_count FROM listings
""")
def json_agency(spark, folder):
    return jf.parse_agency(bronze.agency_pages(spark, folder), 2001).select(
        "source_id", "city", "address", "rooms", "sqm", "floor", "price", "listing_type",
        c("parking").cast("int").alias("parking"), "lot_sqm", "garden_sqm", "units_count",
    )


CFG = flt.SearchConfig(rooms_min=1.5, rooms_max=5.0, price_min=300_000, price_max=2_500_000, min_sqm=40)


@query("bilingual_rejects", """
SELECT CASE WHEN price NOT BETWEEN 300000 AND 2500000 THEN 'price_out_of_range' WHEN rooms NOT BETWEEN 1.5 AND 5.0 THEN 'rooms_out_of_range'
   WHEN sqm < 40 THEN 'sqm_too_small' WHEN NOT (city IN ('NATION_0', 'NATION_1', 'NATION_7', 'NATION_12')) THEN 'city_not_allowed'
   WHEN CASE WHEN line_no = 5 THEN observed_at - 3 ELSE observed_at + 2 END < DATE '1997-01-01' THEN 'too_old' ELSE 'passed' END AS reason, count(*) AS n
FROM listings GROUP BY 1
""")
def bilingual_rejects(spark, folder):
    """C2/C9/AG6 with the rule order of the bilingual feed."""
    rows = jf.parse_bilingual(bronze.bilingual_pages(spark, folder))
    p = lambda n: c("source_payload")[n]
    rules = flt.rule_set(
        CFG, F.lit("1997-01-31").cast("date"), flt.FEED_RULES["bilingual"],
        city_allowed=flt.city_allowed(c("city"), ["NATION_0", "NATION_1", "NATION_7", "NATION_12"]), publish_date=c("publish_date"),
        rule_not_buy=F.coalesce(p("search_option") != "buy", F.lit(True)),
        rule_not_ils=F.coalesce(F.nullif(p("currency"), F.lit("")), F.lit("ILS")) != "ILS",
        rule_not_property=F.coalesce(p("entity") != "property", F.lit(False)),
        rule_no_source_id=F.coalesce(c("source_id"), F.lit("")) == "",
    )
    reason = F.coalesce(flt.reject_reason(rules), F.lit("passed"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("page_completeness", """
SELECT source, total_pages, pages_seen, CASE WHEN total_pages IS NOT NULL THEN pages_seen >= total_pages
   ELSE pages_seen = last_page AND last_page >= 5 END::INTEGER AS complete FROM (
  SELECT l_orderkey::VARCHAR AS source, CASE l_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 3 THEN 2 END AS total_pages,
    count(DISTINCT l_linenumber) AS pages_seen, max(l_linenumber) AS last_page FROM lineitem GROUP BY l_orderkey)
""")
def page_completeness(spark, folder):
    pages = runs.page_completeness(jf.page_marks(bronze.paged_feeds(spark, folder)))
    return pages.select("source", "total_pages", "pages_seen", c("complete").cast("int").alias("complete"))


TREND_SQL = """
, o AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'settlement' ELSE 'neighborhood' END AS level, (o_custkey % 1000)::VARCHAR AS city,
    o_orderpriority AS neighborhood, floor(o_totalprice)::BIGINT AS price, o_orderkey AS k,
    year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders),
  pts AS (SELECT level, city, neighborhood, 3.0::DOUBLE AS rooms, m, price FROM o
    UNION ALL SELECT level, city, neighborhood, 3.0::DOUBLE, m + 3, price + 10 FROM o WHERE k % 3 <> 0
    UNION ALL SELECT level, city, neighborhood, NULL, m, price + 20 FROM o),
  comps AS (SELECT level, city, neighborhood, rooms, make_date((m - 1) // 12, (m - 1) % 12 + 1, 1)::VARCHAR AS deal_date, price FROM pts
    WHERE m >= 2001 * 12 + 8 - 18)
"""


@query("trend_comps", TREND_SQL + "SELECT * FROM comps")
def trend_comps(spark, folder):
    comps = jf.trends_to_comps(bronze.trend_pages(spark, folder), F.lit("2001-08-01").cast("date"))
    return comps.select("level", "city", "neighborhood", "rooms", c("deal_date").cast("string").alias("deal_date"), "price")


@query("level_fallback", TREND_SQL + """
SELECT c.city, c.level, c.rooms, c.deal_date, c.price FROM comps c JOIN (SELECT city, min(level) AS level FROM comps GROUP BY city) b
 ON c.city = b.city AND c.level = b.level WHERE rooms IS NULL OR rooms = 3.0
""")
def level_fallback(spark, folder):
    comps = jf.trends_to_comps(bronze.trend_pages(spark, folder), F.lit("2001-08-01").cast("date"))
    best = jf.prefer_level(comps, ["city"], ["neighborhood", "settlement"]).filter(jf.rooms_or_all(c("rooms"), 3.0))
    return best.select("city", "level", "rooms", c("deal_date").cast("string").alias("deal_date"), "price")


@query("json_posts", """
SELECT post_id, sha256(text) AS text, 'https://social.example/' || post_id AS url, group_id AS author FROM posts
""")
def json_posts(spark, folder):
    found = jf.extract_posts(bronze.post_bodies(spark, folder))
    return found.select("post_id", F.sha2("text", 256).alias("text"), "url", "author")


@query("json_odd_posts", """
SELECT CASE WHEN conv_id % 4 = 2 THEN (conv_id * 1000 + turn + 1)::VARCHAR ELSE post_id END AS post_id, sha256(text) AS text,
  CASE WHEN conv_id % 4 = 0 THEN 'https://social.example/' || post_id ELSE '' END AS url,
  CASE WHEN conv_id % 4 = 0 THEN group_id ELSE '' END AS author
FROM posts WHERE conv_id % 4 < 3 AND text IS NOT NULL
""")
def json_odd_posts(spark, folder):
    """A18 on payloads whose fields have other types than text."""
    found = jf.extract_posts(bronze.odd_post_bodies(spark, folder))
    return found.select("post_id", F.sha2("text", 256).alias("text"), "url", "author")


@query("event_props", r"""
SELECT event_id, try_cast(regexp_extract(props, '"k":\s*([0-9]+)', 1) AS BIGINT) AS k FROM events
""")
def event_props(spark, folder):
    """A1 on stored JSON: one typed field of a payload."""
    from hearthline.sources.tables import read_table

    return read_table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("merge_details", """
SELECT l.source, l.source_id, CASE WHEN d.doc_id IS NOT NULL AND length(trim(d.text)) > length(l.street) THEN sha256(trim(d.text)) ELSE sha256(l.street) END AS description,
  (l.is_agent OR coalesce(d.doc_id % 2 = 0, false))::INTEGER AS parking, coalesce(l.floor, (d.doc_id % 5)::INTEGER) AS floor,
  coalesce((d.doc_id % 90)::INTEGER + 20, NULL) AS sqm_build,
  CASE WHEN d.doc_id IS NULL THEN round_even(l.price::DOUBLE / l.sqm::DOUBLE, 0) ELSE round_even(l.price::DOUBLE / (d.doc_id % 90 + 20)::DOUBLE, 0) END::BIGINT AS price_per_sqm,
  CASE WHEN d.doc_id IS NULL THEN l.street ELSE l.street || ',' || d.lang END AS tags,
  least(l.observed_at, CASE WHEN d.doc_id IS NOT NULL THEN DATE '1998-06-01' END)::VARCHAR AS first_listed_date
FROM listings l LEFT JOIN documents d ON l.source = 'A' AND l.order_id * 10 + l.line_no = d.doc_id
""")
def merge_details(spark, folder):
    rows = listings(spark, folder).withColumns({
        "description": c("street"), "parking": c("is_agent"), "sqm_build": F.lit(None).cast("int"),
        "price_per_sqm": F.lit(None).cast("bigint"), "tags": F.array("street"), "first_listed_date": c("observed_at"),
    })
    doc = c("doc_id")
    found = texts(spark, folder).select(
        F.lit("A").alias("source"), F.concat_ws("-", F.floor(doc / 10).cast("string"), (doc % 10).cast("string")).alias("source_id"),
        "description", (doc % 2 == 0).alias("parking"), (doc % 5).cast("int").alias("floor"),
        (doc % 90 + 20).cast("int").alias("sqm_build"), F.array("lang").alias("tags"), F.lit("1998-06-01").cast("date").alias("first_listed_date"),
    )
    merged = details.merge_details(rows, found)
    return merged.select(
        "source", "source_id", F.sha2("description", 256).alias("description"), c("parking").cast("int").alias("parking"), "floor",
        "sqm_build", "price_per_sqm", F.array_join("tags", ",").alias("tags"), c("first_listed_date").cast("string").alias("first_listed_date"),
    )


BOX = (32.0, 34.8, 32.1, 35.0)


@query("grid_tiles", """
SELECT i AS tile_i, j AS tile_j, count(*) AS markers, (count(*) > 200)::INTEGER AS over_cap FROM (
  SELECT least(floor((lat - 32.0) / ((32.1::DOUBLE - 32.0) / 3))::INTEGER, 2) AS i, least(floor((lon - 34.8::DOUBLE) / ((35.0::DOUBLE - 34.8::DOUBLE) / 3))::INTEGER, 2) AS j
  FROM listings WHERE lat BETWEEN 32.0 AND 32.1::DOUBLE AND lon BETWEEN 34.8::DOUBLE AND 35.0::DOUBLE) GROUP BY ALL
""")
def grid_tiles(spark, folder):
    counts = tiles.tile_counts(listings(spark, folder), BOX, 3)
    grid = tiles.grid_tiles(spark, BOX, 3).select("tile_i", "tile_j")
    return counts.join(grid, ["tile_i", "tile_j"], "left_semi").select(
        "tile_i", "tile_j", "markers", c("over_cap").cast("int").alias("over_cap")
    )


@query("json_details", """
SELECT source, source_id, CASE WHEN line_no % 2 = 0 THEN 'גוף & ' || street || ', נבנה בשנת ' || year_built ELSE street END AS description,
  observed_at::VARCHAR AS created_at, NULL::VARCHAR AS ends_at, (part_id % 3 = 0 OR line_no > 1)::INTEGER AS parking, (part_id % 2 = 0)::INTEGER AS elevator,
  (sqm + 9)::INTEGER AS sqm_build, round_even(price::DOUBLE / (sqm + 9)::DOUBLE, 0)::BIGINT AS price_per_sqm, CASE WHEN line_no % 2 = 0 THEN year_built END AS year_built FROM listings
""")
def json_details(spark, folder):
    """A12/A13/E-D5: nested item details merged into listings by the feed's rules."""
    from hearthline.schema import canonical
    from hearthline.sources.feeds import builtin_feeds

    spec = builtin_feeds(2001)["nested"]
    rows = canonical(listings(spark, folder).drop("year_built"))
    merged = details.merge_details(rows, spec.details(bronze.nested_detail_rows(spark, folder)), spec.detail_rules)
    day = lambda n: c(n).cast("string").alias(n)
    return merged.select(
        "source", "source_id", "description", day("created_at"), day("ends_at"), c("parking").cast("int").alias("parking"),
        c("elevator").cast("int").alias("elevator"), "sqm_build", "price_per_sqm", "year_built",
    )


@query("json_agency_details", """
SELECT source, source_id, CASE WHEN line_no % 3 <> 0 THEN sqm END AS sqm, CASE WHEN line_no % 2 = 0 THEN 600 ELSE 700 END AS lot_sqm,
  CASE WHEN line_no % 2 = 0 THEN NULL ELSE 40 END::INTEGER AS garden_sqm, CASE WHEN line_no % 2 = 0 THEN 2 END::INTEGER AS units_count, floor,
  CASE WHEN part_id % 2 = 0 THEN 1 END AS elevator, CASE WHEN part_id % 5 = 0 THEN 1 END AS ac, year_built,
  CASE WHEN line_no % 2 = 0 THEN 'u.jpg' ELSE 'full.jpg' END AS images FROM listings
""")
def json_agency_details(spark, folder):
    from hearthline.sources.detail_pages import agency_details

    rows = agency_details(bronze.agency_detail_rows(spark, folder), 2001)
    return rows.select(
        "source", "source_id", "sqm", "lot_sqm", "garden_sqm", "units_count", "floor", c("elevator").cast("int").alias("elevator"),
        c("ac").cast("int").alias("ac"), "year_built", F.array_join("images", ",").alias("images"),
    )


@query("deal_providers", TREND_SQL + """
SELECT 'deals_table' AS provider, c_nationkey::VARCHAR AS city, make_date(2000, (c_custkey % 12 + 1)::INTEGER, 1)::VARCHAR AS deal_date,
  (c_custkey % 5 + 1.5)::DOUBLE AS rooms, (c_custkey * 1000 + 7)::BIGINT AS price FROM customer
UNION ALL SELECT 'trends', city, deal_date::VARCHAR, rooms, price FROM comps
""")
def deal_providers(spark, folder):
    """M2: closed deals of every provider, each through its DealSpec."""
    from hearthline.sources.feeds import builtin_deals

    pages = {"deals_table": bronze.deal_pages(spark, folder), "trends": bronze.trend_pages(spark, folder)}
    parts = [
        spec.parse(pages[name]).select(
            F.lit(name).alias("provider"), "city", c("deal_date").cast("string").alias("deal_date"), c("rooms").cast("double").alias("rooms"),
            c("price").cast("bigint").alias("price"))
        for name, spec in builtin_deals(F.lit("2001-08-01").cast("date")).items()
    ]
    return parts[0].unionByName(parts[1])


@query("json_tolerant", """
SELECT source || '-' || source_id AS source_id, price, sqm, sqm AS sqm_build,
  round_even(price::DOUBLE / (sqm + 0.5)::DOUBLE, 0)::BIGINT AS price_per_sqm, (line_no % 5 < 4)::INTEGER AS is_agent FROM listings
""")
def json_tolerant(spark, folder):
    """Fractional prices and areas, and the other names of the agent fields."""
    line = c("line_no") % 5
    item = F.to_json(F.struct(
        F.concat_ws("-", "source", "source_id").alias("token"), (c("price") + 0.25).alias("price"),
        F.when(line == 0, "Broker").alias("ad_type"), F.lit("").alias("adType"), F.when(line == 1, "A").alias("agencyName"), F.lit("").alias("agency"),
        F.struct(F.when(line == 2, "AGENCY").alias("contactType"), F.when(line == 3, "משרד תיווך").alias("contactName")).alias("contact"),
        F.struct((c("sqm") + 0.5).alias("squareMeter")).alias("additionalDetails"), F.struct((c("sqm") + 0.5).alias("squareMeterBuild")).alias("metaData"),
    ))
    start, end = '{"pageProps":{"dehydratedState":{"queries":[{"state":{"data":{"private":[', "]}}}]}}}"
    raw = listings(spark, folder).select(
        F.lit("feed").alias("source"), F.lit(1).alias("page_no"), F.concat(F.lit(start), item, F.lit(end)).alias("payload"))
    return jf.normalize_nested(jf.flatten_sections(raw), 2001).select(
        "source_id", "price", "sqm", "sqm_build", "price_per_sqm", c("is_agent").cast("int").alias("is_agent"))
