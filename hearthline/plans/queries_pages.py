"""HTML pages: cards, tables, structured data, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.plans import bronze
from hearthline.plans.registry import query
from hearthline.sources import detail_pages as dp, html
from hearthline.sources.tables import read_table

c = F.col

PARTS_SQL = """
, p AS (SELECT p_partkey AS k, p_partkey + 1000 AS id, p_type AS city, p_name AS area, p_brand AS street, p_size AS number,
   floor(p_retailprice * 1000)::BIGINT AS price, (1 + (p_size % 10) / 2.0)::DOUBLE AS rooms, (30 + p_size)::INTEGER AS sqm FROM part)
"""


def flat(df, *columns, flags=(), lists=(), dates=()):
    out = [c(n).cast("int").alias(n) if n in flags else F.array_join(n, ",").alias(n) if n in lists
           else c(n).cast("string").alias(n) if n in dates else c(n) for n in columns]
    return df.select(*out)


@query("html_icon_cards", PARTS_SQL + """
SELECT id::VARCHAR AS source_id, city, area AS neighborhood, street || ' ' || number AS street, number::VARCHAR AS house_number, price, rooms, sqm,
  CASE WHEN k % 3 <> 0 THEN 'https://cards.example/ad/' || id ELSE 'https://cards.example/ad/' || id END AS url,
  (k % 7 = 0)::INTEGER AS is_agent, CASE WHEN k % 5 = 0 THEN 'promoted' ELSE '' END AS tags, 'https://img.example/' || id || '.jpg' AS images FROM p
""")
def html_icon_cards(spark, folder):
    rows = html.icon_cards(bronze.icon_card_pages(spark, folder), "cards", "https://cards.example")
    return flat(rows, "source_id", "city", "neighborhood", "street", "house_number", "price", "rooms", "sqm", "url", "is_agent", "tags", "images",
                flags=["is_agent"], lists=["tags", "images"])


@query("html_table_cards", PARTS_SQL + """
SELECT id::VARCHAR AS source_id, city, area AS neighborhood, street || ' ' || number AS street, price,
  CASE WHEN k % 9 <> 0 THEN rooms END AS rooms, CASE WHEN k % 9 <> 0 THEN sqm END AS sqm, CASE WHEN k % 9 <> 0 THEN (k % 4)::INTEGER END AS floor,
  CASE WHEN k % 9 <> 0 THEN 'דירה' ELSE 'apartment' END AS listing_type, (k % 2 <> 0)::INTEGER AS is_agent,
  'https://table.example/i/' || id || '.jpg' AS images, 'https://table.example/details/?ad=' || id AS url FROM p
""")
def html_table_cards(spark, folder):
    rows = html.table_cards(bronze.table_card_pages(spark, folder), "table", "https://table.example")
    return flat(rows, "source_id", "city", "neighborhood", "street", "price", "rooms", "sqm", "floor", "listing_type", "is_agent", "images", "url",
                flags=["is_agent"], lists=["images"])


@query("html_catalog_cards", PARTS_SQL + """
SELECT 'home-' || id AS source_id, city, street, number::VARCHAR AS house_number, price, rooms, sqm, (k % 5)::INTEGER AS floor, 'וילה' AS listing_type,
  (k % 2 = 0)::INTEGER AS parking, 0 AS elevator, CASE WHEN k % 2 = 0 THEN 'חניה' ELSE 'נוף' END AS tags, 450 AS lot_sqm,
  'https://img.example/' || id || '.jpg' AS images, 'https://catalog.example/for-sale/home-' || id || '?a=1' AS url FROM p
""")
def html_catalog_cards(spark, folder):
    rows = html.catalog_cards(bronze.catalog_pages(spark, folder), "catalog", "https://catalog.example")
    return flat(rows, "source_id", "city", "street", "house_number", "price", "rooms", "sqm", "floor", "listing_type", "parking", "elevator", "tags",
                "lot_sqm", "images", "url", flags=["parking", "elevator"], lists=["tags", "images"])


@query("html_amenity_cards", PARTS_SQL + """
SELECT 'hz-' || id AS source_id, city, street, number::VARCHAR AS house_number, price, rooms, sqm, (k % 4)::INTEGER AS floor, 'קוטג' AS listing_type,
  (k % 3 = 0)::INTEGER AS parking, 'חדש,' || area AS tags, CASE WHEN k % 2 = 0 THEN id || '.jpg' ELSE 'cover.jpg' END AS images,
  'https://amenity.example/home/' || id AS url FROM p
""")
def html_amenity_cards(spark, folder):
    rows = html.amenity_cards(bronze.amenity_pages(spark, folder), "amenity", "https://amenity.example")
    return flat(rows, "source_id", "city", "street", "house_number", "price", "rooms", "sqm", "floor", "listing_type", "parking", "tags", "images", "url",
                flags=["parking"], lists=["tags", "images"])


@query("html_article_cards", PARTS_SQL + """
SELECT id::VARCHAR AS source_id, city, area AS neighborhood, street, number::VARCHAR AS house_number, price, rooms, sqm,
  CASE WHEN k % 4 = 0 THEN 0 WHEN k % 2 = 0 THEN 2 ELSE -1 END AS floor, 'גינה' AS tags,
  'https://articles.example/wp-content/uploads/' || id || '.jpg' AS images, 'https://articles.example/2026/' || id AS url FROM p
""")
def html_article_cards(spark, folder):
    rows = html.article_cards(bronze.article_pages(spark, folder), "articles", "https://articles.example")
    return flat(rows, "source_id", "city", "neighborhood", "street", "house_number", "price", "rooms", "sqm", "floor", "tags", "images", "url",
                lists=["tags", "images"])


@query("html_free_items", """
SELECT c_custkey::VARCHAR AS source_id, c_name || ' & more' AS title, c_mktsegment AS city, (c_custkey % 4)::INTEGER AS condition,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://free.example/item/' || c_custkey ELSE 'https://free.example/cache/2026-06/' || c_custkey || '_o.asp' END AS url,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://free.example/showPhoto.asp?id=' || c_custkey END AS image_url,
  CASE WHEN c_custkey % 5 <> 0 THEN make_date(2025, (c_custkey % 12 + 1)::INTEGER, (c_custkey % 28 + 1)::INTEGER)::VARCHAR ELSE '2026-01-02' END AS posted_at FROM customer
""")
def html_free_items(spark, folder):
    rows = html.free_item_rows(bronze.free_item_pages(spark, folder), "free", "https://free.example", F.lit("2026-01-02").cast("date"))
    return flat(rows, "source_id", "title", "city", "condition", "url", "image_url", "posted_at", dates=["posted_at"])


@query("html_deals", """
SELECT c_custkey AS page_id, c_nationkey::VARCHAR AS city, c_mktsegment || ' street' AS street, c_custkey || '/2' AS house_number,
  make_date(2000, (c_custkey % 12 + 1)::INTEGER, 1)::VARCHAR AS deal_date, (c_custkey % 5 + 1.5)::DOUBLE AS rooms, (c_custkey % 100 + 40)::INTEGER AS sqm,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 60 + 1940 END::INTEGER AS year_built, c_custkey * 1000 + 7 AS price FROM customer
""")
def html_deals(spark, folder):
    pages = bronze.deal_pages(spark, folder)
    rows = html.deals_table(pages, c("city"), c("neighborhood"))
    return flat(rows, "page_id", "city", "street", "house_number", "deal_date", "rooms", "sqm", "year_built", "price", dates=["deal_date"])


@query("jsonld", """
SELECT c_custkey AS page_id, c_name AS description, CASE WHEN c_custkey % 4 <> 2 THEN c_custkey * 1000 END AS price,
  CASE WHEN c_custkey % 4 <> 2 THEN c_custkey % 200 + 20 END::INTEGER AS sqm,
  CASE WHEN c_custkey % 4 <> 2 THEN CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 6 ELSE 2 END END::DOUBLE AS rooms,
  CASE c_custkey % 4 WHEN 0 THEN 'a.jpg,b.jpg' WHEN 1 THEN 'one.jpg' ELSE '' END AS images FROM customer WHERE c_custkey % 4 <> 3
""")
def jsonld(spark, folder):
    rows = html.linked_data(bronze.linked_pages(spark, folder))
    return rows.select("page_id", "description", "price", "sqm", "rooms", F.coalesce(F.array_join("images", ","), F.lit("")).alias("images"))


LINKS_SQL = r"""
SELECT page_id, pos - 1 AS position, regexp_extract(item, 'href="([^"]*)"', 1) AS href,
  trim(regexp_replace(replace(regexp_replace(item, '<[^>]+>', '', 'g'), '&amp;', '&'), '[\x{200e}\x{200f}\x{00a0}]', '', 'g'), chr(32) || chr(9) || chr(13) || chr(10)) AS label
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS pos FROM pages)
"""


@query("html_links", LINKS_SQL)
def html_links(spark, folder):
    return html.list_links(read_table(spark, folder, "pages"))


@query("html_list_items", """
SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, len(regexp_extract_all(html, '<li><a href='))::BIGINT AS links,
  len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs FROM pages
""")
def html_list_items(spark, folder):
    """The element tokenizer over the stored pages: one fragment per list, its items counted."""
    pages = read_table(spark, folder, "pages")
    n = html.N
    rows = html.fragments(pages, "html").select(
        "page_id", F.size(html.elements(n, "li")).cast("bigint").alias("items"),
        F.size(html.inside(html.elements(n, "a", attr="href"), html.elements(n, "li"))).cast("bigint").alias("links"),
        F.size(html.elements(n, "p")).cast("bigint").alias("paragraphs"),
    )
    return rows


@query("html_details", """
SELECT c_custkey::VARCHAR AS source_id, c_name AS description, (c_custkey % 9)::INTEGER AS floor, (c_custkey % 2 = 0)::INTEGER AS parking, 0 AS elevator, 1 AS balcony,
  CASE WHEN c_custkey % 7 = 0 THEN 1 END AS is_agent, make_date(2025, (c_custkey % 12 + 1)::INTEGER, (c_custkey % 28 + 1)::INTEGER)::VARCHAR AS first_listed_date FROM customer
""")
def html_details(spark, folder):
    """A12/D28/E-D8: floor, icon flags, description, contact words and date label of a detail page."""
    rows = dp.icon_details(bronze.detail_html(spark, folder), 2026)
    return flat(rows, "source_id", "description", "floor", "parking", "elevator", "balcony", "is_agent", "first_listed_date",
                flags=["parking", "elevator", "balcony", "is_agent"], dates=["first_listed_date"])


@query("html_labelled_details", """
SELECT c_custkey::VARCHAR AS source_id, (c_custkey % 500 + 100)::INTEGER AS lot_sqm, (c_custkey % 90 + 40)::INTEGER AS sqm,
  CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 * 20 END::INTEGER AS garden_sqm, (c_custkey % 60 + 1960)::INTEGER AS year_built,
  1 AS ac, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS mamad, 1 AS balcony, 'מזגן,' || CASE WHEN c_custkey % 4 = 0 THEN 'ממ״ד' ELSE 'נוף' END AS tags FROM customer
""")
def html_labelled_details(spark, folder):
    rows = dp.labelled_details(bronze.detail_html(spark, folder), 2026)
    return flat(rows, "source_id", "lot_sqm", "sqm", "garden_sqm", "year_built", "ac", "mamad", "balcony", "tags",
                flags=["ac", "mamad", "balcony"], lists=["tags"])


@query("html_text_details", """
SELECT c_custkey::VARCHAR AS source_id, (c_custkey % 9)::INTEGER AS floor, 1 AS parking, 1 AS elevator, 1 AS ac, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS mamad,
  '/p?picNum=' || c_custkey AS images FROM customer
""")
def html_text_details(spark, folder):
    rows = dp.text_details(bronze.detail_html(spark, folder), 2026)
    return flat(rows, "source_id", "floor", "parking", "elevator", "ac", "mamad", "images", flags=["parking", "elevator", "ac", "mamad"], lists=["images"])


@query("feed_descriptions", """
SELECT c_custkey::VARCHAR AS source_id,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name || ' פינתי ' || (c_custkey % 500 + 100) || ' מטר' ELSE 'old' END AS catalog,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 500 + 100 ELSE 7 END::INTEGER AS catalog_lot, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 9 ELSE 1 END::INTEGER AS catalog_floor,
  'חניה' AS catalog_tags, '/g' || c_custkey || '.jpg' AS catalog_images, 0 AS catalog_elevator,
  CASE WHEN contains(told, '403') THEN 'old' ELSE told END AS article, 7 AS article_lot, 'מרפסת' AS article_tags, '/s' || c_custkey || '.jpg' AS article_images, 1 AS article_balcony,
  'old' AS table_text FROM (SELECT *, c_name || ' על מגרש ' || (c_custkey % 500 + 100) || ' מטר' AS told FROM customer)
""")
def feed_descriptions(spark, folder):
    """Catalog and article feeds read their description nodes, not the menu; the table feed fills only what is empty.

    Article texts with the error number are no descriptions, so customers and sizes of that number keep the old one."""
    from hearthline.sources.details import merge_details
    from hearthline.sources.feeds import builtin_feeds

    pages = bronze.described_html(spark, folder)
    have = pages.select(
        "source", "source_id", F.lit("old").alias("description"), F.lit(7).alias("lot_sqm"), F.lit(1).alias("floor"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("images"),
        F.lit(False).alias("elevator"), F.lit(False).alias("balcony"))
    feeds = builtin_feeds(2026)
    merged = lambda name: merge_details(have, feeds[name].details(pages), feeds[name].detail_rules)
    one = lambda n: F.array_join(n, ",")
    catalog = merged("catalog_cards").select(
        "source_id", c("description").alias("catalog"), c("lot_sqm").alias("catalog_lot"), c("floor").alias("catalog_floor"),
        one("tags").alias("catalog_tags"), one("images").alias("catalog_images"), c("elevator").cast("int").alias("catalog_elevator"))
    article = merged("article_cards").select(
        "source_id", c("description").alias("article"), c("lot_sqm").alias("article_lot"), one("tags").alias("article_tags"),
        one("images").alias("article_images"), c("balcony").cast("int").alias("article_balcony"))
    table = merged("table_cards").select("source_id", c("description").alias("table_text"))
    return catalog.join(article, "source_id").join(table, "source_id")
