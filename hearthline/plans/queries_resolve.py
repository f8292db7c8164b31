"""Entity resolution and duplicate groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions import similarity as sim
from hearthline.operators import resolve as rs, state as st
from hearthline.operators.ordered import positions
from hearthline.plans.registry import query
from hearthline.session import cut_lineage
from hearthline.sources.tables import listings, observations

c = F.col


def rows_with_url(spark: SparkSession, folder: str) -> DataFrame:
    return listings(spark, folder).withColumns({
        "url": F.concat(F.lit("https://board.example/"), c("source_id")),
        "first_seen_at": c("observed_at"),
    })


KEYED_SQL = """
, keyed AS (SELECT *, 'https://board.example/' || source_id AS url,
   'CAN-' || sha1(street || '|' || house_number || '|' || rooms::VARCHAR || '|' || (sqm // 10 * 10)::VARCHAR || '|' || city)[1:12] AS canonical_id
   FROM listings)
"""


@query("exact_groups", KEYED_SQL + "SELECT source, source_id, canonical_id FROM keyed")
def exact_groups(spark, folder):
    return rs.exact_groups(listings(spark, folder)).select("source", "source_id", "canonical_id")


@query("exact_groups_without_city", """
SELECT source, source_id,
   'CAN-' || sha1(street || '|' || house_number || '|' || rooms::VARCHAR || '|' || (sqm // 10 * 10)::VARCHAR)[1:12] AS canonical_id
FROM listings
""")
def exact_groups_without_city(spark, folder):
    return rs.exact_groups(listings(spark, folder), include_city=False).select("source", "source_id", "canonical_id")


@query("group_representatives", KEYED_SQL + """
SELECT canonical_id, count(*) AS members, arg_min(source || '/' || source_id, (observed_at, source, source_id)) AS first_member
FROM keyed GROUP BY canonical_id
""")
def group_representatives(spark, folder):
    grouped = rs.exact_groups(rows_with_url(spark, folder))
    return rs.representatives(grouped).select(
        "canonical_id", "members", F.concat_ws("/", "seen.source", "seen.source_id").alias("first_member")
    )


SUMMARY_SQL = """
SELECT canonical_id, count(*) AS member_count, max(price) - min(price) AS price_spread,
  min(price) AS cheapest_price, arg_min(source, (price, source, source_id)) AS cheapest_source,
  arg_min(url, (price, source, source_id)) AS cheapest_url, max(price) AS dearest_price,
  arg_min(source, (-price, source, source_id)) AS dearest_source,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM keyed GROUP BY canonical_id
"""


@query("group_summary", KEYED_SQL + SUMMARY_SQL)
def group_summary(spark, folder):
    grouped = rs.exact_groups(rows_with_url(spark, folder))
    return rs.group_summary(grouped).withColumn("sources", F.array_join("sources", ","))


@query("dup_groups", KEYED_SQL + SUMMARY_SQL + " HAVING count(*) > 1")
def dup_groups(spark, folder):
    grouped = rs.exact_groups(rows_with_url(spark, folder))
    return rs.duplicate_groups(grouped).withColumn("sources", F.array_join("sources", ","))


@query("dup_groups_in_order", KEYED_SQL + f"""
SELECT canonical_id, price_spread, row_number() OVER (ORDER BY price_spread DESC, canonical_id) - 1 AS position
FROM ({SUMMARY_SQL} HAVING count(*) > 1)
""")
def dup_groups_in_order(spark, folder):
    """O2: groups with several members, each with its place in the list."""
    grouped = rs.duplicate_groups(rs.exact_groups(rows_with_url(spark, folder))).select("canonical_id", "price_spread")
    return positions(grouped, [F.desc("price_spread"), "canonical_id"])


@query("multi_source_groups", KEYED_SQL + """
SELECT count(*) AS groups, sum(n)::BIGINT AS members FROM (SELECT count(*) AS n FROM keyed GROUP BY canonical_id HAVING count(DISTINCT source) > 1)
""")
def multi_source_groups(spark, folder):
    """AG8: groups that several sources share."""
    grouped = rs.group_summary(rs.exact_groups(rows_with_url(spark, folder)))
    return grouped.filter(F.size("sources") > 1).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("member_count").cast("bigint").alias("members")
    )


@query("assign_ids", KEYED_SQL + """
SELECT source, source_id, CASE WHEN part_id % 2 = 0 THEN canonical_id ELSE 'CAN-old' END AS canonical_id FROM keyed
""")
def assign_ids(spark, folder):
    grouped = rs.exact_groups(listings(spark, folder))
    assignments = grouped.filter(c("part_id") % 2 == 0).select("source", "source_id", "canonical_id")
    state = grouped.withColumn("canonical_id", F.lit("CAN-old"))
    return st.assign_ids(state, assignments).select("source", "source_id", "canonical_id")


# distinct street texts per city; the earliest sighting orders them
NODES_SQL = """
, nodes AS (SELECT city AS city_n, city || ' ' || street AS text, min(observed_at) AS seen FROM obs GROUP BY ALL)
"""


def street_nodes(spark: SparkSession, folder: str) -> DataFrame:
    grouped = observations(spark, folder).groupBy("city", "street").agg(F.min("observed_at").alias("first"))
    text = F.concat_ws(" ", "city", "street")
    return grouped.select(
        text.alias("id"), text.alias("text"), c("city").alias("city_n"), F.struct("first", text.alias("t")).alias("seen")
    )


LCS_SQL = """
length(x.text) - bit_count(list_reduce(
  list_transform(string_split(y.text, ''), lambda ch: coalesce(list_sum(list_transform(range(length(x.text)),
    lambda i: CASE WHEN x.text[i + 1] = ch THEN 1::BIGINT << i ELSE 0 END))::BIGINT, 0)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(x.text)) - 1),
  (1::BIGINT << length(x.text)) - 1))
"""


@query("fuzzy_prefilter", NODES_SQL + """
SELECT x.text AS id, y.text AS parent, levenshtein(x.text, y.text) AS distance FROM nodes x JOIN nodes y
  ON x.city_n = y.city_n AND (x.seen, x.text) > (y.seen, y.text)
WHERE least(length(x.text), length(y.text)) * 200 >= (length(x.text) + length(y.text)) * 85
  AND levenshtein(x.text, y.text) <= (length(x.text) + length(y.text)) * 15 // 100
""")
def fuzzy_prefilter(spark, folder):
    """Sound gates of the similarity join: length, then Levenshtein distance, within a city's streets.

    A Levenshtein distance of up to 15 per cent of both lengths leaves a similarity of 70 per cent in common tokens.
    """
    nodes = cut_lineage(street_nodes(spark, folder))
    a, b = c("x.text"), c("y.text")
    close = rs.candidates(nodes, 70, ["seen"]).filter(
        sim.length_gate(a, b, 85) & sim.levenshtein_gate(a, b, 85))
    first = c("x.seen") > c("y.seen")
    return close.select(
        F.when(first, a).otherwise(b).alias("id"), F.when(first, b).otherwise(a).alias("parent"),
        F.levenshtein(a, b).cast("bigint").alias("distance")
    )


@query("fuzzy_match", NODES_SQL + f"""
, pairs AS (SELECT x.text AS id, y.text AS parent, y.seen AS pseen, {LCS_SQL} AS lcs, length(x.text) + length(y.text) AS total
  FROM nodes x JOIN nodes y ON x.city_n = y.city_n AND (x.seen, x.text) > (y.seen, y.text)
  WHERE least(length(x.text), length(y.text)) * 200 >= (length(x.text) + length(y.text)) * 85)
SELECT id, arg_min(parent, (-lcs * 2.0 / total, pseen, parent)) AS parent, round(max(lcs * 2.0::DOUBLE / total), 6) AS similarity
FROM pairs WHERE lcs * 200 >= total * 85 GROUP BY id
""")
def fuzzy_match(spark, folder):
    """Best earlier street text at or above the threshold."""
    best = rs.best_earlier(cut_lineage(street_nodes(spark, folder)))
    return best.select("id", "parent", F.round("similarity", 6).alias("similarity"))


@query("fuzzy_addresses", f"""
, nodes AS MATERIALIZED (SELECT city AS city_n, city || ' ' || street || ' ' || house_number AS text, min(observed_at) AS seen FROM obs GROUP BY ALL),
  close AS MATERIALIZED (SELECT x.text AS id, y.text AS parent, y.seen AS pseen, length(x.text) + length(y.text) AS total
    FROM nodes x JOIN nodes y ON x.city_n = y.city_n AND (x.seen, x.text) > (y.seen, y.text)
    WHERE least(length(x.text), length(y.text)) * 200 >= (length(x.text) + length(y.text)) * 85
      AND levenshtein(x.text, y.text) <= (length(x.text) + length(y.text)) * 15 // 100),
  pairs AS (SELECT id, parent, pseen, total, {LCS_SQL} AS lcs FROM (SELECT *, {{'text': id}} AS x, {{'text': parent}} AS y FROM close))
SELECT id, arg_min(parent, (-lcs * 2.0 / total, pseen, parent)) AS parent, round(max(lcs * 2.0::DOUBLE / total), 6) AS similarity
FROM pairs WHERE lcs * 200 >= total * 85 GROUP BY id
""")
def fuzzy_addresses(spark, folder):
    """Best earlier address with its house number, of all addresses of a city."""
    text = F.concat_ws(" ", "city", "street", "house_number")
    nodes = observations(spark, folder).groupBy("city", text.alias("text")).agg(F.min("observed_at").alias("first")).select(
        c("text").alias("id"), "text", c("city").alias("city_n"), F.struct("first", c("text").alias("t")).alias("seen"))
    best = rs.best_earlier(cut_lineage(nodes))
    return best.select("id", "parent", F.round("similarity", 6).alias("similarity"))


RESOLVE_SQL = KEYED_SQL + f"""
, units AS (SELECT canonical_id AS id, any_value(city) AS city, any_value(rooms) AS rooms, any_value(sqm // 10) AS area,
    any_value(city || ' ' || street || ' ' || house_number) AS text, min((observed_at, source, source_id)) AS seen FROM keyed GROUP BY canonical_id),
  close AS (SELECT x.id, y.id AS parent, y.seen AS pseen, x.text AS xt, y.text AS yt FROM units x JOIN units y
    ON x.city = y.city AND x.rooms = y.rooms AND x.area = y.area AND x.seen > y.seen
    WHERE least(length(x.text), length(y.text)) * 200 >= (length(x.text) + length(y.text)) * 85
      AND levenshtein(x.text, y.text) <= (length(x.text) + length(y.text)) * 15 // 100),
  measured AS MATERIALIZED (SELECT id, parent, pseen, length(x.text) + length(y.text) AS total, {LCS_SQL} AS lcs
    FROM (SELECT *, {{'text': xt}} AS x, {{'text': yt}} AS y FROM close)),
  links AS (SELECT id, arg_min(parent, (-lcs * 2.0 / total, pseen, parent)) AS parent FROM measured WHERE lcs * 200 >= total * 85 GROUP BY id),
  walk AS (WITH RECURSIVE w AS (SELECT id, parent FROM links UNION ALL SELECT w.id, l.parent FROM w JOIN links l ON w.parent = l.id) SELECT * FROM w),
  tops AS (SELECT id, parent AS root FROM walk WHERE parent NOT IN (SELECT id FROM links))
SELECT source, source_id, canonical_id AS exact_id, coalesce(root, canonical_id) AS canonical_id FROM keyed LEFT JOIN tops ON canonical_id = id
"""


#: What the resolution reads of a listing.
RESOLVED = ["source", "source_id", "street", "house_number", "rooms", "sqm", "city", "first_seen_at"]


@query("resolve_units", RESOLVE_SQL)
def resolve_units(spark, folder):
    """The whole resolution: exact keys, similar addresses of equal size, roots of the links."""
    rows = rs.resolve(rows_with_url(spark, folder).select(*RESOLVED), same_buckets=True)
    return rows.select("source", "source_id", "exact_id", "canonical_id")


RESOLVE_STORED_SQL = KEYED_SQL + f"""
, stored AS (SELECT DISTINCT canonical_id FROM keyed WHERE part_id % 2 = 0),
  units AS (SELECT canonical_id AS id, any_value(city) AS city, any_value(rooms) AS rooms, any_value(sqm // 10) AS area,
    any_value(city || ' ' || street || ' ' || house_number) AS text, canonical_id IN (FROM stored) AS old,
    CASE WHEN canonical_id IN (FROM stored) THEN (0, NULL::TIMESTAMP, '', canonical_id)
      ELSE (1, min((observed_at, source, source_id))[1]::TIMESTAMP, min((observed_at, source, source_id))[2], min((observed_at, source, source_id))[3]) END AS seen
    FROM keyed GROUP BY canonical_id),
  close AS (SELECT x.id, y.id AS parent, y.seen AS pseen, x.text AS xt, y.text AS yt FROM units x JOIN units y
    ON x.city = y.city AND x.rooms = y.rooms AND x.area = y.area AND NOT x.old AND (y.old OR x.seen > y.seen)
    WHERE least(length(x.text), length(y.text)) * 200 >= (length(x.text) + length(y.text)) * 85
      AND levenshtein(x.text, y.text) <= (length(x.text) + length(y.text)) * 15 // 100),
  measured AS MATERIALIZED (SELECT id, parent, pseen, length(x.text) + length(y.text) AS total, {LCS_SQL} AS lcs
    FROM (SELECT *, {{'text': xt}} AS x, {{'text': yt}} AS y FROM close)),
  links AS (SELECT id, arg_min(parent, (-lcs * 2.0 / total, pseen, parent)) AS parent FROM measured WHERE lcs * 200 >= total * 85 GROUP BY id),
  walk AS (WITH RECURSIVE w AS (SELECT id, parent FROM links UNION ALL SELECT w.id, l.parent FROM w JOIN links l ON w.parent = l.id) SELECT * FROM w),
  tops AS (SELECT id, parent AS root FROM walk WHERE parent NOT IN (SELECT id FROM links))
SELECT source, source_id, canonical_id AS exact_id, coalesce(root, canonical_id) AS canonical_id
FROM keyed LEFT JOIN tops ON canonical_id = id WHERE part_id % 2 = 1
"""


@query("resolve_stored", RESOLVE_STORED_SQL)
def resolve_stored(spark, folder):
    """Listings of odd parts resolved against a saved index of the groups of even parts; both halves make up the table."""
    # the latest sighting of every listing serves both halves
    rows = cut_lineage(rows_with_url(spark, folder).select(*RESOLVED, "part_id"))
    even = rs.exact_groups(rows.filter(c("part_id") % 2 == 0)).select("canonical_id", *rs.GROUP_PARTS).distinct()
    index = rs.save_units(rs.stored_units(even, same_buckets=True), f"units_{uuid.uuid4().hex}", 8)
    found = rs.resolve(rows.filter(c("part_id") % 2 == 1), index, same_buckets=True)
    return found.select("source", "source_id", "exact_id", "canonical_id")
