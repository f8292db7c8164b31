"""Bindings of the canonical shapes to the star-schema test tables.

Each view exists twice: as a DataFrame and as the SQL text the results are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; filters and column choice reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt round robin over four tasks a core, in front of work that is heavy per row: a scan makes one task per row group,
    and a million short rows are one or two of them. Rows of equal keys are dealt like any others."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sighting of a listing: lineitem with part, supplier and nation."""
    c = F.col
    item = read_table(spark, folder, "lineitem")
    part = read_table(spark, folder, "part")
    place = read_table(spark, folder, "supplier").join(
        read_table(spark, folder, "nation"), c("s_nationkey") == c("n_nationkey")
    )
    joined = item.join(part, c("l_partkey") == c("p_partkey")).join(
        place, c("l_suppkey") == c("s_suppkey")
    )
    size = c("p_size")
    return joined.select(
        c("l_returnflag").alias("source"),
        F.concat_ws("-", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("source_id"),
        c("n_name").alias("city"), c("p_type").alias("neighborhood"), c("p_name").alias("street"),
        size.cast("string").alias("house_number"),
        (F.lit(1) + (size % 10) / F.lit(2.0)).cast("double").alias("rooms"),
        (F.lit(30) + 3 * F.floor("l_quantity")).cast("int").alias("sqm"),
        F.when(c("l_suppkey") % 7 < 6, c("l_suppkey") % 7).cast("int").alias("floor"),
        F.floor(c("l_extendedprice") * 30).cast("bigint").alias("price"),
        F.floor(c("l_extendedprice") * 30 / (1 - c("l_discount"))).cast("bigint").alias("price_before"),
        (c("l_linestatus") == "O").alias("is_agent"),
        c("l_shipdate").cast("date").alias("observed_at"),
        (F.lit(1950) + size).cast("int").alias("year_built"),
        (F.lit(32.0) + (c("l_suppkey") % 100) / F.lit(1000.0)).alias("lat"),
        (F.lit(34.8) + (c("l_partkey") % 200) / F.lit(1000.0)).alias("lon"),
        c("l_partkey").alias("part_id"), c("l_suppkey").alias("supplier_id"),
        c("l_orderkey").alias("order_id"), c("l_linenumber").alias("line_no"),
    )


OBS_SQL = """
SELECT l_returnflag AS source,
       l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS source_id,
       n_name AS city, p_type AS neighborhood, p_name AS street, p_size::VARCHAR AS house_number,
       (1 + (p_size % 10) / 2.0)::DOUBLE AS rooms,
       (30 + 3 * floor(l_quantity))::INTEGER AS sqm,
       (CASE WHEN l_suppkey % 7 < 6 THEN l_suppkey % 7 END)::INTEGER AS floor,
       floor(l_extendedprice * 30)::BIGINT AS price,
       floor(l_extendedprice * 30 / (1 - l_discount))::BIGINT AS price_before,
       l_linestatus = 'O' AS is_agent, l_shipdate::DATE AS observed_at,
       (1950 + p_size)::INTEGER AS year_built,
       32.0::DOUBLE + (l_suppkey % 100) / 1000.0::DOUBLE AS lat,
       34.8::DOUBLE + (l_partkey % 200) / 1000.0::DOUBLE AS lon,
       l_partkey AS part_id, l_suppkey AS supplier_id, l_orderkey AS order_id, l_linenumber AS line_no
FROM lineitem JOIN part ON l_partkey = p_partkey
     JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

KEY = ["source", "source_id"]
#: The key as sorts compare it: a sort looks at the first bytes of its first column before it reads rows, and sources are few.
SORT_KEY = ["source_id", "source"]
NEWEST = ["observed_at DESC", "price DESC", "part_id", "supplier_id", "sqm", "price_before", "is_agent"]


def newest_order() -> list:
    return [
        F.desc("observed_at"), F.desc("price"), F.asc("part_id"), F.asc("supplier_id"), F.asc("sqm"),
        F.asc("price_before"), F.asc("is_agent"),
    ]


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Latest sighting per listing."""
    from hearthline.operators.windows import first_per_key

    return first_per_key(observations(spark, folder), SORT_KEY, newest_order())


LISTINGS_SQL = f"""
SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY {', '.join(NEWEST)}) AS _rn
  FROM obs) WHERE _rn = 1
"""


def deals(spark: SparkSession, folder: str) -> DataFrame:
    """Closed deals: sightings whose order is finished."""
    from hearthline.functions.text import address_hash

    c = F.col
    closed = read_table(spark, folder, "orders").filter(c("o_orderstatus") == "F").select(
        c("o_orderkey").alias("order_id"), c("o_orderdate").cast("date").alias("deal_date")
    )
    return observations(spark, folder).join(closed, "order_id").select(
        F.lit("registry").alias("provider"),
        address_hash(c("city"), c("neighborhood"), c("street"), c("house_number")).alias("address_hash"),
        "deal_date", "price", "sqm", "rooms", "city", "neighborhood", "street", "house_number",
        "year_built", "observed_at", "source_id",
    )


DEALS_SQL = """
SELECT 'registry' AS provider,
       sha1(lower(city || '|' || neighborhood || '|' || street || '|' || house_number))[1:16] AS address_hash,
       o_orderdate::DATE AS deal_date, price, sqm, rooms, city, neighborhood, street, house_number,
       year_built, observed_at, source_id
FROM obs JOIN orders ON order_id = o_orderkey WHERE o_orderstatus = 'F'
"""


def with_views(sql: str) -> str:
    """Prefix a query with the bindings it may use."""
    return (
        f"WITH obs AS ({OBS_SQL}), listings AS ({LISTINGS_SQL}), deals AS ({DEALS_SQL}), "
        f"history AS ({HISTORY_SQL}), texts AS ({TEXTS_SQL}), posts AS ({POSTS_SQL}) {sql}"
    )


def price_history(spark: SparkSession, folder: str) -> DataFrame:
    """Price sightings over time: events keyed by (event_type, user)."""
    c = F.col
    return read_table(spark, folder, "events").select(
        c("event_type").alias("source"), c("user_id").cast("string").alias("source_id"),
        c("ts").cast("timestamp").alias("ts"), c("value").alias("price"), c("event_id"),
    )


HISTORY_SQL = """
SELECT event_type AS source, user_id::VARCHAR AS source_id, ts, value AS price, event_id FROM events
"""


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions with tags."""
    return read_table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("description"), F.array("lang", "source").alias("tags"),
        "lang", "source",
    )


TEXTS_SQL = "SELECT doc_id, text AS description, [lang, source] AS tags, lang, source FROM documents"


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Social posts: one per conversation turn."""
    c = F.col
    return read_table(spark, folder, "conversations").select(
        F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("post_id"),
        "text", c("role").alias("group_id"), "conv_id", "turn",
    )


POSTS_SQL = """
SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS post_id, text, role AS group_id, conv_id, turn
FROM conversations
"""
