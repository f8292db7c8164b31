"""Alerts, watches, payloads and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.functions.numeric import price_per_area
from hearthline.functions.text import title_of
from hearthline.operators import alerts as al, filters as flt, runs, state as st
from hearthline.plans.queries_state import HALVES_SQL, NOW, halves
from hearthline.plans.registry import query
from hearthline.schema import FREE_ITEM, align_to_schema
from hearthline.sources.tables import listings, posts

c = F.col
SCORE = lambda: (c("part_id") % 100).cast("double") / F.lit(10.0)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    old, new = halves(spark, folder)
    merged = st.upsert(old, new, F.lit(NOW).cast("timestamp"))
    return merged.withColumn("score", SCORE()).withColumn("alert", runs.alert_kind(7.0, 3.0))


ALERT_SQL = HALVES_SQL + """
, al AS (SELECT n.*, (n.part_id % 100)::DOUBLE / 10.0::DOUBLE AS score, o.price AS prev_price,
   CASE WHEN n.floor IS NULL OR n.floor <= 2 THEN CASE WHEN o.price IS NULL AND (n.part_id % 100)::DOUBLE / 10.0::DOUBLE >= 7.0 THEN 'new'
     WHEN o.price > n.price AND (o.price - n.price)::DOUBLE / o.price::DOUBLE * 100 >= 3.0 THEN 'price_drop' END END AS alert
   FROM new n LEFT JOIN old o USING (source, source_id))
"""


@query("alert_kinds", ALERT_SQL + "SELECT source, source_id, alert, score, prev_price FROM al WHERE alert IS NOT NULL")
def alert_kinds(spark, folder):
    return changes(spark, folder).filter(c("alert").isNotNull()).select("source", "source_id", "alert", "score", "prev_price")


@query("price_drop_alerts", ALERT_SQL + """
SELECT source, source_id, price, prev_price, round((prev_price - price)::DOUBLE / prev_price::DOUBLE * 100, 4) AS drop_pct
FROM al WHERE alert = 'price_drop'
""")
def price_drop_alerts(spark, folder):
    from hearthline.functions.numeric import drop_percent

    return changes(spark, folder).filter(c("alert") == "price_drop").select(
        "source", "source_id", "price", "prev_price",
        F.round(drop_percent(c("prev_price"), c("price")), 4).alias("drop_pct"),
    )


@query("top_alerts", ALERT_SQL + """
, capped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY observed_at, source_id) AS alert_no FROM al WHERE alert IS NOT NULL)
SELECT source, source_id, alert_no, '🔥 <b>הזדמנות! [' || score::VARCHAR || '/10]</b>' || chr(10) || '📍 ' || street || ' ' || house_number || chr(10)
  || '💰 ₪' || format('{:,}', price) || ' (' || format('{:,}', round_even(price::DOUBLE / sqm::DOUBLE, 0)::BIGINT) || '/מ"ר)'
  || CASE WHEN line_no % 2 = 0 THEN chr(10) || '🎯 הערכה: ₪' || format('{:,}', price + 1000) ELSE '' END || chr(10)
  || '🛏 ' || rooms::VARCHAR || ' חד׳ | 📐 ' || sqm::VARCHAR || 'מ"ר | קומה ' || coalesce(floor::VARCHAR, '?') || chr(10)
  || '🏷 מקור: ' || source || chr(10) || 'https://board.example/?a=1&amp;id=' || source_id AS message
FROM capped WHERE alert_no <= 10
""")
def top_alerts(spark, folder):
    rows = changes(spark, folder).filter(c("alert").isNotNull()).withColumns({
        "address": F.concat_ws(" ", "street", "house_number"), "price_per_sqm_eff": price_per_area(c("price"), c("sqm")),
        "fair_price_estimate": F.when(c("line_no") % 2 == 0, c("price") + 1000),
        "url": F.concat(F.lit("https://board.example/?a=1&id="), c("source_id")),
    })
    return al.outbox(rows, al.listing_message(), ["source"], [F.asc("observed_at"), F.asc("source_id")], 10).select(
        "source", "source_id", c("alert_no").cast("bigint").alias("alert_no"), "message"
    )


TOPICS = [flt.Topic("motion", [r"tion"]), flt.Topic("accents", [r"é[a-z]+", r"ñ"])]


def linked_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of turn 9 have no link."""
    return posts(spark, folder).withColumn("url", F.when(c("turn") != 9, F.concat(F.lit("https://social.example/"), c("post_id"))))


def post_items(spark: SparkSession, folder: str) -> DataFrame:
    return items_of(linked_posts(spark, folder))


def items_of(linked: DataFrame) -> DataFrame:
    """Matching posts as free items."""
    return al.topic_items(linked, TOPICS, F.lit("2026-01-02").cast("date"), F.concat(F.lit("group "), c("group_id")))


SPACES = r"[\s\x{0B}\x{85}\p{Z}]"
ITEMS_SQL = f"""
, items AS (SELECT *, CASE WHEN m1 AND m2 THEN 'motion, accents' WHEN m1 THEN 'motion' ELSE 'accents' END || ' · group ' || group_id AS watch_label,
   coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'),
    lambda x: trim(regexp_replace(x, '{SPACES}+', ' ', 'g'))), lambda x: x <> '')[1], '') AS line
   FROM (SELECT *, regexp_matches(text, '(?i)tion') AS m1, regexp_matches(text, '(?i)é[a-z]+|ñ') AS m2 FROM posts)
   WHERE (m1 OR m2) AND turn <> 9),
 watch AS (SELECT *, CASE WHEN length(line) > 160 THEN line[1:159] || '…' ELSE line END AS title, conv_id % 3 = 0 AS known FROM items)
"""


@query("watch_scan", ITEMS_SQL + """
SELECT watch_label, count(*) AS fetched, count(*) FILTER (NOT known) AS new,
  count(*) FILTER (NOT known AND rn <= 20) AS alerted
FROM (SELECT *, row_number() OVER (PARTITION BY watch_label, known ORDER BY post_id) AS rn FROM watch) GROUP BY watch_label
""")
def watch_scan(spark, folder):
    """L6/B7/AG10: match, merge into the stored items, count per watch; 20 alerts per watch at most."""
    return runs.free_item_counters(watch_run(spark, folder))


@query("free_scan_log", ITEMS_SQL + """
SELECT '2026-01-01' AS day, watch_label, 1 AS fetched, 0 AS new, 0 AS alerted, 'timeout' AS errors FROM (SELECT DISTINCT watch_label FROM watch)
UNION ALL
SELECT '2026-01-02', watch_label, count(*), count(*) FILTER (NOT known), count(*) FILTER (NOT known AND rn <= 20), ''
FROM (SELECT *, row_number() OVER (PARTITION BY watch_label, known ORDER BY post_id) AS rn FROM watch) GROUP BY watch_label
""")
def free_scan_log(spark, folder):
    """A run's rows appended to the log of the runs before."""
    seen = watch_run(spark, folder)
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp")
    before = seen.select("watch_label").distinct().select(
        at("2026-01-01").alias("ts"), "watch_label", F.lit(1).cast("bigint").alias("fetched"), F.lit(0).cast("bigint").alias("new"),
        F.lit(0).cast("bigint").alias("alerted"), F.lit("timeout").alias("errors"))
    log = runs.append_log(before, runs.free_scan_rows(seen, at("2026-01-02")))
    return log.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "watch_label", "fetched", "new", "alerted", "errors")


def watch_run(spark: SparkSession, folder: str) -> DataFrame:
    merged = watch_merge(spark, folder)
    fresh = al.outbox(merged.filter("is_new"), al.free_item_message(), ["watch_label"], [F.asc("source_id")], 20)
    sent = fresh.select("source", "source_id", F.lit(True).alias("alerted"))
    flagged = merged.join(sent, ["source", "source_id"], "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    return flagged.filter("seen")


def watch_merge(spark: SparkSession, folder: str, seed_only: bool = False) -> DataFrame:
    items = post_items(spark, folder)
    conv = F.split_part("source_id", F.lit("-"), F.lit(1)).cast("bigint")
    then = F.lit("2026-01-01 00:00:00").cast("timestamp")
    stored = align_to_schema(
        items.filter(conv % 3 == 0).withColumns({
            "first_seen_at": then, "last_seen_at": then, "alerted_at": then, "watch_label": F.lit("old label")}), FREE_ITEM)
    merged = st.touch_free_items(stored, items, F.lit("2026-01-02 00:00:00").cast("timestamp"), seed_only)
    return merged.withColumn("seen", F.lit(True))


@query("free_item_state", ITEMS_SQL + """
SELECT post_id AS source_id, watch_label, sha256(title) AS title, CASE WHEN known THEN '2026-01-01' ELSE '2026-01-02' END AS first_seen,
  '2026-01-02' AS last_seen, CASE WHEN known THEN '2026-01-01' END AS alerted_at, (NOT known)::INTEGER AS is_new FROM watch
""")
def free_item_state(spark, folder):
    day = lambda n: F.date_format(n, "yyyy-MM-dd")
    return watch_merge(spark, folder).select(
        "source_id", "watch_label", F.sha2("title", 256).alias("title"), day("first_seen_at").alias("first_seen"),
        day("last_seen_at").alias("last_seen"), day("alerted_at").alias("alerted_at"), c("is_new").cast("int").alias("is_new"),
    )


@query("seed_only_items", ITEMS_SQL + """
SELECT count(*) AS items, count(*) FILTER (known) AS known, count(*) AS alerted FROM watch
""")
def seed_only_items(spark, folder):
    """L5 seeding: everything counts as alerted, nothing is sent."""
    return watch_merge(spark, folder, seed_only=True).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(~c("is_new")).alias("known"), F.count("alerted_at").alias("alerted")
    )


@query("new_item_alerts", ITEMS_SQL + """
SELECT post_id AS source_id, '🆕 <b>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
  || '</b>' || chr(10) || '🔍 ' || watch_label || chr(10) || 'https://social.example/' || post_id AS message
FROM watch WHERE NOT known
""")
def new_item_alerts(spark, folder):
    """Items that are not stored yet, with their alert text."""
    items = post_items(spark, folder)
    conv = F.split_part("source_id", F.lit("-"), F.lit(1)).cast("bigint")
    return al.unseen(items, items.filter(conv % 3 == 0)).select("source_id", al.free_item_message().alias("message"))


@query("mark_alerted", """
SELECT source, source_id, CASE WHEN part_id % 3 = 0 THEN 'sent' ELSE 'open' END AS alert_state FROM listings
""")
def mark_alerted(spark, folder):
    rows = listings(spark, folder)
    state = rows.withColumn("alert_state", F.lit("open"))
    return st.mark(state, rows.filter(c("part_id") % 3 == 0), "alert_state", F.lit("sent")).select(
        "source", "source_id", "alert_state"
    )


@query("comps_worklist", """
SELECT DISTINCT lower(city) AS city, lower(street) AS street FROM (SELECT * FROM listings
  ORDER BY (part_id % 100)::DOUBLE / 10.0::DOUBLE DESC, source, source_id LIMIT 500)
""")
def comps_worklist(spark, folder):
    return al.comps_worklist(listings(spark, folder).withColumn("score", SCORE()), 500)


@query("listings_payload", """
SELECT source, source_id, '{"source":"' || source || '","source_id":"' || source_id || '","price":' || price || ',"floor":' ||
  coalesce(floor::VARCHAR, 'null') || ',"rooms_eff":' || rooms::VARCHAR || ',"price_per_sqm_eff":' || round_even(price::DOUBLE / sqm::DOUBLE, 0)::BIGINT
  || ',"tags":["' || city || '","' || street || '"],"first_listed_date":"' || observed_at::VARCHAR || '","building_age":' || (2001 - year_built) || '}' AS payload
FROM listings WHERE floor IS NULL OR floor <= 2
""")
def listings_payload(spark, folder):
    from hearthline.schema import canonical

    rows = canonical(listings(spark, folder).withColumns({
        "tags": F.array("city", "street"), "publish_date": c("observed_at"), "first_seen_at": c("observed_at"), "score": SCORE(),
    }))
    view = al.dashboard(rows, F.lit("2001-08-01").cast("date"))
    body = view.orderBy(*al.dashboard_order()).select(
        "source", "source_id", "price", "floor", "rooms_eff", "price_per_sqm_eff", "tags", "first_listed_date", "building_age"
    )
    return al.as_json(body, ["source", "source_id"])


@query("dedup_payload", """
, keyed AS (SELECT *, 'CAN-' || sha1(street || '|' || house_number || '|' || rooms::VARCHAR || '|' || (sqm // 10 * 10)::VARCHAR || '|' || city)[1:12] AS canonical_id FROM listings)
SELECT canonical_id, '{"canonical_id":"' || canonical_id || '","member_count":' || count(*) || ',"price_spread":' || (max(price) - min(price))
 || ',"sources":["' || array_to_string(list_sort(list(DISTINCT source)), '","') || '"]}' AS payload
FROM keyed GROUP BY canonical_id HAVING count(*) > 1
""")
def dedup_payload(spark, folder):
    from hearthline.operators.resolve import duplicate_groups, exact_groups

    grouped = exact_groups(listings(spark, folder).withColumn("url", c("source_id")))
    groups = duplicate_groups(grouped).select("canonical_id", "member_count", "price_spread", "sources")
    return al.as_json(groups, ["canonical_id"])
