"""Keyed state: upserts, history, edits, deletes, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline import lexicons as lx, schema
from hearthline.operators import runs, scoring, state as st
from hearthline.operators.extractions import apply_extractions, zip_results
from hearthline.operators.windows import first_per_key, fixed_batches, previous_value, top_per_key
from hearthline.plans.queries_scores import AS_OF as SCORE_AS_OF, CONFIG, SCORE_SQL, TOTAL_SQL, scored_rows
from hearthline.plans.registry import query
from hearthline.sources.tables import (
    NEWEST, SORT_KEY, deals, listings, newest_order, observations, price_history, texts,
)

c = F.col
SPLIT = "1998-07-01"
NOW = "1998-07-01 12:00:00"


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """State before the split date, batch after it; both with one row per key."""
    obs = observations(spark, folder)
    pick = lambda df: first_per_key(df, SORT_KEY, newest_order())
    old = pick(obs.filter(c("observed_at") < SPLIT)).withColumns({
        "publish_date": c("observed_at"), "first_listed_date": F.date_sub("observed_at", 5),
        "first_seen_at": c("observed_at").cast("timestamp"), "last_seen_at": c("observed_at").cast("timestamp"),
        "is_favorite": c("line_no") == 1, "user_notes": F.concat(F.lit("note "), c("street")),
        "rooms_user": F.when(c("line_no") == 2, 9.5), "canonical_id": F.concat(F.lit("CAN-"), c("street")),
    })
    new = pick(obs.filter(c("observed_at") >= SPLIT)).withColumns({
        "publish_date": c("observed_at"), "first_listed_date": F.lit(None).cast("date"),
        "canonical_id": F.lit(None).cast("string"),
    })
    return old, new


HALVES_SQL = f"""
, old AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY {', '.join(NEWEST)}) AS rn
    FROM obs WHERE observed_at < DATE '{SPLIT}') WHERE rn = 1),
  new AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY {', '.join(NEWEST)}) AS rn
    FROM obs WHERE observed_at >= DATE '{SPLIT}') WHERE rn = 1)
"""


@query("upsert_listings", HALVES_SQL + f"""
SELECT source, source_id, coalesce(n.price, o.price) AS price, coalesce(n.street, o.street) AS street,
  CASE WHEN n.price IS NULL THEN (o.observed_at - 5)::VARCHAR WHEN o.price IS NULL THEN n.observed_at::VARCHAR
       ELSE least(n.observed_at, o.observed_at - 5)::VARCHAR END AS first_listed_date,
  strftime(CASE WHEN o.price IS NULL THEN TIMESTAMP '{NOW}' ELSE o.observed_at::TIMESTAMP END, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
  strftime(CASE WHEN n.price IS NULL THEN o.observed_at::TIMESTAMP ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S') AS last_seen_at,
  CASE WHEN o.price IS NOT NULL THEN 'note ' || o.street END AS user_notes,
  CASE WHEN o.line_no = 2 THEN 9.5 END::DOUBLE AS rooms_user,
  CASE WHEN n.price IS NULL THEN 'CAN-' || o.street WHEN n.street = o.street THEN 'CAN-' || o.street END AS canonical_id,
  CASE WHEN n.price IS NULL THEN 'kept' WHEN o.price IS NULL THEN 'new' ELSE 'updated' END AS change,
  CASE WHEN n.price <> o.price THEN o.price END AS prev_price
FROM old o FULL OUTER JOIN new n USING (source, source_id)
""")
def upsert_listings(spark, folder):
    old, new = halves(spark, folder)
    merged = st.upsert(old, new, F.lit(NOW).cast("timestamp"), canonical_inputs=("street",))
    text = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return merged.select(
        "source", "source_id", "price", "street", c("first_listed_date").cast("string").alias("first_listed_date"),
        text("first_seen_at"), text("last_seen_at"), "user_notes", "rooms_user", "canonical_id", "change", "prev_price",
    )


@query("price_history", f"""
SELECT source, source_id, observed_at::VARCHAR AS ts, price FROM (
  SELECT *, row_number() OVER (PARTITION BY source, source_id, observed_at ORDER BY late, price) AS rn FROM (
    SELECT source, source_id, observed_at, price, (observed_at >= DATE '{SPLIT}')::INTEGER AS late FROM obs)) WHERE rn = 1
""")
def price_history_query(spark, folder):
    rows = observations(spark, folder).select("source", "source_id", c("observed_at").cast("timestamp").alias("ts"), "price")
    cut = F.lit(SPLIT).cast("timestamp")
    full = st.append_history(rows.filter(c("ts") < cut), rows.filter(c("ts") >= cut))
    return full.select("source", "source_id", c("ts").cast("date").cast("string").alias("ts"), "price")


@query("price_changes", """
SELECT event_id, previous, (previous <> price)::INTEGER AS changed,
  coalesce(CASE WHEN previous > price THEN (previous - price) / previous * 100 >= 3.0 END, false)::INTEGER AS dropped
FROM (SELECT *, lag(price) OVER (PARTITION BY source, source_id ORDER BY ts, event_id) AS previous FROM history)
WHERE previous IS NOT NULL
""")
def price_changes(spark, folder):
    from hearthline.functions.numeric import drop_percent

    rows = previous_value(
        price_history(spark, folder), ["source", "source_id"], ["ts", "event_id"], "price", F.to_date("ts"), "previous"
    ).filter(c("previous").isNotNull())
    return rows.select(
        "event_id", "previous", (c("previous") != c("price")).cast("int").alias("changed"),
        F.coalesce(drop_percent(c("previous"), c("price")) >= 3.0, F.lit(False)).cast("int").alias("dropped"),
    )


@query("upsert_comps", f"""
SELECT address_hash, deal_date::VARCHAR AS deal_date, price, sqm, rooms FROM (
  SELECT *, row_number() OVER (PARTITION BY address_hash, deal_date, price ORDER BY observed_at DESC, sqm, rooms, source_id) AS rn
  FROM deals) WHERE rn = 1
""")
def upsert_comps(spark, folder):
    rows = deals(spark, folder).withColumn("fetched_at", c("observed_at").cast("timestamp"))
    cut = F.lit(SPLIT).cast("timestamp")
    kept, _ = st.upsert_comps(
        rows.filter(c("fetched_at") < cut), rows.filter(c("fetched_at") >= cut), [F.asc("sqm"), F.asc("rooms"), F.asc("source_id")]
    )
    return kept.select("address_hash", c("deal_date").cast("string").alias("deal_date"), "price", "sqm", "rooms")


@query("rejected_comps", "SELECT count(*) AS rejected FROM deals WHERE contains(street, 'red')")
def rejected_comps(spark, folder):
    rows = deals(spark, folder).withColumns({
        "fetched_at": c("observed_at").cast("timestamp"),
        "address_hash": F.when(~c("street").contains("red"), c("address_hash")),
    })
    _, rejected = st.upsert_comps(rows.filter(F.lit(False)), rows)
    return rejected.agg(F.count(F.lit(1)).alias("rejected"))


LOG_SQL = """
, log AS (SELECT source, date_trunc('hour', ts) AS ts, count(*) FILTER (price > 25) AS fetched, count(*) FILTER (price > 60) AS new
  FROM history GROUP BY ALL)
"""


def scan_log(spark: SparkSession, folder: str) -> DataFrame:
    """One run per source and hour of the price events."""
    return price_history(spark, folder).groupBy("source", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count_if(c("price") > 25).alias("fetched"), F.count_if(c("price") > 60).alias("new")
    )


@query("scan_log", LOG_SQL + """
SELECT source, strftime(ts, '%Y-%m-%d %H') AS ts, fetched, new, 0::BIGINT AS alerted FROM log
""")
def scan_log_query(spark, folder):
    log = scan_log(spark, folder)
    early = log.filter(c("ts") < "2024-01-15").withColumn("alerted", F.lit(0).cast("bigint"))
    late = log.filter(c("ts") >= "2024-01-15")
    full = runs.append_log(early, late)
    return full.select(
        "source", F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), "fetched", "new",
        F.coalesce("alerted", F.lit(0)).cast("bigint").alias("alerted"),
    )


@query("latest_scan", LOG_SQL + """
SELECT source, strftime(max(ts), '%Y-%m-%d %H') AS latest_scan FROM log WHERE fetched > 0 GROUP BY source
""")
def latest_scan(spark, folder):
    return runs.latest_success(scan_log(spark, folder)).select(
        "source", F.date_format("latest_scan", "yyyy-MM-dd HH").alias("latest_scan")
    )


@query("scan_summary", HALVES_SQL + """
SELECT source, count(*) AS fetched, count(*) FILTER (o.price IS NULL) AS new, count(*) FILTER (o.price IS NOT NULL) AS updated,
  count(*) FILTER (o.price > n.price AND (o.price - n.price)::DOUBLE / o.price::DOUBLE * 100 >= 3.0) AS price_drops
FROM new n LEFT JOIN old o USING (source, source_id) GROUP BY source
""")
def scan_summary(spark, folder):
    old, new = halves(spark, folder)
    return runs.scan_summary(st.upsert(old, new, F.lit(NOW).cast("timestamp")))


@query("table_head", "SELECT count(*) AS count, max(observed_at)::VARCHAR AS last_updated FROM listings")
def table_head(spark, folder):
    rows = listings(spark, folder).withColumn("last_seen_at", c("observed_at"))
    return runs.table_head(rows).withColumn("last_updated", c("last_updated").cast("string"))


@query("user_edits", """
SELECT source, source_id, CASE WHEN line_no IN (1, 2) THEN true ELSE part_id % 2 = 0 END::INTEGER AS is_favorite,
  sha256(CASE WHEN line_no = 1 THEN left(repeat(street || ' ', 400), 2000) ELSE 'old' END) AS notes_hash,
  CASE WHEN line_no = 2 THEN NULL WHEN line_no = 3 THEN 4.5 ELSE 2.0 END::DOUBLE AS rooms_user,
  (line_no <= 3)::INTEGER AS matched FROM listings
""")
def user_edits(spark, folder):
    rows = listings(spark, folder)
    state = rows.select(
        "source", "source_id", (c("part_id") % 2 == 0).alias("is_favorite"), F.lit("old").alias("user_notes"),
        F.lit(2.0).alias("rooms_user"),
    )
    mask = (
        F.when(c("line_no") == 1, F.array(F.lit("is_favorite"), F.lit("user_notes")))
        .when(c("line_no") == 2, F.array(F.lit("is_favorite"), F.lit("rooms_user")))
        .otherwise(F.array(F.lit("rooms_user"), F.lit("user_notes")))
    )
    edits = rows.filter(c("line_no") <= 3).select(
        "source", "source_id", mask.alias("set_mask"), F.lit(True).alias("is_favorite"),
        F.when(c("line_no") == 1, F.repeat(F.concat("street", F.lit(" ")), 400)).alias("user_notes"),
        F.when(c("line_no") == 3, 4.5).alias("rooms_user"),
    )
    return st.apply_user_edits(state, edits).select(
        "source", "source_id", c("is_favorite").cast("int").alias("is_favorite"),
        F.sha2("user_notes", 256).alias("notes_hash"), "rooms_user", c("matched").cast("int").alias("matched"),
    )


@query("delete_keys", """
SELECT 'listings' AS tbl, source, source_id, price FROM listings WHERE NOT contains(street, 'blue')
UNION ALL SELECT 'price_history', source, source_id, price FROM obs o WHERE NOT EXISTS (
  SELECT 1 FROM listings l WHERE l.source = o.source AND l.source_id = o.source_id AND contains(l.street, 'blue'))
""")
def delete_keys(spark, folder):
    rows = listings(spark, folder).select("source", "source_id", "price", "street")
    history = observations(spark, folder).select("source", "source_id", "price")
    kept = st.delete_keys({"listings": rows, "price_history": history}, rows.filter(c("street").contains("blue")))
    pick = lambda name: kept[name].select(F.lit(name).alias("tbl"), "source", "source_id", "price")
    return pick("listings").unionByName(pick("price_history"))


@query("purge", """
, p AS (SELECT *, observed_at < DATE '1997-01-01' AND (line_no = 1 OR observed_at + 200 < DATE '1997-01-01') AS gone FROM listings)
SELECT source, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS purged FROM p GROUP BY source
""")
def purge(spark, folder):
    rows = listings(spark, folder).withColumns({
        "first_seen_at": c("observed_at").cast("timestamp"),
        "publish_date": F.when(c("line_no") != 1, F.date_add("observed_at", 200)),
    })
    cutoff = F.lit("1997-01-01").cast("timestamp")
    return rows.groupBy("source").agg(
        F.count_if(~F.coalesce(st.expired(cutoff), F.lit(False))).alias("kept"),
        F.count_if(st.expired(cutoff)).alias("purged"),
    )


@query("purge_cascade", """
, gone AS (SELECT source, source_id FROM listings WHERE observed_at < DATE '1997-01-01'
    AND (line_no = 1 OR observed_at + 200 < DATE '1997-01-01'))
SELECT source, source_id, observed_at::VARCHAR AS observed_at, price FROM obs ANTI JOIN gone USING (source, source_id)
""")
def purge_cascade(spark, folder):
    rows = listings(spark, folder).withColumns({
        "first_seen_at": c("observed_at").cast("timestamp"),
        "publish_date": F.when(c("line_no") != 1, F.date_add("observed_at", 200)),
    })
    history = observations(spark, folder).select("source", "source_id", c("observed_at").cast("string").alias("observed_at"), "price")
    return st.purge(rows, F.lit("1997-01-01").cast("timestamp"), history)["price_history"]


@query("reset_source", """
SELECT 'listings' AS "table", count(*) FILTER (source = 'A') AS deleted FROM listings
UNION ALL SELECT 'price_history', count(*) FILTER (source = 'A') FROM obs
""")
def reset_source(spark, folder):
    tables = {
        "listings": listings(spark, folder).select("source", "source_id"),
        "price_history": observations(spark, folder).select("source", "source_id"),
        "comps": deals(spark, folder).select("provider"),
    }
    return st.reset(tables, "A")[1]


@query("migrate_schema", """
SELECT source, source_id, street, '' AS user_notes, 0 AS is_favorite, sqm, CASE WHEN line_no > 99 THEN 1 END AS lot_sqm FROM listings
""")
def migrate_schema(spark, folder):
    old = listings(spark, folder).withColumn("street", F.when(c("street") != "", c("street")))
    return schema.canonical(old).select(
        "source", "source_id", "street", "user_notes", c("is_favorite").cast("int").alias("is_favorite"), "sqm", "lot_sqm"
    )


@query("rescore", SCORE_SQL + f"""
SELECT source, source_id, CASE WHEN source = 'R' THEN 1.5::DOUBLE ELSE
  greatest(1.0::DOUBLE, least(10.0::DOUBLE, {TOTAL_SQL})) END AS score FROM parts
""")
def rescore(spark, folder):
    """New score for every valid row; rows of an unknown source keep theirs."""
    rows = scored_rows(spark, folder).withColumn("stored", F.lit(1.5))
    scored = scoring.score(rows, F.lit(SCORE_AS_OF).cast("date"), CONFIG)
    valid = c("source").isin("A", "N") & c("price").isNotNull()
    return scored.select("source", "source_id", F.when(valid, c("score")).otherwise(c("stored")).alias("score"))


@query("carry_over", """
SELECT f.doc_id, CASE WHEN f.doc_id % 3 = 0 THEN 7 WHEN p.doc_id IS NOT NULL AND f.doc_id % 4 <> 1 THEN p.doc_id % 50 END::BIGINT AS sqm,
  (p.doc_id IS NOT NULL AND f.doc_id % 4 <> 1 AND f.doc_id % 3 <> 0)::INTEGER AS cache_hit
FROM documents f LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 2) p ON f.doc_id = p.doc_id
""")
def carry_over(spark, folder):
    docs = texts(spark, folder).select("source", c("doc_id").cast("string").alias("source_id"), "description", "doc_id")
    fresh = docs.withColumn("sqm", F.when(c("doc_id") % 3 == 0, 7).cast("bigint")).drop("doc_id")
    prior = docs.filter(c("doc_id") % 5 != 2).withColumns({
        "sqm": (c("doc_id") % 50).cast("bigint"),
        "description": F.when(c("doc_id") % 4 == 1, F.concat("description", F.lit("!"))).otherwise(c("description")),
    }).drop("doc_id")
    return st.carry_over(fresh, prior, ["sqm"]).select(
        c("source_id").cast("bigint").alias("doc_id"), "sqm", c("cache_hit").cast("int").alias("cache_hit")
    )


@query("apply_extractions", """
, b AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS pos FROM texts),
  r AS (SELECT *, pos // 20 AS bn FROM b),
  ok AS (SELECT lang, bn, count(*) = count(*) FILTER (doc_id % 97 <> 5) AS good FROM r GROUP BY ALL)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 55 WHEN good AND doc_id % 300 BETWEEN 10 AND 10000 THEN doc_id % 300 END::BIGINT AS sqm,
  CASE WHEN good THEN doc_id % 2 END::INTEGER AS parking, good::INTEGER AS accepted
FROM r JOIN ok USING (lang, bn)
""")
def apply_extractions_query(spark, folder):
    rows = fixed_batches(texts(spark, folder).select("doc_id", "lang"), ["lang"], ["doc_id"], 20, F.floor(c("doc_id") / 4096))
    results = rows.filter(c("doc_id") % 97 != 5).select(
        "lang", "batch_no", "idx", (c("doc_id") % 300).cast("string").alias("sqm"), (c("doc_id") % 2 == 1).alias("parking")
    )
    wanted = rows.withColumns({
        "sqm": F.when(c("doc_id") % 4 == 0, 55).cast("int"), "parking": F.lit(None).cast("boolean"),
    })
    filled = apply_extractions(zip_results(wanted, results, ["lang", "batch_no"]))
    return filled.select(
        "doc_id", c("sqm").cast("bigint").alias("sqm"), c("parking").cast("int").alias("parking"),
        c("accepted").cast("int").alias("accepted"),
    )


@query("cap_per_source", """
SELECT source, source_id, observed_at::VARCHAR AS observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY observed_at DESC, source_id) AS rn FROM listings) WHERE rn <= 250
""")
def cap_per_source(spark, folder):
    """Max items per source is the feature; tasks keep at most 250 rows per source."""
    return top_per_key(listings(spark, folder), ["source"], [F.desc("observed_at"), F.asc("source_id")], 250).select(
        "source", "source_id", c("observed_at").cast("string").alias("observed_at")
    )


@query("union_sources", """
SELECT 'item:' || source AS source, source_id, price, neighborhood AS listing_type FROM listings WHERE source = 'A'
UNION ALL SELECT 'item:' || source, source_id, price, '' FROM listings WHERE source <> 'A'
UNION ALL SELECT 'event:' || source, event_id::VARCHAR, floor(price)::BIGINT, '' FROM history
""")
def union_sources(spark, folder):
    """H1: feeds with different columns in one canonical table."""
    rows = listings(spark, folder)
    a = rows.filter(c("source") == "A").select(
        F.concat(F.lit("item:"), "source").alias("source"), "source_id", "price", c("neighborhood").alias("listing_type"))
    n = rows.filter(c("source") != "A").select(F.concat(F.lit("item:"), "source").alias("source"), "source_id", "price")
    e = price_history(spark, folder).select(
        F.concat(F.lit("event:"), "source").alias("source"), c("event_id").cast("string").alias("source_id"),
        F.floor("price").cast("bigint").alias("price"))
    full = a.unionByName(n, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
    return schema.canonical(full).select("source", "source_id", "price", "listing_type")


@query("array_union_tags", """
SELECT source, source_id, array_to_string(CASE WHEN line_no % 2 = 0 THEN [city, street] ELSE [street] END ||
  CASE WHEN line_no % 3 = 0 THEN [neighborhood] ELSE [] END, ',') AS tags,
  array_to_string(CASE WHEN line_no % 5 = 0 THEN [house_number] ELSE [] END || ['a', 'b'], ',') AS images FROM listings
""")
def array_union_tags(spark, folder):
    """H4/H5: ordered set union of tags, cover image put first when absent."""
    rows = listings(spark, folder)
    have = F.when(c("line_no") % 2 == 0, F.array("city", "street")).otherwise(F.array("street"))
    more = F.when(c("line_no") % 3 == 0, F.array("street", "neighborhood")).otherwise(F.array("street"))
    images = F.array(F.lit("a"), F.lit("b"))
    cover = F.when(c("line_no") % 5 == 0, c("house_number")).otherwise("b")
    return rows.select(
        "source", "source_id", F.array_join(F.array_union(have, more), ",").alias("tags"),
        F.array_join(F.when(~F.array_contains(images, cover), F.concat(F.array(cover), images)).otherwise(images), ",").alias("images"),
    )
