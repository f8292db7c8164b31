"""Streams over stored tables and the composed scan cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators.filters import SearchConfig
from hearthline.operators.scoring import ScoreConfig
from hearthline.operators.windows import first_per_key
from hearthline.plans.queries_alerts import ITEMS_SQL, items_of, linked_posts
from hearthline.plans.queries_scores import AS_OF, CONFIG, SCORE_SQL, TOTAL_SQL, scored_rows
from hearthline.plans.queries_valuation import PRICED_SQL
from hearthline.plans import bronze
from hearthline.plans.registry import query
from hearthline.plans.scan_cycle import ScanConfig, edit_and_rescore, rescan, scan_cycle
from hearthline.schema import SCORE_REASONS, canonical
from hearthline.session import cut_lineage
from hearthline.sources import json_feeds as jf
from hearthline.sources.tables import KEY, deals, listings, newest_order, observations, read_table
from hearthline.streaming import changes as ch, cycles

c = F.col


def price_stream(spark, folder):
    schema = read_table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/events*.parquet")
    return stream.select(
        c("event_type").alias("source"), c("user_id").cast("string").alias("source_id"), c("ts").cast("timestamp").alias("ts"),
        c("value").alias("price"), "event_id",
    )


@query("stream_scan", """
SELECT event_id, prev_price, CASE WHEN prev_price IS NULL THEN 'new' WHEN prev_price > price THEN 'dropped' WHEN prev_price <> price THEN 'changed' ELSE 'same' END AS change
FROM (SELECT event_id, price, lag(price) OVER (PARTITION BY source, source_id ORDER BY ts, event_id) AS prev_price FROM history)
""")
def stream_scan(spark, folder):
    """L1/L2: the stream finds the same changes as a batch."""
    found, _ = ch.scan_stream(price_stream(spark, folder), ch.run_folder(spark), lambda: F.to_date("ts"))
    return spark.read.parquet(found).select("event_id", "prev_price", "change")


@query("stream_state", """
SELECT source, source_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
  arg_max(price, (ts, event_id)) AS price FROM history GROUP BY ALL
""")
def stream_state(spark, folder):
    _, state = ch.scan_stream(price_stream(spark, folder), ch.run_folder(spark), lambda: F.to_date("ts"))
    day = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return spark.read.parquet(state).select("source", "source_id", day("first_seen"), day("last_seen"), "price")


@query("stream_alert_once", "SELECT DISTINCT source, source_id FROM history WHERE price > 60")
def stream_alert_once(spark, folder):
    hot = price_stream(spark, folder).filter(c("price") > 60)
    return spark.read.parquet(ch.alert_once(hot, ch.run_folder(spark))).select("source", "source_id")


@query("stream_first_alert", """
SELECT source, source_id, min(event_id) FILTER (WHERE nth = 1) AS event_id, min(price) FILTER (WHERE nth = 1) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY ts, event_id) AS nth FROM history WHERE price > 60) GROUP BY ALL
""")
def stream_first_alert(spark, folder):
    """The alert of a key is its earliest row."""
    hot = price_stream(spark, folder).filter(c("price") > 60)
    return spark.read.parquet(ch.alert_once(hot, ch.run_folder(spark))).select("source", "source_id", "event_id", "price")


CYCLE = ScanConfig(
    search=SearchConfig(rooms_min=1.5, rooms_max=5.0, price_min=300_000, price_max=2_500_000, min_sqm=40),
    scoring=ScoreConfig(), score_threshold=6.0,
)


@query("scan_cycle", PRICED_SQL + """
, old AS (SELECT source, source_id, max_by(price, (observed_at, price, -part_id, -supplier_id)) AS price FROM obs WHERE observed_at < DATE '1998-07-01' GROUP BY ALL),
  kept AS (SELECT l.*, p.fair_price_estimate FROM listings l LEFT JOIN priced p USING (source, source_id)
   WHERE l.rooms BETWEEN 1.5 AND 5.0 AND l.price BETWEEN 300000 AND 2500000 AND l.sqm >= 40)
SELECT k.source, count(*) AS fetched, count(*) FILTER (NOT EXISTS (SELECT 1 FROM old o WHERE o.source = k.source AND o.source_id = k.source_id)) AS new,
  count(k.fair_price_estimate) AS valued, sum(k.fair_price_estimate)::BIGINT AS fair_total FROM kept k GROUP BY k.source
""")
def scan_cycle_query(spark, folder):
    """The whole cycle: reject, value, extract, score, upsert; counted per source."""
    # both the profiles and the rows to value come from the listings
    feed = canonical(cut_lineage(listings(spark, folder)).withColumns({
        "description": F.lit(""), "publish_date": c("observed_at"), "tags": F.array("street")}))
    old = first_per_key(observations(spark, folder).filter(c("observed_at") < "1998-07-01"), KEY, newest_order())
    state = canonical(old.withColumns({
        "first_seen_at": c("observed_at").cast("timestamp"), "last_seen_at": c("observed_at").cast("timestamp")}))
    outcome = scan_cycle(feed, state, deals(spark, folder), F.lit("2001-08-01 00:00:00").cast("timestamp"), CYCLE)
    seen = outcome.changes.filter(c("change") != "kept")
    return seen.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(c("change") == "new").alias("new"),
        F.count("fair_price_estimate").alias("valued"), F.sum("fair_price_estimate").alias("fair_total"),
    )


def arriving(spark, rows, part, parts, first, folder, run, files=2):
    """Rows that reach a folder in ``parts`` lots; ``run`` gets a stream of ``files`` a batch after the first lots and again after the rest."""
    # rows are made and written once, not again for every run: a lot arrives as its folder is moved
    laid = rows.withColumn("lot", part)
    laid.write.option("compression", "zstd").partitionBy("lot").parquet(f"{folder}/laid")
    path = lambda *names: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *names]))
    store = path().getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path("in"))
    for lots in (range(first), range(first, parts)):
        for name in [f"lot={n}" for n in lots]:
            if store.exists(path("laid", name)) and not store.rename(path("laid", name), path("in", name)):
                raise RuntimeError(f"{name} did not arrive")
        source = spark.readStream.schema(laid.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        out = run(source.drop("lot"))
    return out


def late_sightings(spark, folder):
    """Price events in six lots by time, every fortieth event in a later one; a restart after the third."""
    rows = observed_prices(spark, folder)
    span = rows.agg(F.min("ts"), F.max("ts")).first()
    seconds = max(1, int((span[1] - span[0]).total_seconds()) + 1) if span[0] else 1
    lot = F.floor((c("ts").cast("long") - F.lit(span[0]).cast("timestamp").cast("long")) * 5 / seconds)
    lot = F.coalesce(F.least(F.lit(5), lot + F.when(c("event_id") % 40 == 0, 2).otherwise(0)), F.lit(0)).cast("int")
    place = ch.run_folder(spark)
    return arriving(spark, rows, lot, 6, 3, place, lambda stream: cycles.sighting_stream(stream, place, lambda: F.to_date("ts"), buckets=8, parts=3))


def observed_prices(spark, folder):
    return read_table(spark, folder, "events").select(
        c("event_type").alias("source"), c("user_id").cast("string").alias("source_id"), c("ts").cast("timestamp").alias("ts"),
        c("event_id").cast("long").alias("event_id"), c("value").cast("double").alias("price"))


@query("stream_late_rows", """
SELECT event_id, prev_price, CASE WHEN prev_price IS NULL THEN 'new' WHEN prev_price > price THEN 'dropped' WHEN prev_price <> price THEN 'changed' ELSE 'same' END AS change
FROM (SELECT event_id, price, lag(price) OVER (PARTITION BY source, source_id ORDER BY ts, event_id) AS prev_price FROM history)
""")
def stream_late_rows(spark, folder):
    """L2: several micro-batches with late rows and a restart end with the changes of a batch."""
    return late_sightings(spark, folder).read("sightings").select("event_id", "prev_price", "change")


@query("stream_late_state", """
SELECT source, source_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
  arg_max(price, (ts, event_id)) AS price FROM history GROUP BY ALL
""")
def stream_late_state(spark, folder):
    day = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return late_sightings(spark, folder).read("state").select("source", "source_id", day("first_seen"), day("last_seen"), "price")


FEED_SQL = """
, pages AS (SELECT source || '-' || source_id AS id, 0 AS run, price, * EXCLUDE (source, source_id, price) FROM listings
    UNION ALL SELECT source || '-' || source_id, 1, price + 3, * EXCLUDE (source, source_id, price) FROM listings),
  passed AS (SELECT * FROM pages WHERE rooms BETWEEN 1.5 AND 5.0 AND price BETWEEN 300000 AND 2500000 AND sqm >= 40)
"""


def two_scans(spark, folder):
    """First pages of all listings, then, after a restart, second pages with another price."""
    pages = bronze.nested_pages(spark, folder)
    place = ch.run_folder(spark)
    parse = lambda raw: jf.normalize_nested(jf.flatten_sections(raw), 2001)
    clock = lambda n: F.timestamp_seconds(F.lit(996_624_000 + 60 * n))
    return arriving(spark, pages, c("page_no"), 2, 1, place, lambda stream: cycles.feed_stream(
        stream, place, parse, deals(spark, folder), clock, CYCLE, buckets=8, parts=1), files=64)


@query("stream_feed_cycle", PRICED_SQL + FEED_SQL + """
SELECT id AS source_id, max_by(passed.price, run) AS price, any_value(p.fair_price_estimate) AS fair_price_estimate, count(*) AS sightings, count(*) = 2 AS again
FROM passed LEFT JOIN priced p ON id = p.source || '-' || p.source_id GROUP BY id
""")
def stream_feed_cycle(spark, folder):
    """L1: raw pages in micro-batches through parse, value, score, upsert and alert; state and history of one store."""
    store = two_scans(spark, folder)
    seen = store.read("history").groupBy("source_id").agg(F.count(F.lit(1)).alias("sightings"))
    return store.read("listings").join(seen, "source_id").select(
        "source_id", "price", "fair_price_estimate", "sightings", (c("first_seen_at") < c("last_seen_at")).alias("again"))


def two_watches(spark, folder):
    """A seeding run over the posts of every third conversation, then, after a restart, a run over all posts in three lots."""
    rows = linked_posts(spark, folder)
    later = F.when(c("again"), c("turn") % 3 + 1).otherwise(0).cast("int")
    both = rows.filter(c("conv_id") % 3 == 0).withColumn("again", F.lit(False)).unionByName(rows.withColumn("again", F.lit(True)))
    place, numbers = ch.run_folder(spark), iter(range(2))

    def watch(stream):
        run = next(numbers)
        return cycles.watch_stream(stream, place, items_of, run, F.timestamp_seconds(F.lit(1_767_225_600 + 86_400 * run)),
                                   seed_only=run == 0, buckets=8, parts=3)
    return arriving(spark, both, later, 4, 1, place, watch, files=4)


WATCH_RUNS_SQL = ITEMS_SQL + """
, counts AS (SELECT watch_label, count(*) AS fetched, count(*) FILTER (known) AS old FROM watch GROUP BY watch_label)
"""


@query("stream_watch", WATCH_RUNS_SQL + """
SELECT 1 AS run, watch_label, fetched, fetched - old AS new, least(fetched - old, 20) AS alerted FROM counts
UNION ALL SELECT 0, watch_label, old, old, 0 FROM counts WHERE old > 0
""")
def stream_watch(spark, folder):
    """Counts of a seeding run and of a run in several micro-batches, whose quota of a watch holds over all of them."""
    return cycles.watch_log(two_watches(spark, folder)).select(c("run").cast("int").alias("run"), "watch_label", "fetched", "new", "alerted")


@query("stream_watch_items", WATCH_RUNS_SQL + """
SELECT post_id AS source_id, watch_label, sha256(title) AS title, known,
  CASE WHEN known THEN '2026-01-01' ELSE '2026-01-02' END AS first_seen, '2026-01-02' AS last_seen FROM watch
""")
def stream_watch_items(spark, folder):
    """The stored items after both runs; alerted are the seeded ones and those in the outbox."""
    store = two_watches(spark, folder)
    sent = store.read("outbox").select("source", "source_id", F.lit(True).alias("sent"))
    day = lambda n: F.date_format(n, "yyyy-MM-dd")
    rows = store.read("items").join(sent, ["source", "source_id"], "left")
    right = F.coalesce("sent", F.lit(False)) == F.coalesce(day("alerted_at") == "2026-01-02", F.lit(False))
    return rows.select(
        "source_id", "watch_label", F.sha2("title", 256).alias("title"),
        (right & F.coalesce(day("alerted_at") == "2026-01-01", F.lit(False))).alias("known"),
        day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"))


#: What the edits of ``edit_rescore`` change: two overrides set, one set, one cleared.
EDITED_SQL = (
    SCORE_SQL.replace("CASE WHEN part_id % 10 = 0 THEN sqm + 5", "CASE WHEN line_no = 1 THEN sqm * 2 WHEN part_id % 10 = 0 AND line_no <> 3 THEN sqm + 5")
    .replace("CASE WHEN part_id % 9 = 0 THEN line_no END AS units", "CASE WHEN line_no = 2 THEN 4 WHEN part_id % 9 = 0 THEN line_no END AS units")
    .replace("CASE WHEN part_id % 6 = 0 THEN sqm * 2 END AS garden", "CASE WHEN line_no = 1 THEN 200 WHEN part_id % 6 = 0 THEN sqm * 2 END AS garden")
)


@query("edit_rescore", EDITED_SQL + f"""
SELECT source, source_id, built::BIGINT AS built, CASE WHEN line_no <= 3 THEN greatest(1.0::DOUBLE, least(10.0::DOUBLE, {TOTAL_SQL})) ELSE 1.5 END::DOUBLE AS score,
  line_no <= 3 AS reasoned FROM parts
""")
def edit_rescore(spark, folder):
    """User overrides on some rows, which alone get a new score and new reasons."""
    rows = scored_rows(spark, folder)
    state = rows.withColumns({"score": F.lit(1.5), "score_reasons": F.lit(None).cast(SCORE_REASONS)})
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    edits = rows.filter(c("line_no") <= 3).select(
        "source", "source_id",
        F.when(c("line_no") == 1, names("sqm_build_user", "garden_sqm_user")).when(c("line_no") == 2, names("units_count_user"))
        .otherwise(names("sqm_build_user")).alias("set_mask"),
        F.when(c("line_no") == 1, c("sqm") * 2).cast("int").alias("sqm_build_user"),
        F.lit(200).alias("garden_sqm_user"), F.lit(4).alias("units_count_user"))
    edited = edit_and_rescore(state, edits, F.lit(AS_OF).cast("date"), CONFIG)
    return edited.select(
        "source", "source_id", F.coalesce("sqm_build_user", "sqm_build", "sqm").cast("bigint").alias("built"), "score",
        c("score_reasons").isNotNull().alias("reasoned"))


@query("rescan_rows", PRICED_SQL + """
SELECT l.source, l.source_id, l.price, line_no = 1 AS again, CASE WHEN line_no = 1 THEN p.fair_price_estimate END AS fair_price_estimate,
  CASE WHEN line_no = 1 THEN 'בית מחולק ל-3 דירות ' || part_id ELSE '' END AS description, CASE WHEN line_no = 1 THEN 3 END AS units_count, line_no = 1 AS scored
FROM listings l LEFT JOIN priced p USING (source, source_id)
""")
def rescan_rows(spark, folder):
    """Some rows get their details again, are mined, valued and scored, and merged; the rest stays."""
    rows = cut_lineage(listings(spark, folder))  # state, keys and details come from them
    before = c("observed_at").cast("timestamp")
    state = canonical(rows.withColumns({
        "tags": F.array("street"), "publish_date": c("observed_at"), "first_seen_at": before, "last_seen_at": before}))
    keys = rows.filter(c("line_no") == 1)
    details = keys.select("source", "source_id", F.concat(F.lit("בית מחולק ל-3 דירות "), c("part_id").cast("string")).alias("description"))
    now = F.lit("2001-08-01 12:00:00").cast("timestamp")
    after = rescan(state, keys, details, deals(spark, folder), now, CYCLE)
    return after.select(
        "source", "source_id", "price", (c("last_seen_at") == now).alias("again"), "fair_price_estimate", "description", "units_count",
        c("score").isNotNull().alias("scored"))
