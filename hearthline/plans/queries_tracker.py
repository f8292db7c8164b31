"""Tracker state machine on the two halves of the sightings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.operators import lifecycle as lc
from hearthline.operators.ordered import read_positions
from hearthline.plans.queries_state import HALVES_SQL, NOW, SPLIT, halves
from hearthline.plans.registry import query
from hearthline.session import checkpoint_dir, cut_lineage
from hearthline.sources.tables import SORT_KEY

c = F.col
TRACKED = {"score": "double", "city": "string", "rooms_eff": "double", "floor": "int", "price": "bigint", "comments": "string"}


COLUMNS = ["source", "source_id", "city", "rooms", "floor", "price", "observed_at", "line_no", "part_id"]


def written_halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both halves as written tables: the old one is read twice, and what they shuffled is gone before the tracker is joined."""
    old, new = halves(spark, folder)
    return cut_lineage(old.select(*COLUMNS, "street")), cut_lineage(new.select(*COLUMNS))


def current_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row per listing with the time it was last seen."""
    cols = COLUMNS
    both = old.select(*cols, F.lit(1).alias("_p")).unionByName(new.select(*cols, F.lit(0).alias("_p")))
    rows = lc.first_per_key(both, SORT_KEY, [F.asc("_p")])
    return rows.select(
        "source", "source_id", "city", c("rooms").alias("rooms_eff"), "floor", "price", "line_no", "part_id",
        F.when(c("_p") == 0, F.lit(NOW).cast("timestamp")).otherwise(c("observed_at").cast("timestamp")).alias("last_seen_at"),
        (c("part_id") % 10).cast("double").alias("score"), F.lit("").alias("comments"),
        c("observed_at").alias("first_listed_date"),
    )


def prior_tracker(old: DataFrame) -> DataFrame:
    """What the tracker showed before: the old half with some user edits and broken cells."""
    n = c("line_no")
    score = F.bround((c("part_id") % 10).cast("double"), 2).cast("string")
    shadow = F.struct(
        score.alias("score"), c("city").alias("city"), c("rooms").cast("string").alias("rooms_eff"),
        c("floor").cast("string").alias("floor"), c("price").cast("string").alias("price"), F.lit("").alias("comments"),
    )
    return old.select(
        "source", "source_id",
        score.alias("cell_score"),
        F.when(n == 3, "#REF!").otherwise(c("city")).alias("cell_city"),
        c("rooms").cast("string").alias("cell_rooms_eff"),
        F.coalesce(c("floor").cast("string"), F.lit("")).alias("cell_floor"),
        F.when(n == 2, "999,999").otherwise(F.format_number("price", 0)).alias("cell_price"),
        F.when(n == 1, F.concat(F.lit("call "), c("street"))).otherwise("").alias("cell_comments"),
        F.when(n != 4, shadow).alias("shadow"),
        F.when(c("part_id") % 2 == 0, F.array(F.struct(
            F.lit("1997-01-01").cast("date").alias("ts"), F.array().cast(f"array<{lc.CHANGE}>").alias("changes"),
            F.lit(None).cast("boolean").alias("disappeared"), F.lit(True).alias("reappeared"),
        ))).alias("change_log"),
        F.when(n == 5, F.lit("1998-01-01").cast("date")).alias("disappeared_on"),
        c("observed_at").alias("last_changed"),
    )


def scans(spark: SparkSession) -> DataFrame:
    """Latest successful scans; source R was never scanned successfully."""
    return spark.createDataFrame([("A", NOW), ("N", NOW)], "source string, t string").select(
        "source", c("t").cast("timestamp").alias("latest_scan")
    )


def fresh_rows(spark: SparkSession, old: DataFrame, new: DataFrame) -> DataFrame:
    return lc.with_freshness(
        current_rows(old, new), scans(spark), F.lit(NOW).cast("timestamp") + F.make_dt_interval(days=F.lit(1)), 1500
    )


def tracker(spark: SparkSession, folder: str) -> DataFrame:
    today = F.lit(SPLIT).cast("date")
    old, new = written_halves(spark, folder)
    return lc.build_tracker(fresh_rows(spark, old, new), prior_tracker(old), today, audit_max=2, tracked=TRACKED)


TRACK_SQL = HALVES_SQL + f"""
, cur AS (SELECT source, source_id, coalesce(n.city, o.city) AS city, CASE WHEN n.price IS NULL THEN o.rooms ELSE n.rooms END AS rooms,
    CASE WHEN n.price IS NULL THEN o.floor ELSE n.floor END AS floor, coalesce(n.price, o.price) AS price,
    coalesce(n.part_id, o.part_id) AS part_id, coalesce(n.observed_at, o.observed_at) AS first_listed,
    n.price IS NOT NULL AS active, o.price IS NOT NULL AS known, o.line_no AS o_line, o.city AS o_city, o.rooms AS o_rooms,
    o.floor AS o_floor, o.price AS o_price, o.part_id AS o_part, o.street AS o_street, o.observed_at AS o_seen
    FROM old o FULL OUTER JOIN new n USING (source, source_id)),
  act AS (SELECT * EXCLUDE (active), CASE WHEN source = 'R' THEN active OR (o_seen::TIMESTAMP >= TIMESTAMP '{NOW}' + INTERVAL 1 DAY - INTERVAL 1500 MINUTE)
      ELSE active OR (o_seen::TIMESTAMP >= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE) END AS active FROM cur),
  merged AS (SELECT *, known AND o_line <> 4 AS shadowed,
    (part_id % 10)::DOUBLE::VARCHAR AS m_score, city AS m_city, rooms::VARCHAR AS m_rooms, floor::VARCHAR AS m_floor,
    CASE WHEN known AND o_line = 2 AND o_price <> 999999 THEN '999999' ELSE price::VARCHAR END AS m_price,
    CASE WHEN known AND o_line = 1 THEN 'call ' || o_street ELSE '' END AS m_comments FROM act),
  diffed AS (SELECT *, list_filter([
     CASE WHEN (NOT known) OR (o_part % 10)::DOUBLE::VARCHAR <> m_score THEN 'score:' || CASE WHEN known THEN (o_part % 10)::DOUBLE::VARCHAR ELSE '' END || '>' || m_score END,
     CASE WHEN (NOT known) OR o_city <> m_city THEN 'city:' || CASE WHEN known THEN o_city ELSE '' END || '>' || m_city END,
     CASE WHEN (NOT known) OR o_rooms::VARCHAR <> m_rooms THEN 'rooms_eff:' || CASE WHEN known THEN o_rooms::VARCHAR ELSE '' END || '>' || m_rooms END,
     CASE WHEN CASE WHEN known THEN coalesce(o_floor::VARCHAR, '') ELSE '' END <> coalesce(m_floor, '') THEN 'floor:' || CASE WHEN known THEN coalesce(o_floor::VARCHAR, '') ELSE '' END || '>' || coalesce(m_floor, '') END,
     CASE WHEN (NOT known) OR o_price::VARCHAR <> m_price THEN 'price:' || CASE WHEN known THEN o_price::VARCHAR ELSE '' END || '>' || m_price END,
     CASE WHEN m_comments <> '' THEN 'comments:>' || m_comments END], lambda x: x IS NOT NULL AND (NOT known OR shadowed)) AS d FROM merged),
  flags AS (SELECT *, active AND known AND o_line = 5 AS came_back, NOT active AND NOT (known AND o_line = 5) AS vanished FROM diffed)
"""


@query("lifecycle", TRACK_SQL + f"""
SELECT source, source_id, active::INTEGER AS active, CASE WHEN vanished THEN '{SPLIT}' WHEN NOT came_back AND known AND o_line = 5 THEN '1998-01-01' END AS disappeared_on,
  CASE WHEN len(d) > 0 THEN '{SPLIT}' WHEN known THEN o_seen::VARCHAR ELSE '{SPLIT}' END AS last_changed FROM flags
""")
def lifecycle(spark, folder):
    return tracker(spark, folder).select(
        "source", "source_id", c("active").cast("int").alias("active"),
        c("disappeared_on").cast("string").alias("disappeared_on"), c("last_changed").cast("string").alias("last_changed"),
    )


@query("shadow_merge", TRACK_SQL + """
SELECT source, source_id, m_score, m_city, m_rooms AS m_rooms_eff, m_floor, m_price, m_comments FROM
 (SELECT * REPLACE (CASE WHEN shadowed OR NOT known THEN m_price ELSE price::VARCHAR END AS m_price,
                    CASE WHEN shadowed OR NOT known THEN m_comments ELSE '' END AS m_comments) FROM flags)
""")
def shadow_merge(spark, folder):
    return tracker(spark, folder).select("source", "source_id", *[f"m_{n}" for n in TRACKED])


@query("change_log", TRACK_SQL + f"""
SELECT source, source_id, array_to_string(list_filter([
   CASE WHEN len(d) > 0 THEN '{SPLIT} ' || array_to_string(d, ' ') END,
   CASE WHEN came_back THEN '{SPLIT} back' WHEN vanished THEN '{SPLIT} gone' END,
   CASE WHEN known AND o_part % 2 = 0 THEN '1997-01-01 back' END], lambda x: x IS NOT NULL)[1:2], '; ') AS log FROM flags
""")
def change_log(spark, folder):
    text = F.transform(c("change_log"), lambda e: F.concat(
        e["ts"].cast("string"), F.lit(" "),
        F.coalesce(
            F.when(e["disappeared"], "gone"), F.when(e["reappeared"], "back"),
            F.array_join(F.transform(e["changes"], lambda x: F.concat(
                x["col"], F.lit(":"), F.coalesce(x["old"], F.lit("")), F.lit(">"), F.coalesce(x["new"], F.lit(""))
            )), " "),
        ),
    ))
    return tracker(spark, folder).select("source", "source_id", F.array_join(text, "; ").alias("log"))


@query("typed_diff", HALVES_SQL + """
SELECT source, source_id, array_to_string(list_filter([
  CASE WHEN o.price::VARCHAR || '.50' <> n.price::VARCHAR THEN 'price:' || (o.price + 0.5)::DOUBLE::VARCHAR || '>' || n.price::VARCHAR END,
  CASE WHEN coalesce(o.floor::VARCHAR, '') <> coalesce(n.floor::VARCHAR, '') THEN 'floor:' || coalesce(o.floor::VARCHAR, '') || '>' || coalesce(n.floor::VARCHAR, '') END],
  lambda x: x IS NOT NULL), ' ') AS diff FROM old o JOIN new n USING (source, source_id)
""")
def typed_diff(spark, folder):
    old, new = halves(spark, folder)
    prior = old.select(
        "source", "source_id", F.concat(c("price").cast("string"), F.lit(".50")).alias("p_price"), c("floor").cast("string").alias("p_floor")
    )
    diff = lc.typed_diff(
        {"price": c("p_price"), "floor": c("p_floor")}, {"price": c("price"), "floor": c("floor")},
        {"price": "bigint", "floor": "int"},
    )
    text = F.array_join(F.transform(diff, lambda x: F.concat(
        x["col"], F.lit(":"), F.coalesce(x["old"], F.lit("")), F.lit(">"), F.coalesce(x["new"], F.lit("")))), " ")
    return new.join(prior, ["source", "source_id"]).select("source", "source_id", text.alias("diff"))


@query("tracker_view", TRACK_SQL + f"""
, v AS (SELECT source, source_id, city IN ('NATION_1', 'NATION_2') AS is_archive, first_listed, m_score::DOUBLE AS score,
    CASE WHEN vanished THEN DATE '{SPLIT}' WHEN NOT came_back AND known AND o_line = 5 THEN DATE '1998-01-01' END AS gone FROM flags)
SELECT source, source_id, is_archive::INTEGER AS is_archive, (gone IS NOT NULL)::INTEGER AS is_gone,
  coalesce(gone, first_listed)::VARCHAR AS sort_date FROM v
""")
def tracker_view(spark, folder):
    """Rows in display order, archive cities marked."""
    rows = lc.split_archive(tracker(spark, folder), ["NATION_1", "NATION_2"])
    return rows.orderBy(*lc.tracker_order(), "source", "source_id").select(
        "source", "source_id", c("is_archive").cast("int").alias("is_archive"),
        c("disappeared_on").isNotNull().cast("int").alias("is_gone"),
        F.coalesce("disappeared_on", "first_listed_date").cast("string").alias("sort_date"),
    )


@query("tracker_written", TRACK_SQL + f"""
, v AS (SELECT source, source_id, city IN ('NATION_1', 'NATION_2') AS is_archive, first_listed, m_score::DOUBLE AS score,
    CASE WHEN vanished THEN DATE '{SPLIT}' WHEN NOT came_back AND known AND o_line = 5 THEN DATE '1998-01-01' END AS gone FROM flags)
SELECT source, source_id, is_archive::INTEGER AS is_archive, row_number() OVER (PARTITION BY is_archive
  ORDER BY gone IS NOT NULL, coalesce(gone, first_listed) DESC NULLS LAST,
    CASE WHEN gone IS NULL THEN coalesce(score, 0) END DESC NULLS LAST, source, source_id) - 1 AS position FROM v
""")
def tracker_written(spark, folder):
    """The tracker written as main table and archive, with the place of each row in its files."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracker/{uuid.uuid4().hex}"
    # written before the sort, which reads its input twice and would hold the joins' shuffles as long
    lc.write_tracker(cut_lineage(tracker(spark, folder)), path, ["NATION_1", "NATION_2"])
    return read_positions(spark, path, ["is_archive"]).select(
        "source", "source_id", c("is_archive").cast("boolean").cast("int").alias("is_archive"), "position")


@query("archive_prior", HALVES_SQL + """
SELECT source, source_id, coalesce(n.price, o.price) AS price, (n.price IS NOT NULL)::INTEGER AS from_archive
FROM old o FULL OUTER JOIN (SELECT * FROM new WHERE city IN ('NATION_1', 'NATION_2')) n USING (source, source_id)
""")
def archive_prior(spark, folder):
    old, new = halves(spark, folder)
    cols = lambda df, flag: df.select("source", "source_id", "price", F.lit(flag).alias("from_archive"))
    return lc.prior_rows(cols(old, 0), cols(new.filter(c("city").isin("NATION_1", "NATION_2")), 1))


@query("tracker_cells", """
SELECT source, source_id, CASE WHEN is_agent THEN 'Agent' ELSE 'Direct' END AS sale_type, street || ' ' || house_number AS address,
  greatest(0, DATE '2001-08-01' - observed_at)::BIGINT AS age_days, rooms AS rooms_eff, sqm::BIGINT AS sqm_build_eff,
  round_even(price::DOUBLE / sqm::DOUBLE, 0)::BIGINT AS price_per_sqm_eff, street || ' / ' || city AS description FROM listings
""")
def tracker_cells(spark, folder):
    from hearthline.schema import canonical
    from hearthline.sources.tables import listings

    rows = canonical(listings(spark, folder).withColumns({
        "first_listed_date": c("observed_at"), "description": F.concat_ws("\r\n/  ", "street", "city"),
    }))
    return lc.tracker_data(rows, F.lit("2001-08-01").cast("date")).select(
        "source", "source_id", "sale_type", "address", c("age_days").cast("bigint").alias("age_days"), "rooms_eff",
        c("sqm_build_eff").cast("bigint").alias("sqm_build_eff"), "price_per_sqm_eff", "description",
    )
