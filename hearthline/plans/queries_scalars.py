"""Dates, numbers and facts mined from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import dates as dt, mining as mn, numeric as num
from hearthline.plans.registry import query
from hearthline.sources.tables import listings, price_history, texts

c = F.col
AS_OF = "2001-08-01"

DATE_TEXT_SQL = """
CASE line_no % 4 WHEN 0 THEN strftime(observed_at, '%Y-%m-%d') || 'T09:30:00Z' WHEN 1 THEN strftime(observed_at, '%-d/%-m/%Y')
  WHEN 2 THEN strftime(observed_at, '%m/%Y') ELSE '2001-02-31' END
"""


def date_text():
    return (
        F.when(c("line_no") % 4 == 0, F.concat(F.date_format("observed_at", "yyyy-MM-dd"), F.lit("T09:30:00Z")))
        .when(c("line_no") % 4 == 1, F.date_format("observed_at", "d/M/yyyy"))
        .when(c("line_no") % 4 == 2, F.date_format("observed_at", "MM/yyyy")).otherwise("2001-02-31")
    )


@query("date_parsing", f"""
SELECT source, source_id,
  CASE WHEN line_no % 4 = 0 THEN strftime(observed_at, '%Y-%m-%d') END AS iso,
  CASE WHEN line_no % 4 = 1 THEN strftime(observed_at, '%Y-%m-%d') END AS day_first,
  CASE WHEN line_no % 4 = 2 THEN strftime(observed_at, '%Y-%m-01') END AS month_year,
  CASE WHEN line_no % 4 = 0 THEN strftime(observed_at, '%Y-%m-%d') || ' 09:30:00' END AS instant,
  CASE WHEN length(t) >= 10 THEN left(t, 10) END AS slice,
  CASE WHEN line_no % 4 = 1 THEN strftime(observed_at, '%Y-%m-%d') END AS labelled
FROM (SELECT *, {DATE_TEXT_SQL} AS t FROM listings)
""")
def date_parsing(spark, folder):
    rows = listings(spark, folder).withColumn("t", date_text())
    text = lambda x: x.cast("string")
    return rows.select(
        "source", "source_id", text(dt.iso_date(c("t"))).alias("iso"), text(dt.day_first_date(c("t"))).alias("day_first"),
        text(dt.month_year_date(c("t"))).alias("month_year"),
        F.date_format(dt.utc_timestamp(c("t")), "yyyy-MM-dd HH:mm:ss").alias("instant"),
        dt.date_slice(c("t")).alias("slice"),
        text(dt.day_first_date(F.concat(F.lit("תאריך יצירה: "), c("t"), F.lit(" 21:43")), anywhere=True)).alias("labelled"),
    )


@query("earliest_date", f"""
SELECT source, source_id, least(CASE WHEN line_no % 4 = 0 THEN observed_at END, CASE WHEN line_no % 2 = 1 THEN observed_at - INTERVAL 3 DAY END,
   DATE '2000-01-15')::DATE::VARCHAR AS first_listed FROM listings
""")
def earliest_date(spark, folder):
    older = F.when(c("line_no") % 2 == 1, F.date_sub("observed_at", 3).cast("string")).otherwise("")
    return listings(spark, folder).select(
        "source", "source_id",
        dt.earliest(date_text(), older, F.lit("2000-01-15")).cast("string").alias("first_listed"),
    )


@query("lifecycle_dates", """
SELECT source, source_id, observed_at::VARCHAR AS published,
  (CASE WHEN line_no % 3 = 0 THEN observed_at ELSE observed_at - INTERVAL 7 DAY END)::DATE::VARCHAR AS first_listed,
  CASE WHEN line_no % 2 = 0 THEN observed_at::VARCHAR WHEN line_no = 1 THEN strftime(observed_at, '%Y-%m-05') END AS image_date
FROM listings
""")
def lifecycle_dates(spark, folder):
    created = F.when(c("line_no") % 3 != 0, F.date_sub("observed_at", 7))
    published, first = dt.published_and_first(created, c("observed_at"))
    path = lambda fmt: F.concat(F.lit("https://img.example/Pic/"), F.date_format("observed_at", fmt), F.lit("/a.jpg"))
    images = F.array(
        F.lit("https://img.example/logo.png"),
        F.when(c("line_no") % 2 == 0, path("yyyyMM/dd")).when(c("line_no") == 1, path("yyyy/MM/'05'"))
        .otherwise("https://img.example/Pic/200113/44/x.jpg"),
    )
    return listings(spark, folder).select(
        "source", "source_id", published.cast("string").alias("published"), first.cast("string").alias("first_listed"),
        dt.image_path_date(images).cast("string").alias("image_date"),
    )


@query("listing_age", f"""
SELECT source, source_id, greatest(0, DATE '2000-01-01' - observed_at)::BIGINT AS age_days,
  (2001 - year_built)::BIGINT AS building_age,
  (date_trunc('month', observed_at - INTERVAL 540 DAY)::DATE)::VARCHAR AS cutoff_days,
  make_date((year(observed_at) * 12 + month(observed_at) - 19) // 12, (year(observed_at) * 12 + month(observed_at) - 19) % 12 + 1, 1)::VARCHAR AS cutoff_calendar,
  (year(observed_at) * 12 + month(observed_at))::BIGINT AS month_index FROM listings
""")
def listing_age(spark, folder):
    seen = c("observed_at")
    return listings(spark, folder).select(
        "source", "source_id", dt.age_days(seen, F.lit("2000-01-01").cast("date")).cast("bigint").alias("age_days"),
        dt.building_age(c("year_built"), F.lit(AS_OF).cast("date")).cast("bigint").alias("building_age"),
        dt.window_cutoff(seen, 18).cast("string").alias("cutoff_days"),
        dt.window_cutoff(seen, 18, "calendar").cast("string").alias("cutoff_calendar"),
        dt.month_index(F.year(seen), F.month(seen)).cast("bigint").alias("month_index"),
    )


@query("effective_values", """
SELECT source, source_id, coalesce(CASE WHEN part_id % 8 = 0 THEN 3.5 END, rooms)::DOUBLE AS rooms_eff,
  coalesce(CASE WHEN part_id % 10 = 0 THEN sqm + 5 END, sqm)::BIGINT AS sqm_eff, built::BIGINT AS sqm_build_eff,
  CASE WHEN line_no % 2 = 0 THEN line_no WHEN part_id % 9 = 0 THEN 2 END::BIGINT AS units_count_eff,
  CASE WHEN line_no % 3 = 0 THEN 40 END::BIGINT AS garden_sqm_eff, CASE WHEN part_id % 5 = 0 THEN sqm * 3 END::BIGINT AS lot_sqm_eff,
  CASE WHEN line_no = 7 THEN 777 ELSE round_even(price::DOUBLE / built::DOUBLE, 0)::BIGINT END AS price_per_sqm_eff
FROM (SELECT *, CASE WHEN line_no = 7 THEN 0 WHEN part_id % 6 = 0 THEN sqm + 9 WHEN part_id % 4 = 0 THEN sqm - 3 ELSE sqm END AS built FROM listings)
""")
def effective_values(spark, folder):
    when = F.when
    rows = listings(spark, folder).withColumns({
        "rooms_user": when(c("part_id") % 8 == 0, 3.5), "sqm_user": when(c("part_id") % 10 == 0, c("sqm") + 5),
        "sqm_build": when(c("part_id") % 4 == 0, c("sqm") - 3),
        "sqm_build_user": when(c("line_no") == 7, 0).when(c("part_id") % 6 == 0, c("sqm") + 9),
        "units_count": when(c("part_id") % 9 == 0, 2), "units_count_user": when(c("line_no") % 2 == 0, c("line_no")),
        "garden_sqm": F.lit(None).cast("int"), "garden_sqm_user": when(c("line_no") % 3 == 0, 40),
        "lot_sqm": when(c("part_id") % 5 == 0, c("sqm") * 3), "lot_sqm_user": F.lit(None).cast("int"),
        "price_per_sqm": F.lit(777).cast("bigint"),
    })
    values = num.effective_values()
    return rows.select("source", "source_id", *[
        v.cast("double" if k == "rooms_eff" else "bigint").alias(k) for k, v in values.items()
    ])


@query("price_per_area", """
SELECT source, source_id, round_even(price::DOUBLE / sqm::DOUBLE, 0)::BIGINT AS price_per_sqm,
  round(CASE WHEN price_before > price THEN (price_before - price)::DOUBLE / price_before::DOUBLE * 100 END, 6) AS drop_pct FROM listings
""")
def price_per_area(spark, folder):
    return listings(spark, folder).select(
        "source", "source_id", num.price_per_area(c("price"), c("sqm")).alias("price_per_sqm"),
        F.round(num.drop_percent(c("price_before"), c("price")), 6).alias("drop_pct"),
    )


@query("bounded_cast", r"""
SELECT source, source_id, CASE WHEN v BETWEEN 10 AND 10000 THEN trunc(v)::BIGINT END AS sqm,
  CASE WHEN w BETWEEN 0.5 AND 30 THEN w END AS rooms, CASE WHEN trunc(f) BETWEEN -10 AND 200 THEN trunc(f)::BIGINT END AS floor
FROM (SELECT source, source_id, CASE line_no % 3 WHEN 0 THEN sqm + 0.7 WHEN 1 THEN sqm * 100 END::DOUBLE AS v,
             (rooms * (line_no % 7))::DOUBLE AS w, (line_no * 3.5 - 14)::DOUBLE AS f FROM listings)
""")
def bounded_cast(spark, folder):
    area = (
        F.when(c("line_no") % 3 == 0, (c("sqm") + F.lit(0.7)).cast("string"))
        .when(c("line_no") % 3 == 1, (c("sqm") * 100).cast("string")).otherwise("unknown")
    )
    rooms = (c("rooms") * (c("line_no") % 7)).cast("string")
    floor = (c("line_no") * F.lit(3.5) - 14).cast("string")
    return listings(spark, folder).select(
        "source", "source_id", num.bounded_cast(area, "sqm").cast("bigint").alias("sqm"),
        num.bounded_cast(rooms, "rooms").alias("rooms"), num.bounded_cast(floor, "floor").cast("bigint").alias("floor"),
    )


# a Hebrew description around the values of the row
STORY_SQL = """
CASE part_id % 8 WHEN 0 THEN 'בית עם ' || line_no || ' יחידות דיור, גינה של ' || sqm || ' מ"ר'
  WHEN 1 THEN 'מחולקת ל-' || line_no || ' דירות, מגרש ' || sqm * 4 || ' מ״ר. חצר'
  WHEN 2 THEN line_no || ' יחידות דיוריחידות הורים'
  WHEN 3 THEN 'וילה יחידת דיור נפרדת ויחידת דיור נוספת ' || ' חצר ' || sqm || ' מ''ר'
  WHEN 4 THEN 'נבנה בשנת ' || year_built || ', ' || rooms || ' חדרים, קומה ' || line_no || ' , ' || sqm || ' מ"ר'
  WHEN 5 THEN 'אין יחידת דיור. נכס בן ' || p || ' שנים בקומת קרקע'
  WHEN 6 THEN 'יש יחידת דיור מניבה, בן שנתיים' ELSE street END
"""


def story():
    k = c("part_id") % 8
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (
        F.when(k == 0, j("בית עם ", c("line_no"), " יחידות דיור, גינה של ", c("sqm"), ' מ"ר'))
        .when(k == 1, j("מחולקת ל-", c("line_no"), " דירות, מגרש ", c("sqm") * 4, " מ״ר. חצר"))
        .when(k == 2, j(c("line_no"), " יחידות דיוריחידות הורים"))
        .when(k == 3, j("וילה יחידת דיור נפרדת ויחידת דיור נוספת ", " חצר ", c("sqm"), " מ'ר"))
        .when(k == 4, j("נבנה בשנת ", c("year_built"), ", ", c("rooms"), " חדרים, קומה ", c("line_no"), " , ", c("sqm"), ' מ"ר'))
        .when(k == 5, j("אין יחידת דיור. נכס בן ", c("p"), " שנים בקומת קרקע"))
        .when(k == 6, F.lit("יש יחידת דיור מניבה, בן שנתיים")).otherwise(c("street"))
    )


def stories(spark, folder):
    return listings(spark, folder).withColumn("p", (c("part_id") % 90).cast("int")).withColumn("story", story())


UNITS_SQL = """
CASE k WHEN 0 THEN line_no WHEN 1 THEN line_no WHEN 3 THEN 2 WHEN 6 THEN 1 END::BIGINT
"""


@query("units_count", f"""
SELECT source, source_id, {UNITS_SQL} AS units, CASE k WHEN 0 THEN line_no WHEN 1 THEN line_no WHEN 2 THEN line_no WHEN 3 THEN 2 END::BIGINT AS units_plain,
  CASE k WHEN 0 THEN line_no WHEN 2 THEN line_no WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 END::BIGINT AS units_brief
FROM (SELECT *, part_id % 8 AS k FROM listings)
""")
def units_count(spark, folder):
    return stories(spark, folder).select(
        "source", "source_id", mn.units_count(c("story")).cast("bigint").alias("units"),
        mn.units_count_plain(c("story")).cast("bigint").alias("units_plain"),
        mn.units_count_brief(c("story")).cast("bigint").alias("units_brief"),
    )


AREAS_SQL = rf"""
, s AS (SELECT *, {STORY_SQL} AS story FROM (SELECT *, part_id % 90 AS p FROM listings)),
  m AS (SELECT *, try_cast(nullif(regexp_extract(story, '(?:גינ[הת]|חצר)[^.\n]{{0,40}}?([0-9]{{2,4}})\s*מ[״"''׳]?\s*ר', 1), '') AS INTEGER) AS g,
    try_cast(nullif(regexp_extract(story, 'מגרש[^.\n]{{0,30}}?([0-9]{{2,5}})\s*מ[״"''׳]?\s*ר', 1), '') AS INTEGER) AS l FROM s)
"""


@query("text_measures", AREAS_SQL + r"""
SELECT source, source_id, CASE WHEN g BETWEEN 5 AND 9999 THEN g END::BIGINT AS garden, CASE WHEN l BETWEEN 20 AND 99999 THEN l END::BIGINT AS lot,
  CASE WHEN part_id % 8 = 4 THEN rooms END AS rooms, CASE WHEN part_id % 8 IN (0, 3, 4) THEN sqm WHEN part_id % 8 = 1 THEN sqm * 4 END::BIGINT AS sqm,
  CASE WHEN part_id % 8 = 4 THEN line_no WHEN part_id % 8 = 5 THEN 0 END::BIGINT AS floor,
  CASE WHEN part_id % 8 = 1 THEN sqm * 4 END::BIGINT AS lot_loose FROM m
""")
def text_measures(spark, folder):
    rows = stories(spark, folder)
    found = mn.text_measures(c("story"))
    return rows.select(
        "source", "source_id", mn.garden_area(c("story")).cast("bigint").alias("garden"),
        mn.lot_area(c("story")).cast("bigint").alias("lot"), found["rooms"].alias("rooms"),
        found["sqm"].cast("bigint").alias("sqm"), found["floor"].cast("bigint").alias("floor"),
        mn.lot_area_loose(c("story")).cast("bigint").alias("lot_loose"),
    )


@query("lot_by_feed", """
SELECT source, source_id, CASE WHEN line_no % 4 IN (0, 3) THEN sqm + 100 END::BIGINT AS agency, (sqm + 100)::BIGINT AS catalog FROM listings
""")
def lot_by_feed(spark, folder):
    """E-T4: the catalog feed reads corners and dunam, the agency feed plots alone."""
    k, size = c("line_no") % 4, (c("sqm") + 100).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("מגרש "), size))
        .when(k == 1, F.concat(F.lit("פינתי "), size, F.lit(" מטר")))
        .when(k == 2, F.concat(F.lit("חצי דונם כלומר "), size, F.lit(" מטר")))
        .otherwise(F.concat(F.lit('על קרקע של '), size, F.lit(' מ"ר')))
    )
    return listings(spark, folder).select(
        "source", "source_id", mn.lot_area_loose(text, mn.LOT_AGENCY).cast("bigint").alias("agency"),
        mn.lot_area_loose(text).cast("bigint").alias("catalog"))


@query("built_area", """
SELECT source, source_id, sqm::BIGINT AS built, CASE WHEN line_no % 4 = 1 THEN sqm END::BIGINT AS garden FROM listings
""")
def built_area(spark, folder):
    k, size = c("line_no") % 4, c("sqm").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("שטח בנוי של "), size))
        .when(k == 1, F.concat(F.lit("דירה "), size, F.lit(' מ"ר גינה, כ-'), size, F.lit(" מטר בנוי")))
        .when(k == 2, F.concat(F.lit("4 חדרים מרווחים "), size, F.lit(" מטר ליד הים")))
        .otherwise(F.concat(F.lit("פנטהאוז "), size, F.lit(" מ״ר, נוף")))
    )
    return listings(spark, folder).select(
        "source", "source_id", mn.built_area(text).cast("bigint").alias("built"),
        mn.garden_area(text, mn.GARDEN_EITHER, 2).cast("bigint").alias("garden"),
    )


@query("year_built", """
SELECT source, source_id, CASE part_id % 8 WHEN 4 THEN year_built WHEN 5 THEN 2001 - part_id % 90 WHEN 6 THEN 1999 END::BIGINT AS year_built FROM listings
""")
def year_built(spark, folder):
    return stories(spark, folder).select(
        "source", "source_id", mn.year_built(c("story"), 2001).cast("bigint").alias("year_built")
    )


@query("extract_features", AREAS_SQL + f"""
SELECT source, source_id, CASE WHEN line_no = 2 THEN 9 ELSE {UNITS_SQL} END AS units_count,
  CASE WHEN g BETWEEN 5 AND 9999 THEN g END::BIGINT AS garden_sqm,
  CASE WHEN line_no = 3 THEN 333 WHEN l BETWEEN 20 AND 99999 THEN l END::BIGINT AS lot_sqm
FROM (SELECT *, part_id % 8 AS k FROM m)
""")
def extract_features(spark, folder):
    rows = stories(spark, folder).withColumns({
        "units_count": F.when(c("line_no") == 2, 9), "garden_sqm": F.lit(None).cast("int"),
        "lot_sqm": F.when(c("line_no") == 3, 333),
    })
    return rows.select("source", "source_id", *[
        v.cast("bigint").alias(k) for k, v in mn.extract_features(c("story")).items()
    ])


@query("text_numbers", r"""
SELECT doc_id, try_cast(nullif(regexp_extract(description, '([0-9]{2,4})\s*(?:EUR|euros|kg|km|%)', 1), '') AS BIGINT) AS amount,
  CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year,
  len(regexp_extract_all(description, '[0-9]+'))::BIGINT AS numbers FROM (
  SELECT *, try_cast(nullif(regexp_extract(description, '\b((?:19|20)[0-9]{2})\b', 1), '') AS BIGINT) AS y FROM texts)
""")
def text_numbers(spark, folder):
    """The same operators with a Latin lexicon over whole documents."""
    return texts(spark, folder).select(
        "doc_id",
        mn.bounded_number(c("description"), (r"([0-9]{2,4})\s*(?:EUR|euros|kg|km|%)",), 0, 9999).cast("bigint").alias("amount"),
        mn.bounded_number(c("description"), (r"(?<![\w])((?:19|20)[0-9]{2})(?![\w])",), 1900, 2100).cast("bigint").alias("year"),
        F.regexp_count("description", F.lit("[0-9]+")).cast("bigint").alias("numbers"),
    )
