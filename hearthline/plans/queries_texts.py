"""String functions, identifiers and keyword tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import lexicons as lx
from hearthline.functions import text as tx
from hearthline.operators.windows import fixed_batches
from hearthline.plans.registry import query
from hearthline.sources.tables import listings, posts, read_table, texts

c = F.col
SPACES = r"[\s\x{0B}\x{85}\p{Z}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_case(table: dict[str, str], value: str) -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return f"CASE {value} {arms} ELSE {value} END"


# an address with abbreviations, marks, quote variants and uneven spaces around the table's values
RAW_ADDRESS_SQL = """
CASE line_no % 4 WHEN 0 THEN 'רח׳ ' || street || '  ' || house_number
  WHEN 1 THEN 'רחוב ' || street || ' דירה ' || house_number || 'א'
  WHEN 2 THEN 'שָׁכ' || chr(39) || ' ' || street || chr(9) || ' ממ״ד' ELSE '  הר־' || street || ' חד ' END
"""


def raw_address():
    return (
        F.when(c("line_no") % 4 == 0, F.concat(F.lit("רח׳ "), c("street"), F.lit("  "), c("house_number")))
        .when(c("line_no") % 4 == 1, F.concat(F.lit("רחוב "), c("street"), F.lit(" דירה "), c("house_number"), F.lit("א")))
        .when(c("line_no") % 4 == 2, F.concat(F.lit("שָׁכ' "), c("street"), F.lit("\t ממ״ד")))
        .otherwise(F.concat(F.lit("  הר־"), c("street"), F.lit(" חד ")))
    )


STRIPPED_SQL = r"regexp_replace(replace(raw, '־', ' '), '[\x{0591}-\x{05C7}]', '', 'g')"
TOKENS_SQL = (
    "list_filter(list_transform(string_split(trim(regexp_replace("
    f"translate({STRIPPED_SQL}, '׳’‘״“”', '''''''\"\"\"'), '{SPACES}+', ' ', 'g')), ' '), "
    f"lambda t: {sql_case(lx.ADDRESS_ABBREVIATIONS, 't')}), lambda t: t <> '')"
)
ADDRESS_SQL = f"""
, addr AS (SELECT source, source_id, rooms, sqm, city, {RAW_ADDRESS_SQL} AS raw FROM listings),
  norm AS (SELECT *, {TOKENS_SQL} AS tokens FROM addr)
"""


@query("text_normalize", ADDRESS_SQL + r"""
SELECT source, source_id, regexp_replace(raw, '[\x{0591}-\x{05C7}]', '', 'g') AS stripped,
       array_to_string(tokens, ' ') AS normal FROM norm
""")
def text_normalize(spark, folder):
    return listings(spark, folder).withColumn("raw", raw_address()).select(
        "source", "source_id", tx.strip_marks(c("raw")).alias("stripped"), tx.normalize_text(c("raw")).alias("normal")
    )


@query("address_key", ADDRESS_SQL + f"""
SELECT source, source_id,
       array_to_string(list_filter(tokens, lambda t: NOT list_contains({sql_list(lx.ADDRESS_STOPWORDS)}, t)), ' ') AS address_key
FROM norm
""")
def address_key(spark, folder):
    return listings(spark, folder).select(
        "source", "source_id", tx.canonicalize_address(raw_address()).alias("address_key")
    )


@query("street_number", ADDRESS_SQL + r"""
SELECT source, source_id,
       CASE WHEN regexp_matches(tokens[-1], '^[0-9]+[A-Za-zא-ת]?$') THEN array_to_string(tokens[:-2], ' ')
            ELSE array_to_string(tokens, ' ') END AS street,
       CASE WHEN regexp_matches(tokens[-1], '^[0-9]+[A-Za-zא-ת]?$') THEN tokens[-1] ELSE '' END AS number
FROM norm
""")
def street_number(spark, folder):
    return listings(spark, folder).withColumn("s", tx.street_number(raw_address())).select(
        "source", "source_id", "s.street", "s.number"
    )


@query("buckets", """
SELECT source, source_id, coalesce((floor(x / 10) * 10)::BIGINT::VARCHAR, '') AS area_bucket,
       coalesce((round_even(r * 2, 0) / 2)::DOUBLE::VARCHAR, '') AS rooms_bucket
FROM (SELECT source, source_id, CASE WHEN line_no <> 4 THEN sqm END AS x,
             CASE WHEN line_no <> 5 THEN rooms + (line_no % 3) * 0.2::DOUBLE END AS r FROM listings)
""")
def buckets(spark, folder):
    rows = listings(spark, folder).withColumns({
        "x": F.when(c("line_no") != 4, c("sqm")),
        "r": F.when(c("line_no") != 5, c("rooms") + (c("line_no") % 3) * F.lit(0.2)),
    })
    return rows.select(
        "source", "source_id", tx.area_bucket(c("x")).alias("area_bucket"), tx.rooms_bucket(c("r")).alias("rooms_bucket")
    )


@query("one_line_and_search_text", r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(description, '[\r\n]', ' ', 'g'), ' {2,}', ' ', 'g'))) AS one_line,
       sha256(lower(description || ' ' || array_to_string(tags, ' '))) AS search_text FROM texts
""")
def one_line_and_search_text(spark, folder):
    return texts(spark, folder).select(
        "doc_id", F.sha2(tx.one_line(c("description")), 256).alias("one_line"),
        F.sha2(tx.search_text(c("description"), c("tags")), 256).alias("search_text"),
    )


PRICE_TEXT_SQL = """
CASE line_no % 5 WHEN 0 THEN format('{:,}', price) || ' ₪' WHEN 1 THEN '₪' || (price // 1000)::VARCHAR || 'K'
  WHEN 2 THEN (price // 1000000)::VARCHAR || '.' || lpad((price // 10000 % 100)::VARCHAR, 2, '0') || 'm' WHEN 3 THEN 'ask' ELSE '0 ₪' END
"""


@query("parse_price", f"""
SELECT source, source_id, CASE WHEN v > 0 THEN v END AS price FROM (SELECT source, source_id,
  floor(try_cast(replace(regexp_extract(t, '([0-9,.]+)\\s*([kKmM]?)', 1), ',', '') AS DOUBLE)
   * CASE lower(regexp_extract(t, '([0-9,.]+)\\s*([kKmM]?)', 2)) WHEN 'k' THEN 1000.0::DOUBLE WHEN 'm' THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END)::BIGINT AS v
  FROM (SELECT source, source_id, replace({PRICE_TEXT_SQL}, '₪', '') AS t FROM listings))
""")
def parse_price(spark, folder):
    kind = c("line_no") % 5
    text = (
        F.when(kind == 0, F.concat(F.format_number("price", 0), F.lit(" ₪")))
        .when(kind == 1, F.concat(F.lit("₪"), F.floor(c("price") / 1000).cast("string"), F.lit("K")))
        .when(kind == 2, F.concat(
            F.floor(c("price") / 1000000).cast("string"), F.lit("."),
            F.lpad((F.floor(c("price") / 10000) % 100).cast("string"), 2, "0"), F.lit("m")))
        .when(kind == 3, "ask").otherwise("0 ₪")
    )
    return listings(spark, folder).select("source", "source_id", tx.parse_price(text).alias("price"))


@query("parse_numbers", r"""
SELECT doc_id, md5(regexp_replace(description, '[^0-9]', '', 'g')) AS digits,
       try_cast(nullif(regexp_replace(description, '[^0-9]', '', 'g'), '') AS BIGINT) AS digit_value,
       try_cast(nullif(regexp_extract(replace(description, ',', ''), '([0-9]+)', 1), '') AS BIGINT) AS first_int,
       try_cast(nullif(regexp_extract(description, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS first_float,
       regexp_extract(description, '([0-9]+[A-Za-z]?)\s*$', 1) AS trailing FROM texts
""")
def parse_numbers(spark, folder):
    text = c("description")
    return texts(spark, folder).select(
        "doc_id", F.md5(F.regexp_replace(text, "[^0-9]", "")).alias("digits"), tx.digits(text).alias("digit_value"),
        tx.first_int(text).alias("first_int"), tx.first_float(text).alias("first_float"), tx.trailing_number(text).alias("trailing"),
    )


NUMBERED = r"^(.+?)\s+([0-9]+[א-ת]?)$"


@query("split_address", rf"""
, a AS (SELECT source, source_id, city, neighborhood, street, house_number, line_no % 3 AS kind FROM listings)
SELECT source, source_id,
  city || '|' || neighborhood || '|' || street || ' ' || house_number || '|' || house_number AS city_first,
  CASE kind WHEN 0 THEN street || '|' || house_number || '||' || '{lx.DEFAULT_CITY}'
            WHEN 1 THEN street || '|' || house_number || '||' || city
            ELSE street || '|' || house_number || '|' || neighborhood || '|' || city END AS street_first,
  CASE kind WHEN 0 THEN street || '|' || house_number || '||' || 'NATION'
            WHEN 1 THEN street || '|' || house_number || '||' || city
            ELSE street || '|' || house_number || '|' || neighborhood || '|' || neighborhood END AS either_order,
  CASE WHEN kind = 2 THEN street || '|' ELSE street || '|' || house_number || '/a' END AS deal_street
FROM a
""")
def split_address(spark, folder):
    rows = listings(spark, folder).withColumn("kind", c("line_no") % 3)
    numbered = F.concat_ws(" ", "street", "house_number")
    first = F.concat_ws(", ", "city", "neighborhood", numbered)
    street_first = F.when(c("kind") == 0, numbered).when(
        c("kind") == 1, F.concat_ws(", ", numbered, "city")
    ).otherwise(F.concat_ws(", ", numbered, "neighborhood", "city"))
    either = F.when(c("kind") == 0, F.concat(F.lit("רחוב NATION "), numbered)).when(
        c("kind") == 1, F.concat_ws(", ", "city", numbered)
    ).otherwise(F.concat_ws(", ", "city", "neighborhood", numbered))
    deal = F.when(c("kind") == 2, c("street")).otherwise(F.concat(numbered, F.lit("/a")))
    flat = lambda s, *names: F.concat_ws("|", *[s[n] for n in names])
    rows = rows.withColumns({
        "a1": tx.split_address_city_first(first), "a2": tx.split_address_street_first(street_first),
        "a3": tx.split_address_either_order(either, prefixes=["NATION"]), "a4": tx.split_street_number(deal),
    })
    return rows.select(
        "source", "source_id",
        flat(c("a1"), "city", "neighborhood", "street", "house_number").alias("city_first"),
        flat(c("a2"), "street", "house_number", "neighborhood", "city").alias("street_first"),
        flat(c("a3"), "street", "house_number", "neighborhood", "city").alias("either_order"),
        flat(c("a4"), "street", "house_number").alias("deal_street"),
    )


CITY_TITLES = ["NATION_12 small", "NATION_1", "NATION_2"]


@query("city_title", r"""
SELECT source, source_id, CASE WHEN starts_with(t, 'NATION_12 small') THEN 'NATION_12 small'
    WHEN starts_with(t, 'NATION_1') THEN 'NATION_1' WHEN starts_with(t, 'NATION_2') THEN 'NATION_2'
    ELSE string_split(t, ' ')[1] END AS city,
  CASE WHEN starts_with(t, 'NATION_12 small') THEN trim(t[16:]) WHEN starts_with(t, 'NATION_1') OR starts_with(t, 'NATION_2')
    THEN trim(t[9:]) ELSE array_to_string(string_split(t, ' ')[2:], ' ') END AS neighborhood
FROM (SELECT source, source_id, city || ' ' || street AS t FROM listings)
""")
def city_title(spark, folder):
    split = tx.split_city_title(F.concat_ws(" ", "city", "street"), CITY_TITLES)
    return listings(spark, folder).withColumn("s", split).select("source", "source_id", "s.city", "s.neighborhood")


@query("merge_address", """
SELECT source, source_id, CASE line_no % 3 WHEN 0 THEN street || ' ' || house_number WHEN 1 THEN
  CASE WHEN ends_with(street, house_number) THEN street ELSE street || ' ' || house_number END ELSE street END AS address
FROM listings
""")
def merge_address(spark, folder):
    street = F.when(c("line_no") % 3 == 0, F.concat_ws(" ", "street", "house_number")).otherwise(c("street"))
    house = F.when(c("line_no") % 3 < 2, c("house_number"))
    return listings(spark, folder).select("source", "source_id", tx.merge_address(street, house).alias("address"))


@query("url_and_title", r"""
SELECT page_id, string_split(url, '?')[1] AS path,
  CASE page_id % 3 WHEN 0 THEN 'https:' || regexp_extract(url, '^https?:(//.*)$', 1)
    WHEN 1 THEN 'https://board.example' || regexp_extract(url, '^https?://[^/]*(/.*)$', 1)
    ELSE 'https://board.example/' || regexp_extract(url, '^https?://[^/]*/(.*)$', 1) END AS absolute,
  regexp_extract(url, '/([^/?#]+)(?:[?#].*)?$', 1) AS slug FROM pages
""")
def url_and_title(spark, folder):
    kind = c("page_id") % 3
    link = (
        F.when(kind == 0, F.regexp_extract("url", "^https?:(//.*)$", 1))
        .when(kind == 1, F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1))
        .otherwise(F.regexp_extract("url", "^https?://[^/]*/(.*)$", 1))
    )
    return read_table(spark, folder, "pages").select(
        "page_id", tx.url_path(c("url")).alias("path"),
        tx.absolutize(link, "https://board.example", relative=True).alias("absolute"),
        F.regexp_extract("url", r"/([^/?#]+)(?:[?#].*)?$", 1).alias("slug"),
    )


@query("post_titles", f"""
SELECT post_id, CASE WHEN length(line) > 160 THEN line[1:159] || '…' ELSE line END AS title FROM (
  SELECT post_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'),
    lambda x: trim(regexp_replace(x, '{SPACES}+', ' ', 'g'))), lambda x: x <> '')[1], '') AS line FROM posts)
""")
def post_titles(spark, folder):
    return posts(spark, folder).select("post_id", tx.title_of(c("text")).alias("title"))


@query("map_links", """
SELECT source, source_id, CASE WHEN floor IS NULL THEN
  'https://www.google.com/maps/search/?api=1&query=' || replace(url_encode(street || ' ' || house_number || ', ' || city || ', ישראל'), '%2F', '/')
  ELSE 'https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=' || lat::VARCHAR || ',' || lon::VARCHAR END AS link
FROM (SELECT *, round(32.0 + (supplier_id % 100) / 1000.0, 3) AS x FROM listings)
""")
def map_links(spark, folder):
    at = lambda col: F.when(c("floor").isNotNull(), c(col))
    return listings(spark, folder).select(
        "source", "source_id",
        tx.map_link(at("lat"), at("lon"), F.concat_ws(" ", "street", "house_number"), c("city"), "ישראל").alias("link"),
    )


@query("cell_rendering", """
SELECT source, source_id, CASE WHEN is_agent THEN 'yes' ELSE '' END AS agent_cell,
  coalesce(floor::VARCHAR, '') AS floor_cell, rooms::VARCHAR AS rooms_cell,
  price::VARCHAR AS price_norm,
  CASE line_no % 3 WHEN 0 THEN price::VARCHAR WHEN 1 THEN 'n/a' END AS price_back,
  CASE WHEN line_no % 3 <> 2 THEN (rooms + 0.5)::DOUBLE::VARCHAR END AS rooms_back
FROM listings
""")
def cell_rendering(spark, folder):
    shown = F.format_number("price", 0)
    price_cell = F.when(c("line_no") % 3 == 0, F.concat(shown, F.lit(".00"))).when(c("line_no") % 3 == 1, " n/a ").otherwise("")
    rooms_cell = F.when(c("line_no") % 3 != 2, F.concat((c("rooms") + 0.5).cast("string"), F.lit("0")))
    return listings(spark, folder).select(
        "source", "source_id", tx.cell_text(c("is_agent"), "boolean").alias("agent_cell"),
        tx.cell_text(c("floor")).alias("floor_cell"), tx.cell_text(c("rooms"), "double").alias("rooms_cell"),
        tx.cell_norm(shown).alias("price_norm"),
        tx.coerce_cell_back(price_cell, "bigint").alias("price_back"),
        tx.coerce_cell_back(rooms_cell, "double").alias("rooms_back"),
    )


@query("reasons_summary", """
SELECT source, source_id, array_to_string(list_filter([
  CASE WHEN is_agent THEN 'seller:-0.48' ELSE 'seller:+0.72' END,
  CASE WHEN line_no % 2 = 0 THEN 'parking:+1' END,
  'age:+' || (2001 - year_built)::VARCHAR,
  'half:' || CASE WHEN rooms = 3 THEN '0' WHEN rooms > 3 THEN '+' ELSE '' END || CASE WHEN rooms = 3 THEN '' ELSE
     CASE WHEN (rooms - 3) % 1 = 0 THEN (rooms - 3)::INTEGER::VARCHAR ELSE (rooms - 3)::DOUBLE::VARCHAR END END,
  CASE WHEN floor IS NOT NULL THEN 'label:' || neighborhood END], lambda x: x IS NOT NULL)[1:4], ', ') AS summary
FROM listings
""")
def reasons_summary(spark, folder):
    pairs = [
        ("seller", F.when(c("is_agent"), -0.48).otherwise(0.72), "number"),
        ("parking", F.when(c("line_no") % 2 == 0, True), "boolean"),
        ("age", F.lit(2001) - c("year_built"), "number"),
        ("half", c("rooms") - 3, "number"),
        ("label", F.when(c("floor").isNotNull(), c("neighborhood")), "string"),
    ]
    return listings(spark, folder).select("source", "source_id", tx.reasons_summary(pairs, 4).alias("summary"))


WORDS = {"parking": ["thre", "que"], "balcony": ["und", "para"], "ac": ["£", "%%%"], "mamad": ["tion,"]}
PHRASES = ["of the", "de la", "est", "ing and", "und"]


@query("keyword_flags", """
SELECT doc_id, (contains(t, 'thre') OR contains(t, 'que'))::INTEGER AS parking,
  (contains(t, 'und') OR contains(t, 'para'))::INTEGER AS balcony,
  (contains(t, '£') OR contains(t, '%%%'))::INTEGER AS ac, contains(t, 'tion,')::INTEGER AS mamad
FROM (SELECT doc_id, lower(description || ' ' || array_to_string(tags, ' ')) AS t FROM texts)
""")
def keyword_flags(spark, folder):
    rows = texts(spark, folder).withColumn("t", tx.search_text(c("description"), c("tags")))
    flags = tx.keyword_flags(c("t"), WORDS)
    return rows.select("doc_id", *[v.cast("int").alias(k) for k, v in flags.items()])


@query("phrase_hits", f"""
SELECT doc_id, array_to_string(list_filter({sql_list(PHRASES)}, lambda p: contains(lower(description), p)), '|') AS phrases,
  regexp_matches(lower(description), '(^|[^a-zà-ÿ])est([^a-zà-ÿ]|$)')::INTEGER AS standalone,
  len(regexp_extract_all(description, 'tion'))::BIGINT AS mentions FROM texts
""")
def phrase_hits(spark, folder):
    low = F.lower("description")
    return texts(spark, folder).select(
        "doc_id", F.array_join(tx.phrase_hits(low, PHRASES), "|").alias("phrases"),
        tx.standalone_word(low, "est", "a-zà-ÿ").cast("int").alias("standalone"),
        F.regexp_count("description", F.lit("tion")).cast("bigint").alias("mentions"),
    )


@query("agent_flag", """
SELECT source, source_id, (line_no % 6 = 0 OR part_id % 11 = 0 OR supplier_id % 13 = 0 OR part_id % 17 = 0
   OR (order_id % 19 = 0) OR (order_id % 23 = 0) OR contains(street, 'red'))::INTEGER AS agent FROM listings
""")
def agent_flag(spark, folder):
    every = lambda col, k, yes, no=None: F.when(c(col) % k == 0, yes).otherwise(F.lit(no))
    agent = tx.detect_agent(
        every("line_no", 6, "platinum", "private"), every("part_id", 11, "Broker", "owner"),
        every("supplier_id", 13, "House & Co"), every("part_id", 17, "AGENCY"),
        every("order_id", 19, "RE/MAX north"), every("order_id", 23, "סוכנות צפון"),
        F.when(c("street").contains("red"), "תיווך"),
    )
    return listings(spark, folder).select("source", "source_id", agent.cast("int").alias("agent"))


@query("icon_flags", """
SELECT source, source_id,
  CASE WHEN line_no % 2 = 0 OR line_no % 3 = 0 THEN (line_no % 2 = 0 AND part_id % 2 = 0 OR line_no % 3 = 0 AND part_id % 3 = 0)::INTEGER END AS parking,
  (part_id % 5 = 0)::INTEGER AS elevator, CASE WHEN line_no = 1 THEN 0 END AS balcony FROM listings
""")
def icon_flags(spark, folder):
    icon = lambda label, on: F.struct(label.alias("label"), on.alias("checked"))
    icons = F.array(
        icon(F.when(c("line_no") % 2 == 0, "חניה").otherwise(""), c("part_id") % 2 == 0),
        icon(F.when(c("line_no") % 3 == 0, "חניה תת קרקעית").otherwise(""), c("part_id") % 3 == 0),
        icon(F.lit("מעלית"), c("part_id") % 5 == 0),
        icon(F.when(c("line_no") == 1, "מרפסת שמש").otherwise(""), F.lit(False)),
        icon(F.concat(F.lit("מרפסת "), F.repeat(F.lit("x"), 30)), F.lit(True)),
    )
    flags = tx.icon_flags(icons)
    return listings(spark, folder).select(
        "source", "source_id", *[flags[k].cast("int").alias(k) for k in ("parking", "elevator", "balcony")]
    )


@query("property_types", """
SELECT source, source_id, CASE neighborhood WHEN 'ECONOMY' THEN 'flat' WHEN 'SMALL' THEN 'studio' ELSE neighborhood END AS listing_type
FROM listings
""")
def property_types(spark, folder):
    mapped = tx.property_type(c("neighborhood"), {"ECONOMY": "flat", "SMALL": "studio"})
    return listings(spark, folder).select("source", "source_id", mapped.alias("listing_type"))


@query("stable_ids", """
SELECT source, source_id, 'CAN-' || sha1(street || '|' || house_number)[1:12] AS canonical_id,
  sha1(lower(city || '|' || neighborhood || '|' || street || '|' || house_number))[1:16] AS address_hash,
  sha256(street || '|' || CASE WHEN line_no % 2 = 0 THEN neighborhood || ' ' || city || '|' ELSE '' END || city)[1:16] AS text_hash
FROM listings
""")
def stable_ids(spark, folder):
    tags = F.when(c("line_no") % 2 == 0, F.array("neighborhood", "city")).otherwise(F.array().cast("array<string>"))
    return listings(spark, folder).select(
        "source", "source_id", tx.canonical_id(F.concat_ws("|", "street", "house_number")).alias("canonical_id"),
        tx.address_hash(c("city"), c("neighborhood"), c("street"), c("house_number")).alias("address_hash"),
        tx.text_hash(c("street"), tags, c("city")).alias("text_hash"),
    )


@query("prompt_batches", """
SELECT doc_id, lang, (pos // 20)::BIGINT AS batch_no, (pos % 20)::BIGINT AS idx,
  sha256(left(description || ' | תגיות: ' || lang || ' ' || source || ' | כתובת: ' || source, 900)) AS chunk
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM texts)
""")
def prompt_batches(spark, folder):
    rows = fixed_batches(texts(spark, folder), ["lang"], ["doc_id"], 20, F.floor(c("doc_id") / 4096))
    return rows.select(
        "doc_id", "lang", "batch_no", "idx",
        F.sha2(tx.prompt_chunk(c("description"), c("tags"), c("source")), 256).alias("chunk"),
    )


@query("longest_text", r"""
SELECT doc_id, sha256(CASE WHEN length(b) > length(CASE WHEN length(a) >= length(l) THEN a ELSE l END) THEN b
   WHEN length(a) >= length(l) THEN a ELSE l END) AS longest
FROM (SELECT d.doc_id, trim(d.text) AS a, trim(coalesce(b.text, '')) AS b, d.lang AS l
      FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id)
""")
def longest_text(spark, folder):
    docs = read_table(spark, folder, "documents")
    bench = read_table(spark, folder, "benchmark").select(c("item_id").alias("doc_id"), c("text").alias("other"))
    return docs.join(bench, "doc_id", "left").select(
        "doc_id", F.sha2(tx.longest_of(c("text"), c("lang"), c("other")), 256).alias("longest")
    )


@query("text_edges", """
SELECT post_id, chr(1488 + turn::INTEGER % 27) || 'é&lt;' AS decoded, NULL::INTEGER AS negated, 1 AS units,
  turn % 2 = 0 AS topic, turn % 3 = 0 AS word FROM posts
""")
def text_edges(spark, folder):
    """D9/D25/E-T1/C11: character references, signs beyond 16 bits before a negation, letters of other scripts, quoted words."""
    from hearthline.functions import mining as mn
    from hearthline.operators.filters import Topic, match_topics

    faces = F.repeat(F.lit("😀"), (c("turn") % 60).cast("int"))
    written = F.when(c("turn") % 2 == 0, "שולחנות").otherwise("שולח")
    word = F.when(c("turn") % 3 == 0, "x a+b").otherwise("x aab")
    return posts(spark, folder).select(
        "post_id", tx.unescape_markup(F.concat(F.lit("&#"), (c("turn") % 27 + 1488).cast("string"), F.lit(";&eacute;&amp;lt;"))).alias("decoded"),
        mn.units_count(F.concat(faces, F.lit("ללא יחידת דיור"))).alias("negated"),
        mn.units_count(F.concat(faces, F.lit(" יחידת דיור"))).alias("units"),
        (F.size(match_topics(written, [Topic("t", ["שולח\\w+"])])) == 1).alias("topic"), tx.standalone_word(word, "a+b").alias("word"),
    )
