"""Detail payloads to enrichment rows; ``details.merge_details`` applies them (A12, D28, E-D8).

Raw tables: JSON details have source, source_id, payload; HTML details have source, source_id,
page_id, html. A column that a page says nothing about is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import lexicons as lx
from hearthline.functions import dates as dt, mining as mn, text as tx
from hearthline.sources import html

_LABEL_DATE = r"תאריך\s*יצירה\s*[:\s\u200f\u202a\u202c]*\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"

NESTED_DETAIL = " ".join("""struct<furnitureInfo:string, description:string,
 metaData:struct<description:string>,
 dates:struct<createdAt:string, updatedAt:string, endsAt:string, rebouncedAt:string>,
 inProperty:struct<includeElevator:boolean, includeParking:boolean, includeSecurityRoom:boolean,
   includeBalcony:boolean, includeAirconditioner:boolean, isRenovated:boolean>,
 additionalDetails:struct<squareMeterBuild:int, parkingSpacesCount:int, balconiesCount:int>>""".split())


def _yes(*tests: Column) -> Column:
    """TRUE when one holds, else NULL: details never switch a flag off."""
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return F.when(out, True)


def nested_details(raw: DataFrame, as_of_year: int) -> DataFrame:
    """Item details: the longest text is the description; flags, dates and areas are structured."""
    d = F.from_json("payload", NESTED_DETAIL)
    rows = raw.select("source", "source_id", d.alias("d"))
    c = lambda path: F.col(f"d.{path}")
    date = lambda n: dt.iso_date(dt.date_slice(c(f"dates.{n}")))
    text = tx.unescape_markup(tx.longest_of(c("furnitureInfo"), c("metaData.description"), c("description")))
    found = rows.select(
        "source", "source_id", tx.blank_to_null(text).alias("description"),
        date("createdAt").alias("created_at"), date("updatedAt").alias("updated_at"), date("endsAt").alias("ends_at"),
        date("rebouncedAt").alias("rebounced_at"), date("createdAt").alias("publish_date"), date("createdAt").alias("first_listed_date"),
        _yes(c("inProperty.includeElevator")).alias("elevator"),
        _yes(c("inProperty.includeParking"), c("additionalDetails.parkingSpacesCount") > 0).alias("parking"),
        _yes(c("inProperty.includeSecurityRoom")).alias("mamad"),
        _yes(c("inProperty.includeBalcony"), c("additionalDetails.balconiesCount") > 0).alias("balcony"),
        _yes(c("inProperty.includeAirconditioner")).alias("ac"), _yes(c("inProperty.isRenovated")).alias("renovated"),
        F.nullif(c("additionalDetails.squareMeterBuild"), F.lit(0)).alias("sqm_build"),
    )
    return found.withColumn("year_built", mn.year_built(F.col("description"), as_of_year))


_AGENCY_BODY = """description:string, size:double, field_size:double, garden_size:double, parking_spaces:int,
 floor:int, elevator:boolean, ac:boolean, air_conditioner:boolean, mamad:boolean, balcony:boolean,
 renovated:boolean, year_built:double, build_year:double, construction_year:double,
 photos:array<struct<url:string, image:string, full:string>>"""
AGENCY_DETAIL = " ".join(f"struct<body:struct<data:struct<{_AGENCY_BODY}>>>".split())


def agency_details(raw: DataFrame, as_of_year: int) -> DataFrame:
    """Agency details: structured sizes first, the text fills the rest."""
    rows = raw.select("source", "source_id", F.from_json("payload", AGENCY_DETAIL)["body"]["data"].alias("d"))
    c = lambda path: F.col(f"d.{path}")
    size = lambda n: F.when(c(n) > 0, c(n).cast("int"))
    text = F.coalesce(c("description"), F.lit(""))
    photos = F.transform(c("photos"), lambda p: F.coalesce(
        tx.blank_to_null(p["url"]), tx.blank_to_null(p["image"]), tx.blank_to_null(p["full"])))
    year = F.coalesce(*[F.nullif(c(n), F.lit(0.0)) for n in ("year_built", "build_year", "construction_year")])
    return rows.select(
        "source", "source_id", tx.blank_to_null(text).alias("description"), size("size").alias("sqm"),
        F.coalesce(mn.lot_area_loose(text, mn.LOT_AGENCY), size("field_size")).alias("lot_sqm"),
        F.coalesce(mn.garden_area(text), size("garden_size")).alias("garden_sqm"), mn.units_count_brief(text).alias("units_count"),
        _yes(c("parking_spaces") > 0).alias("parking"), c("floor").alias("floor"), _yes(c("elevator")).alias("elevator"),
        _yes(c("ac"), c("air_conditioner")).alias("ac"), _yes(c("mamad")).alias("mamad"), _yes(c("balcony")).alias("balcony"),
        _yes(c("renovated")).alias("renovated"), F.array_compact(photos).alias("images"),
        F.coalesce(F.when(year.between(1900, 2100), year.cast("int")), mn.year_built(text, as_of_year)).alias("year_built"),
    )


def _whole_page(pages: DataFrame) -> DataFrame:
    """The page's root element with its listing key; a page without a root tag is its own root."""
    return html.fragments(pages, "html", carry=("source", "source_id"), whole=True)


def _limited(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.left(text, F.lit(limit))


def icon_details(pages: DataFrame, as_of_year: int, description_limit: int | None = None) -> DataFrame:
    """Floor icon, check/times amenity icons, description tag, creation date label, agency words.

    ``description_limit`` cuts the description for a feed that asks for it; by default it is whole.
    """
    n = "nodes"
    page = _whole_page(pages).withColumn("_text", F.get(n, F.lit(0))["text"])
    icons = F.transform(
        F.filter(n, lambda x: (x["tag"] == "i") & F.arrays_overlap(x["classes"], tx.literal_array(["fa-check", "fa-times"]))),
        lambda x: F.struct(F.col("_labels")[x["parent"]].alias("label"), F.array_contains(x["classes"], "fa-check").alias("checked")),
    )
    page = page.withColumn("_labels", F.transform(n, lambda x: x["text"])).withColumn("_icons", icons)
    flags = tx.icon_flags(F.col("_icons"))
    floor = lambda text: tx.group_of(text, r"קומה\s+(-?[0-9]+)").try_cast("int")
    description = tx.blank_to_null(html.attr_of(html.elements(n, "meta", attr="property", like="^og:description$"), "content"))
    measures = mn.text_measures(F.col("_text"))
    return page.select(
        "source", "source_id", _limited(F.trim(description), description_limit).alias("description"),
        F.coalesce(floor(html.icon_text(n, "fa-building")), floor(F.col("_text"))).alias("floor"),
        *[flag.alias(name) for name, flag in flags.items()], measures["rooms"].alias("rooms"), measures["sqm"].alias("sqm"),
        _yes(tx.any_of(html.text_of(html.elements(n, None, attr="class", like="card-contacts")), lx.AGENT_NAMES)).alias("is_agent"),
        F.try_to_date(tx.group_of(F.col("_text"), _LABEL_DATE), "d/M/yyyy").alias("first_listed_date"),
        F.coalesce(mn.year_built(description, as_of_year), mn.year_built(F.col("_text"), as_of_year)).alias("year_built"),
    )


def text_details(pages: DataFrame, as_of_year: int, description_limit: int | None = None) -> DataFrame:
    """Everything from the page's running text: flags, floor, year, picture links.

    ``description_limit`` cuts the description for a feed that asks for it; by default it is whole.
    """
    text = F.col("_text")
    page = _whole_page(pages).withColumn("_text", F.get("nodes", F.lit(0))["text"])
    images = F.transform(html.elements("nodes", "img", attr="src", like="picNum"), lambda x: F.try_element_at(x["attrs"], F.lit("src")))
    return page.select(
        "source", "source_id", _limited(text, description_limit).alias("description"),
        *[_yes(flag).alias(name) for name, flag in tx.keyword_flags(F.lower(text)).items()],
        mn.text_measures(text)["floor"].alias("floor"), images.alias("images"), mn.year_built(text, as_of_year).alias("year_built"),
    )


def labelled_details(pages: DataFrame, as_of_year: int) -> DataFrame:
    """Labelled rows ('strong' label, 'span' value) and a feature list."""
    n = "nodes"
    page = _whole_page(pages).withColumn("_rows", tx.let(html.elements(n, "span"), lambda spans: F.transform(
        html.inside(html.elements(n, "strong"), html.elements(n, "li")),
        lambda s: F.struct(s["text"].alias("label"), F.get(F.filter(
            spans, lambda v: (v["parent"] == s["parent"]) & (v["i"] > s["i"])), F.lit(0))["text"].alias("value")),
    )))
    number = lambda *words: tx.first_int(F.get(F.filter("_rows", lambda r: tx.any_of(r["label"], words)), F.lit(0))["value"]).cast("int")
    features = F.transform(
        html.inside(html.elements(n, "a"), html.elements(n, None, attr="id", like="^property-features-wrap$")), lambda a: a["text"])
    flags = tx.keyword_flags(F.array_join(features, " "))
    has_yard = F.exists("_rows", lambda r: tx.any_of(r["label"], ["חצר", "מרפס"]))
    flags["balcony"] = flags["balcony"] | has_yard
    year = number("שנת בני")
    built = number("שטח בנוי")
    return page.select(
        "source", "source_id", number("מגרש").alias("lot_sqm"), built.alias("sqm"), built.alias("sqm_build"),
        F.when(number("חצר", "מרפס") > 0, number("חצר", "מרפס")).alias("garden_sqm"), F.when(number("יחידות") > 0, number("יחידות")).alias("units_count"),
        F.when(year.between(1900, 2100), year).alias("year_built"), *[_yes(f).alias(k) for k, f in flags.items()],
        F.filter(features, lambda t: t != "").alias("tags"),
    )


# fixed values: where the catalog feed's pages hold description, tags, floor and pictures
CATALOG_NODES = {"description": "rich-text-block-2", "tags": "tags-wrapper", "tag": "greentags", "hidden": "w-condition-invisible",
                 "floors": ("floor-str", "floor-number"), "gallery": "collection-small-imegs-item-5"}


def catalog_details(pages: DataFrame, as_of_year: int) -> DataFrame:
    """Description node with plot, garden and year; visible tags with their flags; floor node; gallery pictures.

    A page without a description node says nothing about description, plot, garden and year.
    """
    n, at = "nodes", CATALOG_NODES
    page = _whole_page(pages).withColumns({
        "_text": tx.blank_to_null(F.trim(html.text_of(html.elements(n, None, at["description"])))),
        "_tags": F.transform(
            F.filter(html.inside(html.elements(n, None, at["tag"]), F.slice(html.elements(n, None, at["tags"]), 1, 1)),
                     lambda x: ~F.array_contains(x["classes"], at["hidden"])),
            lambda x: F.trim(x["text"])),
    })
    flags = tx.keyword_flags(F.array_join("_tags", " "))
    style = lambda a: F.coalesce(F.try_element_at(a["attrs"], F.lit("style")), F.lit(""))
    pictures = F.transform(html.inside(html.elements(n, "a", attr="style", like="background-image"), html.elements(n, None, at["gallery"])),
                           lambda a: tx.group_of(style(a), r"url\(\"?([^\"')]+)\"?\)"))
    floors = [html.first(html.elements(n, None, cls))["text"] for cls in at["floors"]]
    return page.select(
        "source", "source_id", F.col("_text").alias("description"), mn.lot_area_loose(F.col("_text")).alias("lot_sqm"),
        mn.garden_area(F.col("_text")).alias("garden_sqm"), mn.year_built(F.col("_text"), as_of_year).alias("year_built"),
        F.filter("_tags", lambda t: t != "").alias("tags"), *[_yes(f).alias(k) for k, f in flags.items()],
        tx.first_int(F.coalesce(*floors)).cast("int").alias("floor"), F.array_compact(pictures).alias("images"),
    )


# fixed values: where the article feed's pages hold description, features and pictures
ARTICLE_NODES = {"described": "^9ce8f", "text": "elementor-widget-text-editor", "box": "elementor-widget-container",
                 "features": "^73430878$", "feature": "elementor-heading-title", "gallery": "easy-image-gallery", "slide": "swiper-slide"}
#: A description is longer than this, and no error page.
SHORTEST, ERROR = 20, "403"


def article_details(pages: DataFrame, as_of_year: int) -> DataFrame:
    """The first description node with a real text, with plot, garden and year; feature headings with their flags; pictures.

    Nodes marked as the description come before other text nodes. A page without one says nothing about description, plot,
    garden and year.
    """
    n, at = "nodes", ARTICLE_NODES
    boxes = html.elements(n, None, at["box"])
    told = F.concat(html.inside(boxes, html.elements(n, None, attr="data-id", like=at["described"])),
                    html.inside(boxes, html.elements(n, None, at["text"])))
    real = F.filter(F.transform(told, lambda x: F.trim(x["text"])), lambda t: (F.length(t) > SHORTEST) & ~t.contains(ERROR))
    page = _whole_page(pages).withColumns({
        "_text": F.get(real, F.lit(0)),
        "_tags": F.transform(html.inside(html.elements(n, "h5", at["feature"]), html.elements(n, "section", attr="data-id", like=at["features"])),
                             lambda x: F.trim(x["text"])),
    })
    flags = tx.keyword_flags(F.array_join("_tags", " "))
    value = lambda x, name: F.try_element_at(x["attrs"], F.lit(name))
    linked = F.transform(html.inside(html.elements(n, "a", attr="data-fancybox"), html.elements(n, "ul", at["gallery"])), lambda a: value(a, "href"))
    slides = F.transform(html.inside(html.elements(n, "img", attr="src"), html.elements(n, None, at["slide"])), lambda i: value(i, "src"))
    pictures = F.concat(linked, F.filter(slides, lambda x: ~x.endswith(".svg")))
    return page.select(
        "source", "source_id", F.col("_text").alias("description"), mn.lot_area_loose(F.col("_text"), mn.LOT_ARTICLE).alias("lot_sqm"),
        mn.garden_area(F.col("_text")).alias("garden_sqm"), mn.year_built(F.col("_text"), as_of_year).alias("year_built"),
        F.filter("_tags", lambda t: t != "").alias("tags"), *[_yes(f).alias(k) for k, f in flags.items()],
        F.filter(F.array_compact(pictures), lambda x: x != "").alias("images"),
    )
