"""HTML pages to rows.

``fragments`` is the only Python step: a small tokenizer that yields one row per card with the
card's elements as an array. Which element holds which fact is decided in Catalyst, with
higher-order functions over that array. Tables and script blocks need no parser and use regular
expressions in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline import lexicons as lx
from hearthline.functions import dates as dt, mining as mn, text as tx
from hearthline.functions.numeric import price_per_area
from hearthline.operators.windows import first_per_key
from hearthline.schema import canonical

CARDS_PER_BATCH = 256  # bounds the memory of a Python worker, not the result
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_NODE = pa.struct([
    ("i", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()),
    ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
])
_NODE_DDL = (
    "struct<i:int, last:int, parent:int, tag:string, classes:array<string>, attrs:map<string,string>, text:string>"
)


class _Elements(HTMLParser):
    """Flat element list: [last descendant, parent, tag, attrs, first text, end of texts], the last two being places in ``texts``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.texts: list[str] = []

    def updatepos(self, i, j):
        return j  # lines are not counted

    def handle_starttag(self, tag, attrs):
        index, at = len(self.rows), len(self.texts)
        self.rows.append([index, self.open[-1] if self.open else -1, tag, {k: v or "" for k, v in attrs}, at, at])
        if tag not in _VOID:
            self.open.append(index)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][2] == tag:
                self.end_from(depth)
                return

    def end_from(self, depth: int) -> None:
        """End the open elements from a depth on: what came since they opened is theirs."""
        for index in self.open[depth:]:
            row = self.rows[index]
            row[0], row[5] = len(self.rows) - 1, len(self.texts)
        del self.open[depth:]

    def handle_data(self, data):
        text = data.strip()
        if text and not (self.open and self.rows[self.open[-1]][2] in ("script", "style")):
            self.texts.append(text)

    def text_of(self, row: list) -> str:
        return " ".join(self.texts[row[4]:row[5]])


#: Plain markup: end tags, start tags with quoted attributes, and text. Anything else is the parser's.
_PLAIN = re.compile(
    r"""</([a-zA-Z][a-zA-Z0-9]*)>|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9:_-]*="[^"<>]*")*)[ \t\n]*>|([^<]+)|(<)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)="([^"]*)\"""")
#: Elements whose content parsers read in ways of their own.
_OWN_WAYS = {"script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


def _read_plain(page: _Elements, html: str) -> bool:
    """Read a page of plain markup without the parser's steps per sign; FALSE where it holds anything else."""
    for token in _PLAIN.finditer(html):
        end, start, attrs, text, other = token.groups()
        if text is not None:
            page.handle_data(unescape(text) if "&" in text else text)
        elif end is not None:
            page.handle_endtag(end.lower())
        elif other is not None or start.lower() in _OWN_WAYS:
            return False
        else:
            page.handle_starttag(start.lower(), [
                (name.lower(), unescape(value) if "&" in value else value) for name, value in _ATTRIBUTE.findall(attrs)])
    return True


def _parsed(html: str) -> _Elements:
    page = _Elements()
    if not _read_plain(page, html):
        page = _Elements()
        page.feed(html)
        page.close()
    page.end_from(0)
    return page


class _Nodes:
    """Lists of elements as Arrow columns, filled value by value: records per element cost several times as much."""

    def __init__(self) -> None:
        self.ends, self.class_ends, self.attr_ends = [0], [0], [0]
        self.plain: tuple[list, ...] = ([], [], [], [])
        self.classes: list[str] = []
        self.keys: list[str] = []
        self.values: list[str] = []
        self.texts: list[str | None] = []

    def add(self, row: list, index: int, base: int, text: str | None) -> None:
        i, last, parent, tag = self.plain
        attrs = row[3]
        i.append(index - base)
        last.append(row[0] - base)
        parent.append(row[1] - base)
        tag.append(row[2])
        if attrs:
            if "class" in attrs:
                self.classes.extend(attrs["class"].split())
            self.keys.extend(attrs)
            self.values.extend(attrs.values())
        self.class_ends.append(len(self.classes))
        self.attr_ends.append(len(self.keys))
        self.texts.append(text)

    def close_list(self) -> None:
        self.ends.append(len(self.texts))

    def array(self) -> pa.Array:
        text, at = pa.string(), lambda ends: pa.array(ends, pa.int32())
        i, last, parent, tag = (pa.array(v, _NODE.field(k).type) for k, v in enumerate(self.plain))
        classes = pa.ListArray.from_arrays(at(self.class_ends), pa.array(self.classes, text))
        attrs = pa.MapArray.from_arrays(at(self.attr_ends), pa.array(self.keys, text), pa.array(self.values, text))
        nodes = pa.StructArray.from_arrays([i, last, parent, tag, classes, attrs, pa.array(self.texts, text)], fields=list(_NODE))
        return pa.ListArray.from_arrays(at(self.ends), nodes)


def fragments(
    pages: DataFrame, tag: str, cls: str | None = None, attr: str | None = None, carry: Sequence[str] = (), whole: bool = False,
) -> DataFrame:
    """One row per matching element: page_id, position, nodes (itself first), above (its ancestors,
    nearest first), and the text columns ``carry`` of its page. With ``whole`` a page without the tag
    counts as one element of it."""
    key_type = pages.schema["page_id"].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type]
    out = pa.schema([("page_id", arrow_key), ("position", pa.int64()), ("nodes", pa.list_(_NODE)), ("above", pa.list_(_NODE)),
                     *[(name, pa.string()) for name in carry]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cards() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(keys, arrow_key), pa.array(positions, pa.int64()), below.array(), over.array(),
                *[pa.array(values, pa.string()) for values in carried]], schema=out)

        keys, positions, carried, below, over = [], [], [[] for _ in carry], _Nodes(), _Nodes()
        for batch in batches:
            page_values = [batch.column(name).to_pylist() for name in carry]
            for place, (page_id, html) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist())):
                html = html or ""
                page = _parsed(html)
                if whole and all(row[2] != tag for row in page.rows):
                    page = _parsed(f"<{tag}>{html}</{tag}>")
                for index, row in enumerate(page.rows):
                    attrs = row[3]
                    if row[2] != tag or (attr and attr not in attrs) or (cls and cls not in attrs.get("class", "").split()):
                        continue
                    up = row[1]
                    while up >= 0:
                        over.add(page.rows[up], up, index, None)
                        up = page.rows[up][1]
                    over.close_list()
                    for k in range(index, row[0] + 1):
                        below.add(page.rows[k], k, index, page.text_of(page.rows[k]))
                    below.close_list()
                    keys.append(page_id)
                    positions.append(index)
                    for values, found in zip(carried, page_values):
                        values.append(found[place])
                    if len(keys) >= CARDS_PER_BATCH:
                        yield cards()
                        keys, positions, carried, below, over = [], [], [[] for _ in carry], _Nodes(), _Nodes()
        yield cards()

    more = "".join(f", {name} string" for name in carry)
    return pages.select("page_id", "html", *carry).mapInArrow(
        parse, f"page_id {key_type}, position bigint, nodes array<{_NODE_DDL}>, above array<{_NODE_DDL}>{more}"
    )


# ---- choosing elements ------------------------------------------------------

def elements(nodes: Column | str, tag: str | None = None, cls: str | None = None, attr: str | None = None, like: str | None = None) -> Column:
    """Elements by tag, class, attribute and attribute pattern (``like`` matches attr's value)."""
    def test(n: Column) -> Column:
        ok = F.lit(True)
        if tag:
            ok = ok & n["tag"].isin(*tag.split("|"))
        if cls:
            ok = ok & F.array_contains(n["classes"], cls)
        if attr:
            value = F.try_element_at(n["attrs"], F.lit(attr))
            ok = ok & (value.rlike(like) if like else value.isNotNull())
            ok = F.coalesce(ok, F.lit(False))
        return ok
    return F.filter(nodes, test)


def inside(found: Column, anchors: Column) -> Column:
    """Those elements that lie below one of the anchors."""
    return tx.let(anchors, lambda at: F.filter(found, lambda n: F.exists(at, lambda a: (n["i"] > a["i"]) & (n["i"] <= a["last"]))))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def text_of(found: Column) -> Column:
    return F.coalesce(first(found)["text"], F.lit(""))


def attr_of(found: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(first(found)["attrs"], F.lit(name)), F.lit(""))


def icon_text(nodes: Column | str, marker: str, tag: str = "i", attr: str = "class", heading: str | None = None) -> Column:
    """Text around an icon: its parent's, or that of the nearest enclosing heading."""
    icon = first(elements(nodes, tag, attr=attr, like=marker))
    if heading is None:
        return F.coalesce(F.get(nodes, icon["parent"])["text"], F.lit(""))
    heads = tx.let(icon["i"], lambda at: F.filter(elements(nodes, heading), lambda h: (at > h["i"]) & (at <= h["last"])))
    return F.coalesce(tx.let(heads, lambda found: F.get(found, F.size(found) - 1)["text"]), F.lit(""))


N, ABOVE = "nodes", "above"


def _card(df: DataFrame, source: str, found: dict[str, Column]) -> DataFrame:
    """First card of an id over all pages, as canonical rows."""
    rows = df.select("page_id", "position", F.lit(source).alias("source"), *[v.alias(k) for k, v in found.items()])
    rows = rows.filter((F.coalesce("source_id", F.lit("")) != "") & F.col("price").isNotNull())
    rows = first_per_key(rows, ["source", "source_id"], [F.asc("page_id"), F.asc("position")])
    size = F.coalesce(F.nullif(F.col("sqm_build"), F.lit(0)), F.col("sqm")) if "sqm_build" in rows.columns else F.col("sqm")
    return canonical(rows.withColumn("price_per_sqm", price_per_area(F.col("price"), size)))


def _address(*names: str) -> Column:
    return F.concat_ws(", ", *[tx.blank_to_null(F.col(n)) for n in names])


def icon_cards(pages: DataFrame, source: str, base: str, cities: list[str] | None = None) -> DataFrame:
    """Cards whose facts hang on icons; text patterns help out."""
    cards = fragments(pages, "div", "overflow-hidden")
    link = attr_of(elements(N, "a", attr="href", like=r"/ad/[0-9]+"), "href")
    block = attr_of(elements(ABOVE, "div", "card-block"), "data-id")
    base_rows = cards.withColumns({
        "source_id": F.coalesce(tx.group_of(link, r"/ad/([0-9]+)"), tx.group_of(block, "^([0-9]+)$")),
        "whole": first(N)["text"], "title": tx.split_city_title(text_of(elements(N, "h2", "card-title")), cities),
        "street": text_of(elements(N, "p", "card-text")), "link": link, "price": tx.parse_price(text_of(elements(N, "div", "price"))),
    })
    c = F.col
    rooms = F.coalesce(tx.first_float(icon_text(N, "fa-bed")), mn.text_measures(c("whole"))["rooms"])
    sqm = F.coalesce(tx.first_float(icon_text(N, "fa-expand-arrows-alt")).cast("int"), mn.text_measures(c("whole"))["sqm"])
    image = tx.blank_to_null(attr_of(elements(N, "img"), "src"))
    return _card(base_rows, source, {
        "source_id": c("source_id"), "price": c("price"), "city": c("title.city"), "neighborhood": c("title.neighborhood"),
        "street": c("street"), "house_number": tx.trailing_number(c("street")), "rooms": rooms, "sqm": sqm, "sqm_build": sqm,
        "url": F.when(c("link").startswith("http"), c("link")).otherwise(F.concat(F.lit(base + "/ad/"), c("source_id"))),
        "is_agent": tx.any_of(F.lower("whole"), lx.AGENT_NAMES), "listing_type": F.lit("apartment"),
        "images": F.array_compact(F.array(tx.absolutize(image, base))),
        "tags": F.array_compact(F.array(F.when(c("whole").contains("מקודם"), "promoted"))),
        "address": F.concat_ws(", ", tx.blank_to_null(c("street")), tx.blank_to_null(c("title.neighborhood")), tx.blank_to_null(c("title.city"))),
    })


# fixed values: one-line summary 'type rooms (area) floor of total'
COMPOUND = "(.+?)\\s+([0-9.]+)\\s+חדרים\\s+\\(([0-9]+)\\s*מ[״\"']ר\\)\\s+קומה:\\s*(\\S+)\\s*(?:מתוך\\s*([0-9]+))?"


def table_cards(pages: DataFrame, source: str, base: str) -> DataFrame:
    """One table per ad with a compound details cell."""
    c = F.col
    rows = fragments(pages, "table").withColumns({
        "source_id": F.coalesce(
            tx.group_of(attr_of(F.slice(N, 1, 1), "id"), "modaaRow([0-9]+)"),
            tx.group_of(attr_of(F.slice(N, 1, 1), "onclick"), r"openModaaPop\(\s*\"[^\"]*\"\s*,\s*\"([0-9]+)\""),
        ),
        "place": tx.split_address_city_first(text_of(elements(N, "span", "LinkModaaTitle"))),
        "details": mn.compound_details(text_of(elements(N, "td", "tdMoreDetails")), COMPOUND),
        "headline": attr_of(elements(N, "div", attr="id", like="^dvMActions"), "bigtitle"),
    })
    image = tx.blank_to_null(attr_of(inside(elements(N, "img"), elements(N, "td", "tdGallery")), "src"))
    link = tx.blank_to_null(attr_of(elements(N, "a", attr="href", like="details"), "href"))
    box = first(elements(ABOVE, "div"))
    return _card(rows, source, {
        "source_id": c("source_id"), "price": tx.parse_price(text_of(elements(N, "td", "tdPrice")), decimals=False),
        "city": c("place.city"), "neighborhood": c("place.neighborhood"), "street": c("place.street"),
        "house_number": c("place.house_number"), "address": F.concat_ws(", ", *[tx.blank_to_null(c(f"place.{n}")) for n in ("street", "neighborhood", "city")]),
        "rooms": F.coalesce("details.rooms", tx.group_of(c("headline"), r"([0-9.]+)\s*חדרים?").try_cast("double")),
        "sqm": c("details.sqm"), "sqm_build": c("details.sqm"), "floor": c("details.floor"),
        "listing_type": F.coalesce(tx.blank_to_null(c("details.kind")), tx.group_of(c("headline"), r"^ל?\s*(.+?)\s*[0-9]"), F.lit("apartment")),
        "url": F.coalesce(tx.absolutize(link, base), F.concat(F.lit(base + "/details/?ad="), c("source_id"))),
        "images": F.array_compact(F.array(tx.absolutize(image, base))),
        "is_agent": ~F.coalesce(F.array_contains(box["classes"], "Private"), F.lit(False)),
    })


# fixed values: signs of an area label
AREA_LABELS = ["מ״ר", 'מ"ר', "מטר", "מ'", "מ׳ר", "שטח"]


def catalog_cards(pages: DataFrame, source: str, base: str) -> DataFrame:
    """Hidden data block; values and labels pair up by their order, then by position."""
    c = F.col
    data = elements(N, "div", "filter-data")
    below = lambda found, cls: inside(found, elements(N, None, cls))
    values = below(elements(N, None, "info-numbers-2"), "details-wrapper")
    labels = below(F.filter(N, lambda n: F.arrays_overlap(n["classes"], tx.literal_array(["apartment-details2", "apartment-details-2"]))), "details-wrapper")
    rows = fragments(pages, "div", "collection-item-3").withColumns({
        "pairs": F.zip_with(F.transform(values, lambda n: n["text"]), F.transform(labels, lambda n: n["text"]), lambda v, l: F.struct(v.alias("v"), F.coalesce(l, F.lit("")).alias("l"))),
        "raw_price": text_of(below(inside(elements(N, "div"), data), "div-price")),
        "description": text_of(elements(N, "p", "apartment-text")), "place": tx.split_address_street_first(text_of(elements(N, "h4", "address"))),
        "link": attr_of(elements(N, "a", "hot-appartment-cards"), "href"),
        "tags": F.filter(
            F.transform(F.filter(
                below(inside(elements(N, "div"), data), "div-tag"),
                lambda n: ~F.arrays_overlap(n["classes"], tx.literal_array(["w-condition-invisible", "apartment-type"])),
            ), lambda n: n["text"]), lambda t: t != ""),
        "kind": text_of(below(elements(N, None, "apartment-type"), "asset-type")),
    })
    is_area = lambda l: tx.any_of(l, AREA_LABELS)
    labelled = lambda test: first(F.filter("pairs", lambda p: test(p["l"])))["v"]
    plain = lambda k: F.when(
        ~F.get("pairs", F.lit(k))["l"].contains("חדר") & ~is_area(F.get("pairs", F.lit(k))["l"]), F.get("pairs", F.lit(k))["v"]
    )
    rooms = tx.first_float(F.coalesce(labelled(lambda l: l.contains("חדר")), plain(0)))
    sqm = tx.first_int(F.coalesce(labelled(lambda l: is_area(l) & ~l.contains("חדר")), plain(1))).cast("int")
    flags = tx.keyword_flags(F.array_join("tags", " "))
    style = attr_of(elements(N, None, "apartment-card-photo"), "style")
    return _card(rows, source, {
        "source_id": F.regexp_extract("link", r"/for-sale/([^/?]+)", 1), "price": tx.digits(c("raw_price")),
        "url": F.when(c("link") != "", tx.absolutize(c("link"), base, relative=True)).otherwise(""),
        "city": c("place.city"), "neighborhood": c("place.neighborhood"), "street": c("place.street"), "house_number": c("place.house_number"),
        "rooms": rooms, "sqm": sqm, "sqm_build": sqm, "listing_type": c("kind"), "is_agent": F.lit(True), "tags": c("tags"),
        "description": c("description"), **flags,
        "floor": F.coalesce(tx.group_of(c("description"), r"קומה\s+(-?[0-9]+)"), tx.group_of(c("description"), r"floor\s+(-?[0-9]+)")).try_cast("int"),
        "lot_sqm": mn.lot_area_loose(c("description")), "garden_sqm": mn.garden_area(c("description")),
        "images": F.array_compact(F.array(tx.group_of(style, r"url\(\"?([^\"')]+)\"?\)"))),
    })


def amenity_cards(pages: DataFrame, source: str, base: str, default_city: str = lx.DEFAULT_CITY) -> DataFrame:
    """Labelled amenity list, image list as JSON in an attribute."""
    c = F.col
    item = lambda cls: text_of(inside(elements(N, "span"), elements(N, "li", cls)))
    gallery = F.transform(
        F.from_json(attr_of(F.slice(N, 1, 1), "data-images"), "array<struct<image:string>>"), lambda i: tx.blank_to_null(i["image"])
    )
    floor_text = text_of(inside(elements(N, "span"), elements(N, "li", attr="class", like="^h-f")))
    link = attr_of(elements(N, "a", "listing-featured-thumb"), "href")
    thumb = tx.blank_to_null(attr_of(elements(N, "img", "wp-post-image"), "src"))
    labels = F.filter(F.transform(
        F.filter(N, lambda n: (n["tag"] == "a") & F.arrays_overlap(n["classes"], tx.literal_array(["label-status", "hz-label"]))), lambda n: n["text"]), lambda t: t != "")
    rows = fragments(pages, "div", attr="data-hz-id").withColumns({
        "place": tx.split_address_either_order(text_of(inside(elements(N, "span"), elements(N, "address", "item-address"))), default_city),
        "gallery": F.array_compact(gallery), "floor_text": floor_text,
    })
    return _card(rows, source, {
        "source_id": attr_of(F.slice(N, 1, 1), "data-hz-id"), "price": tx.digits(text_of(elements(N, "span", "price"))),
        "city": c("place.city"), "neighborhood": c("place.neighborhood"), "street": c("place.street"), "house_number": c("place.house_number"),
        "rooms": tx.first_float(item("h-rooms")), "sqm": tx.first_int(item("h-area")).cast("int"), "listing_type": item("h-type"),
        "floor": F.when(c("floor_text").contains("קרקע"), 0).otherwise(tx.first_int(c("floor_text")).cast("int")),
        "parking": F.size(inside(elements(N, "span"), elements(N, "li", "h-cars"))) > 0,
        "url": F.when(link != "", tx.absolutize(link, base, relative=True)).otherwise(""), "tags": labels, "is_agent": F.lit(True),
        "images": F.when(F.size("gallery") > 0, c("gallery")).otherwise(F.array_compact(F.array(thumb))),
    })


# fixed values: icons and text forms of an article card
ARTICLE_ICONS = {"rooms": r"032-plan\.png", "area": r"043-blueprint\.png", "floor": r"022-elevator\.png"}
ARTICLE_TEXT = {"rooms": r"([0-9]+(?:\.[0-9]+)?)\s*(?:חדרים|חד')", "area": "([0-9]+)\\s*מ[״\"]{0,2}ר", "floor": r"קומה\s*(-?[0-9]+)"}


def article_cards(pages: DataFrame, source: str, base: str, default_city: str = lx.DEFAULT_CITY) -> DataFrame:
    """A10: icon lookup first, then the first heading whose text has the form."""
    c = F.col
    heads = F.transform(elements(N, "h3"), lambda n: n["text"])
    root = F.slice(N, 1, 1)
    post_class = first(F.filter(first(root)["classes"], lambda k: k.rlike("^post-[0-9]+$")))
    icon = lambda what: icon_text(N, ARTICLE_ICONS[what], "img", "src", "h3|h4|h5")
    from_heads = lambda what: tx.group_of(first(F.filter("heads", lambda t: t.rlike(ARTICLE_TEXT[what]))), ARTICLE_TEXT[what])
    marker = first(elements(N, "i", attr="class", like="fa-map-marker-alt"))
    price_text = first(F.filter(F.transform(elements(N, "h3|h5"), lambda n: n["text"]), lambda t: t.rlike("(?:מחיר|שיווק).*?[0-9,]+")))
    rows = fragments(pages, "article", "ecs-post-loop").withColumns({
        "heads": heads, "post_id": tx.group_of(F.coalesce(post_class, attr_of(root, "id")), "^post-([0-9]+)"),
        "address": F.regexp_replace(F.trim(F.coalesce(F.get(N, marker["parent"])["text"], F.lit(""))), "[,.]+$", ""),
        "floor_icon": icon("floor"), "price_text": price_text,
    }).withColumn("place", tx.split_address_street_first(c("address"), default_city))
    image = tx.blank_to_null(attr_of(elements(N, "img", attr="src", like="wp-content/uploads"), "src"))
    links = F.transform(elements(N, "a", attr="href", like="/category/"), lambda n: n["text"])
    return _card(rows, source, {
        "source_id": c("post_id"), "price": tx.digits(c("price_text")), "address": c("address"),
        "city": c("place.city"), "neighborhood": c("place.neighborhood"), "street": c("place.street"), "house_number": c("place.house_number"),
        "rooms": F.coalesce(tx.first_float(icon("rooms")), from_heads("rooms").try_cast("double")),
        "sqm": F.coalesce(tx.first_int(icon("area")), from_heads("area").try_cast("bigint")).cast("int"),
        "floor": F.coalesce(
            F.when(c("floor_icon").contains("קרקע"), 0), tx.first_int(c("floor_icon")).cast("int"), from_heads("floor").try_cast("int")),
        "url": attr_of(elements(N, "a", attr="href", like=f"^{base}/20"), "href"), "is_agent": F.lit(True),
        "images": F.array_compact(F.array(image)), "tags": F.filter(links, lambda t: t != ""),
    })


def free_item_rows(pages: DataFrame, source: str, base: str, today: Column) -> DataFrame:
    """Rows of a free-item board; the first of an id wins, a missing date is today."""
    c = F.col
    click = r"showObjectDetails\(\s*'([0-9-]+)'\s*,\s*([0-9]+)\s*\)"
    cell = lambda cls: elements(N, "td", cls)
    name = inside(elements(N, "a"), cell("objectName"))
    state = first(inside(elements(N, "span"), cell("objectState")))
    photo = attr_of(inside(elements(N, "a"), cell("photoIcon")), "href")
    rows = fragments(pages, "tr", "objectsTitleTr").withColumns({
        "click": attr_of(F.slice(N, 1, 1), "onclick"), "title": text_of(name), "href": attr_of(name, "href"),
    }).select(
        "page_id", "position", F.lit(source).alias("source"), F.regexp_extract("click", click, 2).alias("source_id"), "title",
        text_of(cell("area")).alias("city"),
        tx.group_of(first(F.filter(state["classes"], lambda k: k.rlike("^condition[0-9]+$"))), "([0-9]+)").try_cast("int").alias("condition"),
        F.when(c("href") != "", tx.absolutize(c("href"), base, relative=True)).otherwise(F.concat(
            F.lit(base + "/cache/"), F.regexp_extract("click", click, 1), F.lit("/"), F.regexp_extract("click", click, 2), F.lit("_o.asp"))).alias("url"),
        F.when(photo.contains("showPhoto"), tx.absolutize(photo, base, relative=True)).alias("image_url"),
        F.coalesce(dt.day_first_date(attr_of(cell("regDate"), "title"), anywhere=True), today).alias("posted_at"),
    ).filter((c("source_id") != "") & (c("title") != ""))
    return first_per_key(rows, ["source_id"], [F.asc("page_id"), F.asc("position")]).drop("page_id", "position")


# ---- without a parser -------------------------------------------------------

def deals_table(pages: DataFrame, city: Column, neighborhood: Column) -> DataFrame:
    """Closed deals of a page's history table. Dates 'MM/yyyy' become the first of the month."""
    section = F.regexp_extract("html", r'(?s)data-testid="deals-history"(.*?)</section>', 1)
    titled = F.regexp_extract("html", r"(?s)נכסים שנמכרו באזור.*?<tbody[^>]*>(.*?)</tbody>", 1)
    body = F.coalesce(
        tx.blank_to_null(F.regexp_extract(section, r"(?s)<tbody[^>]*>(.*?)</tbody>", 1)), tx.blank_to_null(section), titled
    )
    rows = pages.select(
        "page_id", city.alias("city"), neighborhood.alias("neighborhood"),
        F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("position", "_row"),
    )
    cells = rows.withColumn("_cells", F.transform(
        F.regexp_extract_all("_row", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), tx.clean_cell
    )).filter(F.size("_cells") >= 7)
    cell = lambda k: F.coalesce(F.get("_cells", F.lit(k)), F.lit(""))
    year = F.regexp_replace(cell(6), "[^0-9]", "")
    split = tx.split_street_number(cell(0))
    return cells.select(
        "page_id", "position", "city", "neighborhood", cell(0).alias("address"), split["street"].alias("street"),
        split["house_number"].alias("house_number"), dt.month_year_date(cell(2)).alias("deal_date"),
        F.regexp_replace(cell(3), "[½٥]", ".5").try_cast("double").alias("rooms"), tx.digits(cell(4)).cast("int").alias("sqm"),
        F.when(F.length(year) == 4, year.try_cast("int")).alias("year_built"), tx.digits(cell(7)).alias("price"),
    ).filter(F.col("price").isNotNull() & (F.col("address") != ""))


_PLACE = """`@type`:string, description:string, offers:struct<price:string>, floorSize:struct<value:string>,
 numberOfRooms:string, numberOfBedrooms:string, image:string"""
_LINKED = " ".join(f"struct<{_PLACE}, `@graph`:array<struct<{_PLACE}>>>".split())


def linked_data(pages: DataFrame, kind: str = "Place") -> DataFrame:
    """The page's JSON-LD object of a type, at top level or inside @graph; the first wins."""
    bodies = F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    # an object is a candidate together with the members of its graph
    def candidates(body: Column) -> Column:
        top = F.from_json(body, _LINKED)
        own = F.struct(*[top[n].alias(n) for n in (
            "@type", "description", "offers", "floorSize", "numberOfRooms", "numberOfBedrooms", "image")])
        return F.concat(F.array(own), F.coalesce(top["@graph"], F.slice(F.array(own), 1, 0)))
    found = F.filter(F.flatten(F.transform(bodies, candidates)), lambda o: o["@type"] == kind)
    images = lambda o: F.when(
        o["image"].startswith("["), F.from_json(o["image"], "array<string>")).otherwise(F.array_compact(F.array(tx.blank_to_null(o["image"]))))
    return pages.select("page_id", first(found).alias("o")).filter(F.col("o").isNotNull()).select(
        "page_id", F.col("o.description").alias("description"), F.col("o.offers.price").try_cast("double").cast("bigint").alias("price"),
        F.col("o.floorSize.value").try_cast("int").alias("sqm"),
        F.coalesce(F.col("o.numberOfRooms").try_cast("double"), F.col("o.numberOfBedrooms").try_cast("double")).alias("rooms"),
        images(F.col("o")).alias("images"),
    )


def list_links(pages: DataFrame) -> DataFrame:
    """Items and links of stored pages, without a parser."""
    items = F.regexp_extract_all("html", F.lit(r"(?s)<li>(.*?)</li>"), 1)
    return pages.select("page_id", F.posexplode(items).alias("position", "item")).select(
        "page_id", "position", F.regexp_extract("item", r'href="([^"]*)"', 1).alias("href"),
        tx.clean_cell(F.col("item")).alias("label"),
    )
