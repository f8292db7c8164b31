"""Raw payloads rendered from the test tables, so that the feed parsers run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.session import cut_lineage
from hearthline.sources.tables import listings, posts, read_table, spread

c = F.col
lit = F.lit


def _nest(name: str, value: Column) -> Column:
    return F.struct(value.alias(name))


def token() -> Column:
    return F.concat_ws("-", "source", "source_id")


def nested_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Two pages per listing: its section and a repeat with another price; then a late repeat."""
    def item(price: Column) -> Column:
        return F.struct(
            token().alias("token"), price.alias("price"), c("price_before").alias("priceBeforeTag"),
            lit("private").alias("adType"), F.concat(lit("בית &amp; "), c("street"), lit(" נבנה בשנת "), c("year_built").cast("string")).alias("description"),
            F.struct(
                _nest("text", c("neighborhood")).alias("property"), c("rooms").alias("roomsCount"), c("sqm").alias("squareMeter")
            ).alias("additionalDetails"),
            F.struct(
                _nest("text", c("city")).alias("city"), _nest("text", c("neighborhood")).alias("neighborhood"),
                _nest("text", c("street")).alias("street"),
                F.struct(c("house_number").cast("int").alias("number"), c("floor").alias("floor")).alias("house"),
                F.struct(c("lat"), c("lon")).alias("coords"),
            ).alias("address"),
            F.struct(
                lit("https://img.example/cover.jpg").alias("coverImage"), F.array(lit("https://img.example/a.jpg")).alias("images"),
                F.when(c("line_no") % 2 == 0, c("sqm") - 3).alias("squareMeterBuild"),
            ).alias("metaData"),
            F.array(_nest("name", c("street")), _nest("name", F.when(c("line_no") % 3 == 0, "חניה").otherwise("נוף"))).alias("tags"),
            F.struct(F.concat(F.date_format("observed_at", "yyyy-MM-dd"), lit("T08:00:00")).alias("createdAt")).alias("dates"),
        )

    def page(data: Column) -> Column:
        queries = F.array(_nest("state", _nest("data", data)))
        return F.to_json(_nest("pageProps", _nest("dehydratedState", _nest("queries", queries))))

    paging = F.struct(lit(1).alias("currentPage"), lit(2).alias("totalPages")).alias("pagination")
    first = page(F.struct(
        F.when(~c("is_agent"), F.array(item(c("price")))).alias("private"),
        F.when(c("is_agent"), F.array(item(c("price")))).alias("agency"),
        F.array(item(c("price") + 1), item(c("price") + 2)).alias("items"), paging,
    ))
    second = page(F.struct(F.array(item(c("price") + 3)).alias("platinum"), paging))
    # written: what the listings shuffled is gone before the pages' rows, which are wide, are shuffled
    rows = cut_lineage(listings(spark, folder))
    return rows.select(
        lit("board").alias("source"), F.posexplode(F.array(first, second)).alias("page_no", "payload")
    )


def bilingual_pages(spark: SparkSession, folder: str) -> DataFrame:
    stamp = lambda days: F.concat(F.date_format(F.date_add("observed_at", days), "yyyy-MM-dd"), lit("T22:30:00.000Z"))
    item = F.struct(
        token().alias("id"), lit("buy").alias("search_option"), F.when(c("line_no") != 3, "ILS").alias("currency"),
        lit("property").alias("entityType"), c("price").cast("double").alias("price"), c("neighborhood").alias("property_type"),
        F.when(c("line_no") % 2 == 0, F.concat(lit("p/"), token())).alias("slug"),
        stamp(-3).alias("created_at"), F.when(c("line_no") != 5, stamp(2)).alias("search_date"),
        F.struct(
            c("rooms"), _nest("base", c("sqm") + lit(0.5)).alias("area"), _nest("on_the", c("floor")).alias("floor"),
            F.struct((c("line_no") % 3).cast("string").alias("aboveground"), lit("none").alias("underground")).alias("parking"),
        ).alias("additional_info"),
        F.struct(
            F.struct(c("city").alias("city_name"), c("neighborhood"), c("street").alias("street_name"), c("house_number")).alias("he"),
            F.struct(c("lat"), c("lon")).alias("location"), F.array("street", "city").alias("tags"),
        ).alias("address"),
        F.array(
            F.struct(F.when(c("line_no") % 2 == 0, "g.jpg").alias("gallery"), lit("f.jpg").alias("full"), lit("t.jpg").alias("thumbnail")),
            F.struct(lit(None).cast("string").alias("gallery"), lit("").alias("full"), lit("t2.jpg").alias("thumbnail")),
        ).alias("images"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("data"), _nest("hasNextPage", lit(True)).alias("meta")))
    return listings(spark, folder).select(lit("homes").alias("source"), lit(1).alias("page_no"), payload.alias("payload"))


def agency_pages(spark: SparkSession, folder: str) -> DataFrame:
    story = F.when(c("line_no") % 3 == 0, F.concat(lit("פנטהאוז "), c("sqm").cast("string"), lit(" מ״ר, מגרש 600"))).otherwise(
        F.concat(lit("גינה "), c("sqm").cast("string"), lit(' מ"ר, 2 יחידות דיור')))
    item = F.struct(
        (c("order_id") * 10 + c("line_no")).alias("id"), lit("מכירה").alias("deal_type"),
        F.when(c("line_no") == 1, "קוטג").otherwise(c("neighborhood")).alias("type"), c("price").alias("price"), c("rooms").alias("rooms"),
        c("city"), c("street"), c("neighborhood"), F.when(c("line_no") % 2 == 0, F.concat_ws(" ", "street", "city")).alias("full_address"),
        story.alias("description"), F.when(c("line_no") % 3 != 0, c("sqm")).alias("size"), c("floor").cast("string").alias("floor"),
        (c("line_no") % 2).alias("parking_spaces"), _nest("small_size_url", lit("s.jpg")).alias("preview_photo"),
    )
    plain = F.to_json(F.struct(F.array(item).alias("data"), lit(3).alias("last_page")))
    wrapped = F.to_json(_nest("body", _nest("data", F.array(item))))
    return listings(spark, folder).select(
        lit("agency").alias("source"), lit(1).alias("page_no"), F.when(c("line_no") % 2 == 0, plain).otherwise(wrapped).alias("payload")
    )


def paged_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """One page per line of an order; the feeds tell their length in three ways."""
    item = read_table(spark, folder, "lineitem")
    kind, line = c("l_orderkey") % 4, c("l_linenumber")
    payload = (
        F.when(kind == 0, F.to_json(_nest("pagination", _nest("totalPages", lit(4)))))
        .when(kind == 1, F.to_json(_nest("last_page", lit(3))))
        .when(kind == 2, F.to_json(_nest("meta", _nest("hasNextPage", line < 5))))
        .otherwise(F.to_json(_nest("label", F.concat(lit("עמוד "), line.cast("string"), lit(" מתוך 2")))))
    )
    return item.select(c("l_orderkey").cast("string").alias("source"), line.alias("page_no"), payload.alias("payload"))


def trend_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A neighbourhood document per order; every fourth is a settlement document."""
    orders = read_table(spark, folder, "orders")
    price = F.floor("o_totalprice").cast("bigint")
    point = lambda months, p: F.struct(
        p.alias("neighborhoodPrice"), (price + 1).alias("settlementPrice"), (price + 2).alias("countryPrice"),
        F.year(F.add_months("o_orderdate", months)).alias("year"), F.month(F.add_months("o_orderdate", months)).alias("month"),
    )
    bucket = lambda rooms, *points: F.struct(lit(rooms).alias("numRooms"), F.array(*points).alias("graphData"))
    payload = F.to_json(_nest("trends", _nest("rooms", F.array(
        bucket("3", point(0, price), point(3, F.when(c("o_orderkey") % 3 != 0, price + 10))), bucket("all", point(0, price + 20)),
    ))))
    return orders.select(
        F.when(c("o_orderkey") % 4 == 0, "settlement").otherwise("neighborhood").alias("level"),
        (c("o_custkey") % 1000).cast("string").alias("city"), c("o_orderpriority").alias("neighborhood"), payload.alias("payload"),
    )


def post_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Response bodies: noise lines around a deeply nested post, repeated with another text."""
    node = lambda text: F.struct(
        c("post_id"), _nest("text", text).alias("message"),
        F.concat(lit("https://social.example/"), c("post_id"), lit("?ref=feed")).alias("wwwURL"),
        F.array(_nest("name", c("group_id"))).alias("actors"),
    )
    deep = F.to_json(_nest("data", F.struct(
        F.array(_nest("edge", _nest("node", node(c("text"))))).alias("edges"), node(F.upper("text")).alias("repeat"))))
    body = F.concat_ws("\n", lit("for (;;);"), deep, lit("{broken"), lit("[1]"))
    return posts(spark, folder).select(c("post_id").alias("body_no"), body.alias("body"))


def odd_post_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies whose posts have actors, URLs and ids of other types than text, by conversation."""
    n = c("conv_id") % 4
    known = F.struct(c("post_id"), _nest("text", c("text")).alias("message"),
                     F.concat(lit("https://social.example/"), c("post_id"), lit("?a?b")).alias("wwwURL"),
                     F.array(_nest("name", c("group_id"))).alias("actors"))
    texts = F.struct(c("post_id"), _nest("text", c("text")).alias("message"), (c("turn") + 1).alias("wwwURL"), c("group_id").alias("actors"))
    numbers = F.struct((c("conv_id") * 1000 + c("turn") + 1).alias("post_id"), _nest("text", c("text")).alias("message"),
                       F.array(c("conv_id")).alias("actors"))
    no_post = F.struct(c("post_id"), c("text").alias("message"))
    post = F.when(n == 0, F.to_json(known)).when(n == 1, F.to_json(texts)).when(n == 2, F.to_json(numbers)).otherwise(F.to_json(no_post))
    body = F.concat(lit('{"x": [[{"y": '), post, lit('}], 1, null]}\n{"post_id": 0}\n"text"\n{'))
    return posts(spark, folder).select((c("conv_id") * 1000 + c("turn")).alias("body_no"), body.alias("body"))


# ---- HTML: one page per part or customer, with a repeat of the card on a later page ------------

def _text(*parts) -> Column:
    return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def part_rows(spark: SparkSession, folder: str) -> DataFrame:
    k = c("p_partkey")
    return spread(read_table(spark, folder, "part")).select(
        k.alias("k"), (k + 1000).alias("id"), c("p_type").alias("city"), c("p_name").alias("area"), c("p_brand").alias("street"),
        c("p_size").alias("number"), F.floor(c("p_retailprice") * 1000).cast("bigint").alias("price"),
        (lit(1) + (c("p_size") % 10) / lit(2.0)).alias("rooms"), (lit(30) + c("p_size")).alias("sqm"),
    )


def _paged(rows: DataFrame, html: Column, repeat: Column) -> DataFrame:
    return rows.select(F.posexplode(F.array(html, repeat)).alias("page_no", "html"), "k").select(
        (c("page_no") * 1_000_000_000_000 + c("k")).alias("page_id"), "html"
    )


def icon_card_pages(spark: SparkSession, folder: str) -> DataFrame:
    def page(price: Column) -> Column:
        shown = F.when(c("k") % 2 == 0, _text('<i class="fas fa-bed"></i> ', c("rooms"))).otherwise(_text("<b>", c("rooms"), " חד'</b>"))
        return _text(
            '<html><body><div class="card-block" data-id="', c("id"), '"><div class="card overflow-hidden">',
            F.when(c("k") % 3 != 0, _text('<a href="/ad/', c("id"), '?x=1"><h2 class="card-title">', c("city"), " ", c("area"), "</h2></a>"))
            .otherwise(_text('<h2 class="card-title">', c("city"), " ", c("area"), "</h2>")),
            '<p class="card-text">', c("street"), " ", c("number"), '</p><div class="price">', F.format_number(price, 0), " &#8362;</div>",
            "<span>", shown, '</span><span><i class="fas fa-expand-arrows-alt"></i>', c("sqm"), '</span><img src="//img.example/', c("id"), '.jpg">',
            F.when(c("k") % 5 == 0, "<em>מקודם</em>").otherwise(""), F.when(c("k") % 7 == 0, "<br><small>רימקס צפון</small>").otherwise(""),
            "</div></div></body></html>",
        )
    rows = part_rows(spark, folder)
    return _paged(rows, page(c("price")), page(c("price") + 5))


def table_card_pages(spark: SparkSession, folder: str) -> DataFrame:
    def page(price: Column) -> Column:
        floor = F.when(c("k") % 4 == 0, "קרקע").otherwise((c("k") % 4).cast("string"))
        return _text(
            '<div class="box ', F.when(c("k") % 2 == 0, "Private").otherwise("Office"), '"><table id="modaaRow', c("id"), '"><tr>',
            '<td class="tdGallery"><img src="/i/', c("id"), '.jpg"></td><td><span class="LinkModaaTitle">', c("city"), ", ", c("area"), ", ", c("street"), " ", c("number"),
            '</span></td><td class="tdPrice">', F.format_number(price, 0), "&#8362;</td>",
            '<td class="tdMoreDetails">', F.when(c("k") % 9 != 0, _text("דירה ", c("rooms"), " חדרים (", c("sqm"), ' מ"ר) קומה: ', floor, " מתוך 8")).otherwise(""),
            '</td></tr></table><div id="x" bigtitle="-"></div></div>',
        )
    rows = part_rows(spark, folder)
    return _paged(rows, page(c("price")), page(c("price") + 5))


def catalog_pages(spark: SparkSession, folder: str) -> DataFrame:
    def page(price: Column) -> Column:
        label = lambda text: F.when(c("k") % 3 == 0, "").otherwise(text)
        return _text(
            '<div id="Catalog"><div class="collection-item-3 w-dyn-item"><div class="filter-data"><div class="div-price"><div>₪', F.format_number(price, 0),
            '</div></div><div class="asset-type"><div class="apartment-type">וילה</div></div><div class="div-tag"><div class="greentags">',
            F.when(c("k") % 2 == 0, "חניה").otherwise("נוף"), '</div><div class="w-condition-invisible">מעלית</div></div></div>',
            '<a class="hot-appartment-cards" href="/for-sale/home-', c("id"), '?a=1"></a><div class="apartment-card-photo" style="background:url(&quot;https://img.example/', c("id"), '.jpg&quot;)"></div>',
            '<h4 class="address">', c("street"), " ", c("number"), ", ", c("city"), '</h4><div class="details-wrapper"><div class="info-numbers-2">', c("rooms"),
            '</div><div class="apartment-details2">', label("חדרים"), '</div><div class="info-numbers-2">', c("sqm"), '</div><div class="apartment-details-2">', label('מ"ר'),
            '</div></div><p class="apartment-text">בית שקט, קומה ', c("k") % 5, ", מגרש 450 מטר</p></div></div>",
        )
    rows = part_rows(spark, folder)
    return _paged(rows, page(c("price")), page(c("price") + 5))


def amenity_pages(spark: SparkSession, folder: str) -> DataFrame:
    def page(price: Column) -> Column:
        return _text(
            '<div data-hz-id="hz-', c("id"), '" data-images="', F.when(c("k") % 2 == 0, _text("[{&quot;image&quot;:&quot;", c("id"), ".jpg&quot;},{&quot;other&quot;:1}]")).otherwise("[bad"),
            '"><div class="listing-thumb"><a class="listing-featured-thumb" href="/home/', c("id"), '"><img class="wp-post-image" src="cover.jpg"></a></div>',
            '<ul class="item-price-wrap"><li class="item-price"><span class="price">₪ ', F.format_number(price, 0), "</span></li></ul>",
            '<ul class="item-amenities"><li class="h-type"><span>קוטג</span></li><li class="h-rooms"><span>', c("rooms"), '</span></li><li class="h-area"><span>', c("sqm"),
            " מטר</span></li>", F.when(c("k") % 4 == 0, '<li class="h-floor"><span>קומת קרקע</span></li>').otherwise(_text('<li class="h-floor"><span>קומה ', c("k") % 4, "</span></li>")),
            F.when(c("k") % 3 == 0, '<li class="h-cars"><span>1</span></li>').otherwise(""), '</ul><address class="item-address"><span>', c("city"), ", ", c("street"), " ", c("number"),
            '</span></address><div class="labels-wrap"><a class="label-status">חדש</a><a class="hz-label">', c("area"), "</a></div></div>",
        )
    rows = part_rows(spark, folder)
    return _paged(rows, page(c("price")), page(c("price") + 5))


def article_pages(spark: SparkSession, folder: str) -> DataFrame:
    def page(price: Column) -> Column:
        fact = lambda icon, text: F.when(c("k") % 2 == 0, _text('<div><h3><img src="/i/', icon, '"><span>', text, "</span></h3></div>"))
        plain = lambda text: _text("<h3>", text, "</h3>")
        return _text(
            '<article class="elementor-post ecs-post-loop post-', c("id"), ' entry" id="post-0"><h5>מחיר: ', F.format_number(price, 0), " ₪</h5>",
            fact("032-plan.png", c("rooms").cast("string")).otherwise(plain(_text(c("rooms"), " חדרים"))),
            fact("043-blueprint.png", c("sqm").cast("string")).otherwise(plain(_text(c("sqm"), ' מ"ר'))),
            fact("022-elevator.png", F.when(c("k") % 4 == 0, "קרקע").otherwise("קומה 2")).otherwise(plain(lit("קומה -1"))),
            '<h3><i class="fas fa-map-marker-alt"></i>', c("street"), " ", c("number"), ", ", c("area"), ", ", c("city"), '.</h3><a href="https://articles.example/2026/', c("id"),
            '">more</a><img class="wp-post-image" src="https://articles.example/wp-content/uploads/', c("id"), '.jpg"><h3><a href="/category/garden">גינה</a></h3></article>',
        )
    rows = part_rows(spark, folder)
    return _paged(rows, page(c("price")), page(c("price") + 5))


def free_item_pages(spark: SparkSession, folder: str) -> DataFrame:
    k = c("k")
    def row(title: Column) -> Column:
        return _text(
            '<tr class="objectsTitleTr" onclick="showObjectDetails(\'2026-06\', ', k, ')"><td class="objectState"><span class="stateIcon condition', k % 4,
            '"></span></td><td class="objectName"><a', F.when(k % 3 == 0, _text(' href="/item/', k, '"')).otherwise(""), "> ", title, ' </a></td><td class="area">', c("area"),
            '</td><td class="photoIcon"><a href="', F.when(k % 2 == 0, "showPhoto.asp?id=").otherwise("none?"), k, '">p</a></td><td class="regDate" title="', F.when(k % 5 != 0, _text(k % 28 + 1, "/", k % 12 + 1, "/2025 21:43")).otherwise("soon"),
            '">x</td></tr>',
        )
    rows = spread(read_table(spark, folder, "customer")).select(c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_mktsegment").alias("area"))
    html = _text("<table>", row(_text("<b>", c("name"), "</b> &amp; more")), row(lit("repeat")), "</table>")
    return rows.select(k.alias("page_id"), html.alias("html"))


def deal_pages(spark: SparkSession, folder: str) -> DataFrame:
    k = c("k")
    row = lambda price: _text(
        "<tr><td>", c("area"), " street ", k, "/2</td><td>flat</td><td>\u200f", F.lpad((k % 12 + 1).cast("string"), 2, "0"), "/2000</td><td>", k % 5 + 1, "½</td><td>", k % 100 + 40,
        "&nbsp;</td><td>2</td><td>", F.when(k % 3 == 0, "-").otherwise((k % 60 + 1940).cast("string")), "</td><td>", price, "</td></tr>")
    table = _text("<tbody>", row(_text(F.format_number(k * 1000 + 7, 0), " &#x20AA;")), row(lit("-")), "<tr><td>short</td></tr></tbody>")
    html = F.when(k % 2 == 0, _text('<section data-testid="deals-history"><table>', table, "</table></section>")).otherwise(
        _text("<h2>נכסים שנמכרו באזור</h2><table>", table, "</table>"))
    rows = spread(read_table(spark, folder, "customer")).select(
        c("c_custkey").alias("k"), c("c_mktsegment").alias("area"), c("c_nationkey").cast("string").alias("city"))
    return rows.select(k.alias("page_id"), "city", c("area").alias("neighborhood"), html.alias("html"))


def linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    k = c("k")
    place = F.struct(
        lit("Place").alias("@type"), c("name").alias("description"), _nest("price", k * 1000).alias("offers"), _nest("value", k % 200 + 20).alias("floorSize"),
        F.when(k % 3 == 0, k % 6).alias("numberOfRooms"), lit(2).alias("numberOfBedrooms"),
    )
    one = F.struct(*[place[n].alias(n) for n in ("@type", "description", "offers", "floorSize", "numberOfRooms", "numberOfBedrooms")], lit("one.jpg").alias("image"))
    many = F.struct(*[place[n].alias(n) for n in ("@type", "description", "offers", "floorSize", "numberOfRooms", "numberOfBedrooms")], F.array(lit("a.jpg"), lit("b.jpg")).alias("image"))
    graph = _nest("@graph", F.array(F.struct(lit("Person").alias("@type"), lit("x").alias("description")), F.struct(lit("Place").alias("@type"), c("name").alias("description"))))
    body = F.when(k % 4 == 0, F.to_json(many)).when(k % 4 == 1, F.to_json(one)).when(k % 4 == 2, F.to_json(graph)).otherwise('{"@type":"Thing"}')
    html = _text('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">', body, "</script></html>")
    rows = spread(read_table(spark, folder, "customer")).select(c("c_custkey").alias("k"), c("c_name").alias("name"))
    return rows.select(k.alias("page_id"), html.alias("html"))


# ---- details ------------------------------------------------------------------------------------

def nested_detail_rows(spark: SparkSession, folder: str) -> DataFrame:
    stamp = F.concat(F.date_format("observed_at", "yyyy-MM-dd"), lit("T08:00:00"))
    payload = F.to_json(F.struct(
        F.when(c("line_no") % 2 == 0, _text("גוף &amp; ", c("street"), ", נבנה בשנת ", c("year_built"))).alias("furnitureInfo"),
        _nest("description", c("street")).alias("metaData"),
        F.struct(stamp.alias("createdAt"), F.when(c("line_no") == 1, "soon").alias("endsAt")).alias("dates"),
        F.struct((c("part_id") % 2 == 0).alias("includeElevator"), (c("part_id") % 3 == 0).alias("includeParking")).alias("inProperty"),
        F.struct((c("sqm") + 9).alias("squareMeterBuild"), (c("line_no") - 1).alias("parkingSpacesCount")).alias("additionalDetails"),
    ))
    return listings(spark, folder).select("source", "source_id", payload.alias("payload"))


def agency_detail_rows(spark: SparkSession, folder: str) -> DataFrame:
    photo = F.struct(F.when(c("line_no") % 2 == 0, "u.jpg").alias("url"), lit("full.jpg").alias("full"))
    data = F.struct(
        F.when(c("line_no") % 2 == 0, "גינה 80 מטר, מגרש 600, 2 יחידות דיור").otherwise("חצר 40 מ\"ר").alias("description"),
        F.when(c("line_no") % 3 != 0, c("sqm") + lit(0.5)).alias("size"), lit(700).alias("field_size"), lit(0).alias("garden_size"),
        c("floor"), (c("part_id") % 2 == 0).alias("elevator"), (c("part_id") % 5 == 0).alias("air_conditioner"), c("year_built").alias("build_year"),
        F.array(photo).alias("photos"),
    )
    return listings(spark, folder).select("source", "source_id", F.to_json(_nest("body", _nest("data", data))).alias("payload"))


def detail_html(spark: SparkSession, folder: str) -> DataFrame:
    """One page per customer with icons, labelled rows, features, a dated label and contacts."""
    k = c("k")
    rows = spread(read_table(spark, folder, "customer")).select(c("c_custkey").alias("k"), c("c_name").alias("name"))
    icon = lambda mark, label: _text('<div><i class="fas ', mark, '"></i> ', label, "</div>")
    page = _text(
        '<html><head><meta property="og:description" content=" ', c("name"), ' "></head><body><div><i class="fas fa-building"></i> קומה ', k % 9, "</div>",
        icon(F.when(k % 2 == 0, "fa-check").otherwise("fa-times"), "חניה"), icon("fa-times", "מעלית"), icon("fa-check", "מרפסת שמש"),
        '<div class="card-contacts">', F.when(k % 7 == 0, "נכסים בע\"מ").otherwise("דני"), '</div><p class="px-3">תאריך יצירה: ', k % 28 + 1, "/", k % 12 + 1, "/2025</p>",
        "<ul><li><strong>מגרש:</strong> <span>", k % 500 + 100, " מטר</span></li><li><strong>שטח בנוי</strong><span>", k % 90 + 40, "</span></li><li><strong>חצר</strong><span>",
        k % 3 * 20, "</span></li><li><strong>שנת בנייה</strong><span>", k % 60 + 1960, '</span></li></ul><div id="property-features-wrap"><a>מזגן</a><a>', F.when(k % 4 == 0, "ממ״ד").otherwise("נוף"),
        '</a></div><img src="/p?picNum=', k, '"><img src="/logo.png"></body></html>',
    )
    return rows.select(k.alias("page_id"), lit("a").alias("source"), k.cast("string").alias("source_id"), page.alias("html"))


def described_html(spark: SparkSession, folder: str) -> DataFrame:
    """One page per customer with a menu beside the description nodes of the catalog and article feeds."""
    k = c("k")
    rows = spread(read_table(spark, folder, "customer")).select(c("c_custkey").alias("k"), c("c_name").alias("name"))
    page = _text(
        "<html><body><nav>מעלית מגרש 9999 מטר</nav>",
        F.when(k % 5 != 0, _text('<div class="rich-text-block-2 w"><p>', c("name"), "</p><p>פינתי ", k % 500 + 100, " מטר</p></div>")).otherwise(""),
        '<div class="tags-wrapper"><div class="greentags">חניה</div><div class="greentags w-condition-invisible">מזגן</div></div>',
        F.when(k % 2 == 0, _text('<div class="floor-number">', k % 9, "</div>")).otherwise(""),
        '<div class="collection-small-imegs-item-5"><a style="background-image:url(', "/g", k, '.jpg)"></a></div>',
        F.when(k % 3 == 0, '<div data-id="9ce8f1"><div class="elementor-widget-container">403 this page is forbidden</div></div>').otherwise(""),
        '<div class="elementor-widget-text-editor"><div class="elementor-widget-container">short</div><div class="elementor-widget-container">', c("name"),
        ' על מגרש ', k % 500 + 100, ' מטר</div></div><section data-id="73430878"><h5 class="elementor-heading-title">מרפסת</h5></section>',
        '<div class="swiper-slide"><img src="/s', k, '.jpg"><img src="/x.svg"></div></body></html>',
    )
    return rows.select(k.alias("page_id"), lit("a").alias("source"), k.cast("string").alias("source_id"), page.alias("html"))
