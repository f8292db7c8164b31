"""Feed parsers on invented payloads, streams over several files, and the shape of the plans."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from hearthline.operators import valuation as va
from hearthline.plans import registry
from hearthline.sources import html, json_feeds as jf, tiles
from hearthline.sources.registry import FEEDS, FeedSpec, register_feed
from hearthline.streaming import changes as ch

FOLDER = "/root/testdata/sf0.001"


def page(**data):
    return json.dumps({"pageProps": {"dehydratedState": {"queries": [{"state": {"data": []}}, {"state": {"data": data}}]}}}, ensure_ascii=False)


def test_sections_first_token_wins(spark):
    raw = spark.createDataFrame([
        ("s", 1, page(private=[{"token": "a", "price": 1}, {"price": 5}], items=[{"token": "a", "price": 9}, {"token": "b", "price": 2}])),
        ("s", 2, page(agency=[{"token": "b", "price": 8}, {"token": "c", "price": 3}])), ("s", 3, "not json"), ("s", 4, "{}"),
    ], "source string, page_no int, payload string")
    got = {r.token: (r.section, r.price) for r in jf.flatten_sections(raw).select("item.token", "section", "item.price").collect()}
    assert got == {"a": ("private", 1), "b": ("items", 2), "c": ("agency", 3)}


def test_bilingual_mixed_types(spark):
    doc = {"data": [{"id": 7, "price": 100, "additional_info": {"rooms": "three", "area": {"base": 80.9}}, "created_at": "2026-01-02T23:00:00+02:00",
                     "images": [{"full": "f"}, {}]}], "meta": {"hasNextPage": False}}
    raw = spark.createDataFrame([("o", 1, json.dumps(doc))], "source string, page_no int, payload string")
    row = jf.parse_bilingual(raw).first()
    assert (row.source_id, row.rooms, row.sqm, row.images, str(row.publish_date)) == ("7", None, 80, ["f"], "2026-01-02")
    assert row.parking is False and row.url.endswith("/property/7")


def test_trend_window_and_level(spark):
    doc = lambda p: json.dumps({"trends": {"rooms": [
        {"numRooms": "4", "graphData": [{"neighborhoodPrice": p, "year": 2026, "month": 1}, {"neighborhoodPrice": p, "year": 2024, "month": 6},
                                        {"neighborhoodPrice": None, "year": 2026, "month": 2}]},
        {"numRooms": "all", "graphData": [{"neighborhoodPrice": p + 1, "year": 2025, "month": 12}]}]}})
    raw = spark.createDataFrame([("neighborhood", "x", "n", doc(5)), ("settlement", "x", "n", doc(50)), ("settlement", "y", "n", doc(500)), ("neighborhood", "z", "n", '{"trends":{"rooms":[]}}')],
                                "level string, city string, neighborhood string, payload string")
    comps = jf.prefer_level(jf.trends_to_comps(raw, F.lit("2026-02-01").cast("date")), ["city"], ["neighborhood", "settlement"])
    assert sorted((r.city, r.rooms, r.price) for r in comps.filter("rooms is not null").collect()) == [("x", 4.0, 5), ("y", 4.0, 500)]
    assert comps.filter(jf.rooms_or_all(F.col("rooms"), 3.0)).count() == 2


def test_posts_first_wins_and_noise_is_skipped(spark):
    node = {"post_id": "1", "message": {"text": "one"}, "wwwURL": "https://x/1?y", "actors": [{"name": "n"}]}
    lines = "\n".join(["junk", json.dumps({"a": [{"b": node}]}), json.dumps({"c": {**node, "message": {"text": "two"}}}), "{bad"])
    raw = spark.createDataFrame([(1, lines), (2, json.dumps({"post_id": "2", "message": {"text": "t"}}))], "body_no bigint, body string")
    got = {r.post_id: (r.text, r.url, r.author) for r in jf.extract_posts(raw).collect()}
    assert got == {"1": ("one", "https://x/1", "n"), "2": ("t", "", "")}


def test_posts_of_odd_types(spark):
    post = lambda i, **more: {"post_id": i, "message": {"text": f"t{i}"}, **more}
    deep = post("deep")
    for _ in range(60):
        deep = {"k": [deep]}
    lines = [
        post("a", actors="x", wwwURL=5), post("b", actors=None, wwwURL=None), post("c", actors=[], wwwURL=["u"]),
        post("d", actors=[7]), post("e", actors=[{"name": 3}], wwwURL="u?1?2"), post(12), post(0), post(""), post(None), post(True),
        {"post_id": "f", "message": "text"}, {"post_id": "g", "message": {"text": 4}}, {"post_id": {"x": 1}, "message": {"text": "t"}},
        post("h", inner=[post("i")], message={"text": "both", "post_id": "no"}), deep, {"post_id": "a", "message": {"text": "later"}},
    ]
    body = "\n".join(["", "null", "[1]", "{", *map(json.dumps, lines), '{"post_id": "j", "post_id": "k", "message": {"text": "twice"}}'])
    raw = spark.createDataFrame([(1, body), (2, None), (3, "")], "body_no bigint, body string")
    got = {r.post_id: (r.text, r.url, r.author) for r in jf.extract_posts(raw).collect()}
    assert got == {
        "a": ("ta", "", ""), "b": ("tb", "", ""), "c": ("tc", "", ""), "d": ("td", "", ""), "e": ("te", "u", ""), "12": ("t12", "", ""),
        "h": ("both", "", ""), "i": ("ti", "", ""), "deep": ("tdeep", "", ""), "k": ("twice", "", ""),
    }
    assert jf.extract_posts(raw.filter("body_no > 1")).count() == 0


def test_tokenizer_handles_untidy_markup(spark):
    doc = '<div class="card x"><p>a<br>b<img src=q></p><script>var s="<p>no</p>";</script></i><span>c &amp; d</div><div class=card><b>e'
    raw = spark.createDataFrame([(1, doc)], "page_id bigint, html string")
    got = html.fragments(raw, "div", "card").select(F.get("nodes", F.lit(0))["text"].alias("t"), F.size("nodes").alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("a b c & d", 6), ("e", 2)]


def test_tiles_cover_the_box(spark):
    box = (0.0, 0.0, 3.0, 3.0)
    grid = tiles.grid_tiles(spark, box, 3)
    assert grid.count() == 9 and grid.agg(F.max("lat_max"), F.max("lon_max")).first() == (3.0, 3.0)
    points = spark.createDataFrame([(0.0, 0.0), (3.0, 3.0), (2.9, 0.1), (4.0, 1.0)], "lat double, lon double")
    got = {(r.tile_i, r.tile_j): r.markers for r in tiles.tile_counts(points, box, 3).collect()}
    assert got == {(0, 0): 1, (2, 2): 1, (2, 0): 1}


def test_feed_registry():
    spec = register_feed(FeedSpec("invented", parse=lambda df: df))
    assert FEEDS["invented"] is spec
    with pytest.raises(ValueError):
        register_feed(spec)


SIGHTING = "source string, source_id string, ts timestamp, price double, event_id bigint"


def feed_files(spark, batches):
    folder = tempfile.mkdtemp(prefix="hearthline-feed-")
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(s, k, t, float(p), e) for s, k, t, p, e in rows], "source string, source_id string, t string, price double, event_id bigint")
        frame.select("source", "source_id", F.col("t").cast("timestamp").alias("ts"), "price", "event_id").coalesce(1).write.parquet(f"{folder}/part={i}")
    return folder


def read_feed(spark, folder):
    return spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


BATCHES = [
    [("a", "1", "2026-01-01", 10, 1), ("a", "2", "2026-01-01", 5, 2), ("a", "1", "2026-01-02", 12, 3)],
    [("a", "1", "2026-01-03", 9, 4), ("b", "1", "2026-01-03", 7, 5)],
    [("a", "1", "2026-01-04", 9, 6), ("a", "2", "2026-01-05", 4, 7)],
]


def test_stream_equals_batch_over_several_files(spark):
    found, state = ch.scan_stream(read_feed(spark, feed_files(spark, BATCHES)), ch.run_folder(spark), lambda: F.to_date("ts"))
    got = {r.event_id: (r.prev_price, r.change) for r in spark.read.parquet(found).collect()}
    assert got == {1: (None, "new"), 2: (None, "new"), 3: (10.0, "changed"), 4: (12.0, "dropped"), 5: (None, "new"), 6: (9.0, "same"), 7: (5.0, "dropped")}
    last = {(r.source, r.source_id): (str(r.first_seen)[:10], str(r.last_seen)[:10], r.price) for r in spark.read.parquet(state).collect()}
    assert last[("a", "1")] == ("2026-01-01", "2026-01-04", 9.0) and len(last) == 3


def test_stream_without_new_rows_returns_what_it_had(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "source string, source_id string, ts timestamp, price double, event_id long"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lambda: ch.scan_stream(stream(), str(tmp_path / "run"), lambda: F.to_date("ts"))
    found, state = run()
    assert spark.read.parquet(found).count() == 0 and spark.read.parquet(state).count() == 0
    spark.sql("SELECT 'a' AS source, '1' AS source_id, timestamp'2026-01-01' AS ts, 5.0D AS price, 1L AS event_id").write.mode(
        "append").parquet(str(tmp_path / "in"))
    first, again = run(), run()
    assert first == again and [r.price for r in spark.read.parquet(again[1]).collect()] == [5.0]
    outbox = ch.alert_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).filter("price > 9"), str(tmp_path / "out"))
    assert spark.read.parquet(outbox).count() == 0


def test_alerts_go_out_once(spark):
    folder, out = feed_files(spark, BATCHES[:2]), ch.run_folder(spark)
    keys = lambda path: sorted((r.source, r.source_id) for r in spark.read.parquet(path).collect())
    first = keys(ch.alert_once(read_feed(spark, folder), out))
    assert first == [("a", "1"), ("a", "2"), ("b", "1")]
    spark.createDataFrame([("b", "1", 1.0, 8), ("c", "1", 1.0, 9)], "source string, source_id string, price double, event_id bigint").withColumn(
        "ts", F.lit("2026-02-01").cast("timestamp")).select("source", "source_id", "ts", "price", "event_id").coalesce(1).write.parquet(f"{folder}/part=9")
    assert keys(ch.alert_once(read_feed(spark, folder), out)) == first + [("c", "1")]
    seeded = ch.alert_once(read_feed(spark, folder), ch.run_folder(spark), seed_only=True)
    assert spark.read.parquet(seeded).filter("sent").count() == 0


def test_the_first_row_of_a_batch_is_sent(spark):
    schema = "source string, source_id string, price double, event_id bigint, ts string"
    late = [("a", "9", 3.0, 5, "2026-01-03"), ("a", "9", 1.0, 2, "2026-01-01"), ("a", "9", 2.0, 1, "2026-01-02")]
    folder = f"{ch.run_folder(spark)}/in"
    write = lambda rows, part: spark.createDataFrame(rows, schema).select(
        "source", "source_id", F.col("ts").cast("timestamp").alias("ts"), "price", "event_id").coalesce(1).write.parquet(f"{folder}/part={part}")
    write(late, 0)
    write([("a", "9", 4.0, 0, "2025-01-01"), ("b", "1", 1.0, 7, "2026-01-01")], 1)
    sent = ch.alert_once(read_feed(spark, folder), ch.run_folder(spark))
    assert sorted((r.source, r.event_id) for r in spark.read.parquet(sent).collect()) == [("a", 2), ("b", 7)]


# ---- plans ------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_query_needs_a_cartesian_product(spark):
    queries, _ = registry.load()
    for name in ("fair_price_score", "fuzzy_match", "tracker_view", "dup_groups", "scan_cycle", "json_normalize"):
        text = plan(queries[name](spark, FOLDER))
        assert "CartesianProduct" not in text, name


def test_limits_and_filters_are_pushed_down(spark):
    queries, _ = registry.load()
    text = plan(queries["cap_per_source"](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text
    text = plan(queries["single_source"](spark, FOLDER))
    assert "EqualTo(l_returnflag,N)" in text
    narrow = text.split("lineitem.parquet")[1].split("ReadSchema")[1].split("\n")[0]
    assert "l_tax" not in narrow and "l_comment" not in narrow


def test_top_k_does_not_sort_everything(spark):
    queries, _ = registry.load()
    assert "TakeOrderedAndProject" in plan(queries["top_scores"](spark, FOLDER))


def test_comp_cells_bound_both_sides(spark):
    deals = spark.range(1000).select(
        F.lit("c").alias("city"), F.lit("n").alias("neighborhood"), F.lit(3.0).alias("comp_rooms"), (F.col("id") % 3 + 100).cast("int").alias("comp_sqm"),
        F.col("id").alias("price"), F.lit("2024-01-01").cast("date").alias("deal_date"), F.col("id").cast("string").alias("address_hash"))
    assert va.comp_cells(deals, ["city"], 50).count() == 150


def test_bucketed_state_needs_no_exchange(spark):
    from hearthline.operators import state as st

    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("source"), F.col("id").cast("string").alias("source_id"), F.col("id").alias("price"))
    st.save_snapshot(df, "hearthline_state", 4)
    stored, batch = spark.table("hearthline_state"), df.limit(20).repartition(4, "source", "source_id")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = st.upsert(stored, batch, F.lit("2026-01-01").cast("timestamp"))
        assert merged.count() == 200
        lines = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
        scan = next(i for i, line in enumerate(lines) if "hearthline_state" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(lines[scan])
        for line in lines[scan::-1]:  # the operators between the state's scan and the join
            if depth(line) < level:
                above.append(line)
                level = depth(line)
            if "SortMergeJoin" in line:
                break
        assert any("SortMergeJoin" in line for line in above)
        assert not any("Exchange" in line or "ShuffleQueryStage" in line for line in above)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE hearthline_state")


def test_tracker_folders(spark):
    from hearthline.operators.lifecycle import write_tracker

    out = tempfile.mkdtemp(prefix="hearthline-tracker-") + "/t"
    write_tracker(spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "city string, n int"), out, ["x"], ["n"])
    assert {(r.n, r.is_archive) for r in spark.read.parquet(out).collect()} == {(1, "true"), (2, "false"), (3, "false")}


def test_updated_estimates_equal_a_full_run(spark):
    """Days with new deals, expiring ones, new, gone and null profiles; only profiles near a changed cell are priced anew."""
    rng = random.Random(11)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    kinds = "city string, neighborhood string, rooms double, sqm int, price bigint, deal_date string, address_hash string"
    comps = spark.createDataFrame([
        (rng.choice("ABC"), rng.choice(["n", "m", "", None]), rng.choice([2.0, 2.5, 3.0, None]), rng.choice([40, 50, 58, 90, 0, None]),
         rng.randrange(100, 999) * 1000, day(rng.randrange(300)), f"h{i}") for i in range(600)], kinds).withColumn("deal_date", F.col("deal_date").cast("date"))
    every = [(c, n, r, q) for c in "ABCD" for n in ("n", "m", "", None) for r in (2.0, 3.0, None) for q in (45, 60, 88)]
    frame = lambda rows: spark.createDataFrame(rows, "city string, neighborhood string, rooms double, sqm int")
    options = dict(window_months=4, min_comps=2, max_comps=5)
    date = lambda n: F.lit(day(n)).cast("date")
    kept, last = va.start_estimates(frame(every[:100]), comps.filter(F.col("deal_date") < date(150)), date(150), **options), 150
    for now, profiles in ((170, every[20:]), (171, every), (260, every)):
        new = comps.filter((F.col("deal_date") >= date(last)) & (F.col("deal_date") < date(now)))
        kept, last = va.update_estimates(kept, frame(profiles), new, date(now), **options), now
        full = va.start_estimates(frame(profiles), comps.filter(F.col("deal_date") < date(now)), date(now), **options)
        columns = [*va.PROFILE, *va.RESULT]
        assert sorted(map(str, kept.prices.select(columns).collect())) == sorted(map(str, full.prices.select(columns).collect()))
    one = comps.filter((F.col("city") == "A") & (F.col("sqm") == 90)).select("city", F.col("rooms").alias("comp_rooms"), F.col("sqm").alias("comp_sqm"))
    assert {(r.city, r.sqm) for r in va.affected_profiles(frame(every), one).collect()} == {("A", 88)}


def test_positions_follow_the_order_over_many_files(spark):
    """Ties, nulls, hot values, tables named by text, several files a task; an empty table has no rows."""
    from pyspark.sql import functions as F

    from hearthline.operators.ordered import positions, read_positions, write_ordered

    rng = random.Random(3)
    data = [(i, rng.choice([None, 1, 1, 1, 1, rng.randrange(100)]), rng.choice(["b", "a c", None])) for i in range(5_000)]
    frame = spark.createDataFrame(data, "id int, v int, kind string").repartition(7)
    order = [F.desc_nulls_last("v"), "id"]
    plain = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = {r.id: r.position for r in positions(frame, order).collect()}
    assert got == {r[0]: i for i, r in enumerate(plain)}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 90)
    try:
        folder = tempfile.mkdtemp(prefix="hearthline-ordered-") + "/t"
        write_ordered(frame, folder, order, ["kind"])
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    written = read_positions(spark, folder, ["kind"])
    assert len(written.inputFiles()) > 20
    by_kind = {kind: {r[0]: i for i, r in enumerate(x for x in plain if x[2] == kind)} for kind in ("b", "a c", None)}
    for r in written.collect():
        assert by_kind[r.kind][r.id] == r.position
    assert positions(frame.limit(0), order).count() == 0


def test_builtin_feeds_have_known_rules():
    from hearthline.sources.details import RULES
    from hearthline.sources.feeds import builtin_feeds

    specs = builtin_feeds(2026)
    assert len(specs) == 8
    for spec in specs.values():
        assert set((spec.detail_rules or {}).values()) <= set(RULES)


def test_pages_without_a_root_tag_are_kept(spark):
    from hearthline.sources import detail_pages as dp

    pages = spark.createDataFrame(
        [(1, "s", "a", "<html><body><p>מעלית " + "x" * 3000 + "</p></body></html>"), (2, "s", "b", "<p>מעלית</p>"), (3, "s", "c", None)],
        "page_id long, source string, source_id string, html string")
    rows = {r.source_id: r for r in dp.text_details(pages, 2026).collect()}
    assert set(rows) == {"a", "b", "c"} and len(rows["a"].description) > 3000 and "מעלית" in rows["b"].description
    plan = dp.text_details(pages, 2026)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_description_nodes_of_the_feeds(spark):
    from hearthline.sources import detail_pages as dp
    from hearthline.sources.details import merged_value

    long = "בית על מגרש 450 מטר ועוד גינה 80 מ\"ר"
    rows = [(1, "s", "a", f'<nav>מעלית</nav><div class="rich-text-block-2">{long}</div><div class="rich-text-block-2">second</div>'),
            (2, "s", "b", '<div data-id="9ce8f11"><div class="elementor-widget-container">error 403 on this very page</div></div>'
                          f'<div class="elementor-widget-text-editor"><p class="elementor-widget-container">{long}</p></div>'),
            (3, "s", "c", "<nav>מעלית</nav>"), (4, "s", "d", ""), (5, "s", "e", None)]
    pages = spark.createDataFrame(rows, "page_id long, source string, source_id string, html string")
    catalog = {r.source_id: r for r in dp.catalog_details(pages, 2026).collect()}
    assert (catalog["a"].description, catalog["a"].lot_sqm, catalog["a"].garden_sqm, catalog["a"].elevator) == (long, 450, 80, None)
    article = {r.source_id: r for r in dp.article_details(pages, 2026).collect()}
    assert (article["b"].description, article["b"].lot_sqm) == (long, 450)
    assert set(catalog) == set(article) == set("abcde")
    for key in "cde":
        assert catalog[key].description is None and article[key].description is None and catalog[key].images == [] and article[key].tags == []
    got = spark.sql("SELECT '' AS h, 'x' AS f UNION ALL SELECT 'y', 'x' UNION ALL SELECT NULL, NULL UNION ALL SELECT '', NULL").select(
        merged_value(F.col("h"), F.col("f"), "fill_blank").alias("v"))
    assert sorted((r.v for r in got.collect()), key=str) == ["", None, "x", "y"]
