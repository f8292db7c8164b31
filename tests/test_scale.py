"""Work per row: heavy rows are dealt over the cores, repeated expressions run once, repeats of a page go early."""

from __future__ import annotations

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hearthline.functions import mining as mn, text as tx
from hearthline.operators import resolve as rs
from hearthline.plans import bronze, queries_streams as streams, queries_tracker, queries_valuation
from hearthline.session import checkpoint_dir, cut_lineage, scratch_tables, tune
from hearthline.sources import html, json_feeds as jf
from hearthline.sources.tables import listings
from hearthline.streaming import cycles


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_one_row_group_are_dealt_over_many_tasks(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("m").alias("c_mktsegment")).coalesce(1).write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.range(200).select(
        F.col("id").alias("p_partkey"), F.lit("t").alias("p_type"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"),
        F.lit(3).alias("p_size"), F.lit(9.5).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for pages, n in ((bronze.detail_html, 200), (bronze.free_item_pages, 200), (bronze.amenity_pages, 400), (bronze.catalog_pages, 400)):
        found = pages(spark, str(tmp_path))
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n and len(sizes) >= 8 and max(sizes) <= n / 8


def test_chosen_elements_run_once_in_an_address(spark):
    pages = spark.createDataFrame([(1, "<p>רחוב הרצל 4, חיפה</p>")], "page_id long, html string")
    text = html.text_of(html.elements("nodes", "p"))
    for split in (tx.split_address_either_order, tx.split_address_street_first, tx.split_address_city_first, tx.split_city_title):
        assert _plan(html.fragments(pages, "p").select(split(text).alias("s"))).count("filter(nodes") == 1


def test_address_splits_of_null_blank_and_plain_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "רחוב הרצל 4, חיפה"), (4, "חיפה, הרצל 4"), (5, "a, b 2, c")], "k int, t string")
    split = lambda f: [tuple(r["s"]) for r in rows.select("k", f(F.col("t"), default_city="X").alias("s")).orderBy("k").collect()]
    assert split(tx.split_address_either_order) == [
        ("", "", "", "X"), ("", "", "", "X"), ("הרצל", "4", "", "חיפה"), ("הרצל", "4", "", "חיפה"), ("b", "2", "b 2", "c")]
    assert split(tx.split_address_street_first) == [
        ("", "", "", "X"), ("", "", "", "X"), ("רחוב הרצל", "4", "", "חיפה"), ("חיפה", "", "", "הרצל 4"), ("a", "", "b 2", "c")]


def test_inside_reads_its_anchors_once(spark):
    pages = spark.createDataFrame([(1, "<div><ul><li><b>1</b></li></ul><b>2</b><li><i><b>3</b></i></li></div>")], "page_id long, html string")
    found = html.inside(html.elements("nodes", "b"), html.elements("nodes", "li"))
    assert html.fragments(pages, "div").select(F.transform(found, lambda n: n["text"])).head()[0] == ["1", "3"]
    assert "transform(array(filter(nodes" in _plan(html.fragments(pages, "div").select(found.alias("s")))


def test_repeats_of_a_page_go_before_the_rows_are_shuffled(spark):
    item = lambda token, price: {"token": token, "price": price}
    data = {"private": [item("a", 1), item("b", 2), item(None, 3), item("a", 4)], "platinum": [item("b", 5), item("", 6), item("c", 7)]}
    page = json.dumps({"pageProps": {"dehydratedState": {"queries": [{"state": {"data": data}}, {"state": {"data": {"private": [item("c", 8)]}}}]}}})
    raw = spark.createDataFrame([("s", 1, page), ("s", 0, page), ("t", 1, page)], "source string, page_no int, payload string")
    flat = jf.flatten_sections(raw)
    got = {(r["source"], r["page_no"], r["item"]["token"]): int(r["item"]["price"]) for r in flat.collect()}
    if got[("s", 0, "b")] == 5:  # platinum stands before private
        want = {"a": 1, "b": 5, "c": 7}
    else:
        want = {"a": 1, "b": 2, "c": 7}
    assert got == {(s, p, t): n for s, p in (("s", 0), ("t", 1)) for t, n in want.items()} and flat.count() == 6
    assert "array_position" in _plan(flat)


def test_texts_without_a_number_are_not_cast(spark):
    """A failed cast builds an exception, so no cast may meet the empty text of a pattern that does not match."""
    rows = spark.createDataFrame([(1, "3 יחידות דיור, 4.5 חדרים, קומה 2"), (2, "שקט"), (3, ""), (4, None)], "k int, t string")
    t = F.col("t")
    found = rows.orderBy("k").select(
        mn.units_count(t).alias("a"), mn.units_count_plain(t).alias("b"), mn.units_count_brief(t).alias("c"),
        *mn.text_measures(t).values(), tx.digits(t).alias("d"), tx.first_int(t).alias("e"), tx.first_float(t).alias("f"), tx.parse_price(t).alias("g"))
    assert not re.search(r"(?<!null else try_)cast\(regexp_(extract|replace)\(", _plan(found))
    none = (None,) * 10
    assert [tuple(r) for r in found.collect()] == [(3, 3, 3, 4.5, None, 2, 3452, 3, 3.0, 3), none, none, none]


def test_long_steps_run_as_methods_that_are_compiled(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_parking_words_are_not_cast(spark):
    item = lambda above, under: {"id": "a", "additional_info": {"parking": {"aboveground": above, "underground": under}}}
    page = json.dumps({"data": [item("2", "none"), item("none", "1"), item("0", "none"), item("1 or 2", ""), item(None, " 3 ")]})
    rows = jf.parse_bilingual(spark.createDataFrame([("s", 1, page)], "source string, page_no int, payload string")).select("parking")
    assert [r["parking"] for r in rows.collect()] == [True, True, False, False, True]
    assert "RLIKE(" in _plan(rows)


def test_arriving_rows_are_made_once(spark, tmp_path):
    drawn = F.udf(lambda _: random.randrange(2), "int").asNondeterministic()
    rows = spark.range(500).select(F.col("id"), drawn("id").alias("drawn"))
    streams.arriving(spark, rows, F.col("drawn"), 2, 1, str(tmp_path), lambda stream: None)
    kept = spark.read.parquet(f"{tmp_path}/in")
    assert kept.count() == 500 and kept.select("id").distinct().count() == 500


def test_pages_of_plain_markup_are_read_without_the_parser(monkeypatch):
    page = '<div class="a  b" ID="x">one <b>two</b> &amp; three<br><i title="4 &gt; 3"></i></div>after'
    others = ["<div>a < b</div>", "<p>x<script>if (a</b>c)</script>y</p>", "<a href='q'>r</a>", "<!-- c --><b>d</b>", "<br/>e", "<p", "<title>a<b>c</title>"]
    read = lambda text: [[*row[:4], found.text_of(row)] for found in [html._parsed(text)] for row in found.rows]
    fast = [read(text) for text in [page, *others]]
    assert fast[0] == [
        [3, -1, "div", {"class": "a  b", "id": "x"}, "one two & three"], [1, 0, "b", {}, "two"], [2, 0, "br", {}, ""],
        [3, 0, "i", {"title": "4 > 3"}, ""]]
    with monkeypatch.context() as patched:
        patched.setattr(html, "_read_plain", lambda *_: False)
        assert [read(text) for text in [page, *others]] == fast
    fed = []
    monkeypatch.setattr(html._Elements, "feed", lambda self, text: fed.append(text))
    read(page)
    assert fed == []


def test_normal_texts_are_told_by_one_match(spark):
    texts = ["blue plate 18", "רח' הים 5", " a", "a  b", "a\n", "a\u00a0b", "תל־חי", "ד״ר x", "", None, "שד'", "x שד'", "שד'x y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    table, stop = {"רח'": "רחוב", "שד'": "", "b.": "c"}, ["רחוב", "y"]
    slow = tx.expand_abbreviations(tx.unify_quotes(tx.strip_marks(F.coalesce("t", F.lit("")), True)), table)
    got = rows.select(tx.normalize_text(F.col("t"), table).alias("n"), tx.canonicalize_address(F.col("t"), stop, table).alias("c"), slow.alias("s")).collect()
    assert [r["n"] for r in got] == [r["s"] for r in got]
    assert [r["c"] for r in got] == [" ".join(w for w in r["s"].split(" ") if w not in stop) for r in got]
    told = rows.filter(F.col("t").rlike(tx._words_without(table))).collect()
    assert [r["t"] for r in told] == ["blue plate 18", "שד'x y"]


def test_keys_of_listings_are_made_once(spark):
    fields = "source string, source_id string, city string, street string, house_number string, rooms double, sqm int, first_seen_at timestamp"
    rows = spark.createDataFrame([("a", "1", "X", "Herzl", "4", 3.0, 70, None), ("a", "2", "X", "Herzl", "4", 3.0, 70, None)], fields)
    resolved = rs.resolve(rows, same_buckets=True)
    assert "rlike" not in _plan(resolved).lower() and "regexp_replace" not in _plan(resolved)
    assert len({r["canonical_id"] for r in resolved.collect()}) == 1
    groups = rs.exact_groups(rows).select("canonical_id", *rs.GROUP_PARTS).distinct()
    index = rs.stored_units(groups, same_buckets=True)
    assert all("regexp_replace" not in _plan(frame) for frame in (index.keys, index.texts, index.heads))


def test_latest_sightings_are_sorted_by_the_listing_first(spark):
    plan = _plan(listings(spark, "/root/testdata/sf0.001"))
    assert re.search(r"row_number\(\) windowspecdefinition\(source_id#\d+, source#\d+", plan)


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return len(re.findall(r"shuffle_\d+_\d+_\d+\.data", files))


def test_shuffle_files_go_with_their_action(spark, tmp_path):
    tune(spark)
    before = _shuffle_files(spark)
    spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().write.parquet(f"{tmp_path}/t")
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before and spark.read.parquet(f"{tmp_path}/t").count() == 100


def test_tables_of_a_batch_go_with_it(spark):
    with scratch_tables(spark):
        inner = cut_lineage(spark.range(5)).inputFiles()
        with scratch_tables(spark):
            deeper = cut_lineage(spark.range(5)).inputFiles()
        assert all(os.path.exists(f.removeprefix("file://")) for f in inner) and not any(os.path.exists(f.removeprefix("file://")) for f in deeper)
    assert inner and deeper and not any(os.path.exists(f.removeprefix("file://")) for f in inner)
    assert cut_lineage(spark.range(5)).count() == 5


def test_a_stream_leaves_no_tables_of_its_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").repartition(2)
    rows.write.parquet(f"{tmp_path}/in")
    left = []
    cycles.available(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), str(tmp_path),
                     lambda batch, n: left.extend(cut_lineage(batch).inputFiles()))
    assert left and not any(os.path.exists(f.removeprefix("file://")) for f in left)


def test_lots_are_held_once(spark, tmp_path):
    tables = f"{checkpoint_dir(spark).removeprefix('file:')}/tables"
    count = lambda: len(os.listdir(tables)) if os.path.isdir(tables) else 0
    rows, before, seen = spark.range(20).select("id", (F.col("id") % 4).alias("part")), count(), []
    streams.arriving(spark, rows, F.col("part"), 5, 2, str(tmp_path), lambda stream: seen.append(sorted(os.listdir(f"{tmp_path}/in"))))
    assert seen == [["lot=0", "lot=1"], ["lot=0", "lot=1", "lot=2", "lot=3"]] and count() == before
    assert spark.read.parquet(f"{tmp_path}/in").count() == 20
    assert not [f for _, _, files in os.walk(f"{tmp_path}/laid") for f in files if f.endswith(".parquet")]


def test_shared_rows_are_written_before_they_are_joined(spark, monkeypatch):
    """Listings and halves are read more than once or in front of wide shuffles."""
    folder, seen = "/root/testdata/sf0.001", []

    class Seen(Exception):
        pass

    def catch(*frames):
        seen.extend(frames)
        raise Seen

    monkeypatch.setattr(streams, "scan_cycle", lambda feed, *a, **k: catch(feed))
    monkeypatch.setattr(streams, "rescan", lambda state, keys, details, *a, **k: catch(state, keys, details))
    monkeypatch.setattr(queries_tracker.lc, "build_tracker", lambda rows, prior, *a, **k: catch(prior))
    monkeypatch.setattr(queries_tracker.lc, "write_tracker", lambda rows, *a, **k: catch(rows))
    monkeypatch.setattr(queries_valuation, "start_estimates", lambda *a, **k: None)
    monkeypatch.setattr(queries_valuation, "update_estimates", lambda *a, **k: None)
    monkeypatch.setattr(queries_valuation, "with_estimates", lambda rows, kept: catch(rows))
    for run in (streams.scan_cycle_query, streams.rescan_rows, queries_valuation.fair_price_update, queries_tracker.tracker):
        with pytest.raises(Seen):
            run(spark, folder)
    monkeypatch.setattr(queries_tracker, "tracker", lambda *a: spark.range(3).distinct())
    with pytest.raises(Seen):
        queries_tracker.tracker_written(spark, folder)
    seen.append(bronze.nested_pages(spark, folder))
    assert len(seen) == 8
    for frame in seen:
        assert not re.search("window|Join|Aggregate", _plan(frame), re.I) and all("/tables/" in f for f in frame.inputFiles())
