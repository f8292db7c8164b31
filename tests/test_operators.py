"""Behaviour of valuation, scoring, state, tracker, resolution on small invented rows."""

import datetime as dtm
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hearthline.operators import filters as flt, lifecycle as lc, resolve as rs, runs, scoring as sc, state as st, valuation as va
from hearthline.operators.extractions import apply_extractions, zip_results
from hearthline.operators.windows import fixed_batches, numbered, previous_value
from hearthline.plans import scan_cycle as cycle
from hearthline.schema import LISTING, align_to_schema, canonical
from test_functions import _lcs

AS_OF = F.lit  # dates are given as literals below


def listing_frame(spark, rows, **extra):
    names = sorted({k for r in rows for k in r})
    kinds = {f.name: f.dataType.simpleString() for f in LISTING.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return canonical(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def one(source_id="1", **kw):
    base = dict(source="a", source_id=source_id, city="חולון", neighborhood="מרכז", street="הגפן 7", price=1_000_000, sqm=100, rooms=4.0)
    return {**base, **kw}


# ---- valuation --------------------------------------------------------------

def comps(spark, rows):
    return spark.createDataFrame(
        [(c, n, r, s, p, dtm.date.fromisoformat(d), h) for c, n, r, s, p, d, h in rows],
        "city string, neighborhood string, rooms double, sqm int, price bigint, deal_date date, address_hash string")


def priced(spark, listings, deals, **kw):
    out = va.fair_price(listings, deals, F.lit("2024-08-01").cast("date"), **kw)
    return {r.source_id: r for r in out.collect()}


def test_no_comps_no_price(spark):
    got = priced(spark, listing_frame(spark, [one()]), comps(spark, []))
    assert got["1"].fair_price_estimate is None


def test_neighborhood_first_then_city(spark):
    near = [("חולון", "מרכז", 4.0, 100, 1_000_000 + i * 100_000, "2024-05-01", f"h{i}") for i in range(3)]
    far = [("חולון", "צפון", 4.0, 100, 5_000_000 + i, "2024-06-01", f"f{i}") for i in range(5)]
    got = priced(spark, listing_frame(spark, [one(), one("2", neighborhood="דרום"), one("3", neighborhood="")]), comps(spark, near + far))
    assert (got["1"].comps_scope, got["1"].comps_used, got["1"].fair_price_estimate) == ("neighborhood", 3, 1_100_000)
    assert got["1"].fair_price_low <= got["1"].fair_price_estimate <= got["1"].fair_price_high
    assert (got["2"].comps_scope, got["2"].comps_used) == ("city", 8)
    assert (got["3"].comps_scope, got["3"].comps_used) == ("city", 8)


def test_bounds_rooms_age_and_minimum(spark):
    deals = [
        ("חולון", "מרכז", 4.5, 80, 800_000, "2024-05-01", "lo"), ("חולון", "מרכז", None, 120, 1_200_000, "2024-05-01", "hi"),
        ("חולון", "מרכז", 5.0, 100, 1, "2024-05-01", "rooms"), ("חולון", "מרכז", 4.0, 79, 1, "2024-05-01", "small"),
        ("חולון", "מרכז", 4.0, 100, 1, "2023-01-31", "old"), ("חולון", "מרכז", 4.0, None, 1, "2024-05-01", "none"),
    ]
    rows = listing_frame(spark, [one()])
    assert priced(spark, rows, comps(spark, deals))["1"].comps_used is None
    deals.append(("חולון", "מרכז", 3.5, 100, 1_000_000, "2023-02-01", "edge"))
    assert priced(spark, rows, comps(spark, deals))["1"].comps_used == 3


def test_only_the_newest_fifty(spark):
    old = [("חולון", "מרכז", 4.0, 90 + i % 20, 90_000_000, "2024-01-01", f"o{i}") for i in range(200)]
    new = [("חולון", "מרכז", 4.0, 90 + i % 20, (90 + i % 20) * 10_000, "2024-07-01", f"n{i}") for i in range(50)]
    got = priced(spark, listing_frame(spark, [one()]), comps(spark, old + new))
    assert (got["1"].comps_used, got["1"].fair_price_estimate) == (50, 1_000_000)


def test_area_slices_cover_the_tolerance(spark):
    n = 600
    frame = spark.range(10, n).select(F.col("id").alias("a")).join(
        spark.range(10, n).select(F.col("id").alias("b")), (F.col("b") * 10).between(F.col("a") * 8, F.col("a") * 12))
    gap = va.area_slice(F.col("b")) - va.area_slice(F.col("a"))
    assert frame.filter(~gap.between(-2, 1)).count() == 0


# ---- scoring ----------------------------------------------------------------

def scores(spark, rows, **kw):
    out = sc.score(listing_frame(spark, rows), F.lit("2026-06-01").cast("date"), **kw)
    return {r.source_id: r for r in out.select("source_id", "score", "score_reasons").collect()}


def test_score_sources_and_clamp(spark):
    got = scores(spark, [
        one("ref", city="רמת גן", price=3_300_000), one("fair", fair_price_estimate=1_000_000),
        one("units", units_count=6, garden_sqm=400, price=100_000, parking=True, balcony=True, renovated=True, year_built=2025),
        one("text", description="בית עם 3 יחידות דיור וגינה גדולה"), one("agent", is_agent=True, price=9_000_000),
    ])
    r = lambda k: got[k].score_reasons
    assert (r("ref").market_band_source, list(r("ref").market_band)) == ("market_refs", [28_000, 38_000])
    assert (r("fair").market_band_source, list(r("fair").market_band)) == ("comps", [9_000, 11_000])
    assert got["units"].score == 10.0 and r("units").description_unit_source == "structured"
    assert (r("text").description_unit_source, r("text").description_unit_adjustment) == ("description_count", 1.0)
    assert r("text").garden_bonus_source == "description" and r("text").garden_bonus == 0.14
    assert r("agent").seller_channel == "agent" and r("agent").risk_liquidity is True
    assert all(1.0 <= row.score <= 10.0 for row in got.values())


def test_market_delta_edges(value):
    f = lambda p: sc.market_delta(p, F.lit(100), F.lit(200))
    assert value(f, 0.0, 50.0, 100.0, 150.0, 200.0, 220.0, 1000.0, schema="x double") == [None, 2.5, 2.0, 1.0, 0.0, -1.0, -2.0]


def test_band_order_matters(value):
    bands = [("עיר", "צפון", 1, 2), ("עיר", "", 3, 4)]
    got = value(lambda c, n: sc.market_band(c, n, bands, (5, 6)), ("עיר", "צפון ישן"), ("עיר", "דרום"), ("אחר", "צפון"), schema="c string, n string")
    assert [(r.lo, r.hi) for r in got] == [(1, 2), (3, 4), (5, 6)]


# ---- filters ----------------------------------------------------------------

def test_first_reason_wins(spark):
    cfg = flt.SearchConfig(exclude_ground_floor=True)
    rows = listing_frame(spark, [
        one("a", rooms=9.0, price=1), one("b", price=1), one("c", price=2_000_000, floor=0), one("d", price=2_000_000),
        one("e", price=2_000_000, rooms=None, sqm=None, floor=None)])
    order = ["rooms_out_of_range", "ground_floor", "price_out_of_range", "sqm_too_small"]
    out = rows.withColumn("why", flt.reject_reason(flt.rule_set(cfg, F.lit("2026-01-01").cast("date"), order)))
    assert {r.source_id: r.why for r in out.collect()} == {
        "a": "rooms_out_of_range", "b": "price_out_of_range", "c": "ground_floor", "d": None, "e": None}


def test_topics_in_three_scripts(value):
    topics = [flt.Topic("bed", ["מיטה", r"\bbeds?\b"]), flt.Topic("table", ["стол", "TABLE"])]
    assert value(lambda c: flt.match_topics(c, topics), "Double BED", "מוסרים מיטה ו-table", "СТОЛ", "bedroom") == [
        ["bed"], ["bed", "table"], ["table"], []]


# ---- state ------------------------------------------------------------------

NOW = "2026-06-02 10:00:00"


def test_upsert_keeps_user_fields_and_is_idempotent(spark):
    state = listing_frame(spark, [
        one("1", price=100, user_notes="mine", is_favorite=True, rooms_user=3.0, canonical_id="CAN-x", first_seen_at=dtm.datetime(2026, 1, 1),
            last_seen_at=dtm.datetime(2026, 1, 1), publish_date=dtm.date(2026, 1, 1)),
        one("2", price=200, first_seen_at=dtm.datetime(2026, 1, 1), last_seen_at=dtm.datetime(2026, 1, 1))])
    batch = listing_frame(spark, [one("1", price=90, user_notes="scraped", publish_date=dtm.date(2026, 5, 1)), one("3", price=300)])
    now = F.lit(NOW).cast("timestamp")
    merged = st.upsert(state, batch, now)
    rows = {r.source_id: r for r in merged.collect()}
    assert (rows["1"].change, rows["1"].prev_price, rows["1"].price) == ("updated", 100, 90)
    assert (rows["1"].user_notes, rows["1"].is_favorite, rows["1"].rooms_user, rows["1"].canonical_id) == ("mine", True, 3.0, "CAN-x")
    assert rows["1"].first_listed_date == dtm.date(2026, 1, 1)
    assert (rows["2"].change, rows["2"].last_seen_at) == ("kept", dtm.datetime(2026, 1, 1))
    assert (rows["3"].change, rows["3"].prev_price, rows["3"].is_favorite) == ("new", None, False)
    once = st.snapshot_of(merged)
    again = st.snapshot_of(st.upsert(once, batch, now))
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(once) == key(again)


def test_history_keeps_one_row_per_instant(spark):
    t = lambda d: dtm.datetime(2026, 1, d)
    old = spark.createDataFrame([("a", "1", t(1), 5)], "source string, source_id string, ts timestamp, price bigint")
    new = spark.createDataFrame([("a", "1", t(1), 9), ("a", "1", t(2), 5)], old.schema)
    assert sorted((r.ts.day, r.price) for r in st.append_history(old, new).collect()) == [(1, 5), (2, 5)]


def test_user_edits_set_clear_and_omit(spark):
    state = listing_frame(spark, [one("1", rooms_user=3.0, sqm_user=50, user_notes="n"), one("2", rooms_user=3.0)])
    edits = spark.createDataFrame([("a", "1", ["rooms_user", "user_notes"], None, "x" * 2500)],
                                  "source string, source_id string, set_mask array<string>, rooms_user double, user_notes string")
    rows = {r.source_id: r for r in st.apply_user_edits(state, edits).collect()}
    assert (rows["1"].rooms_user, rows["1"].sqm_user, len(rows["1"].user_notes), rows["1"].matched) == (None, 50, 2000, True)
    assert (rows["2"].rooms_user, rows["2"].matched) == (3.0, False)


def test_schema_alignment(spark):
    old = spark.createDataFrame([("a", "1", None)], "source string, source_id string, city string")
    row = canonical(old).first()
    assert (row.city, row.is_favorite, row.sqm_build, len(row)) == ("", False, None, len(LISTING.fields))
    assert align_to_schema(old.withColumn("junk", F.lit(1)), LISTING).columns == LISTING.fieldNames()


def test_alert_kinds_exclude_each_other(spark):
    rows = [("new", 8.0, None, 100, 1), ("new", 6.0, None, 100, 1), ("new", 8.0, None, 100, 3), ("updated", 9.0, 100, 97, None),
            ("updated", 9.0, 100, 98, None), ("kept", 9.0, 100, 50, None)]
    df = spark.createDataFrame(rows, "change string, score double, prev_price bigint, price bigint, floor int")
    assert [r.k for r in df.select(runs.alert_kind(7.0, 3.0).alias("k")).collect()] == ["new", None, None, "price_drop", None, None]


def test_edit_and_rescore_scores_the_whole_row(spark):
    state = sc.score(listing_frame(spark, [one("1", fair_price_estimate=1_000_000), one("2")]), F.lit("2026-06-01").cast("date"))
    edits = spark.createDataFrame([("a", "1", ["units_count_user"], 4)], "source string, source_id string, set_mask array<string>, units_count_user int")
    before = {r.source_id: r.score for r in state.collect()}
    after = {r.source_id: r for r in cycle.edit_and_rescore(canonical(state), edits, F.lit("2026-06-01").cast("date")).collect()}
    assert after["1"].score == round(before["1"] + 1.5, 1) and after["2"].score == before["2"]
    assert after["1"].score_reasons.market_band_source == "comps"


def test_rescan_updates_only_the_chosen_keys(spark):
    state = listing_frame(spark, [one("1", first_seen_at=dtm.datetime(2026, 1, 1)), one("2")])
    details = spark.createDataFrame([("a", "1", "בית, גינה 80 מ\"ר", True)], "source string, source_id string, description string, parking boolean")
    keys = state.filter("source_id = '1'")
    out = cycle.rescan(state, keys, details, comps(spark, []), F.lit(NOW).cast("timestamp"))
    rows = {r.source_id: r for r in out.collect()}
    assert (rows["1"].garden_sqm, rows["1"].parking, rows["1"].score is not None) == (80, True, True)
    assert (rows["2"].score, rows["2"].last_seen_at) == (None, None)


# ---- windows ----------------------------------------------------------------

def test_sliced_lag_and_numbering_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(100)) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    got = previous_value(df, ["k"], ["t"], "v", F.floor(F.col("t") / 37), "p")
    pos = numbered(df, ["k"], ["t"], F.floor(F.col("t") / 37), "n")
    last, count, want, want_pos = {}, {}, {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        want[(k, t)], last[k] = last.get(k), v
        want_pos[(k, t)] = count.get(k, 0)
        count[k] = count.get(k, 0) + 1
    assert {(r.k, r.t): r.p for r in got.collect()} == want
    assert {(r.k, r.t): r.n for r in pos.collect()} == want_pos


def test_result_batches_of_wrong_size_are_rejected(spark):
    rows = spark.range(5).select(F.lit("s").alias("source"), "id", F.lit(None).cast("int").alias("sqm"))
    batches = fixed_batches(rows, ["source"], ["id"], 3, F.floor(F.col("id") / 100))
    results = spark.createDataFrame([("s", 0, 0, "50"), ("s", 0, 1, "5"), ("s", 0, 2, "x"), ("s", 1, 0, "60")],
                                    "source string, batch_no bigint, idx bigint, sqm string")
    out = apply_extractions(zip_results(batches, results, ["source", "batch_no"]))
    assert {r.id: (r.sqm, r.accepted) for r in out.collect()} == {
        0: (50, True), 1: (None, True), 2: (None, True), 3: (None, False), 4: (None, False)}


# ---- resolution -------------------------------------------------------------

def brute_pairs(nodes, percent):
    out = {}
    for (i, a, sa), (j, b, sb) in itertools.permutations(nodes, 2):
        if sa > sb:
            lcs = _lcs(a, b)
            if lcs * 200 >= (len(a) + len(b)) * percent:
                out[(i, j)] = lcs
    return out


@pytest.mark.parametrize("percent,size", [(85, 40), (85, 160), (70, 120)])
def test_similar_pairs_equal_brute_force(spark, percent, size):
    rng = random.Random(size)
    words = ["גפן", "תמר", "רימון", "הרב קוק", "ויצמן", "בן גוריון", "הים", "שדרות ירושלים"]
    texts = set()
    while len(texts) < size:
        t = list("חולון " + rng.choice(words) + " " + rng.choice(words) + f" {rng.randrange(60)}")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("אבגדהוז ")
        texts.add("".join(t).strip())
    nodes = [(f"n{i}", t, i) for i, t in enumerate(sorted(texts))]
    df = spark.createDataFrame([(i, t, "חולון", s) for i, t, s in nodes], "id string, text string, city_n string, seen bigint")
    got = [(r.id, r.parent) for r in rs.similar_pairs(df, percent).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(brute_pairs(nodes, percent))


def test_best_earlier_equals_brute_force_with_short_and_long_texts(spark):
    rng = random.Random(5)
    words = ["גפן", "תמר", "רימון", "herzl", "h" * 70]
    texts = {"1", "2", "a", "ab", "ח", "חו", "חול 1"}
    while len(texts) < 120:
        t = list("חולון " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + f" {rng.randrange(3000)}")
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice("אב🙂7")
        texts.add("".join(t))
    nodes = [(f"n{i}", t, i) for i, t in enumerate(sorted(texts, key=lambda t: (len(t) % 7, t)))]
    df = spark.createDataFrame([(i, t, "חולון", s) for i, t, s in nodes], "id string, text string, city_n string, seen bigint")
    for percent in (85, 50):
        want = {}
        text = {i: t for i, t, _ in nodes}
        for (i, j), lcs in brute_pairs(nodes, percent).items():
            score = (-lcs * 2 / (len(text[i]) + len(text[j])), int(j[1:]), j)
            want[i] = min(want.get(i, score), score)
        got = {r.id: (-r.similarity, int(r.parent[1:]), r.parent) for r in rs.best_earlier(df, percent).collect()}
        assert got == want


def resolve_rows(spark, rows, **kw):
    names = ["source", "source_id", "city", "street", "house_number", "address", "rooms", "sqm", "price", "first_seen_at"]
    df = spark.createDataFrame([tuple(r.get(n, "") for n in names) for r in rows],
                               "source string, source_id string, city string, street string, house_number string, address string, rooms double, sqm int, price bigint, first_seen_at bigint")
    return {(r.source, r.source_id): r.canonical_id for r in rs.resolve(df, **kw).collect()}


def unit(source, source_id, street, seen, **kw):
    return dict(source=source, source_id=source_id, city="חולון", street=street, rooms=4.0, sqm=100, price=1, first_seen_at=seen, **kw)


def test_resolution_is_stable_under_row_order(spark):
    rows = [unit("a", "1", "רח' אלופי צהל 12", 1), unit("b", "1", "רחוב אלופי צהל  12", 2), unit("c", "1", "אלופי צה\"ל 12", 3),
            unit("a", "2", "שדרות ירושלים 90", 4), unit("a", "3", "אלופי צהל 12", 5) | {"sqm": 160}]
    first = resolve_rows(spark, rows)
    assert first[("a", "1")] == first[("b", "1")] == first[("c", "1")] == first[("a", "3")] != first[("a", "2")]
    assert first == resolve_rows(spark, rows[::-1])
    strict = resolve_rows(spark, rows, same_buckets=True)
    assert strict[("a", "1")] == strict[("c", "1")] != strict[("a", "3")]


def test_chains_end_at_the_root_and_cities_stay_apart(spark):
    base = "שדרות בן גוריון הארוכה"
    rows = [unit("a", str(i), base[: len(base) - i] + "x" * i, i) for i in range(7)]
    rows.append(unit("z", "9", base, 99) | {"city": "רמלה"})
    got = resolve_rows(spark, rows)
    assert len({got[("a", str(i))] for i in range(7)}) == 1 and got[("z", "9")] != got[("a", "0")]


def test_stored_groups_come_first(spark):
    rows = [unit("a", "1", "אלופי צהל 12", 1), unit("a", "2", "אלופי צהל 13", 2), unit("a", "3", "שדרות ירושלים 90", 3)]
    stored = spark.createDataFrame([("CAN-old", "חולון", "אלופי צהל", "12", "4.0", "100")],
                                   "canonical_id string, city_n string, street_n string, number_n string, rooms_b string, sqm_b string")
    got = resolve_rows(spark, rows, stored=stored)
    assert got[("a", "1")] == got[("a", "2")] == "CAN-old" and got[("a", "3")] != "CAN-old"


STORED = "canonical_id string, city_n string, street_n string, number_n string, rooms_b string, sqm_b string"


def test_growing_index_equals_plain_groups(spark):
    """Batches against a growing index get the ids that they get against the plain groups of the batches before."""
    rng = random.Random(8)
    streets = ["אלופי צהל", "אלופי צה", "שדרות ירושלים", "שדרות ירושלמי", "הרב קוק", "הרב קוקי", ""]
    rows = [unit("a", str(i), f"{rng.choice(streets)} {rng.randrange(1, 40)}".strip(), i) | {"rooms": float(rng.randrange(3, 5))} for i in range(150)]
    name = f"units_{random.randrange(1 << 40)}"
    index = rs.save_units(rs.stored_units(spark.createDataFrame([], STORED), same_buckets=True), name, 4)
    columns = ["source", "source_id", "city", "street", "house_number", "address", "rooms", "sqm", "price", "first_seen_at"]
    kinds = "source string, source_id string, city string, street string, house_number string, address string, rooms double, sqm int, price bigint, first_seen_at bigint"
    got, known = {}, {}
    for start in range(0, 150, 50):
        batch = spark.createDataFrame([tuple(r.get(n, "") for n in columns) for r in rows[start:start + 50]], kinds)
        groups = sorted(known.items())
        plain = spark.createDataFrame([(i, *parts) for parts, i in groups], STORED) if groups else None
        found = rs.resolve(batch, index, same_buckets=True)
        part = {(r.source, r.source_id): r.canonical_id for r in found.collect()}
        assert part == {(r.source, r.source_id): r.canonical_id for r in rs.resolve(batch, plain, same_buckets=True).collect()}
        for r in found.collect():
            known.setdefault(tuple(r[p] for p in rs.GROUP_PARTS), r.canonical_id)
        index = rs.extend_units(index, name, found, 4)
        got |= part
    assert index.keys.count() == index.keys.select("exact_id").distinct().count() == len(known)
    assert index.texts.count() == index.texts.select(*index.block, "text").distinct().count()
    assert index.heads.count() == index.heads.select("city_n", "t1", "t2", "node").distinct().count()
    text = lambda p: " ".join(x for x in p[:3] if x)
    close = [(a, b) for a in known for b in known if a < b and a[3:] == b[3:] and text(a) == text(b)]
    assert all(known[a] == known[b] for a, b in close)
    with pytest.raises(ValueError):
        rs.resolve(batch, index, percent=90, same_buckets=True)


def test_stored_texts_are_not_shuffled_nor_compared_with_each_other(spark):
    stored = spark.createDataFrame([(f"CAN-{i}", "חולון", "הרב קוק", str(i), "4.0", "100") for i in range(60)], STORED)
    name = f"units_{random.randrange(1 << 40)}"
    index = rs.save_units(rs.stored_units(stored), name, 8)
    new = spark.createDataFrame([("n", "חולון שדרות ירושלים 7", "חולון", 5)], "id string, text string, city_n string, seen bigint").withColumn(
        "mask", rs._masked(F.col("text")))
    assert rs._mask_pairs(new, 50, index.heads).select("mask").distinct().count() <= 1
    plan = rs._meeting(rs.head_pairs(new, 85), index.heads.hint("merge"), 85, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_new_group_with_the_id_of_a_stored_one_ends(spark):
    """A stored group keeps its id although its key has changed; a new group of the old key gets the same id and no loop."""
    rows = [unit("a", "1", "אלופי צהל 12", 1), unit("a", "2", "אלופי צהל 13", 2)]
    own = resolve_rows(spark, rows[:1])[("a", "1")]
    stored = spark.createDataFrame([(own, "חולון", "אלופי צהלי", "12", "4.0", "100")], STORED)
    got = resolve_rows(spark, rows, stored=stored)
    assert got == {("a", "1"): own, ("a", "2"): own}


# ---- tracker ----------------------------------------------------------------

def tracker_step(spark, fresh, prior, day, active=True):
    kinds = {"price": "bigint", "city": "string", "comments": "string", "score": "double"}
    rows = spark.createDataFrame(
        [("a", i, p, c, "", s, active, dtm.date(2026, 1, 1)) for i, p, c, s in fresh],
        "source string, source_id string, price bigint, city string, comments string, score double, active boolean, first_listed_date date")
    return lc.build_tracker(rows, prior, F.lit(day).cast("date"), audit_max=2, tracked=kinds), kinds


def as_prior(spark, frame, kinds, **edits):
    cells = [F.coalesce(F.lit(edits.get(n)), F.col(f"m_{n}"), F.lit("")).alias(f"cell_{n}") for n in kinds]
    return frame.select("source", "source_id", *cells, "shadow", "change_log", "disappeared_on", "last_changed")


def test_tracker_cycle(spark):
    kinds = {"price": "bigint", "city": "string", "comments": "string", "score": "double"}
    nothing = spark.createDataFrame([], "source string, source_id string, " + ", ".join(f"cell_{n} string" for n in kinds)
                                    + ", shadow struct<" + ",".join(f"{n}:string" for n in kinds) + f">, change_log {lc.LOG}, disappeared_on date, last_changed date")
    first, kinds = tracker_step(spark, [("1", 100, "חולון", 7.5)], nothing, "2026-01-01")
    row = first.first()
    assert [c.col for c in row.change_log[0].changes] == ["price", "city", "score"] and row.last_changed == dtm.date(2026, 1, 1)
    # the user edits two cells, one of them into an error text; the source changes the price
    prior = as_prior(spark, first, kinds, comments="call", city="#REF!")
    second, _ = tracker_step(spark, [("1", 90, "חולון", 7.5)], prior, "2026-01-02")
    row = second.first()
    assert (row.m_comments, row.m_city, row.m_price) == ("call", "חולון", "90")
    assert {c.col: (c.old, c.new) for c in row.change_log[0].changes} == {"price": ("100", "90"), "comments": ("", "call")}
    # the merged value became the shadow, so a cell left alone takes the source's value again
    third, _ = tracker_step(spark, [("1", 90, "חולון", 7.5)], as_prior(spark, second, kinds), "2026-01-03")
    row3 = third.first()
    assert row3.m_comments == "" and [(c.col, c.old, c.new) for c in row3.change_log[0].changes] == [("comments", "call", "")]
    assert len(row3.change_log) == 2 and row3.last_changed == dtm.date(2026, 1, 3)
    # an unchanged row keeps its log and its date
    fourth, _ = tracker_step(spark, [("1", 90, "חולון", 7.5)], as_prior(spark, third, kinds), "2026-01-04")
    assert (fourth.first().last_changed, fourth.first().change_log) == (row3.last_changed, row3.change_log)
    third = fourth
    # gone, then back; the log keeps two entries
    gone, _ = tracker_step(spark, [("1", 90, "חולון", 7.5)], as_prior(spark, third, kinds), "2026-01-05", active=False)
    assert gone.first().disappeared_on == dtm.date(2026, 1, 5) and gone.first().change_log[0].disappeared
    back, _ = tracker_step(spark, [("1", 90, "חולון", 7.5)], as_prior(spark, gone, kinds), "2026-01-06")
    assert back.first().disappeared_on is None and back.first().change_log[0].reappeared and len(back.first().change_log) == 2


def test_freshness_uses_the_source_scan(spark):
    t = lambda h, m=0: dtm.datetime(2026, 1, 1, h, m)
    rows = spark.createDataFrame([("a", "1", t(9, 50)), ("a", "2", t(9, 40)), ("b", "3", t(9)), ("b", "4", t(7))], "source string, source_id string, last_seen_at timestamp")
    log = spark.createDataFrame([("a", t(10), 5), ("a", t(12), 0)], "source string, ts timestamp, fetched bigint")
    out = lc.with_freshness(rows, runs.latest_success(log), F.lit("2026-01-01 10:30:00").cast("timestamp"), 120)
    assert {r.source_id: r.active for r in out.collect()} == {"1": True, "2": False, "3": True, "4": False}
