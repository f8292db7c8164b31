"""Exact values of the text, date, number and mining functions."""

import datetime as dtm

from hearthline.functions import dates as dt, mining as mn, numeric as num, similarity as sim, text as tx
from pyspark.sql import functions as F


def test_addresses_converge(value):
    keys = value(tx.canonicalize_address, "רח' הגפן 7", "רחוב הגפן  7", "הגפן 7", " הַגֶּפֶן\t7")
    assert set(keys) == {"הגפן 7"}


def test_abbreviations_are_whole_tokens(value):
    assert value(tx.normalize_text, 'ממ"ד גדול', "ממ״ד גדול", "חד' 3", "חדש", "תל־חי") == [
        "ממד גדול", "ממד גדול", "חדר 3", "חדש", "תל חי"]
    assert value(tx.normalize_text, None) == [""]


def test_street_number(value):
    got = value(tx.street_number, "רחוב התמר 24א", "דרך הים 100", "התמר", "5", "")
    assert [(r.street, r.number) for r in got] == [("רחוב התמר", "24א"), ("דרך הים", "100"), ("התמר", ""), ("", "5"), ("", "")]


def test_buckets(value):
    assert value(tx.area_bucket, 73, 70, None, schema="x int") == ["70", "70", ""]
    assert value(tx.rooms_bucket, 4.3, 3.7, 4.0, 2.25, None, schema="x double") == ["4.5", "3.5", "4.0", "2.0", ""]


def test_city_key(value):
    assert len(set(value(tx.city_key, "תל אביב-יפו", "תל אביב", "תל־אביב יפו"))) == 1
    assert value(tx.city_key, "קרית  גת", "חולון", None) == ["קריית גת", "חולון", ""]


def test_parse_price(value):
    assert value(tx.parse_price, "6,000,000 ₪", "1,670K ₪", "2.5m", "0", "ask", "") == [6000000, 1670000, 2500000, None, None, None]


def test_clean_cell(value):
    assert value(tx.clean_cell, "<b>2,300,000&nbsp;&#x20AA;</b>", "\u200f03/2024\u200e ") == ["2,300,000₪", "03/2024"]


def test_split_addresses(value):
    got = value(tx.split_address_either_order, "רחוב שנהב 7, אריאל", "אריאל, שנהב 7", "אריאל שנהב 7", "שנהב 7", "")
    assert [(r.street, r.house_number, r.city) for r in got] == [
        ("שנהב", "7", "אריאל")] * 4 + [("", "", "אריאל")]
    got = value(tx.split_address_street_first, "דרך הים 4, רובע ב, נופים", "דרך הים", "")
    assert [(r.street, r.house_number, r.neighborhood, r.city) for r in got] == [
        ("דרך הים", "4", "רובע ב", "נופים"), ("דרך הים", "", "", "אריאל"), ("", "", "", "אריאל")]


def test_city_title(value):
    got = value(tx.split_city_title, "תל אביב יפו נוה צדק", "חולון מרכז העיר", "רמת גן", "")
    assert [(r.city, r.neighborhood) for r in got] == [
        ("תל אביב יפו", "נוה צדק"), ("חולון", "מרכז העיר"), ("רמת גן", ""), ("", "")]


def test_merge_address_and_links(value):
    pair = "a string, b string"
    assert value(tx.merge_address, ("הגפן", "7"), ("הגפן 7", "7"), ("", "7"), ("הגפן", None), (None, None), schema=pair) == [
        "הגפן 7", "הגפן 7", "7", "הגפן", ""]
    assert value(lambda c: tx.absolutize(c, "https://b", relative=True), "//i/x", "/x", "x", "http://y") == [
        "https://i/x", "https://b/x", "https://b/x", "http://y"]


def test_title_of(value):
    long = "x" * 161
    assert value(tx.title_of, "\n  \n a  b \nc", long, "", None) == ["a b", "x" * 159 + "…", "", ""]


def test_cells(value):
    assert value(tx.signed_number, 0.72, -0.5, 3.0, 0.0, schema="x double") == ["+0.72", "-0.5", "+3", "0"]
    assert value(lambda c: tx.coerce_cell_back(c, "int"), "1,234", "4.7", "n/a", "") == ["1234", "4", "n/a", None]


def test_hashes(value):
    assert value(tx.canonical_id, "hello") == ["CAN-aaf4c61ddcc5"]


def test_dates(value):
    assert value(dt.iso_date, "2026-04-03T10:00", "2026-02-31", "26-1-1", None) == [dtm.date(2026, 4, 3), None, None, None]
    assert value(dt.day_first_date, " 3/4/2026 ", "31/2/2026", "x") == [dtm.date(2026, 4, 3), None, None]
    assert value(dt.month_year_date, "03/2024", "13/2024", "") == [dtm.date(2024, 3, 1), None, None]
    found = value(lambda c: dt.image_path_date(F.array(F.lit("/logo.png"), c)), "/Pic/202604/03/a.jpg", "/Pic/2026/04/03/a.jpg", "/Pic/209999/99/a.jpg")
    assert found == [dtm.date(2026, 4, 3), dtm.date(2026, 4, 3), None]


def test_window_cutoff_modes(value):
    d = lambda mode: value(lambda c: dt.window_cutoff(c.cast("date"), 18, mode), "2024-08-05")[0]
    assert d("days30") == dtm.date(2023, 2, 1) and d("calendar") == dtm.date(2023, 2, 1)
    assert value(lambda c: dt.window_cutoff(c.cast("date"), 1, "days30"), "2024-03-31") == [dtm.date(2024, 3, 1)]
    assert value(lambda c: dt.window_cutoff(c.cast("date"), 1, "calendar"), "2024-03-31") == [dtm.date(2024, 2, 1)]


def test_numbers(value):
    assert value(num.price_per_area, (100, 8), (100, 0), (0, 5), schema="a bigint, b int") == [12, None, None]
    assert value(lambda c: num.bounded_cast(c, "sqm"), "55.9", "9", "x", None) == [55, None, None, None]
    assert value(lambda c: num.bounded_cast(c, "floor"), "-2.7", "201") == [-2, None]
    km = value(lambda a: num.haversine_km(a, F.lit(34.0), F.lit(32.0), F.lit(34.0)), 33.0, schema="x double")[0]
    assert abs(km - 111.19) < 0.01


def test_units_count(value):
    assert value(
        mn.units_count, "בית עם 3 יחידות דיור", "מחולק ל-4 דירות", "יחידת דיור אחת", "יש יחידת דיור נפרדת ויחידת דיור נוספת",
        "בית ללא יחידת דיור", "2 יחידות דיוריחידות הורים", "דירה נחמדה", "0 יחידות דיור",
    ) == [3, 4, 1, 2, None, None, None, None]
    assert value(mn.units_count_plain, "יחידת דיור אחת", "7 יחידות דיור") == [None, 7]
    assert value(mn.units_count_brief, "2 יחידות דיור", "יחידת דיור", "") == [2, 1, None]


def test_areas(value):
    assert value(mn.garden_area, "גינה 80 מ״ר, חניה", 'חצר 50 מ"ר', "גינה 3 מ\"ר", "דירה") == [80, 50, None, None]
    assert value(mn.lot_area, "מגרש של 450 מ\"ר", "מגרש 12 מ\"ר") == [450, None]
    assert value(mn.lot_area_loose, "מגרש 600", "על קרקע 1200 מטר", "חצי דונם כלומר 500 מטר", "אין") == [600, 1200, 500, None]
    assert value(mn.built_area, "שטח בנוי של 140", "140 מטר בנוי", "דירה 90 מטר גינה", "4 חדרים 110 מ\"ר") == [140, 140, None, 110]


def test_year_built(value):
    year = lambda *texts: value(lambda c: mn.year_built(c, 2026), *texts)
    assert year("שנת בניה 2022", "נבנה בשנת 2018", "בנייה: 2020", "דירה חדשה משנת 2015", "נבנה בשנת 1800") == [2022, 2018, 2020, 2015, None]
    assert year("נכס בן 10", "דירה בת 3 שנים", "בן שנתיים", "בן שנה", "5 שנים ישן", "משופץ") == [2016, 2023, 2024, 2025, 2021, None]


def test_combining_marks_and_search_text(value):
    assert value(lambda c: tx.search_text(c, F.array(F.lit("B"))), "הַגָּן A") == ["הגן a b"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = row[:]
        for j, y in enumerate(b):
            row[j + 1] = previous[j] + 1 if x == y else max(previous[j + 1], row[j])
    return row[-1]


def test_lcs_short_and_long(value):
    pairs = [("kitten", "sitting"), ("", "a"), ("אבגד", "אגד"), ("ab" * 40, "ba" * 45), ("x" * 62, "x" * 61), ("😀a", "a😀")]
    got = value(lambda a, b: sim.lcs_length(a, b), *pairs, schema="a string, b string")
    assert got == [_lcs(a, b) for a, b in pairs]


def test_negation_window_counts_characters_not_code_units(value):
    assert value(mn.units_count, "😀" * 45 + "ללא יחידת דיור", "😀" * 45 + " יחידת דיור") == [None, 1]


def test_character_references(value):
    got = value(tx.unescape_markup, "&#1488;&#x5D1; &eacute; &ndash; &amp;lt; &nosuch; &#0; &#55296; a&b", "plain", None)
    assert got == ["אב é – &lt; &nosuch; � � a&b", "plain", None]


def test_all_named_and_numeric_references(value):
    """Every name of HTML 5, with and without semicolon, and numbers around the special ranges, against the standard library."""
    import html
    from html.entities import html5

    rows = [f"&{name}{tail}" for i, name in enumerate(html5) for tail in [("", ";", "foo;", "1")[i % 4]]]
    numbers = [*range(300), 0xD7FF, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 10**24]
    rows += [f"&#{n}{(';', '', 'g')[n % 3]}" for n in numbers] + [f"&#x{n:x};" for n in numbers]
    rows += ["&", "&&amp", "&notit;", "&#;", "&#x;", "&#X41", "&#000065;", "a&ampb &lt &gt;"]
    assert value(tx.unescape_markup, *rows) == [html.unescape(r) for r in rows]


def test_agency_feed_reads_plots_alone(value):
    texts = ['מגרש 600', 'פינתי 700 מטר', 'חצי דונם כלומר 500 מטר', 'המגרש מ"ר 450', None]
    assert value(lambda c: mn.lot_area_loose(c, mn.LOT_AGENCY), *texts) == [600, None, None, 450, None]
    assert value(mn.lot_area_loose, *texts) == [600, 700, 500, 450, None]


def test_standalone_word_is_quoted(value):
    assert value(lambda c: tx.standalone_word(c, "a+b"), "x a+b c", "aab", "א a+b") == [True, False, True]


def test_topic_patterns_know_letters_of_all_scripts(value):
    from hearthline.operators.filters import Topic, match_topics

    topics = [Topic("desk", [r"שולח\w+"])]
    assert value(lambda c: match_topics(c, topics), "שולחנות", "שולח ישן") == [["desk"], []]
