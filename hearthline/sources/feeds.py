"""The built-in feeds: parser, detail parser, detail merge rules and reject order per source."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, functions as F

from hearthline.operators.filters import FEED_RULES
from hearthline.sources import detail_pages as dp, html, json_feeds as jf
from hearthline.sources.details import DETAIL_RULES
from hearthline.sources.registry import DealSpec, FeedSpec, register_deals, register_feed


def merge_rules(**changes: str) -> dict[str, str]:
    return {**DETAIL_RULES, **changes}


def builtin_feeds(as_of_year: int, base: str = "https://board.example") -> dict[str, FeedSpec]:
    """Specs of the eight feed families; ``base`` completes relative links."""
    year = {"as_of_year": as_of_year}
    nested = lambda raw: jf.normalize_nested(jf.flatten_sections(raw), as_of_year)
    card = lambda parse, name: partial(parse, source=name, base=base)
    return {spec.name: spec for spec in (
        FeedSpec("nested", nested, partial(dp.nested_details, **year), FEED_RULES["nested"],
                 detail_rules=merge_rules(description="overwrite", first_listed_date="overwrite")),
        FeedSpec("bilingual", jf.parse_bilingual, None, FEED_RULES["bilingual"]),
        FeedSpec("agency", partial(jf.parse_agency, **year), partial(dp.agency_details, **year), FEED_RULES["agency"],
                 always_enrich=True, detail_rules=merge_rules(sqm="overwrite")),
        FeedSpec("icon_cards", card(html.icon_cards, "icon_cards"), partial(dp.icon_details, **year), FEED_RULES["cards"],
                 detail_rules=merge_rules(floor="overwrite", description="overwrite")),
        FeedSpec("table_cards", card(html.table_cards, "table_cards"), partial(dp.text_details, **year), FEED_RULES["cards"],
                 always_enrich=True, detail_rules=merge_rules(description="fill_blank")),
        FeedSpec("catalog_cards", card(html.catalog_cards, "catalog_cards"), partial(dp.catalog_details, **year), FEED_RULES["catalog"],
                 always_enrich=True, detail_rules=merge_rules(description="overwrite", lot_sqm="overwrite", floor="overwrite")),
        FeedSpec("amenity_cards", card(html.amenity_cards, "amenity_cards"), partial(dp.labelled_details, **year), FEED_RULES["catalog"],
                 always_enrich=True, detail_rules=merge_rules(
                     sqm="overwrite", sqm_build="overwrite", garden_sqm="overwrite", units_count="overwrite")),
        FeedSpec("article_cards", card(html.article_cards, "article_cards"), partial(dp.article_details, **year), FEED_RULES["catalog"],
                 always_enrich=True, detail_rules=merge_rules(description="overwrite")),
    )}


def builtin_deals(as_of: Column) -> dict[str, DealSpec]:
    """Providers of closed deals; pages carry their own city and neighbourhood."""
    return {spec.name: spec for spec in (
        DealSpec("deals_table", lambda pages: html.deals_table(pages, F.col("city"), F.col("neighborhood"))),
        DealSpec("trends", lambda raw: jf.trends_to_comps(raw, as_of)),
    )}


def register_builtin(as_of_year: int, base: str = "https://board.example", as_of: Column | None = None) -> None:
    for spec in builtin_feeds(as_of_year, base).values():
        register_feed(spec)
    for spec in builtin_deals(F.current_date() if as_of is None else as_of).values():
        register_deals(spec)
