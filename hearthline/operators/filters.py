"""Predicates and ordered reject reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.text import city_key, contains_all, literal_array


@dataclass(frozen=True)
class SearchConfig:
    rooms_min: float = 2.5
    rooms_max: float = 5.0
    price_min: int = 1_500_000
    price_max: int = 10_000_000
    min_sqm: int = 55
    max_listing_age_days: int = 30
    exclude_ground_floor: bool = False
    property_types: Sequence[str] = field(default_factory=list)


def null_or(c: Column, test: Column) -> Column:
    return c.isNull() | test


def search_filter(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Keep rows in range; an unknown value passes, a zero minimum is off."""
    c = F.col
    keep = null_or(c("rooms"), c("rooms").between(cfg.rooms_min, cfg.rooms_max))
    keep = keep & null_or(c("price"), c("price").between(cfg.price_min, cfg.price_max))
    if cfg.min_sqm:
        keep = keep & null_or(c("sqm"), c("sqm") >= cfg.min_sqm)
    return df.filter(keep)


Rule = tuple[str, Column]


def reject_reason(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that holds, NULL when the row passes. Order matters."""
    out = F.when(rules[0][1], rules[0][0])
    for name, failed in rules[1:]:
        out = out.when(failed, name)
    return out


def rule_set(cfg: SearchConfig, as_of: Column, order: Sequence[str], **columns: Column) -> list[Rule]:
    """The rules of one source in its own order, picked from the shared rules."""
    c = lambda name: columns.get(name, F.col(name))
    size = columns.get("size", F.coalesce(F.nullif(c("sqm_build"), F.lit(0)), c("sqm")) if "sqm_build" in columns else c("sqm"))
    shared = {
        "no_token": F.coalesce(c("source_id"), F.lit("")) == "",
        "bad_price": F.coalesce(c("price") <= 0, F.lit(True)),
        "price_out_of_range": F.coalesce(
            ~c("price").between(cfg.price_min, cfg.price_max), F.lit(True)
        ),
        "rooms_out_of_range": F.coalesce(~c("rooms").between(cfg.rooms_min, cfg.rooms_max), F.lit(False)),
        "sqm_too_small": F.coalesce((size != 0) & (size < cfg.min_sqm), F.lit(False))
        if cfg.min_sqm else F.lit(False),
        "ground_floor": F.coalesce(c("floor") == 0, F.lit(False))
        if cfg.exclude_ground_floor else F.lit(False),
        "property_type_filtered": ~F.coalesce(c("listing_type"), F.lit("")).isin(list(cfg.property_types))
        if cfg.property_types else F.lit(False),
    }
    if "city_allowed" in columns:
        shared["city_not_allowed"] = ~columns["city_allowed"]
    if "expected_city" in columns:
        shared["city_mismatch"] = F.coalesce(c("city"), F.lit("")) != columns["expected_city"]
    if "publish_date" in columns:
        shared["too_old"] = F.coalesce(
            columns["publish_date"] < F.date_sub(as_of, cfg.max_listing_age_days), F.lit(False)
        )
    extra = {name[5:]: test for name, test in columns.items() if name.startswith("rule_")}
    shared.update(extra)
    return [(name, shared[name]) for name in order]


# fixed values: order of the checks per feed family
FEED_RULES = {
    "nested": ["no_token", "rooms_out_of_range", "property_type_filtered", "ground_floor",
               "price_out_of_range", "city_mismatch", "sqm_too_small", "too_old"],
    "bilingual": ["not_buy", "not_ils", "not_property", "no_source_id", "bad_price",
                  "price_out_of_range", "rooms_out_of_range", "sqm_too_small", "ground_floor",
                  "city_not_allowed", "too_old"],
    "agency": ["not_for_sale", "no_id", "bad_price", "price_out_of_range", "rooms_out_of_range",
               "sqm_too_small"],
    "cards": ["city_not_allowed", "price_out_of_range", "rooms_out_of_range", "sqm_too_small",
              "ground_floor"],
    "catalog": ["no_price", "price_out_of_range", "rooms_out_of_range", "sqm_too_small",
                "city_not_allowed"],
}


def reject_histogram(df: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """AG6: rejected rows per source and reason, most frequent first."""
    return (
        df.filter(F.col("reject_reason").isNotNull())
        .groupBy(*keys, "reject_reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), *keys, "reject_reason")
    )


def city_allowed(c: Column, names: Sequence[str], groups=None) -> Column:
    """C3 as a predicate on the spelling-independent key."""
    keys = F.transform(literal_array(names), lambda n: city_key(n, groups))
    return F.array_contains(keys, city_key(c, groups))


def allow_cities(df: DataFrame, names: Sequence[str], column: str = "city", groups=None) -> DataFrame:
    """Left-semi join against the configured cities (a short configuration list)."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "name string").select(
        city_key(F.col("name"), groups).alias("_key")
    ).distinct()
    return (
        df.withColumn("_key", city_key(F.col(column), groups))
        .join(F.broadcast(wanted), "_key", "left_semi")
        .drop("_key")
    )


def low_floor(c: Column | None = None, top: int = 2) -> Column:
    c = F.col("floor") if c is None else c
    return null_or(c, c <= top)


def kind_gate(search_option: Column, currency: Column, entity: Column) -> Column:
    """For sale, in the local currency, a property."""
    return (
        (search_option == "buy")
        & (F.coalesce(F.nullif(currency, F.lit("")), F.lit("ILS")) == "ILS")
        & null_or(entity, entity == "property")
    )


def title_has_all(title: Column, tokens: Sequence[str]) -> Column:
    """No tokens required means every title passes."""
    return contains_all(title, literal_array(tokens)) if tokens else F.lit(True)


@dataclass(frozen=True)
class Topic:
    label: str
    patterns: Sequence[str]


def match_topics(text: Column, topics: Sequence[Topic]) -> Column:
    """C11: labels of the topics with a matching pattern, in topic order."""
    labels = []
    for topic in topics:
        hit = F.lit(False)
        for pattern in topic.patterns:
            hit = hit | text.rlike("(?iU)" + pattern)
        labels.append(F.when(hit, topic.label))
    return F.array_compact(F.array(*labels))


def has_identity(source: Column, source_id: Column) -> Column:
    return (F.coalesce(source, F.lit("")) != "") & (F.coalesce(source_id, F.lit("")) != "")


def any_null(columns: Sequence[str]) -> Column:
    """C14: at least one of the columns still has to be filled."""
    out = F.lit(False)
    for name in columns:
        out = out | F.col(name).isNull()
    return out


def young_enough(publish: Column, as_of: Column, days: int) -> Column:
    return null_or(publish, publish >= F.date_sub(as_of, days))
