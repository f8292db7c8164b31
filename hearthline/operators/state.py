"""Keyed state without MERGE: every write yields a new snapshot DataFrame.

Snapshots are plain DataFrames; ``save_snapshot`` writes one to a bucketed table so that the next
upsert reads the state without an exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.dates import earliest
from hearthline.functions.text import address_hash
from hearthline.operators.windows import first_per_key
from hearthline.schema import COMP_KEY, HISTORY_KEY, LISTING_KEY, USER_OWNED


def upsert(
    state: DataFrame, batch: DataFrame, now: Column, *, keys: Sequence[str] = LISTING_KEY,
    owned: Sequence[str] = USER_OWNED, value: str = "price", keep_canonical: bool = True,
    canonical_inputs: Sequence[str] = (),
) -> DataFrame:
    """Full outer merge of one batch (unique keys) into the state.

    Scraped columns come from the batch, user-owned columns and ``first_seen_at`` from the state.
    The result carries ``change`` (new, updated, kept) and ``prev_price`` where the price changed.
    ``canonical_id`` survives a rescan unless one of ``canonical_inputs`` changed.
    """
    tag = lambda df, side: df.select(F.struct(*df.columns).alias(side), *[F.col(k) for k in keys])
    merged = tag(state, "s").join(tag(batch, "b"), list(keys), "full_outer")
    seen, known = F.col("b").isNotNull(), F.col("s").isNotNull()
    s, b = lambda n: F.col("s")[n], lambda n: F.col("b")[n]
    fields: dict[str, Column] = {}
    for name in dict.fromkeys([*state.columns, *batch.columns]):
        in_state, in_batch = name in state.columns, name in batch.columns
        if name in keys:
            fields[name] = F.col(name)
        elif name == "first_seen_at":
            fields[name] = F.coalesce(s(name), now) if in_state else now
        elif name == "last_seen_at":
            fields[name] = F.when(seen, now).otherwise(s(name)) if in_state else F.when(seen, now)
        elif name in owned and in_state:
            fields[name] = F.when(known, s(name)).otherwise(b(name) if in_batch else F.lit(None))
        elif name == "canonical_id" and in_state and keep_canonical:
            same = F.lit(True)
            for column in canonical_inputs:
                same = same & s(column).eqNullSafe(b(column))
            kept = F.when(same, s(name))
            fields[name] = F.when(
                known & seen, F.coalesce(b(name), kept) if in_batch else kept
            ).otherwise(F.coalesce(s(name), b(name)) if in_batch else s(name))
        elif in_state and in_batch:
            fields[name] = F.when(seen, b(name)).otherwise(s(name))
        else:
            fields[name] = s(name) if in_state else b(name)
    if "first_listed_date" in fields:
        dates = [side(d) for side, cols in ((b, batch.columns), (s, state.columns))
                 for d in ("first_listed_date", "publish_date") if d in cols]
        fields["first_listed_date"] = F.when(seen, earliest(*dates)).otherwise(
            s("first_listed_date") if "first_listed_date" in state.columns else F.lit(None)
        )
    fields["change"] = F.when(seen & known, "updated").when(seen, "new").otherwise("kept")
    fields["prev_price"] = F.when(
        seen & known & (s(value) != 0) & (s(value) != b(value)), s(value)
    )
    return merged.select(*[c.alias(n) for n, c in fields.items()])


def snapshot_of(merged: DataFrame) -> DataFrame:
    return merged.drop("change", "prev_price")


def save_snapshot(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = LISTING_KEY) -> None:
    """Bucketed by key: later joins on the key need no exchange on this side."""
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys)
     .sortBy(*keys).format("parquet").saveAsTable(table))


def history_rows(batch: DataFrame, now: Column | None = None) -> DataFrame:
    """One price row per sighting."""
    ts = now if now is not None else F.col("ts")
    return batch.select("source", "source_id", ts.alias("ts"), "price")


def append_history(history: DataFrame, rows: DataFrame, tie: Sequence[Column] = ()) -> DataFrame:
    """Union that keeps the stored row of a repeated (key, ts); within a batch the first by ``tie``."""
    both = history.withColumn("_new", F.lit(0)).unionByName(
        rows.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, list(HISTORY_KEY), [F.asc("_new"), *(tie or [F.asc("price")])]).drop("_new")


def comp_rows(comps: DataFrame, provider: str, fetched_at: Column) -> DataFrame:
    """Projection with the 16-digit address hash."""
    c = F.col
    return comps.withColumns({
        "provider": F.lit(provider),
        "address_hash": address_hash(c("city"), c("neighborhood"), c("street"), c("house_number")),
        "fetched_at": fetched_at,
    })


def valid_comp() -> Column:
    """Rows without a key part cannot be stored."""
    test = F.lit(True)
    for name in COMP_KEY:
        test = test & F.col(name).isNotNull()
    return test


def upsert_comps(
    state: DataFrame, batch: DataFrame, tie: Sequence[Column] = ()
) -> tuple[DataFrame, DataFrame]:
    """(new state, rejected rows). The latest fetch of a key wins."""
    good = batch.filter(valid_comp())
    both = state.unionByName(good, allowMissingColumns=True)
    return (
        first_per_key(both, list(COMP_KEY), [F.desc("fetched_at"), *tie]),
        batch.filter(~valid_comp()),
    )


def mark(state: DataFrame, keys_df: DataFrame, column: str, value: Column, keys: Sequence[str] = LISTING_KEY) -> DataFrame:
    """Set a column on the listed keys."""
    flagged = keys_df.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (
        state.join(flagged, list(keys), "left")
        .withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
        .drop("_hit")
    )


def apply_user_edits(
    state: DataFrame, edits: DataFrame, columns: Sequence[str] = USER_OWNED,
    keys: Sequence[str] = LISTING_KEY, notes_limit: int = 2000,
) -> DataFrame:
    """``edits`` has unique keys, a ``set_mask`` of column names and their values.

    A masked NULL clears an override; an unmasked column stays. ``matched`` tells which rows had
    an edit.
    """
    named = edits.select(
        *keys, "set_mask", *[F.col(n).alias(f"_e_{n}") for n in columns if n in edits.columns]
    )
    joined = state.join(named, list(keys), "left")
    for name in columns:
        if name not in edits.columns:
            continue
        value = F.col(f"_e_{name}")
        if name == "user_notes":
            value = F.left(value, F.lit(notes_limit))
        hit = F.array_contains("set_mask", name)
        if name in ("is_favorite", "user_notes"):  # never NULL, so NULL means "leave"
            hit = hit & value.isNotNull()
        joined = joined.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return joined.withColumn("matched", F.coalesce(F.size("set_mask") > 0, F.lit(False))).drop(
        "set_mask", *[f"_e_{n}" for n in columns]
    )


def delete_keys(tables: Mapping[str, DataFrame], doomed: DataFrame, keys: Sequence[str] = LISTING_KEY) -> dict[str, DataFrame]:
    """Remove the keys from every table."""
    gone = doomed.select(*keys).distinct()
    return {name: df.join(gone, list(keys), "left_anti") for name, df in tables.items()}


def expired(cutoff: Column) -> Column:
    """First seen before the cutoff and not published since."""
    return (F.col("first_seen_at") < cutoff) & (
        F.col("publish_date").isNull() | (F.col("publish_date") < cutoff.cast("date"))
    )


def purge(state: DataFrame, cutoff: Column, history: DataFrame | None = None) -> dict[str, DataFrame]:
    """Retained rows; with ``history`` given, the price rows of purged listings go too."""
    gone = F.coalesce(expired(cutoff), F.lit(False))
    out = {"listings": state.filter(~gone)}
    if history is not None:
        out["price_history"] = history.join(
            state.filter(gone).select(*LISTING_KEY), list(LISTING_KEY), "left_anti"
        )
    return out


def reset(tables: Mapping[str, DataFrame], source: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """B13/AG11: (remaining tables, deleted rows per table), for one source or for all.

    One pass per table: the counts are aggregates, nothing is brought to the driver.
    """
    kept, counts = {}, None
    for name, df in tables.items():
        if source is not None and "source" not in df.columns:
            kept[name] = df
            continue
        hit = F.lit(True) if source is None else F.coalesce(F.col("source") == source, F.lit(False))
        kept[name] = df.filter(~hit)
        n = df.filter(hit).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def assign_ids(state: DataFrame, assignments: DataFrame, keys: Sequence[str] = LISTING_KEY) -> DataFrame:
    """Set canonical_id on the assigned rows."""
    named = assignments.select(*keys, F.col("canonical_id").alias("_id"))
    return (
        state.join(named, list(keys), "left")
        .withColumn("canonical_id", F.coalesce(F.col("_id"), F.col("canonical_id")))
        .drop("_id")
    )


def touch_free_items(state: DataFrame, batch: DataFrame, now: Column, seed_only: bool = False) -> DataFrame:
    """New items enter (as alerted when seeding); known ones only get last seen and label."""
    keys = list(LISTING_KEY)
    tag = lambda df, side: df.select(F.struct(*df.columns).alias(side), *keys)
    merged = tag(state, "s").join(tag(batch, "b"), keys, "full_outer")
    s, b = F.col("s"), F.col("b")
    known, seen = s.isNotNull(), b.isNotNull()
    fields = {}
    for name in state.columns:
        if name in keys:
            fields[name] = F.col(name)
        elif name == "first_seen_at":
            fields[name] = F.coalesce(s[name], now)
        elif name == "last_seen_at":
            fields[name] = F.when(seen, now).otherwise(s[name])
        elif name == "watch_label":
            fields[name] = F.when(seen, b[name]).otherwise(s[name])
        elif name == "alerted_at":
            fields[name] = F.when(known, s[name]).otherwise(now if seed_only else F.lit(None))
        else:
            fields[name] = F.when(known, s[name]).otherwise(
                b[name] if name in batch.columns else F.lit(None)
            )
    fields["is_new"] = ~known
    return merged.select(*[c.alias(n) for n, c in fields.items()])


def carry_over(fresh: DataFrame, prior: DataFrame, columns: Sequence[str], keys: Sequence[str] = LISTING_KEY) -> DataFrame:
    """Where the description is unchanged, NULL columns take the prior value."""
    old = prior.select(
        *keys, F.col("description").alias("_description"), *[F.col(n).alias(f"_p_{n}") for n in columns]
    )
    joined = fresh.join(old, list(keys), "left")
    same = F.coalesce(F.col("_description"), F.lit("")) == F.coalesce(F.col("description"), F.lit(""))
    applied = F.lit(False)
    for name in columns:
        applied = applied | (F.col(name).isNull() & F.col(f"_p_{name}").isNotNull())
    joined = joined.withColumn("cache_hit", F.coalesce(same & applied, F.lit(False)))
    for name in columns:
        joined = joined.withColumn(
            name, F.coalesce(F.col(name), F.when(same, F.col(f"_p_{name}")))
        )
    return joined.drop("_description", *[f"_p_{n}" for n in columns])
