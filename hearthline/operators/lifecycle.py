"""Tracker rows: freshness, user-edit merge, change log, order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import lexicons as lx
from hearthline.functions.dates import age_days
from hearthline.functions.numeric import effective_values
from hearthline.functions.text import cell_norm, cell_number, coerce_cell_back, merge_address, one_line
from hearthline.operators.ordered import write_ordered
from hearthline.operators.windows import first_per_key
from hearthline.schema import LISTING_KEY

# tracked columns and the type a user's cell text is read back as
TRACKED = {
    name: {"score": "double", "rooms_eff": "double", "price": "bigint", "price_before": "bigint"}.get(
        name, "int" if name.endswith("_eff") or name == "floor" else "string"
    )
    for name in lx.TRACKED_COLUMNS
}

CHANGE = "struct<col:string,old:string,new:string>"
ENTRY = f"struct<ts:date,changes:array<{CHANGE}>,disappeared:boolean,reappeared:boolean>"
LOG = f"array<{ENTRY}>"


def tracker_data(listings: DataFrame, as_of: Column) -> DataFrame:
    """Display columns of a listing before cells are merged."""
    c = F.col
    return listings.withColumns({
        **{k: v for k, v in effective_values().items() if k != "sqm_eff"},
        "sale_type": F.when(F.coalesce(c("is_agent"), F.lit(False)), "Agent").otherwise("Direct"),
        "address": merge_address(c("street"), c("house_number")),
        "age_days": age_days(c("first_listed_date"), as_of),
        "description": one_line(c("description")),
        "comments": F.lit(""),
    })


def as_cell(c: Column, kind: str) -> Column:
    return cell_number(c) if kind == "double" else c.cast("string")


def with_freshness(
    rows: DataFrame, scans: DataFrame, now: Column, cutoff_minutes: int, grace_minutes: int = 15
) -> DataFrame:
    """A row is active when seen in the latest successful scan of its source; sources
    without a scan fall back to a fixed cutoff. ``scans``: source, latest_scan."""
    seen = F.col("last_seen_at")
    grace = F.make_dt_interval(mins=F.lit(grace_minutes))
    cutoff = F.make_dt_interval(mins=F.lit(cutoff_minutes))
    return rows.join(scans, "source", "left").withColumn(
        "active",
        F.coalesce(
            F.when(F.col("latest_scan").isNotNull(), seen >= F.col("latest_scan") - grace)
            .otherwise(seen >= now - cutoff),
            F.lit(False),
        ),
    )


def prior_rows(main: DataFrame, archive: DataFrame) -> DataFrame:
    """The archive's row of a key, else the main table's."""
    both = archive.withColumn("_p", F.lit(0)).unionByName(main.withColumn("_p", F.lit(1)))
    return first_per_key(both, list(LISTING_KEY), [F.asc("_p")]).drop("_p")


def merge_cell(fresh: Column, prior: Column, shadow: Column, kind: str) -> Column:
    """A cell that differs from what was last written is the user's and wins, unless it is an
    error text. A column without a shadow takes the fresh value."""
    edited = (cell_norm(prior) != cell_norm(shadow)) & ~F.coalesce(prior, F.lit("")).isin(lx.CELL_ERRORS)
    return F.when(edited, coerce_cell_back(prior, kind)).otherwise(as_cell(fresh, kind))


def diff_cells(old: Mapping[str, Column], new: Mapping[str, Column]) -> Column:
    """Changed columns as an array, in column order."""
    changes = [
        F.when(
            cell_norm(old[n]) != cell_norm(new[n]),
            F.struct(F.lit(n).alias("col"), old[n].alias("old"), new[n].alias("new")),
        )
        for n in new
    ]
    return F.array_compact(F.array(*changes)).cast(f"array<{CHANGE}>")


def typed_diff(prior: Mapping[str, Column], fresh: Mapping[str, Column], kinds: Mapping[str, str]) -> Column:
    """Like ``diff_cells``; old numbers are shown in numeric form."""
    out = []
    for n, value in fresh.items():
        new = F.coalesce(as_cell(value, kinds[n]), F.lit(""))
        old = F.trim(F.coalesce(prior[n], F.lit("")))
        shown = F.when(
            old.contains("."), F.coalesce(old.try_cast("double").cast("string"), old)
        ).otherwise(F.coalesce(old.try_cast("bigint").cast("string"), old))
        out.append(F.when(old != F.trim(new), F.struct(
            F.lit(n).alias("col"), F.when(old != "", shown).alias("old"), as_cell(value, kinds[n]).alias("new")
        )))
    return F.array_compact(F.array(*out)).cast(f"array<{CHANGE}>")


def trim_log(log: Column, cap: int) -> Column:
    """Newest ``cap`` entries; 0 keeps all."""
    return F.slice(log, 1, cap) if cap > 0 else log


def build_tracker(
    rows: DataFrame, prior: DataFrame, today: Column, *, audit_max: int = 20,
    tracked: Mapping[str, str] | None = None,
) -> DataFrame:
    """Merge the user's cells, log what changed, stamp disappearances.

    ``rows`` come from ``with_freshness``. ``prior``: key, ``cell_<col>`` texts, ``shadow`` struct of
    texts (NULL before the first sync), ``change_log``, ``disappeared_on``, ``last_changed``.
    """
    tracked = dict(tracked or TRACKED)
    c = F.col
    named = prior.select(
        *LISTING_KEY, *[c(f"cell_{n}") for n in tracked],
        c("shadow").alias("_shadow"), c("change_log").cast(LOG).alias("_log"),
        c("disappeared_on").alias("_gone"), c("last_changed").alias("_changed"), F.lit(True).alias("_known"),
    )
    base = rows.filter((F.coalesce("source", F.lit("")) != "") & (F.coalesce("source_id", F.lit("")) != ""))
    joined = base.join(named, list(LISTING_KEY), "left")
    shadowed = c("_shadow").isNotNull()
    merged = joined.withColumns({
        f"m_{n}": F.when(shadowed, merge_cell(c(n), c(f"cell_{n}"), c("_shadow")[n], kind)).otherwise(as_cell(c(n), kind))
        for n, kind in tracked.items()
    })
    diff = diff_cells({n: c("_shadow")[n] for n in tracked}, {n: c(f"m_{n}") for n in tracked})
    # a known row without a shadow is being migrated: nothing to compare with
    merged = merged.withColumn(
        "diff", F.when(c("_known").isNull() | shadowed, diff).otherwise(F.array().cast(f"array<{CHANGE}>"))
    )
    entry = lambda changes, gone, back: F.struct(
        today.alias("ts"), changes.alias("changes"), F.lit(gone).alias("disappeared"), F.lit(back).alias("reappeared")
    ).cast(ENTRY)
    none = F.lit(None)
    came_back = c("active") & c("_gone").isNotNull()
    vanished = ~c("active") & c("_gone").isNull()
    fresh_entries = F.array_compact(F.array(
        F.when(F.size("diff") > 0, entry(c("diff"), None, None)),
        F.when(came_back, entry(none, None, True)).when(vanished, entry(none, True, None)),
    ))
    log = F.concat(fresh_entries, F.coalesce("_log", F.array().cast(LOG)))
    return merged.withColumns({
        "change_log": trim_log(log, audit_max),
        "disappeared_on": F.when(came_back, F.lit(None).cast("date")).when(vanished, today).otherwise(c("_gone")),
        "last_changed": F.when(F.size("diff") > 0, today).otherwise(
            F.coalesce("_changed", F.when(c("_known").isNull(), today))
        ),
        "shadow": F.struct(*[c(f"m_{n}").alias(n) for n in tracked]),
    }).drop("_shadow", "_log", "_gone", "_changed", "_known", *[f"cell_{n}" for n in tracked])


def tracker_order() -> list[Column]:
    """Active rows by date then score, gone rows by the day they went."""
    gone = F.col("disappeared_on").isNotNull()
    return [
        F.asc(gone.cast("int")),
        F.desc_nulls_last(F.when(gone, F.col("disappeared_on")).otherwise(F.col("first_listed_date"))),
        F.desc_nulls_last(F.when(~gone, F.coalesce(F.col("m_score").try_cast("double"), F.lit(0.0)))),
    ]


def split_archive(df: DataFrame, archive_cities: Sequence[str]) -> DataFrame:
    """H2: mark archive rows; a row without a city belongs to the main table."""
    return df.withColumn("is_archive", F.coalesce(F.col("city").isin(list(archive_cities)), F.lit(False)))


def write_tracker(
    df: DataFrame, path: str, archive_cities: Sequence[str], order: Sequence[Column | str] | None = None
) -> None:
    """One folder for the main table, one for the archive, rows in display order; ``read_positions`` numbers them."""
    rows = [*tracker_order(), *LISTING_KEY] if order is None else order
    write_ordered(split_archive(df, archive_cities), path, rows, ["is_archive"])
