"""Date functions; the reference time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline.functions.text import group_of


def iso_date(c: Column) -> Column:
    """DATE of the first ten characters, NULL when they are no calendar date."""
    head = F.left(c, F.lit(10))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def day_first_date(c: Column, anywhere: bool = False) -> Column:
    """DATE of 'd/M/yyyy', optionally found inside a longer text."""
    pattern = r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
    pattern = pattern if anywhere else r"^\s*" + pattern + r"\s*$"
    return F.try_to_date(group_of(c, pattern), "d/M/yyyy")


def month_year_date(c: Column) -> Column:
    """First day of 'MM/yyyy', NULL otherwise."""
    return F.try_to_date(F.concat(F.lit("01/"), group_of(c, r"^\s*([0-9]{1,2}/[0-9]{4})\s*$")), "dd/M/yyyy")


def earliest(*columns: Column) -> Column:
    """Earliest valid date of ISO texts or dates."""
    dates = [iso_date(c.cast("string")) for c in columns]
    return F.least(*dates) if len(dates) > 1 else dates[0]


def utc_timestamp(c: Column) -> Column:
    """ISO timestamp with 'T'; without an offset it counts as UTC (session zone)."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(c))


def date_slice(c: Column) -> Column:
    return F.when(F.length(c) >= 10, F.left(c, F.lit(10)))


def image_path_date(images: Column, look_at: int = 5) -> Column:
    """Date in an image path, '/Pic/yyyymm/dd/' or '/Pic/yyyy/mm/dd/', of the first images."""
    def one(url):
        compact = F.regexp_extract(url, r"/Pic/([0-9]{6}/[0-9]{2})/", 1)
        wide = F.regexp_extract(url, r"/Pic/([0-9]{4}/[0-9]{2}/[0-9]{2})/", 1)
        return F.when(F.contains(url, F.lit("/Pic/")), F.coalesce(F.try_to_date(compact, "yyyyMM/dd"), F.try_to_date(wide, "yyyy/MM/dd")))
    found = F.array_compact(F.transform(F.slice(images, 1, look_at), one))
    return F.get(found, F.lit(0))


def published_and_first(created: Column, bumped: Column) -> tuple[Column, Column]:
    """(latest, earliest) of two possibly missing instants."""
    return F.greatest(created, bumped), F.least(created, bumped)


def age_days(first_listed: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.date_diff(as_of, first_listed))


def window_cutoff(as_of: Column, months: int, month_mode: str = "days30") -> Column:
    """First day of the month that lies ``months`` back; a month is 30 days or a calendar month."""
    if month_mode == "days30":
        back = F.date_sub(as_of, 30 * months)
    elif month_mode == "calendar":
        back = F.add_months(as_of, -months)
    else:
        raise ValueError(f"unknown month mode {month_mode!r}")
    return F.trunc(back, "month")


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def building_age(year_built: Column, as_of: Column) -> Column:
    return F.when(year_built != 0, F.year(as_of) - year_built)
