"""Facts mined from free text (E-T*). Patterns come as lexicon entries, so any language works."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from hearthline import lexicons as lx
from hearthline.functions.text import any_of, group_of, let, number_of

# fixed value: the spellings of square metres end in this
METRE = "מ[״\"'׳]?\\s*ר"


@dataclass(frozen=True)
class UnitLexicon:
    """How a text states its number of housing units."""

    # fixed values: patterns of the number of housing units
    counts: tuple[str, ...] = (
        "(?:מחולק[ת]?\\s*(?:ל[-\\s]*)?)?([0-9]{1,3})[\\s\\u200e\\u200f]*(?:יחידות|יחידת)"
        "[\\s\\u200e\\u200f]*(?:דיור|מניבות?)",
        "מחולק[ת]?\\s*(?:ל[-\\s]*)?([0-9]{1,3})[\\s\\u200e\\u200f]*(?:יחידות|דירות)",
    )
    veto: str | None = (
        "יחידות?\\s*(?:הורים?|אורחים?|מתבגרים?|יחידת\\s*הורים?|שינה|רחצה|מיזוג|מזגנים?)"
    )
    mention: str = "(?:^|[\\s\\u200e\\u200f])ו?יחידת\\s+דיור"
    separators: tuple[str, ...] = tuple(lx.UNIT_SEPARATORS)
    negation: str | None = "(?U)(?:ללא|אין|אינו|איננו|לא\\s+(?:כולל|מכיל|יש|קיים|נכלל))\\b"
    veto_before: int = 10
    negation_window: int = 40


HEBREW_UNITS = UnitLexicon()


def _start(c: Column, pattern: str) -> Column:
    """0-based start of the first match in code points, as substr and length count, NULL without one."""
    return F.when(c.rlike(pattern), F.length(F.regexp_extract(c, f"^((?s:.*?))(?:{pattern})", 1)))


def _positive(c: Column) -> Column:
    """The number when it is positive, else NULL."""
    return F.nullif(F.greatest(c, F.lit(0)), F.lit(0))


def units_count(c: Column, lexicon: UnitLexicon = HEBREW_UNITS) -> Column:
    """E-T1: a stated count, else repeated mentions with a separating word, else one plain mention."""
    def accepted(pattern: str) -> Column:
        value = _positive(number_of(c, pattern))
        if not lexicon.veto:
            return value
        begin, veto = _start(c, pattern), _start(c, lexicon.veto)
        stop = begin + F.length(F.regexp_extract(c, pattern, 0))
        near = veto.isNotNull() & veto.between(begin - lexicon.veto_before, stop)
        return let(value, lambda v: F.when(v.isNotNull() & ~near, v))

    stated = F.coalesce(*[accepted(p) for p in lexicon.counts])
    mentions = F.regexp_count(c, F.lit(lexicon.mention))
    repeated = (mentions >= 2) & any_of(c, lexicon.separators)
    single = mentions == 1
    if lexicon.negation:
        begin = _start(c, lexicon.mention)
        left = F.greatest(begin - lexicon.negation_window, F.lit(0))
        before = F.substr(c, left + 1, begin - left)
        single = single & ~F.coalesce(before.rlike(lexicon.negation), F.lit(False))
    return F.coalesce(stated, F.when(repeated, mentions).when(single, 1)).cast("int")


def units_count_plain(c: Column, lexicon: UnitLexicon = HEBREW_UNITS) -> Column:
    """E-T2, scoring variant: no veto, a single mention says nothing."""
    stated = [_positive(number_of(c, p)) for p in lexicon.counts]
    mentions = F.regexp_count(c, F.lit(lexicon.mention))
    several = F.nullif(F.greatest(mentions, F.lit(1)), F.lit(1))
    return F.coalesce(*stated, F.when(any_of(c, lexicon.separators), several)).cast("int")


# fixed values: count before the unit words, and a bare mention
UNITS_BRIEF = ("([0-9]+)\\s*יחידות\\s*דיור", "(?U)\\bיחידת\\s*דיור\\b")


def units_count_brief(c: Column, patterns: tuple[str, str] = UNITS_BRIEF) -> Column:
    """E-T2, agency variant: the number before the unit words, or one for a bare mention."""
    count, bare = patterns
    return F.coalesce(number_of(c, count), F.when(c.rlike(bare), 1))


def bounded_number(
    c: Column, patterns: tuple[str, ...], lo: int, hi: int, groups: int = 1, tail: str | None = None
) -> Column:
    """The first pattern that matches gives the number; NULL outside [lo, hi].

    ``tail`` is the form of the number when it is the last one of the match: then each pattern runs
    once, whatever its number of groups.
    """
    if tail:
        hits = [group_of(F.regexp_extract(c, p, 0), f"({tail})[^0-9]*$") for p in patterns]
    else:
        hits = [group_of(c, p, g) for p in patterns for g in range(1, groups + 1)]
    value = F.coalesce(*hits).try_cast("int")
    return F.when(value.between(lo, hi), value)


# fixed values: garden, plot and built area patterns
GARDEN = (f"(?:גינ[הת]|חצר)[^.\\n]{{0,40}}?([0-9]{{2,4}})\\s*{METRE}",)
GARDEN_EITHER = (
    "(?:גינ[הת]|חצר)[^.\\n]{0,40}?([0-9]{2,4})\\s*מ[״\"'׳]?ר"
    "|([0-9]{2,4})\\s*מ[״\"'׳]?ר[^.\\n]{0,30}?(?:גינ[הת]|חצר)",
)
LOT = (f"מגרש[^.\\n]{{0,30}}?([0-9]{{2,5}})\\s*{METRE}",)


def _plot(words: str) -> str:
    """A size of three to five digits behind one of the words, with its unit after or before it, or without."""
    return (
        f"(?:{words})(?:[^.\\n]{{0,80}}?([0-9]{{3,5}})\\s*(?:מ[״\"'׳]?ר|מטר)"
        "|\\s*מ[״\"'׳]?ר\\s*([0-9]{3,5})|[^.\\n]{0,40}?([0-9]{3,5})(?:[\\s,.]|$))"
    )


# fixed values: plot words of the agency feed, and those of the catalog feed, which also reads sizes in dunam
LOT_AGENCY = (_plot("מגרש|קרקע|המגרש"),)
LOT_LOOSE = (
    _plot("מגרש|קרקע|המגרש|פינת[יי]"),
    "(?:דונם|חצי\\s+דונם)[^.]{0,40}?([0-9]{3,5})\\s*(?:מ[״\"'׳]?ר|מטר)",
)
# fixed value: plot size of the article feed, with its unit
LOT_ARTICLE = ("(?:מגרש|קרקע|המגרש)[^.\\n]{0,80}?([0-9]{3,5})\\s*(?:מ[״\"']?ר|מטר)",)
_NOT_BUILT = "(?!(?:\\s*(?:מגרש|קרקע|גינ[הת]|חצר|מרפסת|מרפסות)))"
BUILT = (
    "(?:שטח\\s*(?:בנוי|מבונה|דירה|הבית|הדירה|נטו|ברוטו)?\\s*(?:של\\s*)?([0-9]{2,4})"
    "|([0-9]{2,4})\\s*(?:מ[״\"'׳]?ר|מטר)\\s*בנוי"
    "|בנוי\\s*(?:של\\s*)?([0-9]{2,4})"
    "|בנוי\\s*מ[״\"'׳]?ר\\s*([0-9]{2,4})"
    f"|חדרים?\\s*(?:[^.\\n]{{0,30}}?)([0-9]{{2,4}})\\s*(?:מ[״\"'׳]?ר|מטר){_NOT_BUILT}"
    "|כ[-\\s]*([0-9]{2,4})\\s*(?:מ[״\"'׳]?ר|מטר)\\s*בנוי"
    "|(?:וילה|קוטג'|קוטג|דו[-\\s]?משפחתי|בית\\s*פרטי|דירה|פנטהאוז)\\s+([0-9]{2,4})\\s*"
    f"(?:מ[״\"'׳]?ר|מטר){_NOT_BUILT})\\s*(?:מ[״\"'׳]?ר|מטר)?",
)


def garden_area(c: Column, patterns: tuple[str, ...] = GARDEN, groups: int = 1) -> Column:
    return bounded_number(c, patterns, 5, 9999, groups)


def lot_area(c: Column, patterns: tuple[str, ...] = LOT) -> Column:
    return bounded_number(c, patterns, 20, 99999)


def lot_area_loose(c: Column, patterns: tuple[str, ...] = LOT_LOOSE) -> Column:
    """Plot size with or without a unit; by the catalog's patterns also after a dunam mention."""
    return bounded_number(c, patterns, 0, 99999, tail="[0-9]{3,5}")


def built_area(c: Column, patterns: tuple[str, ...] = BUILT) -> Column:
    return bounded_number(c, patterns, 10, 9999, tail="[0-9]{2,4}")


@dataclass(frozen=True)
class YearLexicon:
    """How a text states a construction year or an age."""

    # fixed values: patterns of a construction year and of a building's age
    direct: str = (
        "(?U)שנת\\s+(?:ה)?ב(?:ני[יה]ה?|ניי[ה]?)\\s*[:\\-=]?\\s*(\\d{4})"
        "|נבנ[הת]\\w*\\s*(?:ב(?:שנת|חודש|שנים)?\\s*)?(\\d{4})"
        "|משנת\\s+(\\d{4})"
        "|ב(?:ני[יה]ה?|ניי[ה]?)\\s*(?:מקורית?|ראשונית?|חדשה?)?\\s*[:\\-=]?\\s*(\\d{4})"
        "|שנת\\s*בניה\\s*(\\d{4})(?:$|[,.\\s])"
        "|(?:בית|דירה|נכס|מבנה|קוטג|וילה)\\s+חדש[ה]?\\s*(?:מ(?:קבלן|ן\\s+היסוד))?\\s*(?:משנת\\s+)?(\\d{4})"
        "|חדש[ה]?\\s*(?:מ(?:קבלן|היסוד))?\\s*(?:משנת\\s+)?(\\d{4})"
    )
    age: str = (
        "(?U)גיל\\s*[:\\-=]?\\s*(\\d{1,2})\\s*(?:שנה|שנים|שגיל)?"
        "|(?:נכס|בית|דירה|מבנה|קוטג|וילה|מבנה)\\s*(?:הוא\\s+)?בן\\s+(\\d{1,2})\\s*(?:שנה|שנים)?"
        "|(?:נכס|בית|דירה|מבנה|קוטג|וילה)\\s*(?:היא\\s+)?בת\\s+(\\d{1,2})\\s*(?:שנה|שנים)?"
        "|בן\\s+(\\d{1,2})\\s*(?:שנה|שנים|$)"
        "|בת\\s+(\\d{1,2})\\s*(?:שנה|שנים)"
        "|(\\d{1,2})\\s*(?:שנה|שנים)\\s*(?:גיל|ישן|ישנה)"
        "|בן\\s+שנתיים|בת\\s+שנתיים|בן\\s+שנה(?![ים])|בת\\s+שנה(?![ים])"
    )
    two_years: str = "שנתיים"


HEBREW_YEARS = YearLexicon()


def year_built(c: Column, as_of_year: Column | int, lexicon: YearLexicon = HEBREW_YEARS) -> Column:
    """E-T6: a stated year within 1900-2100, else the year an age implies."""
    this_year = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    stated = group_of(F.regexp_extract(c, lexicon.direct, 0), r"([0-9]{4})[^0-9]*$").try_cast("int")
    hit = group_of(c, lexicon.age, 0)
    counted = group_of(hit, r"([0-9]{1,2})[^0-9]*$").try_cast("int")
    age = F.coalesce(counted, F.when(hit.contains(lexicon.two_years), 2).when(hit.isNotNull(), 1))
    return F.coalesce(
        F.when(stated.between(1900, 2100), stated), F.when(age.between(0, 150), this_year - age)
    ).cast("int")


@dataclass(frozen=True)
class MeasureLexicon:
    """Rooms, area and floor in running text (E-T7)."""

    # fixed values: patterns of rooms, area and floor
    rooms: str = "([0-9]+(?:\\.[0-9]+)?)\\s*חד"
    area: str = "([0-9]+)\\s*מ[״\"'׳]?ר"
    floor: str = "קומה\\s+(-?[0-9]+)"
    ground: tuple[str, ...] = field(default=("קרקע",))


HEBREW_MEASURES = MeasureLexicon()


def text_measures(c: Column, lexicon: MeasureLexicon = HEBREW_MEASURES) -> dict[str, Column]:
    floor = number_of(c, lexicon.floor)
    return {
        "rooms": number_of(c, lexicon.rooms, kind="double"),
        "sqm": number_of(c, lexicon.area),
        "floor": F.coalesce(floor, F.when(any_of(c, lexicon.ground), 0)),
    }


def compound_details(c: Column, pattern: str) -> Column:
    """STRUCT(kind, rooms, sqm, floor, total_floors) of a one-line summary."""
    floor = group_of(c, pattern, 4)
    return F.struct(
        F.trim(F.regexp_extract(c, pattern, 1)).alias("kind"),
        number_of(c, pattern, 2, "double").alias("rooms"),
        number_of(c, pattern, 3).alias("sqm"),
        F.when(floor.isin("קרקע", "ground"), 0).otherwise(floor.try_cast("int")).alias("floor"),
        number_of(c, pattern, 5).alias("total_floors"),
    )


def extract_features(
    text: Column, units: UnitLexicon = HEBREW_UNITS,
    garden: tuple[str, ...] = GARDEN, lot: tuple[str, ...] = LOT,
) -> dict[str, Column]:
    """E-T8: fill the three columns where they are NULL."""
    return {
        "units_count": F.coalesce(F.col("units_count"), units_count(text, units)),
        "garden_sqm": F.coalesce(F.col("garden_sqm"), garden_area(text, garden)),
        "lot_sqm": F.coalesce(F.col("lot_sqm"), lot_area(text, lot)),
    }
