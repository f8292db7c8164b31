"""String functions: Column in, Column out, all inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from hearthline import lexicons as lx

SPACE = r"(?U)\s+"
MARKS = "[\\u0591-\\u05c7]"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside a lambda, where it would run per element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group_of(c: Column, pattern: str, index: int = 1) -> Column:
    """First match of a group, NULL when there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, index))


def number_of(c: Column, pattern: str, index: int = 1, kind: str = "int") -> Column:
    """First match of a group as a number, NULL when there is none. A cast that fails costs an exception a row, so empty texts are not cast."""
    return group_of(c, pattern, index).try_cast(kind)


def any_of(c: Column, words: Sequence[str]) -> Column:
    """True when any of the words is a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


# ---- address text (D1-D8) ---------------------------------------------------

def strip_marks(c: Column, split_maqaf: bool = False) -> Column:
    """Remove vowel and accent marks. The maqaf hyphen lies in the range; it may become a space."""
    if split_maqaf:
        c = F.regexp_replace(c, "־", " ")
    return F.regexp_replace(c, MARKS, "")


def unify_quotes(c: Column) -> Column:
    return F.translate(c, "׳’‘״“”", "'''\"\"\"")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def expand_abbreviations(c: Column, table: dict[str, str] | None = None) -> Column:
    """Replace whole tokens by their long form; '' drops the token. Spaces collapse."""
    table = lx.ADDRESS_ABBREVIATIONS if table is None else table
    lookup = literal_map(table)
    tokens = F.transform(
        F.split(collapse_spaces(c), " "), lambda t: F.coalesce(F.try_element_at(lookup, t), t)
    )
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def _words_without(words: Iterable[str]) -> str:
    """Pattern of texts that are normal already: words with one plain space between, none of ``words``, no marks or quotes to unify."""
    named = "|".join(re.escape(w) for w in words)
    other = f"(?!(?:{named})(?: |\\z))" if named else ""
    word = other + r"[^\s\u0591-\u05c7׳’‘״“”]++"
    return f"(?U)^{word}(?: {word})*+\\z"


def normalize_text(c: Column, table: dict[str, str] | None = None) -> Column:
    """Marks, quotes, spaces and abbreviations of an address text. One match tells texts that need none of the steps."""
    text = F.coalesce(c, F.lit(""))
    normal = _words_without(lx.ADDRESS_ABBREVIATIONS if table is None else table)
    return F.when(text.rlike(normal), text).otherwise(expand_abbreviations(unify_quotes(strip_marks(text, True)), table))


def canonicalize_address(
    c: Column, stopwords: Sequence[str] | None = None, table: dict[str, str] | None = None
) -> Column:
    """Normal text without its stop words."""
    words = lx.ADDRESS_STOPWORDS if stopwords is None else stopwords
    stop = literal_array(words)
    text = F.coalesce(c, F.lit(""))
    tokens = F.split(normalize_text(c, table), " ")
    canonical = _words_without([*(lx.ADDRESS_ABBREVIATIONS if table is None else table), *words])
    return F.when(text.rlike(canonical), text).otherwise(
        F.array_join(F.filter(tokens, lambda t: ~F.array_contains(stop, t)), " "))


_HOUSE = r"^(?:(.*) )?([0-9]+[A-Za-zא-ת]?)$"


def street_number(c: Column) -> Column:
    """STRUCT(street, number): the last token is the number when it starts with a digit."""
    return let(normalize_text(c), lambda norm: let(F.regexp_extract(norm, _HOUSE, 2), lambda number: F.struct(
        F.when(number != "", F.regexp_extract(norm, _HOUSE, 1)).otherwise(norm).alias("street"), number.alias("number"),
    )))


def area_bucket(c: Column, size: int = 10) -> Column:
    return F.coalesce((F.floor(c / F.lit(size)) * size).cast("bigint").cast("string"), F.lit(""))


def rooms_bucket(c: Column) -> Column:
    return F.coalesce((F.bround(c * 2) / 2).cast("double").cast("string"), F.lit(""))


def city_text(c: Column) -> Column:
    return collapse_spaces(F.translate(F.coalesce(c, F.lit("")), "-־", "  "))


def city_key(c: Column, groups: Sequence[Sequence[str]] | None = None) -> Column:
    """Spelling-independent city key."""
    pairs = {}
    for names in lx.CITY_SYNONYMS if groups is None else groups:
        spell = [" ".join(n.replace("-", " ").replace("־", " ").split()) for n in names]
        pairs.update({s: spell[0] for s in spell})
    norm = city_text(c)
    return F.coalesce(F.try_element_at(literal_map(pairs), norm), norm)


# ---- markup and numbers (D9-D13) --------------------------------------------

_ENTITY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,30};?)"
#: Names that count without a semicolon too, also in front of other letters.
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}


def _windows(point: int) -> str:
    """Numbers of control signs mean the sign of that byte in Windows text, where it has one."""
    try:
        return bytes([point]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(point)


def text_map(pairs: dict[str, str]) -> Column:
    """A fixed map as one folded literal, for tables too long for a column per entry."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in sorted(pairs.items()))), F.lit("\x02"), F.lit("\x01"))


def _number_text(e: Column) -> Column:
    """Text of a numeric reference; numbers of no character give U+FFFD, of signs that a page can't hold nothing."""
    bare = F.regexp_extract(e, "^&#0*([0-9]+)", 1), F.regexp_extract(e, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    decimal = F.when(F.length(bare[0]) > 7, 0).otherwise(blank_to_null(bare[0]).try_cast("bigint"))
    hexadecimal = F.when(F.length(bare[1]) > 6, 0).otherwise(F.conv(F.nullif(bare[1], F.lit("")), 16, 10).try_cast("bigint"))
    point = F.when(e.rlike("^&#[xX]"), hexadecimal).otherwise(decimal)
    fine = F.when((point < 1) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF), 0xFFFD).otherwise(point)
    unfit = (
        point.between(1, 8) | point.between(14, 31) | (point == 11) | (point == 127) | point.between(0xFDD0, 0xFDEF)
        | (point.between(0xFFFE, 0x10FFFF) & (F.pmod(point, F.lit(0x10000)) >= 0xFFFE))
    )
    char = F.decode(F.unhex(F.lpad(F.hex(fine), 8, "0")), "UTF-32")
    windows = text_map({str(p): _windows(p) for p in range(128, 160)})
    return F.when(unfit, "").when(point.between(128, 159), F.try_element_at(windows, point.cast("string"))).otherwise(char)


def _name_text(e: Column) -> Column:
    """Text of a named reference: the whole name, else its longest beginning that needs no semicolon; other names stay."""
    name = F.substr(e, F.lit(2))
    by_letter: dict[str, dict[str, str]] = {}
    for known, text in html5.items():
        by_letter.setdefault(known[0], {})[known] = text
    shelves = F.create_map(*[x for letter, names in sorted(by_letter.items()) for x in (F.lit(letter), text_map(names))])
    whole = F.try_element_at(F.try_element_at(shelves, F.left(name, F.lit(1))), name)
    bare = text_map(_BARE)
    sizes = sorted({len(n) for n in _BARE}, reverse=True)
    begun = [F.concat(F.try_element_at(bare, F.left(name, F.lit(k))), F.substr(name, F.lit(k + 1))) for k in sizes]
    return F.coalesce(whole, *begun, e)


def _entity_text(e: Column) -> Column:
    return F.when(F.startswith(e, F.lit("&#")), _number_text(e)).otherwise(_name_text(e))


def unescape_markup(c: Column) -> Column:
    """Numeric and named character references of HTML 5, decoded once, without leaving the JVM."""
    def decoded(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), _entity_text)
        parts = F.zip_with(F.split(text, _ENTITY, -1), found, lambda gap, e: F.concat(gap, F.coalesce(e, F.lit(""))))
        return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)

    return let(c, decoded)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def clean_cell(c: Column) -> Column:
    plain = unescape_markup(strip_tags(c))
    return F.btrim(F.regexp_replace(plain, "[\\u200e\\u200f\\u00a0]", ""), F.lit(" \t\r\n"))


def parse_price(c: Column, decimals: bool = True) -> Column:
    """'1,670K ₪' -> 1670000; NULL unless positive."""
    pattern = r"([0-9,.]+)\s*([kKmM]?)" if decimals else r"([0-9,]+)\s*([kKmM]?)"
    plain = F.regexp_replace(c, "₪", "")
    number = blank_to_null(F.regexp_replace(F.regexp_extract(plain, pattern, 1), ",", "")).try_cast("double")
    suffix = F.lower(F.regexp_extract(plain, pattern, 2))
    scale = F.when(suffix == "k", 1000.0).when(suffix == "m", 1000000.0).otherwise(1.0)
    value = F.floor(number * scale).cast("bigint")
    return F.when(value > 0, value)


def digits(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, "[^0-9]", "")).try_cast("bigint")


def first_int(c: Column) -> Column:
    return number_of(F.regexp_replace(c, ",", ""), r"([0-9]+)", kind="bigint")


def first_float(c: Column) -> Column:
    return number_of(c, r"([0-9]+(?:\.[0-9]+)?)", kind="double")


def trailing_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]+[A-Za-z]?)\s*$", 1)


# ---- address splitting (D14-D16) --------------------------------------------

def split_city_title(c: Column, cities: Sequence[str] | None = None) -> Column:
    """STRUCT(city, neighborhood): first listed city that prefixes the title, else the first word."""
    known = literal_array(lx.MULTIWORD_CITIES if cities is None else cities)

    def split(title: Column, hit: Column) -> Column:
        word = F.regexp_extract(title, r"(?U)^\s*(\S+)", 1)
        rest = F.regexp_extract(title, r"(?Us)^\s*\S+\s+(.*)$", 1)
        return F.struct(
            F.coalesce(hit, word).alias("city"),
            F.when(hit.isNotNull(), F.trim(F.substr(title, F.length(hit) + 1))).otherwise(rest)
            .alias("neighborhood"),
        )

    return let(F.coalesce(c, F.lit("")), lambda title: let(
        F.get(F.filter(known, lambda k: title.startswith(k)), F.lit(0)), lambda hit: split(title, hit)))


_NUMBERED = r"^(.+?)\s+([0-9]+[א-ת]?)$"


def _parts(c: Column) -> Column:
    return F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p))


def _street_of(part: Column) -> Column:
    return F.when(part.rlike(_NUMBERED), F.trim(F.regexp_extract(part, _NUMBERED, 1))).otherwise(part)


def split_address_city_first(c: Column) -> Column:
    """'city, neighbourhood, street 4'."""
    def split(parts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        return F.struct(
            at(0).alias("city"), at(1).alias("neighborhood"), at(2).alias("street"),
            trailing_number(at(2)).alias("house_number"),
        )

    return let(_parts(c), split)


def split_address_street_first(c: Column, default_city: str = lx.DEFAULT_CITY) -> Column:
    """'street 4, neighbourhood, city'."""
    def split(parts: Column) -> Column:
        n = F.size(parts)
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        return F.struct(
            _street_of(first).alias("street"),
            F.regexp_extract(first, _NUMBERED, 2).alias("house_number"),
            F.when(n >= 3, F.get(parts, n - 2)).otherwise("").alias("neighborhood"),
            F.when(n >= 2, F.get(parts, n - 1)).otherwise(default_city).alias("city"),
        )

    return let(_parts(c), split)


def split_address_either_order(
    c: Column, default_city: str = lx.DEFAULT_CITY, prefixes: Sequence[str] | None = None
) -> Column:
    """'street 4, city', 'city, street 4' or 'city street 4'; a leading 'street' word is dropped."""
    starts = literal_array(lx.CITY_PREFIXES if prefixes is None else prefixes)

    def split(text: Column, parts: Column, numbered: Column, prefix: Column) -> Column:
        n = F.size(parts)
        others = F.when(
            numbered.isNotNull(), F.filter(parts, lambda p: p != numbered)
        ).otherwise(parts)
        last = let(others, lambda left: F.get(left, F.size(left) - 1))
        city_in_list = F.coalesce(last, F.get(parts, n - 1))
        rest = F.when(
            prefix.isNotNull(), F.trim(F.substr(text, F.length(prefix) + 1))
        ).otherwise(text)
        return let(
            F.when(n >= 2, F.coalesce(numbered, F.get(parts, F.lit(0)))).otherwise(rest),
            lambda source: F.struct(
                _street_of(source).alias("street"),
                F.regexp_extract(source, _NUMBERED, 2).alias("house_number"),
                F.when(n == 3, F.get(parts, F.lit(1))).otherwise("").alias("neighborhood"),
                F.when(n >= 2, city_in_list).otherwise(F.coalesce(prefix, F.lit(default_city))).alias("city"),
            ))

    first = lambda found: F.get(found, F.lit(0))
    whole = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^רחוב\s+", "")
    return let(whole, lambda text: let(_parts(text), lambda parts: let(
        first(F.filter(parts, lambda p: p.rlike(_NUMBERED))), lambda numbered: let(
            first(F.filter(starts, lambda k: text.startswith(F.concat(k, F.lit(" "))))),
            lambda prefix: split(text, parts, numbered, prefix)))))


def split_street_number(c: Column) -> Column:
    """STRUCT(street, house_number) of a deal's address text."""
    pattern = r"(?U)^(.*?)\s+(\d[\d\w/]*)$"
    text = F.trim(c)
    return F.struct(
        F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text)
        .alias("street"),
        F.regexp_extract(text, pattern, 2).alias("house_number"),
    )


def merge_address(street: Column, house: Column) -> Column:
    s = F.trim(F.coalesce(street, F.lit("")))
    h = F.trim(F.coalesce(house.cast("string"), F.lit("")))
    return F.when(h == "", s).when(s == "", h).when(s.endswith(h), s).otherwise(
        F.concat_ws(" ", s, h)
    )


# ---- links and titles (D17-D20, D33, D34) -----------------------------------

def absolutize(c: Column, base: str, relative: bool = False) -> Column:
    url = (
        F.when(c.startswith("//"), F.concat(F.lit("https:"), c))
        .when(c.startswith("/"), F.concat(F.lit(base), c))
    )
    if relative:
        return url.when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit(base + "/"), c))
    return url.otherwise(c)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\r\n]", " "), " {2,}", " "))


def title_of(c: Column, limit: int = 160) -> Column:
    """First non-blank line, spaces collapsed, cut with an ellipsis."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), collapse_spaces)
    line = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(
        F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 1)), F.lit("…"))
    ).otherwise(line)


def map_link(lat: Column, lon: Column, address: Column, city: Column, country: str) -> Column:
    pano = F.concat(
        F.lit("https://www.google.com/maps/@?api=1&map_action=pano&viewpoint="),
        lat.cast("string"), F.lit(","), lon.cast("string"),
    )
    query = F.concat_ws(", ", blank_to_null(address), blank_to_null(city), F.lit(country))
    quoted = F.url_encode(query)
    for form, uri in [(r"\+", "%20"), ("%2F", "/"), ("%7E", "~"), (r"\*", "%2A")]:
        quoted = F.regexp_replace(quoted, form, uri)
    search = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), quoted)
    return F.when(lat.isNotNull() & lon.isNotNull(), pano).otherwise(search)


def url_path(c: Column) -> Column:
    """URL without its query string."""
    return F.get(F.split(F.coalesce(c, F.lit("")), r"\?"), F.lit(0))


def pick_images(images: Column) -> Column:
    """One URL per image struct: gallery, else full, else thumbnail."""
    urls = F.transform(
        images,
        lambda i: F.coalesce(
            blank_to_null(i["gallery"]), blank_to_null(i["full"]), blank_to_null(i["thumbnail"])
        ),
    )
    return F.coalesce(F.array_compact(urls), F.array().cast("array<string>"))


def longest_of(*columns: Column) -> Column:
    """Longest of the trimmed candidates; the earliest wins ties; '' when all are missing."""
    best = F.lit("")
    for c in columns:
        text = F.trim(F.coalesce(c, F.lit("")))
        best = F.when(F.length(text) > F.length(best), text).otherwise(best)
    return best


# ---- cells (D21-D23) --------------------------------------------------------

def cell_number(c: Column) -> Column:
    """A double as its shortest text with at most two decimals: 2.50 -> '2.5', 3.0 -> '3.0'."""
    return F.bround(c, 2).cast("string")


def cell_text(c: Column, kind: str = "string") -> Column:
    """Cell rendering: NULL '', TRUE 'yes', FALSE '', doubles to two decimals."""
    if kind == "boolean":
        body = F.when(c, "yes").otherwise("")
    elif kind == "double":
        body = cell_number(c)
    else:
        body = c.cast("string")
    return F.coalesce(body, F.lit(""))


def cell_norm(c: Column) -> Column:
    """Comparable cell text: no thousands separators, no outer spaces, NULL is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), ",", ""))


def coerce_cell_back(text: Column, kind: str) -> Column:
    """Cell text -> text of the value in the type of the fresh value; left as text if it does not parse."""
    norm = cell_norm(text)
    if kind == "boolean":
        out = F.lower(norm).isin("true", "yes", "1").cast("string")
    elif kind in ("int", "bigint"):
        out = F.coalesce(norm.try_cast("double").cast("bigint").cast("string"), norm)
    elif kind == "double":
        out = F.coalesce(norm.try_cast("double").cast("string"), norm)
    else:
        out = F.trim(text)
    return F.when(F.coalesce(text, F.lit("")) != "", out)


def signed_number(c: Column) -> Column:
    """+0.72, -0.5, 0: two decimals, trailing zeros dropped."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), "0+$", ""), r"\.$", "")
    return F.when(c > 0, F.concat(F.lit("+"), text)).otherwise(text)


def reasons_summary(pairs: Sequence[tuple[str, Column, str]], limit: int = 8) -> Column:
    """'key:+value' for the first ``limit`` reasons that are present."""
    cells = []
    for name, value, kind in pairs:
        if kind == "boolean":
            body = F.when(value, "+1").otherwise("0")
        elif kind == "number":
            body = signed_number(value.cast("double"))
        else:
            body = value.cast("string")
        cells.append(F.when(value.isNotNull(), F.concat(F.lit(name + ":"), body)))
    return F.array_join(F.slice(F.array_compact(F.array(*cells)), 1, limit), ", ")


# ---- search text, keywords (D24-D29, D35) -----------------------------------

def search_text(description: Column, tags: Column) -> Column:
    joined = F.array_join(tags, " ")
    raw = F.concat_ws(
        " ", F.coalesce(description, F.lit("")), F.when(F.size(tags) > 0, joined)
    )
    return F.lower(strip_marks(raw))


def standalone_word(c: Column, word: str, letters: str = r"\u0590-\u05ff") -> Column:
    """The word as it stands, signs of regular expressions included, between other characters than letters."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", word)
    return c.rlike(f"(?<![{letters}]){quoted}(?![{letters}])")


def phrase_hits(c: Column, phrases: Sequence[str]) -> Column:
    return let(c, lambda text: F.filter(literal_array(phrases), lambda p: text.contains(p)))


def keyword_flags(c: Column, words: dict[str, list[str]] | None = None) -> dict[str, Column]:
    words = lx.AMENITY_WORDS if words is None else words
    return {flag: any_of(c, keys) for flag, keys in words.items()}


def contains_all(c: Column, tokens: Column) -> Column:
    return let(c, lambda text: F.forall(tokens, lambda t: text.contains(t)))


def detect_agent(
    section: Column, ad_type: Column, agency: Column, contact_type: Column,
    contact_name: Column, seller: Column, tags_text: Column,
) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    return (
        text(section).isin(lx.AGENT_SECTIONS)
        | F.lower(text(ad_type)).isin(lx.AGENT_AD_TYPES)
        | (text(agency) != "")
        | F.lower(text(contact_type)).isin(lx.AGENT_CONTACT_TYPES)
        | any_of(text(contact_name), lx.AGENT_NAMES)
        | any_of(text(seller), lx.AGENT_NAMES)
        | any_of(text(tags_text), lx.AGENT_TAGS)
    )


def icon_flags(icons: Column, labels: Sequence[tuple[str, str]] | None = None) -> dict[str, Column]:
    """Flags of ARRAY<STRUCT<label, checked>>; TRUE wins over FALSE, NULL when unmentioned."""
    labels = lx.AMENITY_LABELS if labels is None else labels
    short = F.filter(
        icons, lambda i: (F.length(i["label"]) > 0) & (F.length(i["label"]) <= lx.AMENITY_LABEL_MAX)
    )
    # the first label that occurs decides which flag an icon belongs to
    owned = F.transform(
        short,
        lambda i: F.struct(
            F.coalesce(*[F.when(i["label"].contains(w), flag) for w, flag in labels]).alias("flag"),
            i["checked"].alias("checked"),
        ),
    )

    def state(flag: str) -> Column:
        hits = F.filter(owned, lambda i: i["flag"] == flag)
        return F.when(F.size(hits) > 0, F.exists(hits, lambda i: i["checked"]))

    return {flag: state(flag) for flag in dict.fromkeys(f for _, f in labels)}


def property_type(c: Column, table: dict[str, str] | None = None) -> Column:
    return F.coalesce(F.try_element_at(literal_map(table or lx.PROPERTY_TYPES), c), c)


# ---- identifiers (D30-D32, B5) ----------------------------------------------

def canonical_id(raw: Column) -> Column:
    return F.concat(F.lit("CAN-"), F.left(F.sha1(raw), F.lit(12)))


def address_hash(*columns: Column) -> Column:
    text = [F.coalesce(c, F.lit("")) for c in columns]
    return F.left(F.sha1(F.lower(F.concat_ws("|", *text))), F.lit(16))


def text_hash(description: Column, tags: Column, address: Column) -> Column:
    raw = F.concat_ws(
        "|", F.coalesce(description, F.lit("")),
        F.when(F.size(tags) > 0, F.array_join(tags, " ")), blank_to_null(address),
    )
    return F.left(F.sha2(raw, 256), F.lit(16))


def prompt_chunk(description: Column, tags: Column, address: Column, limit: int = 900) -> Column:
    tag_text = F.when(F.size(tags) > 0, F.concat(F.lit("תגיות: "), F.array_join(tags, " ")))
    place = F.concat(F.lit("כתובת: "), blank_to_null(address))
    return F.left(
        F.concat_ws(" | ", F.coalesce(description, F.lit("")), tag_text, place), F.lit(limit)
    )
