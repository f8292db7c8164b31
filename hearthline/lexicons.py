"""Word lists, lookup tables and thresholds the results depend on."""

from __future__ import annotations

# ---- address text -----------------------------------------------------------
# fixed values: token abbreviations and their long form ('' drops the token)
ADDRESS_ABBREVIATIONS = {
    "רח'": "רחוב",
    "שכ'": "שכונה",
    "מרפ'": "מרפסת",
    "ממ'ד": "ממד",
    'ממ"ד': "ממד",
    "מ'ד": "ממד",
    'מ"ד': "ממד",
    "מ'ר": "מטר",
    'מ"ר': "מטר",
    "חד": "חדר",
    "חד'": "חדר",
    "מס'ד": "מסדרון",
    'מס"ד': "מסדרון",
    "כניסה": "",
    "בניין": "",
    "דירה": "",
}

# fixed values: tokens without meaning in an address key
ADDRESS_STOPWORDS = [
    "רחוב", "הרחוב", "רח", "שכונה", "קומה", "כניסה", "בניין",
    "דירה", "דירות", "למכירה", "למכר",
    "חדר", "חדרים", "מטר", "מטרים",
    "ה", "של", "את", "על", "עם", "ב", "מן", "אל", "גם",
    "אזור", "תעשייה", "תעשיה", "מסחרי", "מרכז",
    "ישוב", "עיר",
]

# fixed values: municipality spellings (canonical name first)
CITY_SYNONYMS = [
    ["תל אביב יפו", "תל אביב-יפו", "תל אביב"],
    ["קריית אונו", "קרית אונו"],
    ["קריית גת", "קרית גת"],
    ["קריית ביאליק", "קרית ביאליק"],
    ["קריית מוצקין", "קרית מוצקין"],
    ["קריית ים", "קרית ים"],
    ["קריית אתא", "קרית אתא"],
    ["פתח תקווה", "פתח תקוה"],
    ["ראשון לציון", 'ראשל"צ', "ראשל״צ"],
    ["באר שבע", "באר-שבע"],
    ["נוף הגליל", "נוף הגליל עילית"],
]

# fixed values: city names of several words, in matching order
MULTIWORD_CITIES = [
    "תל אביב יפו", "תל אביב", "בת ים", "רמת גן", "גבעת שמואל", "גבעת ברנר", "גבעתיים",
    "ראשון לציון", "פתח תקווה", "קריית אונו", "קרית אונו", "קריית גת", "קריית ביאליק",
    "קריית מוצקין", "קריית ים", "קריית אתא", "נוף הגליל", "בית שמש", "באר שבע", "כפר סבא",
    "הוד השרון", "רמת השרון", "רמת הגולן", "מעלה אדומים", "יד בנימין", "אור יהודה", "אור עקיבא",
]

# default of the caller's parameter: city of addresses that name none, and known city names
DEFAULT_CITY = "אריאל"
CITY_PREFIXES = ["אריאל", "ברקן", "נופים"]

# ---- listing attributes -----------------------------------------------------
# fixed values: property type spelling -> stored type
PROPERTY_TYPES = {
    "דירה": "דירה", "דירת גן": "דירת גן", "דו משפחתי": "דו משפחתי", "דופלקס": "דופלקס",
    "בית פרטי": "בית פרטי", "קוטג'": "קוטג'", "קוטג": "קוטג'", "וילה": "וילה",
    "פנטהאוז": "פנטהאוז", "מגרש": "מגרש",
}

# fixed values: words that switch an amenity flag on
AMENITY_WORDS = {
    "parking": ["חנייה", "חניה"],
    "elevator": ["מעלית"],
    "balcony": ["מרפסת"],
    "ac": ["מיזוג", "מזגן"],
    "mamad": ["ממד", 'ממ"ד', "ממ״ד"],
    "renovated": ["משופץ", "משופצת", "שיפוץ"],
}

# fixed values: label of an amenity icon -> flag, in matching order
AMENITY_LABELS = [
    ("מעלית", "elevator"), ("חניה", "parking"), ("מרפסת", "balcony"), ("מרפסת שמש", "balcony"),
    ('ממ"ד', "mamad"), ("ממד", "mamad"), ("מזגן", "ac"), ("משופצת", "renovated"),
]
# fixed value: longest label read as an amenity
AMENITY_LABEL_MAX = 30

# fixed values: signs of an agency
AGENT_SECTIONS = ["agency", "platinum"]
AGENT_AD_TYPES = ["agency", "business", "broker", "agent", "commercial"]
AGENT_CONTACT_TYPES = ["agency", "broker", "agent", "business"]
AGENT_TAGS = ["תיווך", "מתווך", "סוכן"]
AGENT_NAMES = [
    "תיווך", 'נדל"ן', "מתווך", "סוכנ", "נכסים",
    "רימקס", "RE/MAX", "קולדוול", "century", "סנצ'ורי",
]

# fixed values: lists of the nested feed, in order of precedence
FEED_SECTIONS = ["private", "agency", "platinum", "items", "feed_items"]

# ---- scoring ----------------------------------------------------------------
# fixed values: (city part, neighbourhood part or '', low, high) price per square metre, in order
MARKET_BANDS = [
    ("תל אביב", "צפון הישן", 50_000, 65_000),
    ("תל אביב", "רוטשילד", 50_000, 65_000),
    ("תל אביב", "הבימה", 50_000, 65_000),
    ("תל אביב", "לב העיר", 50_000, 65_000),
    ("תל אביב", "לב תל אביב", 50_000, 65_000),
    ("תל אביב", "", 38_000, 52_000),
    ("חיפה", "כרמל", 18_000, 28_000),
    ("חיפה", "", 12_000, 20_000),
    ("רמת גן", "", 28_000, 38_000),
    ("אריאל", "", 12_000, 18_000),
    ("בית שמש", "", 15_000, 22_000),
    ("אור יהודה", "", 28_000, 38_000),
]
# fixed value: band of cities without their own
FALLBACK_BAND = (25_000, 40_000)

# fixed values: point of interest and its distance bands (below km, points)
POI = (32.025982, 34.864421)
POI_BANDS = [(0.5, 1.5), (1.0, 1.0), (1.5, 0.6), (2.5, 0.2), (4.0, 0.0)]
POI_FAR = -0.5

# fixed values: points of the score
FEATURE_POINTS = {"parking": 0.3, "balcony": 0.2, "renovated": 0.4}
SELLER_POINTS = {"agent": -0.48, "private": 0.72}

# fixed values: building age bands (up to years, points, label)
AGE_BANDS = [
    (5, 0.3, "new_construction"), (15, 0.1, "modern"), (35, 0.0, "standard"), (50, -0.2, "older"),
]
# fixed value: points beyond the last age
AGE_OLDEST = (-0.4, "very_old")

# fixed values: phrases of a large garden
GARDEN_PHRASES = [
    "גינה גדולה", "גינה ענקית", "גינה עשירה", "גינה רחבה",
    "חצר גדולה", "חצר ענקית", "שטח גינה", "מגרש גדול",
]
# fixed values: words that separate repeated units
UNIT_SEPARATORS = ["נוספת", "נוסף", "נפרדת", "נפרד", "סטודיו", "שנייה", "אחרת"]

# ---- bounds -----------------------------------------------------------------
# fixed values: sane range per extracted number
NUMBER_BOUNDS = {
    "rooms": (0.5, 30), "sqm": (10, 10000), "sqm_build": (10, 10000), "floor": (-10, 200),
    "units_count": (1, 100), "garden_sqm": (5, 9999), "lot_sqm": (5, 99999),
}
# fixed values: flags an extraction may set
EXTRACTED_FLAGS = ["parking", "balcony", "elevator", "renovated", "ac"]

# ---- tracker ----------------------------------------------------------------
# fixed values: columns compared and editable in the tracker, in order
TRACKED_COLUMNS = [
    "score", "sale_type", "comments", "description", "city", "neighborhood", "address",
    "rooms_eff", "sqm_build_eff", "lot_sqm_eff", "garden_sqm_eff", "floor", "price",
    "price_before", "listing_type", "units_count_eff",
]
CELL_ERRORS = ["#ERROR!", "#REF!", "#VALUE!", "#NAME?", "#N/A", "#DIV/0!", "#NULL!", "#NUM!"]
