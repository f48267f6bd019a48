"""Parsers of listing text. Each gives null unless it is sure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.scalars import blank_to_null, group, matches, mentions, once, pattern, round_half_up, within

# Street suffixes and their short forms.
SUFFIXES = {
    "street": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "drive": "dr", "court": "ct",
    "place": "pl", "road": "rd", "lane": "ln", "terrace": "ter", "highway": "hwy", "parkway": "pkwy",
}
# Ordinals up to twenty in words.
ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
    "eleventh": "11th", "twelfth": "12th", "thirteenth": "13th", "fourteenth": "14th", "fifteenth": "15th", "sixteenth": "16th", "seventeenth": "17th", "eighteenth": "18th",
    "nineteenth": "19th", "twentieth": "20th",
}
# Number words of concessions.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "six": 6}
WEEKS_PER_MONTH = 4.345
# Precisions of a geocoder's address types; anything else is a block.
PRECISIONS = {
    "house": "exact_address", "house_number": "exact_address", "address": "exact_address", "building": "building", "residential": "building", "apartments": "building",
    "road": "block", "street": "block", "block": "block", "neighbourhood": "neighborhood", "suburb": "neighborhood", "quarter": "neighborhood",
    "city": "city", "town": "city", "municipality": "city",
}
# How listings write prices, rooms, sizes, terms, units and concessions.
PRICE = r"\$?\s*(\d{3,6})(?:\.\d{1,2})?"
STUDIO = r"\bstudio\b"
BEDROOMS = r"(\d+(?:\.\d+)?)\s*(?:br|bd|bed(?:room)?s?)\b"
SHARED_BATH = r"\b(shared|split)\s*ba"
BATHROOMS = r"(\d+(?:\.\d+)?)\s*(?:ba(?:th(?:room)?s?)?)\b"
SQUARE_FEET = r"(?i)(\d{2,5})\s*(?:ft2|ft²|sq\.?\s*ft\.?|sqft|square\s*feet)"
MONTH_TO_MONTH, LEASE_MONTHS = "month[- ]to[- ]month", r"(\d{1,2})\s*[- ]?months?"
UNIT = r"([A-Za-z]?\d{1,4}(?:-\d{1,4})?[A-Za-z]{0,2})"
CONCESSION = r"(?i)(\d+(?:\.\d+)?\s*(?:months?|weeks?)\s+free(?:\s+rent)?[^.!\n]*|move[- ]in special[^.!\n]*|\$\d[\d,]*\s+off[^.!\n]*)"
# Wordings of laundry and parking, the first that occurs counts, each with fragments of which any match has one.
LAUNDRY = {
    "none": (r"\bno laundry\b", ("no laundry",)),
    "in_unit": (r"\b(w/d in unit|washer\s*/?\s*dryer in unit|in[- ]unit (laundry|washer)|laundry in unit)\b", ("w/d in unit", "dryer in unit", "unit laundry", "unit washer", "laundry in unit")),
    "in_building": (
        r"\b(laundry (in bldg|in building|on site|on-site|room)|shared laundry|coin[- ]op|laundry facilities)\b",
        ("laundry in b", "laundry on", "laundry room", "shared laundry", "coin-op", "coin op", "laundry facilities"),
    ),
    "hookups": (r"\b(w/d hookups?|washer\s*/?\s*dryer hookups?|laundry hookups?)\b", ("w/d hookup", "dryer hookup", "laundry hookup")),
}
PARKING = {
    "garage": (r"\b(garage|valet parking)\b", ("garage", "valet parking")),
    "off_street": (
        r"\b(off[- ]street|carport|driveway|assigned parking|parking included|parking available|parking spot)\b",
        ("off-street", "off street", "carport", "driveway", "assigned parking", "parking included", "parking available", "parking spot"),
    ),
    "street": (r"\bstreet parking\b", ("street parking",)),
    "none": (r"\bno parking\b", ("no parking",)),
}


def _allowed(animal: str) -> tuple[str, ...]:
    return tuple(f"{animal}{s} {x}" for s in ("", "s") for x in ("are ", "ok", "welcome", "allowed")) + (f"{animal}-friendly", f"{animal} friendly")


# Wordings about pets, with fragments of which any match has one.
PETS = {
    "refused": (r"\bno pets\b|\bpets?[^a-z]{0,3}not allowed\b|\bpet[- ]free\b", ("no pets", "not allowed", "pet-free", "pet free")),
    "pets": (r"\bpets? (are )?(ok|okay|welcome|allowed|friendly)\b|\bpet[- ]friendly\b", (*_allowed("pet"), "pets friendly")),
    "cats": (r"\bcats? (are )?(ok|okay|welcome|allowed)\b|\bcat[- ]friendly\b", _allowed("cat")),
    "dogs": (r"\bdogs? (are )?(ok|okay|welcome|allowed)\b|\bdog[- ]friendly\b", _allowed("dog")),
    "only_cats": (r"\bcats? only\b", ("cat only", "cats only")),
    "no_cats": (r"\bno cats\b", ("no cats",)),
    "no_dogs": (r"\bno dogs\b", ("no dogs",)),
    "limit": (r"\b(small dogs?( only)?( under \d+ ?lbs?)?|dogs? under \d+ ?lbs?|one dog max|breed restrictions?[^.,;]*)", ("small dog", "dog under ", "dogs under ", "one dog max", "breed restriction")),
}
# What all wordings about pets of a kind have; texts without it are searched once for the kind.
ANIMALS = {"refused": "pet", "pets": "pet", "cats": "cat", "only_cats": "cat", "no_cats": "cat", "dogs": "dog", "no_dogs": "dog"}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def parse_price(raw: Column) -> Column:
    """Monthly price: three to six digits, cents ignored, 100 to 100000."""
    return within(group(F.replace(raw, F.lit(",")), PRICE).cast("double"), 100, 100_000)


def has_price(price: Column, effective: Column) -> Column:
    return F.coalesce(price, effective).isNotNull()


def parse_bedrooms(raw: Column) -> Column:
    text = F.lower(raw)
    return F.when(matches(text, STUDIO), F.lit(0.0)).otherwise(within(group(text, BEDROOMS).cast("double"), 0, 12))


def parse_bathrooms(raw: Column) -> Column:
    text = F.lower(raw)
    return F.when(~matches(text, SHARED_BATH), within(group(text, BATHROOMS).cast("double"), 0, 12, open_low=True))


def parse_square_feet(raw: Column) -> Column:
    return within(group(F.replace(raw, F.lit(",")), SQUARE_FEET).cast("int"), 80, 20_000)


def price_per_square_foot(price: Column, square_feet: Column) -> Column:
    """To two digits, half up; zero counts as missing."""
    return F.when((price != 0) & (square_feet > 0), round_half_up(price.cast("double") / square_feet, 2))


def _first_that_occurs(text: Column, wordings: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    return F.coalesce(*(F.when(matches(text, w, fragments), name) for name, (w, fragments) in wordings.items()))


def normalize_laundry(raw: Column) -> Column:
    return once(F.lower(raw), lambda text: _first_that_occurs(text, LAUNDRY))


def normalize_parking(raw: Column) -> Column:
    return once(F.lower(raw), lambda text: _first_that_occurs(text, PARKING))


def parse_pet_policy(raw: Column) -> Column:
    """Struct of cats_allowed, dogs_allowed (each may be unknown) and dog_restrictions_raw."""
    wording, fragments = PETS["limit"]

    def found(text: Column) -> Column:
        said = [F.coalesce(F.contains(text, F.lit(animal)) & matches(text, *PETS[name]), F.lit(False)).alias(name) for name, animal in ANIMALS.items()]
        return F.struct(*said, F.when(mentions(text, fragments), F.trim(group(text, wording))).alias("limit"))

    def policy(said: Column) -> Column:
        limit = F.when(~said["refused"], said["limit"])
        cat = F.when(said["refused"], False).when(said["only_cats"], True).when(said["no_cats"], False).when(said["cats"] | said["pets"], True)
        dog = F.when(said["refused"] | said["only_cats"] | said["no_dogs"], False).when(said["dogs"] | said["pets"], True).when(limit.isNotNull(), True)
        return F.struct(cat.alias("cats_allowed"), dog.alias("dogs_allowed"), limit.alias("dog_restrictions_raw"))

    return once(once(F.lower(raw), found), policy)


def effective_monthly(price: Column, concessions: Column) -> Column:
    """Rent over twelve months less the free months or weeks, to a whole amount."""
    text = F.lower(concessions)
    words = "|".join(NUMBER_WORDS)

    def amount(unit: str) -> Column:
        found = group(text, rf"(\d+(?:\.\d+)?|{words})\s*{unit}s? free")
        return F.coalesce(_map(NUMBER_WORDS)[found].cast("double"), found.try_cast("double"))

    free = F.coalesce(amount("month"), amount("week") / F.lit(WEEKS_PER_MONTH))
    return F.when((price != 0) & (free > 0) & (free < 12), round_half_up(price.cast("double") * (F.lit(12.0) - free) / F.lit(12.0)))


def extract_concessions(text: Column) -> Column:
    return F.trim(group(text, CONCESSION, 0))


def address_key(address: Column, unit: Column | None = None) -> Column:
    """Comparable form of an address, with the unit behind a bar if there is one."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(address), r"[^a-z0-9\s]", " "), r"\s+", " "))
    short = _map(SUFFIXES)
    key = F.array_join(F.transform(F.split(blank_to_null(clean), " "), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")
    if unit is None:
        return key
    own = normalize_unit(unit)
    return F.when(own.isNotNull(), F.concat(key, F.lit("|"), own)).otherwise(key)


def normalize_unit(unit: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.lower(unit), "[^a-z0-9]", ""))


def unit_from_title(title: Column) -> Column:
    """A unit after # or "unit" anywhere, or after a final dash if the title starts like an address."""
    anywhere = group(title, rf"(?i)(?:#\s?|\bunit\s+#?){UNIT}\b")
    final = group(title, rf"^\d+\s+[A-Za-z][^-–#]{{2,40}}[-–]\s*{UNIT}\s*$")
    return F.coalesce(anywhere, final)


def effective_unit(unit: Column, title: Column) -> Column:
    return F.coalesce(normalize_unit(unit), normalize_unit(unit_from_title(title)))


def address_only_key(address_normalized: Column, address_raw: Column) -> Column:
    """Key of the address without a unit; null without a digit in it."""
    return once(address_key(F.coalesce(address_normalized, address_raw)), lambda key: F.when(key.rlike("[0-9]"), key))


def title_key(title: Column, price: Column, neighborhood: Column) -> Column:
    """Title, price and neighbourhood in one key; null if one is missing or the title is short."""
    from hearthlake.functions.scalars import plain_number

    clean = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    return F.when((F.length(clean) >= 8) & (neighborhood != ""), F.concat(clean, F.lit("|"), plain_number(price), F.lit("|"), F.lower(neighborhood)))


def html_to_text(html: Column) -> Column:
    """Readable text of HTML; null if nothing is left."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(p|div|li|h[1-6])>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, value in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(value))
    text = F.regexp_replace(text, "&#0?39;|&apos;", "'")
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, " *\n *", "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return blank_to_null(F.regexp_replace(text, r"^\s+|\s+$", ""))


def lease_term_months(raw: Column) -> Column:
    text = F.lower(raw)
    return F.when(matches(text, MONTH_TO_MONTH), F.lit(1)).otherwise(within(group(text, LEASE_MONTHS).cast("int"), 1, 36))


def street_ordinals(address: Column) -> Column:
    """Ordinal words up to twenty as digits, whole words only."""
    for word, digits in ORDINALS.items():
        address = F.regexp_replace(address, pattern(rf"(?i)\b{word}\b"), digits)
    return address


def geocode_key(address: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(address), r"[^a-z0-9\s]", " "), r"\s+", " "))


def geocode_precision(address_type: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PRECISIONS), address_type), F.lit("block"))


def junk_address(address: Column) -> Column:
    """Whether an address is the label of a map link."""
    return matches(F.lower(F.trim(address)), r"^\(?\s*google map")


def bedrooms_from_unit_type(raw: Column) -> Column:
    text = F.lower(raw)
    return F.when(matches(text, r"studio|\bsro\b"), F.lit(0)).otherwise(group(text, r"(\d+)\s*(?:br|bed)").cast("int"))


def split_amenities(raw: Column) -> Column:
    """Items between tildes or carets."""
    return F.filter(F.transform(F.split(raw, r"[~^]"), lambda x: F.trim(x)), lambda x: x != "")


def info_parts(raw: Column) -> Column:
    """Parts of a line that is divided by backslashes or double slashes."""
    return F.filter(F.transform(F.split(raw, r"\\|//"), lambda x: F.trim(x)), lambda x: x != "")


def listing_id_from_url(url: Column) -> Column:
    """Nine digits or more before .html, else the last part of the path."""
    return F.coalesce(group(url, r"(\d{9,})\.html"), group(url, r"([^/?#]+)/?(?:[?#].*)?$"))


def sentinel_to_null(text: Column) -> Column:
    """Null for blank text and for the words that stand for nothing."""
    clean = F.trim(text)
    return F.when(~clean.isin("None", "null", "") & clean.isNotNull(), clean)
