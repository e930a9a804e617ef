"""Column builders that bring raw text fields to their canonical form; scores.

Each returns null where the text does not qualify; blank counts as missing.
Only ASCII digits are digits; nan, inf and 1_000 are not numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field, rule, error code, whether it may be missing, by dataset.
PLANS: dict[str, list[tuple[str, str, str, bool]]] = {
    "FIR": [("fir_id", "text", "INVALID_RECORD_STRUCTURE", False), ("date", "date", "INVALID_TIMESTAMP", False), ("police_station", "text", "INVALID_RECORD_STRUCTURE", True), ("text", "text", "INVALID_RECORD_STRUCTURE", False), ("source", "upper", "INVALID_RECORD_STRUCTURE", True)],
    "CDR": [("cdr_id", "text", "INVALID_RECORD_STRUCTURE", False), ("caller", "phone", "INVALID_PHONE_NUMBER", False), ("receiver", "phone", "INVALID_PHONE_NUMBER", False), ("timestamp", "timestamp", "INVALID_TIMESTAMP", False), ("duration", "integer", "INVALID_NUMERIC_VALUE", False)],
    "TRANSACTION": [("transaction_id", "text", "INVALID_RECORD_STRUCTURE", False), ("sender_account", "account", "INVALID_RECORD_STRUCTURE", False), ("receiver_account", "account", "INVALID_RECORD_STRUCTURE", False), ("amount", "amount", "INVALID_NUMERIC_VALUE", False), ("currency", "upper", "INVALID_RECORD_STRUCTURE", False), ("timestamp", "timestamp", "INVALID_TIMESTAMP", False)],
    "VEHICLE": [("vehicle_id", "text", "INVALID_RECORD_STRUCTURE", False), ("registration_number", "vehicle", "INVALID_VEHICLE_NUMBER", False), ("owner_name", "text", "INVALID_RECORD_STRUCTURE", False), ("source", "upper", "INVALID_RECORD_STRUCTURE", True)],
    "LOCATION": [("location_id", "text", "INVALID_RECORD_STRUCTURE", False), ("name", "text", "INVALID_RECORD_STRUCTURE", False), ("latitude", "latitude", "INVALID_NUMERIC_VALUE", True), ("longitude", "longitude", "INVALID_NUMERIC_VALUE", True)],
}
# Match keys derived from a field, by dataset.
DERIVED = {"VEHICLE": [("owner_normalized", "owner_name")], "LOCATION": [("name_normalized", "name")]}
ID_PATTERN = "^[A-Za-z0-9_-]{1,64}$"
_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"


# White space: ASCII blanks and controls and all Unicode spaces, as a set of characters, and these characters themselves.
_WS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"^[{_WS}]+|[{_WS}]+$", "")


def trim(c: Column) -> Column:
    """strip(), of which only the ends are looked at: for fields of any length."""
    return F.btrim(c, F.lit(_SPACES))


def _single_spaced(t: Column) -> Column:
    # printable ASCII without two blanks in a row stays as it is; telling so takes two ranges, not the whole set
    return F.when(~t.rlike("[^ -~]|  "), t).otherwise(F.regexp_replace(t, f"[{_WS}]+", " "))


def whitespace(c: Column) -> Column:
    return _single_spaced(trim(c))


def name_key(c: Column) -> Column:
    return F.lower(whitespace(c))


def _only(t: Column, pattern: str) -> Column:
    """The pattern's group if the whole text matches, else null."""
    return F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))


def _phone(t: Column) -> Column:
    return F.concat(F.lit("+91"), _only(F.regexp_replace(t, f"[{_WS}\\-().]", ""), r"^\+?(?:91)?(\d{10})$"))


def _vehicle(t: Column) -> Column:
    return _only(F.upper(F.regexp_replace(t, f"[{_WS}\\-]", "")), r"^([A-Z]{2}\d{2}[A-Z]{2}\d{4})$")


def _account(t: Column) -> Column:
    return _only(F.upper(F.regexp_replace(t, f"[{_WS}\\-]", "")), "^([A-Z0-9]{3,32})$")


_PLAIN = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2}):(\d{1,2})|T(\d{1,2}):(\d{1,2}))?$"
_ISO = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,]\d+)?)?)?(?:([+-]\d{2}):?(\d{2})?(?::?(\d{2}))?)?)?$"


def _timestamp(t: Column) -> Column:
    t = strip(F.regexp_replace(t, "Z$", ""))
    padded = F.regexp_replace(t, r"(?<=[-T :])(\d)(?=[-T :]|$)", "0$1")
    # parts that a text lacks leave bare colons, which become zeros or go
    parts = F.regexp_replace(F.regexp_replace(t, _ISO, "$1-$3-$4T$5:$7:$8 $9:$10:$11"), "(?:T::)? ::$", "")
    iso = F.regexp_replace(F.regexp_replace(parts, "(?<=:)(?=:| |$)", "00"), " ", "")
    return F.date_format(F.try_to_timestamp(F.when(t.rlike(_PLAIN), padded).when(t.rlike(_ISO), iso)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _date(t: Column) -> Column:
    return F.substring(_timestamp(t), 1, 10)


def _number(t: Column) -> Column:
    return _only(t, _NUMBER).try_cast("double")


def _amount(t: Column) -> Column:
    n = _number(strip(F.regexp_replace(t, ",", "")))
    return F.when(n >= 0, n)


def _integer(t: Column) -> Column:
    n = _only(t, r"^([+-]?\d+)$").try_cast("bigint")
    return F.when(n >= 0, n)


def _within(t: Column, most: int) -> Column:
    n = _number(t)
    return F.when(n.between(-most, most), n)


#: By rule, the normal form of a text without white space at its ends.
OF_STRIPPED = {
    "text": _single_spaced, "upper": lambda t: F.upper(_single_spaced(t)), "phone": _phone, "vehicle": _vehicle, "account": _account, "timestamp": _timestamp, "date": _date,
    "amount": _amount, "integer": _integer, "latitude": lambda t: _within(t, 90), "longitude": lambda t: _within(t, 180),
}


def phone(c: Column) -> Column:
    return _phone(strip(c))


def vehicle(c: Column) -> Column:
    return _vehicle(strip(c))


def account(c: Column) -> Column:
    return _account(strip(c))


def timestamp(c: Column) -> Column:
    """ISO text in UTC to the second, of dates and times with year, month and
    day in that order; offsets are taken off, fractions cut, one Z at the end
    is ignored. The session time zone must be UTC."""
    return _timestamp(strip(c))


def date(c: Column) -> Column:
    return F.substring(timestamp(c), 1, 10)


def amount(c: Column) -> Column:
    return _amount(strip(c))


def integer(c: Column) -> Column:
    return _integer(strip(c))


def latitude(c: Column) -> Column:
    return _within(strip(c), 90)


def longitude(c: Column) -> Column:
    return _within(strip(c), 180)


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{_WS}]")


def score(c: Column) -> Column:
    """A finite score in [0, 1]; anything else is 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def severity(c: Column) -> Column:
    return F.when(c >= 0.8, "HIGH").when(c >= 0.5, "MEDIUM").otherwise("LOW")


def edge_id(src: Column, kind: Column, dst: Column, key: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", src, kind, dst, key), 256), 1, 16))


def reasons(features: dict[str, Column], medians: dict[str, Column]) -> Column:
    """Texts of the features that stand out against their medians."""
    # Feature, floor, multiple of the median, text.
    rules = [
        ("calls_per_day", 2.0, 2, "Communication spike"),
        ("unique_contacts", 5.0, 2, "High number of unique contacts"),
        ("night_calls", 3.0, 2, "Unusual night-call activity"),
        ("transaction_amount", 100000.0, 3, "Large transaction activity"),
        ("transaction_count", 5.0, 2, "Unusual transaction frequency"),
        ("location_changes", 3.0, 2, "Unusual location changes"),
        ("unique_locations", 4.0, 2, "High location diversity"),
    ]
    return F.array_compact(F.array(*[F.when((features[k] > 0) & (features[k] >= F.greatest(F.lit(low), medians[k] * times)), text) for k, low, times, text in rules]))


def priority(pagerank: Column, betweenness: Column, anomaly: Column) -> Column:
    return F.round(0.35 * score(pagerank) + 0.35 * score(betweenness) + 0.30 * score(anomaly), 4)


def priority_100(pagerank: Column, betweenness: Column, anomaly: Column) -> Column:
    """The priority as a whole number from 0 to 100."""
    return F.round(priority(pagerank, betweenness, anomaly) * 100).cast("int")


def score_reasons(pagerank: Column, betweenness: Column, anomaly: Column, high_degree: Column | None = None, community_size: Column | None = None) -> Column:
    """Texts of the parts of a score that are high."""
    # Threshold and text of each part.
    rules = [
        (pagerank >= 0.7, "High structural importance in the network"),
        (betweenness >= 0.7, "Acts as a bridge between network groups"),
        (anomaly >= 0.7, "Unusual activity pattern"),
        (F.lit(False) if high_degree is None else high_degree, "Highly connected entity"),
        (F.lit(False) if community_size is None else community_size >= 3, "Connected to a dense network group"),
    ]
    return F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))


def shown_score(c: Column) -> Column:
    """Two decimals; a dash where there is no number."""
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.format_string("%.2f", c))


def shown_percent(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.concat(F.round(c * 100).cast("long").cast("string"), F.lit("%")))


def shown_integer(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_number(c, 0))


# Fixed value: words before a name that say a role.
ROLE_WORDS = r"^(?:complainant|accused|victim|witness|informant|suspect)s?\b\s+"


def clean_person(c: Column) -> Column:
    """A name without a leading role word and marks at its ends; null if under
    2 or over 256 characters are left."""
    name = F.btrim(F.regexp_replace(strip(c), f"(?i){ROLE_WORDS}", ""), F.lit(" ,."))
    return F.when(F.length(name).between(2, 256), name)
