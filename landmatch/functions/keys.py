"""Identifier normalisation as column expressions. Keys stay strings: leading zeros count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESETS = ("regional-12", "amtlicher-8", "plz-5", "berlin-bezirk-rs5", "text")


def raw_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def digits(value: Column) -> Column:
    return F.regexp_replace(raw_text(value), "[^0-9]", "")


def last_digits(value: Column, n: int) -> Column:
    """Digits padded on the left to n, then the last n; no digits give n zeros."""
    d = digits(value)
    return F.right(F.lpad(d, F.greatest(F.lit(n), F.length(d)), F.lit("0")), F.lit(n))


def postal_code(d: Column) -> Column:
    return F.when(d == "", "").otherwise(F.lpad(d, 5, "0"))


def berlin_district(d: Column) -> Column:
    """State and district of five digits with the fixed middle of the eight-digit key; other lengths raise."""
    return F.when(F.length(d) == 5, F.concat(F.substring(d, 1, 2), F.lit("000"), F.substring(d, 3, 3))).otherwise(F.raise_error(F.concat(F.lit("not a 5-digit district: "), d)))


def text_key(value: Column) -> Column:
    squeezed = F.regexp_replace(raw_text(value), r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(squeezed, r"(?U)\s+", " "))


def regional(d: Column) -> Column:
    """Twelve digits: longer keys are cut, shorter ones padded on the right."""
    return F.when(d == "", "").otherwise(F.rpad(d, 12, "0"))


def hierarchy(key: Column) -> Column:
    """State, region, district and municipality parts of a 12-digit key."""
    part = lambda name, at, n: F.substring(key, at, n).alias(name)
    return F.struct(part("land", 1, 2), part("region", 3, 1), part("district", 4, 2), part("municipality", 6, 3))


def explorer_hierarchy(key: Column) -> Column:
    """All five parts of a 12-digit key, the association's four digits included."""
    part = lambda name, at, n: F.substring(key, at, n).alias(name)
    return F.struct(part("land", 1, 2), part("region", 3, 1), part("district", 4, 2), part("association", 6, 4), part("municipality", 10, 3))


def municipality_key(regional_key: Column) -> Column:
    """The 8-digit municipality key inside a 12-digit regional key."""
    return F.concat(F.substring(regional_key, 1, 5), F.substring(regional_key, 10, 3))


def osm_key(value: Column, preset: str) -> Column:
    d = digits(value)
    if preset == "berlin-bezirk-rs5":
        return F.when(F.length(d) == 5, berlin_district(d)).otherwise(d)
    if preset == "amtlicher-8":
        return last_digits(value, 8)
    if preset == "regional-12":
        return regional(d)
    if preset == "plz-5":
        return postal_code(d)
    if preset == "text":
        return text_key(value)
    raise ValueError(f"unknown preset {preset}")


def osm_notes(value: Column, preset: str) -> Column:
    d = digits(value)
    n = F.length(d)
    notes = {
        "berlin-bezirk-rs5": [
            F.when(n == 5, "berlin-5-digit→8-digit-rs"),
            F.when(n == 8, "already-8-digit"),
            F.when(~n.isin(5, 8), F.concat(F.lit("unexpected-digit-length:"), n.cast("string"))),
        ],
        "regional-12": [F.when((n > 0) & (n < 12), "regional-12-padded")],
        "plz-5": [F.when(n > 5, "plz-5-truncated"), F.when((n > 0) & (n < 5), "plz-5-left-padded")],
    }.get(preset, [])
    return F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")


#: The preset's name in a normalised value.
LABELS = {"regional-12": "full-12-digit-regional", "amtlicher-8": "8-digit-ags", "plz-5": "plz-5", "berlin-bezirk-rs5": "berlin-bezirk-rs5-canonical", "text": "text"}


def normalize_osm(source_key: str, value: Column, preset: str) -> Column:
    """Everything known about one value: digits, canonical key, hierarchy where it has one, preset label and notes."""
    d, key = digits(value), osm_key(value, preset)
    whole = {"regional-12": F.when(d != "", hierarchy(key)), "amtlicher-8": F.when(F.length(d) == 12, hierarchy(d))}
    none = F.lit(None).cast("struct<land:string,region:string,district:string,municipality:string>")
    return F.struct(
        F.lit(source_key).alias("source_key"),
        raw_text(value).alias("raw"),
        d.alias("digits"),
        key.alias("canonical"),
        whole.get(preset, none).alias("hierarchy"),
        F.lit(LABELS[preset]).alias("preset"),
        osm_notes(value, preset).alias("notes"),
    )


def official_key(value: Column, preset: str) -> Column:
    """The official side keeps its digits as they are unless the preset is a padded or textual one."""
    d = digits(value)
    if preset == "plz-5":
        return postal_code(d)
    if preset == "text":
        return text_key(value)
    plain = F.when(d != "", d).otherwise(F.trim(raw_text(value)))
    return F.when(d != "", regional(d)).otherwise(plain) if preset == "regional-12" else plain


def transposed(value: Column, mapping: dict[str, str], preset: str) -> Column:
    """The mapping's entry, normalised; a value without an entry raises."""
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.trim(raw_text(value))]
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no transposition for "), raw_text(value)))).otherwise(official_key(found, preset))


def check_transposition(source: str | None, target: str | None, mapping: dict[str, str], official_property: str, match_target: str) -> None:
    """Raises unless the transposition names the official property, the match target, and maps to distinct targets."""
    if source is not None and source != official_property:
        raise ValueError("the transposition's source is not the official property")
    if target is not None and target != match_target:
        raise ValueError("the transposition's target is not the match property")
    if not mapping:
        raise ValueError("the transposition is empty")
    if any(not k.strip() or not v.strip() for k, v in mapping.items()):
        raise ValueError("the transposition has an empty entry")
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("two entries share a target")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def relation_id(at_id: Column, osm_id: Column) -> Column:
    """A relation's id: digits or ``relation/n`` in the typed id, else a negative plain id. A positive plain id is none."""
    typed = F.regexp_extract(F.coalesce(at_id, F.lit("")), r"^(?:relation/)?([0-9]+)$", 1)
    plain = osm_id.try_cast("bigint")
    return F.coalesce(F.nullif(typed, F.lit("")), F.when(plain < 0, (-plain).cast("string")))


def candidate_ref(way_id: Column, osm_id: Column) -> Column:
    """(osm_type, osm_id) of a candidate: its way if it has one, else a relation; ids are positive, null where neither is a whole number."""
    way, rel = (F.abs(blank_to_null(c.cast("string")).try_cast("bigint")) for c in (way_id, osm_id))
    ref = lambda kind, x: F.struct(F.lit(kind).alias("osm_type"), x.alias("osm_id"))
    return F.when(way != 0, ref("way", way)).when(rel != 0, ref("relation", rel))


def bucket_relation_id(feature_ids: Column, fallback: Column) -> Column:
    """A group's relation: its first relation id, else what its properties say, else its first id, else blank."""
    first = F.get(F.filter(feature_ids, lambda x: x.startswith("relation/")), F.lit(0))
    return F.coalesce(F.regexp_replace(first, "^relation/", ""), fallback, F.get(feature_ids, F.lit(0)), F.lit(""))


def object_ref(value: Column) -> Column:
    """A positive relation id written as digits or ``relation/n``, else null."""
    n = F.regexp_extract(F.trim(raw_text(value)), r"^(?:relation/)?([0-9]+)$", 1).try_cast("bigint")
    return F.when(n > 0, n)


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a over the characters, as eight hex digits."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: ((h.bitwiseXOR(c)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))


def file_stem(key: Column) -> Column:
    """A key as a file name of lower-case letters, digits, - and _; what is empty then is named by its hash."""
    clean = F.regexp_replace(F.lower(key), "[^a-z0-9_-]+", "_")
    bare = F.regexp_replace(clean, "^_+|_+$", "")
    return F.when(bare == "", F.concat(F.lit("key_"), fnv1a(key))).otherwise(bare)


def uri_component(value: Column) -> Column:
    """Percent encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def is_digit_heavy(value: Column) -> Column:
    t = F.trim(raw_text(value))
    return (t != "") & ~t.rlike("[a-zA-ZäöüÄÖÜß]") & t.rlike(r"^[0-9\s/.-]+$") & t.rlike("[0-9]")


def path_match(value: Column) -> Column:
    """Trimmed, without one trailing slash; a slash alone stays."""
    return F.regexp_replace(F.trim(value), "(?<=.)/$", "")


def licence_fingerprint(*parts: Column) -> Column:
    """Parts joined by the unit separator; a null part is an empty one."""
    return F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts])


def postal_bucket(value: Column) -> Column:
    """Last digit, 0 without any."""
    return F.coalesce(F.right(digits(value), F.lit(1)).try_cast("int"), F.lit(0))


def link_value(value: Column) -> Column:
    """A text or number that can be looked up: trimmed, with a digit in it; otherwise null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike("[0-9]"), text)
