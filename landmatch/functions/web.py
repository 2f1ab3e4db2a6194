"""Texts of live queries and what is read from their answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landmatch.functions.dates import iso_instant

MAX_QUERY = 48_000


def plain_number(value: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def wfs_url(base: Column, layer: Column, version: Column, box: tuple[Column, ...], count: int = 50, srs: Column | None = None, axis: Column | None = None, output_format: Column | None = None) -> Column:
    """A GetFeature request with form encoding. Version 2.0.0 takes EPSG:4326 corners latitude first, unless axis says otherwise; any other version is 1.1.0."""
    w, s, e, n = (plain_number(c) for c in box)
    none = F.lit(None).cast("string")
    new = F.coalesce(version == "2.0.0", F.lit(False))
    name = F.coalesce(none if srs is None else srs, F.lit("EPSG:4326"))
    degrees = new & (name == "EPSG:4326")
    order = F.coalesce(none if axis is None else axis, F.when(degrees, "latlon").otherwise("lonlat"))
    corners = F.when(order == "lonlat", F.concat_ws(",", w, s, e, n)).otherwise(F.concat_ws(",", s, w, n, e))
    crs = F.when(degrees, "urn:ogc:def:crs:EPSG::4326").otherwise(name)
    form = F.nullif(F.trim(none if output_format is None else output_format), F.lit(""))
    return F.concat(
        base, F.lit("?service=wfs&version="), F.when(new, "2.0.0").otherwise("1.1.0"), F.lit("&request=GetFeature"),
        F.when(new, "&typeNames=").otherwise("&typeName="), F.url_encode(layer), F.lit("&bbox="), F.url_encode(F.concat(corners, F.lit(","), crs)),
        F.when(new, "&count=").otherwise("&maxFeatures="), F.lit(str(count)), F.lit("&srsName="), F.url_encode(name),
        F.coalesce(F.concat(F.lit("&outputFormat="), F.url_encode(form)), F.lit("")),
    )


#: What each live query asks for inside its box, and in which form.
OVERPASS_PARTS = {
    "administrative": (('relation["boundary"="administrative"]', 'way["boundary"="administrative"]'), "geom"),
    "postal_code": (('relation["boundary"="postal_code"]', 'way["boundary"="postal_code"]'), "geom"),
    "addr_postcode": (('node["addr:postcode"]', 'way["addr:postcode"]'), "center"),
}


def overpass_query(kind: str, box: tuple[Column, ...]) -> Column:
    """Boundaries of one kind, or postal addresses, inside a box (west, south, east, north)."""
    w, s, e, n = (plain_number(c) for c in box)
    parts, form = OVERPASS_PARTS[kind]
    area = F.concat(F.lit("("), F.concat_ws(",", s, w, n, e), F.lit(");\n"))
    lines = [x for part in parts for x in (F.lit(f"  {part}"), area)]
    return F.concat(F.lit("[out:json][timeout:90];\n(\n"), *lines, F.lit(f");\nout {form};"))


def relation_tags_query(relation: Column) -> Column:
    return F.concat(F.lit("[out:json][timeout:25];\nrelation("), relation.cast("string"), F.lit(");\nout tags;"))


def may_send(host: Column, query: Column, allowed: list[str]) -> Column:
    return host.isin(allowed) & (F.length(query) <= MAX_QUERY)


OVERPASS_SCHEMA = "elements array<struct<type:string,id:bigint,tags:map<string,string>>>"


def overpass_hits(body: Column) -> Column:
    """(type, id, tags) of the relations and ways of an answer; an element without tags has none."""
    found = F.filter(F.from_json(body, OVERPASS_SCHEMA).elements, lambda e: e["type"].isin("relation", "way"))
    return F.transform(found, lambda e: F.struct(e["type"].alias("type"), e["id"].alias("id"), F.coalesce(e["tags"], F.create_map().cast("map<string,string>")).alias("tags")))


def object_identity(properties: Column) -> Column:
    """(type, id, label) of a rendered feature from its JSON properties, null where no field gives an id.

    The id is the first of relation_id, way_id, @id, id (each a number, or text like ``way/5``) and osm_id. The type is
    that of @type, else of a typed @id or id, else a type field of relation or way, else that of the id's own field.
    """
    doc = F.try_parse_json(properties)
    part = lambda f: F.try_variant_get(doc, f'$["{f}"]', "variant")
    is_text = lambda f: F.schema_of_variant(part(f)) == "STRING"
    text = lambda f: F.when(is_text(f), F.try_variant_get(doc, f'$["{f}"]', "string"))
    number = lambda f: F.when(~is_text(f), F.try_variant_get(doc, f'$["{f}"]', "bigint"))
    typed = lambda f, k: F.nullif(F.regexp_extract(F.coalesce(F.trim(text(f)), F.lit("")), "^(relation|way|node)/([0-9]+)$", k), F.lit(""))
    ref = lambda f: F.coalesce(typed(f, 2).try_cast("bigint"), number(f))
    kind = F.coalesce(text("@type"), typed("@id", 1), typed("id", 1), F.when(text("type").isin("relation", "way"), text("type")))
    found = F.coalesce(number("relation_id"), number("way_id"), ref("@id"), ref("id"), number("osm_id"))
    relation = F.coalesce(number("relation_id"), F.when(kind == "relation", found))
    way = F.coalesce(number("way_id"), F.when(kind == "way", found))
    label = F.coalesce(F.nullif(F.trim(text("label")), F.lit("")), F.coalesce(relation, way, found).cast("string"))
    known = F.coalesce(kind, F.when(relation.isNotNull(), "relation").otherwise("way"))
    return F.when(found.isNotNull(), F.struct(known.alias("type"), F.coalesce(relation, way, found).alias("id"), label.alias("label")))


def wfs_exception(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, r"(?s)<(?:\w+:)?ExceptionText>\s*(.*?)\s*</", 1)), F.lit(""))


def xml_unescape(text: Column) -> Column:
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, f"(?i){code}", char)
    return text


#: Named characters of German pages.
ENTITIES = {"&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&szlig;": "ß", "&nbsp;": " "}


def reference_date(html: Column) -> Column:
    """The day that a page gives after its label of the data's state, as YYYY-MM-DD. Only the ranges of day and month are checked."""
    for code, char in ENTITIES.items():
        html = F.regexp_replace(html, f"(?i){code}", char)
    d, m, y = (F.regexp_extract(html, r"(?iu)Aktualit(?:ä|auml;|ae)tsstand:\s*(\d{1,2})\.(\d{1,2})\.(\d{4})", k) for k in (1, 2, 3))
    fits = d.try_cast("int").between(1, 31) & m.try_cast("int").between(1, 12)
    return F.when(fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def metadata_dates(xml: Column) -> Column:
    """(updated, published) of an ISO 19139 record, normalised: the last revision, else the stamp; the first publication or creation."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)(<gmd:CI_Date\b.*?</gmd:CI_Date>)"), F.lit(1))
    dates = F.transform(blocks, lambda x: F.struct(iso_instant(F.regexp_extract(x, r"(?i)<gco:Date(?:Time)?\b[^>]*>([^<]+)<", 1)).alias("day"), F.lower(F.trim(F.regexp_extract(x, r"""(?i)codeListValue=['"]([^'"]+)['"]""", 1))).alias("kind")))
    of = lambda kinds, at: F.try_element_at(F.filter(dates, lambda x: x["kind"].isin(kinds) & x["day"].isNotNull()), F.lit(at))["day"]
    stamp = iso_instant(F.regexp_extract(xml, r"(?is)<gmd:dateStamp\b.*?<gco:Date(?:Time)?\b[^>]*>([^<]+)<", 1))
    return F.struct(F.coalesce(of(["revision"], -1), stamp).alias("updated"), of(["publication", "creation"], 1).alias("published"))


#: Tag names of capabilities documents that tell of publication and of updates.
PUBLISHED_TAGS = "publication|published|issued|creation"
UPDATED_TAGS = "revision|modified|updated|lastupdate|datestamp|metadatadate"


def capabilities_dates(xml: Column) -> Column:
    """(updated, published): the first date in a leaf whose tag tells of either; a plain ``date`` counts as updated if it comes before both."""
    leaves = F.regexp_extract_all(xml, F.lit(r"(<(?:\w+:)?\w+[^<>]*>[^<>]+</(?:\w+:)?\w+>)"), F.lit(1))
    part = lambda x, k: F.regexp_extract(x, r"<(?:\w+:)?(\w+)[^<>]*>([^<>]+)</(?:\w+:)?(\w+)>", k)
    read = F.transform(leaves, lambda x: F.struct(F.lower(part(x, 1)).alias("tag"), F.lower(part(x, 3)).alias("end"), iso_instant(part(x, 2)).alias("day")))
    dated = F.filter(read, lambda x: (x["tag"] == x["end"]) & x["day"].isNotNull())
    first = lambda rule: F.get(F.filter(dated, rule), F.lit(0))["day"]
    published = first(lambda x: x["tag"].rlike(PUBLISHED_TAGS))
    lead = F.get(F.filter(dated, lambda x: x["tag"].rlike(f"{PUBLISHED_TAGS}|{UPDATED_TAGS}") | (x["tag"] == "date")), F.lit(0))
    updated = F.when(lead["tag"] == "date", lead["day"]).otherwise(first(lambda x: x["tag"].rlike(UPDATED_TAGS)))
    return F.struct(updated.alias("updated"), published.alias("published"))


def interval_end(body: Column) -> Column:
    return F.get_json_object(body, "$.extent.temporal.interval[0][1]")


def capabilities_url(url: Column) -> Column:
    """The GetCapabilities request of a service's address; its version parameter stays."""
    version = F.nullif(F.trim(F.parse_url(url, F.lit("QUERY"), F.lit("version"))), F.lit(""))
    return F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?service=WFS&request=GetCapabilities"), F.coalesce(F.concat(F.lit("&version="), F.url_encode(version)), F.lit("")))


def collection_url(items: Column) -> Column:
    """The address of the collection that an address below it names, null where it names none."""
    return F.nullif(F.regexp_extract(items, r"^([a-z]+://[^/?#]+[^?#]*?/collections/[^/?#]+)", 1), F.lit(""))


def metadata_url(capabilities: Column) -> Column:
    """The address of the metadata record that a capabilities document names."""
    found = F.regexp_extract(capabilities, r"(?i)<inspire_common:URL>\s*([^<]+)\s*</inspire_common:URL>", 1)
    return F.nullif(F.trim(xml_unescape(found)), F.lit(""))


#: Words of errors that pass.
PASSING = "unable to connect|connectionrefused|connection reset|timed out|econnrefused|econnreset|network"


def transient(message: Column) -> Column:
    """Whether an error is worth another attempt."""
    return F.lower(message).rlike(PASSING)


def row_key(source: Column, kind: Column, ident: Column, index: Column) -> Column:
    """``src:type:id``; features without an id are numbered from 1."""
    return F.concat_ws(":", source, kind, F.coalesce(F.nullif(F.trim(ident), F.lit("")), index.cast("string")))


def editor_zoom(w: Column, s: Column, e: Column, n: Column) -> Column:
    span = F.greatest(e - w, n - s, F.lit(1e-9))
    return F.least(F.greatest(F.floor(14 - F.log2(span * 45) + 0.5), F.lit(11)), F.lit(18)).cast("int")


#: Addresses of the editors, and what the web editor hides.
WEB_EDITOR, REMOTE_CONTROL, OBJECT_PAGE = "https://ideditor.netlify.app/", "http://127.0.0.1:8111", "https://www.openstreetmap.org/relation/"
HIDDEN = "address_points,points,service_roads,paths,buildings,building_parts,indoor,landuse,rail,pistes,aerialways,power,past_future"


def component(text: Column) -> Column:
    """A text as part of an address, as browsers encode it."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def editor_links(box: tuple[Column, Column, Column, Column], relation: Column, geojson: Column, hashtag: str) -> Column:
    """(edit, browse, load, import) addresses of a row: the web editor at the row's place, the object's page, and two calls of the desktop editor's remote control.

    box: west, south, east, north, null without a place; relation: number or null; geojson: address of the official
    shape or null. The changeset's hashtag is the caller's.
    """
    w, s, e, n = box
    view = F.when(w.isNotNull(), F.concat(editor_zoom(w, s, e, n).cast("string"), F.lit("/"), F.format_string("%.6f", (s + n) / 2), F.lit("/"), F.format_string("%.6f", (w + e) / 2)))
    pair = lambda name, value: F.concat(F.lit(f"{name}="), F.url_encode(value))
    ident = F.concat(F.lit("r"), relation.cast("string"))
    anchor = F.concat_ws("&", pair("map", view), pair("id", ident), pair("disable_features", F.lit(HIDDEN)), pair("gpx", geojson), pair("hashtags", F.lit(hashtag)))
    tagged = F.concat(F.lit("changeset_hashtags="), component(F.lit(hashtag)))
    return F.struct(
        F.concat(F.lit(f"{WEB_EDITOR}#"), anchor).alias("edit"), F.concat(F.lit(OBJECT_PAGE), component(relation.cast("string"))).alias("browse"),
        F.concat(F.lit(f"{REMOTE_CONTROL}/load_object?relation_members=true&objects="), ident, F.lit("&"), tagged).alias("load"),
        F.concat(F.lit(f"{REMOTE_CONTROL}/import?new_layer=true&"), tagged, F.lit("&url="), component(geojson)).alias("import"),
    )


def is_postal(preset: Column, boundary: Column) -> Column:
    """Whether a data set is one of postal codes."""
    return F.coalesce(preset == "plz-5", F.lit(False)) | F.coalesce(boundary == "postal_code", F.lit(False))


def map_view(text: Column) -> Column:
    """(zoom, lat, lon) of ``zoom/lat/lon`` within the map's limits, else null. A part may have a tail that is no number."""
    p = F.split(text, "/")
    zoom, lat, lon = (F.regexp_extract(F.trim(F.get(p, F.lit(k))), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double") for k in range(3))
    ok = (F.size(p) == 3) & zoom.between(0, 24) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(zoom.alias("zoom"), lat.alias("lat"), lon.alias("lon")))


def map_view_text(zoom: Column, lat: Column, lon: Column) -> Column:
    """The view as text: zoom to one decimal, place to six, inside the map's limits. Halves go up."""
    up = lambda c, k, low, high: plain_number(F.least(F.greatest(F.floor(c * 10**k + 0.5) / 10**k, F.lit(float(low))), F.lit(float(high))))
    return F.concat_ws("/", up(zoom, 1, 0, 24), up(lat, 6, -90, 90), up(lon, 6, -180, 180))


def duration_text(ms: Column) -> Column:
    minutes, seconds = F.floor(ms / 60_000), F.floor((ms % 60_000) / 1000 + 0.5)
    long = F.when(seconds > 0, F.concat_ws(" ", minutes.cast("string"), F.lit("min"), seconds.cast("string"), F.lit("s"))).otherwise(F.concat_ws(" ", minutes.cast("string"), F.lit("min")))
    return F.when(ms.isNull(), "—").when(ms < 60_000, F.format_string("%.1f s", ms / 1000.0)).otherwise(long)


def placeholder(value: Column, label: str = "—") -> Column:
    """Whether a trimmed value stands for none: blank, the label of an empty property, NAN or dashes."""
    v = F.trim(value)
    return v.isNull() | (v == "") | (v == label) | (F.upper(v) == "NAN") | v.rlike("^-+$")


def licence_of(url: Column) -> Column:
    """(id, source, compatible) that go by the host of a download, null for others."""
    of = lambda ident, source, compatible: F.struct(F.lit(ident).alias("id"), F.lit(source).alias("source"), F.lit(compatible).alias("compatible"))
    by, zero = "https://www.govdata.de/dl-de/by-2-0", "https://www.govdata.de/dl-de/zero-2-0"
    return (
        F.when(url.contains("gdi.berlin.de") | url.contains("daten.berlin.de"), of("dl_de_zero_20", zero, "yes_waiver"))
        .when(url.contains("geobasis-bb.de"), of("dl_de_by_20", by, "yes_waiver"))
        .when(url.contains("api.hamburg.de"), of("dl_de_by_20", by, "no"))
    )


#: Kinds of the files of an area by their place below its folder.
FILE_KINDS = {
    "snapshots.json": "snapshots",
    "output/comparison_table.json": "comparison_table_json",
    "output/comparison.pmtiles": "comparison_pmtiles",
    "output/comparison-diff.pmtiles": "comparison_diff_pmtiles",
    "output/unmatched.pmtiles": "unmatched_pmtiles",
}
FOLDER_KINDS = {"output/features/": "feature_shards", "output/official_for_edit/": "official_for_edit", "output/_build/": "ephemeral_build"}
OBSOLETE_FILES = ["output/comparison_for_report.json", "output/detailed_results.csv", "output/comparison_report.md"]


def file_kind(path: Column) -> Column:
    """The kind of a file ``area/...``."""
    rest = F.regexp_extract(path, "^[^/]+/(.+)$", 1)
    kind = F.when(rest == "", "other")
    for name, label in FILE_KINDS.items():
        kind = kind.when(rest == name, label)
    for folder, label in FOLDER_KINDS.items():
        kind = kind.when(rest.startswith(folder), label)
    return kind.when(rest.isin(OBSOLETE_FILES), "obsolete_legacy").otherwise("other_internal_or_source")
