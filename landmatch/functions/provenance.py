"""Where data come from: display names, grouping keys, freshness and decisions on reuse, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landmatch.functions.web import licence_of

# Datasets that say nothing, and parameters that name one.
GENERIC_DATASETS = ["", "GeoJSON", "WFS GML"]
HINT_PARAMETERS = ("typeNames", "TYPENAMES", "typeName", "TYPENAME")
#: The profile prefix and group key of a product that areas reach in several ways, and where it is served.
PRODUCT_PREFIX, PRODUCT_KEY = "bkg_vg25_", "preset:bkg_vg25"
PRODUCT_PLACES = {"daten.gdz.bkg.bund.de": "vg25_ebenen", "sgx.geodatenzentrum.de": "wfs_vg25"}


def filled(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def url_hint(url: Column) -> Column:
    """The dataset that an address names: a type parameter, else what follows ``collections`` or ``datasets`` in its path."""
    asked = [filled(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(p)))) for p in HINT_PARAMETERS]
    below = [F.nullif(F.regexp_extract(F.coalesce(part(url, "PATH"), F.lit("")), f"/{name}/+([^/]+)", 1), F.lit("")) for name in ("collections", "datasets")]
    return F.coalesce(*asked, *below)


def source_name(provider: Column, dataset: Column, layer: Column, public_url: Column, download_url: Column) -> Column:
    """How a source is shown: by host and dataset if it is fetched over HTTP, else by provider, dataset and layer, else by its address."""
    p, d, ly = (F.coalesce(c, F.lit("")) for c in (provider, dataset, layer))
    url = F.coalesce(F.nullif(public_url, F.lit("")), F.nullif(download_url, F.lit("")))
    host, hint = F.nullif(part(url, "HOST"), F.lit("")), url_hint(url)
    named = lambda head, *rest: F.concat(head, F.lit(" ("), F.concat_ws(", ", *rest), F.lit(")"))
    by_host = F.when(hint.isNotNull(), named(host, hint)).when(d.isin(GENERIC_DATASETS), host).otherwise(named(host, d))
    return (
        F.when((p == "HTTP") & host.isNotNull(), by_host)
        .when((p != "") & (d != "") & (ly != ""), named(p, d, ly))
        .when((p != "") & (d != ""), named(p, d))
        .when(p != "", p).when(d != "", d)
        .otherwise(url)
    )


def absolute_url(text: Column) -> Column:
    """A trimmed absolute address with its host in lower case and at least a slash as path; null for anything else."""
    url = F.trim(text)
    tail = lambda mark, name: F.coalesce(F.concat(F.lit(mark), part(url, name)), F.lit(""))
    path = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    return F.when(part(url, "HOST").isNotNull(), F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")), path, tail("?", "QUERY"), tail("#", "REF")))


def source_group(mode: Column, profile: Column, download_url: Column, area: Column, missing: str = "download:missing:") -> Column:
    """The key under which areas of one official source are shown together; an area without a source is alone."""
    url = absolute_url(download_url)
    host, path = F.lower(part(url, "HOST")), F.lower(part(url, "PATH"))
    product = F.lit(False)
    for name, piece in PRODUCT_PLACES.items():
        product = product | ((host == name) & path.contains(piece))
    by_profile = F.when(profile.startswith(PRODUCT_PREFIX), PRODUCT_KEY).otherwise(F.concat(F.lit("preset:"), profile))
    return F.when(mode == "profile", by_profile).when(product, PRODUCT_KEY).when(url.isNotNull(), F.concat(F.lit("download:"), url)).otherwise(F.concat(F.lit(missing), area))


def provenance_record(previous: Column, configured: Column, url: Column, form: Column, crs: Column) -> Column:
    """A download's metadata: each field as it was, else as configured, else as its host implies, else a plain word.

    previous and configured: structs of layer, provider, dataset, public_url, download_url, licence, licence_url, compatible, note.
    """
    implied = licence_of(url)
    either = lambda name, *more: F.coalesce(previous[name], configured[name], *more).alias(name)
    return F.struct(
        either("layer"), either("provider", F.lit("HTTP")), either("dataset", F.when(form == "geojson", "GeoJSON").otherwise("WFS GML")), either("public_url"), either("download_url", url),
        either("licence", implied["id"], F.lit("unknown")), either("licence_url", implied["source"]), either("compatible", implied["compatible"], F.lit("unknown")),
        either("note", F.when(F.length(crs) > 0, F.concat(F.lit("Declared CRS: "), crs))),
    )


def freshness(updated: Column, published: Column, downloaded: Column) -> Column:
    """(primary, secondary): the date that tells how fresh a source is, and the download beside it if it is another one."""
    own = F.coalesce(filled(updated), filled(published))
    return F.struct(F.coalesce(own, filled(downloaded)).alias("primary"), F.when(own.isNotNull(), filled(downloaded)).alias("secondary"))


def reuse_decision(force: Column, exists: Column, known: Column, resolved: Column, downloaded: Column) -> Column:
    """(decision, reason, action): a stored geometry is used again if its source's date is the known one and its download is dated."""
    same = F.coalesce(F.trim(known) == F.trim(resolved), F.lit(False))
    reuse = ~force & exists & same & filled(downloaded).isNotNull()
    decision = F.when(reuse, "hit").when(force, "forced-refresh").when(same, "miss").otherwise("stale")
    reason = F.when(reuse, "source_updated_at_unchanged").when(force, "force_flag").when(~exists, "missing_geometry").otherwise("source_updated_at_changed")
    return F.struct(decision.alias("decision"), reason.alias("reason"), F.when(reuse, "reuse").otherwise("refresh").alias("action"))


def branch_status(status: Column, used_cache: Column, step: Column) -> Column:
    fine = (status == "ok") | ((status == "skipped") & used_cache)
    return F.when(fine, "success").when(step.startswith("compare:"), "compare_failed").otherwise("failed_no_cache")


def download_alert(status: Column, origin: Column, streak: Column) -> Column:
    """failed, fallback, streak_warning from two fallbacks in a row on, or null."""
    n = F.coalesce(streak, F.lit(0))
    fallback = F.coalesce(origin == "fallback_artifact", F.lit(False)) | (n > 0)
    return F.when(status == "failed_no_cache", "failed").when(fallback, F.when(n >= 2, "streak_warning").otherwise("fallback"))


def likely_wfs(url: Column) -> Column:
    return F.lower(url).rlike("service=wfs|request=getfeature|/wfs")
