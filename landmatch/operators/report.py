"""The report's relation: both kinds of rows, filters, sorting, live tags beside expected values, and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmatch.functions.web import placeholder
from landmatch.operators.metrics import diff_polygons

CATEGORIES = ("matched", "official_only", "unmatched_osm")
LEVELS = ("ok", "review", "issue")
#: Official properties, the tag that should hold each, and other tags that may.
EXPECTED_TAGS = {
    "AGS": ("de:amtlicher_gemeindeschluessel",),
    "ARS": ("de:regionalschluessel",),
    "GEN": ("name",),
    "BEZ": ("admin_title", "admin_title:de"),
    "ADE": ("admin_level",),
    "NUTS": ("ref:nuts:3", "ref:nuts"),
}
#: Admin levels of the official levels.
ADMIN_LEVELS = {"1": ["2"], "2": ["4"], "3": ["5"], "4": ["6"], "5": ["7"], "6": ["7", "8"]}
NO_DIFFERENCE = "__empty_diff_placeholder__"


def report_rows(main: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Matched and official rows, and unmatched ones, whose missing columns are null."""
    return main.where(F.col("category").isin(*CATEGORIES[:2])).unionByName(unmatched.withColumn("category", F.lit(CATEGORIES[2])), allowMissingColumns=True)


def chosen_categories(text: Column) -> Column:
    """Known names of a comma-separated list, in the report's order; all where none is known."""
    asked = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    every = F.array(*[F.lit(c) for c in CATEGORIES])
    found = F.filter(every, lambda c: F.array_contains(asked, c))
    return F.when(F.size(found) > 0, found).otherwise(every)


def layer_filter(role: str, source: str, focus: str | None = None, allowed: list[str] | None = None) -> Column:
    """Features (feature_id, role, source) of one map layer: the one in focus, else those allowed; an empty list allows none."""
    layer = (F.col("role") == role) & (F.col("source") == source)
    if focus is not None:
        return layer & (F.col("feature_id") == focus)
    return layer if allowed is None else layer & F.col("feature_id").isin(allowed) if allowed else F.lit(False)


def sort_order(by: str, descending: bool = True) -> list[Column]:
    """Order of the report's table by one of its keys; rows without a value come last both ways."""
    numbers = {"iou": F.col("iou"), "area": F.col("area_diff_pct"), "haus": F.nanvl("hausdorff_m", F.lit(None)), "haus95": F.nanvl("hausdorff_p95_m", F.lit(None)), "issue": F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))}
    if by in numbers:
        return [numbers[by].desc_nulls_last() if descending else numbers[by].asc_nulls_last()]
    if by == "category":
        place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
        return [place.desc() if descending else place.asc()]
    names = [F.collate(F.col(c), "de_CI_AI") for c in ("name", "key")]
    return [c.desc() if descending else c.asc() for c in names]


def latest_value(runs: DataFrame, by: list[str], run: str, value: str) -> DataFrame:
    """(by.., value): that of the last run with a finite one."""
    finite = runs.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return finite.groupBy(*by).agg(F.max_by(value, run).alias(value))


def chart_series(runs: DataFrame, rows: DataFrame, by: list[str], run: str, mean: str, value: str) -> DataFrame:
    """(by.., run, mean): the runs with a finite mean; groups without one have ``current``, the mean of their rows' values."""
    finite = runs.where(F.col(mean).isNotNull() & ~F.isnan(mean) & (F.abs(mean) < float("inf"))).select(*by, F.col(run).cast("string").alias(run), mean)
    now = rows.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(mean)).select(*by, F.lit("current").alias(run), mean)
    return finite.unionByName(now.join(finite.select(*by).distinct(), by, "left_anti"))


def licence_table(summaries: DataFrame, areas: DataFrame) -> DataFrame:
    """(place, merge_key, area, members): licence summaries (area, merge_key) grouped, in the order of the areas (area, place).

    A group stands at the place of its first area, which represents it; areas without a summary are left out. One area
    has one summary; a later one of the same area counts, as summaries are looked up by area.
    """
    placed = areas.join(summaries, "area").select("place", "area", "merge_key")
    grouped = placed.groupBy("merge_key").agg(F.array_sort(F.collect_list(F.struct("place", "area"))).alias("_m"))
    return grouped.select(F.get("_m", F.lit(0)).place.alias("place"), "merge_key", F.get("_m", F.lit(0)).area.alias("area"), F.transform("_m", lambda x: x.area).alias("members"))


def feature_shards(rows: DataFrame, candidates: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by.., key, shard): one JSON document per row, with the row's candidates where it has a list, an empty one too."""
    carried = rows.join(candidates.select(*by, key, "candidates"), [*by, key], "left")
    row = F.struct(*[c for c in rows.columns if c not in by])
    return carried.select(*by, key, F.to_json(F.struct(row.alias("row"), F.col("candidates"))).alias("shard"))


def expected_tags(official: DataFrame, by: list[str]) -> DataFrame:
    """(by.., official_key, official_value, tags, expected): the tags that official properties (by.., name, value) should have."""
    tags = F.create_map(*[x for k, v in EXPECTED_TAGS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    levels = F.create_map(*[x for k, v in ADMIN_LEVELS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    value = F.trim("value")
    expected = F.when(F.col("name") == "ADE", F.try_element_at(levels, value)).otherwise(F.array(value))
    return official.select(*by, F.col("name").alias("official_key"), value.alias("official_value"), F.try_element_at(tags, F.col("name")).alias("tags"), expected.alias("expected")).where("tags is not null and expected is not null")


def live_tags(official: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """(by.., tag, value, state): live tags (by.., tag, value) that equal, differ from or have no official value, and official values that no tag holds."""
    wanted = expected_tags(official, by)
    each = wanted.select(*by, F.explode("tags").alias("tag"), "expected")
    held = live.select(*by, "tag", F.trim("value").alias("value")).join(each, [*by, "tag"], "left")
    state = F.when(F.col("expected").isNull(), "unmapped").when(F.array_contains("expected", F.col("value")), "equal").otherwise("different")
    present = live.select(*by, "tag").join(each.select(*by, "tag"), [*by, "tag"], "left_semi")
    named = wanted.select(*by, "official_key", F.explode("tags").alias("tag")).join(present, [*by, "tag"], "left_semi").select(*by, "official_key").distinct()
    missing = wanted.join(named, [*by, "official_key"], "left_anti").select(*by, F.get("tags", F.lit(0)).alias("tag"), F.col("official_value").alias("value"), F.lit("missing").alias("state"))
    return held.select(*by, "tag", "value", state.alias("state")).unionByName(missing)


def values_in_snapshot(live: DataFrame, snapshot: DataFrame, by: list[str]) -> DataFrame:
    """Live rows whose trimmed value is one of the snapshot's; placeholders match nothing."""
    known = snapshot.where(~placeholder(F.col("value"))).select(*by, F.trim("value").alias("_v")).distinct()
    return live.withColumn("_v", F.trim("value")).join(known, [*by, "_v"], "left_semi").drop("_v")


def without_hidden(live: DataFrame, hidden: DataFrame) -> DataFrame:
    """Rows whose row_key is not hidden; rows without a key stay."""
    return live.join(hidden.select("row_key"), "row_key", "left_anti")


def editor_tags(rows: DataFrame, key: str, boundary: str, levels: list[str], properties: list[str]) -> DataFrame:
    """(key, tag, value): the tags that a row which only the official side has should get in the map."""
    fixed = [("boundary", F.lit(boundary)), *[("admin_level", F.lit(v)) for v in levels], *[(p.strip(), F.col(key)) for p in properties if p.strip()]]
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in fixed])
    return rows.where("category = 'official_only'").select(key, F.explode(pairs).alias("t")).select(key, "t.*")


def feature_tables(rows: DataFrame, by: list[str], key: str, corner: Column) -> DataFrame:
    """(by.., layer, feature_id, source, geom): the tables overlay, diff and unmatched of rows with official_geom and osm_geom.

    A group with an overlay but without a difference gets a placeholder: the ``corner`` (point of the north-east) of all its overlay.
    """
    both = rows.where("category <> 'unmatched_osm'")
    sided = lambda df, col, source, layer: df.where(F.col(col).isNotNull()).select(*by, F.lit(layer).alias("layer"), F.col(key).alias("feature_id"), F.lit(source).alias("source"), F.col(col).alias("geom"))
    overlay = sided(both, "official_geom", "external", "overlay").unionByName(sided(both, "osm_geom", "osm", "overlay"))
    pieces = diff_polygons(both.where("official_geom is not null"), [*by, key])
    diff = pieces.select(*by, F.lit("diff").alias("layer"), F.col(key).alias("feature_id"), F.when(F.col("side") == "official", "external").otherwise("osm").alias("source"), "geom")
    empty = overlay.join(diff.select(*by).distinct(), by, "left_anti").groupBy(*by).agg(corner.alias("geom"))
    placeholders = empty.select(*by, F.lit("diff").alias("layer"), F.lit(NO_DIFFERENCE).alias("feature_id"), F.lit("external").alias("source"), "geom")
    unmatched = sided(rows.where("category = 'unmatched_osm'"), "osm_geom", "osm", "unmatched")
    return overlay.unionByName(diff).unionByName(placeholders).unionByName(unmatched)
