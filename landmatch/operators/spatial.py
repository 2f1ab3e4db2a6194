"""Bounding boxes, grid joins, the scope filter and candidate points.

Range conditions alone would plan a nested loop over all pairs. Boxes and points are therefore sent to the cells of
a grid, which gives the join an equality. A box belongs to the finest level at which it covers at most two cells
either way, and looks for others at its own and the coarser levels: at most 4 * LEVELS rows, whatever its size.
A pair counts in one cell only, that of the lower left corner of the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmatch.functions.geometry import call

# Overlap that counts as substantive, and how candidates' polygons shrink.
LEAST_AREA_M2, LEAST_RATIO = 100_000.0, 0.08
SHRINK = 0.7
LEVELS = 20


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def feature_box(props: Column, geom: Column) -> Column:
    """(w, s, e, n): a feature's stored box where all four of its numbers are finite, else that of its geometry, which is null for none or a broken one."""
    stored = [F.try_element_at(props, F.lit(f"_bbox_{c}")).try_cast("double") for c in ("minx", "miny", "maxx", "maxy")]
    finite = F.lit(True)
    for c in stored:
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return F.when(finite, F.struct(*[c.alias(n) for c, n in zip(stored, "wsen", strict=True)])).otherwise(call("Envelope", geom))


def boxes_overlap(a: str, b: str) -> Column:
    """Closed intervals: boxes that touch overlap."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = box(a), box(b)
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def padded(x0: Column, y0: Column, x1: Column, y1: Column, share: float = 0.06) -> tuple[Column, ...]:
    dx, dy = (x1 - x0) * share, (y1 - y0) * share
    return x0 - dx, y0 - dy, x1 + dx, y1 + dy


def union_bbox(prefix: str = "") -> list[Column]:
    clean = [F.when(~F.isnan(c), c) for c in box(prefix)]
    return [F.min(clean[0]).alias("x0"), F.min(clean[1]).alias("y0"), F.max(clean[2]).alias("x1"), F.max(clean[3]).alias("y1")]


def prune_by_bbox(official: DataFrame, osm: DataFrame, by: list[str], buffer: float) -> DataFrame:
    """osm rows whose box overlaps the group's box of all official rows, padded by the buffer. One box per group is broadcast by Spark where it fits."""
    whole = official.groupBy(*by).agg(*union_bbox())
    frame = whole.select(*[F.col(c).alias(f"_{c}") for c in by], (F.col("x0") - buffer).alias("_x0"), (F.col("y0") - buffer).alias("_y0"), (F.col("x1") + buffer).alias("_x1"), (F.col("y1") + buffer).alias("_y1"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    return osm.join(frame, [*same, (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1")) & (F.col("y0") <= F.col("_y1")) & (F.col("_y0") <= F.col("y1"))], "left_semi")


def level_of(x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> Column:
    """Smallest level (cells of cell * 4 ** level) at which the box covers at most two cells either way; LEVELS is beyond any map."""
    wide = F.greatest(x1 - x0, y1 - y0)
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(wide <= cell * 4**k, F.lit(k)).otherwise(level)
    return level


def cells(x0: Column, y0: Column, x1: Column, y1: Column, level: Column, cell: float) -> Column:
    """Cells of one level that the box touches."""
    size = F.lit(cell) * F.pow(F.lit(4.0), level)
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(level.alias("level"), i.alias("i"), j.alias("j")))))


def meetings(left: DataFrame, right: DataFrame, by: list[str], cell: float, how: str, more: Column | None = None) -> DataFrame:
    """Joins rows of equal ``by`` in the grid cells where their boxes (x0, y0, x1, y1) meet; the right side's columns have the prefix r_.

    A pair meets at the coarser of its two levels. Levels that the other side has no box of are not looked at: at most
    LEVELS values are sent round for that.
    """
    corner = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    own = level_of(*corner, cell)
    renamed = lambda df: df.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "_cell")

    def stored(df: DataFrame) -> DataFrame:
        return df.withColumn("_cell", F.explode(cells(*corner, own, cell)))

    def asked(df: DataFrame, other: DataFrame, above: int) -> DataFrame:
        levels = other.select(own.alias("_level")).distinct()
        lifted = df.withColumn("_level", F.explode(F.when(own + above < LEVELS, F.sequence(own + above, F.lit(LEVELS - 1)))))
        there = lifted.join(F.broadcast(levels), "_level", "left_semi")
        return there.withColumn("_cell", F.explode(cells(*corner, F.col("_level"), cell))).drop("_level")

    met = []
    for one, two in ((asked(left, right, 0), stored(right)), (stored(left), asked(right, left, 1))):
        on = [*[F.col(f"a.{c}") == F.col(f"b.r_{c}") for c in by], F.col("a._cell") == F.col("b._cell"), *([] if more is None else [more])]
        joined = one.alias("a").join(renamed(two).alias("b"), on, how)
        met.append(joined if how == "left_semi" else joined.select("a.*", *[f"b.r_{c}" for c in right.columns]))
    return met[0].unionByName(met[1])


OVERLAP = "x0 <= r_x1 and r_x0 <= x1 and y0 <= r_y1 and r_y0 <= y1"


def grid_pairs(left: DataFrame, right: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Pairs of rows of equal ``by`` whose boxes overlap, each once."""
    size = F.lit(cell) * F.pow(F.lit(4.0), F.col("_cell.level"))
    home = (F.floor(F.greatest("x0", "r_x0") / size) == F.col("_cell.i")) & (F.floor(F.greatest("y0", "r_y0") / size) == F.col("_cell.j"))
    return meetings(left, right, by, cell, "inner").where(F.expr(OVERLAP) & home).drop("_cell")


def scope_condition(inter: Column, osm_area: Column, centroid_inside: Column, intersects: Column) -> Column:
    """A row is in scope if it intersects and either its centroid lies inside or the overlap is substantive."""
    substantive = (inter >= LEAST_AREA_M2) & F.when(osm_area > 0, inter / osm_area >= LEAST_RATIO).otherwise(F.lit(False))
    return intersects & (centroid_inside | substantive)


def scope_semi_join(osm: DataFrame, official: DataFrame, by: list[str], cell: float, keep: Column, uses: tuple[str, ...] = ()) -> DataFrame:
    """osm rows for which some overlapping official row (columns r_..) satisfies ``keep``; each once.

    ``keep`` may read ``by``, the boxes and the columns in ``uses``. Only whether there is such a row counts: rows
    that agree in all these are looked at once, and a box is done with the first one that keeps it.
    """
    columns = [*by, "x0", "y0", "x1", "y1", *uses]
    some = meetings(osm.select(*columns).distinct(), official.select(*columns).distinct(), by, cell, "left_semi", F.expr(OVERLAP) & keep)
    seen = some.select(*[F.col(c).alias(f"_{c}") for c in columns])
    return osm.join(seen, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_semi")


def polygon_scope(osm: DataFrame, official: DataFrame, by: list[str], cell: float, osm_id: str) -> DataFrame:
    """The scope filter on WKB polygons in longitude and latitude; boxes come first, then cheap predicates, then the overlap's area.

    Rows that share an id are judged one by one.
    """
    lap = call("Difference", F.col("geom"), call("Difference", F.col("geom"), F.col("r_geom")))
    area = F.coalesce(call("GeodesicArea", lap), F.lit(0.0))
    inside = call("Covers", F.col("r_geom"), call("Centroid", F.col("geom")))
    touching = call("Intersects", F.col("geom"), F.col("r_geom"))
    keep = F.when(~touching, F.lit(False)).when(inside, F.lit(True)).otherwise(scope_condition(area, call("GeodesicArea", F.col("geom")), F.lit(False), F.lit(True)))
    return scope_semi_join(osm, official, by, cell, keep, ("geom",))


def shrunk(x0: Column, y0: Column, x1: Column, y1: Column, factor: float = SHRINK) -> list[Column]:
    """A rectangle scaled about its centre; a factor outside (0, 1) leaves it as it is."""
    f = factor if 0 < factor < 1 else 1.0
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return [cx - (x1 - x0) / 2 * f, cy - (y1 - y0) / 2 * f, cx + (x1 - x0) / 2 * f, cy + (y1 - y0) / 2 * f]


def eligible_points(points: DataFrame, levels: list[str] | None = None, ignored: list[str] | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points with an object's type and id that may be candidates. points: osm_type, osm_id, admin_level, x0, y0.

    The ignore list holds relation ids and leaves ways alone; with a list of levels, points without a level go; the
    box is closed.
    """
    kept = points.where(F.col("osm_type").isNotNull() & F.col("osm_id").isNotNull())
    if ignored:
        kept = kept.where(~((F.col("osm_type") == "relation") & F.col("osm_id").cast("string").isin(ignored)))
    if levels:
        kept = kept.where(F.coalesce(F.trim("admin_level").isin(levels), F.lit(False)))
    if box:
        kept = kept.where(F.col("x0").between(box[0], box[2]) & F.col("y0").between(box[1], box[3]))
    return kept


def point_hits(rows: DataFrame, points: DataFrame, by: list[str], cell: float) -> DataFrame:
    """Pairs of a row whose box holds a point, each once; the point's columns get the prefix r_.

    A row stands in the cells of its own level, four at most; a point is asked once at each level that rows have.
    """
    corner = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    own = level_of(*corner, cell)
    stored = rows.where(F.col("x0").isNotNull()).withColumn("_cell", F.explode(cells(*corner, own, cell)))
    levels = rows.where(F.col("x0").isNotNull()).select(own.alias("_level")).distinct()
    size = F.lit(cell) * F.pow(F.lit(4.0), F.col("_level"))
    at = F.struct(F.col("_level").alias("level"), F.floor(F.col("x0") / size).alias("i"), F.floor(F.col("y0") / size).alias("j"))
    asked = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).join(F.broadcast(levels), "_level", "left_semi").withColumn("_cell", at)
    a, b = stored.alias("a"), asked.select(*[F.col(c).alias(f"r_{c}") for c in points.columns], "_cell").alias("b")
    inside = F.col("r_x0").between(F.col("x0"), F.col("x1")) & F.col("r_y0").between(F.col("y0"), F.col("y1"))
    return a.join(b, [*[F.col(f"a.{c}") == F.col(f"b.r_{c}") for c in by], F.col("a._cell") == F.col("b._cell"), inside]).select("a.*", *[f"b.r_{c}" for c in points.columns]).drop("_cell")


def points_in_polygons(rows: DataFrame, points: DataFrame, official_keys: DataFrame, by: list[str], key: str, cell: float, fields: tuple[str, ...] = ("name", "admin_level", "regional", "amtlicher"), factor: float = SHRINK) -> DataFrame:
    """(by.., key, candidates, n_rows): the candidate points in each row's polygon shrunk about its centroid.

    rows: by.., key, geom (WKB in the points' coordinates, or null); points, official_keys and fields as for
    ``candidate_points``. Boxes of the shrunk polygons find the points; then each polygon is indexed by its edges once
    and asked for all points that a task has for it.
    """
    rows = dealt(rows, by, key)
    small = rows.withColumn("geom", call("Shrink", "geom", F.lit(factor))).withColumn("_box", call("Envelope", "geom"))
    boxed = small.select(*by, key, "geom", *[F.col(f"_box.{c}").alias(n) for c, n in zip("wsen", ("x0", "y0", "x1", "y1"), strict=True)])
    hits = eligible_hits(boxed, points, official_keys, by, key, cell).where(call("HoldsPoint", "geom", "r_x0", "r_y0")).drop("geom")
    return listed(rows, hits, by, key, fields)


def candidate_points(rows: DataFrame, points: DataFrame, official_keys: DataFrame, by: list[str], key: str, cell: float, covers: Column, fields: tuple[str, ...] = ("name",)) -> DataFrame:
    """(by.., key, candidates, n_rows): points inside each key's rows, relations first, then by id; keys without a hit have an empty list.

    rows: by.., key, x0.. (box of the shrunk polygon); points: by.., osm_type, osm_id, canonical, x0.. (a box of no size)
    and the text columns ``fields`` that candidates carry, blanks as null. A point whose own key belongs to another
    official row is dropped; one with the row's own key stays. Rows of one key are one: n_rows is their number, and
    ``times`` of a candidate the number of its hits in them.
    """
    rows = dealt(rows, by, key)
    return listed(rows, eligible_hits(rows, points, official_keys, by, key, cell).where(covers), by, key, fields)


def dealt(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """rows dealt by key, as the lists need them, before any work on shapes: a small file is not one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, key)


def eligible_hits(rows: DataFrame, points: DataFrame, official_keys: DataFrame, by: list[str], key: str, cell: float) -> DataFrame:
    """Pairs as of ``point_hits``, without points of other rows' keys.

    A point whose key an official row has can only be a candidate of that key, so it meets the rows of its key and
    no others; only the rest are looked for by place.
    """
    taken = official_keys.select(*[F.col(c).alias(f"k_{c}") for c in by], F.col(key).alias("k_key")).where("k_key <> ''").distinct()
    known = [*[F.col(c) == F.col(f"k_{c}") for c in by], F.col("canonical") == F.col("k_key")]
    owned = points.join(taken, known, "left_semi").select(*[F.col(c).alias(f"r_{c}") for c in points.columns])
    inside = F.col("r_x0").between(F.col("x0"), F.col("x1")) & F.col("r_y0").between(F.col("y0"), F.col("y1"))
    by_key = rows.join(owned, [*[F.col(c) == F.col(f"r_{c}") for c in by], F.col(key) == F.col("r_canonical"), inside])
    return point_hits(rows, points.join(taken, known, "left_anti"), by, cell).unionByName(by_key)


def listed(rows: DataFrame, hits: DataFrame, by: list[str], key: str, fields: tuple[str, ...]) -> DataFrame:
    """The hits of each key's rows as a list."""
    rank = F.when(F.col("r_osm_type") == "relation", 0).otherwise(1)
    carried = [F.nullif(F.trim(F.col(f"r_{c}")), F.lit("")).alias(c) for c in fields]
    # of points of one object, one is listed
    told = F.struct(rank.alias("rank"), F.col("r_osm_id").alias("osm_id"), F.col("r_osm_type").alias("osm_type"), *carried)
    one = hits.groupBy(*by, key, rank.alias("_rank"), F.col("r_osm_id").alias("_id")).agg(F.min(told).alias("_c"), F.count("*").alias("_times"))
    lists = one.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("_c.*", F.col("_times").alias("times")))).alias("candidates"))
    empty = F.array().cast(f"array<struct<rank:int,osm_id:bigint,osm_type:string,{','.join(f'{c}:string' for c in fields)},times:bigint>>")
    each = rows.groupBy(*by, key).agg(F.count("*").alias("n_rows"))
    return each.join(lists, [*by, key], "left").select(*by, key, F.coalesce("candidates", empty).alias("candidates"), "n_rows")


def row_bbox() -> list[Column]:
    """Box over both sides of a row; a missing side is passed over."""
    least, most = F.least, F.greatest
    return [least("a_x0", "b_x0").alias("x0"), least("a_y0", "b_y0").alias("y0"), most("a_x1", "b_x1").alias("x1"), most("a_y1", "b_y1").alias("y1")]


def map_bounds(x0: Column, y0: Column, x1: Column, y1: Column, factor: float = 4.0) -> Column:
    """The box times the factor about its centre, inside the map's limits; null for a box of no size."""
    dx, dy = (x1 - x0) * factor / 2, (y1 - y0) * factor / 2
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    inside = F.struct(F.greatest(cx - dx, F.lit(-180.0)).alias("w"), F.greatest(cy - dy, F.lit(-85.0)).alias("s"), F.least(cx + dx, F.lit(180.0)).alias("e"), F.least(cy + dy, F.lit(85.0)).alias("n"))
    return F.when((x1 > x0) & (y1 > y0), inside)
