"""Overlap metrics, anomalies against the run before, and triage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmatch.functions.geometry import call

# Thresholds of the triage.
IOU_VERY_STRONG, IOU_GOOD, IOU_LOW, IOU_MID = 0.995, 0.99, 0.985, 0.7
SYM_STRONG, SYM_GOOD, SYM_HIGH = 0.35, 0.75, 1.5
AREA_STRONG, AREA_HIGH = 0.35, 1.2
NORM_REVIEW, NORM_SEVERE = 0.02, 0.04
Z_OUTLIER, Z_SCALE, MIN_SAMPLES = 3.5, 0.6745, 8
BIN_BITS = 20
#: Metric of each delta, in the order of the reasons.
BASELINE = {"iou": "BASELINE_ANOMALY_IOU_DELTA", "symmetric_diff_pct": "BASELINE_ANOMALY_SYMDIFF_DELTA", "area_diff_pct": "BASELINE_ANOMALY_AREA_DELTA", "hausdorff_norm": "BASELINE_ANOMALY_HAUSDORFF_NORM_DELTA"}


def iou(inter: Column, union: Column) -> Column:
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def area_diff_pct(official: Column, osm: Column) -> Column:
    return F.when(official > 0, F.abs(osm - official) / official * 100).when(osm > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def symmetric_diff_pct(official: Column, osm: Column, inter: Column) -> Column:
    """Area in one of the two only, in percent of the larger one."""
    larger = F.greatest(official, osm)
    return F.when(larger > 0, F.greatest(official + osm - 2 * inter, F.lit(0.0)) / larger * 100).otherwise(F.lit(0.0))


def symmetric_diff_area(official: Column, pct: Column) -> Column:
    return official * pct / 100


def hausdorff_norm(p95: Column, boundary: Column, official: Column) -> Column:
    """In boundary lengths, or where there is none in square roots of the area."""
    usable = p95.isNotNull() & ~F.isnan(p95)
    return F.when(usable & (boundary > 1e-9), p95 / boundary).when(usable & (official > 1e-9), p95 / F.sqrt(official))


def polygon_metrics(rows: DataFrame, official: str = "official_geom", osm: str = "osm_geom") -> DataFrame:
    """Adds the metric columns from two WKB columns of planar coordinates; null where a side has no area. One call per row."""
    m = rows.withColumn("_m", call("Measures", F.col(official), F.col(osm)))
    a, b, i, u = (F.col(f"_m.{c}") for c in ("official_area", "osm_area", "intersection", "union"))
    has = F.col("_m").isNotNull()
    return m.withColumns(
        {
            "iou": F.when(has, iou(i, u)),
            "area_diff_pct": F.when(has, area_diff_pct(a, b)),
            "symmetric_diff_pct": F.when(has, symmetric_diff_pct(a, b, i)),
            "hausdorff_m": F.col("_m.hausdorff"),
            "hausdorff_p95_m": F.nanvl(F.col("_m.hausdorff_p95"), F.lit(None).cast("double")),
            "hausdorff_norm": hausdorff_norm(F.col("_m.hausdorff_p95"), F.col("_m.boundary"), a),
            "official_area_m2": a,
            "osm_area_m2": b,
        }
    ).drop("_m")


def mean_iou(column: str = "iou") -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def finite_max(column: Column) -> Column:
    """Largest finite value, 0 where there is none above it."""
    return F.greatest(F.coalesce(F.max(F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)), F.lit(0.0)), F.lit(0.0))


def exact_medians(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by.., name, n): the exact median of each group, the mean of the two middle values of an even count.

    No task holds a group. Equal values become one row with a count before the first shuffle. Then the middle ranks are
    looked up in a histogram over the first BIN_BITS bits of the values in the doubles' order, which has 256 bins for
    each power of two, and only the values that share a bin with a middle one are put in order. Groups must not be null.
    """
    counted = values.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", call("OrderedBits", F.col("_v")))
    binned = counted.withColumn("_bin", F.shiftright("_b", 64 - BIN_BITS))
    bins = binned.groupBy(*by, "_bin").agg(F.sum("_n").alias("_in"))
    whole = Window.partitionBy(*by)
    ranked = bins.withColumns({"_upto": F.sum("_in").over(whole.orderBy("_bin")), "n": F.sum("_in").over(whole)})
    middle = ranked.withColumns({"_low": F.expr("(n - 1) div 2") - F.col("_upto") + F.col("_in"), "_high": F.expr("n div 2") - F.col("_upto") + F.col("_in")})
    here = lambda rank: (F.col(rank) >= 0) & (F.col(rank) < F.col("_in"))
    chosen = middle.where(here("_low") | here("_high")).select(*by, "_bin", "n", "_low", "_high")
    placed = binned.join(chosen, [*by, "_bin"]).withColumn("_last", F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy("_b")))
    holds = lambda rank: (F.col("_last") - F.col("_n") <= F.col(rank)) & (F.col(rank) < F.col("_last"))
    found = placed.where(holds("_low") | holds("_high"))
    return found.groupBy(*by).agg(((F.min("_v") + F.max("_v")) / 2).alias(name), F.max("n").alias("n"))


def beside_previous(current: DataFrame, previous: DataFrame, by: list[str], key: str, metrics: list[str]) -> DataFrame:
    """The rows of a run whose key the previous run (by.., key, metrics) measured too, with its metrics as prev_..

    Rows without an iou were not measured; a key is there once in either run.
    """
    known = previous.where("iou is not null").select(*by, key, *[F.col(m).alias(f"prev_{m}") for m in metrics])
    return current.where("iou is not null").join(known, [*by, key])


def anomalies(rows: DataFrame, by: list[str], key: str, metrics: dict[str, str] = BASELINE) -> DataFrame:
    """(by.., key, reasons): keys whose change in a metric stands out among the group's changes by the modified z-score.

    rows: by.., key, and for each metric m the columns m and prev_m. A metric with under MIN_SAMPLES changes is passed
    over; where the median deviation is 0, any other change stands out.
    """
    names = list(metrics)
    deltas = F.array(*[F.struct(F.lit(k).alias("rank"), F.abs(F.col(m) - F.col(f"prev_{m}")).alias("delta")) for k, m in enumerate(names)])
    long = rows.select(*by, key, F.explode(deltas).alias("d")).select(*by, key, "d.*").where(F.col("delta").isNotNull() & ~F.isnan("delta"))
    group = [*by, "rank"]
    middle = exact_medians(long, group, "delta", "med").where(F.col("n") >= MIN_SAMPLES)
    off = long.join(middle, group).withColumn("off", F.abs(F.col("delta") - F.col("med")))
    spread = exact_medians(off, group, "off", "mad").drop("n")
    out = off.join(spread, group).where(F.when(F.col("mad") > 1e-9, Z_SCALE * F.col("off") / F.col("mad") > Z_OUTLIER).otherwise(F.col("off") > 1e-9))
    reasons = F.array(*[F.lit(r) for r in metrics.values()])
    found = out.groupBy(*by, key).agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    return found.select(*by, key, F.transform("ranks", lambda k: F.get(reasons, k)).alias("reasons"))


def triage(iou_: Column, area: Column, sym: Column, norm: Column, baseline: Column) -> Column:
    """(level, reasons): baseline reasons come first. A null norm is no outlier."""
    area, sym, norm = F.abs(area), F.abs(sym), F.abs(norm)
    known = F.coalesce(baseline, F.array().cast("array<string>"))
    strong = (iou_ >= IOU_VERY_STRONG) & (sym <= SYM_STRONG) & (area <= AREA_STRONG)
    good = (iou_ >= IOU_GOOD) & (sym <= SYM_GOOD)
    outlier, severe = (F.coalesce(norm >= x, F.lit(False)) for x in (NORM_REVIEW, NORM_SEVERE))
    low, high = (iou_ < IOU_LOW) & (sym > SYM_HIGH), area > AREA_HIGH
    found = F.array_compact(
        F.array(
            F.when(strong, "STRONG_OVERLAP_LOW_DIFF"),
            F.when(outlier & good, "BOUNDARY_OUTLIER_BUT_OVERLAP_STABLE"),
            F.when(low, "LOW_IOU_HIGH_SYM_DIFF"),
            F.when(high, "HIGH_AREA_DELTA"),
        )
    )
    level = (
        F.when(strong & ~low & ~high & (F.size(known) == 0), "ok")
        .when(low | (high & severe), "issue")
        .when(outlier | high | (F.size(known) > 0) | (iou_ < IOU_GOOD), "review")
        .otherwise("ok")
    )
    return F.struct(level.alias("level"), F.array_distinct(F.concat(known, found)).alias("reasons"))


def tier(value: Column, good: Column, mid: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "neutral").when(good, "good").when(mid, "mid").otherwise("bad")


def kpi_tiers(iou_: Column, area: Column, sym: Column, norm: Column) -> dict[str, Column]:
    n = F.abs(norm)
    return {
        "tier_iou": tier(iou_, iou_ >= IOU_GOOD, iou_ >= IOU_MID),
        "tier_area": tier(area, area <= AREA_STRONG, area <= AREA_HIGH),
        "tier_sym": tier(sym, sym <= SYM_STRONG, sym <= SYM_GOOD),
        "tier_norm": tier(n, n < NORM_REVIEW, n < NORM_SEVERE),
    }


def diff_polygons(rows: DataFrame, keep: list[str], least_m2: float = 1e-6) -> DataFrame:
    """(keep.., side, geom): what only one side covers, from WKB in longitude and latitude; slivers under least_m2 go."""
    both = F.array(
        F.struct(F.lit("official").alias("side"), call("Difference", F.col("official_geom"), F.col("osm_geom")).alias("geom")),
        F.struct(F.lit("osm").alias("side"), F.when(F.col("official_geom").isNotNull(), call("Difference", F.col("osm_geom"), F.col("official_geom"))).alias("geom")),
    )
    parts = rows.select(*keep, F.explode(both).alias("d")).select(*keep, "d.*").where("geom is not null")
    return parts.where(call("GeodesicArea", F.col("geom")) >= least_m2)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
