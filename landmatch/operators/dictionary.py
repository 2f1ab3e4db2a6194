"""The register's key dictionary: row rules, lookup maps, obsolete keys, name search."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landmatch.functions.dates import snapshot_date
from landmatch.functions.geometry import call
from landmatch.functions.keys import last_digits

# Record types and the codes of the 16 states.
RECORD_TYPES = ("10", "20", "30", "40", "50", "60")
STATES = tuple(f"{k:02d}" for k in range(1, 17))
#: Fields of a record that must be zero, by record type, with their widths.
ZERO_FIELDS = {"10": ("rb", "kreis", "vb", "gem"), "20": ("kreis", "vb", "gem"), "30": ("vb", "gem"), "40": ("vb", "gem"), "50": ("gem",)}
WIDTHS = {"land": 2, "rb": 1, "kreis": 2, "vb": 4, "gem": 3}
MAPS = ("states", "regions", "districts", "associations", "municipalities_by_ags", "municipalities_by_ars")


def field(name: str) -> Column:
    return last_digits(F.col(name), WIDTHS[name])


def is_zero(name: str) -> Column:
    return field(name) == "0" * WIDTHS[name]


def is_record() -> Column:
    return F.trim("satzart").rlike("^[0-9]+$")


def row_errors(rows: DataFrame) -> DataFrame:
    """(satzart, land, line, rule): what is wrong with single rows. A row of an unknown type has only that error."""
    kind, land = F.trim("satzart"), field("land")
    known = kind.isin(*RECORD_TYPES)
    dated = F.trim("snapshot_date") != ""
    rules = [
        F.when(~known, "unexpected_satzart"),
        F.when(known & dated & snapshot_date(F.col("snapshot_date")).isNull(), "invalid_snapshot_date"),
        F.when(known & (land != "00") & ~land.isin(*STATES), "invalid_land_code"),
        *[F.when((kind == t) & ~is_zero(name), f"satzart{t}_{name}_zero") for t, names in ZERO_FIELDS.items() for name in names],
        F.when((kind == "40") & ~land.isin(*STATES), "kreis_invalid_land"),
    ]
    return rows.where(is_record()).select(kind.alias("satzart"), land.alias("land"), "line", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def hierarchy_errors(rows: DataFrame) -> DataFrame:
    """Row errors, states that are missing or not 16, and rows whose state has no record of its own."""
    spark = rows.sparkSession
    kind, land = F.trim("satzart"), field("land")
    states = rows.where((kind == "10") & land.isin(*STATES)).select(land.alias("land")).distinct()
    wanted = spark.createDataFrame([(s,) for s in STATES], "land string")
    lone = F.lit("10").alias("satzart"), F.lit(0).cast("long").alias("line")
    missing = wanted.join(states, "land", "left_anti").select(lone[0], "land", lone[1], F.lit("missing_bundesland").alias("rule"))
    count = states.agg(F.count("*").alias("n")).where("n <> 16").select(lone[0], F.lit("").alias("land"), lone[1], F.lit("bundesland_count").alias("rule"))
    placed = rows.select(kind.alias("satzart"), land.alias("land"), "line")
    lost = placed.where(F.col("satzart").isin("40", "50", "60")).join(states, "land", "left_anti")
    orphans = lost.where("land <> '00'").select("satzart", "land", "line", F.lit("orphan_land_reference").alias("rule"))
    homeless = lost.where("satzart = '60'").select("satzart", "land", "line", F.lit("gemeinde_orphan_land").alias("rule"))
    return reduce(DataFrame.unionByName, [row_errors(rows), count, missing, orphans, homeless])


def lookup_entries(rows: DataFrame) -> DataFrame:
    """(map_name, key, name, line): all entries that rows make, blanks left out."""
    kind = F.trim("satzart")
    ars = F.concat(*[field(n) for n in WIDTHS])
    ags = F.concat(field("land"), field("rb"), field("kreis"), field("gem"))
    entry = lambda name, t, key: F.when(kind == t, F.struct(F.lit(name).alias("map_name"), key.alias("key")))
    made = F.array_compact(
        F.array(
            entry("states", "10", field("land")),
            entry("regions", "20", F.concat(field("land"), field("rb"))),
            entry("districts", "40", F.concat(field("land"), field("rb"), field("kreis"))),
            entry("associations", "50", F.concat(field("land"), field("rb"), field("kreis"), field("vb"))),
            entry("municipalities_by_ars", "60", ars),
            entry("municipalities_by_ags", "60", ags),
        )
    )
    return rows.where(is_record() & (F.trim("name") != "")).select(F.explode(made).alias("e"), F.trim("name").alias("name"), "line").select("e.*", "name", "line")


def lookup_maps(entries: DataFrame) -> DataFrame:
    """(map_name, key, name): the first line's name wins."""
    return entries.groupBy("map_name", "key").agg(F.min_by("name", "line").alias("name"))


def lookup_conflicts(entries: DataFrame) -> DataFrame:
    """(map_name, key, previous, incoming, line): later lines with another name for a key."""
    first = lookup_maps(entries).withColumnRenamed("name", "previous")
    return entries.join(first, ["map_name", "key"]).where("name <> previous").select("map_name", "key", "previous", F.col("name").alias("incoming"), "line")


def obsolete(annual: DataFrame, latest: DataFrame) -> DataFrame:
    """(map_name, key, name, last_year) of keys that are in a year's maps but not in the latest.

    A state or district whose number still begins a current municipality's is not obsolete.
    """
    prefixes = latest.where("map_name = 'municipalities_by_ags'")
    guards = prefixes.select(F.lit("states").alias("map_name"), F.substring("key", 1, 2).alias("key")).union(prefixes.select(F.lit("districts"), F.substring("key", 1, 5))).distinct()
    gone = annual.join(latest.select("map_name", "key"), ["map_name", "key"], "left_anti").join(guards, ["map_name", "key"], "left_anti")
    return gone.groupBy("map_name", "key").agg(F.max_by("name", "year").alias("name"), F.max("year").alias("last_year"))


def segment_names(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, level, segment, name): names of a 12-digit key's five prefixes. names: (segment, name), distinct segments."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.substring("key", 1, k).alias("segment")) for k in (2, 3, 5, 9, 12)])
    return keys.select("key", F.explode(levels).alias("s")).select("key", "s.*").join(names, "segment", "left").select("key", "level", "segment", "name")


def reverse_by_ags(by_ars: DataFrame) -> DataFrame:
    """(ags, ars, name): of the rows that share an 8-digit key the one with the latest year, then the smallest key."""
    ags = F.concat(F.substring("ars", 1, 5), F.substring("ars", 10, 3))
    order = Window.partitionBy("ags").orderBy(F.desc("year"), "ars")
    return by_ars.withColumn("ags", ags).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("ags", "ars", "name")


def name_form(text: Column) -> Column:
    """A name as it is searched: trimmed, single spaces, no zero-width spaces, compatibility form, lower case."""
    plain = F.regexp_replace(F.replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\u200b"), F.lit("")), r"(?U)\s+", " ")
    return F.lower(call("Compatible", plain))


def key_order(text: Column, strength: int = 2) -> Column:
    """Bytes that sort texts as German does, digits by their value: 2 before 10."""
    return call("SortKey", text, F.lit("de-u-kn-true"), F.lit(strength))


def name_rank(name: Column, query: str) -> Column:
    """0 for the name itself, then its part before a comma, a leading word, a prefix, a part; null for no match."""
    q = F.lit(query)
    head = F.trim(F.split_part(name, F.lit(","), F.lit(1)))
    return (
        F.when(F.lit(len(query) < 2), F.lit(None).cast("int"))
        .when(name == q, 0).when(head == q, 1)
        .when(name.startswith(query + ",") | name.startswith(query + " "), 2)
        .when(head.startswith(query), 10 + max(0, 40 - len(query)))
        .when(name.contains(query), 60)
    )


def search_names(entries: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """(kind, id, name, rank): the best rank of each (kind, id), by rank, then name without case and accents, then kind and id, its digits by value."""
    asked = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", query.strip().replace("\u200b", ""))).lower()
    ranked = entries.withColumn("rank", name_rank(name_form(F.col("name")), asked)).where("rank is not null")
    best = ranked.groupBy("kind", "id").agg(F.min(F.struct("rank", "name")).alias("b")).select("kind", "id", "b.*")
    return best.orderBy("rank", F.collate("name", "de_CI_AI"), "kind", key_order(F.col("id")), "id").limit(limit)


def best_source(candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """The source of the latest snapshot among those without errors. candidates: (source, snapshot_date); errors: (source)."""
    return candidates.join(errors.select("source"), "source", "left_anti").agg(F.max_by("source", F.struct("snapshot_date", "source")).alias("source"), F.max("snapshot_date").alias("snapshot_date")).where("source is not null")
