"""The home page's index from folders of tables, the registry of discussions, and the small rules beside them."""

from __future__ import annotations

import copy
import json
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from landmatch.functions import geometry
from landmatch.functions.geometry import call
from landmatch.operators import areas, discussions, history, live, spatial

METRICS = {"iou": 1, "areaDiffPct": 0, "symmetricDiffPct": 0.5, "hausdorffM": 3, "officialAreaM2": 1e6, "osmAreaM2": 1e6, "issueIndicator": {"level": "review", "reasons": []}}
ROW = {"canonicalMatchKey": "k", "nameLabel": "n", "osmRelationId": "1", "category": "matched", "metrics": METRICS, "mapBbox": None}
GOOD = {
    "area": "x", "displayName": " Ähre ", "titlePrefix": "T", "generatedAt": "2024-01-01", "metricsCrs": "EPSG:25832", "hasPmtiles": True, "tippecanoeLayer": "l", "filterConfigSummary": {"officialMatchProperty": "AGS"},
    "sourceMetadata": {"official": {"provider": "HTTP", "dataset": "GeoJSON", "sourcePublicUrl": "https://h.org/a/datasets/seen", "sourceDownloadUrl": "https://h.org/d"}},
    "rows": [ROW, {**ROW, "category": "official_only", "metrics": None}, {**ROW, "metrics": {**METRICS, "issueIndicator": {"level": "issue", "reasons": []}}}], "unmatchedOsm": [{"canonicalMatchKey": "u", "nameLabel": "u", "osmRelationId": "2"}],
}


def changed(path: str, value) -> dict:
    out = copy.deepcopy(GOOD)
    *way, last = path.split(".")
    at = out
    for step in way:
        at = at[int(step) if step.isdigit() else step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return out


#: Each of these is one table that the report cannot show.
MALFORMED = [
    ("displayName", "  "), ("titlePrefix", ...), ("rows", ...), ("unmatchedOsm", None), ("rows.0.category", "other"), ("rows.1.category", "unmatched_osm"), ("rows.0.metrics.iou", ...), ("rows.0.metrics.issueIndicator.level", "bad"), ("rows.2.nameLabel", ...),
    ("sourceMetadata.official", ...), ("sourceMetadata.official.sourcePublicUrl", "here"), ("sourceMetadata.official.sourceDownloadUrl", ""), ("sourceMetadata.official.osmCompatibility", "maybe"), ("sourceMetadata.official.licenseSourceUrl", "there"),
]


def put(root: Path, area: str, text: str, at: str = "output/comparison_table.json") -> None:
    file = root / area / at
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)


def test_malformed_tables_are_left_out(spark):
    texts = [("good", json.dumps(GOOD)), ("cut", json.dumps(GOOD)[:-1]), ("empty", ""), ("none", None), (None, json.dumps(GOOD)), ("list", "[]"), *[(f"{p}={v}", json.dumps(changed(p, v))) for p, v in MALFORMED]]
    fine = [("no level", changed("rows.0.metrics.issueIndicator", ...)), ("no metrics", changed("rows.0.metrics", None)), ("no rows", changed("rows", [])), ("blank terms", changed("sourceMetadata.official.licenseSourceUrl", ""))]
    docs = spark.createDataFrame([*texts, *[(a, json.dumps(d)) for a, d in fine]], "area string, text string")
    assert {r.area for r in areas.comparison_tables(docs).collect()} == {"good", *[a for a, _ in fine]}
    assert areas.comparison_tables(docs.limit(0)).count() == 0


def test_home_is_written_from_folders(spark, tmp_path):
    geometry.register(spark)
    root, out = tmp_path / "datasets", str(tmp_path / "home")
    for area in ("b 10", "b 2+", "ä", "z"):
        put(root, area, json.dumps(GOOD))
    put(root, "broken", "{")
    put(root, ".hidden", json.dumps(GOOD))
    put(root, "elsewhere", json.dumps(GOOD), "comparison_table.json")
    configs = spark.createDataFrame([("z", "direct", "admin_rs", "ref", ["6"]), ("ä", "profile", "bkg_vg25_x", "ref", [])], "area string, mode string, profile string, match_property string, admin_levels array<string>")
    areas.write_home(spark, str(root), out, configs)
    lines = lambda name: [json.loads(x) for f in sorted(Path(out, name).glob("part-*")) for x in f.read_text().splitlines()]
    rows = lines("areas")
    assert [r["area"] for r in rows] == ["ä", "b 2+", "b 10", "z"]
    assert rows[3] == {"area": "z", "display_name": "Ähre", "matched": 2, "official_only": 1, "unmatched_osm": 1, "reviews": 1, "issues": 1, "match_properties": ["de:regionalschluessel"], "admin_levels": ["6"]}
    assert rows[0]["match_properties"] == ["ref"] and "admin_levels" not in rows[0] and "match_properties" not in rows[1]
    assert [(r["area"], r["group_key"], r["label"], r["compatible"]) for r in lines("licences")] == [("ä", "preset:bkg_vg25", "unknown", "unknown"), ("b 2+", "download:https://h.org/d", "unknown", "unknown"), ("b 10", "download:https://h.org/d", "unknown", "unknown"), ("z", "download:https://h.org/d", "unknown", "unknown")]
    assert lines("sources") == [{"name": "h.org (seen)", "href": "https://h.org/a/datasets/seen"}]


def test_counts_of_stored_rows(spark):
    rows = [("a", "matched", "ok"), ("a", "matched", None), ("a", "official_only", "issue"), ("a", "unmatched_osm", "issue"), ("b", "matched", "review"), (None, "matched", "issue")]
    found = areas.home_counts(spark.createDataFrame(rows, "area string, category string, level string"), ["area"]).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {"a": (2, 1, 1, 0, 1), "b": (1, 0, 0, 1, 0), None: (1, 0, 0, 0, 1)}


def issue(n, title, state="open", url="https://h.org/1", pull=None):
    return {"number": n, "title": title, "html_url": url, "state": state, "updated_at": "2024-01-01T00:00:00Z", "pull_request": pull, "labels": ["x"]}


def stored(spark, out):
    return [tuple(r) for r in spark.read.schema(discussions.ROW).json(f"{out}/issues").orderBy("number").select("number", "match", "state").collect()]


def test_registry_is_refreshed_or_kept(spark, tmp_path):
    answers, out = tmp_path / "answers", str(tmp_path / "registry")
    answers.mkdir()
    # nothing fetched, nothing stored
    assert not discussions.sync(spark, None, out, "t0")
    assert stored(spark, out) == [] and not Path(out, "checked").exists()
    (answers / "1.json").write_text(json.dumps([issue(7, " /a/b/ "), issue(3, "/", "closed"), issue(5, "/c", pull={"url": "u"})]))
    (answers / "2.json").write_text(json.dumps([issue(4, "/a/b", "locked")]))
    fetched = discussions.read_issue_pages(spark, str(answers))
    assert discussions.sync(spark, fetched, out, "t1")
    first = [(3, "/", "closed"), (4, "/a/b", "closed"), (7, "/a/b", "open")]
    assert stored(spark, out) == first and spark.read.json(f"{out}/checked").collect()[0][0] == "t1"
    found = discussions.issues_of(spark.read.schema(discussions.ROW).json(f"{out}/issues"), spark.createDataFrame([("/a/b/",), ("/no",)], "path string"), "path")
    assert sorted((r.path, r.number or 0) for r in found.collect()) == [("/a/b/", 4), ("/a/b/", 7), ("/no", 0)]
    # a row that does not fit, and an answer that is no list: the old registry stays
    for bad in ([issue(9, " ")], [issue(0, "/x")], [issue(9, "/x", url="here")], {"message": "rate limit"}, "nonsense"):
        (answers / "2.json").write_text(json.dumps(bad) if bad != "nonsense" else "[{")
        with pytest.raises((PySparkException, Py4JJavaError)):
            discussions.sync(spark, discussions.read_issue_pages(spark, str(answers)), out, "t2")
        assert stored(spark, out) == first
    # a failed fetch keeps it too, but nobody knows its date
    assert not discussions.sync(spark, None, out, "t3")
    assert stored(spark, out) == first and not Path(out, "checked").exists()


def test_state_counts_as_publication(spark):
    schema = "run_id string, phase string, status string, started_at timestamp, ended_at timestamp, published_at timestamp"
    runs = spark.createDataFrame([], schema).unionByName(spark.sql("select 'r' run_id, 'compare' phase, 'ok' status, timestamp'2024-01-01' started_at, timestamp'2024-01-02' ended_at, timestamp'2024-01-03' published_at"))
    state = lambda busy, day: spark.sql(f"select {busy} in_progress, timestamp'2024-01-{day}' completed_at")
    published = lambda s: history.key_figures(runs, s).collect()[0]["last_published_at"].day
    assert [published(s) for s in (None, state("false", "05"), state("true", "05"), state("null", "04"), state("false", "02"), state("false", "05").where("false"))] == [3, 5, 3, 4, 3, 3]
    assert history.key_figures(runs.limit(0), state("false", "05")).collect()[0]["last_compare_ok_at"] is None


def test_simplified_shapes(spark):
    geometry.register(spark)
    shape = lambda wkt, tol: spark.range(1).select(call("AsText", call("Simplify", call("FromText", F.lit(wkt)), F.lit(tol), F.lit(6))).alias("t")).first()["t"]
    assert shape("POLYGON ((0 0, 0.5 0.00001, 1 0, 1 1, 0 1, 0 0))", 2.5 / 111320) == "POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))"
    assert shape("POLYGON ((0 0, 1.00000049 0, 1 1, 0 1, 0 0))", 0.0) == "POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))"
    # nothing would be left: the shape itself
    tiny = "POLYGON ((0 0, 0 0.00000001, 0.00000001 0.00000001, 0 0))"
    assert shape(tiny, 2.5 / 111320).startswith("POLYGON ((0 0")
    broken = spark.range(1).select(call("Simplify", F.lit(b"broken"), F.lit(0.1), F.lit(6)).alias("g"), call("Envelope", F.lit(b"broken")).alias("e")).first()
    assert bytes(broken["g"]) == b"broken" and broken["e"] is None


def test_stored_box_comes_first(spark):
    geometry.register(spark)
    box = {f"_bbox_{c}": v for c, v in zip(("minx", "miny", "maxx", "maxy"), ("1", "2.5", "3", "4"), strict=True)}
    rows = [(0, box, b"broken"), (1, {**box, "_bbox_maxy": "Infinity"}, None), (2, {**box, "_bbox_minx": ""}, None), (3, None, None), (4, None, b"broken")]
    df = spark.createDataFrame(rows, "k int, props map<string,string>, geom binary")
    df = df.withColumn("geom", F.when(F.col("k").isin(1, 2, 3), geometry.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1))).otherwise(F.col("geom")))
    found = {r.k: r.b and tuple(r.b) for r in df.select("k", spatial.feature_box(F.col("props"), F.col("geom")).alias("b")).collect()}
    assert found == {0: (1, 2.5, 3, 4), 1: (0, 0, 1, 1), 2: (0, 0, 1, 1), 3: (0, 0, 1, 1), 4: None}


def test_numbers_inside_a_group_over_many_ranges(spark):
    rows = [(None if k % 50 == 0 else "hot" if k % 3 else f"s{k % 7}", None if k % 31 == 0 else (k * 37) % 101, k) for k in range(600)]
    df = spark.createDataFrame(rows, "source string, at int, k int").repartition(7)
    found = {r.k: r.place for r in live.numbered(df, "source", ["at", "k"], "place").collect()}
    wanted, groups = {}, {}
    for source, at, k in rows:
        groups.setdefault(source, []).append((at is not None, at or 0, k))
    for members in groups.values():
        wanted |= {k: n for n, (_, _, k) in enumerate(sorted(members), 1)}
    assert found == wanted
    assert live.numbered(df.limit(0), "source", ["at", "k"], "place").count() == 0


def test_row_keys(spark):
    rows = spark.createDataFrame([("a", "7", 1), ("a", None, 2), ("a", "", 3), ("b", " ", 9), ("b", "x", 10)], "source string, ident string, at int")
    assert sorted(r.row_key for r in live.row_keys(rows, "source", "ident", ["at"], F.lit("wfs")).collect()) == ["wfs:a:2", "wfs:a:3", "wfs:a:7", "wfs:b:1", "wfs:b:x"]
