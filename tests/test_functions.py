"""Single functions on the values that a user of the comparison relies on."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from landmatch.functions import dates, geometry, keys, web
from landmatch.operators import dictionary, history, metrics, report, resolver, spatial
from landmatch.sources import readers, sinks
from landmatch.streaming import fold


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("side", "preset", "raw", "wanted"),
    [
        ("osm", "berlin-bezirk-rs5", "11001", "11000001"), ("osm", "berlin-bezirk-rs5", "11012", "11000012"), ("official", "regional-12", "01001", "010010000000"),
        ("official", "regional-12", "11", "110000000000"), ("official", "regional-12", "1200000000001", "120000000000"), ("official", "plz-5", "13585", "13585"),
        ("official", "plz-5", "1234", "01234"), ("official", "plz-5", "10115-000", "10115"), ("osm", "regional-12", "010515163", "010515163000"), ("osm", "amtlicher-8", "12073532", "12073532"),
        ("osm", "amtlicher-8", "", "00000000"), ("osm", "plz-5", "987", "00987"), ("osm", "plz-5", "123456", "12345"), ("osm", "text", " Friedrichs  Hain ", "friedrichs hain"), ("official", "text", "FRIEDRICHSHAIN", "friedrichshain"),
    ],
)
def test_keys(spark, side, preset, raw, wanted):
    assert one(spark, (keys.osm_key if side == "osm" else keys.official_key)(F.lit(raw), preset)) == wanted


def test_key_helpers(spark):
    assert one(spark, keys.uri_component(F.lit("a b/ü~!'()*"))) == "a%20b%2F%C3%BC~!'()*"
    assert one(spark, keys.file_stem(F.lit("Ä!"))).startswith("key_")
    assert one(spark, keys.municipality_key(F.lit("010515163099"))) == "01051099"
    with pytest.raises(ValueError):
        keys.check_transposition("a", "b", {"x": "1", "y": "1"}, "a", "b")


def test_shrink_and_measures(spark):
    geometry.register(spark)
    square = geometry.rectangle(F.lit(9.0), F.lit(49.0), F.lit(11.0), F.lit(51.0))
    wide = one(spark, geometry.call("Envelope", geometry.call("Shrink", square, F.lit(0.7))))
    assert 1.39 < wide.e - wide.w < 1.41
    for factor in (1.0, 0.0, -0.5, 1.5):
        same = one(spark, geometry.call("Envelope", geometry.call("Shrink", square, F.lit(factor))))
        assert (same.w, same.e) == (9.0, 11.0)
    box = lambda x: geometry.rectangle(F.lit(x), F.lit(0.0), F.lit(x + 2), F.lit(1.0))
    row = one(spark, geometry.call("Measures", box(0.0), box(1.0)))
    assert (row.intersection, row.union, row.hausdorff, row.boundary) == (1.0, 3.0, 1.0, 6.0)
    degree = one(spark, geometry.call("GeodesicArea", geometry.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))
    assert degree == pytest.approx(12_308_778_361, rel=1e-4)
    utm = one(spark, geometry.call("Envelope", geometry.call("ToUtm", geometry.call("FromText", F.lit("POINT (9 48)")), F.lit(32))))
    assert utm.w == pytest.approx(500_000, abs=1e-3) and utm.s == pytest.approx(5_316_300, abs=400)


@pytest.mark.parametrize(
    ("official", "osm", "kept"),
    [
        ([(9.0, 50.0, 9.2, 50.2)], (9.05, 50.05, 9.1, 50.1), True), ([(9.0, 50.0, 9.05, 50.05)], (10.0, 51.0, 10.05, 51.05), False),
        ([(9.0, 50.0, 9.2, 50.2)], (9.15, 50.0, 11.0, 50.2), False), ([(9.0, 50.0, 9.1, 50.1), (9.1, 50.0, 9.2, 50.1)], (9.12, 50.02, 9.18, 50.08), True), ([], (9.0, 50.0, 9.1, 50.1), False),
    ],
)
def test_scope(spark, official, osm, kept):
    geometry.register(spark)
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    frame = lambda rows: spark.createDataFrame([(k, "a", *r) for k, r in enumerate(rows)], "id long, area string, x0 double, y0 double, x1 double, y1 double").withColumn("geom", geometry.rectangle(*corners))
    found = spatial.polygon_scope(frame([osm]), frame(official), ["area"], 0.25, "id")
    assert [r.id for r in found.collect()] == ([0] if kept else [])


def test_triage(spark):
    none = F.lit(None).cast("array<string>")
    got = one(spark, metrics.triage(F.lit(0.998), F.lit(0.1), F.lit(0.1), F.lit(0.01), none))
    assert (got.level, got.reasons) == ("ok", ["STRONG_OVERLAP_LOW_DIFF"])
    rows = [("a", f"k{k}", *(0.7 if k == 11 else 0.99, 0.99) , *[0.1] * 6) for k in range(12)]
    names = list(metrics.BASELINE)
    schema = "area string, key string, " + ", ".join(f"{m} double, prev_{m} double" for m in names)
    found = metrics.anomalies(spark.createDataFrame(rows, schema), ["area"], "key").collect()
    assert [(r.key, r.reasons) for r in found] == [("k11", ["BASELINE_ANOMALY_IOU_DELTA"])]


def test_dates(spark):
    assert str(one(spark, dates.strict_date(F.lit("31122049")))) == "2049-12-31" and one(spark, dates.strict_date(F.lit("31022024"))) is None
    assert str(one(spark, dates.strict_date(F.lit("010199")))) == "1999-01-01"
    assert str(one(spark, dates.window_key(F.lit("2024-06-30 22:30:00").cast("timestamp_ntz")))) == "2024-06-30"
    assert one(spark, dates.iso_week(F.lit("2027-01-01").cast("date"))) == "2026-W53"


def test_sources(spark, tmp_path):
    geometry.register(spark)
    (tmp_path / "f.json").write_text('{"features":[{"id":"r1","properties":{"name":"n"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,1],[0,0]]]}}]}')
    row = readers.read_geojson(spark, str(tmp_path / "f.json")).withColumn("area", geometry.call("Area", F.col("geom"))).first()
    assert (row.feature_id, row.props["name"], row.area) == ("r1", "n", 2.0)
    (tmp_path / "r.txt").write_bytes("10310120240100000      Kläs\n\n6031012024010510010003Ort\n".encode("latin-1"))
    lines = readers.read_register_text(spark, str(tmp_path / "r.txt")).collect()
    assert [r.line for r in lines] == [1, 2] and lines[1].land == "01" and "ä" in lines[0].name + "".join(str(x) for x in lines[0])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/GV_2024.txt", b"one")
        z.writestr("y.bin", b"two")
    members = readers.read_archive_members(spark, str(tmp_path / "a.zip"), r"GV_\d+\.txt$").collect()
    assert [(m.member, bytes(m.content)) for m in members] == [("x/GV_2024.txt", b"one")]
    config = readers.parse_config("a", '{"id_preset": "plz-5", "osm_profile": "p", "match_property": "m", // note\n "scope_filter": "centroid_in_official_coverage",}')
    assert config.scope_filter == "intersects_official_coverage"
    with pytest.raises(ValueError):
        readers.parse_config("a", '{"id_preset": "plz-5", "osm_profile": "p", "match_property": "m", "bbox_filter": "official_bbox_overlap"}')
    events = spark.createDataFrame([('{"kind":"run_start","runId":"a"}',), ("bad",), ('{"runId":"b"}',)], "value string")
    assert [e.runId for e in readers.parse_events(events).collect()] == ["a"]


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Onlineprodukt_30.06.2024"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Ort</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="6"><c r="A6"><v>0</v></c></row><row r="7"><c r="A7"><v>60</v></c><c r="H7" t="s"><v>0</v></c></row></sheetData></worksheet>')
    rows = readers.read_workbook(spark, str(tmp_path / "w.xlsx"), r"^Onlineprodukt").collect()
    assert [(r.line, r.a, r.h) for r in rows] == [(7, "60", "Ort")]


def test_workbook_by_its_relations_and_date(spark, tmp_path):
    """The second sheet is stored as the first file; its name tells the date; rows without a number first are headings."""
    sheet = lambda *rows: "<worksheet><sheetData>" + "".join(f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t>{a}</t></is></c><c r="H{r}" t="inlineStr"><is><t>{h}</t></is></c></row>' for r, a, h in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="Deckblatt" r:id="rId2"/><sheet name="Onlineprodukt_Gemeinden30062024" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet((7, " 60 ", "Ort"), (8, "Satz", "x"), (9, "", "y"), (10, "50", "Amt")))
        z.writestr("xl/worksheets/sheet2.xml", sheet((7, "1", "cover")))
    path = str(tmp_path / "w.xlsx")
    rows = readers.read_workbook(spark, path, r"^Onlineprodukt_Gemeinden(\d{8})$").collect()
    assert [(r.line, r.a, r.h, str(r.snapshot)) for r in rows] == [(7, "60", "Ort", "2024-06-30"), (10, "50", "Amt", "2024-06-30")]
    assert [(r.h, r.snapshot) for r in readers.read_workbook(spark, path, "^Deck").collect()] == [("cover", None)]
    with pytest.raises(Exception, match="no sheet matches"):
        readers.read_workbook(spark, path, "^Nichts").collect()


def test_dates_in_names(spark):
    names = ["GV_31012024.txt", "GV_310150.txt", "GV_310151.txt", "GV_31022024.txt", "GV_290224.txt", "GV_1234567.txt", "other", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(dates.named_date(F.col("n"), r"GV_(\d+)\.txt$").alias("d")).collect()
    assert [r.d and str(r.d) for r in rows] == ["2024-01-31", "2050-01-31", "1951-01-31", None, "2024-02-29", None, None, None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"k{k}", k) for k in range(50)], "area string, key string, v long")
    sinks.write_comparison(rows, str(tmp_path / "t"), buckets=4)
    assert sinks.lookup(spark.read.parquet(str(tmp_path / "t")), "a", "k7", buckets=4).first()["v"] == 7
    snap = lambda v: spark.createDataFrame([("a", "2024-01-01", v)], "area string, run_id string, n long")
    sinks.write_snapshots(snap(1), snap(2), str(tmp_path / "s"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    """A log that arrives in two files, folded as a stream, gives the runs of the whole log."""
    lines = [f'{{"kind":"{k}","run_id":"r{n % 3}","at":"2024-01-0{n % 5 + 1}T00:00:00","seq":{n},"step":"compare:x","dataset":"d","status":"ok","duration_ms":{n}}}' for n, k in enumerate(["run_start", "step_end", "dataset_end", "run_end"] * 5)]
    (tmp_path / "in").mkdir()
    at = [str(tmp_path / x) for x in ("in", "table", "ck")]
    for k, part in enumerate((lines[:11], lines[11:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(part))
        fold.fold_stream(fold.read_log(spark, at[0]), *at[1:]).awaitTermination()
    wanted = history.fold_runs(spark.read.schema(fold.LOG).json(at[0]))
    got = fold.current_runs(spark, at[1]).select(*wanted.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))




def test_instants_do_not_depend_on_the_session(spark):
    """The same answers in a zone with other summer times."""
    utc = lambda t: F.lit(t).cast("timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Europe/Berlin", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(spark, dates.iso_instant(F.lit("2024-06-01T12:00:00Z"))) == "2024-06-01T12:00:00.000Z"
            assert one(spark, dates.iso_instant(F.lit("2024-03-10T02:30:00.25"))) == "2024-03-10T02:30:00.250Z"
            assert one(spark, dates.iso_instant(F.lit(" 2024-06-01 "))) == "2024-06-01T00:00:00.000Z"
            assert one(spark, dates.stale(utc("2024-10-24 12:00:00"), utc("2024-10-29 12:00:00"), 5)) is False
            assert one(spark, dates.stale(utc("2024-10-24 12:00:00"), utc("2024-10-29 12:00:01"), 5)) is True
            for hours, wanted in ((0.5, ("minutes", 30)), (25, ("hours", 25)), (26, ("days", 1)), (24 * 370, ("months", 12)), (24 * 800, ("years", 2))):
                found = one(spark, dates.age_bucket(utc("2022-01-01 00:00:00"), utc("2022-01-01 00:00:00") + F.make_dt_interval(mins=F.lit(int(hours * 60)))))
                assert (found.unit, found.n) == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_instants_read_their_text_once(spark):
    texts = {"2024-06-01T12:00:00.25-0130": "2024-06-01T13:30:00.250Z", "2024-06-01 12:00:59.9999": "2024-06-01T12:00:59.999Z", "2024-06-01|+|01|00": None, "2024-02-30": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.i for r in df.select("t", dates.iso_instant(F.col("t")).alias("i")).collect()} == texts
    plan = df.select(dates.extract_name(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_") + plan.count("rlike") <= 2


def test_months_end_on_the_last_day_of_a_shorter_month(spark):
    """2023-01-31 to 2024-02-29 are 13 full months, as DuckDB's date_sub counts them, but not before the time of day."""
    cases = {("2023-01-31 08:00:00", "2024-02-29 08:00:00"): ("months", 13), ("2023-01-31 08:00:00", "2024-02-29 07:59:59"): ("months", 12), ("2023-01-31 08:00:00", "2024-03-30 09:00:00"): ("months", 13), ("2022-12-31 00:00:00", "2024-02-29 00:00:00"): ("years", 1), ("2022-12-30 00:00:00", "2024-02-28 00:00:00"): ("months", 13)}
    for (start, end), wanted in cases.items():
        found = one(spark, dates.age_bucket(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        assert (found.unit, found.n) == wanted


def test_live_queries(spark):
    box = tuple(F.lit(x) for x in (13.0, 52.5, 13.25, 53.0))
    assert one(spark, web.overpass_query("postal_code", box)) == '[out:json][timeout:90];\n(\n  relation["boundary"="postal_code"](52.5,13,53,13.25);\n  way["boundary"="postal_code"](52.5,13,53,13.25);\n);\nout geom;'
    old = one(spark, web.wfs_url(F.lit("https://h/x"), F.lit("a:b c"), F.lit("1.1.0"), box, srs=F.lit("EPSG:25833")))
    assert old == "https://h/x?service=wfs&version=1.1.0&request=GetFeature&typeName=a%3Ab+c&bbox=13%2C52.5%2C13.25%2C53%2CEPSG%3A25833&maxFeatures=50&srsName=EPSG%3A25833"
    assert "&bbox=13%2C52.5" in one(spark, web.wfs_url(F.lit("h"), F.lit("a"), F.lit("2.0.0"), box, axis=F.lit("lonlat")))
    assert one(spark, web.reference_date(F.lit("Aktualit&auml;tsstand: 1.7.2026"))) == "2026-07-01"
    assert one(spark, web.reference_date(F.lit("Aktualitätsstand: 32.07.2026"))) is None and one(spark, web.reference_date(F.lit("01.07.2026"))) is None
    assert [one(spark, web.placeholder(F.lit(x))) for x in ("", "—", "nan", "--", "null", "-1")] == [True, True, True, True, False, False]
    view = one(spark, web.map_view(F.lit("23.5/89.1234567/-180x")))
    assert (view.zoom, view.lat, view.lon) == (23.5, 89.1234567, -180.0) and one(spark, web.map_view(F.lit("25/0/0"))) is None
    assert one(spark, web.map_view_text(F.lit(12.34), F.lit(52.12345678), F.lit(-13.0))) == "12.3/52.123457/-13"
    assert one(spark, web.object_identity(F.lit('{"id":"5"}'))) is None and one(spark, web.object_identity(F.lit('{"id":5}'))).type == "way"
    assert one(spark, dictionary.name_form(F.lit("  Ｂad \u200bOrb "))) == "bad orb"


def test_click_in_draw_order(spark):
    hits = [(1, 1, "b", "matched"), (1, 2, "a", "official_only"), (2, 1, "x", "unmatched_osm"), (2, 2, "y", "official_only"), (3, 1, "z", "official_only")]
    found = resolver.click_decision(spark.createDataFrame(hits, "click long, at long, feature_key string, category string"), ["click"], "at")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "open", "b"), (2, "choose", "x"), (3, "open", "z")]


def test_grid_pairs_of_any_size(spark):
    """Boxes of very different sizes, against all pairs, and the rows that a box becomes."""
    boxes = [(k, "a", float(k % 17), float(k % 13), k % 17 + 4.0 ** (k % 7) / 8, k % 13 + 4.0 ** (k % 5) / 8) for k in range(90)]
    schema = "id long, g string, x0 double, y0 double, x1 double, y1 double"
    left, right = spark.createDataFrame(boxes[:50], schema), spark.createDataFrame(boxes[40:], schema)
    found = [(r.id, r.r_id) for r in spatial.grid_pairs(left, right, ["g"], 0.05).select("id", "r_id").collect()]
    wanted = [(a[0], b[0]) for a in boxes[:50] for b in boxes[40:] if a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]]
    assert sorted(found) == sorted(wanted)
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    rows = left.select(F.size(spatial.cells(*corners, spatial.level_of(*corners, 0.05), 0.05)).alias("n")).agg(F.max("n")).first()[0]
    assert rows <= 4


def test_feature_tables_without_a_difference(spark):
    geometry.register(spark)
    square = geometry.rectangle(F.lit(10.0), F.lit(50.0), F.lit(11.0), F.lit(51.0))
    rows = spark.createDataFrame([("a", "k", "matched")], "area string, key string, category string").select("*", square.alias("official_geom"), square.alias("osm_geom"))
    corner = geometry.call("FromText", F.lit("POINT (11 51)"))
    found = report.feature_tables(rows, ["area"], "key", F.max(corner)).select("layer", "feature_id", geometry.call("AsText", F.col("geom")).alias("g")).collect()
    assert [(r.layer, r.feature_id, r.g) for r in found if r.layer == "diff"] == [("diff", report.NO_DIFFERENCE, "POINT (11 51)")]
    assert sum(r.layer == "overlay" for r in found) == 2


def test_candidate_point_sources(spark, tmp_path):
    geometry.register(spark)
    assert readers.read_candidate_points(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "c.json").write_text('{"features":[{"id":"1","properties":{"osm_way_id":"12345"},"geometry":{"type":"Point","coordinates":[10,50]}},{"id":"2","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,1],[0,0]]]}}]}')
    assert [r.feature_id for r in readers.read_candidate_points(spark, str(tmp_path / "c.json")).collect()] == ["1"]
    for name in ("b", ".hidden", "a"):
        (tmp_path / "areas" / name).mkdir(parents=True)
    assert readers.areas_below(spark, str(tmp_path / "areas")) == ["a", "b"]
    events = spark.createDataFrame([('{"runId":"b"}',)], "value string")
    with pytest.raises(Exception, match="no kind"):
        readers.parse_events(events, strict=True).collect()
