"""Answers, relations, candidates in polygons, exact medians, collation keys and digests against values worked out by hand or in Python."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from landmatch.functions import geometry, web
from landmatch.functions.geometry import call
from landmatch.operators import answers, audit, dictionary, metrics, spatial
from landmatch.plans import shapes
from landmatch.sources import sinks


@pytest.fixture(autouse=True)
def functions(spark):
    geometry.register(spark)


def wkt(spark, column):
    return spark.range(1).select(call("AsText", column).alias("t")).first()["t"]


def answered(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = answers.features(df, "text", ["k"]).withColumn("wkt", call("AsText", "geom")).orderBy("k", "id").collect()
    return [(r["k"], r["error"], r["id"], r["properties"], r["wkt"]) for r in found]


RING = "<gml:LinearRing><gml:posList>{}</gml:posList></gml:LinearRing>"


def member(inside, tag="wfs:member", attributes='gml:id="a.1"'):
    return f'<c xmlns:wfs="w" xmlns:gml="g"><{tag}><u {attributes}>{inside}</u></{tag}></c>'


def polygon(outer, *holes):
    return "<gml:Polygon><gml:exterior>" + RING.format(outer) + "</gml:exterior>" + "".join("<gml:interior>" + RING.format(h) + "</gml:interior>" for h in holes) + "</gml:Polygon>"


@pytest.mark.parametrize(
    ("shape", "wanted"),
    [
        (polygon("0 0 4 0 4 4 0 4"), "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))"),  # an open ring is closed
        (polygon("0 0 4 0 4 4 0 4 0 0", "1 1 2 1 2 2", "1 1"), "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 1))"),  # a hole of one point goes
        (polygon("0 0 4 0 4"), None),  # an odd count
        (polygon("0 0 4 0"), None),  # two points
        (polygon("0 0 x 4 0 4 4 0 4"), "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))"),  # tokens that are no numbers are passed over
        (f"<gml:MultiSurface><m>{polygon('0 0 1 0 1 1')}</m><m>{polygon('5 5 6 5 6 6')}</m></gml:MultiSurface>", "MULTIPOLYGON (((0 0, 1 1, 1 0, 0 0)), ((5 5, 6 6, 6 5, 5 5)))"),
        (f"<gml:MultiSurface><m>{polygon('0 0 1 0 1 1')}</m><m>{polygon('0 0')}</m></gml:MultiSurface>", "POLYGON ((0 0, 1 1, 1 0, 0 0))"),
        ("<gml:MultiSurface/>", None),
        ("<gml:Point><gml:pos>1 2</gml:pos></gml:Point>", None),
    ],
)
def test_shapes_of_members(spark, shape, wanted):
    ((_, error, found, properties, got),) = answered(spark, member(f"<n> x </n><theGeom>{shape}</theGeom>"))
    assert (error, found, properties, got) == (None, "a.1", {"n": "x"}, wanted)


def test_kinds_of_answers(spark):
    collection = '{"features":[{"type":"Feature","id":7,"properties":{"a":"b"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":null,"geometry":null},{"type":"x"}]}'
    got = answered(
        spark, member("<n>1</n><gml:boundedBy><n>no</n></gml:boundedBy>", "gml:featureMember", 'fid="f"'), member("<n> </n>", attributes=""), collection,
        "<r xmlns:ows='o'><ows:ExceptionText> bad layer </ows:ExceptionText></r>", "<a><b></a>", "", None, "<c/>",
        '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/hostname">]><a>&x;</a>',
    )
    assert got == [
        (0, None, "f", {"n": "1"}, None), (1, None, None, None, None), (2, None, None, None, None), (2, None, "7", {"a": "b"}, "POLYGON ((0 0, 1 1, 1 0, 0 0))"),
        (3, "bad layer", None, None, None), (4, "INVALID_WFS_XML", None, None, None), (8, "INVALID_WFS_XML", None, None, None),
    ]


def related(spark, *ways):
    rows = spark.createDataFrame([(1, role, text) for role, text in ways], "relation_id int, role string, text string").withColumn("geom", call("FromText", "text"))
    return answers.relation_polygons(rows).select(call("AsText", "geom").alias("t")).first()["t"]


def test_relations(spark):
    square = [("outer", "LINESTRING (0 0, 9 0, 9 9)"), ("outer", "LINESTRING (0 9, 9 9)"), ("outer", "LINESTRING (0 0, 0 9)")]
    assert related(spark, *square) == "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0))"
    hole = [("inner", "LINESTRING (1 1, 2 1, 2 2)"), ("inner", "LINESTRING (1 1, 2 2)")]
    assert related(spark, *hole, *square) == "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 2 1, 2 2, 1 1))"
    # a ring within a hole's place is a polygon of its own, and the hole goes to the smaller shell around it
    island = [("outer", "LINESTRING (20 0, 29 0, 29 9, 20 9, 20 0)"), ("outer", "LINESTRING (21 1, 25 1, 25 5, 21 5, 21 1)"), ("inner", "LINESTRING (22 2, 23 2, 23 3, 22 2)")]
    assert related(spark, *island) == "MULTIPOLYGON (((20 0, 20 9, 29 9, 29 0, 20 0)), ((21 1, 21 5, 25 5, 25 1, 21 1), (22 2, 23 2, 23 3, 22 2)))"
    assert related(spark, *square[:2]) is None  # open
    assert related(spark, *square[:2], (None, "LINESTRING (30 0, 31 0, 31 1, 30 0)")) == "POLYGON ((30 0, 31 1, 31 0, 30 0))"  # polygons win over lines
    assert related(spark, *hole) is None
    assert related(spark, ("outer", None)) is None


def test_candidates_in_polygons(spark):
    rows = spark.createDataFrame([(1, "k1", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (1, "k2", None), (2, "k3", "POLYGON ((0 0, 1000 0, 1000 1000, 0 0))")], "g int, key string, t string").withColumn("geom", call("FromText", "t"))
    points = [
        (1, "way", 9, "", 2.0, 2.0), (1, "relation", 11, "k1", 2.5, 2.0), (1, "relation", 2, "zz", 8.5, 8.5), (1, "relation", 3, "k2", 2.0, 3.0), (1, "relation", 4, "", 5.0, 5.0),
        (1, "relation", 5, "", 1.0, 1.0), (1, "way", 9, "", 2.1, 2.1), (1, "way", 12, "", 3.6, 5.0), (2, "way", 9, "", 700.0, 300.0), (2, "way", 8, "", 300.0, 700.0),
    ]
    df = spark.createDataFrame(points, "g int, osm_type string, osm_id long, canonical string, x0 double, y0 double").select("*", F.lit(" n ").alias("name"), F.lit("").alias("postal_code"))
    found = spatial.points_in_polygons(rows, df, rows, ["g"], "key", 4.0, fields=("name", "postal_code")).collect()
    got = {r["key"]: [(c["osm_type"], c["osm_id"], c["name"], c["postal_code"]) for c in r["candidates"]] for r in found}
    # shrunk to 1.5..8.5 with a hole of 4.3..5.7; its edge counts as inside; k2's own point stays out of k1
    assert got == {"k1": [("relation", 2, "n", None), ("relation", 11, "n", None), ("way", 9, "n", None), ("way", 12, "n", None)], "k2": [], "k3": [("way", 9, "n", None)]}


def test_answers_share_a_parser(spark):
    """A thread makes one parser, and a broken answer does not spoil it for the next one."""
    texts = ['<r><member><u gml:id="1"/></member></r>', "<r><member>", "", '<r><member><u gml:id="2"/></member></r>']
    found = [(r.error, r.id) for r in answers.features(spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1), "t", ["k"]).orderBy("k").collect()]
    assert found == [(None, "1"), (answers.INVALID, None), (None, "2")]
    source = next(p for p in geometry.SOURCES if p.name == "ShapeUdfs.java").read_text()
    assert "ThreadLocal<DocumentBuilder>" in source


def test_answers_are_dealt(spark, small):
    """The customers of one split of a file are not one task's."""
    one = spark.read.parquet(f"{small}/customer.parquet")
    made = shapes.answer_texts(spark, small)
    assert one.rdd.getNumPartitions() == 1 and made.rdd.getNumPartitions() > 1
    assert made.count() == one.count()


def test_points_of_known_keys_meet_their_rows_only(spark):
    rows = spark.createDataFrame([(1, k, 0.0, 0.0, 9.0, 9.0) for k in ("a", "b", "c")], "g int, key string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, "way", 1, "a", 1.0, 1.0), (1, "way", 2, "zz", 2.0, 2.0), (1, "way", 3, "b", 20.0, 2.0), (1, "way", 4, "", 3.0, 3.0)], "g int, osm_type string, osm_id long, canonical string, x0 double, y0 double")
    hits = spatial.eligible_hits(rows, points, rows, ["g"], "key", 4.0).select("key", "r_osm_id").collect()
    assert sorted(map(tuple, hits)) == [("a", 1), ("a", 2), ("a", 4), ("b", 2), ("b", 4), ("c", 2), ("c", 4)]


def test_scope_judges_rows_of_one_id_one_by_one(spark):
    box = "g int, id int, x0 double, y0 double, x1 double, y1 double"
    osm = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, 1.0), (1, 7, 90.0, 0.0, 91.0, 1.0), (1, 8, 0.0, 0.0, 1.0, 1.0), (2, 9, 0.0, 0.0, 1.0, 1.0), (1, None, 0.0, 0.0, 1.0, 1.0)], box)
    official = spark.createDataFrame([(1, n, 0.0, 0.0, 40.0, 40.0) for n in range(50)], box)
    kept = spatial.scope_semi_join(osm, official, ["g"], 8.0, keep=F.col("r_x1") > F.col("x1")).collect()
    assert sorted((r.id or 0, r.x0) for r in kept) == [(0, 0.0), (7, 0.0), (8, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 7, 500, 501])
def test_exact_medians(spark, n):
    rng = random.Random(n)
    values = [(g, rng.choice([rng.uniform(-1, 1), rng.gauss(0, 1e6), 1e-300, -0.0, 0.0, 5.0, rng.randrange(3) * 1e290])) for g in "ab" for _ in range(n)]
    got = {r["g"]: (r["m"], r["n"]) for r in metrics.exact_medians(spark.createDataFrame(values, "g string, v double"), ["g"], "v", "m").collect()}
    for g in "ab":
        assert got[g] == (pytest.approx(statistics.median(v for h, v in values if h == g), rel=1e-15), n)
    assert metrics.exact_medians(spark.createDataFrame([], "g string, v double"), ["g"], "v", "m").collect() == []


def test_key_order_and_compatible_form(spark):
    wanted = ["a2", "A2", "ä2", "Ä2", "a10", "a010b", "b1", "ß", "st", "z"]
    df = spark.createDataFrame([(x,) for x in reversed(wanted)], "s string")
    got = [r["s"] for r in df.orderBy(dictionary.key_order(F.col("s")), "s").collect()]
    assert got == wanted
    base = df.groupBy(dictionary.key_order(F.col("s"), 0).alias("k")).agg(F.count("*").alias("n")).where("n > 1").collect()
    assert [r["n"] for r in base] == [4]
    forms = spark.createDataFrame([("ﬁ Ⅳ１",), ("é",), (None,)], "s string").select(call("Compatible", "s").alias("f"))
    assert [r["f"] for r in forms.collect()] == ["fi IV1", "é", None]
    plan = df.select(dictionary.name_form(F.col("s")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_fingerprints(spark):
    files = [("a", None, "b/2", b"two"), ("a", None, "b/10", b"ten"), ("a", 1, "x", None), ("ü", 1, "x", b""), ("a", None, "b/2", b"again")]
    df = spark.createDataFrame(files, "owner string, part int, path string, content binary").repartition(3)
    digest = lambda *parts: hashlib.sha256(b"".join(p + b"\0" for p in parts)).hexdigest()
    got = {(r["owner"], r["part"]): r["fingerprint"] for r in audit.fingerprint(df, ["owner", "part"]).collect()}
    assert got == {("a", None): digest(b"b/10", b"ten", b"b/2", b"again", b"b/2", b"two"), ("a", 1): digest(b"x", b""), ("ü", 1): digest(b"x", b"")}
    assert audit.fingerprint(df.limit(0), ["owner"]).collect() == []


def test_documents_by_key(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{k}", f'{{"n":{k}}}') for k in range(40)], "key string, document string")
    sinks.write_documents(rows, str(tmp_path / "d"), "key", "document", buckets=4)
    stored = spark.read.json(str(tmp_path / "d"))
    assert sorted((r["key"], r["document"]) for r in stored.collect()) == sorted((f"k{k}", f'{{"n":{k}}}') for k in range(40))
    for bad, why in ((rows.union(rows.limit(1)), "two documents"), (rows.limit(3).withColumn("document", F.lit("{")), "no document")):
        with pytest.raises(ValueError, match=why):
            sinks.write_documents(bad, str(tmp_path / "e"), "key", "document")
    assert not (tmp_path / "e").exists()


def test_editor_links(spark):
    null = F.lit(None).cast("double")
    box = tuple(F.lit(x) for x in (13.0, 52.0, 13.5, 52.25))
    link = lambda *x: spark.range(1).select(web.editor_links(*x, "a~b c").alias("l")).first()["l"]
    full = link(box, F.lit(5), F.lit("https://h/ü (1).json"))
    assert full["edit"].startswith(f"{web.WEB_EDITOR}#map=11%2F52.125000%2F13.250000&id=r5&disable_features=address_points%2Cpoints")
    assert full["edit"].endswith("&gpx=https%3A%2F%2Fh%2F%C3%BC+%281%29.json&hashtags=a%7Eb+c")
    assert full["browse"] == f"{web.OBJECT_PAGE}5"
    assert full["load"] == f"{web.REMOTE_CONTROL}/load_object?relation_members=true&objects=r5&changeset_hashtags=a~b%20c"
    assert full["import"] == f"{web.REMOTE_CONTROL}/import?new_layer=true&changeset_hashtags=a~b%20c&url=https%3A%2F%2Fh%2F%C3%BC%20(1).json"
    bare = link((null,) * 4, F.lit(None).cast("long"), F.lit(None).cast("string"))
    assert bare["edit"] == f"{web.WEB_EDITOR}#disable_features={web.HIDDEN.replace(',', '%2C')}&hashtags=a%7Eb+c"
    assert (bare["browse"], bare["load"], bare["import"]) == (None, None, None)
