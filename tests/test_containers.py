"""FlatGeobuf and GeoPackage files written here by other means, and read by the data sources."""

from __future__ import annotations

import math
import random
import sqlite3
import struct

import numpy as np
import pytest

from landmatch.functions import geometry
from landmatch.functions.geometry import call
from landmatch.sources import containers

flatbuffers = pytest.importorskip("flatbuffers")


def vector(b, values, size, put):
    b.StartVector(size, len(values), size)
    for v in reversed(values):
        put(v)
    return b.EndVector()


def offsets(b, items):
    b.StartVector(4, len(items), 4)
    for x in reversed(items):
        b.PrependUOffsetTRelative(x)
    return b.EndVector()


def sized(b, root):
    b.Finish(root)
    raw = bytes(b.Output())
    return struct.pack("<I", len(raw)) + raw


COLUMNS = [("name", 11), ("n", 7), ("ok", 2), ("x", 10), ("small", 1), ("seq", 5), ("raw", 14)]


def head(kind, count, node_size):
    b = flatbuffers.Builder(0)
    made = []
    for name, t in COLUMNS:
        text = b.CreateString(name)
        b.StartObject(11)
        b.PrependUOffsetTRelativeSlot(0, text, 0)
        b.PrependUint8Slot(1, t, 0)
        made.append(b.EndObject())
    columns, name = offsets(b, made), b.CreateString("layer")
    b.StartObject(14)
    b.PrependUOffsetTRelativeSlot(0, name, 0)
    b.PrependUint8Slot(2, kind, 0)
    b.PrependUOffsetTRelativeSlot(7, columns, 0)
    b.PrependUint64Slot(8, count, 0)
    b.PrependUint16Slot(9, node_size, 16)
    return b"fgb\x03fgb\x00" + sized(b, b.EndObject())


def shape(b, rings=None, parts=None, kind=0):
    inner = [shape(b, r) for r in parts] if parts else None
    below = offsets(b, inner) if inner else None
    xy = ends = None
    if rings:
        flat = [c for ring in rings for p in ring for c in p]
        xy = vector(b, flat, 8, b.PrependFloat64)
        if len(rings) > 1:
            ends = vector(b, np.cumsum([len(r) for r in rings]).tolist(), 4, b.PrependUint32)
    b.StartObject(8)
    if ends is not None:
        b.PrependUOffsetTRelativeSlot(0, ends, 0)
    if xy is not None:
        b.PrependUOffsetTRelativeSlot(1, xy, 0)
    b.PrependUint8Slot(6, kind, 0)
    if below is not None:
        b.PrependUOffsetTRelativeSlot(7, below, 0)
    return b.EndObject()


def told(values):
    out = b""
    for k, (_, t) in enumerate(COLUMNS):
        if values[k] is not None:
            form = {7: "<q", 2: "<?", 10: "<d", 1: "<B", 5: "<i"}.get(t)
            raw = values[k] if t == 14 else values[k].encode() if t == 11 else b""
            out += struct.pack("<H", k) + (struct.pack(form, values[k]) if form else struct.pack("<I", len(raw)) + raw)
    return out


def feature(values, **geometry_of):
    b = flatbuffers.Builder(0)
    g = shape(b, **geometry_of) if geometry_of else None
    raw = b.CreateByteVector(told(values))
    b.StartObject(3)
    if g is not None:
        b.PrependUOffsetTRelativeSlot(0, g, 0)
    b.PrependUOffsetTRelativeSlot(1, raw, 0)
    return sized(b, b.EndObject())


def write(path, kind, features, boxes=None, node_size=16):
    """features in the order of the index; boxes: theirs, for an index."""
    index = b""
    if boxes is not None:
        at = np.cumsum([0, *map(len, features)])[:-1]
        levels = [[(*box, int(a)) for box, a in zip(boxes, at, strict=True)]]
        while len(levels) == 1 or len(levels[-1]) > 1:
            below = levels[-1]
            groups = [below[k : k + node_size] for k in range(0, len(below), node_size)]
            levels.append([(min(g[0] for g in x), min(g[1] for g in x), max(g[2] for g in x), max(g[3] for g in x), k * node_size) for k, x in enumerate(groups)])
        first = 0
        flat = []
        for depth in range(len(levels) - 1, -1, -1):
            first += len(levels[depth])
            flat += [(*n[:4], n[4] if depth == 0 else first + n[4]) for n in levels[depth]]
        index = b"".join(struct.pack("<ddddQ", *n) for n in flat)
    path.write_bytes(head(kind, len(features), node_size if boxes is not None else 0) + index + b"".join(features))


def squares(n):
    rng = random.Random(n)
    out = []
    for k in range(n):
        x, y, s = rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0.1, 1)
        out.append((x, y, x + s, y + s, k))
    return sorted(out)  # neighbours stand together, as the index wants


def square_file(path, n, node_size=16, index=True):
    all_ = squares(n)
    ring = lambda x0, y0, x1, y1, _: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]
    features = [feature([f"Fläche {q[4]}", q[4] << 33, q[4] % 2 == 0, q[0], q[4] % 200, -q[4], bytes([q[4] % 256])], rings=ring(*q)) for q in all_]
    write(path, 3, features, [q[:4] for q in all_] if index else None, node_size)
    return all_


@pytest.mark.parametrize(("n", "node_size", "index"), [(1, 16, True), (16, 16, True), (700, 4, True), (700, 16, True), (60, 16, False)])
def test_round_trip(spark, tmp_path, n, node_size, index):
    geometry.register(spark)
    all_ = square_file(tmp_path / "a.fgb", n, node_size, index)
    df = containers.read_flatgeobuf(spark, str(tmp_path / "a.fgb"), parts=5)
    assert [f.name for f in df.schema.fields] == ["seq", "geom", "name", "n", "ok", "x", "small", "seq_5", "raw"]
    got = sorted(tuple(r) for r in df.withColumn("geom", call("Area", "geom")).collect())
    for r, q in zip(got, [(k, *q) for k, q in enumerate(all_)], strict=True):
        assert r[0] == q[0]
        assert math.isclose(r[1], (q[3] - q[1]) * (q[4] - q[2]), rel_tol=1e-9)
        assert r[2:] == (f"Fläche {q[5]}", q[5] << 33, q[5] % 2 == 0, q[1], q[5] % 200, -q[5], bytes([q[5] % 256]))
    box = (20.0, 30.0, 24.0, 33.0)
    hit = containers.read_flatgeobuf(spark, str(tmp_path / "a.fgb"), box, parts=3).select("name").collect()
    assert sorted(r["name"] for r in hit) == sorted(f"Fläche {q[4]}" for q in all_ if q[0] <= 24 and 20 <= q[2] and q[1] <= 33 and 30 <= q[3])
    assert containers.read_flatgeobuf(spark, str(tmp_path / "a.fgb"), (200.0, 0.0, 201.0, 1.0)).count() == 0


def test_a_box_reads_what_it_needs(tmp_path):
    all_ = square_file(tmp_path / "a.fgb", 3000)
    reader = containers.FlatGeobufReader(str(tmp_path / "a.fgb"), (50.0, 50.0, 51.0, 51.0), 4)
    file = containers.Bytes(reader.path)
    h = containers.header(file)
    found = [x for p in reader.partitions() for x in reader.hits(file, h, p)]
    assert {n for n, _ in found} == {k for k, q in enumerate(all_) if q[0] <= 51 and 50 <= q[2] and q[1] <= 51 and 50 <= q[3]}
    assert file.taken < 0.1 * file.size


def test_other_shapes_and_absent_values(spark, tmp_path):
    geometry.register(spark)
    none = [None] * len(COLUMNS)
    features = [
        feature(none, rings=[[(0, 0), (9, 0), (9, 9), (0, 0)], [(5, 1), (6, 1), (6, 2), (5, 1)]], kind=3), feature(none, parts=[[[(0, 0), (1, 0), (1, 1), (0, 0)]], [[(5, 5), (6, 5), (6, 6), (5, 5)]]], kind=6),
        feature(none, rings=[[(1.5, 2.5)]], kind=1), feature(none, rings=[[(0, 0), (1, 2)]], kind=2), feature(none),
    ]
    write(tmp_path / "b.fgb", 0, features)
    df = containers.read_flatgeobuf(spark, str(tmp_path / "b.fgb"))
    got = [tuple(r) for r in df.select(call("AsText", "geom"), "name", "n").collect()]
    assert got == [
        ("POLYGON ((0 0, 9 9, 9 0, 0 0), (5 1, 6 1, 6 2, 5 1))", None, None), ("MULTIPOLYGON (((0 0, 1 1, 1 0, 0 0)), ((5 5, 6 6, 6 5, 5 5)))", None, None),
        ("POINT (1.5 2.5)", None, None), ("LINESTRING (0 0, 1 2)", None, None), (None, None, None),
    ]
    write(tmp_path / "none.fgb", 3, [])
    assert containers.read_flatgeobuf(spark, str(tmp_path / "none.fgb")).count() == 0
    (tmp_path / "x.fgb").write_bytes(b"something else")
    with pytest.raises(ValueError, match="not a FlatGeobuf"):
        containers.header(containers.Bytes(str(tmp_path / "x.fgb")))


def utm(lon, lat, zone):
    """Redfearn's formulas on GRS 80, another way than the library's series."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    p, d = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    steps = 20_000
    at = lambda x: a * (1 - e2) / (1 - e2 * math.sin(x) ** 2) ** 1.5
    arc = p / steps / 3 * sum((1 if k in (0, steps) else 4 if k % 2 else 2) * at(p * k / steps) for k in range(steps + 1))
    nu, rho = a / math.sqrt(1 - e2 * math.sin(p) ** 2), at(p)
    psi, t, c = nu / rho, math.tan(p), math.cos(p)
    north = arc + nu * math.sin(p) * (d**2 * c / 2 + d**4 * c**3 / 24 * (4 * psi**2 + psi - t**2) + d**6 * c**5 / 720 * (8 * psi**4 * (11 - 24 * t**2) - 28 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 - 32 * t**2) - psi * 2 * t**2 + t**4))
    east = nu * d * c * (1 + d**2 * c**2 / 6 * (psi - t**2) + d**4 * c**4 / 120 * (4 * psi**3 * (1 - 6 * t**2) + psi**2 * (1 + 8 * t**2) - psi * 2 * t**2 + t**4))
    return 500_000 + k0 * east, k0 * north


def package(path, zone=32):
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER);
      CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER, organization TEXT, organization_coordsys_id INTEGER);
      INSERT INTO gpkg_contents VALUES ('vg "250"', 'features'), ('degrees', 'features'), ('odd', 'features'), ('notes', 'attributes');
      INSERT INTO gpkg_geometry_columns VALUES ('vg "250"', 'shape', 7), ('degrees', 'geom', 8), ('odd', 'geom', 9);
      INSERT INTO gpkg_spatial_ref_sys VALUES (7, 'EPSG', 25832), (8, 'epsg', 4326), (9, 'EPSG', 3857);
      CREATE TABLE 'vg "250"' (fid INTEGER PRIMARY KEY, shape BLOB, ars TEXT, ewz INT, area REAL, seq INT); CREATE TABLE degrees (fid INTEGER PRIMARY KEY, geom BLOB); CREATE TABLE odd (fid INTEGER PRIMARY KEY, geom BLOB);""")
    points = {}
    for k in range(1, 120):
        lon, lat = 6 + k / 20, 47.5 + k / 15
        points[k] = (lon, lat)
        raw = struct.pack("<BIdd", 1, 1, *utm(lon, lat, zone))
        envelope = struct.pack("<dddd", 0, 0, 0, 0) if k % 2 else b""
        blob = None if k == 50 else b"GP\x00" + bytes([1 | (2 if k % 2 else 0) | (16 if k == 60 else 0)]) + struct.pack("<i", 7) + envelope + raw
        con.execute("INSERT INTO 'vg \"250\"' VALUES (?, ?, ?, ?, ?, ?)", (k * 3, blob, None if k == 40 else f"{k % 16:02d}{k:04d}", k, k / 2, k))
    con.execute("INSERT INTO degrees VALUES (1, ?)", (b"GP\x00\x01" + struct.pack("<i", 8) + struct.pack("<BIdd", 1, 1, 13.4, 52.5),))
    con.commit()
    con.close()
    return points


def test_layers(spark, tmp_path):
    geometry.register(spark)
    path = str(tmp_path / "a.gpkg")
    points = package(path)
    df = containers.read_layer(spark, path, 'vg "250"', parts=7)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("seq", "bigint"), ("geom", "binary"), ("fid", "bigint"), ("ars", "string"), ("ewz", "bigint"), ("area", "double"), ("seq_4", "bigint")]
    rows = {r["ewz"]: r for r in df.withColumn("e", call("Envelope", "geom")).collect()}
    assert len(rows) == 119
    for k, (lon, lat) in points.items():
        assert (rows[k]["seq"], rows[k]["area"]) == (3 * k, k / 2)
        if k in (50, 60):
            assert rows[k]["geom"] is None
        else:  # within a millimetre
            assert abs(rows[k]["e"]["w"] - lon) < 1.5e-8
            assert abs(rows[k]["e"]["s"] - lat) < 1e-8
    some = containers.read_layer(spark, path, 'vg "250"', "ars", "07").collect()
    assert sorted(r["ewz"] for r in some) == [k for k in range(1, 120) if k % 16 == 7 and k != 40]
    at = containers.read_layer(spark, path, "degrees").select(call("AsText", "geom").alias("t")).first()["t"]
    assert at == "POINT (13.4 52.5)"
    for name, why in (("odd", "EPSG 3857"), ("notes", "no layer"), ("nowhere", "no layer")):
        with pytest.raises(ValueError, match=why):
            containers.read_layer(spark, path, name)


def test_projection_there_and_back(spark):
    geometry.register(spark)
    df = spark.createDataFrame([(x, y) for x in (5.9, 9.0, 10.5, 12.0) for y in (47.3, 50.0, 55.0)], "x double, y double").selectExpr("*", "lm_FromText(concat('POINT (', x, ' ', y, ')')) as g")
    for r in df.select("x", "y", call("Envelope", call("ToUtm", "g", geometry.F.lit(32))).alias("u"), call("Envelope", call("FromUtm", call("ToUtm", "g", geometry.F.lit(32)), geometry.F.lit(32))).alias("b")).collect():
        east, north = utm(r["x"], r["y"], 32)
        assert abs(r["u"]["w"] - east) < 0.002
        assert abs(r["u"]["s"] - north) < 0.002
        # about a millimetre
        assert abs(r["b"]["w"] - r["x"]) < 1e-8
        assert abs(r["b"]["s"] - r["y"]) < 1e-8
