"""Data sources over single binary files: FlatGeobuf with its spatial index, and layers of GeoPackages.

Both are read in parts: the driver looks at a header and a few index nodes or at the range of row ids, and each task
reads the bytes of its own part. A box (FlatGeobuf) or the beginning of a property (GeoPackage) is applied in the scan,
so that features outside it are not read. Paths are those that Arrow's file systems open; they must be visible to
all executors.
"""

from __future__ import annotations

import math
import shutil
import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from landmatch.functions.geometry import call

BATCH = 1000
#: Fixed values of the FlatGeobuf format: its first bytes (the fourth is the major version), the size of an index node, kinds of geometry.
MAGIC = b"fgb\x03fgb"
NODE = np.dtype([("x0", "<f8"), ("y0", "<f8"), ("x1", "<f8"), ("y1", "<f8"), ("at", "<u8")])
POINT, LINE, POLYGON, POINTS, LINES, POLYGONS, COLLECTION = range(1, 8)
#: Fixed values of the format: SQL type and binary form of each column type, by number; None for a length and bytes.
COLUMN_TYPES = (
    ("bigint", "<b"), ("bigint", "<B"), ("boolean", "<?"), ("bigint", "<h"), ("bigint", "<H"), ("bigint", "<i"), ("bigint", "<I"), ("bigint", "<q"), ("decimal(20,0)", "<Q"),
    ("double", "<f"), ("double", "<d"), ("string", None), ("string", None), ("string", None), ("binary", None),
)
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


class Bytes:
    """A file read at given places; ``taken`` counts what was read."""

    def __init__(self, path: str):
        system, inner = (pyarrow.fs.FileSystem.from_uri(path)) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.file, self.taken = system.open_input_file(inner), 0
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.taken += n
        return self.file.read_at(n, at)


class Table:
    """One table of a FlatBuffer, by field number."""

    def __init__(self, data: bytes, at: int | None = None):
        self.data = data
        self.at = struct.unpack_from("<I", data, 0)[0] if at is None else at

    def field(self, n: int) -> int:
        table = self.at - struct.unpack_from("<i", self.data, self.at)[0]
        known = struct.unpack_from("<H", self.data, table)[0]
        skip = struct.unpack_from("<H", self.data, table + 4 + 2 * n)[0] if 4 + 2 * n < known else 0
        return self.at + skip if skip else 0

    def scalar(self, n: int, form: str, default):
        at = self.field(n)
        return struct.unpack_from(form, self.data, at)[0] if at else default

    def vector(self, n: int) -> tuple[int, int]:
        """(first byte, length); length 0 if there is none."""
        at = self.field(n)
        if not at:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return at + 4, struct.unpack_from("<I", self.data, at)[0]

    def array(self, n: int, kind: str) -> np.ndarray:
        at, length = self.vector(n)
        return np.frombuffer(self.data, kind, length, at) if length else np.zeros(0, kind)

    def text(self, n: int) -> str | None:
        at, length = self.vector(n)
        return self.data[at : at + length].decode() if at else None

    def table(self, n: int) -> Table | None:
        at = self.field(n)
        return Table(self.data, at + struct.unpack_from("<I", self.data, at)[0]) if at else None

    def tables(self, n: int) -> list[Table]:
        at, length = self.vector(n)
        return [Table(self.data, p + struct.unpack_from("<I", self.data, p)[0]) for p in range(at, at + 4 * length, 4)]


@dataclass(frozen=True)
class Header:
    kind: int
    columns: tuple[tuple[str, int], ...]
    features: int
    node_size: int
    index_at: int
    levels: tuple[tuple[int, int], ...]  # first and end node of each level, from the root down

    @property
    def features_at(self) -> int:
        return self.index_at + (self.levels[-1][1] * NODE.itemsize if self.levels else 0)


def header(file: Bytes) -> Header:
    start = file.read(0, 12)
    if start[:7] != MAGIC:
        raise ValueError("not a FlatGeobuf file of version 3")
    size = struct.unpack_from("<I", start, 8)[0]
    h = Table(file.read(12, size))
    columns = tuple((c.text(0), c.scalar(1, "<B", 0)) for c in h.tables(7))
    count, node_size = h.scalar(8, "<Q", 0), h.scalar(9, "<H", 16)
    sizes = []
    if node_size and count:
        sizes = [count]
        while len(sizes) == 1 or sizes[-1] > 1:
            sizes.append(math.ceil(sizes[-1] / node_size))
    ends = np.cumsum(sizes[::-1]).tolist()
    return Header(h.scalar(2, "<B", 0), columns, count, node_size, 12 + size, tuple((e - s, e) for s, e in zip(sizes[::-1], ends, strict=True)))


def nodes(file: Bytes, h: Header, first: int, end: int) -> np.ndarray:
    return np.frombuffer(file.read(h.index_at + first * NODE.itemsize, (end - first) * NODE.itemsize), NODE)


def touching(found: np.ndarray, box: tuple[float, ...] | None) -> np.ndarray:
    if box is None:
        return np.ones(len(found), bool)
    return (found["x0"] <= box[2]) & (box[0] <= found["x1"]) & (found["y0"] <= box[3]) & (box[1] <= found["y1"])


def below(file: Bytes, h: Header, level: int, parents: np.ndarray, box: tuple[float, ...] | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, nodes) of the next level's nodes that touch the box, under the given nodes of ``level``."""
    end = h.levels[level + 1][1]
    numbers, got = [], []
    for first in parents["at"].tolist():
        some = nodes(file, h, first, min(first + h.node_size, end))
        hit = touching(some, box)
        numbers.append(first + np.flatnonzero(hit))
        got.append(some[hit])
    return (np.concatenate(numbers), np.concatenate(got)) if got else (np.zeros(0, np.int64), np.zeros(0, NODE))


def wkb(g: Table, kind: int) -> bytes:
    kind = g.scalar(6, "<B", 0) or kind
    parts = g.tables(7)
    if kind in (POLYGONS, COLLECTION):
        return struct.pack("<BII", 1, kind, len(parts)) + b"".join(wkb(p, POLYGON if kind == POLYGONS else 0) for p in parts)
    xy = g.array(1, "<f8")
    if kind == POINT:
        return struct.pack("<BI", 1, kind) + (xy[:2].tobytes() if len(xy) else struct.pack("<dd", math.nan, math.nan))
    if kind == LINE:
        return struct.pack("<BII", 1, kind, len(xy) // 2) + xy.tobytes()
    if kind == POINTS:
        return struct.pack("<BII", 1, kind, len(xy) // 2) + b"".join(struct.pack("<BI", 1, POINT) + xy[k : k + 2].tobytes() for k in range(0, len(xy), 2))
    ends = g.array(0, "<u4").tolist() or ([len(xy) // 2] if len(xy) else [])
    pieces = [(e - b, xy[2 * b : 2 * e].tobytes()) for b, e in zip([0, *ends], ends, strict=False)]
    head = struct.pack("<BII", 1, kind, len(pieces))
    if kind == LINES:
        return head + b"".join(struct.pack("<BII", 1, LINE, n) + raw for n, raw in pieces)
    if kind == POLYGON:
        return head + b"".join(struct.pack("<I", n) + raw for n, raw in pieces)
    raise ValueError(f"geometry kind {kind} is not read")


def properties(raw: bytes, columns: tuple[tuple[str, int], ...]) -> dict[int, object]:
    at, out = 0, {}
    while at + 2 <= len(raw):
        k = struct.unpack_from("<H", raw, at)[0]
        sql, form = COLUMN_TYPES[columns[k][1]]
        at += 2
        if form is None:
            n = struct.unpack_from("<I", raw, at)[0]
            value = raw[at + 4 : at + 4 + n]
            out[k] = value if sql == "binary" else value.decode()
            at += 4 + n
        else:
            out[k] = struct.unpack_from(form, raw, at)[0]
            at += struct.calcsize(form)
    return out


def field_names(columns: tuple[tuple[str, int], ...]) -> list[str]:
    """Column names; one that stands for an output column of its own, or twice, gets its number."""
    taken, out = {"seq", "geom"}, []
    for k, (name, _) in enumerate(columns):
        out.append(name if name.lower() not in taken else f"{name}_{k}")
        taken.add(out[-1].lower())
    return out


@dataclass
class Part(InputPartition):
    """Nodes of one level below which the part's features lie; level -1: all features, in the file's order."""

    level: int
    first: tuple[int, ...]


class FlatGeobufReader(DataSourceReader):
    def __init__(self, path: str, box: tuple[float, ...] | None, parts: int):
        self.path, self.box, self.parts = path, box, parts

    def partitions(self) -> list[Part]:
        file = Bytes(self.path)
        h = header(file)
        if not h.levels:
            return [Part(-1, ())]
        level, found, numbers = 0, nodes(file, h, 0, 1), np.zeros(1, np.int64)
        numbers, found = numbers[touching(found, self.box)], found[touching(found, self.box)]
        # down to the level that has a node for each part; the last one holds single features
        while len(numbers) and len(numbers) < self.parts and level < len(h.levels) - 2:
            numbers, found = below(file, h, level, found, self.box)
            level += 1
        return [Part(level, tuple(p.tolist())) for p in np.array_split(numbers, max(1, min(self.parts, len(numbers))))]

    def hits(self, file: Bytes, h: Header, part: Part) -> Iterator[tuple[int, bytes]]:
        """(number, feature) of a part."""
        if part.level < 0:
            at, seq = h.features_at, 0
            while at < file.size:
                size = struct.unpack("<I", file.read(at, 4))[0]
                yield seq, file.read(at + 4, size)
                at, seq = at + 4 + size, seq + 1
            return
        first_leaf = h.levels[-1][0]
        for number in part.first:
            found = nodes(file, h, number, number + 1)
            for level in range(part.level, len(h.levels) - 1):
                numbers, found = below(file, h, level, found, self.box)
            for n, at in zip(numbers.tolist(), found["at"].tolist(), strict=True):
                size = struct.unpack("<I", file.read(h.features_at + at, 4))[0]
                yield n - first_leaf, file.read(h.features_at + at + 4, size)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        file = Bytes(self.path)
        h = header(file)
        names, kinds = ["seq", "geom", *field_names(h.columns)], [pa.int64(), pa.binary(), *(ARROW[COLUMN_TYPES[t][0]] for _, t in h.columns)]
        rows: list[list] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        for seq, raw in self.hits(file, h, partition):
            feature = Table(raw)
            g = feature.table(0)
            if partition.level < 0 and self.box is not None and (g is None or not self.inside(g)):
                continue
            at, n = feature.vector(1)
            told = properties(raw[at : at + n], h.columns)
            rows.append([seq, None if g is None else wkb(g, h.kind), *(told.get(k) for k in range(len(h.columns)))])
            if len(rows) == BATCH:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    def inside(self, g: Table) -> bool:
        xy = [p.array(1, "<f8") for p in ([g] if not g.tables(7) else g.tables(7))]
        x, y = np.concatenate([a[::2] for a in xy]), np.concatenate([a[1::2] for a in xy])
        return len(x) > 0 and bool(x.min() <= self.box[2] and self.box[0] <= x.max() and y.min() <= self.box[3] and self.box[1] <= y.max())


class FlatGeobuf(DataSource):
    """Options: path, bbox (``west,south,east,north``; features whose boxes touch it), parts."""

    @classmethod
    def name(cls) -> str:
        return "landmatch_fgb"

    def schema(self) -> str:
        columns = header(Bytes(self.options["path"])).columns
        fields = [f"`{n}` {COLUMN_TYPES[t][0]}" for n, (_, t) in zip(field_names(columns), columns, strict=True)]
        return ", ".join(["seq bigint", "geom binary", *fields])

    def reader(self, schema) -> FlatGeobufReader:
        box = tuple(float(x) for x in self.options["bbox"].split(",")) if self.options.get("bbox") else None
        return FlatGeobufReader(self.options["path"], box, int(self.options.get("parts", 8)))


def read_flatgeobuf(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, parts: int = 8) -> DataFrame:
    """(seq, geom, properties..): features of a file, by their number in it; with a box, those whose boxes touch it."""
    spark.dataSource.register(FlatGeobuf)
    reader = spark.read.format(FlatGeobuf.name()).option("path", path).option("parts", parts)
    return (reader if box is None else reader.option("bbox", ",".join(map(repr, box)))).load()


# ---- layers of GeoPackages

#: Fixed values of the format: bytes of the box in a geometry's header, by its code.
ENVELOPES = (0, 32, 48, 48, 64)
SQLITE_TYPES = (("INT", "bigint"), ("BOOL", "boolean"), ("REAL", "double"), ("DOUBLE", "double"), ("FLOAT", "double"), ("BLOB", "binary"))


def plain_wkb(raw: bytes | None) -> bytes | None:
    """The WKB behind a geometry's header; null for an empty geometry."""
    if raw is None or raw[:2] != b"GP" or raw[3] & 16:
        return None
    return raw[8 + ENVELOPES[raw[3] >> 1 & 7] :]


@contextmanager
def database(path: str) -> Iterator[sqlite3.Connection]:
    """A read-only connection; a file that is not on a local path is copied for as long as it is open."""
    with tempfile.TemporaryDirectory() as folder:
        if "://" in path:
            system, inner = pyarrow.fs.FileSystem.from_uri(path)
            local = inner
            if system.type_name != "local":
                local = f"{folder}/layer.gpkg"
                with system.open_input_stream(inner) as source, open(local, "wb") as out:
                    shutil.copyfileobj(source, out, 1 << 20)
        else:
            local = path
        con = sqlite3.connect(f"file:{local}?mode=ro&immutable=1", uri=True)
        try:
            yield con
        finally:
            con.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Layer:
    table: str
    geometry: str
    epsg: int | None
    columns: tuple[tuple[str, str], ...]


def layer(con: sqlite3.Connection, name: str) -> Layer:
    known = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features'")]
    if name not in known:
        raise ValueError(f"no layer {name!r}; there are {', '.join(sorted(known))}")
    geometry, srs = con.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()
    code = con.execute("SELECT organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ? AND upper(organization) = 'EPSG'", (srs,)).fetchone()
    sql = lambda kind: next((s for part, s in SQLITE_TYPES if part in kind.upper()), "string")
    columns = tuple((r[1], sql(r[2])) for r in con.execute(f"PRAGMA table_info({quoted(name)})") if r[1] != geometry)
    return Layer(name, geometry, code[0] if code else None, columns)


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class LayerReader(DataSourceReader):
    def __init__(self, path: str, name: str, column: str | None, prefix: str, parts: int):
        self.path, self.name, self.column, self.prefix, self.parts = path, name, column, prefix, parts

    def partitions(self) -> list[Rows]:
        with database(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(layer(con, self.name).table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        cuts = [low + (high + 1 - low) * k // self.parts for k in range(self.parts + 1)]
        return [Rows(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with database(self.path) as con:
            found = layer(con, self.name)
            names = field_names(tuple((n, 0) for n, _ in found.columns))
            begins = f" AND substr({quoted(self.column)}, 1, ?) = ?" if self.column else ""
            if self.column and self.column not in [n for n, _ in found.columns]:
                raise ValueError(f"layer {self.name!r} has no column {self.column!r}")
            asked = ", ".join(["rowid", quoted(found.geometry), *(quoted(n) for n, _ in found.columns)])
            cursor = con.execute(f"SELECT {asked} FROM {quoted(found.table)} WHERE rowid BETWEEN ? AND ?{begins} ORDER BY rowid", (partition.first, partition.last, *((len(self.prefix), self.prefix) if self.column else ())))
            kinds = [ARROW[s] for _, s in found.columns]
            while rows := cursor.fetchmany(BATCH):
                fits = lambda v, kind: None if v is None else bool(v) if kind == pa.bool_() else str(v) if kind == pa.string() else v
                columns = [pa.array([fits(r[k + 2], kind) for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([plain_wkb(r[1]) for r in rows], pa.binary()), *columns], names=["seq", "geom", *names])


class GeoPackage(DataSource):
    """Options: path, layer, column and prefix (rows whose column begins so), parts."""

    @classmethod
    def name(cls) -> str:
        return "landmatch_gpkg"

    def schema(self) -> str:
        with database(self.options["path"]) as con:
            found = layer(con, self.options["layer"])
        fields = [f"`{n}` {s}" for n, (_, s) in zip(field_names(tuple((n, 0) for n, _ in found.columns)), found.columns, strict=True)]
        return ", ".join(["seq bigint", "geom binary", *fields])

    def reader(self, schema) -> LayerReader:
        o = self.options
        return LayerReader(o["path"], o["layer"], o.get("column"), o.get("prefix", ""), int(o.get("parts", 8)))


#: EPSG numbers of longitude and latitude, and of the UTM zones that the sources use.
DEGREES, UTM_ZONES = (4326, 4258), {25831: 31, 25832: 32, 25833: 33, 32631: 31, 32632: 32, 32633: 33}


def read_layer(spark: SparkSession, path: str, name: str, column: str | None = None, prefix: str = "", parts: int = 8) -> DataFrame:
    """(seq, geom, properties..): a layer's rows in longitude and latitude; with a column, those where it begins with the prefix."""
    spark.dataSource.register(GeoPackage)
    with database(path) as con:
        epsg = layer(con, name).epsg
    if epsg not in DEGREES and epsg not in UTM_ZONES:
        raise ValueError(f"layer {name!r} has coordinates of EPSG {epsg}, which are not read")
    reader = spark.read.format(GeoPackage.name()).option("path", path).option("layer", name).option("parts", parts)
    rows = (reader.option("column", column).option("prefix", prefix) if column else reader).load()
    return rows if epsg in DEGREES else rows.withColumn("geom", call("FromUtm", F.col("geom"), F.lit(UTM_ZONES[epsg])))
