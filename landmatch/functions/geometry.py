"""Geometry functions on WKB columns, run by the JTS library that ships with Spark.

The Java sources beside this package are compiled once per machine with the JDK's compiler against Spark's own
jars, added to the session, and registered under names that start with ``lm_``.
"""

from __future__ import annotations

import glob
import hashlib
import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = sorted((Path(__file__).resolve().parent.parent / "geom").glob("*.java"))
MEASURES = ("official_area", "osm_area", "intersection", "union", "hausdorff", "hausdorff_p95", "boundary")
_double = lambda *names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
FEATURE = T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geom", T.BinaryType())])
FUNCTIONS = {
    "FromText": T.BinaryType(), "AsText": T.StringType(), "Area": T.DoubleType(), "Length": T.DoubleType(), "Envelope": _double("w", "s", "e", "n"),
    "Multi": T.BinaryType(), "UnionAll": T.BinaryType(), "Intersects": T.BooleanType(), "Covers": T.BooleanType(), "Centroid": T.BinaryType(),
    "PointOnSurface": T.BinaryType(), "Difference": T.BinaryType(), "Shrink": T.BinaryType(), "Simplify": T.BinaryType(), "Measures": _double(*MEASURES),
    "ToUtm": T.BinaryType(), "FromUtm": T.BinaryType(), "GeodesicArea": T.DoubleType(),
    "Compatible": T.StringType(), "SortKey": T.BinaryType(), "OrderedBits": T.LongType(),
    "HoldsPoint": T.BooleanType(), "XmlFeatures": T.ArrayType(FEATURE), "RelationPolygons": T.BinaryType(),
}
#: Classes of the functions that are not in GeomUdfs.
HOMES = {"Compatible": "TextUdfs", "SortKey": "TextUdfs", "OrderedBits": "TextUdfs", "HoldsPoint": "ShapeUdfs", "XmlFeatures": "ShapeUdfs", "RelationPolygons": "ShapeUdfs"}


def _jar() -> str:
    name = hashlib.sha256(b"".join(p.read_bytes() for p in SOURCES) + pyspark.__version__.encode()).hexdigest()[:16]
    out = Path(tempfile.gettempdir()) / f"landmatch-geom-{os.getuid()}-{name}.jar"
    if not out.exists():
        jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
        compiler = shutil.which("javac")
        if compiler is None:
            raise RuntimeError("the geometry functions need a JDK on the driver")
        with tempfile.TemporaryDirectory() as at:
            subprocess.run([compiler, "-nowarn", "-encoding", "UTF-8", "-d", at, "-cp", ":".join(glob.glob(f"{jars}/*.jar")), *map(str, SOURCES)], check=True, capture_output=True)
            packed = f"{out}.{os.getpid()}"
            with zipfile.ZipFile(packed, "w") as z:
                for f in Path(at).rglob("*.class"):
                    z.write(f, f.relative_to(at))
            os.replace(packed, out)
    return str(out)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; repeated calls are free."""
    if spark.catalog.functionExists("lm_Measures"):
        return
    spark.sql(f"ADD JAR '{_jar()}'")
    for name, kind in FUNCTIONS.items():
        spark.udf.registerJavaFunction(f"lm_{name}", f"landmatch.geom.{HOMES.get(name, 'GeomUdfs')}${name}", kind)


def call(name: str, *columns: Column | str) -> Column:
    return F.call_function(f"lm_{name}", *columns)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """WKB of an axis-parallel rectangle."""
    p = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.concat_ws(", ", p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))
    return call("FromText", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))
