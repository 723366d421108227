"""Planar geometry on WKB columns: st_* functions of the JTS kernel, and closed forms without it.

Spark ships JTS; the kernel is a jar of Java UDFs over it, built from
kernel/src. It is registered once a session. Its functions are opaque to the
optimizer, so plans compute a geometry once, behind an exchange or in a struct,
before they filter on it.
"""

from __future__ import annotations

import hashlib
import math
import os
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .binding import bind

KERNEL = Path(__file__).resolve().parent.parent / "kernel"

# The kernel's classes and their Spark result types.
RESULTS = {
    "Difference": "binary",
    "Intersection": "binary",
    "LineDifference": "binary",
    "LineIntersection": "binary",
    "Snap": "binary",
    "Buffer": "binary",
    "CropBuffer": "binary",
    "SnapGrid": "binary",
    "Simplify": "binary",
    "Multi": "binary",
    "MakeValid": "binary",
    "PolygonParts": "binary",
    "ExteriorRing": "binary",
    "InteriorRings": "array<binary>",
    "LineMerge": "binary",
    "Boundary": "binary",
    "Centroid": "binary",
    "PointOnSurface": "binary",
    "BuildArea": "binary",
    "Orient": "binary",
    "DropZ": "binary",
    "Dump": "array<binary>",
    "UnionAll": "binary",
    "UnionLines": "binary",
    "Intersects": "boolean",
    "Within": "boolean",
    "Covers": "boolean",
    "SameShape": "boolean",
    "IsEmpty": "boolean",
    "IsValid": "boolean",
    "Area": "double",
    "Length": "double",
    "Distance": "double",
    "GeometryType": "string",
    "NumParts": "int",
    "NumPoints": "int",
    "AsText": "string",
    "FromText": "binary",
    "Bounds": "array<double>",
    "Coordinates": "array<double>",
    "PolygonOf": "binary",
    "LineOf": "binary",
    "PointOf": "binary",
    "Triangles": "array<binary>",
    "DetectStep": "array<binary>",
    "Readable": "boolean",
    "OnePolygon": "binary",
}


def build() -> Path:
    """The kernel's jar; compiled where it is missing or made from another source, which a digest in it tells. Only the driver compiles; Spark ships the jar."""
    import zipfile

    import pyspark

    source = KERNEL / "src/archspan/Geo.java"
    digest = hashlib.sha256(source.read_bytes()).hexdigest()

    def current(jar: Path) -> bool:
        if not jar.exists():
            return False
        with zipfile.ZipFile(jar) as z:
            return "source.sha256" in z.namelist() and z.read("source.sha256").decode() == digest

    jar = KERNEL / "geo.jar"
    if current(jar):
        return jar
    out = Path(tempfile.mkdtemp(prefix="archspan-"))
    subprocess.run(["javac", "--release", "17", "-nowarn", "-cp", f"{Path(pyspark.__file__).parent}/jars/*", "-d", str(out), str(source)], check=True)
    target = jar if os.access(KERNEL, os.W_OK) else out / "geo.jar"
    part = Path(f"{target}.{os.getpid()}")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for c in sorted(out.rglob("*.class")):
            z.write(c, c.relative_to(out))
        z.writestr("source.sha256", digest)
    os.replace(part, target)
    return target


def name_of(cls: str) -> str:
    return "st_" + "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(cls))


def register(spark: SparkSession) -> SparkSession:
    """Makes the st_* functions known to a session."""
    if not spark.catalog.functionExists("st_one_polygon"):
        spark.sql(f"ADD JAR '{build()}'")
        for cls, kind in RESULTS.items():
            spark.udf.registerJavaFunction(name_of(cls), f"archspan.Geo${cls}", kind)
    return spark


def st(name: str, *args: Column | str | float) -> Column:
    """A call of an st_* function; numbers become double literals."""
    return F.call_function(f"st_{name}", *(F.lit(float(a)) if isinstance(a, (int, float)) else F.col(a) if isinstance(a, str) else a for a in args))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The polygon between two corners, counter-clockwise."""
    return st("polygon_of", F.array(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0))


def not_sliver(g: Column, distance: float) -> Column:
    """Whether the erosion by distance leaves anything; the second buffer of an opening can't empty it."""
    return ~st("is_empty", st("buffer", g, -distance))


def shoelace(xy: Column) -> Column:
    """Signed area of a closed ring given as x, y, x, y, ...: positive counter-clockwise."""
    n = (F.size(xy) / 2).cast("int")
    term = lambda i: xy[2 * i] * xy[2 * i + 3] - xy[2 * i + 2] * xy[2 * i + 1]
    return F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda a, i: a + term(i)) / 2


def azimuth(dx: Column, dy: Column) -> Column:
    """North-clockwise direction in [0, 2 pi)."""
    a = F.atan2(dx, dy)
    return F.when(a < 0, a + 2 * F.pi()).otherwise(a)


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two bounds (min x, min y, max x, max y) share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def to_geojson(coordinates: Column, kind: str = "LineString") -> Column:
    """GeoJSON text of a geometry from its coordinate arrays."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


# The grid's double stereographic projection, the ellipsoids (half axis, squared eccentricity), and the shift from Bessel's to that of WGS84.
_CENTRE, _SCALE, _FALSE = (math.radians(5 + 23 / 60 + 15.5 / 3600), math.radians(52 + 9 / 60 + 22.178 / 3600)), 0.9999079, (155000.0, 463000.0)
_BESSEL, _WGS84 = ((a, (2 - 1 / f) / f) for a, f in ((6377397.155, 299.1528128), (6378137.0, 298.257223563)))
_MOVE, _TURN, _GROW = (565.417, 50.3319, 465.552), [math.radians(v / 3600) for v in (-0.398957, 0.343988, -1.8774)], 1 + 4.0725e-6
_HELMERT = [[_GROW, -_GROW * _TURN[2], _GROW * _TURN[1]], [_GROW * _TURN[2], _GROW, -_GROW * _TURN[0]], [-_GROW * _TURN[1], _GROW * _TURN[0], _GROW]]


def _inverse(m: list[list[float]]) -> list[list[float]]:
    cof = [[m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * cof[j][0] for j in range(3))
    return [[v / det for v in r] for r in cof]


def _sphere() -> tuple[float, float, float, float]:
    """Of the conformal sphere: its radius, the exponent n, half the logarithm of c, and the centre's latitude."""
    e2, phi = _BESSEL[1], _CENTRE[1]
    e, sin = math.sqrt(e2), math.sin(phi)
    radius = _BESSEL[0] * math.sqrt(1 - e2) / (1 - e2 * sin**2)
    n = math.sqrt(1 + e2 * math.cos(phi) ** 4 / (1 - e2))
    w = math.exp(2 * n * (math.asinh(math.tan(phi)) - e * math.atanh(e * sin)))
    chi = (w - 1) / (w + 1)
    c = (n + sin) * (1 - chi) / ((n - sin) * (1 + chi))
    return radius, n, math.log(c) / 2, math.asin((c * w - 1) / (c * w + 1))


def _named(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _geocentric(lon: Column, lat: Column, h: Column, ellipsoid: tuple[float, float]) -> Column:
    a, e2 = ellipsoid
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), F.lit(2)))
    return bind(_named(n=n, lon=lon, lat=lat, h=h), lambda v: _named(x=(v["n"] + v["h"]) * F.cos(v["lat"]) * F.cos(v["lon"]), y=(v["n"] + v["h"]) * F.cos(v["lat"]) * F.sin(v["lon"]), z=(v["n"] * (1 - e2) + v["h"]) * F.sin(v["lat"])))


def _geodetic(at: Column, ellipsoid: tuple[float, float]) -> Column:
    """struct(lon, lat, h) of a geocentric point near the surface, by Bowring's formula."""
    a, e2 = ellipsoid
    b = a * math.sqrt(1 - e2)

    def latitude(v: Column) -> Column:
        high = v["z"] + e2 / (1 - e2) * b * F.pow(F.sin(v["t"]), F.lit(3))
        return _named(p=v["p"], z=v["z"], lon=v["lon"], lat=F.atan2(high, v["p"] - e2 * a * F.pow(F.cos(v["t"]), F.lit(3))))

    def height(v: Column) -> Column:
        return v["p"] * F.cos(v["lat"]) + v["z"] * F.sin(v["lat"]) - a * F.sqrt(1 - e2 * F.pow(F.sin(v["lat"]), F.lit(2)))

    flat = bind(at, lambda q: _named(p=F.hypot(q["x"], q["y"]), z=q["z"], lon=F.atan2(q["y"], q["x"])))
    turned = bind(flat, lambda v: _named(p=v["p"], z=v["z"], lon=v["lon"], t=F.atan2(v["z"] * a, v["p"] * b)))
    return bind(bind(turned, latitude), lambda v: _named(lon=v["lon"], lat=v["lat"], h=height(v)))


def _shifted(at: Column, back: bool) -> Column:
    """A geocentric point of Bessel's ellipsoid in WGS84, or back."""
    m = _inverse(_HELMERT) if back else _HELMERT
    d = [at[k] - _MOVE[i] if back else at[k] for i, k in enumerate("xyz")]
    return _named(**{k: sum((c * v for c, v in zip(m[i], d, strict=True)), F.lit(0.0 if back else _MOVE[i])) for i, k in enumerate("xyz")})


def rd_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of Dutch grid coordinates: the inverse projection and the seven-parameter shift of points on Bessel's ellipsoid. Holds at any distance, where the published polynomials hold in the Netherlands alone."""
    radius, n, half_c, chi = _sphere()
    e = math.sqrt(_BESSEL[1])
    k = radius * _SCALE
    sin, cos = math.sin(chi), math.cos(chi)

    def direction(v: Column) -> Column:
        t = (v["x"] * v["x"] + v["y"] * v["y"]) / (4 * k * k)
        part = 1 / (k * (1 + t))
        return _named(x=(1 - t) / (1 + t) * cos - v["y"] * part * sin, y=v["x"] * part, z=(1 - t) / (1 + t) * sin + v["y"] * part * cos)

    def steeper(psi: Column) -> Callable[[Column, Column], Column]:
        return lambda tan, _: bind(tan / F.sqrt(1 + tan * tan), lambda s: F.sinh(psi + e * F.atanh(e * s)))

    def latitude(v: Column) -> Column:
        return F.atan(F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.sinh(v["psi"]), steeper(v["psi"])))

    d = bind(_named(x=x - _FALSE[0], y=y - _FALSE[1]), direction)
    own = bind(d, lambda v: _named(lon=_CENTRE[0] + F.atan2(v["y"], v["x"]) / n, psi=(F.asinh(v["z"] / F.hypot(v["x"], v["y"])) - half_c) / n))
    own = bind(own, lambda v: _named(lon=v["lon"], lat=latitude(v)))
    there = bind(own, lambda v: _geocentric(v["lon"], v["lat"], F.lit(0.0), _BESSEL))
    g = _geodetic(bind(there, lambda v: _shifted(v, False)), _WGS84)
    return F.degrees(g["lon"]), F.degrees(g["lat"])


def wgs84_to_rd(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Dutch grid coordinates of longitude and latitude: the inverse of rd_to_wgs84, at the height that lies on Bessel's ellipsoid."""
    radius, n, half_c, chi = _sphere()
    e = math.sqrt(_BESSEL[1])
    sin, cos = math.sin(chi), math.cos(chi)
    place = _named(lon=F.radians(lon), lat=F.radians(lat))

    def on_bessel(h: Callable[[Column], Column]) -> Column:
        there = bind(place, lambda v: _geocentric(v["lon"], v["lat"], h(v), _WGS84))
        return _geodetic(bind(there, lambda v: _shifted(v, True)), _BESSEL)

    own = on_bessel(lambda _: -on_bessel(lambda _: F.lit(0.0))["h"])

    def projected(v: Column) -> Column:
        below = 1 + F.tanh(v["chi"]) * sin + cos * F.cos(v["turn"]) / F.cosh(v["chi"])
        scale = 2 * radius * _SCALE / below
        return _named(x=_FALSE[0] + scale * F.sin(v["turn"]) / F.cosh(v["chi"]), y=_FALSE[1] + scale * (F.tanh(v["chi"]) * cos - F.cos(v["turn"]) * sin / F.cosh(v["chi"])))

    off = lambda v: bind(v["lon"] - _CENTRE[0], lambda d: d - 2 * math.pi * F.round(d / (2 * math.pi)))
    psi = lambda v: F.asinh(F.tan(v["lat"])) - e * F.atanh(e * F.sin(v["lat"]))
    turned = bind(own, lambda v: _named(turn=n * off(v), chi=n * psi(v) + half_c))
    at = bind(turned, projected)
    return at["x"], at["y"]
