"""Planar and spatial arithmetic on columns: no geometry objects, so all of it is inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def offset(x1: Column, y1: Column, x2: Column, y2: Column, d: float, left: bool = False) -> Column:
    """struct(x1, y1, x2, y2) of a segment moved by d to its right (outward on a counter-clockwise ring); null for no length."""
    n = F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
    s = -d if left else d
    dx, dy = (y2 - y1) / n * s, -(x2 - x1) / n * s
    return F.when(n > 0, F.struct((x1 + dx).alias("x1"), (y1 + dy).alias("y1"), (x2 + dx).alias("x2"), (y2 + dy).alias("y2")))


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def meet(px: Column, py: Column, ux: Column, uy: Column, qx: Column, qy: Column, vx: Column, vy: Column) -> Column:
    """struct(x, y) where the lines p + t u and q + s v meet; null if they are parallel."""
    c = cross(ux, uy, vx, vy)
    t = cross(qx - px, qy - py, vx, vy) / F.when(F.abs(c) > 1e-12, c)
    return F.when(t.isNotNull(), F.struct((px + t * ux).alias("x"), (py + t * uy).alias("y")))


def miter(corner: Column, at_x: Column, at_y: Column, d: float, limit: float = 10.0) -> Column:
    """corner, unless it is farther than limit times d from the old one: then null, for a bevel."""
    far = F.sqrt((corner["x"] - at_x) ** 2 + (corner["y"] - at_y) ** 2)
    return F.when(far <= limit * abs(d), corner)


def segment_key(x1: Column, y1: Column, x2: Column, y2: Column, tolerance: float = TOLERANCE) -> Column:
    """A key that both directions of a segment share, on a grid of tolerance (half to even)."""
    q = [F.rint(c / tolerance).cast("long") for c in (x1, y1, x2, y2)]
    a, b = F.struct(q[0].alias("x"), q[1].alias("y")), F.struct(q[2].alias("x"), q[3].alias("y"))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray from a point to the right crosses an edge struct(x1, y1, x2, y2)."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Parity of crossings over all rings of an edge array: shells less holes; divisions happen for spanning edges alone."""
    cut = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
    )
    return F.size(F.filter(edges, cut)) % 2 == 1


def rotation(omega: Column, phi: Column, kappa: Column) -> list[list[Column]]:
    """Rows of R_kappa R_phi R_omega."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    r_o = [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), co, so], [F.lit(0.0), -so, co]]
    r_p = [[cp, F.lit(0.0), -sp], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [sp, F.lit(0.0), cp]]
    r_k = [[ck, sk, F.lit(0.0)], [-sk, ck, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    times = lambda a, b: [[sum((a[i][k] * b[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    return times(r_k, times(r_p, r_o))


def project(camera: dict[str, Column], x: Column, y: Column, z: Column, slack: float = 100.0) -> Column:
    """struct(u, v) of a point's pixel; null behind the camera or beyond the image by more than slack."""
    r = rotation(camera["omega"], camera["phi"], camera["kappa"])
    d = [x - camera["cx"], y - camera["cy"], z - camera["cz"]]
    p = [sum((r[i][k] * d[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    u = camera["width"] / 2 - camera["f"] * F.try_divide(p[0], p[2])
    v = camera["height"] / 2 + camera["f"] * F.try_divide(p[1], p[2])
    seen = (p[2] < 0) & u.between(-slack, camera["width"] + slack) & v.between(-slack, camera["height"] + slack)
    return F.when(seen, F.struct(u.alias("u"), v.alias("v")))


def facing(nx: Column, ny: Column, vx: Column, vy: Column) -> tuple[Column, Column]:
    """Dot product of unit normal and view, and the angle between them in degrees."""
    dot = (nx * vx + ny * vy) / (F.sqrt(nx**2 + ny**2) * F.sqrt(vx**2 + vy**2))
    return dot, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def newell(points: Column) -> Column:
    """struct(x, y, z): Newell's normal of a ring, an array of struct(x, y, z) without the closing point; its length is twice the area."""
    n = F.size(points)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])

    def add(a: Column, i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, (i + 1) % n)
        return F.struct(
            (a["x"] + (p["y"] - q["y"]) * (p["z"] + q["z"])).alias("x"),
            (a["y"] + (p["z"] - q["z"]) * (p["x"] + q["x"])).alias("y"),
            (a["z"] + (p["x"] - q["x"]) * (p["y"] + q["y"])).alias("z"),
        )

    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, add)


def norm(v: Column) -> Column:
    return F.sqrt(v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2)


def surface_kind(n: Column, z: Column, ground: Column) -> Column:
    """Semantics of a face by its unit normal and height."""
    return F.when(F.abs(n["z"]) < 0.3, "WallSurface").when(n["z"] > 0, "RoofSurface").when(F.abs(z - ground) <= 0.5, "GroundSurface").otherwise("OuterCeilingSurface")


NORMAL, PLANE = 5e-4, 2e-2  # fixed values: how far two normals' dot product and two planes may be apart


def coplanar(n: Column, d: Column, m: Column, e: Column) -> Column:
    """Whether two planes (unit normal, distance) are one, within the fixed tolerances."""
    dot = n["x"] * m["x"] + n["y"] * m["y"] + n["z"] * m["z"]
    return (1 - dot <= NORMAL) & (F.abs(d - e) <= PLANE)


def dequantised(vertices: Column, scale: Column, translate: Column) -> Column:
    """Real coordinates of integer vertices."""
    return F.transform(vertices, lambda v: F.transform(v, lambda c, i: c * F.get(scale, i) + F.get(translate, i)))


def octree_depth(budget: Column, n: Column) -> Column:
    """The deepest level whose expected points stay within a budget; a level holds four times its parent's."""
    return F.greatest(F.lit(0), F.floor(F.log(F.lit(4.0), F.greatest(F.lit(1.0), budget / n)))).cast("int")


def inside_by_angle(x: Column, y: Column, edges: Column) -> Column:
    """Whether the angles under which a point sees its ring's edges add up to a full turn."""
    seen = lambda e: F.atan2(cross(e["x1"] - x, e["y1"] - y, e["x2"] - x, e["y2"] - y), (e["x1"] - x) * (e["x2"] - x) + (e["y1"] - y) * (e["y2"] - y))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + seen(e))) > F.pi()


def inside_by_winding(x: Column, y: Column, edges: Column) -> Column:
    """Whether the ring winds around a point: edges that pass its height upwards on its right, less those downwards."""
    side = lambda e: cross(e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"])
    turn = lambda e: F.when((e["y1"] <= y) & (e["y2"] > y) & (side(e) > 0), 1).when((e["y1"] > y) & (e["y2"] <= y) & (side(e) < 0), -1).otherwise(0)
    return F.aggregate(edges, F.lit(0), lambda a, e: a + turn(e)) != 0


def inside_by_fan(x: Column, y: Column, edges: Column) -> Column:
    """Whether an odd number of the triangles from the ring's first point to its edges hold a point."""
    o = F.get(edges, F.lit(0))

    def holds(e: Column) -> Column:
        one, two = (cross(e[f"x{k}"] - o["x1"], e[f"y{k}"] - o["y1"], x - o["x1"], y - o["y1"]) >= 0 for k in (1, 2))  # a point on a diagonal is on the same side of it for both its triangles
        b = cross(e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"])
        return (one & ~two & (b > 0)) | (~one & two & (b < 0))

    return F.aggregate(edges, F.lit(0), lambda n, e: n + holds(e).cast("int")) % 2 == 1


def inside_by_slabs(x: Column, y: Column, edges: Column) -> Column:
    """Whether a point lies between an odd and an even border of its slab: the borders are the edges that cross the slab, from left to right."""
    crossing = F.filter(edges, lambda e: (F.least(e["y1"], e["y2"]) <= y) & (y < F.greatest(e["y1"], e["y2"])))
    borders = F.array_sort(F.transform(crossing, lambda e: e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])))
    return F.size(F.filter(borders, lambda b: b <= x)) % 2 == 1
