"""Geometry, points and status rows derived from the driver's tables.

The tables hold no geometry. These SQL texts derive it by integer arithmetic on
multiples of a quarter, in a dialect that Spark and DuckDB share, so that both
sides of a comparison start from exactly the same doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# A building: a rectangle in a cell of 40 by 40, and by how much the topographic one is narrower.
FOOTPRINT = """
SELECT p_partkey AS pid, concat('NL.IMBAG.Pand.', lpad(cast(p_partkey AS varchar(20)), 16, '0')) AS identificatie,
       lpad(cast(p_partkey AS varchar(20)), 16, '0') AS key,
       (p_partkey % 100) * 40e0 AS x0, floor(p_partkey / 100e0) * 40e0 AS y0,
       (8 + p_size % 16) * 1e0 AS w, (8 + p_partkey % 12) * 1e0 AS h, (p_partkey % 7) * 0.25e0 AS cut
FROM part"""

# Points around buildings; an eighth off the grid, so that none lies on an edge.
POINT = """
SELECT l_orderkey * 10 + l_linenumber AS point_id, l_partkey AS pid,
       (l_partkey % 100) * 40e0 + ((l_suppkey * 7 + l_linenumber * 3 + l_orderkey) % 96) * 0.25e0 + 0.125e0 AS x,
       floor(l_partkey / 100e0) * 40e0 + ((l_orderkey * 5 + l_linenumber * 11) % 80) * 0.25e0 + 0.125e0 AS y,
       l_quantity * 0.25e0 AS z, cast(l_suppkey % 8 AS int) AS tile
FROM lineitem"""

# Edges of L-shaped rings, one a building, counter-clockwise.
EDGE = """
SELECT pid, 0 AS ring, 0 AS seq, x0 AS x1, y0 AS y1, x0 + w AS x2, y0 AS y2 FROM footprint
UNION ALL SELECT pid, 0, 1, x0 + w, y0, x0 + w, y0 + 4e0 FROM footprint
UNION ALL SELECT pid, 0, 2, x0 + w, y0 + 4e0, x0 + 4e0, y0 + 4e0 FROM footprint
UNION ALL SELECT pid, 0, 3, x0 + 4e0, y0 + 4e0, x0 + 4e0, y0 + h FROM footprint
UNION ALL SELECT pid, 0, 4, x0 + 4e0, y0 + h, x0, y0 + h FROM footprint
UNION ALL SELECT pid, 0, 5, x0, y0 + h, x0, y0 FROM footprint"""

# Roads: level segments through the yards.
ROAD = """
SELECT s_suppkey AS road_id, CASE WHEN s_suppkey % 9 = 0 THEN 'water' ELSE 'road' END AS subtype,
       CASE s_suppkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'service' ELSE 'steps' END AS class,
       (s_suppkey % 90) * 40e0 + 1e0 AS xa, (s_suppkey % 90) * 40e0 + 130e0 AS xb, floor(s_suppkey / 5e0) * 40e0 + 3e0 AS y
FROM supplier"""

# Result rows of a height run.
STATUS = """
SELECT o_orderkey AS underpass_id, concat('NL.IMBAG.Pand.', lpad(cast(o_custkey AS varchar(20)), 16, '0')) AS identificatie,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN 'success'
            WHEN o_orderkey % 3 = 0 THEN 'too_few_points' WHEN o_orderkey % 3 = 1 THEN 'too_many_points' ELSE 'failed' END AS underpass_status,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN 'streetlidar' ELSE 'fallback' END AS underpass_source,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN cast(0 AS bigint) ELSE cast(floor(o_totalprice * (o_orderkey % 5) * (o_orderkey % 7)) AS bigint) END AS underpass_point_count,
       CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 6 <> 1 THEN (o_orderkey % 80) * 0.25e0 END AS underpass_z,
       CASE WHEN o_orderkey % 11 = 0 OR (o_orderstatus = 'F' AND o_orderkey % 4 <> 0) THEN NULL
            WHEN o_orderkey % 3 = 0 THEN concat('Only ', cast(o_orderkey % 90 AS varchar(20)), ' points inside polygon; minimum is 100')
            WHEN o_orderkey % 3 = 1 THEN 'Selected more than 5000000 points'
            WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Fewer than two usable Z peaks found' END AS underpass_error
FROM orders"""

# Directed edges of underpasses with a kind, and neighbours of buildings.
KIND = """
SELECT pid AS underpass_id, concat('NL.IMBAG.Pand.', lpad(cast(pid AS varchar(20)), 16, '0')) AS identificatie, seq AS edge_id,
       CASE WHEN (pid + seq) % 3 = 0 THEN 'interior' WHEN (pid * 7 + seq) % 5 = 0 THEN 'shared' ELSE 'exterior' END AS edge_type, x1, y1, x2, y2
FROM edge"""
ADJACENT = "SELECT a.identificatie, b.identificatie AS adjacent_identificatie, a.pid, b.pid AS adjacent_pid FROM footprint a JOIN footprint b ON b.pid = a.pid + 1 WHERE a.pid % 100 <> 99"

# Cameras and walls of the oblique imagery.
CAMERA = """
SELECT concat('img', cast(s_suppkey AS varchar(20))) AS image_id, (s_suppkey % 40) * 50e0 AS cx, floor(s_suppkey / 40e0) * 50e0 - 30e0 AS cy, 60e0 + s_suppkey % 7 AS cz,
       (s_suppkey % 9 - 4) * 0.05e0 AS omega, (s_suppkey % 7 - 3) * 0.05e0 AS phi, (s_suppkey % 11 - 5) * 0.1e0 AS kappa, 2000e0 AS f, 4000 AS width, 3000 AS height
FROM supplier"""

TABLES = {"footprint": FOOTPRINT, "point": POINT, "edge": EDGE, "road": ROAD, "status": STATUS, "kind": KIND, "adjacent": ADJACENT, "camera": CAMERA}
BASE = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table or a derived one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TABLES[name]
    used = {w: table(spark, sf_dir, w) for w in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text))}
    return spark.sql(re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", r"\1\2{\3}", text), **used)


def oracle(body: str) -> str:
    """SQL that starts with the derived tables that body names; body is a query, or further 'WITH' members and a query."""
    need: list[str] = []

    def add(text: str) -> None:
        for w in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if w in TABLES and w not in need:
                add(TABLES[w])
                need.append(w)

    add(body)
    body = body.strip()
    head = ", ".join(f"{w} AS ({TABLES[w]})" for w in need)
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[14 if recursive else 4 :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{rest}"
    return f"WITH {head} {body}" if head else body
