"""Queries of file formats and streams: each writes the form and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import planar
from ..functions.geometry import rectangle, register, st, to_geojson
from ..operators import cityjson, offset
from ..operators.spatial import spatial_join
from ..sources import documents, gpkg, las
from ..streaming import incremental
from .models import _features
from .registry import query
from .synth import oracle, table


def _local(spark, tag):
    """A folder that can be opened as files; one that executors share, where the shared folder is one."""
    return storage.new_path(spark, tag).removeprefix("file://").removeprefix("file:")


def _rectangles(spark, d):
    register(spark)
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return table(spark, d, "footprint").select("pid", "identificatie", "cut", rectangle(x, y, x + w, y + h).alias("geom"))


@query(oracle("SELECT pid, identificatie, w * h AS area FROM footprint"))
def s7_s8_s11_k12_geopackage(spark, d):
    """Written as GeoPackages, a file a partition, and read as features with their layer, geometry column and reference system."""
    folder = _local(spark, "gpkg")
    gpkg.write(_rectangles(spark, d).coalesce(4), folder, "buildings")
    spark.dataSource.register(gpkg.GeoPackage)
    return spark.read.format("gpkg").option("path", folder).load().select("pid", "identificatie", st("area", "geom").alias("area"))


@query(oracle("SELECT pid FROM footprint WHERE x0 + w >= 500 AND x0 <= 1500 AND y0 + h >= 100 AND y0 <= 900"))
def s20_s21_layer_within_bounds(spark, d):
    """A layer by its number, one column, and the features within bounds alone, by the R-tree."""
    folder = _local(spark, "gpkg")
    gpkg.write(_rectangles(spark, d).coalesce(4), folder, "buildings")
    spark.dataSource.register(gpkg.GeoPackage)
    return spark.read.format("gpkg").options(path=folder, layer="0", columns="pid", bbox="500,100,1500,900").load()


@query(oracle("SELECT pid, w * h AS area, 28992 AS srid FROM footprint"))
def s9_g27_blobs(spark, d):
    """Geometries as GeoPackage blobs, with an envelope of each size, and back by column functions."""
    g = _rectangles(spark, d)
    kind = F.col("pid") % 5
    pad = F.element_at(F.array(*[F.lit(b"\0" * n) for n in gpkg.ENVELOPE]), (kind + 1).cast("int"))
    head = F.concat(F.lit(b"GP\0"), F.unhex(F.lpad(F.hex((1 + kind * 2).cast("long")), 2, "0")), F.lit((28992).to_bytes(4, "little")))
    blob = F.concat(head, pad, F.col("geom"))
    told = g.select("pid", gpkg.wkb_column(blob).alias("g"), F.substring(blob, 5, 4).alias("s"))
    number = F.conv(F.concat(*[F.substring(F.hex("s"), 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("int")
    return told.select("pid", st("area", "g").alias("area"), number.alias("srid"))


@query(oracle("SELECT count(*) AS n, round(sum(x), 3) AS x, max(z) AS top, count(DISTINCT tile) AS tiles FROM point"))
def s14_k11_las_files(spark, d):
    """A LAS file for each tile, and the places of all points read back."""
    folder = _local(spark, "las")
    p = table(spark, d, "point").select("tile", "x", "y", "z")
    files = las.write_files_by_key(p, "tile", folder).count()
    spark.dataSource.register(las.Las)
    read = spark.read.format("las").options(path=folder, columns="xyz").load()
    return read.agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.max("z").alias("top")).withColumn("tiles", F.lit(files).cast("long"))


@query(oracle("SELECT DISTINCT identificatie, edge_type FROM kind"))
def s17_k10_geojson(spark, d):
    """Edges as files of whole feature collections, read with their properties checked."""
    folder = storage.new_path(spark, "geojson")
    line = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    e = table(spark, d, "kind").select(documents.feature(to_geojson(line), F.struct("identificatie", "edge_type")).alias("f"))
    documents.write_geojson_collections(e, "f", folder)
    back = documents.read_geojson(spark, folder, ["identificatie", "edge_type"], "LineString")
    return back.select(F.col("properties")["identificatie"].alias("identificatie"), F.col("properties")["edge_type"].alias("edge_type")).distinct()


@query("SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS image_id, s_acctbal AS cx FROM supplier")
def s19_camera_table(spark, d):
    """Tab-separated rows whose ids stay texts, zeros in front included."""
    path = storage.new_path(spark, "cameras")
    zero = F.lit(0.0)
    names = ["image_id", "width", "height", "cx", *documents.CAMERA.replace(" double", "").replace(" int", "").replace(" string", "").split(", ")[4:]]
    s = table(spark, d, "supplier")
    values = {"image_id": F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), "width": F.lit(4000), "height": F.lit(3000), "cx": F.col("s_acctbal")}
    s.select(*[values.get(n, zero).alias(n) for n in names]).write.csv(path, sep="\t")
    return documents.read_cameras(spark, path).select("image_id", "cx")


@query(oracle("SELECT concat('t', pid % 3) AS folder, count(*) + 1 AS n, CAST(1 AS BIGINT) AS headers FROM footprint GROUP BY 1"))
def s24_k19_model_lines(spark, d):
    """Model files with a header each, put together by folder with one header."""
    path = storage.new_path(spark, "models")
    f = _features(spark, d).select(F.concat(F.lit("t"), F.col("pid") % 3).alias("folder"), F.col("pid"), "value")
    head = f.select("folder").distinct().select("folder", F.lit(-1).alias("pid"), F.lit('{"type":"CityJSON","version":"2.0"}').alias("value"))
    f.unionByName(head).repartition("folder").sortWithinPartitions("pid").select("folder", "value").write.partitionBy("folder").text(path)
    lines = documents.read_model_lines(spark, f"{path}/*")
    out = documents.concatenate(lines, F.regexp_extract("file", "folder=(t[0-9])", 1))
    return out.groupBy("folder").agg(F.count("*").alias("n"), F.count_if(F.col("ord") == 0).alias("headers"))


@query(oracle("SELECT pid, w AS first, h AS second FROM footprint"))
def k13_csv_with_json(spark, d):
    """A nested column as JSON in a CSV, and back."""
    path = storage.new_path(spark, "csv")
    f = table(spark, d, "footprint").select("pid", F.array(F.struct(F.col("w").alias("v")), F.struct(F.col("h").alias("v"))).alias("peaks"))
    documents.write_csv_with_json(f, path)
    back = spark.read.schema("pid long, peaks string").csv(path, header=True, escape='"').select("pid", F.from_json("peaks", "array<struct<v: double>>").alias("p"))
    return back.select("pid", F.col("p")[0]["v"].alias("first"), F.col("p")[1]["v"].alias("second"))


@query("SELECT CAST(8 AS BIGINT) AS n")
def s35_discovered_files(spark, d):
    """Files with a suffix in folders below; names that start with two underscores don't count."""
    path = storage.new_path(spark, "found")
    r = table(spark, d, "region").select((F.col("r_regionkey") % 4).alias("k"), F.lit("x").alias("value")).where("k < 4")
    for name in ("a", "b"):
        r.dropDuplicates(["k"]).repartition(4, "k").write.partitionBy("k").text(f"{path}/{name}")
    r.coalesce(1).select("value").write.text(f"{path}/c__")
    files = documents.discover(spark, path, ".txt")
    return files.where(F.col("path").contains("/k=")).agg(F.count_distinct(F.regexp_extract("path", "/([ab]/k=[0-9])/", 1)).alias("n"))


@query("SELECT o_custkey AS k, count(*) AS n, count(*) > 12 AS exceeded FROM orders GROUP BY o_custkey")
def r_2_running_counts(spark, d):
    """Counts by key of a stream over a folder, which is read to its end."""
    src, out, name = storage.new_path(spark, "stream"), storage.new_path(spark, "counts"), storage.new_path(spark, "state")
    table(spark, d, "orders").select(F.col("o_custkey").alias("k")).repartition(3).write.parquet(src)
    s = incremental.running_counts(spark.readStream.schema("k long").parquet(src), "k", 12)
    s.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", name).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT c_custkey, count(*) AS n FROM customer GROUP BY c_custkey")
def r_3_resumed_work(spark, d):
    """Work on a stream that is stopped and taken up again when half of the rows have come: each key is done once."""
    src, sink, state = storage.new_path(spark, "stream"), storage.new_path(spark, "sink"), storage.new_path(spark, "state")
    c = table(spark, d, "customer").select("c_custkey")
    for rest in (0, 1):
        c.where(F.col("c_custkey") % 2 == rest).unionByName(c.where(F.col("c_custkey") % 10 == 0)).write.mode("append").parquet(src)  # some come twice
        incremental.resume(spark.readStream.schema("c_custkey long").parquet(src), sink, state, ["c_custkey"], lambda b: b).awaitTermination()
    return spark.read.parquet(sink).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query(oracle("SELECT pid, 2 AS n_holes, 4 * (1 + cut) AS second_length, (w * h - 1 - (1 + cut) * (1 + cut)) AS area FROM footprint"))
def g12_interior_rings(spark, d):
    """Holes by their number, in the order of their corners."""
    register(spark)
    f = table(spark, d, "footprint")
    x, y, w, h, c = (F.col(n) for n in ("x0", "y0", "w", "h", "cut"))
    one = st("difference", rectangle(x, y, x + w, y + h), rectangle(x + 1, y + 1, x + 2, y + 2))
    g = f.select("pid", st("difference", one, rectangle(x + 4, y + 3, x + 5 + c, y + 4 + c)).alias("g"))
    rings = F.array_sort(F.transform(st("interior_rings", "g"), lambda r: F.struct(st("bounds", r)[0].alias("x"), st("length", r).alias("length"))))
    return g.select("pid", F.size(rings).alias("n_holes"), F.get(rings, F.lit(1))["length"].alias("second_length"), st("area", "g").alias("area"))


@query(oracle("SELECT a.pid AS a, b.pid AS b, a.w <= b.w AND a.h <= b.h AND a.pid <> b.pid AND a.y0 = b.y0 AND a.x0 >= b.x0 AND a.x0 + a.w <= b.x0 + b.w AS within FROM footprint a JOIN footprint b ON a.pid <= b.pid AND b.pid <= a.pid + 1 AND a.y0 = b.y0"))
def g17_intersects_and_within(spark, d):
    """Pairs of a building and itself or its neighbour: whether one lies within the other and isn't it."""
    f = _rectangles(spark, d).join(table(spark, d, "footprint").select("pid", "y0"), "pid")
    a, b = f.select(F.col("pid").alias("a"), F.col("y0").alias("ya"), F.col("geom").alias("ga")), f.select(F.col("pid").alias("b"), F.col("y0").alias("yb"), F.col("geom").alias("gb"))
    near = a.join(b, (F.col("ya") == F.col("yb")) & F.col("b").between(F.col("a"), F.col("a") + 1))
    return near.select("a", "b", (st("within", "ga", "gb") & ~st("same_shape", "ga", "gb") & st("intersects", "ga", "gb")).alias("within"))


@query(oracle("SELECT p.point_id, f.pid FROM point p JOIN footprint f ON p.x > f.x0 AND p.x < f.x0 + f.w AND p.y > f.y0 AND p.y < f.y0 + f.h"))
def j12_points_within(spark, d):
    """A spatial join whose exact test is st_within."""
    f = _rectangles(spark, d).select("pid", "geom", st("bounds", "geom").alias("r_bounds"))
    p = table(spark, d, "point").select("point_id", st("point_of", "x", "y").alias("at"), F.array("x", "y", "x", "y").alias("l_bounds"))
    return spatial_join(p, f, 40.0, lambda _: st("within", "at", "geom")).select("point_id", "pid")


@query(oracle("SELECT pid, seq, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS family, true AS own, false AS other FROM edge"))
def m4_m14_planes(spark, d):
    """Walls on edges as planes: a wall is coplanar with itself moved by a centimetre, and not with one ten metres off."""
    e = table(spark, d, "edge")
    n = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    normal = F.struct(((F.col("y2") - F.col("y1")) / n).alias("x"), ((F.col("x1") - F.col("x2")) / n).alias("y"), F.lit(0.0).alias("z"))
    w = e.select("pid", "seq", normal.alias("n"), "x1", "y1")
    off = F.col("n.x") * F.col("x1") + F.col("n.y") * F.col("y1")
    level = F.abs(planar.cross(F.col("n.x"), F.col("n.y"), F.lit(0.0), F.lit(1.0))) < 0.5
    return w.select("pid", "seq", F.when(level, 0).otherwise(1).alias("family"), planar.coplanar(F.col("n"), off, F.col("n"), off + 0.01).alias("own"), planar.coplanar(F.col("n"), off, F.col("n"), off + 10).alias("other"))


@query(oracle("SELECT pid, CASE WHEN pid % 2 = 0 THEN 'geometry_offset_failed' END AS reason FROM footprint"))
def f13_segments_without_length(spark, d):
    """Rings, half of which have an edge without length."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    seg = lambda a, b, c, e: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2"), F.lit(True).alias("movable"))
    ring = [seg(x, y, x + w, y), seg(x + w, y, x + w, y + h), seg(x + w, y + h, x, y)]
    point = seg(x, y, x, y)
    return table(spark, d, "footprint").select("pid", F.when(F.col("pid") % 2 == 0, F.array(*ring, point)).otherwise(F.array(*ring)).alias("ring")).select("pid", offset.skip_reason(F.col("ring")).alias("reason"))


@query(oracle("SELECT concat('b', pid) AS id, 'u1' AS source, w * h * 0.25e0 AS area FROM footprint WHERE pid % 6 <> 0"))
def x13_surfaces_last_write_wins(spark, d):
    """Of faces that name one source, the last one's ring counts."""
    f = cityjson.faces(_features(spark, d), [0.5, 0.5, 0.25], [100.0, 200.0, 0.0])
    both = f.unionByName(f.withColumn("face", F.col("face") - 100).withColumn("rings", F.transform("rings", lambda r: F.slice(r, 1, 2))))
    last = cityjson.last_of_source(both)
    return last.select("id", "source", cityjson.face_area(F.col("rings")).alias("area"))


@query(oracle("SELECT pid, true AS back FROM footprint"))
def g16_there_and_back(spark, d):
    """Grid coordinates to longitude and latitude and back, to a decimetre."""
    f = table(spark, d, "footprint").select("pid", (F.col("x0") * 10 + 120_000).alias("x"), (F.col("y0") * 10 + 400_000).alias("y"))
    from ..functions.geometry import rd_to_wgs84, wgs84_to_rd

    lon, lat = rd_to_wgs84(F.col("x"), F.col("y"))
    g = f.select("pid", "x", "y", lon.alias("lon"), lat.alias("lat"))
    x, y = wgs84_to_rd(F.col("lon"), F.col("lat"))
    return g.select("pid", ((F.abs(x - F.col("x")) < 0.5) & (F.abs(y - F.col("y")) < 0.5)).alias("back"))
