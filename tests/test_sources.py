import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from archspan.functions.geometry import register, st
from archspan.sources import documents, gpkg, las, runs, tables, tiles
from archspan.streaming import incremental


def test_geopackage_round_trip(spark, tmp_path):
    register(spark)
    df = spark.range(5).select("id", F.concat(F.lit("n"), "id").alias("name"), st("point_of", F.col("id").cast("double"), F.lit(2.0)).alias("geom"))
    files = gpkg.write(df.coalesce(1), str(tmp_path / "g"), "points")
    assert [os.path.basename(f) for f in files] == ["points-00000.gpkg"]
    spark.dataSource.register(gpkg.GeoPackage)
    back = spark.read.format("gpkg").option("path", str(tmp_path / "g")).load()
    assert back.schema["geom"].dataType.simpleString() == "binary"
    got = {(r["id"], r["name"], r["x"]) for r in back.select("id", "name", st("bounds", "geom")[0].alias("x")).collect()}
    assert got == {(i, f"n{i}", float(i)) for i in range(5)}
    with pytest.raises(Exception, match="no feature layer"):
        spark.read.format("gpkg").option("path", str(tmp_path / "g")).option("layer", "other").load().collect()


def test_geopackage_blobs(spark):
    wkb = bytes(range(21))
    for kind, size in enumerate(gpkg.ENVELOPE):
        blob = b"GP" + bytes([0, 1 | kind << 1, 0, 0, 0, 0]) + b"e" * size + wkb
        assert gpkg.wkb_of(blob) == wkb
        assert bytes(spark.range(1).select(gpkg.wkb_column(F.lit(blob)).alias("g")).first()["g"]) == wkb
    assert gpkg.wkb_of(gpkg.blob_of(wkb)) == wkb
    with pytest.raises(ValueError):
        gpkg.wkb_of(b"XX000000")


def test_las_round_trip(spark, tmp_path):
    x = np.arange(1000) / 8
    las.write(str(tmp_path / "a.las"), x, x + 1, x * 0)
    las.write(str(tmp_path / "b.las"), x[:0], x[:0], x[:0])
    las.check_compatible([str(tmp_path / "a.las"), str(tmp_path / "b.las")])
    spark.dataSource.register(las.Las)
    df = spark.read.format("las").option("path", str(tmp_path)).load()
    r = df.agg(F.count("*"), F.sum("x"), F.max("y"), F.max("z"), F.count_distinct("tile")).first()
    assert tuple(r) == (1000, pytest.approx(x.sum()), pytest.approx(x.max() + 1), 0.0, 1)


def test_geojson(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"identificatie": "a", "n": 1}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(fc, indent=1))
    df = documents.read_geojson(spark, str(tmp_path), ["identificatie"], "LineString")
    r = documents.one_feature(df).first()
    assert r["properties"] == {"identificatie": "a", "n": "1"} and json.loads(r["geometry"]["coordinates"]) == [[0, 0], [1, 1]]
    with pytest.raises(Exception, match="property missing is missing"):
        documents.read_geojson(spark, str(tmp_path), ["missing"]).collect()
    with pytest.raises(Exception, match="no Polygon"):
        documents.read_geojson(spark, str(tmp_path), kind="Polygon").collect()


def test_models_cameras_csv_and_discovery(spark, tmp_path):
    for t in ("t1", "t2"):
        os.makedirs(tmp_path / t)
        for f in ("a", "b"):
            (tmp_path / t / f"{f}.jsonl").write_text('{"type":"CityJSON","f":"%s"}\n{"type":"CityJSONFeature","id":"%s%s"}\n' % (f, t, f))
    m = documents.read_model_lines(spark, str(tmp_path / "*"))
    out = documents.concatenate(m, F.regexp_extract("file", "/(t[0-9])/", 1))
    assert out.groupBy("folder").agg(F.count("*").alias("n"), F.min_by("value", "ord").alias("h")).orderBy("folder").collect() == [("t1", 3, '{"type":"CityJSON","f":"a"}'), ("t2", 3, '{"type":"CityJSON","f":"a"}')]
    (tmp_path / "t1" / "__x.jsonl").write_text("x")
    assert documents.discover(spark, str(tmp_path), ".jsonl").count() == 4
    (tmp_path / "cam.tsv").write_text("0012\t10\t20\t1\t2\t3\t0\t0\t0\t5\t5\t1\t1\n")
    assert documents.read_cameras(spark, str(tmp_path / "cam.tsv")).first()["image_id"] == "0012"
    documents.write_csv_with_json(spark.sql("SELECT 1 AS a, array(named_struct('z', 2.5D)) AS peaks"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["peaks"] == '[{"z":2.5}]'


def test_streams(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    spark.range(10).select("id", (F.col("id") % 3).alias("k")).write.parquet(src)
    for n in (10, 10, 15):  # the second run finds nothing new
        if n == 15:
            spark.range(5, 15).select("id", (F.col("id") % 3).alias("k")).write.mode("append").parquet(src)
        s = spark.readStream.schema("id long, k long").parquet(src)
        incremental.resume(s, sink, str(tmp_path / "cp"), ["id"], lambda b: b.withColumn("done", F.lit(True))).awaitTermination()
        assert spark.read.parquet(sink).count() == n
    s = spark.readStream.schema("id long, k long").parquet(src)
    q = incremental.running_counts(s, "k", 6).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == {(0, 7, True), (1, 6, False), (2, 7, True)}
    lines = spark.createDataFrame([('{"id":"a","x":1}',), ('{"id":"b"}',)], "value string")
    got = incremental.decode_matching(lines, spark.createDataFrame([("a",)], "id string")).select("id", "match").collect()
    assert {tuple(r) for r in got} == {("a", True), ("b", False)}


def test_geopackage_within_bounds(spark, tmp_path):
    register(spark)
    n = F.col("id").cast("double")
    square = st("polygon_of", F.array(n, n, n + 1, n, n + 1, n + 1, n, n + 1, n, n))
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") != 50, square).alias("geom"))
    gpkg.write(df.repartition(3), str(tmp_path / "g"), "squares")
    spark.dataSource.register(gpkg.GeoPackage)
    read = lambda **o: spark.read.format("gpkg").options(path=str(tmp_path / "g"), **o).load()
    assert gpkg.extent(str(tmp_path / "g")) == (0, 0, 100, 100)
    near = read(bbox="9.5,0,20,19.5", columns="id", layer="0")
    assert near.columns == ["id"] and sorted(r["id"] for r in near.collect()) == list(range(9, 20))
    assert sorted(r["id"] for r in read(bbox="48,48,52,52").collect()) == [47, 48, 49, 51, 52]
    assert read(srid="4326").schema["geom"].metadata == {"srid": 4326} and read().count() == 100
    for f in gpkg.files_of(str(tmp_path / "g")):  # without an index the bounds of the geometries themselves count
        import sqlite3

        with sqlite3.connect(f) as db:
            db.execute('DROP TABLE "rtree_squares_geom"')
    assert gpkg.extent(str(tmp_path / "g")) == (0, 0, 100, 100) and read(bbox="9.5,0,20,19.5").count() == 11
    with pytest.raises(Exception, match="no columns other"):
        read(columns="id,other").collect()


def test_bounds_of_all_kinds_of_geometry(spark):
    register(spark)
    texts = ["POINT(1 2)", "LINESTRING(0 0,3 -1)", "POLYGON((0 0,4 0,4 4,0 0),(1 .5,2 .5,2 1,1 .5))", "MULTIPOINT((1 1),(5 6))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((8 8,9 8,9 9,8 8)))", "GEOMETRYCOLLECTION(POINT(7 7),LINESTRING(-1 0,0 0))"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(st("from_text", "t").alias("g")).select("g", st("bounds", "g").alias("b")).collect()
    assert [gpkg.wkb_bounds(bytes(r["g"])) for r in rows] == [tuple(r["b"]) for r in rows]
    import struct

    assert gpkg.wkb_bounds(struct.pack("<BI3d", 1, 1001, 1, 2, 3)) == (1, 2, 1, 2) and gpkg.wkb_bounds(struct.pack(">BII4d", 0, 0x80000002, 1, 1, 2, 3, 4)[:33]) == (1, 2, 1, 2)
    assert gpkg.wkb_bounds(struct.pack("<BII", 1, 3, 0)) is None


def test_las_columns_and_reference_systems(spark, tmp_path):
    x = np.arange(10) / 8
    for name, crs in (("a", "PROJCS[one]"), ("b", "PROJCS[one]"), ("c", "PROJCS[two]")):
        las.write(str(tmp_path / f"{name}.las"), x, x + 1, x * 0, crs=crs)
    assert las.header(str(tmp_path / "a.las")).crs == "PROJCS[one]"
    las.check_compatible([str(tmp_path / f"{n}.las") for n in "ab"])
    with pytest.raises(ValueError, match="files differ"):
        las.check_compatible([str(tmp_path / f"{n}.las") for n in "ac"])
    spark.dataSource.register(las.Las)
    read = lambda c: spark.read.format("las").options(path=str(tmp_path), columns=c).load()
    assert read("xyz").columns == ["x", "y", "z"] and read("z,tile").columns == ["z", "tile"] and len(read("all").columns) == 6
    assert tuple(read("xyz").agg(F.count("*"), F.sum("x"), F.max("y")).first()) == (30, pytest.approx(3 * x.sum()), pytest.approx(x.max() + 1))
    assert read("tile").distinct().count() == 3
    with pytest.raises(Exception, match="no columns w"):
        read("w").collect()


def test_typed_tables(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), "id BIGINT NOT NULL, v STRING", ["id"]).create()
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    t.insert(rows((1, "a"), (2, None))).insert(rows((3, "c")))
    assert t.version() == 3 and t.read().count() == 3 and t.read(2).count() == 2
    for bad, error, text in [(rows((3, "x")), ValueError, "several rows"), (rows((None, "x")), ValueError, "null in id"), (rows((7, "x"), (7, "y")), ValueError, "several rows"),
                             (spark.sql("SELECT 1 AS id, 'x' AS v"), TypeError, "id"), (spark.sql("SELECT 9L AS id"), TypeError, "v"), (rows((8, "x")).withColumn("w", F.lit(1)), TypeError, "w")]:
        with pytest.raises(error, match=text):
            t.insert(bad)
    assert t.version() == 3  # what failed left nothing
    t.add_column("h", "double").update(spark.createDataFrame([(1, 2.5), (99, 1.0)], "id long, h double"), ["h"])
    assert {tuple(r) for r in t.read().collect()} == {(1, "a", 2.5), (2, None, None), (3, "c", None)}
    with pytest.raises(ValueError, match="is there as double"):
        t.add_column("h", "string")
    with pytest.raises(ValueError, match="several rows"):
        t.update(spark.createDataFrame([(1, 2.5), (1, 1.0)], "id long, h double"), ["h"])
    seen = t.version()
    t.mutate(lambda df: df.where("id > 1"), seen)
    with pytest.raises(tables.Conflict):
        t.mutate(lambda df: df.where("id > 2"), seen)
    assert t.read().count() == 2
    os.makedirs(tmp_path / "t" / f"v{t.version() + 1:06d}")  # a writer that died
    assert t.read().count() == 2
    with pytest.raises(tables.Conflict):
        t.insert(t.read().limit(0))
    assert t.create().read().count() == 0 and t.version() == 1
    with pytest.raises(FileNotFoundError):
        tables.Table(spark, str(tmp_path / "none")).read()


def test_cached_results_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(4)

    assert [tables.cached(spark, str(tmp_path / "c"), make).count() for _ in range(3)] == [4, 4, 4] and len(made) == 1


def test_tile_index_and_box_query(spark):
    register(spark)
    layer = spark.createDataFrame([("a.laz",), ("./b/../c.laz",), ("s3://x/d.laz",), ("",), (None,)], "location string").withColumn("geom", st("point_of", F.lit(1.0), F.lit(2.0)))
    assert [r["path"] for r in tiles.tile_index(layer, "/pc").collect()] == ["/pc/a.laz", "/pc/b/../c.laz", "s3://x/d.laz"]
    with pytest.raises(ValueError, match="no usable tile"):
        tiles.tile_index(layer.where("coalesce(location, '') = ''"), "/pc")
    assert tiles.box_query('s.t"x', ["id", "h"], "geom", (1, 2, 3, 4)) == 'SELECT "id", "h", ST_AsBinary("geom") AS "geom" FROM "s"."t""x" WHERE "geom" && ST_MakeEnvelope(1.0, 2.0, 3.0, 4.0, 28992)'


def test_octree_reads_cells_in_the_box_alone(spark, tmp_path):
    pts = spark.range(2000).select("id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1600)) / 100.0).alias(c) for k, c in enumerate("xyz")])
    cube, box = (0.0, 0.0, 0.0, 16.0), (0.0, 0.0, 3.0, 3.0)
    tiles.write_octree(tiles.by_octree(pts, cube, 3, "id"), str(tmp_path / "o"))
    got = tiles.read_octree(spark, str(tmp_path / "o"), box, cube, 2)
    want = {r["id"] for r in pts.where("x <= 3 AND y <= 3").collect()}
    assert want <= {r["id"] for r in got.collect()} and got.count() < 600 and tiles.read_octree(spark, str(tmp_path / "o"), box, cube, 0).count() < 60
    assert tiles.read_octree(spark, str(tmp_path / "o"), (0.0, 0.0, 16.0, 16.0), cube, 2).count() == 2000


def test_settings_metrics_and_images(spark, tmp_path):
    (tmp_path / ".env").write_text("# db\nexport A_HOST='h'\nA_PORT=54 # note\nA_DATABASE=\"d\"\n\nA_USER=u\n")
    with pytest.raises(KeyError, match="A_PASSWORD"):
        runs.settings("a_", str(tmp_path / ".env"), {})
    s = runs.settings("a_", str(tmp_path / ".env"), {"A_PASSWORD": "p", "A_USER": "w", "A_HOST": ""})
    assert (s.host, s.port, s.database, s.user, s.password) == ("h", 54, "d", "w", "p")
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"file_name": "a",\n "exit_code": 0, "success": true, "wall_clock_seconds": 1.5}')
    (tmp_path / "m/b.json").write_text('{"file_name": ')
    m = runs.read_metrics(spark, str(tmp_path / "m"))
    assert {(r["corrupt"], r["file_name"], r["wall_clock_seconds"]) for r in m.collect()} == {(False, "a", 1.5), (True, None, None)}
    runs.write_metrics(m, str(tmp_path / "csv"))
    assert [r["file_name"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["a"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x1.png").write_bytes(b"one")
    names = spark.createDataFrame([("x1",), ("x2",)], "image_id string")
    assert {(r["image_id"], r["found"]) for r in runs.read_images(spark, names, str(tmp_path / "i")).collect()} == {("x1", True), ("x2", False)}
    (tmp_path / "v.csv").write_text("id,h\na,1.5\n ,2\nb,\nc,x\na,1.0\n")
    assert {tuple(r) for r in runs.read_values(spark, str(tmp_path / "v.csv"), "id", "h").collect()} == {("a", 1.5)}
