"""Queries of typed tables, tile indexes, boxes, metrics and run files, each through what it writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions.geometry import rectangle, register, st
from ..operators import validity
from ..sources import runs, tables, tiles
from .registry import query
from .synth import oracle, table


def _new(spark, tag, schema=None, key=None):
    return tables.Table(spark, storage.new_path(spark, tag), schema, key)


@query(oracle("SELECT CAST(s_suppkey AS BIGINT) AS underpass_id, concat('b', s_suppkey % 10) AS identificatie, s_acctbal AS area FROM supplier"))
def k1_k2_typed_inserts(spark, d):
    """A typed table with a unique id, filled by two batches."""
    t = _new(spark, "typed", "underpass_id BIGINT NOT NULL, identificatie STRING NOT NULL, area DOUBLE", ["underpass_id"]).create()
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("underpass_id"), F.concat(F.lit("b"), F.col("s_suppkey") % 10).alias("identificatie"), F.col("s_acctbal").alias("area"))
    return t.insert(s.where("underpass_id % 2 = 0")).insert(s.where("underpass_id % 2 = 1")).read()


@query(oracle("SELECT identificatie, sum(w * h) AS area FROM footprint WHERE cut > 0.4e0 GROUP BY identificatie"))
def k3_table_from_query(spark, d):
    f = table(spark, d, "footprint").where("cut > 0.4").groupBy("identificatie").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    return _new(spark, "query").replace(f).read()


@query(oracle("SELECT pid AS fid, identificatie, CASE WHEN pid % 3 = 0 THEN cut END AS underpass_h, CASE WHEN pid % 3 = 0 THEN 'streetlidar' ELSE 'heuristic' END AS source FROM footprint"))
def k8_column_and_update(spark, d):
    """Columns are added with their types, and set by feature id."""
    f = table(spark, d, "footprint")
    t = _new(spark, "features", "fid BIGINT NOT NULL, identificatie STRING", ["fid"]).replace(f.select(F.col("pid").alias("fid"), "identificatie"))
    t.add_column("underpass_h", "double").add_column("source", "string").add_column("source", "string")
    third = F.col("pid") % 3 == 0
    changes = f.select(F.col("pid").alias("fid"), F.when(third, F.col("cut")).alias("underpass_h"), F.when(third, "streetlidar").otherwise("heuristic").alias("source"))
    return t.update(changes, ["underpass_h", "source"]).read()


@query(oracle("SELECT edge_type, count(*) AS n, sum(abs(x2 - x1) + abs(y2 - y1)) AS length FROM kind GROUP BY edge_type"))
def k9_edge_table(spark, d):
    """Classified edges as rows of a table with geometry, unique by underpass and edge."""
    register(spark)
    t = _new(spark, "edges", "underpass_id BIGINT NOT NULL, identificatie STRING NOT NULL, edge_id INT NOT NULL, edge_type STRING, geom BINARY", ["underpass_id", "edge_id"]).create()
    e = table(spark, d, "kind").select("underpass_id", "identificatie", F.col("edge_id").cast("int").alias("edge_id"), "edge_type", st("line_of", F.array("x1", "y1", "x2", "y2")).alias("geom"))
    return t.insert(e).read().groupBy("edge_type").agg(F.count("*").alias("n"), F.sum(st("length", "geom")).alias("length"))


@query("SELECT o_custkey AS building, max(o_orderpriority) AS tag, CAST(3 AS BIGINT) AS version FROM orders GROUP BY o_custkey")
def k20_tag_store(spark, d):
    """Tags by building: two mutations, each of the version that it saw."""
    o = table(spark, d, "orders")
    t = _new(spark, "tags", "building BIGINT NOT NULL, tag STRING", ["building"])
    t.replace(o.groupBy(F.col("o_custkey").alias("building")).agg(F.min("o_orderpriority").alias("tag")))
    t.mutate(lambda df: df.withColumn("tag", F.lit(None).cast("string")), t.version())
    new = o.groupBy(F.col("o_custkey").alias("building")).agg(F.max("o_orderpriority").alias("tag"))
    t.mutate(lambda df: df.drop("tag").join(new, "building"), t.version())
    return t.read().withColumn("version", F.lit(t.version()).cast("long"))


@query(oracle("SELECT pid, CAST((row_number() OVER (ORDER BY identificatie, pid) - 1) // 500 AS BIGINT) AS chunk FROM footprint"))
def s1_ordered_chunks(spark, d):
    f = table(spark, d, "footprint").select("identificatie", "pid")
    return tables.chunks(f, ["identificatie", "pid"], 500).select("pid", F.col("chunk").cast("long").alias("chunk"))


@query(oracle("SELECT s_suppkey AS tile, CASE WHEN s_suppkey % 4 = 1 THEN concat('/abs/', s_suppkey, '.laz') ELSE concat('/root/pc/', s_suppkey, '.laz') END AS path FROM supplier WHERE s_suppkey % 4 <> 3 AND s_suppkey % 5 <> 0"))
def s12_tile_index(spark, d):
    """Every fourth location is absolute, others are relative or blank; every fifth tile lacks a geometry."""
    register(spark)
    k, name = F.col("s_suppkey"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".laz"))
    where = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("/abs/"), name)).when(k % 4 == 2, F.concat(F.lit("./"), name)).otherwise("")
    x = k.cast("double")
    layer = table(spark, d, "supplier").select(k.alias("tile"), where.alias("location"), F.when(k % 5 != 0, rectangle(x, x, x + 1, x + 1)).alias("geom"))
    return tiles.tile_index(layer, "/root/pc/").select(st("bounds", "geom")[0].cast("long").alias("tile"), "path")


@query(oracle("SELECT pid FROM footprint WHERE x0 + w >= 500 AND x0 <= 1500 AND y0 + h >= 100 AND y0 <= 900"))
def s23_box_on_columns(spark, d):
    """Features stored with their bounds and read within a box: comparisons that reach the Parquet scan."""
    f = table(spark, d, "footprint").select("pid", F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), (F.col("x0") + F.col("w")).alias("max_x"), (F.col("y0") + F.col("h")).alias("max_y"))
    return tiles.within(_new(spark, "boxes").replace(f).read(), (500, 100, 1500, 900)).select("pid")


@query(oracle("SELECT CAST(pid AS VARCHAR) AS id, part.i AS part, CASE WHEN pid % 4 <> 0 THEN cut END AS elevation, pid % 4 <> 0 AS has_elevation, p_size, w * h / 2 AS area FROM footprint JOIN (SELECT p_partkey, p_size FROM part) ON p_partkey = pid, (SELECT CAST(unnest([0, 1]) AS INT) AS i) part"))
def s22_polygon_features(spark, d):
    """Features of two polygons each, with an elevation that may be null and an attribute in its type."""
    register(spark)
    f = table(spark, d, "footprint").join(table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("string").alias("p_size")), "pid")
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    two = st("union_all", F.array(rectangle(x, y, x + w / 2, y + h), rectangle(x + w, y, x + w + w / 2, y + h)))
    layer = f.select("pid", "p_size", F.when(F.col("pid") % 4 != 0, F.col("cut")).alias("z"), two.alias("geom"))
    return tiles.polygon_features(layer, "pid", "z", {"p_size": "int"}).select("id", "part", "elevation", "has_elevation", "p_size", st("area", "geom").alias("area"))


@query(oracle("SELECT underpass_id, identificatie FROM status WHERE underpass_id = 7"))
def s27_one_by_id(spark, d):
    """One feature by its id: the limit is the feature."""
    return tiles.one_by_id(table(spark, d, "status").select("underpass_id", "identificatie"), "underpass_id", 7)


@query(oracle("""SELECT count(*) AS n, count(*) FILTER (WHERE x < 0 OR x >= 4096 OR y < 0 OR y >= 4096) AS outside FROM point"""))
def s28_m16_octree(spark, d):
    """Points stored by depth and cell; all depths within the whole cube give each point once, and a cell holds its points."""
    cube = (0.0, 0.0, 0.0, 4096.0)
    at = tiles.by_octree(table(spark, d, "point").select("point_id", "x", "y", "z"), cube, 3, "point_id")
    t = _new(spark, "octree")
    tiles.write_octree(at, t.path)
    every = tiles.read_octree(spark, t.path, (0.0, 0.0, 4096.0, 4096.0), cube, 2)
    side = cube[3] / F.pow(F.lit(2.0), F.col("depth"))
    held = (F.col("x") >= F.col("cx") * side) & (F.col("x") < (F.col("cx") + 1) * side) & (F.col("y") >= F.col("cy") * side) & (F.col("y") < (F.col("cy") + 1) * side)
    return every.agg(F.count("*").alias("n"), F.count_if(~held).alias("outside"))


@query("SELECT c_custkey AS key, max(c_acctbal) AS value FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 GROUP BY c_custkey")
def s29_values_without_blanks(spark, d):
    c = table(spark, d, "customer")
    k, v = F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return runs.clean_values(c.select(k.alias("key"), v.alias("value")), "key", "value").select(F.col("key").cast("long").alias("key"), "value")


@query("""SELECT s_suppkey % 6 = 0 AS corrupt, count(*) AS n, CAST(sum(CASE WHEN s_suppkey % 6 <> 0 AND s_suppkey % 4 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_success,
sum(CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 0.5e0 END) AS seconds FROM supplier GROUP BY s_suppkey % 6 = 0""")
def s31_d42_run_metrics(spark, d):
    """Metrics of runs as JSON texts; every sixth is cut off, which is counted and stops nothing."""
    k = F.col("s_suppkey")
    text = F.to_json(F.struct(F.concat(F.lit("t"), k.cast("string"), F.lit(".city.jsonl")).alias("file_name"), (k * 0.5).alias("wall_clock_seconds"), (k % 4).alias("exit_code"), (k % 4 != 1).alias("success")))
    files = table(spark, d, "supplier").select(k.cast("string").alias("path"), F.when(k % 6 == 0, F.left(text, F.lit(9))).otherwise(text).alias("value"))
    m = runs.parse_metrics(files)
    return m.groupBy("corrupt").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.sum("wall_clock_seconds").alias("seconds"))


@query("""SELECT s_suppkey, concat('{"allErrors":[', s_suppkey % 4, '],"val3dityVersion":"', s_suppkey, '","validity":', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS renamed,
concat('{"a":', s_suppkey, ',"b":"x","d":true}') AS parameters FROM supplier""")
def x8_x22_converted_reports(spark, d):
    k = F.col("s_suppkey")
    text = F.concat(F.lit('{"val3dity_version":"'), k.cast("string"), F.lit('","validity":'), (k % 2 == 0).cast("string"), F.lit(',"all_errors":['), (k % 4).cast("string"), F.lit('],"other":1,"parameters":{"a":'), k.cast("string"), F.lit(',"b":"x","c":[1],"d":true,"e":null,"f":{"g":1}}}'))
    return table(spark, d, "supplier").select("s_suppkey", validity.renamed(text).alias("renamed"), validity.scalar_parameters(text).alias("parameters"))


@query("SELECT true AS whole")
def x19_stamps(spark, d):
    """The time is one that can't be told before; its form can."""
    return table(spark, d, "region").select(runs.stamp().alias("t")).agg(F.bool_and(F.col("t").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")).alias("whole"))


@query(oracle("SELECT floor(x0 / 400) AS cx, pid, CAST(row_number() OVER (PARTITION BY floor(x0 / 400) ORDER BY x0, y0, pid) AS BIGINT) AS place FROM footprint"))
def t6_order_within_cells(spark, d):
    """Places of a cell's rows by the corner of their bounds, as they are stored: a cell's rows are one sorted partition's run."""
    f = table(spark, d, "footprint").select(F.floor(F.col("x0") / 400).cast("double").alias("cx"), "pid", F.array("x0", "y0").alias("bounds"))
    rows = tiles.spatial_order(f.repartition("cx"), "bounds", "pid").withColumn("at", F.monotonically_increasing_id())
    rows = storage.durable(rows, "ordered")
    before = rows.alias("r").join(rows.groupBy("cx").agg(F.collect_list("at").alias("all")), "cx")
    return before.select("cx", "pid", F.size(F.filter("all", lambda v: v <= F.col("at"))).cast("long").alias("place"))


@query(oracle("SELECT tile, count(*) AS n FROM point GROUP BY tile"))
def s16_cached_result(spark, d):
    """Counts that the first call makes and the second one reads."""
    path = storage.new_path(spark, "cached")
    make = lambda: table(spark, d, "point").groupBy("tile").agg(F.count("*").alias("n"))
    tables.cached(spark, path, make)

    def never():
        raise RuntimeError("made twice")

    return tables.cached(spark, path, never)
