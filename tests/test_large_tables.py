"""Queries on small tables that hold what only large ones of the driver do."""

import duckdb
import pytest
from test_queries import rows

from archspan import plans


def agrees(spark, folder, name, **tables):
    """Whether a query gives its SQL's rows on tables of DuckDB's SQL texts."""
    db = duckdb.connect()
    for t, text in tables.items():
        db.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = db.sql(plans.ORACLES[name])
    assert got[1] and got == rows(want.columns, want.fetchall())


PART = "SELECT CAST({} AS BIGINT) AS p_partkey, CAST(i % 50 AS INT) AS p_size FROM range({}) t(i)"


def test_most_central_point_where_ids_outweigh_distances(spark, tmp_path):
    line = "SELECT CAST(i * 40000 AS BIGINT) AS l_orderkey, CAST(i % 100 AS BIGINT) AS l_partkey, CAST(i % 24 AS BIGINT) AS l_suppkey, CAST(i % 5 AS INT) AS l_linenumber, 4.0 AS l_quantity FROM range(3000) t(i)"
    agrees(spark, tmp_path, "t10_most_central", lineitem=line)


def test_geojson_files_do_not_grow_with_a_partition(spark, tmp_path):
    from pyspark.sql import functions as F

    from archspan.sources import documents

    point = F.lit('{"type":"Point","coordinates":[1,2]}')
    f = spark.range(0, 30_000, 1, 1).select(documents.feature(point, F.struct(F.col("id").alias("n"))).alias("f"))
    documents.write_geojson_collections(f, "f", str(tmp_path / "g"))
    files = list((tmp_path / "g").glob("part-*"))
    assert len(files) > 1 and max(p.stat().st_size for p in files) <= 2_000_001
    back = documents.read_geojson(spark, str(tmp_path / "g"), ["n"], "Point")
    assert sorted(int(r["n"]) for r in back.select(F.col("properties")["n"].alias("n")).collect()) == list(range(30_000))
    documents.write_geojson_collections(f.where("false"), "f", str(tmp_path / "empty"))
    assert documents.read_geojson(spark, str(tmp_path / "empty"), ["n"], "Point").count() == 0


def test_cells_of_polygons_are_not_broadcast(spark, tmp_path):
    line = "SELECT CAST(i AS BIGINT) AS l_orderkey, CAST(i % 100 AS BIGINT) AS l_partkey, CAST(i % 24 AS BIGINT) AS l_suppkey, CAST(i % 5 AS INT) AS l_linenumber, 4.0 AS l_quantity FROM range(3000) t(i)"
    agrees(spark, tmp_path, "d19_shell_minus_holes", lineitem=line, part=PART.format("i", 100))
    assert "Broadcast" not in plans.QUERIES["d19_shell_minus_holes"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_critical_walls_of_edges_whose_ids_are_far_apart(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from archspan.operators import walls

    edges = walls.critical_edges
    monkeypatch.setattr(walls, "critical_edges", lambda *a: edges(*a).withColumn("edge_id", F.col("edge_id") * 1_000_000))
    agrees(spark, tmp_path, "d28_critical_walls", part=PART.format("i", 60))


def test_grid_coordinates_far_from_the_country(spark, tmp_path):
    from pyspark.sql import functions as F

    from archspan.functions.geometry import rd_to_wgs84

    agrees(spark, tmp_path, "g16_there_and_back", part=PART.format("i * 3001", 400))
    lon, lat = rd_to_wgs84(F.lit(121687.43), F.lit(487484.06))
    r = spark.range(1).select(lon, lat).first()
    assert r[0] == pytest.approx(4.89801, abs=1e-5) and r[1] == pytest.approx(52.37422, abs=1e-5)


def test_models_of_inferred_kinds_are_not_broadcast(spark, tmp_path):
    agrees(spark, tmp_path, "d38_inferred_semantics", part=PART.format("i", 40))
    plan = plans.QUERIES["d38_inferred_semantics"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "from_json" not in plan
