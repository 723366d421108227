import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from archspan import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are missing")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = db.sql(plans.ORACLES[name])
    assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_estimates_of_blocks_equal_the_plain_estimator(spark):
    import plain_heights

    from archspan.plans import points

    got = {r["block"]: r for r in plans.QUERIES["d24_estimated_heights"](spark, SF).collect()}
    cloud, boxes = (df.toPandas() for df in points.blocks(spark, SF))
    n = 0
    for block, p in cloud.groupby("block"):
        box = boxes[boxes["block"] == block]
        if len(box) and len(p) >= 100:
            want = plain_heights.estimate(p["x"].to_numpy(), p["y"].to_numpy(), p["z"].to_numpy(), tuple(box["bounds"].iloc[0]))
            assert got[block]["error"] == want.get("error") and (got[block]["underpass_z"] or 0) == pytest.approx(want.get("underpass_z", 0))
            assert (got[block]["top_area"] or 0) == want.get("top_area", 0)
            n += 1
    assert n > 10


def test_largest_components_of_whole_layers(spark):
    from archspan.plans import points

    cells = {}
    for r in points._layers(spark, SF).collect():
        cells.setdefault((r["tile"], r["layer"]), set()).add((r["row"], r["col"]))
    want = {}
    for key, left in cells.items():
        best = 0
        while left:
            todo, n = [left.pop()], 0
            while todo:
                n += 1
                a, b = todo.pop()
                near = {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            best = max(best, n)
        want[key] = best * 0.25
    assert {(r["tile"], r["layer"]): r["area"] for r in plans.QUERIES["d22_all_components"](spark, SF).collect()} == want
