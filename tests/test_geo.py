import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import geo

POINTS = [(0.0, 0.0), (86.0, 10.0), (10.0, 179.9), (10.0, -179.9), (-89.9, 5.0), (40.7, -74.0), (None, 3.0)]


def far(a, b):
    u, v = (math.sin(math.radians(x - y) / 2) for x, y in zip(a, b))
    return 2 * geo.EARTH * math.asin(math.sqrt(u * u + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * v * v))


def test_distance(spark):
    df = spark.createDataFrame(POINTS, "lat double, lon double")
    for origin in ((40.7, -74.0), (10.0, 179.95), (0.0, 0.0)):
        got = [r[0] for r in df.select(geo.distance(F.col("lat"), F.col("lon"), origin)).collect()]
        assert got[-1] is None
        assert all(abs(g - far(p, origin)) < 1e-3 for g, p in zip(got, POINTS[:-1]))


@settings(max_examples=12, deadline=None)
@given(st.floats(-89, 89), st.floats(-180, 180), st.floats(1, 9e6))
def test_box_holds_every_near_point(spark, lat, lon, radius):
    df = spark.range(1500).select(
        (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon")
    )
    test = geo.box(F.col("lat"), F.col("lon"), (lat, lon), radius)
    if test is not None:
        near = df.where(geo.distance(F.col("lat"), F.col("lon"), (lat, lon)) <= radius)
        assert near.where(~test).count() == 0


def test_cells_interleave(spark):
    df = spark.createDataFrame([(0.0, 0.0), (86.0, 0.0), (-85.0, -180.0)], "lat double, lon double")
    got = [r[0] for r in df.select(geo.cell(F.col("lat"), F.col("lon"), 1)).collect()]
    assert got == [3, 0, 0]


def test_cells_decode(spark):
    points = [(0.0, 0.0), (40.7, -74.0), (-85.0, 179.99), (85.0, -180.0), (-33.9, 151.2)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for steps in (1, 5, 16, 31):
        code = geo.cell(F.col("lat"), F.col("lon"), steps)
        row, column = geo.cell_place(code)
        centre = geo.cell_centre(code, steps)
        high, wide = 2 * geo.CELL_LATITUDE / 2**steps, 360 / 2**steps
        for r in df.select("lat", "lon", row.alias("row"), column.alias("column"), centre.alias("c"), code.alias("code")).collect():
            assert abs(r.c.lat - r.lat) <= high / 2 + 1e-9 and abs(r.c.lon - r.lon) <= wide / 2 + 1e-9
            # bits of row and column in turn, as plain arithmetic has them
            assert r.code == sum(((r.row >> i & 1) << 2 * i) + ((r.column >> i & 1) << 2 * i + 1) for i in range(steps))
