import math
import random

import pytest
from pyspark.sql import functions as F

from terrasieve.functions import crs, geom
from terrasieve.operators.matching import overlap_area, signed_edges

HOLED = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
MULTI = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 5 7, 7 7, 7 5, 5 5)))"
CONCAVE = "POLYGON ((0 0, 20 1, 8 9, 22 25, -3 20, 0 0))"


def star(rng, cx=0.0, cy=0.0):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(5, 14)))
    p = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in ((t, rng.uniform(0.3, 1)) for t in a)]
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*p, p[0]]) + "))"


def one(spark, wkt, *columns):
    df = spark.createDataFrame([(wkt,)], "w string").withColumn("g", geom.parse_wkt(F.col("w")))
    return df.select(*columns).first()


def test_measures(spark):
    g = F.col("g")
    r = one(spark, HOLED, geom.area(g), geom.perimeter(g), geom.centroid(g).alias("c"), geom.box(g).alias("b"), geom.contains_point(g, F.lit(3.0), F.lit(3.0)), geom.contains_point(g, F.lit(5.0), F.lit(5.0)))
    assert (r[0], r[1], r[4], r[5]) == (96.0, 48.0, False, True)
    assert r.c.x == pytest.approx((500 - 12) / 96) and tuple(r.b) == (0, 0, 10, 10)
    assert one(spark, MULTI, geom.area(g))[0] == 5.0
    r = one(spark, "POLYGON EMPTY", geom.area(g), geom.box(g), geom.centroid(g), geom.format_wkt(g))
    assert tuple(r) == (0.0, None, None, "POLYGON EMPTY")
    assert tuple(one(spark, None, geom.area(g), geom.format_wkt(g))) == (None, None)
    assert one(spark, "POINT (1 2)", g)[0] is None


def test_wkt_round_trip(spark):
    assert one(spark, MULTI, geom.format_wkt(F.col("g"), 0))[0] == MULTI
    assert one(spark, "polygon z((0.5 1.5 9,2.5 3.5 9,4 4 9,0.5 1.5 9))", geom.format_wkt(F.col("g"), 0))[0] == "POLYGON ((0 2, 2 4, 4 4, 0 2))"  # halves to even


def test_affine_is_inverse(spark):
    tr = [F.lit(v) for v in (2.7e-6, 1e-7, 23.5, -2e-7, -2.7e-6, 30.9)]
    g = geom.map_points(geom.map_points(F.col("g"), geom.pixel_to_geo(*tr)), geom.geo_to_pixel(*tr))
    assert one(spark, CONCAVE, geom.format_wkt(g, 3))[0] == one(spark, CONCAVE, geom.format_wkt(F.col("g"), 3))[0]


def test_overlap_area_is_exact(spark):
    """Against the topology suite in Spark's own jars, which only the driver reaches."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(4)
    pairs = [(star(rng), star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1))) for _ in range(150)] + [(HOLED, CONCAVE), (MULTI, HOLED), (HOLED, HOLED), ("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))")]
    pairs = [(a, b) for a, b in pairs if reader.read(a).isValid() and reader.read(b).isValid()]
    got = overlap_area([signed_edges(a).ravel() for a, _ in pairs], [signed_edges(b).ravel() for _, b in pairs])
    for (a, b), v in zip(pairs, got):
        assert v == pytest.approx(reader.read(a).intersection(reader.read(b)).getArea(), abs=1e-9)
    assert overlap_area([], []).size == 0


def test_labels(spark):
    line = geom.parse_line(F.lit("LINESTRING (0 0, 0 6)"))
    boat = spark.range(1).select(geom.feature_label(line, F.lit("Boat")).alias("b")).first().b
    assert (boat.length, boat.width, boat.aspect, boat.compass) == (6, 2, 3, 0) and {(p.x, p.y) for p in boat.ring} == {(-1, 0), (-1, 6), (1, 6), (1, 0)}
    plane = spark.range(1).select(geom.feature_label(geom.parse_line(F.lit("LINESTRING (0 -4, 3 0, 0 4, -3 0)")), F.lit("Airplane")).alias("p")).first().p
    assert (plane.length, plane.width, plane.compass) == (8, 6, 180)


def test_utm(spark):
    rows = [(i, lon, lat) for i, (lon, lat) in enumerate([(-180.0, -79.9), (0.0, 0.0), (23.5, 30.98), (179.99, -14.0), (-101.25, 12.0), (7.5, 51.2)])]
    df = spark.createDataFrame(rows, "i int, lon double, lat double").withColumn("u", crs.utm_forward(F.col("lon"), F.col("lat")))
    got = df.select("i", "lon", "lat", "u.*", crs.utm_inverse(F.col("u.easting"), F.col("u.northing"), F.col("u.zone"), F.col("u.northern")).alias("b")).orderBy("i").collect()
    for r in got:
        assert r.b.lon == pytest.approx(r.lon, abs=1e-9) and r.b.lat == pytest.approx(r.lat, abs=1e-9)
    assert (got[5].zone, round(got[5].easting, 2), round(got[5].northing, 2)) == (32, 395201.31, 5673135.24)


def test_frames_hold_every_position(spark, tmp_path):
    from math import hypot

    import __spark_entry__ as entry

    places = [(17.7, 60.5), (23.5, 31.0), (-101.2, 12.0), (-179.999, -14.0), (179.999, -14.0), (-0.3, -42.0), (29.9, 1.0), (30.0, 1.0)]
    rows = [(i, "roof", f"POINT ({x} {y})") for i, (x, y) in enumerate(places)]
    spark.createDataFrame(rows, "point_id long, label string, geometry string").write.parquet(f"{tmp_path}/scene_points.parquet")
    got = {r.point_id: r for r in entry.queries()["a17_frame_to_utm"](spark, str(tmp_path)).collect()}
    assert {i: r.zone for i, r in got.items()} == {0: 33, 1: 33, 2: 14, 3: 1, 4: 1, 5: 30, 6: 33, 7: 36}
    assert hypot(got[3].easting - got[4].easting, got[3].northing - got[4].northing) < 250  # 0.002 degrees apart


def test_metric_square_is_the_envelope_of_the_circle(spark):
    from terrasieve.operators.tables import object_centred

    places = [(1, 13.4, 52.5, "Big Boat", 7), (2, -70.6, -33.4, None, 7), (3, 179.9999, 0.0, "x", 7), (4, None, 1.0, "x", 7)]
    df = spark.createDataFrame(places, "id int, lon double, lat double, kind string, box int")
    got = {r.id: r for r in object_centred(df, "lon", "lat", 50.0, "kind").collect()}
    assert (got[1].folder, got[2].folder, got[4].box) == ("BigBoat", "unknown", None)
    for i, lon, lat, *_ in places[:3]:
        u = spark.range(1).select(crs.utm_forward(F.lit(lon), F.lit(lat)).alias("u")).first().u
        ring = [(u.easting + 50 * math.cos(k * math.pi / 32), u.northing + 50 * math.sin(k * math.pi / 32), u.zone, u.northern) for k in range(64)]
        v = spark.createDataFrame(ring, "e double, n double, z int, s int").select(crs.utm_inverse(F.col("e"), F.col("n"), F.col("z"), F.col("s")).alias("p")).select("p.*").collect()
        want = min(p.lon for p in v), min(p.lat for p in v), max(p.lon for p in v), max(p.lat for p in v)
        assert tuple(got[i].box) == pytest.approx(want, abs=1e-9)
    assert object_centred(df.limit(0), "lon", "lat", 50.0).count() == 0
