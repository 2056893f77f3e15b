import random
import struct
import zlib

import numpy as np
import pytest

from terrasieve.operators import overlay as O
from terrasieve.operators.nearby import rings_of
from tests.test_geom import HOLED, MULTI, star


def area(*wkts):
    return O.trapezoid_area(O.union_trapezoids([rings for w in wkts for rings in rings_of(w)]))


def test_union_against_the_topology_suite(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(9)
    for _ in range(40):
        shapes = [w for w in (star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(4)) if reader.read(w).isValid()]
        if shapes:
            want = reader.read(shapes[0])
            for w in shapes[1:]:
                want = want.union(reader.read(w))
            assert area(*shapes) == pytest.approx(want.getArea(), abs=1e-9)
    assert area(HOLED) == 96 and area(HOLED, HOLED) == 96 and area(MULTI) == 5
    assert area("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))") == 2  # crosses itself
    assert area("") == 0 and O.trapezoid_wkt(O.union_trapezoids([])) == "POLYGON EMPTY"


def test_buffer_against_the_topology_suite(spark):
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    line = np.array([[0.0, 0.0], [10.0, 0.0], [14.0, 6.0], [3.0, 9.0]])
    want = reader.read("LINESTRING (" + ", ".join(f"{x} {y}" for x, y in line) + ")").buffer(2.0, 16).getArea()
    assert O.trapezoid_area(O.union_trapezoids(O.segment_capsules(line, 2.0, 16))) == pytest.approx(want, rel=2e-3)
    df = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0)], 2.0), (2, [(0.0, 0.0)], 1.0), (3, None, 1.0)], "k int, l array<struct<x:double,y:double>>, f double")
    got = {r.k: r.area for r in O.buffer_lines(df, "k", "l", 0.5, 1, "f").collect()}
    assert got == {1: pytest.approx(4 * 2 + 2), 2: 0.0, 3: 0.0}


def test_dissolve_over_cells(spark):
    rows = [("a", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 1, 1), ("a", "POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))", 2, 0), ("a", None, 3, 9), ("b", MULTI, 4, 2), (None, HOLED, 5, 3), (None, HOLED, 6, 4)]
    df = spark.createDataFrame(rows, "k string, w string, v int, o int")
    for cell in (3.0, 7.0, 100.0):
        got = {}
        for r in O.dissolve(df, "k", "w", cell, ["v"], "o").collect():
            got[r.k] = got.get(r.k, 0) + r.area
            assert area(r.wkt) == pytest.approx(r.area)
        assert got == {"a": pytest.approx(175), "b": pytest.approx(5), None: pytest.approx(96)}


def tiff(a, deflate=False):
    """A small little-endian GeoTIFF of (rows, cols, bands) uint16."""
    raw = a.astype("<u2").tobytes()
    raw = zlib.compress(raw) if deflate else raw
    scale, tie = struct.pack("<3d", 0.5, 0.25, 0), struct.pack("<6d", 0, 0, 0, 100.0, 50.0, 0)
    fields = [(256, 3, 1, a.shape[1]), (257, 3, 1, a.shape[0]), (258, 3, 1, 16), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, None), (277, 3, 1, a.shape[2]), (279, 4, 1, len(raw)), (33550, 12, 3, "s"), (33922, 12, 6, "t")]
    start = 8 + 2 + 12 * len(fields) + 4
    where = {"s": start, "t": start + 24, None: start + 72}
    body = b"".join(struct.pack("<HHII", t, k, n, where.get(v, v) if not isinstance(v, int) else v) for t, k, n, v in fields)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + body + b"\0\0\0\0" + scale + tie + raw


def test_tiff(spark, tmp_path):
    from terrasieve.sources import tiff as R

    a = np.arange(24).reshape(3, 4, 2)
    for deflate in (False, True):
        assert np.array_equal(R.pixels(tiff(a, deflate)), np.moveaxis(a, 2, 0))
    (tmp_path / "x.tif").write_bytes(tiff(a))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    got = {r.image_id: r for r in R.read_rasters(spark, str(tmp_path)).collect()}
    assert (got["x"].width, got["x"].height, got["x"].bands, got["x"].tr_a, got["x"].tr_c, got["x"].tr_e, got["x"].tr_f) == (4, 3, 2, 0.5, 100.0, -0.25, 50.0)
    assert got["bad"].error
    (tmp_path / "bad.tif").unlink()
    tiles = R.read_tiles(spark, str(tmp_path), 3).collect()
    assert len(tiles) == 4 and sum(len(t.data) for t in tiles) == 24


def test_sql_functions(spark):
    from terrasieve.functions.register import register

    r = register(spark).sql("select st_area('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))') as a, st_iou('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))', 'POLYGON ((1 0, 3 0, 3 2, 1 2, 1 0))') as i, st_area(null) as n, st_repaired_area('POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))') as r").first()
    assert (r.a, round(r.i, 9), r.n, r.r) == (4.0, round(1 / 3, 9), None, 2.0)
    assert spark.sql("select * from tile_regions(array(1, 1, 0, 2), 2)").count() == 2


def test_buffers_of_all_rings(spark, tmp_path):
    import __spark_entry__ as entry

    ring = lambda x, y, n: f"({x} {y}, {x + n} {y}, {x + n} {y + n}, {x} {y + n}, {x} {y})"
    wkt = {1: f"POLYGON ({ring(0, 0, 100)})", 2: f"POLYGON ({ring(0, 0, 100)}, {ring(30, 30, 20)})", 3: f"MULTIPOLYGON (({ring(0, 0, 100)}), ({ring(200, 0, 20)}))"}
    spark.createDataFrame([(k, "i", 1, w) for k, w in wkt.items()], "footprint_id long, ImageId string, BuildingId int, PolygonWKT_Pix string").write.parquet(f"{tmp_path}/footprints.parquet")
    got = {r.footprint_id: r.area for r in entry.queries()["a19_line_buffers"](spark, str(tmp_path)).collect()}
    square = lambda n: 4 * n * 4 - 4 * 4 + 4 * 2  # strips of width 4 share their corners' squares inside; the ends reach out as triangles
    assert got == {1: pytest.approx(square(100)), 2: pytest.approx(square(100) + square(20)), 3: pytest.approx(square(100) + square(20))}
