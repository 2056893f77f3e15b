import math
import random

import numpy as np
import pytest

from terrasieve.functions.wkt import rings_of
from terrasieve.operators.clip import clip_line, clip_polygon, cut_features, line_text, polygon_text

BOX = ["left", "bottom", "right", "top"]


def star(rng, n, cx=0.0, cy=0.0, size=1.0):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    p = [(cx + size * r * math.cos(t), cy + size * r * math.sin(t)) for t, r in ((t, rng.uniform(0.3, 1)) for t in a)]
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*p, p[0]]) + ")"


def rectangle(b):
    return f"POLYGON (({b[0]} {b[1]}, {b[2]} {b[1]}, {b[2]} {b[3]}, {b[0]} {b[3]}, {b[0]} {b[1]}))"


def test_against_the_topology_suite(spark):
    """Concave polygons with holes and parts, cut to random boxes: equal area, valid, and the same points."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(7)
    seen = 0
    for _ in range(250):
        hole = ", (0.05 0.05, 0.05 -0.05, -0.05 -0.05, -0.05 0.05, 0.05 0.05)" if rng.random() < 0.5 else ""
        body = f"({star(rng, rng.randint(5, 25))}{hole})"
        text = f"POLYGON {body}" if rng.random() < 0.7 else f"MULTIPOLYGON ({body}, ({star(rng, 6, 5, 5)}))"
        x, y = sorted(rng.uniform(-1, 1) for _ in range(2)), sorted(rng.uniform(-1, 1) for _ in range(2))
        box = x[0], y[0], x[1], y[1]
        whole = reader.read(text)
        if not whole.isValid():
            continue
        want = whole.intersection(reader.read(rectangle(box)))
        got = reader.read(polygon_text(clip_polygon(rings_of(text), box)))
        seen += 1
        assert got.isValid(), text
        assert got.getArea() == pytest.approx(want.getArea(), abs=1e-9)
        assert got.symDifference(want).getArea() == pytest.approx(0, abs=1e-9)
        assert got.getNumGeometries() == want.getNumGeometries() or want.getArea() == 0
    assert seen > 200


def test_edges_on_the_box():
    box = (0.0, 0.0, 10.0, 10.0)
    area = lambda parts: sum(abs(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)) / 2) * (1 if i == 0 else -1) for rings in parts for i, p in enumerate(rings))
    same = clip_polygon(rings_of(rectangle(box)), box)
    assert area(same) == 100 and len(same) == 1
    assert clip_polygon(rings_of(rectangle((10, 0, 20, 10))), box) == []  # touches along an edge
    assert area(clip_polygon(rings_of(rectangle((-5, -5, 15, 15))), box)) == 100
    comb = "POLYGON ((-1 1, 12 1, 12 2, 5 2, 5 3, 12 3, 12 4, 5 4, 5 5, 12 5, 12 6, -1 6, -1 1))"
    assert area(clip_polygon(rings_of(comb), (6.0, 0.0, 10.0, 10.0))) == 12 and len(clip_polygon(rings_of(comb), (6.0, 0.0, 10.0, 10.0))) == 3
    holed = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    assert [len(p) for p in clip_polygon(rings_of(holed), (1.0, 1.0, 9.0, 9.0))] == [2] and area(clip_polygon(rings_of(holed), (5.0, 0.0, 9.0, 10.0))) == 40 - 2


def test_lines():
    box = (0.0, 0.0, 10.0, 10.0)
    line = lambda *p: line_text(*clip_line(np.array(p, dtype=float), box))
    assert line((-5, 5), (15, 5)) == ("LineString", "LINESTRING (0.0 5.0, 10.0 5.0)")
    assert line((-5, 5), (5, 5), (5, 20), (7, 20), (7, 5)) == ("MultiLineString", "MULTILINESTRING ((0.0 5.0, 5.0 5.0, 5.0 10.0), (7.0 10.0, 7.0 5.0))")
    assert line((-5, 5), (5, 15)) == ("Point", "POINT (0.0 10.0)") and line((20, 20), (30, 30)) == ("LineString", "LINESTRING EMPTY")
    assert line((-5, 5), (5, 15), (15, 5), (5, 5))[0] == "GeometryCollection"
    assert line((0, 0), (10, 0)) == ("LineString", "LINESTRING (0.0 0.0, 10.0 0.0)")


def test_operator(spark):
    rows = [
        (1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 2.0, 0.0, 10.0, 10.0, None, "x"), (2, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 0.0, 0.0, 10.0, 10.0, 32.0, "x"), (3, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 3.9, 0.0, 10.0, 10.0, None, "x"),
        (4, "POLYGON EMPTY", 0.0, 0.0, 1.0, 1.0, None, "x"), (5, None, 0.0, 0.0, 1.0, 1.0, None, "x"), (6, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", None, 0.0, 1.0, 1.0, None, "x"), (7, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 20.0, 0.0, 30.0, 1.0, None, "x"), (8, "LINESTRING (0 0, 4 0)", 0.0, 0.0, 1.0, 1.0, None, "x"),
    ]
    df = spark.createDataFrame(rows, "id int, geometry string, left double, bottom double, right double, top double, area double, kind string").selectExpr("*", "2.0d tr_a", "0.0d tr_b", "100.0d tr_c", "0.0d tr_d", "-2.0d tr_e", "50.0d tr_f")
    got = {r.id: r for r in cut_features(df, "geometry", BOX, least_share=0.1, orig_area="area", transform=[f"tr_{c}" for c in "abcdef"]).collect()}
    assert set(got) == {1, 2} and (got[1].partialDec, got[1].truncated, got[1].origarea, got[1].origlen, got[1].kind) == (0.5, 1, 16.0, 0.0, "Polygon")
    assert (got[2].partialDec, got[2].truncated, got[2].origarea) == (0.5, 1, 32.0)
    assert rings_of(got[2].pix_geometry)[0][0].min(0).tolist() == [-50.0, 23.0]
    lines = cut_features(df, "geometry", BOX, "LineString").collect()
    assert [(r.id, r.geometry, r.origlen, r.partialDec, r.truncated) for r in lines] == [(8, "LINESTRING (0.0 0.0, 1.0 0.0)", 4.0, 1.0, 0)]
    assert cut_features(df.limit(0), "geometry", BOX).count() == 0
    with pytest.raises(ValueError):
        cut_features(df, "geometry", BOX, "Point")
