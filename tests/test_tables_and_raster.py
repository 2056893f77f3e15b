import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import chips as C
from terrasieve.operators import labels as L
from terrasieve.operators import raster as X
from terrasieve.operators import tables as T
from terrasieve.sources import geojson as G


def test_distance_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < rng.random()
        got = X.distance_to(m)
        y, x = np.nonzero(m)
        for i in range(m.shape[0]):
            for j in range(m.shape[1]):
                want = np.sqrt(((y - i) ** 2 + (x - j) ** 2).min()) if len(y) else np.inf
                assert got[i, j] == pytest.approx(want)


def test_polygons_cover_their_pixels():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.integers(0, 3, (6, 7)).astype(float)
        area = 0.0
        for value, rings in X.regions_of(t):
            shoe = [abs(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1])) / 2 for p in rings]
            area += shoe[0] - sum(shoe[1:])
            assert value != 0
        assert area == (t != 0).sum()


def test_resample():
    t = np.arange(16.0).reshape(4, 4)
    assert np.array_equal(X.resample(t, 1.0), t)
    assert X.resample(t, 2.0).shape == (8, 8) and X.resample(t, 0.5).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_box_join_mixes_sizes(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 500.0, 500.0), (3, None, None, None, None), (4, 3.0, 3.0, 3.0, 3.0)], "a long, ax double, ay double, bx double, by double")
    b = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, -5.0, -5.0, 900.0, 900.0), (3, 450.0, 450.0, 451.0, 451.0), (4, 3.0, 3.0, 4.0, 4.0)], "b long, cx double, cy double, dx double, dy double")
    got = [(r.a, r.b) for r in C.box_join(a, b, ["ax", "ay", "bx", "by"], ["cx", "cy", "dx", "dy"], 1.0).collect()]
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (4, 2), (4, 4)]


def test_ordered_index_and_split(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r.n for r in C.ordered_index(df.repartition(7), [F.col("k")], "n").orderBy("k").collect()] == list(range(1000))
    s = C.split_rows(df, "k", [("train", 0.6), ("test", 0.2), ("val", 0.2)])
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 600, "test": 200, "val": 200}
    assert C.split_rows(df, "k", [("a", 0.5), ("b", 0.5)], drop_boundary=True).count() == 999
    with pytest.raises(ValueError):
        C.pair_by_position(df, df.limit(3), "k", "k")


def test_describe_of_one_and_none(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0), ("c", 2.0), ("c", 4.0), ("c", 8.0)], "k string, v double")
    r = {x.k: x for x in T.describe(df, "k", {"v": "v"}).collect()}
    assert (r["a"].v_std, r["a"].v_p50, r["b"].v_count, r["b"].v_mean) == (None, 2.0, 0, None)
    assert (r["c"].v_p25, r["c"].v_p50, r["c"].v_p75) == (1.75, 3.0, 5.0)


def test_sources_and_sinks(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    rows = [("/x/img_1.geojson", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"BuildingId": i}, "geometry": shape} for i in (-1, 5, None)]})), ("/x/e.geojson", ""), ("/x/n.geojson", None)]
    df = spark.createDataFrame(rows, "path string, body string")
    f = G.chip_features(df, "body", "path", [])
    assert [(r.ImageId, r.BuildingId) for r in f.orderBy("BuildingId").collect()] == [("img_1", 1), ("img_1", 2), ("img_1", 3)]
    own = G.features(df, "body", []).withColumn("BuildingId", F.get_json_object("properties", "$.BuildingId").cast("int"))
    assert G.without_placeholders(own).count() == 2
    G.write_geojson(own, str(tmp_path / "g"), "coordinates", "kind", ["BuildingId"])
    again = G.features(G.read_files(spark, str(tmp_path / "g" / "*")), "body", [])
    assert again.count() == 3 and again.first().kind == "Polygon"
    (tmp_path / "t.csv").write_text('ImageId,PolygonWKT,PolygonWKT_Geo\na,"POLYGON ((0 0, 1 0, 1 1, 0 0))",POLYGON EMPTY\n')
    assert G.read_wkt_csv(spark, str(tmp_path / "t.csv")).first().geometry == []
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        G.read_wkt_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "l.csv").write_text("# c\n\n /r/a.tif , Pan \n/r/b.tif,MUL\n")
    assert [tuple(r) for r in G.read_list_csv(spark, str(tmp_path / "l.csv")).orderBy("path").collect()] == [("/r/a.tif", "Pan"), ("/r/b.tif", "MUL")]
    (tmp_path / "r.csv").write_text("x\ny\nh1,h2\n1,2\n3,4\n")
    assert G.read_after_lines(spark, str(tmp_path / "r.csv"), 2, "a int, b int").count() == 2
    with pytest.raises(ValueError):
        G.load_tile_index(spark, str(tmp_path), "AOI_9")


def test_osm(spark):
    body = json.dumps({"elements": [{"type": "node", "id": n, "lon": n, "lat": 0.0, "tags": {"id": "tag"}} for n in (1, 2, 3)] + [{"type": "way", "id": 9, "nodes": [3, 1, 2, 3]}, {"type": "way", "id": 8, "nodes": [2, 1, 77]}]})
    nodes, ways = G.read_osm(spark.createDataFrame([(body,)], "b string"), "b")
    assert nodes.first().properties["id"] == "tag"
    got = {r.id: (r.kind, [p.node_id for p in r.line]) for r in G.way_geometries(ways, nodes).collect()}
    assert got == {9: ("Polygon", [3, 1, 2, 3]), 8: ("LineString", [2, 1])}


def test_summaries(spark, tmp_path):
    chips = spark.createDataFrame([("a",), ("b",)], "imageId string")
    foot = spark.createDataFrame([("a", 1, "P", None), ("b", -1, "x", "x")], "ImageId string, BuildingId int, PolygonWKT_Pix string, PolygonWKT_Geo string")
    assert sorted(tuple(r) for r in L.summary_rows(chips, foot).collect()) == [("a", 1, "P", "POLYGON EMPTY"), ("b", -1, "POLYGON EMPTY", "POLYGON EMPTY")]
    lines = spark.createDataFrame([("a", [(0.005, 1.0), (2.0, 3.0)])], "ImageId string, line array<struct<x:double,y:double>>")
    assert sorted(r.WKT_Pix for r in L.road_rows(chips, lines).collect()) == ["LINESTRING (0.00 1.00, 2.00 3.00)", "LineString EMPTY"]
    L.write_summary(chips, foot, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2


def test_grid_across_180_degrees(spark, tmp_path):
    import __spark_entry__ as entry

    got = {}
    for name, origin in (("across", 179.994), ("beside", 79.994)):
        lefts = [origin + k * 0.0035 for k in range(5)]
        rows = [(f"i{k}", "A", 650, 650, 0.0000027, 0.0, x - 360 if x >= 180 else x, 0.0, -0.0000027, 12.0 + k * 0.002) for k, x in enumerate(lefts)]
        columns = "imageId string, aoi string, width int, height int, tr_a double, tr_b double, tr_c double, tr_d double, tr_e double, tr_f double"
        for turned in (0, 1):  # whichever side the first chip lies on
            ids = [(f"i{(4 - k) if turned else k}", *r[1:]) for k, r in enumerate(rows)]
            spark.createDataFrame(ids, columns).write.parquet(f"{tmp_path}/{name}{turned}/chips.parquet")
            got[name, turned] = sorted(map(tuple, entry.queries()["l9_grid_chips"](spark, f"{tmp_path}/{name}{turned}").collect()))
    assert len(got["beside", 0]) > 3 and len({tuple(v) for v in got.values()}) == 1


def test_burnt_on_the_chips_own_pixels(spark, tmp_path):
    import __spark_entry__ as entry

    wkt = [
        (1, "a", 5, "POLYGON ((1 1, 4 1, 4 3, 1 3, 1 1))"), (2, "a", 6, "POLYGON ((3 2, 6 2, 6 4, 3 4, 3 2))"), (3, "a", 7, "POLYGON ((380 380, 400 380, 400 400, 380 400, 380 380))"),
        (4, "b", 8, "MULTIPOLYGON (((60 60, 69 60, 69 69, 60 69, 60 60), (62 62, 67 62, 67 67, 62 67, 62 62)), ((-3 0, 2 0, 2 1, -3 1, -3 0)))"), (5, "none", 9, "POLYGON ((1 1, 4 1, 4 3, 1 3, 1 1))"),
    ]
    spark.createDataFrame(wkt, "footprint_id long, ImageId string, BuildingId int, PolygonWKT_Pix string").write.parquet(f"{tmp_path}/footprints.parquet")
    spark.createDataFrame([("a", 390, 390), ("b", 650, 650)], "imageId string, width int, height int").write.parquet(f"{tmp_path}/chips.parquet")
    got = {(r.image, r.row, r.col): r.value for r in entry.queries()["r4_rasterize"](spark, str(tmp_path)).collect()}
    want = {("a", r, c): 5 for r in (1, 2) for c in (1, 2, 3)} | {("a", r, c): 6 for r in (2, 3) for c in (3, 4, 5)} | {("a", r, c): 7 for r in range(380, 390) for c in range(380, 390)}
    want |= {("b", r, c): 8 for r in range(60, 69) for c in range(60, 69) if not (62 <= r < 67 and 62 <= c < 67)} | {("b", 0, c): 8 for c in (0, 1)}
    assert got == want


def test_pieces_of_names(spark):
    df = spark.createDataFrame([("/srv/RGB_AOI_1_x-img12.tif",), ("a",), ("__",), ("",), (None,)], "n string")
    got = [r[0] for r in df.select(T.name_pieces(F.col("n"))).collect()]
    assert {"AOI_1_x-img12", "img12", "RGB_AOI_1_x-img12.tif", "srv/RGB", "1", "tif"} <= set(got[0]) and "img1" not in got[0] and len(got[0]) == len(set(got[0])) == 28
    assert got[1:] == [["a"], [], [], None]
