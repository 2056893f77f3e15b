import json
from collections import deque
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve.operators import matching as M
from terrasieve.operators import raster as X
from terrasieve.sources import files, geojson, reports, tiff


def test_grouped_documents(spark, tmp_path):
    df = spark.range(2000).selectExpr("if(id < 1500, 'hot', if(id < 1501, null, concat('a/ b', id % 3))) as k", "id", "'[0, 0]' as c", "'Point' as kind", "9 as bytes")
    listed = geojson.write_geojson(df, f"{tmp_path}/g", "c", "kind", ["id"], "k").collect()
    assert sum(r.n_rows for r in listed) == 2000 and all(Path(r.file).stat().st_size == r.bytes for r in listed)
    ids = []
    for r in listed:
        own = [f["properties"]["id"] for f in json.loads(Path(r.file).read_text())["features"]]
        assert own == sorted(own) and len(own) == r.n_rows
        ids += own
    assert sorted(ids) == list(range(2000))
    assert {Path(r.file).parent.name for r in listed} == {"hot", "null", "a~2F~20b0", "a~2F~20b1", "a~2F~20b2"}
    assert geojson.write_geojson(df.limit(0), f"{tmp_path}/e", "c", "kind", ["id"]).count() == 0
    assert not [p for p in tmp_path.rglob(".*") if ".geojson." in p.name]


def test_copies(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}.bin").write_bytes(b"x" * i * 1_000_000)
    rows = [(f"{tmp_path}/f{i}.bin", "train" if i % 2 else "test") for i in range(5)] + [(f"{tmp_path}/none.bin", "test"), (None, "test")]
    got = files.copy_files(spark.createDataFrame(rows, "p string, s string"), "p", "s", f"{tmp_path}/out").collect()
    assert sorted(r.bytes for r in got if r.error is None) == [i * 1_000_000 for i in range(5)] and len([r for r in got if r.error]) == 2
    assert sorted(p.name for p in (tmp_path / "out" / "train").iterdir()) == ["f1.bin", "f3.bin"]


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "u4", "i4", "f4", "f8"])
@pytest.mark.parametrize("tile", [None, 16, 64])
def test_rasters_round_trip(dtype, tile):
    rng = np.random.default_rng(1)
    for shape in ((1, 1, 1), (3, 70, 33), (2, 64, 16), (4, 5, 130)):
        a = (rng.random(shape) * 200).astype(dtype)
        for compress in (False, True):
            data = tiff.encode(a, (0.5, 0.0, 100.0, 0.0, -0.25, 50.0), compress, tile)
            assert np.array_equal(tiff.pixels(data), a)
            m = tiff.metadata(data)
            assert (m["width"], m["height"], m["bands"], m["dtype"], m["affine"]) == (shape[2], shape[1], shape[0], dtype, (0.5, 0.0, 100.0, 0.0, -0.25, 50.0))
    with pytest.raises(ValueError):
        tiff.encode(np.zeros((2, 2)), ())


@pytest.mark.parametrize("kind", ["LZW", "PackBits", "Deflate", "ZLib"])
def test_rasters_of_another_writer(spark, tmp_path, kind):
    """Images that Java's own writer compresses, among them LZW with tables that fill up."""
    jvm, size = spark._jvm, 150
    rng = np.random.default_rng(2)
    a = np.where(rng.random((size, size)) < 0.5, rng.integers(0, 256, (size, size)), 7).astype("u1")
    image = jvm.java.awt.image.BufferedImage(size, size, 10)  # TYPE_BYTE_GRAY
    image.getRaster().setDataElements(0, 0, size, size, bytearray(a.tobytes()))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionType(kind)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(f"{tmp_path}/x.tif"))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    assert np.array_equal(tiff.pixels((tmp_path / "x.tif").read_bytes())[0], a)


def test_unreadable_rasters_come_out_with_their_error(spark, tmp_path):
    (tmp_path / "good.tif").write_bytes(tiff.encode(np.arange(12, dtype="u1").reshape(1, 3, 4)))
    (tmp_path / "bad.tif").write_bytes(b"II*\0nothing")
    (tmp_path / "cut.tif").write_bytes(tiff.encode(np.arange(12, dtype="u1").reshape(1, 3, 4))[:30])
    got = tiff.read_tiles(spark, str(tmp_path), 2).collect()
    assert {r.image_id for r in got if r.error} == {"bad", "cut"} and sorted(sum((list(r.data) for r in got if r.error is None), [])) == list(range(12))
    df = spark.createDataFrame([("a", [1.0, 2.0, 300.0, -4.0], 2, 9), ("b", None, 2, 9), ("c", [], 2, 9)], "i string, d array<double>, w int, bytes int")
    assert tiff.write_rasters(df, "i", "d", "w", None, None, f"{tmp_path}/w").count() == 1
    assert tiff.pixels((tmp_path / "w" / "a.tif").read_bytes()).tolist() == [[[1, 2], [255, 0]]]
    tiff.write_arrays(df, "i", "d", "w", f"{tmp_path}/n")
    assert np.load(tmp_path / "n" / "a.npy").tolist() == [[1.0, 2.0], [300.0, -4.0]]


def test_reports(spark, tmp_path, capsys):
    scores = spark.createDataFrame([("AOI_1_x", 0.5, 1, 1, 1), ("AOI_2_x", 0.0, 0, 2, 0)], "image_id string, f1 double, tp long, fp long, fn long")
    report = M.area_scores(scores, ["AOI_1"])
    reports.write_report(report, scores, str(tmp_path / "r"), "truth.csv", "found.csv")
    text = (tmp_path / "r" / "areas.csv").read_text().splitlines()
    assert text[:5] == ["TruthFile,truth.csv", "ProposalFile,found.csv", "AOI_Name,AOI_1", "Summary Results", "F1Score Total,0.5"] and len(text) == 22
    assert spark.read.csv(str(tmp_path / "r" / "chips"), header=True).columns == ["ImageId", "F1Score", "True Positive Count", "False Positive Count", "False Negative Count"]
    assert reports.print_report(report) in capsys.readouterr().out


def test_united_frames(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(2, 5)], "id int, lanes int")
    assert sorted(tuple(r) for r in geojson.united({"rail": a, "road": b}).select("infrastructure", "id", "name", "lanes").collect()) == [("rail", 1, "x", None), ("road", 2, None, 5)]


def test_lines_before_the_header_of_files_in_several_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("\n".join(["note, with comma"] * 5 + ["a,b"] + [f"{k},{i}" for i in range(4000)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = geojson.read_after_lines(spark, str(tmp_path), 5, "a int, b int")
        assert got.count() == 12_000 and got.distinct().count() == 12_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def brute_labels(tile):
    out, n = np.full(tile.shape, -1), 0
    for r, c in np.ndindex(tile.shape):
        if out[r, c] < 0:
            todo = deque([(r, c)])
            out[r, c] = n
            while todo:
                y, x = todo.popleft()
                for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= v < tile.shape[0] and 0 <= u < tile.shape[1] and out[v, u] < 0 and tile[v, u] == tile[y, x]:
                        out[v, u] = n
                        todo.append((v, u))
            n += 1
    return out


def test_labels_and_distances_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        shape = tuple(rng.integers(1, 14, 2))
        tile = rng.integers(0, rng.integers(1, 4), shape)
        a, b = X.labels_of(tile), brute_labels(tile)
        assert len({*zip(a.ravel().tolist(), b.ravel().tolist())}) == len(np.unique(a)) == len(np.unique(b))
        mask = rng.random(shape) < rng.random()
        y, x = np.nonzero(mask)
        want = np.array([[np.sqrt(((y - r) ** 2 + (x - c) ** 2).min()) if len(y) else np.inf for c in range(shape[1])] for r in range(shape[0])])
        assert np.allclose(X.distance_to(mask), want)
    spiral = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]])
    assert len(np.unique(X.labels_of(spiral))) == 2
    assert len(X.regions_of(np.random.default_rng(1).integers(0, 2, (300, 300)).astype(float))) > 1000


def test_percentiles_over_tiles(spark):
    rng = np.random.default_rng(6)
    tiles = [("hot" if i % 3 else None, (rng.integers(0, 50, 9) * 1.0).tolist(), i) for i in range(60)] + [("hot", [None, float("nan"), 3.0], 61), ("none", None, 62), ("void", [], 63)]
    df = spark.createDataFrame(tiles, "img string, t array<double>, image int")
    got = {r.image: (r.a, r.b) for r in X.tile_percentiles(df, "img", "t", {"a": 0.25, "b": 0.98}).collect()}
    for k in ("hot", None):
        v = [x for i, t, _ in tiles if i == k and t for x in t if x is not None and x == x]
        assert got[k] == pytest.approx((np.percentile(v, 25), np.percentile(v, 98)))
    assert set(got) == {"hot", None}
    out = {r.image: r.t for r in X.stretch_8bit(df, "img", "t").collect()}
    assert len(out) == len(tiles) and max(v for v in out[1]) <= 255 and out[61][0] is None and out[62] is None
    assert X.normalise(df, "img", "t").columns == df.columns and X.normalise(df, "img", "t", most=10.0).where("image = 61").first().t == [None, 1.0, 0.3]
    assert X.tile_percentiles(df.limit(0), "img", "t", {"a": 0.5}).count() == 0


def test_regions_of_whole_rasters(spark):
    """Tiles of 8 pixels against the raster in one piece: the same areas, and outlines that hold them; a spiral crosses every border often."""
    from terrasieve.functions import geom

    rng = np.random.default_rng(8)
    spiral = np.zeros((24, 24))
    for k in range(0, 12, 2):
        spiral[k, k : 24 - k] = spiral[23 - k, k : 24 - k] = 1
        spiral[k : 24 - k, 23 - k] = spiral[k + 2 : 24 - k, k] = 1
        if k:
            spiral[k, k - 1] = 1
    rasters = {"noise": rng.integers(0, 3, (24, 24)).astype(float), "spiral": spiral, "flat": np.full((24, 24), 5.0), "none": np.zeros((24, 24))}
    rows = [(name, r // 8, c // 8, a[r : r + 8, c : c + 8].ravel().tolist(), 3) for name, a in rasters.items() for r in range(0, 24, 8) for c in range(0, 24, 8)] + [("flat", 9, 9, None, 3)]
    df = spark.createDataFrame(rows, "img string, y int, x int, t array<double>, region int")
    out = X.polygonize_tiles(df, "img", "y", "x", "t", 8).withColumn("outlined", geom.area(geom.parse_wkt(F.col("wkt")))).collect()
    for name, a in rasters.items():
        whole = sorted((v, sum(abs(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1])) / 2 * (1 if i == 0 else -1) for i, p in enumerate(rings))) for v, rings in X.regions_of(a))
        assert sorted((r.value, float(r.area)) for r in out if r.image == name) == whole
    assert all(r.outlined == r.area for r in out) and not any(r.image == "none" for r in out)
    assert X.polygonize_tiles(df.limit(0), "img", "y", "x", "t", 8).count() == 0
