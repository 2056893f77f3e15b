import json
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from terrasieve.operators import chips as C
from terrasieve.sources import tiff


def test_chips_are_cut_and_written(spark, tmp_path):
    """Four cells over two rasters of 8 pixels side by side, and features that lie in one, two or no cell."""
    a = np.arange(64).reshape(8, 8)
    rasters = spark.createDataFrame([("r0", a.ravel().astype(float).tolist(), 8, 8, 1.0, 0.0, 0.0, 0.0, -1.0, 8.0), ("r1", (a + 100).ravel().astype(float).tolist(), 8, 8, 1.0, 0.0, 8.0, 0.0, -1.0, 8.0), ("r2", None, 8, 8, 1.0, 0.0, 0.0, 0.0, -1.0, 8.0)], "image_id string, data array<double>, width int, height int, " + ", ".join(f"tr_{c} double" for c in "abcdef"))
    cells = spark.createDataFrame([("c0", 0.0, 0.0, 5.0, 5.0), ("c1", 5.0, 0.0, 10.0, 5.0), ("c2", 50.0, 50.0, 55.0, 55.0), ("c3", 7.9, 7.9, 8.1, 8.1)], "chip_name string, l double, b double, r double, t double")
    shapes = [(1, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))"), (2, "POLYGON ((4 1, 6 1, 6 3, 4 3, 4 1))"), (3, "POLYGON ((30 30, 31 30, 31 31, 30 30))"), (4, "POLYGON EMPTY"), (5, None)]
    features = spark.createDataFrame(shapes, "BuildingId int, w string")
    images, vectors = C.write_chips(cells, "chip_name", ["l", "b", "r", "t"], rasters, features, "w", ["BuildingId"], 5.0, str(tmp_path / "out"))
    got = {Path(r.file).stem: Path(r.file).read_bytes() for r in images.collect()}
    assert set(got) == {"c0_r0", "c1_r0", "c1_r1"}
    assert np.array_equal(tiff.pixels(got["c0_r0"])[0], a[3:, :5]) and tiff.metadata(got["c0_r0"])["affine"] == (1.0, 0.0, 0.0, 0.0, -1.0, 5.0)
    assert np.array_equal(tiff.pixels(got["c1_r1"])[0], (a + 100)[3:, :2]) and tiff.metadata(got["c1_r1"])["affine"][2] == 8.0
    found = {(Path(r.file).parent.name, f["properties"]["BuildingId"]): f["properties"] for r in vectors.collect() for f in json.loads(Path(r.file).read_text())["features"]}
    assert set(found) == {("c0", 1), ("c0", 2), ("c1", 2)}
    assert (found["c0", 2]["partialDec"], found["c0", 2]["truncated"], found["c0", 1]["truncated"], found["c0", 1]["origarea"]) == (0.5, 1, 0, 4.0)


def test_names(spark):
    df = spark.createDataFrame([("AOI_1", 3, 1.5, 2.5, "Big Boat"), ("AOI_1", -1, 1.5, 2.5, None)], "aoi string, n int, l double, b double, kind string")
    rows = C.chip_summary(df, F.col("aoi"), F.col("n"), F.col("l"), F.col("b"), ["PAN"], ["roads", "houses"], "/o", "clip_").orderBy(F.desc("n")).collect()
    assert rows[0].chipName == "clip_PAN_AOI_1_img3.tif" and rows[0].geoVectorName == ["/o/geojson/roads/clip_roads_AOI_1_img3.geojson", "/o/geojson/houses/clip_houses_AOI_1_img3.geojson"]
    assert rows[1].chipName == "clip_PAN_AOI_1_1.500000_2.500000.tif" and rows[0].rasterSource == "/o/PAN/clip_PAN_AOI_1_img3.tif"
    one = C.chip_summary(df.limit(1), F.col("aoi"), F.col("n"), F.col("l"), F.col("b"), ["PAN"], [], "/o", label=F.col("kind")).first()
    assert one.chipName == "BigBoat_PAN_AOI_1_img3.tif" and one.rasterSource == "/o/PAN/BigBoat/BigBoat_PAN_AOI_1_img3.tif" and one.geoVectorName == []
