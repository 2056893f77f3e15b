import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from terrasieve.operators.compaction import consolidate, first_fit_decreasing, list_folder

T = dt.datetime(2020, 1, 1)


def first_fit(sizes, capacity):
    free, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = min(sizes[i], capacity)
        k = next((k for k, f in enumerate(free) if f >= s), None)
        if k is None:
            k = len(free)
            free.append(capacity)
        free[k] -= s
        out[i] = k
    return [out[i] for i in range(len(sizes))]


@given(st.lists(st.integers(0, 120), max_size=60))
def test_first_fit_decreasing(sizes):
    assert first_fit_decreasing(np.array(sizes, dtype=np.int64), 100).tolist() == first_fit(sizes, 100)


def body(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": "Point", "coordinates": [n, 0]}} for n, p in enumerate(features)]})


def folder(spark, rows, **kw):
    df = spark.createDataFrame(rows, "file_id long, geoVectorName string, imageId string, written_at timestamp, body string, bin string")
    return consolidate(df, **kw)


def test_each_record_once_in_its_latest_version(spark):
    rows = [
        (1, "a", "A", T, body({"BuildingId": 1}, {"ImageId": "B", "BuildingId": 2, "v": "old"}), "x"), (2, "b", "A", T + dt.timedelta(1), body({"ImageId": "B", "BuildingId": 2, "v": "new"}), "x"),
        (3, "a", "A", T, body({"BuildingId": 1}, {"ImageId": "B", "BuildingId": 2, "v": "old"}), "x"), (4, "c", "C", None, "", "x"), (5, "d", "D", T, None, "x"), (6, "e", "E", T, "{broken", "x"),
        (None, "f", "F", T, body({"BuildingId": 9}), "x"), (None, "f", "F", T, body({"BuildingId": 9}), "x"), (8, "g", None, T, body({"note": "no key"}, {"note": "no key"}), "x"), (9, "h", "H", T, body(), "x"),
    ]
    path = folder(spark, rows, target_bytes=400)
    got = spark.read.parquet(path + "/data").collect()
    keys = sorted(((r.ImageId, r.BuildingId) for r in got), key=repr)
    assert keys == sorted([("A", 1), ("B", 2), ("F", 9), (None, None), (None, None)], key=repr)
    assert next(json.loads(r.properties)["v"] for r in got if r.ImageId == "B") == "new"
    assert spark.read.parquet(path + "/_manifest").count() >= 9


def sizes(path):
    import glob
    import os

    return sorted(map(os.path.getsize, glob.glob(path.removeprefix("file:").replace("//", "/") + "/data/*.parquet")))


def test_files_come_out_at_the_target_size(spark):
    """By the size of what is written: compressed, and without what later versions replace."""
    df = spark.range(60_000).selectExpr(
        "id as file_id", "concat('n', id) as geoVectorName", "concat('I', pmod(id, 20000)) as imageId", "timestamp_seconds(id) as written_at",
        """concat('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"BuildingId": 1, "v": "', sha2(string(id), 256), '"}, "geometry": {"type": "Point", "coordinates": [1, ', id, ']}}]}') as body""",
    )
    path = consolidate(df, target_bytes=150_000)
    found, note = sizes(path), json.loads(Path(path.removeprefix("file:").replace("//", "/"), "_COMMIT.json").read_text())
    assert spark.read.parquet(path + "/data").count() == 20_000
    assert note["files"] == len(found) == note["bins"] > 5 and note["median_bytes"] == found[len(found) // 2]
    assert all(0.7 * 150_000 < x < 1.3 * 150_000 for x in found[1:])


def test_an_existing_folder_is_refused_and_files_of_a_folder_are_listed(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for i in range(30):
        (tmp_path / "in" / ("sub" if i % 2 else ".") / f"chip{i}.geojson").write_text(body({"BuildingId": i}))
    (tmp_path / "in" / "note.txt").write_text("no file of ours")
    listed = list_folder(spark, str(tmp_path / "in"))
    out = consolidate(listed, out=f"{tmp_path}/out")
    assert {(r.ImageId, r.BuildingId) for r in spark.read.parquet(f"{out}/data").collect()} == {(f"chip{i}", i) for i in range(30)} and len(sizes(out)) == 1
    with pytest.raises(FileExistsError):
        consolidate(listed, out=f"{tmp_path}/out")
    assert spark.read.parquet(f"{out}/_manifest").count() == 30 and not (tmp_path / "out" / "out-staging").exists()


def test_empty(spark):
    rows = [(i, f"n{i}", f"I{i}", T, body({"BuildingId": i}), "x") for i in range(300)]
    path = folder(spark, rows)
    assert len(sizes(path)) == 1 and spark.read.parquet(path + "/data").select("ImageId", "BuildingId").distinct().count() == 300
    assert spark.read.parquet(folder(spark, []) + "/data").count() == 0
