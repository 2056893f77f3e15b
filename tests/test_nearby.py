import numpy as np

from terrasieve.operators import nearby as N


def test_positions(spark):
    rows = ["POINT (1 2)", " point ( 181.5   -3 ) ", "SRID=4326;POINT(1 2)", "POINT Z (1 2 99)", '{"type": "Point", "coordinates": [1, 2, 5]}', None, "", "POINT EMPTY", "POINT (nan nan)", "POINT (1e999 0)", "POINT (1 91)", "LINESTRING (1 2, 3 4)", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(rows)), "point_id long, geometry string").withColumnRenamed("point_id", "pid")
    got = sorted(tuple(r) for r in N.positions(df, "pid", "geometry").collect())
    assert got == [(0, 1.0, 2.0), (1, -178.5, -3.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (4, 1.0, 2.0)]


def brute(pts, metres):
    x = N.unit_vectors(pts[:, 1], pts[:, 2])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    i, j = np.nonzero(d <= N.chord(metres))
    return {(int(pts[a, 0]), int(pts[b, 0])) for a, b in zip(i, j) if pts[a, 0] < pts[b, 0]}


def points(n, seed=3):
    rng = np.random.default_rng(seed)
    centre = np.array([[179.9999, -14.0], [10.0, 50.0], [0.0, 89.9999], [10.0, 50.0]])[rng.integers(0, 4, n)]
    xy = centre + rng.normal(0, 2e-4, (n, 2))
    xy[: n // 5] = xy[:1]  # a spot that holds a fifth of all rows
    xy[:, 0] = (xy[:, 0] + 180) % 360 - 180
    return np.column_stack([np.arange(n), xy])


def frame(spark, pts):
    return spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in pts], "id long, lon double, lat double")


def test_near_against_brute_force(spark, monkeypatch):
    pts = points(700)
    df = frame(spark, pts)
    want = brute(pts, 10.0)
    assert {tuple(r) for r in N.near_pairs(df, 10.0).collect()} == want
    monkeypatch.setattr(N, "LEAF_ROWS", 40)
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    got = [tuple(r) for r in N.near_pairs(df, 10.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_and_repeated(spark):
    assert N.near_pairs(frame(spark, points(0)), 10.0).count() == 0
    twice = frame(spark, np.array([[1, 5.0, 5.0], [1, 5.0, 5.0], [2, 5.0, 5.0]]))
    assert {tuple(r) for r in N.near_pairs(twice, 10.0).collect()} == {(1, 2)}


def test_very_many_rows_at_one_spot(spark, monkeypatch):
    """A spot of 200,000 rows is one place; its pairs with others come once, and members name its rows."""
    df = spark.range(200_000).selectExpr("id + 10 as id", "double(5) as lon", "double(5) as lat").unionByName(frame(spark, np.array([[1, 5.00001, 5.0], [2, 5.00002, 5.0], [3, 6.0, 5.0]])))
    spots, members = N.places(df)
    assert spots.count() == 4 and members.count() == 200_000 and members.select("place_id").distinct().count() == 1
    assert {tuple(r) for r in N.near_places(spots, 10.0).collect()} == {(1, 2), (1, 10), (2, 10)}
    pairs = N.with_members(N.near_places(spots, 10.0), "other_place", members, "member")
    assert pairs.count() == 400_001


def test_pairs_are_handed_over_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 7)
    pts = points(300)
    got = [tuple(r) for r in N.near_pairs(frame(spark, pts), 10.0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pts, 10.0)


def test_regions_and_inside(spark, monkeypatch):
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    foot = [
        (1, "i", square, None), (2, "i", None, "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 1, 20 0)), ((22 0, 23 0, 23 1, 22 1, 22 0)))"), (3, "i", "POLYGON EMPTY", "POLYGON EMPTY"), (4, "j", "POLYGON ((0 0, 1 0, 1 1, 0 0))", ""),
        (5, "i", None, "POLYGON ((179.5 0, 180.5 0, 180.5 1, 179.5 1, 179.5 0))"), (6, "i", None, "POLYGON ((nonsense))"), (7, None, None, "POLYGON Z ((40 0 1, 50 0 1, 45 10 1, 40 0 1))"), (1, "i", square, None),
    ]
    chips = spark.createDataFrame([("i", 1.0, 0.0, 100.0, 0.0, -1.0, 50.0), (None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "imageId string, " + ", ".join(f"tr_{c} double" for c in "abcdef"))
    df = spark.createDataFrame(foot, "footprint_id long, ImageId string, PolygonWKT_Pix string, PolygonWKT_Geo string")
    areas = N.regions(df, "footprint_id", "PolygonWKT_Geo", "PolygonWKT_Pix", "ImageId", chips)
    pts = frame(spark, np.array([[1, 101.0, 49.0], [2, 105.0, 45.0], [3, 20.5, 0.5], [4, 22.5, 0.5], [5, 21.5, 0.5], [6, 179.9, 0.5], [7, -179.9, 0.5], [8, -179.4, 0.5], [9, 45.0, 3.0], [10, 0.5, 0.2]]))
    want = {(1, 1), (3, 2), (4, 2), (6, 5), (7, 5), (9, 7)}
    splits = N.fit_splits(pts, 10.0)
    assert {tuple(r) for r in N.inside_pairs(pts, areas, splits).collect()} == want
    monkeypatch.setattr(N, "LEAF_ROWS", 2)
    monkeypatch.setattr(N, "BLOCK_ROWS", 1)
    assert {tuple(r) for r in N.inside_pairs(pts, areas, N.fit_splits(pts, 10.0)).collect()} == want
    assert N.inside_pairs(pts.limit(0), areas, splits).count() == 0 and N.inside_pairs(pts, areas.limit(0), splits).count() == 0


def test_sweep_on_random_polygons():
    rng = np.random.default_rng(5)
    coords, ends = [], []
    for _ in range(40):
        k = rng.integers(3, 12)
        a, r = np.sort(rng.uniform(0, 2 * np.pi, k)), rng.uniform(0.1, 1, k)
        c = rng.uniform(0, 6, 2)
        coords.append(np.column_stack([c[0] + r * np.cos(a), c[1] + r * np.sin(a)]).ravel())
        ends.append(np.array([k]))
    px, py = rng.uniform(-1, 7, 3000), rng.uniform(-1, 7, 3000)
    i, j = N.sweep(px, py, np.arange(40), coords, ends, cells=500)
    want = set()
    for n, c in enumerate(coords):
        p = c.reshape(-1, 2)
        odd = np.zeros(3000, bool)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
            with np.errstate(all="ignore"):
                odd ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        want |= {(int(k), n) for k in np.nonzero(odd)[0]}
    assert set(zip(i.tolist(), j.tolist())) == want
