"""Positions near other positions, and regions that hold positions, over k-d partitions of the unit sphere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.wkt import parse_batch, rings_of  # noqa: F401
from terrasieve.session import cut_lineage

EARTH_RADIUS_M = 6_371_008.8
#: Rows of the sample that places the k-d splits (every row is then routed by them), rows aimed
#: at in a leaf, most leaves, and rows on either side of one task's block of a fuller leaf. The
#: leaves of four thousand million places still fit a block each.
SAMPLE_ROWS, LEAF_ROWS, MAX_LEAVES, BLOCK_ROWS = 1 << 19, 4096, 1 << 17, 32768
#: Pairs that a task hands over at a time.
PAIRS_AT_ONCE = 1 << 18

_N = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINT_WKT = rf"(?i)^\s*(?:SRID\s*=\s*\d+\s*;\s*)?POINT\s*(?:ZM|Z|M)?\s*\(\s*({_N})\s+({_N})(?:\s+\S+){{0,2}}\s*\)\s*;?\s*$"
POINT_JSON = rf'(?s)^\s*\{{(?=.*"type"\s*:\s*"Point").*"coordinates"\s*:\s*\[\s*({_N})\s*,\s*({_N})\s*(?:,[^\]]*)?\].*\}}\s*$'


def positions(df: DataFrame, id_col: str, geometry_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lon, lat) and the columns of keep of the rows whose geometry is a point, as WKT (any case, with SRID or height) or GeoJSON.

    lon is brought to [-180, 180). Rows whose geometry is null, empty, of another kind or without
    finite coordinates, or whose latitude is beyond 90 degrees, have no position and don't come out.
    """
    g = F.col(geometry_col)
    pair = F.when(g.rlike(POINT_WKT), F.regexp_replace(g, POINT_WKT, "$1 $2")).when(g.rlike(POINT_JSON), F.regexp_replace(g, POINT_JSON, "$1 $2"))
    xy = df.select(F.col(id_col).alias("id"), *keep, F.split(pair, " ").alias("_p")).where(F.col("_p").isNotNull())
    xy = xy.select("id", *keep, F.col("_p")[0].try_cast("double").alias("_x"), F.col("_p")[1].try_cast("double").alias("lat"))
    good = (F.abs("_x") < float("inf")) & (F.abs("lat") <= 90)
    return xy.where(good).select("id", (F.col("_x") - 360 * F.floor((F.col("_x") + 180) / 360)).alias("lon"), "lat", *keep)


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.column_stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])


def _cos_range(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the cosine over [lo, hi] degrees."""
    a, b = np.cos(np.radians(lo)), np.cos(np.radians(hi))
    top = np.floor(hi / 360) * 360 >= lo
    bottom = np.floor((hi - 180) / 360) * 360 + 180 >= lo
    return np.where(bottom, -1.0, np.minimum(a, b)), np.where(top, 1.0, np.maximum(a, b))


def vector_box(x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in three dimensions of the longitudes x0..x1 at the latitudes y0..y1."""
    c0, c1 = _cos_range(np.clip(y0, -90, 90), np.clip(y1, -90, 90))
    c0 = np.maximum(c0, 0)
    lo, hi = [], []
    for shift in (0, 90):
        a0, a1 = _cos_range(x0 - shift, x1 - shift)
        lo.append(np.minimum(a0 * c0, a0 * c1))
        hi.append(np.maximum(a1 * c0, a1 * c1))
    z0, z1 = np.sin(np.radians(np.clip(y0, -90, 90))), np.sin(np.radians(np.clip(y1, -90, 90)))
    eps = 1e-12
    return np.column_stack([*lo, z0]) - eps, np.column_stack([*hi, z1]) + eps


@dataclass
class Splits:
    """A complete binary tree of k-d splits: node i has children 2i and 2i+1; axis -1: everything goes left."""

    levels: int
    axis: np.ndarray
    at: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, leaves: int, least_width: float) -> Splits:
        levels = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        axis, at = np.full(1 << levels, -1, dtype=np.int8), np.zeros(1 << levels)
        parts = {1: np.arange(len(sample))}
        for node in range(1, 1 << levels):
            rows = parts.pop(node, np.empty(0, dtype=np.int64))
            left, right = rows, rows[:0]
            if len(rows) > 1:
                box = sample[rows]
                width = box.max(0) - box.min(0)
                k = int(width.argmax())
                if width[k] > least_width:
                    axis[node], at[node] = k, np.median(box[:, k])
                    side = box[:, k] <= at[node]
                    left, right = rows[side], rows[~side]
            parts[2 * node], parts[2 * node + 1] = left, right
        return Splits(levels, axis, at)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The one leaf of each point."""
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.levels):
            k = self.axis[node]
            node = 2 * node + ((k >= 0) & (x[np.arange(len(x)), np.maximum(k, 0)] > self.at[node]))
        return node - (1 << self.levels)

    def touched(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves whose region meets the boxes."""
        rows, node = np.arange(len(lo)), np.ones(len(lo), dtype=np.int64)
        for _ in range(self.levels):
            k = self.axis[node]
            j = np.maximum(k, 0)
            left = (k < 0) | (lo[rows, j] <= self.at[node])
            right = (k >= 0) & (hi[rows, j] > self.at[node])
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return rows, node - (1 << self.levels)


class KdTree:
    """A k-d tree in arrays, with buckets of rows and the box of every node."""

    def __init__(self, x: np.ndarray, bucket: int = 48):
        self.x, self.rows = x, np.arange(len(x))
        self.levels = max(0, int(np.ceil(np.log2(max(1, len(x) / bucket)))))
        size = 2 << self.levels
        self.lo, self.hi = np.full((size, 3), np.inf), np.full((size, 3), -np.inf)
        self.span = np.zeros((size, 2), dtype=np.int64)
        self.span[1] = 0, len(x)
        for node in range(1, size):
            a, b = self.span[node]
            if a < b:
                own = x[self.rows[a:b]]
                self.lo[node], self.hi[node] = own.min(0), own.max(0)
            if node < size // 2:
                mid = (a + b) // 2
                if b - a > 1:
                    k = int((self.hi[node] - self.lo[node]).argmax())
                    self.rows[a:b] = self.rows[a:b][np.argpartition(own[:, k], mid - a)]
                self.span[2 * node], self.span[2 * node + 1] = (a, mid), (mid, b)
        self.first_leaf = size // 2

    def pairs(self, other: KdTree, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of self, rows of other) at most radius apart, found by descending both trees."""
        a, b = np.array([1]), np.array([1])
        while len(a):  # level by level over all node pairs at once
            gap = np.maximum(0, np.maximum(self.lo[a] - other.hi[b], other.lo[b] - self.hi[a]))
            near = (np.einsum("ij,ij->i", gap, gap) <= radius * radius)
            a, b = a[near], b[near]
            end_a, end_b = a >= self.first_leaf, b >= other.first_leaf
            for p, q in zip(a[end_a & end_b], b[end_a & end_b]):
                i, j = self.rows[slice(*self.span[p])], other.rows[slice(*other.span[q])]
                d = self.x[i][:, None, :] - other.x[j][None, :, :]
                u, v = np.nonzero(np.einsum("ijk,ijk->ij", d, d) <= radius * radius)
                if len(u):
                    yield i[u], j[v]
            go = ~(end_a & end_b)
            a, b, end_a, end_b = a[go], b[go], end_a[go], end_b[go]
            down_a = ~end_a
            a2 = np.concatenate([2 * a[down_a], 2 * a[down_a] + 1, a[~down_a]])
            b2 = np.concatenate([b[down_a], b[down_a], b[~down_a]])
            down_b = b2 < other.first_leaf
            keep = np.concatenate([end_b[down_a], end_b[down_a], end_b[~down_a]]) == ~down_b
            assert keep.all()
            a = np.concatenate([a2[down_b], a2[down_b], a2[~down_b]])
            b = np.concatenate([2 * b2[down_b], 2 * b2[down_b] + 1, b2[~down_b]])


def chord(metres: float) -> float:
    return 2 * np.sin(min(metres / (2 * EARTH_RADIUS_M), np.pi / 2))


def fit_splits(points: DataFrame, metres: float) -> Splits:
    """Splits fitted to a bounded sample of (id, lon, lat); their number follows the counted rows."""
    n = points.count()
    part = points.select("lon", "lat")
    if n > SAMPLE_ROWS:
        part = part.sample(min(1.0, 0.9 * SAMPLE_ROWS / n), seed=7)
    sample = part.limit(2 * SAMPLE_ROWS).toPandas()
    return Splits.fit(unit_vectors(sample["lon"].to_numpy(float), sample["lat"].to_numpy(float)), min(MAX_LEAVES, -(-n // LEAF_ROWS)), 8 * chord(metres))


def _chunk(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A chunk 0..n-1 of each id."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _blocks(leaf: np.ndarray, ids: np.ndarray, own_parts: np.ndarray, other_parts: np.ndarray, is_query: bool):
    """(row, q, d): a query goes to its chunk q in every d, a data row to its chunk d in every q."""
    mine, others = (own_parts[leaf], other_parts[leaf]) if is_query else (other_parts[leaf], own_parts[leaf])
    row = np.repeat(np.arange(len(leaf)), others)
    across = np.arange(len(row)) - np.repeat(np.cumsum(others) - others, others)
    fixed = _chunk(ids, mine)[row]
    return (row, fixed, across) if is_query else (row, across, fixed)


def _leaf_counts(df: DataFrame, run, leaves: int) -> dict[str, np.ndarray]:
    """Rows of each kind by leaf, counted in the tasks first; at most a row a leaf and kind comes to the driver."""

    def count(batches):
        total = {}
        for batch in batches:
            for kind, leaf in run(batch):
                total[kind] = total.get(kind, 0) + np.bincount(leaf, minlength=leaves)
        for kind, c in total.items():
            at = np.nonzero(c)[0]
            yield pd.DataFrame({"kind": kind, "leaf": at, "n": c[at]})

    out: dict[str, np.ndarray] = {}
    for kind, leaf, n in df.mapInPandas(count, "kind string, leaf long, n long").groupBy("kind", "leaf").agg(F.sum("n")).collect():
        out.setdefault(kind, np.zeros(leaves, dtype=np.int64))[leaf] = n
    return out


def _parts(counts: dict, kind: str, leaves: int) -> np.ndarray:
    return np.maximum(1, -(-counts.get(kind, np.zeros(leaves, dtype=np.int64)) // BLOCK_ROWS))


def places(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, members): one row (id, lon, lat, n) for each position, and (place_id, id) of all rows at positions of several.

    The place's id is the least of its rows'. Counted in the tasks first, so that a spot with a
    third of all rows is one row a task; its members are never gathered.
    """
    spots = points.where(F.col("id").isNotNull()).groupBy("lon", "lat").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    spots = cut_lineage(spots.select("id", "lon", "lat", "n"))
    shared = spots.where(F.col("n") > 1).select(F.col("id").alias("place_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    members = points.join(shared, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat"))).select("place_id", "id")
    return spots, cut_lineage(members.distinct())


def near_places(spots: DataFrame, metres: float, splits: Splits | None = None) -> DataFrame:
    """(place_id, other_place), place_id < other_place, of all places (id, lon, lat) at most metres apart on the sphere.

    Each place is owned by one leaf of the k-d splits and copied to every leaf within the chord
    radius (halo), so that each pair is found once, where its smaller id is owned. Leaves with
    more than BLOCK_ROWS places are worked off in blocks of bounded size, and pairs are handed
    over in pieces. A leaf that can't be split any more is no wider than eight radii, so that
    what its blocks send stays far below what they find. No places give no pairs.
    """
    splits, radius = splits or fit_splits(spots, metres), chord(metres)
    leaves = 1 << splits.levels

    def routed(batch):
        x = unit_vectors(batch["lon"].to_numpy(float), batch["lat"].to_numpy(float))
        row, leaf = splits.touched(x - radius, x + radius)
        return x, splits.own(x), row, leaf

    def kinds(batch):
        _, own, _, leaf = routed(batch)
        yield "own", own
        yield "all", leaf

    counts = _leaf_counts(spots.select("lon", "lat"), kinds, leaves)
    own_parts, all_parts = _parts(counts, "own", leaves), _parts(counts, "all", leaves)

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, own, row, leaf = routed(batch)
            ids = batch["id"].to_numpy(np.int64)
            for is_query, r, place in ((True, np.arange(len(x)), own), (False, row, leaf)):
                k, q, d = _blocks(place, ids[r], own_parts, all_parts, is_query)
                at = r[k]
                yield pd.DataFrame({"leaf": place[k], "q": q, "d": d, "query": is_query, "id": ids[at], "x": x[at, 0], "y": x[at, 1], "z": x[at, 2]})

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        xyz, ids, asks = pdf[["x", "y", "z"]].to_numpy(), pdf["id"].to_numpy(), pdf["query"].to_numpy()
        a, b = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        left, right, size = [], [], 0
        if len(a) and len(b):
            for i, j in KdTree(xyz[a]).pairs(KdTree(xyz[b]), radius):
                p, o = ids[a[i]], ids[b[j]]
                keep = p < o
                left.append(p[keep]), right.append(o[keep])
                size += len(left[-1])
                if size >= PAIRS_AT_ONCE:
                    yield pd.DataFrame({"place_id": np.concatenate(left), "other_place": np.concatenate(right)})
                    left, right, size = [], [], 0
        if size:
            yield pd.DataFrame({"place_id": np.concatenate(left), "other_place": np.concatenate(right)})

    rows = spots.select("id", "lon", "lat").mapInPandas(route, "leaf long, q long, d long, query boolean, id long, x double, y double, z double")
    return rows.groupBy("leaf", "q", "d").applyInPandas(join, "place_id long, other_place long")


def with_members(pairs: DataFrame, place_col: str, members: DataFrame, id_col: str) -> DataFrame:
    """pairs with one row for each member of the place, its id as id_col; places of one row are their own member."""
    m = members.select(F.col("place_id").alias("_place"), F.col("id").alias("_member"))
    rows = pairs.join(m, F.col(place_col) == F.col("_place"), "left")
    return rows.withColumn(id_col, F.coalesce("_member", place_col)).drop("_place", "_member")


def near_pairs(points: DataFrame, metres: float, splits: Splits | None = None, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(point_id, other_id), point_id < other_id, of all positions at most metres apart on the sphere.

    points: (id BIGINT, lon, lat); known: places(points), if they are at hand. Rows at one place
    are all paired, after the places have been: where that is too much, near_places and members
    say the same. An id that occurs twice isn't paired with itself; rows without id take no
    part. An empty table gives an empty result.
    """
    spots, members = known or places(points)
    pairs = with_members(with_members(near_places(spots, metres, splits), "place_id", members, "_a"), "other_place", members, "_b")
    a, b = members.alias("a"), members.alias("b")
    same = a.join(b, (F.col("a.place_id") == F.col("b.place_id")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("point_id"), F.col("b.id").alias("other_id"))
    return pairs.select(F.least("_a", "_b").alias("point_id"), F.greatest("_a", "_b").alias("other_id")).where("point_id < other_id").unionByName(same)


def regions(df: DataFrame, id_col: str, geo_col: str, pix_col: str, image_col: str, chips: DataFrame, chip_image_col: str = "imageId") -> DataFrame:
    """(id, part, coords, ends): the polygons of each row in degrees, one row a part.

    geo_col counts; where it is null, blank or EMPTY, pix_col (column, row) taken to degrees by
    the affine tr_a..tr_f of the row's chip. Texts that are no polygons give no row. coords holds
    x and y in turns, longitudes without a jump at 180 degrees; ends the rings' ends in points. Rows without id take no part.
    """
    df = df.where(F.col(id_col).isNotNull())
    absent = F.col(geo_col).isNull() | F.col(geo_col).rlike(r"(?i)^\s*$|EMPTY\s*$")
    tr = [f"tr_{c}" for c in "abcdef"]
    names = ["id", "wkt", *tr]
    geo = df.where(~absent).select(F.col(id_col).alias("id"), F.col(geo_col).alias("wkt"), *[F.lit(None).cast("double").alias(t) for t in tr])
    pix = df.where(absent & F.col(pix_col).isNotNull() & ~F.col(pix_col).rlike(r"(?i)^\s*$|EMPTY\s*$")).select(F.col(id_col).alias("id"), F.col(pix_col).alias("wkt"), F.col(image_col).alias("_image"))
    pix = pix.join(chips.select(F.col(chip_image_col).alias("_image"), *tr), "_image").select(*names)

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r = parse_batch(batch["wkt"])
            if not len(r.size):
                continue
            first = ~r.hole  # rings that begin a part
            text = np.repeat(r.owner, r.size)
            a, b, c, d, e, f = batch[tr].to_numpy(float)[text].T
            x, y = r.xy.T
            x, y = np.where(np.isnan(a), x, a * x + b * y + c), np.where(np.isnan(a), y, d * x + e * y + f)
            part, begin = np.repeat(np.cumsum(first) - 1, r.size), r.start[first]
            x = x[begin][part] + (x - x[begin][part] + 180) % 360 - 180
            x = x - 360 * np.floor((np.minimum.reduceat(x, begin) + 180) / 360)[part]
            stops = np.cumsum(r.size)
            ring_part = np.cumsum(first) - 1
            ends = np.split(stops - begin[ring_part], np.nonzero(first)[0][1:])
            yield pd.DataFrame({"id": batch["id"].to_numpy()[r.owner[first]], "part": r.part[first], "coords": np.split(np.column_stack([x, y]).ravel(), 2 * begin[1:]), "ends": ends})

    return geo.unionByName(pix).mapInPandas(parse, "id long, part int, coords array<double>, ends array<int>")


def _edges(ids, coords, ends) -> tuple[np.ndarray, ...]:
    """x1, y1, x2, y2, region of all edges, left to right; regions that reach 180 degrees are also taken 360 degrees west."""
    p = np.concatenate([np.asarray(c, dtype=float) for c in coords]).reshape(-1, 2)
    rings = np.array([len(e) for e in ends], dtype=np.int64)
    points = np.array([len(c) // 2 for c in coords], dtype=np.int64)
    owner = np.repeat(np.arange(len(ends)), rings)
    stop = np.concatenate([np.asarray(e, dtype=np.int64) for e in ends]) + (np.cumsum(points) - points)[owner]
    start = np.append(0, stop[:-1])
    follow = np.arange(1, len(p) + 1)
    follow[stop - 1] = start
    region = np.repeat(np.arange(len(points)), points)
    e = np.column_stack([p, p[follow]])
    west = np.maximum.reduceat(p[:, 0], start) >= 180
    again = np.repeat(west, stop - start)
    e, region = np.concatenate([e, e[again] - np.array([360.0, 0, 360.0, 0])]), np.concatenate([region, region[again]])
    swap = e[:, 0] > e[:, 2]
    e[swap] = e[swap][:, [2, 3, 0, 1]]
    keep = e[:, 0] < e[:, 2]  # vertical edges don't count
    e, region = e[keep], region[keep]
    order = np.argsort(e[:, 0], kind="stable")
    e = e[order]
    return e[:, 0], e[:, 1], e[:, 2], e[:, 3], region[order]


def sweep(px: np.ndarray, py: np.ndarray, ids, coords, ends, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(point row, region row) of all points inside regions, by a plane sweep along x.

    Points are passed in order of x in strips; the status holds the edges that cross the strip.
    A point is inside a region if an odd number of its edges at the point's x lie above.
    """
    if not len(px) or not len(ids):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    x1, y1, x2, y2, region = _edges(ids, coords, ends)
    slope = (y2 - y1) / (x2 - x1)
    top, low = np.maximum(y1, y2), np.full(len(ids), np.inf)
    np.minimum.at(low, region, np.minimum(y1, y2))
    high = np.full(len(ids), -np.inf)
    np.maximum.at(high, region, top)
    order = np.argsort(px, kind="stable")
    status, entered, at = np.empty(0, dtype=np.int64), 0, 0
    found_p, found_r = [], []
    while at < len(order):
        strip = order[at : at + 128]
        left, right = px[strip[0]], px[strip[-1]]
        enter = int(np.searchsorted(x1, right, side="right"))
        status = np.concatenate([status, np.arange(entered, enter)])
        status, entered = status[x2[status] > left], enter  # the edges left behind
        y_low, y_high = py[strip].min(), py[strip].max()
        live = status[(high[region[status]] > y_low) & (low[region[status]] < y_high)] if len(strip) > 1 else status
        live = live[np.argsort(region[live], kind="stable")]
        step = max(1, cells // max(1, len(live)))
        for s in range(0, len(strip), step):
            part = strip[s : s + step]
            if not len(live):
                break
            x, y = px[part][:, None], py[part][:, None]
            above = (x1[live] <= x) & (x < x2[live]) & (y1[live] + (x - x1[live]) * slope[live] > y)
            cuts = np.nonzero(np.diff(region[live], prepend=-1))[0]
            odd = np.add.reduceat(above, cuts, axis=1, dtype=np.int32) % 2 == 1
            i, j = np.nonzero(odd)
            found_p.append(part[i]), found_r.append(region[live][cuts][j])
        at += 128
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *found_p]), np.concatenate([none, *found_r])


def inside_pairs(points: DataFrame, areas: DataFrame, splits: Splits) -> DataFrame:
    """(point_id, other_id) of all positions in the interior of a region of areas (from regions()).

    Regions are copied to every leaf that their bounds touch; each position has one leaf. Leaves
    fuller than BLOCK_ROWS of either are worked off in blocks. A position in several parts of one
    region comes out once; in several regions, with each of them.
    """
    leaves = 1 << splits.levels

    def own(batch):
        return splits.own(unit_vectors(batch["lon"].to_numpy(float), batch["lat"].to_numpy(float)))

    def touched(batch):
        box = np.array([(c[::2].min(), c[1::2].min(), c[::2].max(), c[1::2].max()) for c in map(np.asarray, batch["coords"])], dtype=float).reshape(-1, 4)
        return splits.touched(*vector_box(*box.T))

    def weighed(batch):  # a region counts as a row for every four of its edges
        row, leaf = touched(batch)
        size = np.array([1 + len(c) // 8 for c in batch["coords"]], dtype=np.int64)
        return [("a", np.repeat(leaf, size[row]))]

    p_parts = _parts(_leaf_counts(points, lambda b: [("p", own(b))], leaves), "p", leaves)
    a_parts = _parts(_leaf_counts(areas, weighed, leaves), "a", leaves)

    def route_points(batches):
        for batch in batches:
            leaf, ids = own(batch), batch["id"].to_numpy(np.int64)
            k, q, d = _blocks(leaf, ids, p_parts, a_parts, True)
            yield pd.DataFrame({"leaf": leaf[k], "q": q, "d": d, "id": ids[k], "lon": batch["lon"].to_numpy(float)[k], "lat": batch["lat"].to_numpy(float)[k]})

    def route_areas(batches):
        for batch in batches:
            row, leaf = touched(batch)
            ids = batch["id"].to_numpy(np.int64)
            k, q, d = _blocks(leaf, ids[row], p_parts, a_parts, False)
            at = row[k]
            yield pd.DataFrame({"leaf": leaf[k], "q": q, "d": d, "id": ids[at], "coords": batch["coords"].to_numpy()[at], "ends": batch["ends"].to_numpy()[at]})

    def join(p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        ids = a["id"].to_numpy(np.int64)
        i, j = sweep(p["lon"].to_numpy(float), p["lat"].to_numpy(float), ids, a["coords"].to_numpy(), a["ends"].to_numpy())
        return pd.DataFrame({"point_id": p["id"].to_numpy(np.int64)[i], "other_id": ids[j]}).drop_duplicates()

    key = "leaf long, q long, d long, id long"
    left = points.where(F.col("id").isNotNull()).mapInPandas(route_points, f"{key}, lon double, lat double").groupBy("leaf", "q", "d")
    right = areas.where(F.col("id").isNotNull()).mapInPandas(route_areas, f"{key}, coords array<double>, ends array<int>").groupBy("leaf", "q", "d")
    return left.cogroup(right).applyInPandas(join, "point_id long, other_id long")
