"""Scoring of proposed against true footprints: candidates, IoU, one-to-one greedy matching, scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.operators.chips import box_join, ordered_index
from terrasieve.operators.components import components
from terrasieve.functions.wkt import parse_batch
from terrasieve.session import cut_lineage

#: Digits to which IoU is rounded, so that equal polygons tie whatever the order of summation.
IOU_DIGITS = 9
#: Width of a grid cell in pixels; candidate sets up to this size let later pairs be dropped early;
#: pairs of an image up to which it is folded as a whole.
CELL, MOST_SHARED, FOLD_PAIRS = 128.0, 32, 200_000


def edge_lists(wkts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x1, y1, x2, y2, sign of all polygons' non-vertical edges, left to right, and each polygon's number of rows.

    sign: +1 for edges with the interior below, -1 with it above, so that sums of sign times the
    integral under the edges are areas; holes count against their exterior.
    """
    r = parse_batch(wkts)
    if not len(r.size):
        return np.empty((0, 5)), np.zeros(r.texts, dtype=np.int64)
    start, ring, hole = r.start, np.repeat(np.arange(len(r.size)), r.size), r.hole
    p = r.xy
    q, origin = p[r.follow()], p[start][ring]
    u, v = p - origin, q - origin
    turn = np.sign(np.add.reduceat(u[:, 0] * v[:, 1] - v[:, 0] * u[:, 1], start)) * np.where(hole, -1.0, 1.0)
    back = q[:, 0] < p[:, 0]
    a, b = np.where(back[:, None], q, p), np.where(back[:, None], p, q)
    keep = a[:, 0] < b[:, 0]
    sign = np.where(back, 1.0, -1.0) * turn[ring]
    return np.column_stack([a, b, sign])[keep], np.bincount(r.owner[ring[keep]], minlength=r.texts)


def signed_edges(wkt: str) -> np.ndarray:
    """edge_lists of one polygon."""
    return edge_lists([wkt])[0]


def polygon_table(df: DataFrame, id_col: str, image_col: str, wkt_col: str, keep: bool = False) -> DataFrame:
    """(id, image_id, area, xmin, ymin, xmax, ymax, edges) of each row, and wkt with keep; without polygon: area 0, null box, no edges."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            e, n = edge_lists(batch["wkt"])
            some, at = n > 0, np.cumsum(n) - n
            columns = {"area": np.zeros(len(n)), **{c: np.full(len(n), np.nan) for c in ("xmin", "ymin", "xmax", "ymax")}}
            if some.any():
                over = lambda f, values: f.reduceat(values, at[some])
                columns["area"][some] = over(np.add, e[:, 4] * (e[:, 2] - e[:, 0]) * (e[:, 1] + e[:, 3]) / 2)
                columns["xmin"][some], columns["xmax"][some] = over(np.minimum, e[:, 0]), over(np.maximum, e[:, 2])
                columns["ymin"][some], columns["ymax"][some] = over(np.minimum, np.minimum(e[:, 1], e[:, 3])), over(np.maximum, np.maximum(e[:, 1], e[:, 3]))
            edges = [None if not k else e[i : i + k].ravel() for i, k in zip(at, n)]
            out = pd.DataFrame({"id": batch["id"], "image_id": batch["image_id"], **columns, "edges": pd.Series(edges, index=batch.index, dtype=object)})
            if keep:
                out["wkt"] = batch["wkt"]
            yield out.astype({c: "Float64" for c in ("xmin", "ymin", "xmax", "ymax")})

    rows = df.select(F.col(id_col).alias("id"), F.col(image_col).alias("image_id"), F.col(wkt_col).alias("wkt"))
    return rows.mapInPandas(run, "id long, image_id string, area double, xmin double, ymin double, xmax double, ymax double, edges array<double>" + ", wkt string" * keep)


def overlap_area(first: Iterable, second: Iterable) -> np.ndarray:
    """Exact area of the intersection of each pair of edge lists: sum of signs times the integral of the lower edge."""
    first, second = [np.asarray(x, dtype=float).reshape(-1, 5) for x in first], [np.asarray(x, dtype=float).reshape(-1, 5) for x in second]
    n, m = np.array([len(x) for x in first], dtype=np.int64), np.array([len(x) for x in second], dtype=np.int64)
    if not len(n) or not (n * m).sum():
        return np.zeros(len(n))
    pair = np.repeat(np.arange(len(n)), n * m)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    a = np.concatenate(first)[np.repeat(np.cumsum(n) - n, n * m) + k // m[pair]]
    b = np.concatenate(second)[np.repeat(np.cumsum(m) - m, n * m) + k % m[pair]]
    left, right = np.maximum(a[:, 0], b[:, 0]), np.minimum(a[:, 2], b[:, 2])
    on = left < right
    pair, a, b, left, right = pair[on], a[on], b[on], left[on], right[on]
    at = lambda e, x: e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    fl, fr, gl, gr = at(a, left), at(a, right), at(b, left), at(b, right)
    u, v, w = fl - gl, fr - gr, right - left
    low = (np.minimum(fl, gl) + np.minimum(fr, gr)) / 2 * w
    cross = u * v < 0
    t = np.where(cross, u / np.where(cross, u - v, 1.0), 0.0)
    mid = fl + t * (fr - fl)
    split = (np.minimum(fl, gl) + mid) / 2 * t * w + (mid + np.minimum(fr, gr)) / 2 * (1 - t) * w
    return np.bincount(pair, a[:, 4] * b[:, 4] * np.where(cross, split, low), minlength=len(n))


def clip_area(first: Column, second: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(overlap_area(a, b))

    return run(first, second)


def candidates(proposals: DataFrame, truths: DataFrame) -> DataFrame:
    """(image_id, pid, tid, iou) of all pairs of one image whose closed boxes touch; both are polygon_tables.

    Joined on the image and on grid cells, so that an image with very many rows is spread over its
    cells and its rows aren't all compared with each other.
    """
    names = ["area", "xmin", "ymin", "xmax", "ymax", "edges"]
    p = proposals.select("image_id", F.col("id").alias("pid"), *[F.col(n).alias(f"p_{n}") for n in names])
    t = truths.select(F.col("image_id").alias("_image"), F.col("id").alias("tid"), *[F.col(n).alias(f"t_{n}") for n in names])
    pairs = box_join(p, t, [f"p_{n}" for n in names[1:5]], [f"t_{n}" for n in names[1:5]], CELL, ("image_id", "_image"))
    inter = pairs.select("image_id", "pid", "tid", (F.col("p_area") + F.col("t_area")).alias("_sum"), clip_area(F.col("p_edges"), F.col("t_edges")).alias("_both"))
    iou = F.coalesce(F.try_divide("_both", F.col("_sum") - F.col("_both")), F.lit(0.0))
    return inter.select("image_id", "pid", "tid", F.bround(F.greatest(iou, F.lit(0.0)), IOU_DIGITS).alias("iou"))


def greedy_match(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, pid, tid, iou): proposals in order of pid each take the free truth of highest IoU.

    Only IoU at or above threshold counts; ties go to the lower tid. Once k proposals with the same
    k candidates have had their turn, all these truths are certainly taken, so that later pairs
    with them are dropped beforehand; what is left for the sequential fold of an image is a few
    pairs a truth, also in an image that holds a third of all proposals. Images of very many pairs
    are folded by groups of linked truths (overlap_groups), which don't affect each other.
    """
    strong = pairs.where(F.col("iou") >= threshold)
    sets = strong.groupBy("image_id", "pid").agg(F.array_sort(F.collect_set("tid")).alias("_set"))
    turn = F.row_number().over(Window.partitionBy("image_id", "_set").orderBy("pid"))
    spent = sets.withColumn("_turn", turn).where(F.col("_turn") <= MOST_SHARED).where(F.col("_turn") == F.size("_set"))
    last = spent.select("image_id", F.explode("_set").alias("tid"), "pid").groupBy("image_id", "tid").agg(F.min("pid").alias("_last"))
    left = strong.join(last, ["image_id", "tid"], "left").where(F.col("_last").isNull() | (F.col("pid") <= F.col("_last"))).select("image_id", "pid", "tid", "iou")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "iou", "tid"], ascending=[True, False, True], kind="stable")
        taken, served, keep = set(), set(), []
        for k, (p, t) in enumerate(zip(pdf["pid"], pdf["tid"])):
            if p not in served and t not in taken:
                served.add(p)
                taken.add(t)
                keep.append(k)
        return pdf.iloc[keep][["image_id", "pid", "tid", "iou"]]

    left = cut_lineage(left)
    return overlap_groups(left).groupBy("image_id", "_group").applyInPandas(fold, left.schema)


def overlap_groups(pairs: DataFrame) -> DataFrame:
    """pairs plus _group, so that no proposal or truth of an image lies in two groups and no group is needlessly large.

    An image of up to FOLD_PAIRS pairs is one group. In a larger one a group is a set of truths
    that proposals link (a component).
    """
    large = pairs.groupBy("image_id").agg(F.count("*").alias("_n")).where(F.col("_n") > FOLD_PAIRS).select("image_id")
    if large.isEmpty():
        return pairs.withColumn("_group", F.lit(0).cast("long"))
    within = cut_lineage(pairs.join(large.withColumn("_large", F.lit(True)), "image_id", "left"))
    hot = within.where("_large")
    hub = hot.groupBy("image_id", "pid").agg(F.min("tid").alias("a"))
    links = hub.join(hot.select("image_id", "pid", F.col("tid").alias("b")), ["image_id", "pid"])
    label = components(hot.select("image_id", F.col("tid").alias("node")), links, "image_id").select("image_id", F.col("node").alias("tid"), F.col("group").alias("_group"))
    rows = within.join(label, ["image_id", "tid"], "left")
    return rows.select("image_id", "pid", "tid", "iou", F.coalesce("_group", F.lit(0).cast("long")).alias("_group"))


def closest_match(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, pid, tid, iou) by the other reading of the rule: each truth's closest proposal, a proposal serving one truth.

    Ties go to the lower pid and tid. A truth whose closest proposal is closer to another truth stays unmatched.
    """
    strong = pairs.where(F.col("iou") >= threshold)
    of_truth = Window.partitionBy("image_id", "tid").orderBy(F.desc("iou"), "pid")
    of_proposal = Window.partitionBy("image_id", "pid").orderBy(F.desc("iou"), "tid")
    rows = strong.withColumn("_k", F.row_number().over(of_truth)).where("_k = 1")
    return rows.withColumn("_k", F.row_number().over(of_proposal)).where("_k = 1").drop("_k")


def scored_features(proposals: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, pid, tid, building_pos, iou, is_match) for every proposal with a polygon.

    Matches carry the truth's id and its 0-based place in the image; other proposals tid null,
    building_pos -1 and their best IoU with a truth that was free at their turn (0 without one).
    """
    pairs = cut_lineage(candidates(proposals, truths))
    matches = cut_lineage(greedy_match(pairs, threshold))
    taken = matches.select("image_id", "tid", F.col("pid").alias("_by"))
    free = pairs.join(taken, ["image_id", "tid"], "left").where(F.col("_by").isNull() | (F.col("_by") >= F.col("pid")))
    best = free.groupBy("image_id", "pid").agg(F.max("iou").alias("_best"))
    numbered = ordered_index(truths.where("xmin is not null").select("image_id", F.col("id").alias("tid")), [F.col("image_id"), F.col("tid")], "_n")
    place = numbered.join(numbered.groupBy("image_id").agg(F.min("_n").alias("_first")), "image_id").select("image_id", "tid", (F.col("_n") - F.col("_first")).cast("int").alias("_pos"))
    hit = matches.join(place, ["image_id", "tid"]).select("image_id", "pid", "tid", "_pos", "iou")
    rows = proposals.where("xmin is not null").select("image_id", F.col("id").alias("pid")).join(hit, ["image_id", "pid"], "left").join(best, ["image_id", "pid"], "left")
    return rows.select("image_id", "pid", "tid", F.coalesce("_pos", F.lit(-1)).alias("building_pos"), F.coalesce("iou", "_best", F.lit(0.0)).alias("iou"), F.col("tid").isNotNull().alias("is_match"))


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def image_scores(proposals: DataFrame, truths: DataFrame, matches: DataFrame) -> DataFrame:
    """(image_id, f1, tp, fp, fn) of every image with a true polygon or a proposal row.

    proposals: polygon_table of all rows, placeholders with null box included: these still make
    their image appear. truths: polygon_table of the true footprints that survived the filters.
    """
    n = lambda d, name: d.groupBy("image_id").agg(F.count("xmin").alias(name))
    both = n(proposals, "_p").join(n(truths.where("xmin is not null"), "_t"), "image_id", "full_outer").join(matches.groupBy("image_id").agg(F.count("*").alias("_m")), "image_id", "left")
    tp = F.coalesce("_m", F.lit(0))
    rows = both.where(F.col("image_id").isNotNull()).select("image_id", tp.alias("tp"), (F.coalesce("_p", F.lit(0)) - tp).alias("fp"), (F.coalesce("_t", F.lit(0)) - tp).alias("fn"))
    return rows.select("image_id", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "tp", "fp", "fn")


def area_scores(scores: DataFrame, names: list[str]) -> DataFrame:
    """(aoi, f1, precision, recall, tp, fp, fn) for each name and 'Total'; images belong to names their id contains."""
    spark = scores.sparkSession
    areas = spark.createDataFrame([(n,) for n in [*names, "Total"]], "aoi string")
    lit = F.array(*[F.struct(F.lit(n).alias("aoi")) for n in [*names, "Total"]])
    mine = scores.select(F.explode(F.filter(lit, lambda a: (a["aoi"] == "Total") | F.contains(F.col("image_id"), a["aoi"]))).alias("_a"), "tp", "fp", "fn").select("_a.aoi", "tp", "fp", "fn")
    sums = areas.join(mine.groupBy("aoi").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), "aoi", "left")
    sums = sums.select("aoi", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return sums.select("aoi", f1(tp, fp, fn).alias("f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), "tp", "fp", "fn")
