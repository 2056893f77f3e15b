import random

from pyspark.sql import functions as F

from terrasieve.operators import matching as M


def box(x, y, w, h):
    return f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"


def table(spark, rows):
    return M.polygon_table(spark.createDataFrame(rows, "i long, image string, w string"), "i", "image", "w")


def iou(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w / (a[2] * a[3] + b[2] * b[3] - w)


def serial(props, truths, least):
    """The sequential rule, one image: (match or None, best free IoU) by proposal."""
    free, out = dict(truths), {}
    for p in sorted(props):
        scores = sorted(((-round(iou(props[p], b), 9), t) for t, b in free.items()))
        best = scores[0] if scores else (0.0, None)
        if -best[0] >= least:
            out[p] = (best[1], -best[0])
            del free[best[1]]
        else:
            out[p] = (None, -best[0])
    return out


def test_greedy_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    want, p_rows, t_rows, k = {}, [], [], 0
    for image in "abcdef":
        truths, props = {}, {}
        for _ in range(rng.randint(0, 8)):
            k += 1
            truths[k] = (rng.randint(0, 30), rng.randint(0, 30), rng.randint(8, 14), rng.randint(8, 14))
        for _ in range(rng.randint(0, 60)):
            k += 1
            base = rng.choice([*truths.values(), (0, 0, 10, 10)])
            props[k] = (base[0] + rng.randint(-3, 3), base[1] + rng.randint(-3, 3), base[2], base[3])
        p_rows += [(i, image, box(*b)) for i, b in props.items()]
        t_rows += [(i, image, box(*b)) for i, b in truths.items()]
        for p, (t, s) in serial(props, truths, 0.3).items():
            want[p] = (t, round(s, 6))
    got = M.scored_features(table(spark, p_rows), table(spark, t_rows), 0.3).collect()
    assert {r.pid: (r.tid, round(r.iou, 6)) for r in got} == want
    assert all((r.building_pos == -1) == (r.tid is None) for r in got)


def test_large_images_are_folded_by_linked_truths(spark, monkeypatch):
    """Chains, loose groups and an image that stays small, by the sequential rule; one group holds few of the truths."""
    rng = random.Random(9)
    want, p_rows, t_rows, k = {}, [], [], 0
    for image, n, span in (("chain", 60, 1), ("loose", 60, 40), ("small", 3, 5)):
        truths, props = {}, {}
        for i in range(n):
            k += 1
            truths[k] = (i * 6 * span, 0, 10, 10)
        for _ in range(5 * n):
            k += 1
            base = rng.choice([*truths.values()])
            props[k] = (base[0] + rng.randint(-4, 4), base[1] + rng.randint(-1, 1), 10, 10)
        p_rows += [(i, image, box(*b)) for i, b in props.items()]
        t_rows += [(i, image, box(*b)) for i, b in truths.items()]
        for p, (t, s) in serial(props, truths, 0.1).items():
            if t is not None:
                want[p] = (t, round(s, 6))
    pairs = M.candidates(table(spark, p_rows), table(spark, t_rows)).where("iou >= 0.1").cache()
    monkeypatch.setattr(M, "FOLD_PAIRS", 50)
    groups = {(r.image_id, r._group) for r in M.overlap_groups(pairs).collect()}
    assert sum(i == "loose" for i, _ in groups) > 30 and sum(i == "small" for i, _ in groups) == 1 and sum(i == "chain" for i, _ in groups) == 1
    assert {r.pid: (r.tid, round(r.iou, 6)) for r in M.greedy_match(pairs, 0.1).collect()} == want


def test_scores_cover_all_kinds_of_images(spark):
    props = table(spark, [(1, "both", box(0, 0, 10, 10)), (2, "both", box(0, 0, 10, 10)), (3, "only_p", box(0, 0, 1, 1)), (4, "placeholder", "POLYGON EMPTY"), (5, None, None)])
    truths = table(spark, [(1, "both", box(0, 0, 10, 10)), (2, "only_t", box(0, 0, 10, 10)), (3, "touch", box(0, 0, 1, 1))])
    matches = M.greedy_match(M.candidates(props, truths))
    got = {r.image_id: (r.f1, r.tp, r.fp, r.fn) for r in M.image_scores(props, truths, matches).collect()}
    assert got == {"both": (2 / 3, 1, 1, 0), "only_p": (0.0, 0, 1, 0), "placeholder": (0.0, 0, 0, 0), "only_t": (0.0, 0, 0, 1), "touch": (0.0, 0, 0, 1)}
    report = {r.aoi: r for r in M.area_scores(M.image_scores(props, truths, matches), ["only", "none"]).collect()}
    assert (report["only"].fp, report["only"].fn, report["none"].tp, report["Total"].tp) == (1, 2 - 1, 0, 1)
    assert M.greedy_match(M.candidates(props.limit(0), truths)).count() == 0


def test_touching_boxes_are_candidates_with_iou_0(spark):
    pairs = M.candidates(table(spark, [(1, "a", box(0, 0, 1, 1))]), table(spark, [(1, "a", box(1, 0, 1, 1)), (2, "a", box(0, 0, 1, 1)), (3, "b", box(0, 0, 1, 1))]))
    assert {(r.tid, r.iou) for r in pairs.collect()} == {(1, 0.0), (2, 1.0)}


def test_match_is_distinct(spark):
    p = spark.range(500).select("id", F.lit("hot").alias("image"), F.lit(box(0, 0, 10, 10)).alias("w"))
    rows = M.greedy_match(M.candidates(M.polygon_table(p, "id", "image", "w"), table(spark, [(7, "hot", box(0, 0, 10, 10)), (9, "hot", box(0, 0, 10, 10))])))
    assert sorted((r.pid, r.tid) for r in rows.collect()) == [(0, 7), (1, 9)]


def test_repeated_truths_leave_little_to_the_fold(spark):
    """Every proposal fits all of three equal truths: after three turns they are taken, and no later pair is kept."""
    p = spark.range(3000).select("id", F.lit("hot").alias("image"), F.lit(box(0, 0, 10, 10)).alias("w"))
    t = table(spark, [(k, "hot", box(0, 0, 10, 10)) for k in (5, 6, 7)])
    rows = M.greedy_match(M.candidates(M.polygon_table(p, "id", "image", "w"), t)).collect()
    assert sorted((r.pid, r.tid) for r in rows) == [(0, 5), (1, 6), (2, 7)]


def test_the_other_reading(spark):
    pairs = spark.createDataFrame([("a", 1, 10, 0.6), ("a", 2, 10, 0.9), ("a", 2, 11, 0.7), ("a", 3, 11, 0.6), ("a", 4, 12, 0.4)], "image_id string, pid long, tid long, iou double")
    assert sorted((r.pid, r.tid) for r in M.closest_match(pairs).collect()) == [(2, 10)]
