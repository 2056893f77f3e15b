"""Detection scoring over proposals and footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions import geom
from terrasieve.operators import matching as M
from terrasieve.plans.registry import Registry, overlap_sql, vertices_sql
from terrasieve.session import cut_lineage, temporary_folder, read_spread
from terrasieve.sources import geojson as G
from terrasieve.sources import reports as S

query = Registry()

#: Least true area in square pixels (strict), IoU that counts as a match (inclusive), areas reported on.
LEAST_AREA, THRESHOLD = 20.0, 0.5
AREAS = ["AOI_1_Solvane", "AOI_2_Kerrimoor", "AOI_3_Tashivo", "AOI_4_Nordhavel", "AOI_5_Quellamar", "AOI_6_Nowhere"]

_PAIRS = f"""
WITH RECURSIVE {vertices_sql("p", "proposals", "proposal_id", "ImageId", "PolygonWKT_Pix", "BuildingId IS DISTINCT FROM -1")},
{vertices_sql("t", "footprints", "footprint_id", "ImageId", "PolygonWKT_Pix", "BuildingId IS DISTINCT FROM -1")},
tb AS (SELECT * FROM t_b WHERE area > {LEAST_AREA}),
touching AS (SELECT p.image, p.id AS pid, t.id AS tid, p.area + t.area AS total FROM p_b p JOIN tb t ON p.image = t.image
  AND p.xmin <= t.xmax AND t.xmin <= p.xmax AND p.ymin <= t.ymax AND t.ymin <= p.ymax),
both_areas AS ({overlap_sql("touching", "p_e", "t_e")}),
pairs AS (SELECT image, pid, tid, round_even(greatest(coalesce(shared / nullif(total - shared, 0), 0), 0), 9) AS iou FROM touching LEFT JOIN both_areas USING (pid, tid))"""

_MATCHES = f"""{_PAIRS},
strong AS (SELECT * FROM pairs WHERE iou >= {THRESHOLD}),
turns AS (SELECT image, pid, row_number() OVER (PARTITION BY image ORDER BY pid) AS step FROM (SELECT DISTINCT image, pid FROM strong)),
wanted AS (SELECT image, step, pid, list(tid ORDER BY iou DESC, tid) AS cands FROM strong JOIN turns USING (image, pid) GROUP BY ALL),
fold(image, step, used, pid, tid) AS (
  SELECT DISTINCT image, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM wanted
  UNION ALL
  SELECT image, step, CASE WHEN tid IS NULL THEN used ELSE list_append(used, tid) END, pid, tid FROM (
    SELECT w.image, w.step, f.used, w.pid, list_filter(w.cands, lambda c: NOT list_contains(f.used, c))[1] AS tid
    FROM fold f JOIN wanted w ON w.image = f.image AND w.step = f.step + 1)),
matches AS (SELECT image, pid, tid, iou FROM fold JOIN pairs USING (image, pid, tid) WHERE tid IS NOT NULL)"""

_SCORES = f"""{_MATCHES},
ids AS (SELECT DISTINCT image FROM tb UNION SELECT DISTINCT ImageId FROM proposals WHERE ImageId IS NOT NULL),
counts AS (SELECT image, (SELECT count(*) FROM matches m WHERE m.image = ids.image) AS tp, (SELECT count(*) FROM p_b p WHERE p.image = ids.image) AS np,
  (SELECT count(*) FROM tb t WHERE t.image = ids.image) AS nt FROM ids),
scores AS (SELECT image AS image_id, tp, np - tp AS fp, nt - tp AS fn FROM counts)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """polygon_tables of the proposals (placeholders with null box) and of the true footprints."""
    real = ~F.col("BuildingId").eqNullSafe(-1)
    shape = F.when(real, F.col("PolygonWKT_Pix")).alias("wkt")
    p = M.polygon_table(read_spread(spark, sf_dir, "proposals").select("proposal_id", "ImageId", shape), "proposal_id", "ImageId", "wkt")
    t = M.polygon_table(read_spread(spark, sf_dir, "footprints").where(real), "footprint_id", "ImageId", "PolygonWKT_Pix")
    return p, t.where(F.col("area") > LEAST_AREA)


@query(f"{_PAIRS} SELECT image AS image_id, pid, tid, round(iou, 6) AS iou FROM pairs")
def m0_candidate_iou(spark, sf_dir):
    """Pairs of one image whose boxes touch, with IoU."""
    p, t = _tables(spark, sf_dir)
    return M.candidates(p, t).withColumn("iou", F.round("iou", 6))


@query(f"""{_MATCHES},
taken AS (SELECT image, tid, pid AS taken_by FROM matches),
free AS (SELECT p.pid, max(p.iou) AS best FROM pairs p LEFT JOIN taken USING (image, tid) WHERE taken_by IS NULL OR taken_by >= p.pid GROUP BY p.pid),
pos AS (SELECT id AS tid, row_number() OVER (PARTITION BY image ORDER BY id) - 1 AS building_pos FROM tb)
SELECT p.image AS image_id, p.id AS pid, m.tid, CAST(coalesce(building_pos, -1) AS INTEGER) AS building_pos, round(coalesce(m.iou, best, 0), 6) AS iou, m.tid IS NOT NULL AS is_match
FROM p_b p LEFT JOIN matches m ON m.pid = p.id LEFT JOIN free f ON f.pid = p.id LEFT JOIN pos ON pos.tid = m.tid""")
def m1_greedy_scored(spark, sf_dir):
    """M1, W7, AG8, O3, F11, SNK2: each proposal's match or its best free IoU."""
    p, t = _tables(spark, sf_dir)
    return M.scored_features(cut_lineage(p), cut_lineage(t), THRESHOLD).withColumn("iou", F.round("iou", 6))


def _scores(spark, sf_dir) -> DataFrame:
    p, t = map(cut_lineage, _tables(spark, sf_dir))
    return M.image_scores(p, t, M.greedy_match(M.candidates(p, t), THRESHOLD))


@query(f"{_SCORES} SELECT image_id, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp, fp, fn FROM scores")
def m2_image_scores(spark, sf_dir):
    """M2, M3, AG1, AG11, J1, J12, SNK11: counts and F1 of every image."""
    return _scores(spark, sf_dir).withColumn("f1", F.round("f1", 6))


@query(f"""{_SCORES},
areas AS (SELECT unnest({[*AREAS, "Total"]!r}) AS aoi),
sums AS (SELECT aoi, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn
  FROM areas LEFT JOIN scores ON aoi = 'Total' OR contains(image_id, aoi) GROUP BY aoi)
SELECT aoi, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, tp, fp, fn FROM sums""")
def m4_aoi_report(spark, sf_dir):
    """M4, AG2, F8, SNK10, SNK12: micro-averaged scores of each area and in total."""
    report = M.area_scores(_scores(spark, sf_dir), AREAS)
    return report.select("aoi", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")], "tp", "fp", "fn")


@query(f"""{_MATCHES},
taken AS (SELECT image, tid, pid AS taken_by FROM matches),
free AS (SELECT p.pid, max(p.iou) AS best FROM pairs p LEFT JOIN taken USING (image, tid) WHERE taken_by IS NULL OR taken_by >= p.pid GROUP BY p.pid),
pos AS (SELECT id AS tid, row_number() OVER (PARTITION BY image ORDER BY id) - 1 AS building_pos FROM tb)
SELECT p.image AS "ImageId", CAST(coalesce(building_pos, -1) AS INTEGER) AS "BuildingId", round(coalesce(m.iou, best, 0), 5) AS "IOUScore", count(*) AS n
FROM p_b p LEFT JOIN matches m ON m.pid = p.id LEFT JOIN free f ON f.pid = p.id LEFT JOIN pos ON pos.tid = m.tid GROUP BY ALL""")
def snk2_scored_geojson(spark, sf_dir):
    """SNK2: each image's scored proposals as GeoJSON of a fixed schema, written and read again."""
    p, t = map(cut_lineage, _tables(spark, sf_dir))
    shapes = read_spread(spark, sf_dir, "proposals").where(F.col("PolygonWKT_Pix").contains("((")).select(F.col("proposal_id").alias("id"), geom.parse_wkt(F.col("PolygonWKT_Pix")).alias("g"))
    folder = temporary_folder(spark, "scored")
    S.write_scored(M.scored_features(p, t, THRESHOLD), shapes, folder)
    rows = G.features(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.geojson").text(folder, wholetext=True).select(F.col("value").alias("body")), "body", [])
    own = lambda c, t: F.get_json_object("properties", f"$.{c}").cast(t).alias(c)
    return rows.select(own("ImageId", "string"), own("BuildingId", "int"), own("IOUScore", "double")).groupBy("ImageId", "BuildingId", "IOUScore").agg(F.count("*").alias("n"))


@query(f"""{_SCORES} SELECT image_id || ',' || tp || ',' || fp || ',' || fn AS line FROM scores
UNION ALL SELECT label || ',' || v FROM (SELECT unnest(['TruthFile', 'ProposalFile', 'AOI_Name', 'True Positive Total', 'False Positive Total', 'False Negative Total']) AS label,
  unnest(['footprints', 'proposals', aoi, tp::VARCHAR, fp::VARCHAR, fn::VARCHAR]) AS v FROM (SELECT aoi, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn
  FROM (SELECT unnest({[*AREAS, "Total"]!r}) AS aoi) LEFT JOIN scores ON aoi = 'Total' OR contains(image_id, aoi) GROUP BY aoi))""")
def snk10_report_csv(spark, sf_dir):
    """SNK10, SNK11, SNK12: the report of areas and chips as CSV, written and read again, without its ratios."""
    scores, folder = cut_lineage(_scores(spark, sf_dir)), temporary_folder(spark, "report")
    S.write_report(M.area_scores(scores, AREAS), scores, folder, "footprints", "proposals")
    areas = spark.read.text(f"{folder}/areas.csv").where(F.col("value").rlike("^(TruthFile|ProposalFile|AOI_Name|[A-Z][a-z]+ (Positive|Negative) Total),")).select(F.col("value").alias("line"))
    chips = spark.read.csv(f"{folder}/chips", header=True)
    return areas.unionByName(chips.select(F.concat_ws(",", *[F.col(f"`{c}`") for c in ("ImageId", "True Positive Count", "False Positive Count", "False Negative Count")]).alias("line")))


def queries() -> dict:
    return query.named


def oracle_sql() -> dict[str, str]:
    return query.sql
