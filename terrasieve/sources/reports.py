"""What an evaluation or a data set leaves as files: scored features, reports, summaries by layer, areas in degrees."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.functions import geom
from terrasieve.operators.labels import summary_rows
from terrasieve.sources.files import write_bytes
from terrasieve.sources.geojson import coordinates_json, write_geojson

# The reports' labels, in order, with the report's column.
AREA_LABELS = [("F1Score Total", "f1"), ("Precision", "precision"), ("Recall", "recall"), ("True Positive Total", "tp"), ("False Positive Total", "fp"), ("False Negative Total", "fn")]
CHIP_COLUMNS = [("ImageId", "image_id"), ("F1Score", "f1"), ("True Positive Count", "tp"), ("False Positive Count", "fp"), ("False Negative Count", "fn")]


def area_lines(report: DataFrame, truth: str, proposals: str) -> list[list]:
    """The report of each area (a row each, as many as were asked for) as label and value rows, areas apart by an empty row."""
    lines: list[list] = []
    for row in report.collect():
        lines += [["TruthFile", truth], ["ProposalFile", proposals], ["AOI_Name", row["aoi"]], ["Summary Results"], *([label, row[c]] for label, c in AREA_LABELS), [""]]
    return lines


def chip_report(scores: DataFrame) -> DataFrame:
    """The image scores under the report's column names."""
    return scores.select(*[F.col(c).alias(label) for label, c in CHIP_COLUMNS])


def write_report(report: DataFrame, scores: DataFrame, path: str, truth: str = "", proposals: str = "") -> None:
    """path/areas.csv, written by the driver as it has a few rows an area, and path/chips, a CSV with header written by the tasks."""
    chip_report(scores).write.mode("overwrite").csv(f"{path}/chips", header=True)
    text = io.StringIO()
    csv.writer(text).writerows(area_lines(report, truth, proposals))
    write_bytes(f"{path}/areas.csv", [text.getvalue().encode()])


def print_report(report: DataFrame) -> str:
    """The areas' counts and F1, a line a value; also printed."""
    said = "\n".join(f"{label} {row[c]}" for row in report.collect() for label, c in (("Area", "aoi"), ("True positives", "tp"), ("False positives", "fp"), ("False negatives", "fn"), ("F1", "f1")))
    print(said)
    return said


def write_scored(scored: DataFrame, polygons: DataFrame, path: str) -> DataFrame:
    """Scored features (image_id, pid, iou, building_pos) as feature collections of each image, and their list.

    polygons: (id, g) of the proposals. Properties are ImageId, IOUScore with five decimals and BuildingId, -1 without a match.
    """
    rows = scored.join(polygons.select(F.col("id").alias("pid"), "g"), "pid")
    return write_geojson(_with_coordinates(rows.select(F.col("image_id").alias("ImageId"), F.round("iou", 5).alias("IOUScore"), F.col("building_pos").alias("BuildingId"), "g")), path, "coordinates", "kind", ["ImageId", "IOUScore", "BuildingId"], "ImageId")


def _with_coordinates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"coordinates": coordinates_json(F.col("g")), "kind": F.when(F.size("g") == 1, "Polygon").otherwise("MultiPolygon")})


def write_areas(features: DataFrame, chips: DataFrame, path: str, properties: list[str]) -> DataFrame:
    """Pixel features (ImageId, g, properties) in degrees by their chip's transform, as feature collections of each area, and their list."""
    tr = [F.col(f"tr_{x}") for x in "abcdef"]
    rows = features.join(chips.select(F.col("imageId").alias("_image"), "aoi", *tr), F.col("ImageId") == F.col("_image"))
    return write_geojson(_with_coordinates(rows.withColumn("g", geom.map_points(F.col("g"), geom.pixel_to_geo(*tr)))), path, "coordinates", "kind", properties, "aoi")


def write_layer_summaries(chips: DataFrame, footprints: DataFrame, layer: str, path: str) -> None:
    """The summary CSV of each raster layer (a column of chips), path/layer=<value>; chips without buildings have their sentinel row."""
    rows = summary_rows(chips, footprints).join(chips.select(F.col("imageId").alias("_image"), F.col(layer).alias("layer")), F.col("ImageId") == F.col("_image")).drop("_image")
    rows.write.mode("overwrite").partitionBy("layer").csv(path, header=True, escape='"')
