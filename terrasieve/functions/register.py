"""Functions for SQL text: geometry over WKT, and a table function for regions of tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from terrasieve.operators.matching import overlap_area, signed_edges
from terrasieve.operators.overlay import trapezoid_area, union_trapezoids
from terrasieve.functions.wkt import rings_of
from terrasieve.operators.raster import regions_of


def _area(e: np.ndarray) -> float:
    return float(np.sum(e[:, 4] * (e[:, 2] - e[:, 0]) * (e[:, 1] + e[:, 3]) / 2))


@F.pandas_udf(T.DoubleType())
def st_area(wkt: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else _area(signed_edges(w)) for w in wkt])


@F.pandas_udf(T.DoubleType())
def st_overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(overlap_area([signed_edges(x or "").ravel() for x in a], [signed_edges(x or "").ravel() for x in b]))


@F.pandas_udf(T.DoubleType())
def st_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    first, second = [signed_edges(x or "") for x in a], [signed_edges(x or "") for x in b]
    both = overlap_area([x.ravel() for x in first], [x.ravel() for x in second])
    total = np.array([_area(x) + _area(y) for x, y in zip(first, second)]) - both
    return pd.Series(np.divide(both, total, out=np.zeros(len(both)), where=total > 0))


@F.pandas_udf(T.DoubleType())
def st_repaired_area(wkt: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else trapezoid_area(union_trapezoids(rings_of(w))) for w in wkt])


@udtf(returnType=T.StructType([T.StructField("region", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("wkt", T.StringType())]))
class TileRegions:
    """tile_regions(data, width): the equal-valued regions of a tile, 0 masked."""

    def eval(self, data: list, width: int):
        if data:
            for i, (value, rings) in enumerate(regions_of(np.asarray(data, dtype=float).reshape(-1, width))):
                yield i, value, "POLYGON (" + ", ".join("(" + ", ".join(f"{x:g} {y:g}" for x, y in r) + ")" for r in rings) + ")"


def register(spark: SparkSession) -> SparkSession:
    """Makes st_area, st_overlap_area, st_iou, st_repaired_area and tile_regions known to spark.sql."""
    for name, f in (("st_area", st_area), ("st_overlap_area", st_overlap_area), ("st_iou", st_iou), ("st_repaired_area", st_repaired_area)):
        spark.udf.register(name, f)
    spark.udtf.register("tile_regions", TileRegions)
    return spark
