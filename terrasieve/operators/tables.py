"""Per-image statistics, regressions, unions, names."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.functions import crs


def describe(df: DataFrame, key: str, columns: dict[str, str], scale: float = 1.0) -> DataFrame:
    """key and, for each column under its short name, count, sum, mean, std, min, p25, p50, p75, max.

    Quartiles are exact and interpolate linearly; the std of one row is null. Groups without
    values have count 0 and nulls.
    """
    aggs = []
    for column, name in columns.items():
        v = F.col(column) * scale
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs += [F.count(v).alias(f"{name}_count"), F.sum(v).alias(f"{name}_sum"), F.avg(v).alias(f"{name}_mean"), F.stddev_samp(v).alias(f"{name}_std"), F.min(v).alias(f"{name}_min"), q.alias(f"_{name}"), F.max(v).alias(f"{name}_max")]
    out = df.groupBy(key).agg(*aggs)
    for name in columns.values():
        out = out.withColumns({f"{name}_{p}": F.col(f"_{name}")[i] for i, p in enumerate(("p25", "p50", "p75"))}).drop(f"_{name}")
    return out


def regression_by_area(df: DataFrame, key: str, areas: list[str], y: str, x: str) -> DataFrame:
    """(aoi, joined, slope, intercept, r2, n) of least squares y ~ x over the rows whose key contains each area."""
    mine = F.filter(F.array(*map(F.lit, areas)), lambda a: F.contains(F.col(key), a))
    rows = df.select(F.explode(mine).alias("aoi"), F.col(y).alias("_y"), F.col(x).alias("_x"))
    return rows.groupBy("aoi").agg(F.count("*").alias("joined"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"), F.regr_count("_y", "_x").alias("n"))


def with_style(df: DataFrame, fills: dict[str, str], default: str, opacity: float) -> DataFrame:
    """df (aoi, source) plus location, fill and fill_opacity."""
    fill = F.lit(default)
    for area, colour in fills.items():
        fill = F.when(F.col("aoi") == area, colour).otherwise(fill)
    return df.withColumns({"location": F.concat_ws("/", F.lit("/data"), "aoi", "source"), "fill": fill, "fill_opacity": F.lit(opacity)})


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def strip_all(text: Column, parts: list[str]) -> Column:
    out = text
    for p in parts:
        out = F.replace(out, F.lit(p), F.lit(""))
    return out


def name_pieces(text: Column) -> Column:
    """All pieces of a name that begin and end at a separator (_ . / - or blank) or at an end of it, each once.

    What a name holds as whole tokens is found by an equi-join on these; a name of n tokens has at most n (n + 1) / 2.
    """
    parts = F.split(text, r"(?<=[_./\- ])|(?=[_./\- ])")  # tokens and separators in turns
    tokens = F.filter(F.transform(parts, lambda p, i: F.when(~p.rlike(r"^[_./\- ]?$"), i)), lambda i: i.isNotNull())
    return F.array_distinct(F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: b >= a), lambda b: F.array_join(F.slice(parts, a + 1, b - a + 1), "")))))


def area_name(number: Column, name: Column) -> Column:
    return F.format_string("AOI_%s_%s", number, name)


def metric_square(df: DataFrame, lon: str, lat: str, radius: float) -> DataFrame:
    """df plus box: the envelope, in degrees, of the 64-vertex circle of radius metres around each position.

    The vertices are taken back from UTM one by one, as reprojecting the square's corners would
    give a looser box. One Arrow step for all vertices of a batch; null positions give a null box.
    """
    turn = np.arange(64) * (pi / 32)
    dx, dy = radius * np.cos(turn), radius * np.sin(turn)

    @F.pandas_udf("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    def envelope(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        lons, lats = x.to_numpy(float), y.to_numpy(float)
        zone, east, north = crs.forward_array(lons, lats)
        a, b = crs.inverse_array(east[:, None] + dx, north[:, None] + dy, zone[:, None], (lats < 0)[:, None])
        return pd.DataFrame({"xmin": a.min(1), "ymin": b.min(1), "xmax": a.max(1), "ymax": b.max(1)})

    known = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    rows = df.withColumn("_box", envelope(F.col(lon).cast("double"), F.col(lat).cast("double")))
    return rows.withColumn("box", F.when(known, F.col("_box"))).drop("_box")


def object_centred(df: DataFrame, lon: str, lat: str, radius: float, class_col: str | None = None) -> DataFrame:
    """metric_square plus folder: the object's class without blanks, or 'unknown'."""
    folder = F.coalesce(F.regexp_replace(F.col(class_col), " ", ""), F.lit("unknown")) if class_col else F.lit("unknown")
    return metric_square(df, lon, lat, radius).withColumn("folder", folder)
