"""The N best rows of every group, by score thresholds from the histograms of the large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per doubling of (1 + |score| * SCALE); the mapping is monotone, so thresholds are safe for any scores.
STEPS, SCALE = 1024, float(1 << 20)
#: Groups that get a threshold at most; a group does if it holds more rows than one of that many equal groups would.
MOST_THRESHOLDS = 100_000
#: ... and more than so many rows a wanted one; below, ranking costs less than a threshold.
LEAST_FACTOR = 64


def score_bucket(score: Column) -> Column:
    """Monotone bucket of a finite or infinite DOUBLE; it needs no knowledge of the data's range."""
    size = F.least(F.abs(score), F.lit(1e300))
    return (F.signum(score) * F.floor(F.log2(F.lit(1.0) + size * SCALE) * STEPS)).cast("int")


def thresholds(rows: DataFrame, group_col: str, score_col: str, n: int) -> DataFrame:
    """(_topn_key, _topn_cut): the safe lower bucket of each large group, by the 64-bit hash of the group.

    At most MOST_THRESHOLDS rows of 12 bytes: only so many groups can each hold more than one
    part in MOST_THRESHOLDS of all rows. Groups of equal hash share the lowest of their buckets.
    """
    sizes = rows.groupBy(F.xxhash64(group_col).alias("_topn_key")).agg(F.count("*").alias("_topn_rows"))
    total = sizes.agg(F.coalesce(F.sum("_topn_rows"), F.lit(0))).scalar()
    large = sizes.where((F.col("_topn_rows") > LEAST_FACTOR * n) & (F.col("_topn_rows") > total / MOST_THRESHOLDS)).select("_topn_key")
    within = rows.select(F.col(group_col).alias("_topn_group"), F.xxhash64(group_col).alias("_topn_key"), score_bucket(F.col(score_col)).alias("_topn_bucket"))
    counts = within.join(F.broadcast(large), "_topn_key").groupBy("_topn_key", "_topn_group", "_topn_bucket").agg(F.count("*").alias("_topn_n"))
    above = Window.partitionBy("_topn_key", "_topn_group").orderBy(F.desc("_topn_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_topn_above", F.coalesce(F.sum("_topn_n").over(above), F.lit(0))).where(F.col("_topn_above") < n)
    cut = needed.groupBy("_topn_key", "_topn_group").agg(F.min("_topn_bucket").alias("_topn_cut"), F.sum("_topn_n").alias("_topn_found"))
    safe = F.when(F.col("_topn_found") >= n, F.col("_topn_cut")).otherwise(F.lit(-(2**31)))
    return cut.groupBy("_topn_key").agg(F.min(safe).alias("_topn_cut"))


def top_n(df: DataFrame, group_col: str, score_col: str, tie_cols: list[str], n: int, competes: Column | None = None) -> DataFrame:
    """df's columns plus rank_no INT (1..n) for the n best rows of every group.

    Order: score descending, then tie_cols ascending with nulls last; with unique tie_cols the
    result is fixed. A column rank_no of df is replaced. Rows with null or NaN score, or for which competes isn't true, take no
    part. Null groups form one group. Groups with fewer than n rows come out whole; repeated
    rows compete singly; an empty table gives an empty one.

    1. Rows are counted per group, combined map-side. 2. The large groups, of which there can be
    only so many, get a histogram of score buckets, combined map-side, so that a hot group sends
    at most one row per bucket and task; the group's threshold is the highest bucket at or above
    which n or more rows lie. 3. Rows below it are dropped by a broadcast of bounded size before
    any row is shuffled, however many groups there are. 4. The survivors are ranked exactly;
    Spark's group limit keeps at most n rows a task and group, also where a third of all rows tie.
    """
    if n < 1:
        raise ValueError("n must be positive")
    keep = F.col(score_col).isNotNull() & ~F.isnan(score_col)
    rows = df.where(keep if competes is None else keep & competes)
    cuts = thresholds(rows, group_col, score_col, n)
    marked = rows.withColumns({"_topn_at": F.xxhash64(group_col), "_topn_bucket": score_bucket(F.col(score_col))})
    survivors = marked.join(F.broadcast(cuts), F.col("_topn_at") == F.col("_topn_key"), "left")
    survivors = survivors.where(F.col("_topn_cut").isNull() | (F.col("_topn_bucket") >= F.col("_topn_cut"))).drop("_topn_at", "_topn_key", "_topn_cut", "_topn_bucket")
    order = Window.partitionBy(group_col).orderBy(F.desc(score_col), *[F.asc_nulls_last(t) for t in tie_cols])
    return survivors.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n)
