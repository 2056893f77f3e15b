"""The pN_ queries of the training-text problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.session import read as _read
from terrasieve.session import read_spread as _read_spread


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.llm.topn import top_n

    rows = _read(spark, sf_dir, "proposals").select("proposal_id", "ImageId", "BuildingId", "Confidence")
    best = top_n(rows, "ImageId", "Confidence", ["BuildingId", "proposal_id"], 3, competes=~F.col("BuildingId").eqNullSafe(-1))
    return best.select("ImageId", "rank_no", "proposal_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.llm.packing import pack_texts

    return pack_texts(_read_spread(spark, sf_dir, "documents"), "doc_id", "text", 2048)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.llm.leakage import find_leaks

    runs = find_leaks(_read_spread(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "eval_items"), "item_id", "text", 15)
    return runs.select("item_id", "doc_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrasieve.llm.residue import find_residue

    return find_residue(_read_spread(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


P3_SQL = """
SELECT ImageId, CAST(rank_no AS INTEGER) AS rank_no, proposal_id FROM (
  SELECT ImageId, proposal_id, row_number() OVER (PARTITION BY ImageId
    ORDER BY Confidence DESC, BuildingId ASC NULLS LAST, proposal_id ASC) AS rank_no
  FROM proposals WHERE Confidence IS NOT NULL AND NOT isnan(Confidence) AND BuildingId IS DISTINCT FROM -1)
WHERE rank_no <= 3
"""

P8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, list_aggregate(w[k:k + 14], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS k FROM i)),
dg AS (SELECT doc_id, list_aggregate(w[k:k + 14], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS k FROM d))
SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)
"""


def queries() -> dict:
    return {q.__name__: q for q in (p3_found, p7_containers, p8_found, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p8_found": P8_SQL}
