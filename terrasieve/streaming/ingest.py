"""Continuous loading with the map-only operators: the same functions over a stream instead of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terrasieve.functions.timestamps import normalise_timestamps
from terrasieve.sources.summary_csv import load_lines


def load_line_stream(lines: DataFrame, out: str, checkpoint: str, id_col: str = "line_id", header_col: str = "header_line", line_col: str = "line_text") -> StreamingQuery:
    """Starts a query that appends valid lines to out/valid and others, with their reason, to out/faulty.

    Both are written in one micro-batch under its number, so that a batch that is run again after a
    failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.where("reason is null").drop("reason", "error_at", "error_detail").write.mode("overwrite").parquet(f"{out}/valid/batch={number}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{out}/faulty/batch={number}")

    return load_lines(lines, id_col, header_col, line_col).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def normalised_stream(rows: DataFrame, id_col: str, fields: list[str], source_col: str, lookup: DataFrame) -> DataFrame:
    """normalise_timestamps of a stream; the lookup is a table."""
    return normalise_timestamps(rows, id_col, fields, source_col, lookup)
