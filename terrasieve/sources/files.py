"""Files that tasks read and write themselves, on any file system that Arrow knows (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it; paths without scheme, or of file:, are local and taken as they are."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def write_bytes(path: str, pieces: Iterable[bytes]) -> int:
    """Writes a file under another name and moves it to its own when it is whole, so that a lost task leaves no half file; its size."""
    files, at = filesystem(path)
    folder, _, name = at.rpartition("/")
    files.create_dir(folder, recursive=True)
    draft, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with files.open_output_stream(draft) as out:
        for piece in pieces:
            size += out.write(piece) or len(piece)
    files.move(draft, at)
    return size


def safe_name(value) -> str:
    """A value as part of a file's name."""
    text = "null" if value is None or value != value else str(value)
    return "".join(c if c.isalnum() or c in "._-" else f"~{ord(c):02X}" for c in text)


def write_grouped(rows: DataFrame, key: str, text: str, order: list[str], folder: str, head: str, tail: str, separator: str, suffix: str) -> DataFrame:
    """Writes the texts of each key to folder/key/part-N and returns the committed list (file, n_rows, bytes).

    Rows are brought together by key with a rebalancing shuffle: adaptive execution cuts a hot key
    into several parts, each a complete document of its own, and texts are streamed, never
    gathered. The list, folder/_files, is written last; files of tasks that didn't succeed aren't
    in it. Null keys are written as 'null'; an empty table writes no document.
    """
    placed = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(text).alias("_t"))
    placed = placed.hint("rebalance", "_k").sortWithinPartitions("_k", *[f"_o{i}" for i in range(len(order))])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        pending = ((k, t) for batch in batches for k, t in zip(batch["_k"], batch["_t"]))
        held = next(pending, None)
        while held is not None:
            name, count = safe_name(held[0]), 0
            path = f"{folder}/{name}/part-{number:05d}{suffix}"

            def pieces():
                nonlocal held, count
                yield head.encode()
                while held is not None and safe_name(held[0]) == name:  # noqa: B023
                    yield ((separator if count else "") + held[1]).encode()
                    count += 1
                    held = next(pending, None)
                yield tail.encode()

            size = write_bytes(path, pieces())
            yield pd.DataFrame([(path, count, size)], columns=["file", "n_rows", "bytes"])

    placed.select("_k", "_t").mapInPandas(run, "file string, n_rows long, bytes long").write.mode("overwrite").parquet(f"{folder}/_files")
    return rows.sparkSession.read.parquet(f"{folder}/_files")


def write_each(rows: DataFrame, name: str, folder: str, encode: Callable[[pd.Series], bytes], suffix: str) -> DataFrame:
    """Writes one file a row, folder/name+suffix with encode(row), and returns the committed list (file, bytes)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for _, row in batch.iterrows():
                path = f"{folder}/{safe_name(row[name])}{suffix}"
                done.append((path, write_bytes(path, [encode(row)])))
            yield pd.DataFrame(done, columns=["file", "bytes"])

    rows.mapInPandas(run, "file string, bytes long").write.mode("overwrite").parquet(f"{folder}/_files")
    return rows.sparkSession.read.parquet(f"{folder}/_files")


def copy_files(rows: DataFrame, path: str, split: str, folder: str) -> DataFrame:
    """Copies each row's file to folder/split and returns (file, copy, bytes, error); files that can't be read come out with error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for source, part in zip(batch["_p"], batch["_s"]):
                target = f"{folder}/{safe_name(part)}/{source.rstrip('/').rpartition('/')[2]}" if source else None
                try:
                    files, at = filesystem(source or "")
                    with files.open_input_stream(at) as stream:
                        size, error = write_bytes(target, iter(lambda: stream.read(1 << 20), b"")), None  # noqa: B023
                except (OSError, ValueError) as e:
                    size, error = None, str(e)
                done.append((source, target if error is None else None, size, error))
            yield pd.DataFrame(done, columns=["file", "copy", "bytes", "error"]).astype({"bytes": "Int64"})

    rows.select(F.col(path).alias("_p"), F.col(split).cast("string").alias("_s")).mapInPandas(run, "file string, copy string, bytes long, error string").write.mode("overwrite").parquet(f"{folder}/_files")
    return rows.sparkSession.read.parquet(f"{folder}/_files")
