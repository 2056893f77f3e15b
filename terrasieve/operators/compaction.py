"""Consolidation of very many tiny GeoJSON files into few files of good size."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.session import cut_lineage, new_folder

#: Files that one first-fit-decreasing task packs; more files are hashed to more tasks.
FILES_PER_PACKING = 100_000
#: Output files written by one wave of tasks at most; more bins share tasks, still with a file each.
MAX_TASKS = 10_000
#: Records on which the size of what is written is measured.
PROBE_ROWS = 50_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size; larger ones first, each into the first bin with room. A size over capacity gets a bin of its own.

    A tournament tree over the bins' free space finds the first fitting bin in O(log n).
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length()) if n else 1
    free = [capacity] * (2 * leaves)
    out = np.empty(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = min(int(sizes[i]), capacity)
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out[i] = node - leaves
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return out


def pack_manifest(manifest: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, pack_no, bin_no) by first-fit decreasing within hashed packings of bounded size; nulls count as size 0."""
    packs = max(1, -(-manifest.count() // FILES_PER_PACKING))
    id_type = manifest.schema[id_col].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size_col, id_col], ascending=[False, True], kind="stable")
        return pd.DataFrame({id_col: pdf[id_col], "pack_no": pdf["pack_no"], "bin_no": first_fit_decreasing(pdf[size_col].to_numpy(), capacity)})

    rows = manifest.select(id_col, F.coalesce(F.col(size_col), F.lit(0)).alias(size_col), F.pmod(F.xxhash64(id_col), F.lit(packs)).cast("int").alias("pack_no"))
    return rows.groupBy("pack_no").applyInPandas(pack, f"`{id_col}` {id_type}, pack_no int, bin_no long")


FEATURE = "struct<type:string, properties:string, geometry:string, features:array<struct<properties:string, geometry:string>>>"


def building_records(files: DataFrame, id_col: str, image_col: str, time_col: str, body_col: str) -> DataFrame:
    """(file_id, pos, written_at, ImageId, BuildingId, properties, geometry) of the features in files' bodies.

    ImageId is the feature's own, else the file row's. Empty, null or unreadable bodies hold no records.
    """
    body = F.from_json(body_col, FEATURE)
    parsed = files.select(F.col(id_col).alias("file_id"), F.col(image_col).alias("_image"), F.col(time_col).alias("written_at"), body.alias("_b"))
    own = F.when(F.col("_b.type") == "Feature", F.array(F.struct(F.col("_b.properties").alias("properties"), F.col("_b.geometry").alias("geometry"))))
    exploded = parsed.select("file_id", "_image", "written_at", F.posexplode(F.coalesce("_b.features", own)).alias("pos", "_f")).where(F.col("_f").isNotNull())
    key = F.from_json("_f.properties", "struct<ImageId:string, BuildingId:int>")
    return exploded.withColumn("_k", key).select(
        "file_id", "pos", "written_at", F.coalesce("_k.ImageId", "_image").alias("ImageId"), F.col("_k.BuildingId").alias("BuildingId"),
        F.col("_f.properties").alias("properties"), F.col("_f.geometry").alias("geometry"),
    )


def latest_records(records: DataFrame) -> DataFrame:
    """Each (ImageId, BuildingId) once: its latest version, ties by file_id and place in the file.

    Records without BuildingId have no key; of those, equal contents come out once.
    """
    content = F.when(F.col("BuildingId").isNull(), F.sha2(F.concat_ws("\u0001", "properties", "geometry"), 256))
    order = F.struct(F.coalesce("written_at", F.lit("0001-01-01").cast("timestamp")), -F.col("file_id"), -F.col("pos"))
    best = records.withColumn("_content", content).groupBy("ImageId", "BuildingId", "_content").agg(
        F.max_by(F.struct("file_id", "pos", "written_at", "properties", "geometry"), order).alias("_r")
    )
    return best.select("ImageId", "BuildingId", "_r.*")


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free checksum of the record columns."""
    h = F.xxhash64("ImageId", "BuildingId", "properties", "geometry").cast("decimal(38,0)")
    row = df.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _sizes(spark: SparkSession, folder: str) -> list[int]:
    """Bytes of the Parquet files below a folder."""
    fs, path = _fs(spark, folder)
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        if status.getPath().getName().endswith(".parquet"):
            out.append(int(status.getLen()))
    return out


def list_folder(spark: SparkSession, path: str, glob: str = "*.geojson") -> DataFrame:
    """(file_id, geoVectorName, imageId, written_at, body) of the files below a folder, for consolidate.

    file_id is a hash of the path, imageId the base name. Freeze it (write it, or let consolidate
    do so) before relying on it: files may come and go.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(F.abs(F.shiftright(F.xxhash64("path"), 1)).alias("file_id"), F.col("path").alias("geoVectorName"), name.alias("imageId"), F.col("modificationTime").alias("written_at"), F.col("content").cast("string").alias("body"))


def consolidate(
    files: DataFrame, id_col: str = "file_id", name_col: str = "geoVectorName", image_col: str = "imageId",
    time_col: str = "written_at", body_col: str = "body", target_bytes: int = 128 << 20, out: str | None = None, keep: bool = True,
) -> str:
    """Writes the files' records into few Parquet files of about target_bytes and returns the committed folder.

    1. The manifest (id, name, size, hash of each file) is frozen in the shared folder. 2. A file
    weighs what is left of it: the bytes of the records of which it holds the surviving version,
    times the share that compression leaves, measured on at most PROBE_ROWS of them. Files of any
    weight are bin-packed, first-fit decreasing. 3. Each bin becomes one file
    that holds its files' records. 4. What was written is read again;
    rows and checksum must be those of the records, and the input must still match the manifest.
    5. One rename makes the folder visible; a failed run leaves only a staging folder, and a
    folder that exists already is refused. keep=False: the folder goes when the JVM ends.
    The folder's _manifest holds (file_id, name, bytes, hash, bin), _COMMIT.json the sizes of the files. Files without id get a negative one
    from their hash; files listed twice count once; null, empty and unreadable bodies hold no records;
    an empty table gives an empty folder. Extra columns are ignored.
    """
    spark = files.sparkSession
    base = out or new_folder(spark, "consolidated")
    staging = base + "-staging"
    for folder in (base, staging):
        fs, path = _fs(spark, folder)
        if fs.exists(path):
            raise FileExistsError(f"consolidation: {folder} exists")
    own_id = F.coalesce(F.col(id_col), -F.abs(F.shiftright(F.xxhash64(name_col, body_col), 1)) - 1)
    files = files.select(own_id.alias("_file"), F.col(name_col).alias("_name"), F.col(image_col).alias("_own_image"), F.col(time_col).alias("_time"), F.col(body_col).alias("_body"))
    id_col, name_col, image_col, time_col, body_col = "_file", "_name", "_own_image", "_time", "_body"
    line = files.select(F.col(id_col).alias("file_id"), F.col(name_col).alias("name"), F.coalesce(F.octet_length(body_col), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(body_col).alias("hash"))
    manifest = cut_lineage(line)
    records = cut_lineage(latest_records(building_records(files, id_col, image_col, time_col, body_col)))
    raw = F.sum(F.coalesce(F.octet_length("properties"), F.lit(0)) + F.coalesce(F.octet_length("geometry"), F.lit(0)) + F.coalesce(F.octet_length("ImageId"), F.lit(0)) + 32)
    numbered = cut_lineage(pack_manifest(records.groupBy("file_id").agg(raw.alias("bytes")), "file_id", "bytes", max(1, int(target_bytes / _left_of(records, raw, f"{staging}/_probe")))))
    per_pack = numbered.groupBy("pack_no").agg(F.max("bin_no").alias("_last")).collect()  # one row a packing
    offset, offsets = 0, []
    for row in sorted(per_pack):
        offsets.append((row[0], offset))
        offset += row[1] + 1
    table = spark.createDataFrame(offsets, "pack_no int, _offset long")
    bins = numbered.join(table, "pack_no").select("file_id", (F.col("bin_no") + F.col("_offset")).alias("bin"))
    n_bins = max(1, offset)
    placed = records.join(bins, "file_id")
    tasks = min(n_bins, MAX_TASKS)
    writer = placed.repartitionById(tasks, F.pmod("bin", F.lit(tasks)).cast("int"))
    if n_bins > MAX_TASKS:
        writer.sortWithinPartitions("bin", "ImageId", "BuildingId").write.partitionBy("bin").parquet(f"{staging}/data")
    else:
        writer.sortWithinPartitions("ImageId", "BuildingId").write.parquet(f"{staging}/data")
    expected, found = checksum(records), checksum(spark.read.schema(records.schema).parquet(f"{staging}/data"))
    state = F.count("*"), F.sum("bytes"), F.sum(F.col("hash").cast("decimal(38,0)"))
    if expected != found:
        raise RuntimeError(f"consolidation: {found} written, {expected} expected; staging folder kept: {staging}")
    if line.agg(*state).first() != manifest.agg(*state).first():
        raise RuntimeError("consolidation: the input changed after its manifest was frozen")
    manifest.join(bins, "file_id", "left").write.parquet(f"{staging}/_manifest")
    fs, path = _fs(spark, staging)
    sizes = sorted(_sizes(spark, f"{staging}/data"))
    said = {"rows": expected[0], "checksum": str(expected[1]), "bins": n_bins, "target_bytes": target_bytes, "files": len(sizes), "least_bytes": sizes[0] if sizes else 0, "median_bytes": sizes[len(sizes) // 2] if sizes else 0, "most_bytes": sizes[-1] if sizes else 0}
    note = fs.create(_fs(spark, f"{staging}/_COMMIT.json")[1], True)
    note.write(bytearray(json.dumps(said).encode()))
    note.close()
    target = _fs(spark, base)[1]
    if fs.exists(target) or not fs.rename(path, target):
        raise RuntimeError(f"consolidation: {staging} couldn't be renamed to {base}")
    if not keep:
        fs.deleteOnExit(target)
    return base


def _left_of(records: DataFrame, raw, folder: str) -> float:
    """Written bytes per byte of records, measured on at most PROBE_ROWS of them; the folder is removed."""
    spark = records.sparkSession
    probe = records.limit(PROBE_ROWS).repartition(1).sortWithinPartitions("ImageId", "BuildingId")
    probe.write.parquet(folder)
    fs, path = _fs(spark, folder)
    whole = spark.read.schema(records.schema).parquet(folder).agg(raw).first()[0]
    share = sum(_sizes(spark, folder)) / whole if whole else 1.0
    fs.delete(path, True)
    return max(share, 1e-3)
