"""TIFF rasters, read and written without a native library."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.sources.files import write_each

# Bytes of the TIFF field types, and numpy kinds by (sample format, bits).
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """The byte order and the first directory's fields; ValueError if it isn't a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _SIZES:
            continue
        form = order + (f"{count}s" if kind == 2 else _SIZES[kind] * count)
        size = struct.calcsize(form)
        start = None if size <= 4 else struct.unpack(order + "I", entry[8:12])[0]
        tags[tag] = struct.unpack(form, entry[8 : 8 + size] if start is None else data[start : start + size])
    return order, tags


def metadata(data: bytes) -> dict:
    """width, height, bands, dtype and the affine a..f (the identity where the file has none)."""
    _, t = tags_of(data)
    bits, sample = t.get(258, (8,))[0], t.get(339, (1,))[0]
    affine = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if 33550 in t and 33922 in t:
        (sx, sy), tie = t[33550][:2], t[33922]
        affine = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    elif 34264 in t:
        m = t[34264]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    return {"width": t[256][0], "height": t[257][0], "bands": t.get(277, (1,))[0], "dtype": _KINDS.get((sample, bits), "?"), "affine": affine}


def _lzw(data: bytes) -> bytes:
    """LZW with codes from the high bits on, of 9 to 12 bits, widened one code early."""
    out, table, previous, bits, width, value = [], [], b"", 0, 9, 0
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, value = value >> bits, value & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not previous:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out.append(entry)
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
    return b"".join(out)


_DECODERS = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def pixels(data: bytes) -> np.ndarray:
    """(bands, rows, cols) of strips or tiles, plain, LZW, deflate or PackBits, with or without horizontal differences; ValueError otherwise."""
    order, t = tags_of(data)
    m = metadata(data)
    compression, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
    if compression not in _DECODERS or predictor not in (1, 2) or m["dtype"] == "?" or (predictor == 2 and m["dtype"][0] == "f"):
        raise ValueError(f"compression {compression} with predictor {predictor} of {m['dtype']} can't be read")
    tiled = 324 in t
    offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    width, height, bands = m["width"], m["height"], m["bands"]
    planar = t.get(284, (1,))[0] == 2
    block_w, block_h = (t[322][0], t[323][0]) if tiled else (width, min(height, t.get(278, (height,))[0]))
    across, down = -(-width // block_w), -(-height // block_h)
    depth = 1 if planar else bands
    out = np.zeros((bands, height, width), dtype=m["dtype"])
    for k, (a, n) in enumerate(zip(offsets, sizes)):
        band, place = divmod(k, across * down) if planar else (0, k)
        y, x = place // across * block_h, place % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        raw = _DECODERS[compression](data[a : a + n])
        block = np.frombuffer(raw, dtype=order + m["dtype"], count=rows * block_w * depth).reshape(rows, block_w, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=m["dtype"])
        keep = block[: height - y, : width - x]
        out[band : band + depth, y : y + keep.shape[0], x : x + keep.shape[1]] = np.moveaxis(keep, 2, 0)
    return out


def encode(bands: np.ndarray, affine: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), compress: bool = True, tile: int | None = None) -> bytes:
    """A classic little-endian TIFF of (bands, rows, cols) with its affine a..f; deflated strips of up to 64 rows, or tiles of the given side (a multiple of 16)."""
    bands = np.asarray(bands)
    code = bands.dtype.kind + str(bands.dtype.itemsize)
    kind = next((k for k, v in _KINDS.items() if v == code), None)
    if kind is None or bands.ndim != 3:
        raise ValueError(f"{bands.dtype} of {bands.ndim} dimensions can't be written")
    n, height, width = bands.shape
    mixed = np.moveaxis(bands, 0, 2).astype("<" + code)
    if tile:
        full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, n), dtype=mixed.dtype)
        full[:height, :width] = mixed
        blocks = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
    else:
        blocks = [mixed[y : y + 64] for y in range(0, height, 64)]
    raw = [zlib.compress(b.tobytes()) if compress else b.tobytes() for b in blocks]
    at = 8 + np.cumsum([0, *map(len, raw)])
    a, b, c, d, e, f = affine
    tags: list[tuple[int, int, tuple]] = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (kind[1],) * n), (259, 3, (8 if compress else 1,)), (262, 3, (2 if n == 3 and kind == (1, 8) else 1,)), (277, 3, (n,)), (284, 3, (1,)), (339, 3, (kind[0],) * n), (34264, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))]
    where, long = tuple(int(x) for x in at[:-1]), tuple(map(len, raw))
    tags += [(322, 4, (tile,)), (323, 4, (tile,)), (324, 4, where), (325, 4, long)] if tile else [(273, 4, where), (278, 4, (64,)), (279, 4, long)]
    start = int(at[-1]) + int(at[-1]) % 2
    later, entries = b"", b""
    after = start + 2 + 12 * len(tags) + 4
    for tag, kind_of, values in sorted(tags):
        body = struct.pack("<" + _SIZES[kind_of] * len(values), *values)
        if len(body) <= 4:
            entries += struct.pack("<HHI", tag, kind_of, len(values)) + body.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind_of, len(values), after + len(later))
            later += body + b"\0" * (len(body) % 2)
    return b"II*\0" + struct.pack("<I", start) + b"".join(raw) + b"\0" * (start - int(at[-1])) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + later


def write_rasters(df: DataFrame, image: str, data: str, width: str, bands: str | None, affine: list[str] | None, folder: str, dtype: str = "u1", compress: bool = True, tile: int | None = None) -> DataFrame:
    """One TIFF a row, folder/<image>.tif, and the committed list (file, bytes).

    data is the row-major array of all bands one after the other, width its columns, bands their
    number (1 without); values are cut to dtype's range. affine: columns a..f. Rows without data write nothing.
    """
    limit = np.iinfo(dtype) if dtype[0] in "iu" else None

    def one(row) -> bytes:
        values = np.asarray(row[data], dtype=float)
        cut = np.clip(values, limit.min, limit.max) if limit else values
        return encode(cut.astype(dtype).reshape(int(row[bands]) if bands else 1, -1, int(row[width])), tuple(float(row[c]) for c in affine) if affine else (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), compress, tile)

    return write_each(df.where(F.size(data) > 0).select(image, data, width, *([bands] if bands else []), *(affine or [])), image, folder, one, ".tif")


def write_arrays(df: DataFrame, image: str, data: str, width: str, folder: str) -> DataFrame:
    """One .npy file of doubles a row, folder/<image>.npy, and the committed list (file, bytes)."""

    def one(row) -> bytes:
        out = io.BytesIO()
        np.save(out, np.asarray(row[data], dtype=float).reshape(-1, int(row[width])))
        return out.getvalue()

    return write_each(df.where(F.size(data) > 0).select(image, data, width), image, folder, one, ".npy")


def read_rasters(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """(path, image_id, width, height, bands, dtype, tr_a..tr_f, error) of every raster below path; unreadable ones with error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    names = [f"tr_{c}" for c in "abcdef"]

    def run(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"]):
                try:
                    m = metadata(bytes(data))
                    rows.append((p, m["width"], m["height"], m["bands"], m["dtype"], *m["affine"], None))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((p, None, None, None, None, *[None] * 6, str(e)))
            out = pd.DataFrame(rows, columns=["path", "width", "height", "bands", "dtype", *names, "error"])
            yield out.astype({"width": "Int64", "height": "Int64", "bands": "Int64"})

    schema = "path string, width int, height int, bands int, dtype string, " + ", ".join(f"{n} double" for n in names) + ", error string"
    return files.select("path", "content").mapInPandas(run, schema).withColumn("image_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))


def read_tiles(spark: SparkSession, path: str, size: int, stride: int | None = None, glob: str = "*.tif") -> DataFrame:
    """(image_id, band, x0, y0, width, height, data ARRAY<DOUBLE>, error): windows of each raster, cut off at its edges; one row a window and band.

    A raster that can't be read is one row with its error, and null elsewhere.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    step = stride or size
    names = ["image_id", "band", "x0", "y0", "width", "height", "data", "error"]

    def run(batches):
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    a = pixels(bytes(data))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    yield pd.DataFrame([(name, None, None, None, None, None, None, str(e))], columns=names)
                    continue
                for y in range(0, a.shape[1], step):
                    rows = []
                    for x in range(0, a.shape[2], step):
                        for band in range(a.shape[0]):
                            w = a[band, y : y + size, x : x + size]
                            rows.append((name, band, x, y, w.shape[1], w.shape[0], w.astype(float).ravel(), None))
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "image_id string, band int, x0 int, y0 int, width int, height int, data array<double>, error string")
