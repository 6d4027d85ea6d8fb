"""Cells of GeoTIFF files: strips and tiles, plain or deflated, whole numbers and floats, with their georeference."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, band int, row long, col long, value double, x double, y double"

# fixed values of the file format: size and struct code of field types, sample kinds, tags
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, PER_PIXEL, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT = 322, 323, 324, 325, 339, 33550, 33922
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image; ValueError for what is no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in TYPES:
            continue
        form = order + TYPES[kind] * count
        place = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        found[tag] = struct.unpack_from(form, data, place)
    return order, found


def blocks(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band or -1 for all, first row, first column, samples) of each strip or tile; cut to the image."""
    order, t = tags(data)
    first = lambda tag, default: t.get(tag, (default,))[0]
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], first(PER_PIXEL, 1)
    if first(COMPRESSION, PLAIN) not in (PLAIN, DEFLATE, OLD_DEFLATE) or first(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only plain and deflated samples are read")
    kind = np.dtype(f"{order}{KINDS[first(SAMPLE_FORMAT, 1)]}{first(BITS, 8) // 8}")
    tiled = TILE_OFFSETS in t
    bw, bh = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(first(ROWS, height), height))
    offsets, counts = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[OFFSETS], t[COUNTS])
    apart = first(PLANAR, 1) == 2 and bands > 1
    across, down = -(-width // bw), -(-height // bh)
    depth = 1 if apart else bands
    for k, (at, size) in enumerate(zip(offsets, counts)):
        plane, k = divmod(k, across * down)
        r0, c0 = k // across * bh, k % across * bw
        raw = data[at : at + size]
        if first(COMPRESSION, PLAIN) != PLAIN:
            raw = zlib.decompress(raw)
        rows = bh if tiled else min(bh, height - r0)
        block = np.frombuffer(raw, kind, rows * bw * depth).reshape(rows, bw, depth)
        if first(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        yield plane if apart else -1, r0, c0, block[: height - r0, : width - c0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, band from 1, row, col, value, x, y of the cell's centre) of all files of a folder or pattern.

    A task holds one file and one of its blocks as cells. Without a georeference x and y are null.
    A file that is no TIFF, or packed in another way, is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                _, t = tags(data)
                scale, tie = t.get(PIXEL_SCALE), t.get(TIE_POINT)
                for plane, r0, c0, block in blocks(data):
                    for b in range(block.shape[2]):
                        r, c = (g.ravel() for g in np.indices(block.shape[:2]))
                        out = pd.DataFrame({"path": name, "band": b + 1 if plane < 0 else plane + 1, "row": r + r0, "col": c + c0, "value": block[:, :, b].ravel().astype(float)})
                        known = scale is not None and tie is not None
                        out["x"] = tie[3] + (out["col"] + 0.5 - tie[0]) * scale[0] if known else None
                        out["y"] = tie[4] - (out["row"] + 0.5 - tie[1]) * scale[1] if known else None
                        yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def scene(spark: SparkSession, files: dict[int, str]) -> DataFrame:
    """Cells of a scene kept as one file a band: `files` gives the path of each band number."""
    from functools import reduce

    from pyspark.sql import functions as F

    return reduce(DataFrame.unionByName, (read(spark, p).filter("band = 1").withColumn("band", F.lit(b)) for b, p in files.items()))
