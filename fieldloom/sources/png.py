"""PNG images of maps: one binary value an image, encoded and decoded with zlib only."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode(pixels: np.ndarray) -> bytes:
    """uint8 array (rows, columns, 3), the first row on top."""
    height, width, _ = pixels.shape
    raw = np.zeros((height, 1 + 3 * width), np.uint8)
    raw[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """uint8 array (rows, columns, channels) of an 8-bit image that is not interlaced and has no palette."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit images without palette and interlacing are read")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        how, line = rows[y, 0], rows[y, 1:]
        above = out[y - 1] if y else np.zeros_like(line)
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = line + above
        else:
            for i in range(len(line)):
                a = int(out[y, i - channels]) if i >= channels else 0
                b, c = int(above[i]), int(above[i - channels]) if i >= channels else 0
                nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                out[y, i] = (int(line[i]) + {1: a, 3: (a + b) // 2, 4: nearest}[int(how)]) & 255
    return out.reshape(height, width, channels)


def images(maps: DataFrame, width: int, height: int, key: str = "cam_id") -> DataFrame:
    """(key, png) from (key, py, px, r, g, b) with channels of 0 to 1; pixels without a row are black. A task holds one
    image at a time, whose size is the camera's, not the data's."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width, 3), np.uint8)
        out[rows["py"], rows["px"]] = np.floor(rows[["r", "g", "b"]].clip(0, 1).to_numpy() * 255)
        return pd.DataFrame({key: rows[key].iloc[:1], "png": [encode(out)]})

    kind = dict(maps.dtypes)[key]
    return maps.select(key, "py", "px", "r", "g", "b").groupBy(key).applyInPandas(draw, f"{key} {kind}, png binary")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, py, px, r, g, b), 0 to 1, of the PNG files of a folder; grey images have three equal channels."""

    def read(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                a = decode(data)
                rgb = a[:, :, :3] if a.shape[2] > 2 else np.repeat(a[:, :, :1], 3, axis=2)
                y, x = np.indices(a.shape[:2])
                yield pd.DataFrame({"path": path, "py": y.ravel().astype(np.int32), "px": x.ravel().astype(np.int32)} | {n: rgb[:, :, i].ravel() / 255 for i, n in enumerate("rgb")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, py int, px int, r double, g double, b double")
