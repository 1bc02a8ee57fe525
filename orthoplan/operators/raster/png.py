"""8-bit gray PNG without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAGIC = b"\x89PNG\r\n\x1a\n"


class PngError(ValueError):
    pass


def encode(gray: np.ndarray) -> bytes:
    height, width = gray.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = gray
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    if not data.startswith(MAGIC):
        raise PngError("not a PNG")
    at, head, body, ended = len(MAGIC), None, [], False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise PngError(f"bad chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise PngError("truncated PNG")
    width, height, depth, color, _, _, interlaced = head
    if (depth, color, interlaced) != (8, 0, 0):
        raise PngError("only 8-bit gray without interlacing")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise PngError(str(e)) from e
    if raw.size != height * (width + 1):
        raise PngError("wrong amount of pixel data")
    rows = raw.reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y, row in enumerate(rows):
        out[y] = above = unfiltered(int(row[0]), row[1:], above)
    return out


def unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """One row; a byte's left neighbour is the pixel before, so filters that use it run along the row."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, dtype=np.uint64).astype(np.uint8)
    if kind == 2:
        return row + above
    if kind > 4:
        raise PngError(f"unknown filter {kind}")
    out, left, corner = bytearray(len(row)), 0, 0
    for x, (v, up) in enumerate(zip(row.tolist(), above.tolist())):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
        left = out[x] = (v + guess) & 255
        corner = up
    return np.frombuffer(bytes(out), np.uint8)


def decoded(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, width, height, raster, error; a file that cannot be read is an error row."""

    def rows(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    a = decode(content)
                    out.append((path, a.shape[1], a.shape[0], a.tobytes(), None))
                except PngError as e:
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "raster", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(rows, "path string, width int, height int, raster binary, error string")


def encoded(sheets: DataFrame) -> DataFrame:
    """sheets(document, sheet, width, height, raster) -> document, sheet, png."""

    def rows(batches):
        for pdf in batches:
            png = [encode(np.frombuffer(r, np.uint8).reshape(h, w)) for r, h, w in zip(pdf["raster"], pdf["height"], pdf["width"])]
            yield pdf[["document", "sheet"]].assign(png=png)

    return sheets.mapInPandas(rows, "document string, sheet int, png binary")
