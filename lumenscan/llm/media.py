"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized, hashed and written as NPY tiles.

A media column holds the bytes of an image in one of the formats P1 to P6 or uncompressed BMP.  ``decode``
gives an array, ``area_resize`` averages it over the exact area of each target pixel from an integral image,
``difference_hash`` compares neighbours of a 9 by 8 reduction, and ``to_npy`` / ``from_npy`` store tiles.

Defined results: null bytes give null features; an image without pixels or bytes of another format raise
``MediaError`` in the functions, and give a row with ``error`` set and null features in ``features``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD_UNIT = 64
TILE = (8, 9)


class MediaError(ValueError):
    pass


_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def _netpbm_header(data: bytes, count: int) -> tuple[list[int], int]:
    at, found = 2, []
    for _ in range(count):
        m = _HEADER.match(data, at)
        if not m:
            raise MediaError("cut or malformed header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, shape (height, width) or (height, width, 3); bitmaps are 0 for black, 255 for white."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise MediaError("no Netpbm image")
    bitmap, colour, plain = kind in (b"P1", b"P4"), kind in (b"P3", b"P6"), kind in (b"P1", b"P2", b"P3")
    (width, height, *most), at = _netpbm_header(data, 2 if bitmap else 3)
    top = 1 if bitmap else most[0]
    if width * height == 0 or not 0 < top < 65536:
        raise MediaError("no pixels, or a wrong maximum")
    shape = (height, width, 3) if colour else (height, width)
    n = int(np.prod(shape))
    if plain:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([*re.sub(rb"\s+", b"", body)[:n]], np.int64) - 48 if bitmap else np.array(body.split()[:n], np.int64)
        if len(values) < n:
            raise MediaError("cut image")
    elif bitmap:
        row = (width + 7) // 8
        body = data[at + 1 : at + 1 + row * height]
        if len(body) < row * height:
            raise MediaError("cut image")
        values = np.unpackbits(np.frombuffer(body, np.uint8).reshape(height, row), axis=1)[:, :width].astype(np.int64).reshape(-1)
    else:
        kind_of = np.dtype(">u2" if top > 255 else "u1")
        body = data[at + 1 : at + 1 + n * kind_of.itemsize]
        if len(body) < n * kind_of.itemsize:
            raise MediaError("cut image")
        values = np.frombuffer(body, kind_of)
        return values.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)
    if bitmap:
        return np.where(values == 1, 0, 255).astype(np.uint8).reshape(shape)
    return values.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)


def encode_pgm(pixels: np.ndarray) -> bytes:
    """An 8-bit grey image as binary PGM, losslessly."""
    height, width = pixels.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as uint8; palettes of greys give (height, width), else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP image")
    start, head, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    used = struct.unpack_from("<I", data, 46)[0]
    flipped, height = height < 0, abs(height)
    if packing or width <= 0 or not height or bits not in (1, 4, 8, 24, 32):
        raise MediaError("a BMP of a kind that isn't read")
    row = (width * bits + 31) // 32 * 4
    if len(data) < start + row * height:
        raise MediaError("cut image")
    lines = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    lines = lines if flipped else lines[::-1]
    if bits >= 24:
        return lines[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1].copy()
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = lines[:, :width]
    else:
        index = np.unpackbits(lines, axis=1)
        if bits == 4:
            index = index.reshape(height, -1, 4) @ np.array([8, 4, 2, 1], np.uint8)
        index = index[:, :width]
    if index.max() >= len(palette):
        raise MediaError("a colour outside the palette")
    grey = (palette[:, :1] == palette).all()
    return palette[index][:, :, 0].copy() if grey else palette[index]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An 8-bit grey image as BMP with a grey palette, losslessly."""
    height, width = pixels.shape
    row = (width + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance by the integer weights 299, 587 and 114 of 1000."""
    if pixels.ndim == 2:
        return pixels
    return (pixels.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def _edges(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(to + 1, dtype=np.int64) * n
    return at // to, at % to


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area of each target pixel, as float64, from one integral image.

    The integral at a fractional edge is linear between its neighbours along each axis, so all sums are of
    integers over ``height * width`` and exact below 2**53.
    """
    if min(pixels.shape[:2]) < 1 or min(height, width) < 1:
        raise MediaError("no pixels")
    if pixels.ndim == 3:
        return np.stack([area_resize(pixels[:, :, k], height, width) for k in range(pixels.shape[2])], axis=2)
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    y, fy = _edges(h, height)
    x, fx = _edges(w, width)
    rows = total[y] * (height - fy)[:, None] + total[np.minimum(y + 1, h)] * fy[:, None]
    both = rows[:, x] * (width - fx)[None, :] + rows[:, np.minimum(x + 1, w)] * fx[None, :]
    return np.diff(np.diff(both, axis=0), axis=1) / (h * w)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: is a pixel of the 9 by 8 reduction brighter than its right neighbour?  Compared in integers, so ties are exact."""
    small = area_resize(grey(pixels), *TILE)
    bits = (np.round(small * pixels.shape[0] * pixels.shape[1]).astype(np.int64)[:, :-1] > np.round(small * pixels.shape[0] * pixels.shape[1]).astype(np.int64)[:, 1:]).reshape(-1)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def to_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(tile), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiles(pixels: np.ndarray, height: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of the image cut into tiles; those at the edges may be smaller."""
    for y in range(0, pixels.shape[0], height):
        for x in range(0, pixels.shape[1], width):
            yield y // height, x // width, to_npy(pixels[y : y + height, x : x + width])


def pad_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAYLOAD_UNIT if raw else PAYLOAD_UNIT)


def store_payload(payload: bytes) -> bytes:
    """The payload as the samples of a PGM of 64 columns."""
    return encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_UNIT))


def features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, height, width, feature (difference hash, 16 hex digits), tile (NPY bytes of the reduction), error."""
    names = [key, "height", "width", "feature", "tile", "error"]

    def run(batches):
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    rows.append((k, None, None, None, None, None))
                    continue
                try:
                    pixels = decode(data)
                    rows.append((k, *pixels.shape[:2], f"{difference_hash(pixels):016x}", to_npy(np.round(area_resize(grey(pixels), *TILE)).astype(np.uint16)), None))
                except MediaError as e:
                    rows.append((k, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], names)

    of = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{media}`").alias("_media"))
    return of.mapInArrow(run, f"`{key}` {dict(of.dtypes)[key]}, height long, width long, feature string, tile binary, error string")


def digest_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as an image, reads it back and digests both; null counts as empty.  One row for each row of df."""
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary()}

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                n, payload = pad_payload(value)
                stored = store_payload(payload)
                pixels = decode(stored)
                back = pixels.tobytes()
                if back != payload:
                    raise MediaError("the stored payload differs")
                tile = to_npy(np.round(area_resize(pixels, *TILE)).astype(np.uint8))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAYLOAD_UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(pixels):016x}", tile))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)]], [key, *kinds])

    of = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return of.mapInArrow(run, f"`{key}` {dict(of.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
