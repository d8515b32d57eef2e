"""Media columns: Netpbm and BMP images as numpy arrays, area-resized and hashed, stored as NPY tiles.

Images are decoded to (height, width, channels) arrays of 8-bit samples. Resizing takes exact area means from an integral
image, read at fractional corners by bilinear interpolation. A difference hash compares neighbours of a small grey image.

`media_columns` returns tiles; `op4_media_columns` stores texts as PPM and returns digests of what it has stored.

Defined results: null bytes, an unknown or broken format, samples above the header's greatest and headers that claim more
than the file holds decode to None and give null columns; a null text is an empty
text; equal payloads give equal columns; images of one row or column are resized like others.
"""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import crc, map_arrow, table

#: Bytes of one row of a text image: 64 pixels of 3 samples.
ROW = 192
#: Side of the square NPY tiles.
TILE = 16
#: Digits of a number in a Netpbm header.
MOST_DIGITS = 9


def header_numbers(data: bytes, need: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header, and where they end; comments run to the ends of their lines."""
    numbers: list[int] = []
    at = 2
    while len(numbers) < need:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if not 0 < end - at <= MOST_DIGITS:
            raise ValueError("not a number")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with at most 8 bits a sample, which are brought to 0 to 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = header_numbers(data, 2 if bitmap else 3)
    width, height, top = *numbers[:2], 1 if bitmap else numbers[2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    size = width * height * depth
    if not 0 < top <= 255 or not size:
        raise ValueError("only images of 8-bit samples")
    if size > 8 * (len(data) - at):  # a sample takes a bit at least, so nothing larger than the file is made
        raise ValueError("less data than the header says")
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, size, at + 1)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    elif kind == b"P1":
        bits = np.frombuffer(data, np.uint8, offset=at)
        flat = 1 - (bits[(bits == 48) | (bits == 49)][:size] - 48)
    else:
        samples = data[at:].split(maxsplit=size)[:size]
        if any(len(x) > 3 or not x.isdigit() for x in samples):
            raise ValueError("a sample is no number")
        flat = np.array(samples, np.uint16)
    if len(flat) != size or int(flat.max()) > top:
        raise ValueError("a sample is missing or above the greatest")
    out = flat.reshape(height, width, depth)
    return out.astype(np.uint8, copy=False) if top == 255 else (out.astype(np.uint16) * 255 // top).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits."""
    start = struct.unpack_from("<I", data, 10)[0]
    header, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if data[:2] != b"BM" or packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("not a plain BMP")
    stride, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    if start < 14 + header or stride * rows > len(data) - start:
        raise ValueError("less data than the header says")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)
        out = palette[raw[:, :width]][:, :, 2::-1]
    else:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode(data: bytes | None) -> np.ndarray | None:
    """The image in `data`, or None."""
    try:
        return None if not data else decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, struct.error, IndexError, OverflowError):
        return None


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area means as float64, by an integral image."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    whole = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, pixels.shape[2]))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

    def at(a: np.ndarray, n: int, axis: int) -> np.ndarray:
        where = np.arange(n + 1) * ((a.shape[axis] - 1) / n)
        low = np.minimum(where.astype(np.int64), a.shape[axis] - 2)
        part = (where - low).reshape([-1 if i == axis else 1 for i in range(3)])
        return a.take(low, axis) * (1 - part) + a.take(low + 1, axis) * part

    sums = at(at(whole, height, 0), width, 1)
    boxes = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return boxes / ((pixels.shape[0] / height) * (pixels.shape[1] / width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 grey area means is less than its right neighbour."""
    grey = area_resize(pixels, 8, 9).mean(axis=2).round(6)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.floor(area_resize(pixels, side, side) + 0.5), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_columns(df: DataFrame, image: str = "image", key: str = "id", side: int = TILE) -> DataFrame:
    """For a column of image bytes: key, width, height, channels, tile (NPY bytes), dhash; nulls where nothing decodes."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        pixels = [decode(x) for x in cols["image"]]
        got = lambda f: [None if p is None else f(p) for p in pixels]
        return {"id": cols["id"], "width": got(lambda p: p.shape[1]), "height": got(lambda p: p.shape[0]), "channels": got(lambda p: p.shape[2]), "tile": got(lambda p: npy_tile(p, side)), "dhash": got(difference_hash)}

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.selectExpr(f"`{key}` AS id", f"`{image}` AS image"), make, f"id {kind}, width long, height long, channels long, tile binary, dhash string")


def text_image(raw: bytes) -> bytes:
    """A text's bytes, padded with spaces to whole rows, as a PPM of 64 pixels a row."""
    size = max(ROW, -(-len(raw) // ROW) * ROW)
    return encode_ppm(np.frombuffer(raw.ljust(size, b" "), np.uint8).reshape(-1, ROW // 3, 3))


def text_media(docs: DataFrame) -> DataFrame:
    """Texts stored as images: doc_id, n_bytes, media (PPM), tile (NPY), dhash."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        raw = [(t or "").encode() for t in cols["text"]]
        media = [text_image(r) for r in raw]
        pixels = [decode_netpbm(m) for m in media]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(r) for r in raw], "media": media, "tile": [npy_tile(p) for p in pixels], "dhash": [difference_hash(p) for p in pixels]}

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary, tile binary, dhash string")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text stored as a PPM, read back from the stored bytes, with digests and a difference hash."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")}
        for i, text in zip(cols["doc_id"], cols["text"], strict=True):
            raw = (text or "").encode()
            media = text_image(raw)
            pixels = decode_netpbm(media)
            payload = pixels.tobytes()
            row = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), hashlib.sha256(npy_tile(pixels)).hexdigest())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return out

    return map_arrow(table(spark, sf_dir, "documents").select("doc_id", "text"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
