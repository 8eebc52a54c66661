"""Media columns: Netpbm and BMP images to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import stored
from gristmill.llm.tokens import blocks

UNIT = 576
#: The last bytes of a payload that a checksum of its own is taken of.
TAIL = 32
#: Netpbm formats: magic -> (channels, bit samples, plain text)
_PNM = {b"P1": (1, True, True), b"P2": (1, False, True), b"P3": (3, False, True), b"P4": (1, True, False), b"P5": (1, False, False), b"P6": (3, False, False)}


def encode_pnm(pixels: np.ndarray) -> bytes:
    """A binary PGM (h, w) or PPM (h, w, 3) of 8-bit samples."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _header(data: bytes, numbers: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, comments skipped, and where the samples begin."""
    out, at = [], 2
    while len(out) < numbers:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_pnm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 samples scaled to 0..255 (P1, P4: 1 is black), shape (h, w) or (h, w, 3)."""
    if data[:2] not in _PNM:
        raise ValueError("neither Netpbm nor BMP")
    channels, bits, plain = _PNM[data[:2]]
    numbers, at = _header(data, 2 if bits else 3)
    w, h = numbers[:2]
    shape = (h, w) if channels == 1 else (h, w, 3)
    if bits:
        if plain:
            digits = np.frombuffer(data, np.uint8, offset=at - 1)
            values = digits[(digits == 48) | (digits == 49)][: w * h] - 48
        else:
            values = np.unpackbits(np.frombuffer(data, np.uint8, h * (-(-w // 8)), at).reshape(h, -1), axis=1)[:, :w]
        return (255 * (1 - values)).astype(np.uint8).reshape(shape)
    most = numbers[2]
    if plain:
        values = np.array(data[at:].split(), np.int64)[: h * w * channels]
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", h * w * channels, at)
    if most == 255:
        return values.astype(np.uint8).reshape(shape)
    return ((values.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8).reshape(shape)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed BMP: 8-bit grey palette for (h, w), 24-bit for (h, w, 3)."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = np.ascontiguousarray(pixels[::-1] if grey else pixels[::-1, :, ::-1], np.uint8).reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0) + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 and 32-bit BMP as (h, w, 3), or (h, w) where the palette is grey."""
    at, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {depth} bits, compression {packing}")
    stride = (w * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if depth >= 24:
        step = depth // 8
        return np.ascontiguousarray(rows[:, : w * step].reshape(abs(h), w, step)[:, :, 2::-1])
    if depth == 8:
        index = rows[:, :w]
    else:
        parts = np.unpackbits(rows, axis=1).reshape(abs(h), -1, depth)
        index = (parts @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :w]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return np.ascontiguousarray(palette[:, 0][index])
    return np.ascontiguousarray(palette[index])


def decode(data: bytes) -> np.ndarray:
    pixels = decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)
    if not pixels.size:
        raise ValueError("an image without pixels")
    return pixels


#: Rows of an image whose integral image is held at a time.
BAND = 512


def _shrunk(values: np.ndarray, n: int) -> np.ndarray:
    """Along the first axis: the mean of the (fractional) piece of each of n equal parts, from the running sums."""
    size = len(values)
    total = np.concatenate([np.zeros_like(values[:1], np.float64), np.cumsum(values, 0, dtype=np.float64)])
    edge = np.arange(n + 1) * (size / n)
    low = np.minimum(edge.astype(np.int64), size - 1)
    part = (edge - low).reshape([-1] + [1] * (values.ndim - 1))
    return np.diff(total[low] * (1 - part) + total[low + 1] * part, axis=0) / (size / n)


def area_resize(pixels: np.ndarray, h: int, w: int) -> np.ndarray:
    """The mean of the (fractional) source area of each target pixel, from the integral image; float64.

    Rows are shrunk first, a band at a time, so that large images need little more than h x w columns of numbers."""
    bands = [_shrunk(pixels[i : i + BAND].swapaxes(0, 1), w).swapaxes(0, 1) for i in range(0, len(pixels), BAND)]
    return _shrunk(np.concatenate(bands), h)


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8 x 9 reduction is less than the next one to its right."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(2)
    cells = np.rint(area_resize(grey, 8, 9) * 256)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def payload(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes filled up with 255 to a positive multiple of `unit`."""
    return text + b"\xff" * (-len(text) % unit or (0 if text else unit))


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, tile binary, error string"


def encode(raw: bytes, width: int, form: str) -> bytes:
    """A payload as an image of `width` samples a row; form either is bmp or pgm, by the lowest bit of the payload's CRC."""
    pixels = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return encode_bmp(pixels) if form == "bmp" or form == "either" and zlib.crc32(raw) & 1 else encode_pnm(pixels)


def store_as_media(docs: DataFrame, width: int = UNIT, form: str = "either") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty) as an image of `width` samples a row; form pgm, bmp or either,
    which makes a table of both kinds. It is stored in the shared folder.

    An empty text is one row of 255s. Texts of any length become images of as many rows as they need. Rows with equal
    texts get equal media. Other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            media = [encode(payload(x), width, form) for x in raw]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, MEDIA), "media")


def features(data: bytes, tile: int = 16) -> tuple:
    """What read_media gives of one medium, from payload_bytes on."""
    pixels = decode(data)
    raw = pixels.tobytes()
    small = np.rint(area_resize(pixels, tile, tile)).astype(np.uint8)
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), *pixels.shape[:2], npy(small), None


def read_media(media: DataFrame, tile: int = 16) -> DataFrame:
    """Decodes each medium and gives its samples' digests, an NPY tile of tile x tile samples and its difference hash.

    A medium that is null or can't be decoded gives nulls and the reason as error; it doesn't end the job. An image
    without pixels is such a one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media"):
            rows = []
            for key, n, data in zip(*batch.columns, strict=True):
                try:
                    found = features(data.as_buffer().to_pybytes(), tile) if data.is_valid else (None,) * 9 + ("no medium",)
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    found = (None,) * 9 + (f"{type(e).__name__}: {e}",)
                rows.append((key.as_py(), n.as_py(), *found))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(run, FEATURES)
