"""Image files as rows: size and EXIF orientation from the headers, down-sampled and upright brightness of the pixels.

Files come from the binaryFile source, whose partitions are by file size; their bytes are parsed in Arrow batches. A file that can't be
read, is cut off or is of another kind gives nulls, never an error; an empty file has no row in that source.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most that a side is decoded to, and the degrees by which EXIF orientations are turned.
MOST_SIDE, DEGREES = 4096, {3: 180, 6: 90, 8: 270}

HEADER = "path string, kind string, width int, height int, orientation int"
PIXELS = "path string, width int, height int, sample int, luma binary"


def read(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """path, modificationTime, length, content of the image files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def exif_orientation(tiff: bytes) -> int:
    """The orientation tag of a TIFF block; 1 where there is none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
        if tag == 0x0112 and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG file."""
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        yield name, data[at + 8 : at + 8 + size]
        at += 12 + size


def header(data: bytes) -> tuple[str, int, int, int] | None:
    """kind, width, height and orientation of a JPEG or PNG file; None for anything else."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            width, height = struct.unpack_from(">II", data, 16)
            turned = next((exif_orientation(c) for n, c in _chunks(data) if n == b"eXIf"), 1)
            return ("png", width, height, turned) if data[12:16] == b"IHDR" and width and height else None
        if data[:2] != b"\xff\xd8":
            return None
        at, turned = 2, 1
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if data[at] != 0xFF or size < 2:
                return None
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                turned = exif_orientation(data[at + 10 : at + 2 + size])
            # a start of frame that is none of the tables among them
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return ("jpeg", width, height, turned) if width and height else None
            at += 2 + size
    except (IndexError, struct.error):
        return None


def headers(files: DataFrame) -> DataFrame:
    """path, kind, width, height, orientation (1 to 8) of files (path, content); nulls where the header can't be read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [header(x) if x is not None else None for x in b.column("content").to_pylist()]
            columns = [pa.array([f[k] if f else None for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("path"), *columns], names=["path", "kind", "width", "height", "orientation"])

    return files.select("path", "content").mapInArrow(parse, HEADER)


def sample_size(width: Column, height: Column, most_w: Column, most_h: Column, always: bool = False) -> Column:
    """The power of two by which both sides are divided so that half of each stays at or above what is asked for; 1 for small images.

    With always the halves are compared for any image, not only for one larger than asked for on some side.
    """
    # how often a half can be halved again: the bits of the quotient
    times = lambda side, most: F.when(F.floor(side / 2) < most, 0).otherwise(F.length(F.bin(F.floor(F.floor(side / 2) / most))))
    steps = F.least(times(width, F.greatest(most_w, F.lit(1))), times(height, F.greatest(most_h, F.lit(1))))
    size = F.pow(F.lit(2), steps).cast("int")
    return size if always else F.when((width > most_w) | (height > most_h), size).otherwise(F.lit(1))


def rotation(orientation: Column) -> Column:
    """Degrees clockwise for an EXIF orientation; mirrored ones are not turned."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in DEGREES.items() for x in p)), orientation), F.lit(0))


def upright_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height after the turn that the orientation asks for."""
    lying = rotation(orientation) % 180 == 90
    return F.when(lying, height).otherwise(width), F.when(lying, width).otherwise(height)


def png_luma(data: bytes) -> np.ndarray | None:
    """Brightness (0 to 255) of an 8-bit, not interlaced PNG of grey, colour, palette or with alpha; None for others."""
    width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or per is None:
        return None
    parts = dict.fromkeys((b"IDAT", b"PLTE"), b"")
    for name, body in _chunks(data):
        if name in parts:
            parts[name] += body
    raw = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * per)
    out = np.zeros((height, width * per), np.uint8)
    above = np.zeros(width * per, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.cumsum(line.reshape(width, per), axis=0, dtype=np.uint8).ravel()
        elif kind:
            for x in range(len(line)):
                left, up, corner = (int(line[x - per]) if x >= per else 0), int(above[x]), (int(above[x - per]) if x >= per else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    pixels = out.reshape(height, width, per).astype(np.int64)
    if colour == 3:
        pixels = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]].astype(np.int64)
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return (pixels[:, :, :3] @ np.array([299, 587, 114])) // 1000


def shrunk(a: np.ndarray, n: int) -> np.ndarray:
    """The means of n x n blocks (smaller ones at the right and lower edge), rounded down."""
    if n == 1:
        return a
    rows, cols = np.arange(0, a.shape[0], n), np.arange(0, a.shape[1], n)
    sums = np.add.reduceat(np.add.reduceat(a, rows, axis=0), cols, axis=1)
    return sums // (np.diff(np.append(rows, a.shape[0]))[:, None] * np.diff(np.append(cols, a.shape[1]))[None, :])


def pixels(files: DataFrame, most: int = MOST_SIDE) -> DataFrame:
    """path, width, height, sample, luma: files (path, content) decoded, divided by their sample size and turned upright; luma is row-major, a byte a pixel.

    PNG files are decoded here; for JPEG files, which need a codec that the library does not bring, and for broken ones
    luma and sizes are null. A task holds one image beside its batch.
    """

    def one(data: bytes | None, sample: int | None) -> tuple[int, int, bytes] | None:
        try:
            found = header(data or b"")
            luma = png_luma(data) if found and found[0] == "png" else None
            if luma is None:
                return None
            small = np.rot90(shrunk(luma, sample), -DEGREES.get(found[3], 0) // 90)
            return small.shape[1], small.shape[0], small.astype(np.uint8).tobytes()
        except (IndexError, ValueError, struct.error, zlib.error):
            return None

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data, sample in zip(*(b.column(c).to_pylist() for c in ("path", "content", "sample")), strict=True):
                found = one(data, sample or 1)
                row = {"path": [path], "width": [found and found[0]], "height": [found and found[1]], "sample": [sample if found else None], "luma": [found and found[2]]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("sample", pa.int32()), ("luma", pa.binary())]))

    sized = headers(files).select("path", sample_size(F.col("width"), F.col("height"), F.lit(most), F.lit(most)).cast("int").alias("sample"))
    return files.select("path", "content").join(sized, "path").mapInArrow(decode, PIXELS)
