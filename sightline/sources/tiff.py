"""Single-band GeoTIFF files in the azimuthal equidistant projection, read by bands of rows and written row by row.

Read are classic and Big TIFF, of either byte order, in strips or tiles, as they
are or packed by Deflate, LZW or PackBits, with or without differencing.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..functions.geodesy import projection_strings

# TIFF tags and types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GEO_ASCII = 33550, 33922, 34735, 34737
SHORT, LONG, DOUBLE, ASCII, LONG8 = 3, 4, 12, 2, 16
SIZES = {1: "B", ASCII: "s", SHORT: "H", LONG: "I", 9: "i", 11: "f", DOUBLE: "d", LONG8: "Q"}
KINDS = {(2, 16): np.int16, (1, 16): np.uint16, (3, 32): np.float32}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
#: Files beyond this size are written as Big TIFF.
CLASSIC_BYTES = (1 << 32) - (1 << 20)


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    dtype: np.dtype
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    block: tuple[int, int]  # columns and rows of a strip or tile
    packing: int
    predictor: int
    pixel: tuple[float, float]
    origin: tuple[float, float]
    projection: str

    @property
    def scale(self) -> float:
        return self.pixel[0]

    @property
    def centre(self) -> tuple[float, float]:
        """In metres, from the top left corner and half the extent."""
        return self.origin[0] + self.width * self.pixel[0] / 2, self.origin[1] - self.height * self.pixel[1] / 2

    def lonlat(self) -> tuple[float, float]:
        """The anchor of the projection, on which the raster must be centred."""
        if max(map(abs, self.centre)) > 0.001:
            raise ValueError(f"the raster's centre {self.centre} is not the origin of its projection")
        found = {k: float(v) for k, v in re.findall(r"\+(l(?:at|on)_0)=([^\s|]+)", self.projection)}
        if len(found) != 2:
            raise ValueError("the projection names no lat_0 and lon_0")
        return found["lon_0"], found["lat_0"]


def _tags(path: str) -> tuple[str, dict]:
    """Byte order and tags of the first picture of a file."""
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read(2))
        magic = struct.unpack(order + "H", f.read(2))[0] if order else 0
        if magic not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = magic == 43
        if big:
            f.read(4)
        word, entry, many = ("Q", "HHQ", "Q") if big else ("I", "HHI", "H")
        room = struct.calcsize(word)
        f.seek(struct.unpack(order + word, f.read(room))[0])
        size = struct.calcsize("=" + entry) + room
        entries = [f.read(size) for _ in range(struct.unpack(order + many, f.read(struct.calcsize(many)))[0])]
        tags = {}
        for e in entries:
            tag, kind, n = struct.unpack(order + entry, e[: size - room])
            if kind not in SIZES:
                continue
            long = struct.calcsize(SIZES[kind]) * n
            raw = e[size - room :][:long]
            if long > room:
                f.seek(struct.unpack(order + word, e[size - room :])[0])
                raw = f.read(long)
            tags[tag] = raw.rstrip(b"\0").decode() if kind == ASCII else struct.unpack(f"{order}{n}{SIZES[kind]}", raw)
    return order, tags


def read_header(path: str) -> Header:
    """Header of a file that must be one square band with square pixels."""
    order, tags = _tags(path)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("only one band can be read")
    packing = one(COMPRESSION, PLAIN)
    if packing not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS):
        raise ValueError(f"compression {packing} cannot be read")
    kind = KINDS.get((one(FORMAT, 1), one(BITS, 1)))
    if kind is None:
        raise ValueError("bands must be Int16, UInt16 or Float32")
    predictor = one(PREDICTOR, 1)
    if predictor not in (1, 2) and (predictor, kind) != (3, np.float32):
        raise ValueError(f"predictor {predictor} cannot be read")
    width, height, pixel = one(WIDTH, 0), one(HEIGHT, 0), tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0))
    if width != height or f"{pixel[0]:.10f}" != f"{pixel[1]:.10f}":
        raise ValueError("the raster and its pixels must be square")
    tie = tags.get(TIE_POINT, (0, 0, 0, -width * pixel[0] / 2, height * pixel[1] / 2, 0))
    tiled = TILE_OFFSETS in tags
    block = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(ROWS, height)))
    offsets = tags[TILE_OFFSETS if tiled else OFFSETS]
    dtype = np.dtype(kind).newbyteorder(order)
    counts = tags.get(TILE_COUNTS if tiled else COUNTS, (block[0] * block[1] * dtype.itemsize,) * len(offsets))
    return Header(width, height, dtype, offsets, counts, block, packing, predictor, pixel[:2], (tie[3], tie[4]), tags.get(GEO_ASCII, ""))


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, before = list(single), [], b""
    bits = held = 0
    width = 9
    for byte in raw:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, before, width = list(single), b"", 9
            continue
        said = table[code] if code < len(table) else before + before[:1]
        out.append(said)
        if before:
            table.append(before + said[:1])
            # One earlier than the table needs it, as the format has it.
            width = min(12, (len(table) + 1).bit_length())
        before = said
    return b"".join(out)


def unpack_bits(raw: bytes) -> bytes:
    """PackBits: a count, then so many bytes as they are, or one byte to repeat."""
    out, at = [], 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out.append(raw[at + 1 : at + n + 2])
            at += n + 2
        else:
            if n > 128:
                out.append(raw[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def _block(raw: bytes, header: Header, rows: int) -> np.ndarray:
    """The values of a strip or tile (rows x columns)."""
    if header.packing in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif header.packing == LZW:
        raw = unpack_lzw(raw)
    elif header.packing == PACK_BITS:
        raw = unpack_bits(raw)
    columns, size = header.block[0], header.dtype.itemsize
    raw = raw[: rows * columns * size]
    if header.predictor == 3:  # bytes of a row by significance, then differenced
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, columns * size), axis=1, dtype=np.uint8).reshape(rows, size, columns)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">f4")[..., 0].astype(np.float32)
    values = np.frombuffer(raw, header.dtype).reshape(rows, columns)
    if header.predictor == 2:
        whole = f"u{size}"
        values = np.cumsum(values.astype(values.dtype.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(values.dtype.newbyteorder("="))
    return values


def read_rows(path: str, header: Header, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows start to stop."""
    columns, high = header.block
    across = -(-header.width // columns)
    strips = columns == header.width and across == 1
    with open(path, "rb") as f:
        if strips and header.packing == PLAIN and header.predictor == 1:  # only the rows asked for
            size = header.width * header.dtype.itemsize
            for row in range(start, stop):
                f.seek(header.offsets[row // high] + row % high * size)
                yield np.frombuffer(f.read(size), header.dtype)
            return
        for down in range(start // high, -(-stop // high)):
            # The last strip may be short; tiles never are.
            rows = min(high, header.height - down * high) if strips else high
            blocks = []
            for k in range(down * across, (down + 1) * across):
                f.seek(header.offsets[k])
                blocks.append(_block(f.read(header.counts[k]), header, rows))
            band = np.concatenate(blocks, axis=1)[:, : header.width] if across > 1 else blocks[0][:, : header.width]
            for row in range(max(start, down * high), min(stop, (down + 1) * high, header.height)):
                yield band[row - down * high]


def elevations(values: np.ndarray) -> np.ndarray:
    """Int16 as it is; UInt16 less 32767, which must fit."""
    if values.dtype.kind == "u":
        moved = values.astype(np.int32) - 32767
        if moved.max(initial=0) > 32767:
            raise ValueError("an elevation does not fit 16 bits")
        return moved.astype(np.int16)
    if values.dtype.kind != "i":
        raise ValueError("elevations must be Int16 or UInt16")
    return values.astype(np.int16)


def write(path: str, width: int, scale: float, lonlat: tuple[float, float], rows: Iterator[np.ndarray], dtype=np.float32) -> None:
    """Write rows as they come; the grid is centred on the projection's origin."""
    dtype = np.dtype(dtype).newbyteorder("<")
    sample_format, bits = next(k for k, v in KINDS.items() if np.dtype(v) == np.dtype(dtype.type))
    half = width * scale / 2
    projection = (projection_strings(*lonlat)[1] + "|").encode() + b"\0"
    size = width * width * dtype.itemsize
    big = size > CLASSIC_BYTES
    word, room = ("Q", 8) if big else ("I", 4)
    place = LONG8 if big else LONG
    entries = [
        (WIDTH, LONG, (width,)), (HEIGHT, LONG, (width,)), (BITS, SHORT, (bits,)), (COMPRESSION, SHORT, (1,)), (PHOTOMETRIC, SHORT, (1,)),
        (OFFSETS, place, (0,)), (SAMPLES, SHORT, (1,)), (ROWS, LONG, (width,)), (COUNTS, place, (size,)), (FORMAT, SHORT, (sample_format,)),
        (PIXEL_SCALE, DOUBLE, (scale, scale, 0.0)), (TIE_POINT, DOUBLE, (0.0, 0.0, 0.0, -half, half, 0.0)),
        (GEO_KEYS, SHORT, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 1026, GEO_ASCII, len(projection) - 1, 0)), (GEO_ASCII, ASCII, projection),
    ]
    at = (16 + 8 + 20 * len(entries) + 8) if big else (8 + 2 + 12 * len(entries) + 4)
    blobs, placed = b"", []
    for tag, kind, values in entries:
        raw = values if kind == ASCII else struct.pack(f"<{len(values)}{SIZES[kind]}", *values)
        placed.append((tag, kind, len(values), raw if len(raw) <= room else at + len(blobs)))
        blobs += raw + b"\0" * (len(raw) % 2) if len(raw) > room else b""
    data = at + len(blobs)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(placed)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(placed)))
        for tag, kind, n, value in placed:
            value = data if tag == OFFSETS else value
            f.write(struct.pack("<HH" + word, tag, kind, n) + (struct.pack("<" + word, value) if isinstance(value, int) else value.ljust(room, b"\0")))
        f.write(struct.pack("<" + word, 0) + blobs)
        seen = 0
        for row in rows:
            if len(row) != width:
                raise ValueError("a row has the wrong width")
            f.write(np.asarray(row).astype(dtype).tobytes())
            seen += 1
    if seen != width:
        raise ValueError(f"{seen} rows for a grid of {width}")
