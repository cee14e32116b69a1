"""Image files: PNG, BMP, TIFF and TGA, to pixels and back, without an imaging library.

Pixels are BGRA, 4 bytes each, rows from the top. Files come through ``binaryFile`` and
are decoded one file at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PIXELS = "path string, width int, height int, bgra binary, bits int, reason string"


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _shaped(bgra: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(bgra, np.uint8).reshape(height, width, 4)


def to_png(bgra: bytes, width: int, height: int) -> bytes:
    rgba = _shaped(bgra, width, height)[..., [2, 1, 0, 3]]
    lines = np.zeros((height, 1 + width * 4), np.uint8)
    lines[:, 1:] = rgba.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows without their filters.

    A pixel needs those to its left, above and above left. Where rows name the filters that
    need both sides, all pixels with the same sum of row and column are ready together, so
    there is one step for each such sum; else a row is ready at once.
    """
    how, raw = lines[:, 0].astype(np.int32), lines[:, 1:].reshape(len(lines), width, step).astype(np.int32)
    height = len(lines)
    out = np.zeros((height + 1, width + 1, step), np.int32)  # a row above and a column before are zero
    if (how > 2).any():
        for at in range(height + width - 1):
            y = np.arange(max(0, at - width + 1), min(height, at + 1))
            x, kind = at - y, how[y][:, None]
            a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
            near = a + b - c
            da, db, dc = abs(near - a), abs(near - b), abs(near - c)
            paeth = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
            out[y + 1, x + 1] = (raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, paeth], 0)) & 255
    else:
        for y in range(height):
            line = np.cumsum(raw[y], axis=0) if how[y] == 1 else raw[y] + out[y, 1:] if how[y] == 2 else raw[y]
            out[y + 1, 1:] = line & 255
    return out[1:, 1:].reshape(height, width * step).astype(np.uint8)


def from_png(data: bytes) -> tuple[int, int, bytes]:
    """8-bit gray, RGB, palette, gray-alpha or RGBA, not interlaced."""
    at, idat, palette, clear = 8, [], b"", b""
    width = height = depth = kind = interlace = 0
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            idat.append(body)
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    out = _unfiltered(np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, 1 + width * step), width, step)
    px = out.reshape(height, width, step)
    bgra = np.full((height, width, 4), 255, np.uint8)
    if kind in (0, 4):
        bgra[..., :3] = px[..., :1]
    elif kind == 3:
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        bgra[..., :3] = colours[px[..., 0]][..., ::-1]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            bgra[..., 3] = alpha[px[..., 0]]
    else:
        bgra[..., :3] = px[..., 2::-1]
    if kind in (4, 6):
        bgra[..., 3] = px[..., -1]
    return width, height, bgra.tobytes()


def to_bmp(bgra: bytes, width: int, height: int) -> bytes:
    """32 bits a pixel, rows from the bottom."""
    body = _shaped(bgra, width, height)[::-1].tobytes()
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 32, 0, len(body), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + info + body


def from_bmp(data: bytes) -> tuple[int, int, bytes]:
    start, width, height, bits = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    step = bits // 8
    line = -(-width * step // 4) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * step].reshape(abs(height), width, step)
    bgra = np.full((abs(height), width, 4), 255, np.uint8)
    bgra[..., :step] = rows
    return width, abs(height), (bgra[::-1] if height > 0 else bgra).tobytes()


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, widened one code early."""
    clear, end = 256, 257
    table = {bytes([i]): i for i in range(256)}
    out, bits, held, width, following = bytearray(), 0, 0, 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
        bits &= (1 << held) - 1

    put(clear)
    known = b""
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if longer in table:
            known = longer
            continue
        put(table[known])
        table[longer] = following
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
        if following >= 4094:
            put(clear)
            table = {bytes([j]): j for j in range(256)}
            width, following = 9, 258
        known = data[i : i + 1]
    if known:
        put(table[known])
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(end)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, table, width = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9
    last, bits, held = b"", 0, 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("an LZW code that no table has")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
    return bytes(out)


def to_tiff(bgra: bytes, width: int, height: int) -> bytes:
    """One LZW strip of RGBA."""
    strip = lzw(_shaped(bgra, width, height)[..., [2, 1, 0, 3]].tobytes())
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 4, 0), (259, 3, 1, 5), (262, 3, 1, 2), (273, 4, 1, 0), (277, 3, 1, 4), (278, 4, 1, height), (279, 4, 1, len(strip)), (338, 3, 1, 2)]
    after = 8 + 2 + 12 * len(tags) + 4
    values = {258: after, 273: after + 8}
    entries = b"".join(struct.pack("<HHI", t, kind, n) + (struct.pack("<HH", v, 0) if kind == 3 and n == 1 else struct.pack("<I", values.get(t, v))) for t, kind, n, v in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + struct.pack("<4H", 8, 8, 8, 8) + strip


def from_tiff(data: bytes) -> tuple[int, int, bytes]:
    """Strips of 8-bit gray, RGB or RGBA samples, plain or LZW, either byte order, first page."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    sizes, tags = {1: "B", 3: "H", 4: "I"}, {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in sizes:
            size = struct.calcsize(sizes[kind]) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = struct.unpack(f"{order}{n}{sizes[kind]}", data[place : place + size])
    first = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples, packing = first(256, 0), first(257, 0), first(277, 1), first(259, 1)
    if set(tags.get(258, (1,))) != {8} or packing not in (1, 5) or first(284, 1) != 1 or first(317, 1) != 1 or samples not in (1, 3, 4) or first(262, 1) not in (0, 1, 2):
        raise ValueError("only TIFF files of 8-bit samples side by side, plain or LZW, are read")
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279])]
    px = np.frombuffer(b"".join(map(unlzw, strips)) if packing == 5 else b"".join(strips), np.uint8, width * height * samples).reshape(height, width, samples)
    bgra = np.full((height, width, 4), 255, np.uint8)
    bgra[..., :3] = (255 - px if first(262, 1) == 0 else px) if samples == 1 else px[..., 2::-1]
    if samples == 4:
        bgra[..., 3] = px[..., 3]
    return width, height, bgra.tobytes()


def to_tga(bgra: bytes, width: int, height: int) -> bytes:
    """Uncompressed, 32 bits a pixel, rows from the top."""
    return bytes([0, 0, 2]) + bytes(9) + struct.pack("<HHBB", width, height, 32, 0x28) + bytes(bgra)


def from_tga(data: bytes) -> tuple[int, int, bytes]:
    """Uncompressed TGA of 24 or 32 bits a pixel."""
    skip, _, kind = data[0], data[1], data[2]
    width, height, bits, flags = struct.unpack("<HHBB", data[12:18])
    if kind != 2 or bits not in (24, 32):
        raise ValueError("only uncompressed TGA files of 24 or 32 bits are read")
    step = bits // 8
    px = np.frombuffer(data, np.uint8, width * height * step, 18 + skip).reshape(height, width, step)
    bgra = np.full((height, width, 4), 255, np.uint8)
    bgra[..., :step] = px
    return width, height, (bgra if flags & 32 else bgra[::-1]).tobytes()


def decode_file(data: bytes) -> tuple[int, int, bytes]:
    if data[:4] == b"\x89PNG":
        return from_png(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return from_tiff(data)
    if data[:2] == b"BM":
        return from_bmp(data)
    if len(data) >= 18 and data[1] == 0 and data[2] == 2 and data[16] in (24, 32):
        return from_tga(data)
    raise ValueError("no PNG, BMP, TIFF or TGA file that is read here")


def decoded(data: bytes | None) -> tuple:
    """width, height, bgra, bits a pixel (32 if some pixel isn't opaque, else 24) and why a file gives no image."""
    try:
        width, height, bgra = decode_file(bytes(data or b""))
    except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
        return None, None, None, None, str(e) or type(e).__name__
    return width, height, bgra, 24 if (np.frombuffer(bgra, np.uint8)[3::4] == 255).all() else 32, None


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, bgra, bits and reason of the files under a path; a file that gives no image has a reason only."""
    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = pd.DataFrame([(p, *decoded(c)) for p, c in zip(rows["path"], rows["content"])], columns=["path", "width", "height", "bgra", "bits", "reason"])
            yield out.astype({c: "Int32" for c in ("width", "height", "bits")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(some, PIXELS)


def encode_images(pixels: DataFrame, kind: str = "png") -> DataFrame:
    """``pixels`` (img, width, height, bgra) with file, its bytes as PNG, BMP, TIFF or TGA."""
    make = {"png": to_png, "bmp": to_bmp, "tiff": to_tiff, "tga": to_tga}[kind]

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            yield rows.assign(file=[make(b, int(w), int(h)) for b, w, h in zip(rows["bgra"], rows["width"], rows["height"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema.fields)
    return pixels.mapInPandas(some, f"{fields}, file binary")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and length of files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")
