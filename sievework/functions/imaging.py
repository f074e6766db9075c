"""Image bytes without an imaging library: PNG, BMP and binary PNM pixels, and the headers of JPEG, PNG, GIF, BMP, TIFF and WebP with their EXIF fields. A caller with a decoder of its own passes it in its place."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETAILS = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("camera_make", T.StringType()), T.StructField("camera_model", T.StringType()), T.StructField("taken_raw", T.StringType()), T.StructField("frame_count", T.IntegerType())])
_SIDEWAYS = (5, 6, 7, 8)
# EXIF tags.
MAKE, MODEL, ORIENTATION, EXIF_IFD, TAKEN = 0x010F, 0x0110, 0x0112, 0x8769, 0x9003
WIDTH, HEIGHT = 0x0100, 0x0101


def _png_chunks(b: bytes):
    at = 8
    while at + 8 <= len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        yield kind, b[at + 8 : at + 8 + n]
        at += 12 + n


def png_pixels(b: bytes) -> np.ndarray:
    """height x width x channels of a PNG that isn't interlaced, 8 bits a sample."""
    head, data, palette = None, [], None
    for kind, body in _png_chunks(b):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a kind of PNG that isn't read")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel()
        elif kind in (3, 4):
            for x in range(len(line)):
                left = int(line[x - channels]) if x >= channels else 0
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = int(above[x - channels]) if x >= channels else 0
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                line[x] = (line[x] + guess) & 255
        elif kind:
            raise ValueError("unknown PNG filter")
        above = line & 255
        out[y] = above
    out = out.reshape(height, width, channels)
    return palette[out[:, :, 0]] if head[3] == 3 and palette is not None else out


def bmp_pixels(b: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", b, 10)
    width, height = struct.unpack_from("<ii", b, 18)
    bits, packing = struct.unpack_from("<HI", b, 28)
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError("a kind of BMP that isn't read")
    row = (width * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(b, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return a[::-1] if height > 0 else a


def pnm_pixels(b: bytes) -> np.ndarray:
    m = re.match(rb"(P[56])\s+(\d+)\s+(\d+)\s+255\s", b)
    if not m:
        raise ValueError("a kind of PNM that isn't read")
    channels = 1 if m[1] == b"P5" else 3
    return np.frombuffer(b, np.uint8, int(m[2]) * int(m[3]) * channels, m.end()).reshape(int(m[3]), int(m[2]), channels)


def pixels(b: bytes) -> np.ndarray:
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return png_pixels(b)
    if b[:2] == b"BM":
        return bmp_pixels(b)
    if b[:2] in (b"P5", b"P6"):
        return pnm_pixels(b)
    raise ValueError("no decoder for these bytes")


def grey_image(b: bytes) -> np.ndarray:
    """Luma of an image, upright by its EXIF orientation."""
    a = pixels(b)
    grey = a[:, :, 0] if a.shape[2] < 3 else np.rint(a[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
    return upright(grey, header(b)[6] or 1)


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    if orientation in (2, 4, 5, 7) :
        a = {2: lambda x: x[:, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.T, 7: lambda x: x[::-1, ::-1].T}[orientation](a)
    elif orientation in (3, 6, 8):
        a = np.rot90(a, {3: 2, 6: -1, 8: 1}[orientation])
    return a


def tiff_fields(b: bytes, at: int = 0) -> tuple[dict[int, object], int]:
    """The fields of the first directory and of its EXIF directory, and the number of directories."""
    order = {b"II": "<", b"MM": ">"}.get(b[at : at + 2])
    if order is None:
        return {}, 0
    found: dict[int, object] = {}

    def read(pos: int, into: dict) -> int:
        n, = struct.unpack_from(order + "H", b, at + pos)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", b, at + pos + 2 + 12 * i)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4}.get(kind, 0) * count
            place = at + pos + 10 + 12 * i
            if size > 4:
                place = at + struct.unpack_from(order + "I", b, place)[0]
            if kind == 2:
                into.setdefault(tag, b[place : place + count].decode("latin-1"))
            elif kind in (3, 4) and count:
                into.setdefault(tag, struct.unpack_from(order + ("H" if kind == 3 else "I"), b, place)[0])
        return struct.unpack_from(order + "I", b, at + pos + 2 + 12 * n)[0]

    frames = 0
    try:
        pos, seen = struct.unpack_from(order + "I", b, at + 4)[0], set()
        while pos and pos not in seen:
            seen.add(pos)
            pos = read(pos, found if not frames else {})
            frames += 1
        if isinstance(found.get(EXIF_IFD), int):
            read(found[EXIF_IFD], found)
    except struct.error:
        pass
    return found, frames


def header(b: bytes) -> tuple:
    """width, height, make, model, time taken (as written), frames, orientation, from the header alone; nulls where it doesn't tell."""
    width = height = None
    fields: dict[int, object] = {}
    frames = 1
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        for kind, body in _png_chunks(b):
            if kind == b"IHDR":
                width, height = struct.unpack(">II", body[:8])
            elif kind == b"acTL":
                frames = struct.unpack(">I", body[:4])[0]
            elif kind == b"eXIf":
                fields, _ = tiff_fields(body)
    elif b[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(b) and b[at] == 0xFF:
            mark, n = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", b[at + 5 : at + 9])
                break
            if mark == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
                fields, _ = tiff_fields(b[at + 10 : at + 2 + n])
            at += 2 + n
    elif b[:6] in (b"GIF87a", b"GIF89a"):
        width, height = struct.unpack("<HH", b[6:10])
        at = 13 + (3 * 2 ** ((b[10] & 7) + 1) if b[10] & 0x80 else 0)
        frames = 0
        while at < len(b) and b[at] != 0x3B:
            if b[at] == 0x2C:
                frames += 1
                at += 10 + (3 * 2 ** ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0) + 1
            elif b[at] == 0x21:
                at += 2
            else:
                break
            while at < len(b) and b[at]:
                at += 1 + b[at]
            at += 1
        frames = max(1, frames)
    elif b[:2] == b"BM":
        width, height = struct.unpack_from("<ii", b, 18)
        height = abs(height)
    elif b[:2] in (b"II", b"MM"):
        fields, frames = tiff_fields(b)
        width, height = fields.get(WIDTH), fields.get(HEIGHT)
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP" and b[12:16] == b"VP8X":
        width, height = (int.from_bytes(b[24 + 3 * i : 27 + 3 * i], "little") + 1 for i in range(2))
        frames = max(1, b.count(b"ANMF"))
    elif m := re.match(rb"P[56]\s+(\d+)\s+(\d+)\s", b):
        width, height = int(m[1]), int(m[2])
    turn = fields.get(ORIENTATION)
    if turn in _SIDEWAYS:
        width, height = height, width
    text = lambda tag: (str(fields.get(tag) or "").strip(" \0\t\r\n") or None)
    return width, height, text(MAKE), text(MODEL), text(TAKEN), frames, turn


@F.pandas_udf(DETAILS)
def details_udf(content: pd.Series) -> pd.DataFrame:
    """Displayed size, camera, raw time taken and frames; exif_date() reads the time."""
    rows = []
    for b in content:
        try:
            rows.append(header(bytes(b))[:6])
        except (struct.error, TypeError, IndexError, ValueError):
            rows.append((None,) * 6)
    return pd.DataFrame(rows, columns=[f.name for f in DETAILS.fields]).astype({"width": "Int32", "height": "Int32", "frame_count": "Int32"})
