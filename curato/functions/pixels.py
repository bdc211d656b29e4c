"""Numeric kernels over decoded pictures: resampling, hashes, descriptors, orientation, colour and PNG bytes.

Pictures are arrays (height, width, channels) of bytes, red first; kernels with a leading dimension take many at once.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

# Weights of red, green and blue in the brightness, of 65536.
LUMA = np.array([19595, 38470, 7471], np.int64)
#: Bits of a resampling weight.
PRECISION = 22


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _windowed_sinc(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


_FILTERS = {"bicubic": (_cubic, 2.0), "lanczos": (_windowed_sinc, 3.0)}


@lru_cache(maxsize=256)
def weights(before: int, after: int, kind: str) -> np.ndarray:
    """(after, before) whole-numbered weights that take a line of ``before`` pixels to ``after``; a wider filter where it shrinks."""
    kernel, reach = _FILTERS[kind]
    scale = before / after
    wide = max(scale, 1.0)
    out = np.zeros((after, before))
    for i in range(after):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - reach * wide + 0.5)), min(before, int(centre + reach * wide + 0.5))
        own = kernel((np.arange(low, high) - centre + 0.5) / wide)
        out[i, low:high] = own / own.sum()
    return np.trunc(out * (1 << PRECISION) + np.where(out < 0, -0.5, 0.5))


def resize(picture: np.ndarray, width: int, height: int, kind: str = "bicubic") -> np.ndarray:
    """The picture (…, height, width, channels) in another size: across, then down, rounded to bytes after each."""

    def shrink(rows: np.ndarray, axis: int, size: int) -> np.ndarray:
        if rows.shape[axis] == size:
            return rows
        # Whole numbers below 2 ** 53 stay exact in doubles.
        summed = np.moveaxis(np.moveaxis(rows, axis, -1).astype(np.float64) @ weights(rows.shape[axis], size, kind).T, -1, axis)
        return np.clip(np.floor((summed + (1 << PRECISION - 1)) / (1 << PRECISION)), 0, 255).astype(np.uint8)

    return shrink(shrink(picture, -2, width), -3, height)


def rgb_of(picture: np.ndarray) -> np.ndarray:
    """Three channels of one, three or four."""
    return np.repeat(picture, 3, axis=-1) if picture.shape[-1] == 1 else picture[..., :3]


def brightness(picture: np.ndarray) -> np.ndarray:
    """The brightness of each pixel as a byte."""
    return (((rgb_of(picture).astype(np.int64) @ LUMA) + 0x8000) >> 16).astype(np.uint8) if picture.shape[-1] > 1 else picture[..., 0]


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    return np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None, :] + 1) / 64)


def perceptual_hashes(pictures: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each brightness picture of 32 by 32: the low 8 by 8 terms of its cosine transform over their median."""
    low = _cosines() @ pictures.astype(np.float64) @ _cosines().T
    # Terms that vanish but for rounding are zero.
    low[np.abs(low) < 1e-6] = 0.0
    bits = low.reshape(len(low), 64)
    bits = bits > np.median(bits, axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">i8")[:, 0].astype(np.int64)


#: Numbers of a descriptor: colour histograms, steps across and down, layout, means and spreads.
DESCRIPTOR = 3 * 16 + 32 + 32 + 64 + 8


def descriptors(pictures: np.ndarray) -> np.ndarray:
    """A unit vector of ``DESCRIPTOR`` numbers for each colour picture of 32 by 32."""
    n = len(pictures)
    bins = np.minimum(pictures.astype(np.int64) * 16 // 255, 15)
    shares = np.stack([(bins == i).sum(axis=(1, 2)) for i in range(16)], axis=-1).reshape(n, 48)
    unit = pictures / 255.0
    gray = unit.mean(axis=-1)
    across, down = np.abs(np.diff(gray, axis=2)).mean(axis=2), np.abs(np.diff(gray, axis=1)).mean(axis=1)
    # The layout is cut to bytes from single precision.
    single = pictures.astype(np.float32) / np.float32(255)
    single = (single[..., 0] + single[..., 1] + single[..., 2]) / np.float32(3) * np.float32(255)
    layout = resize(single.astype(np.uint8)[..., None], 8, 8).reshape(n, 64)
    spread = np.concatenate((unit.mean(axis=(1, 2)), unit.std(axis=(1, 2)), gray.mean(axis=(1, 2))[:, None], gray.std(axis=(1, 2))[:, None]), axis=1)
    found = np.concatenate((shares, across, down, layout, spread), axis=1)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def tiny_embeddings(pictures: np.ndarray) -> np.ndarray:
    """A unit vector of 192 numbers for each colour picture of 8 by 8: its pixels less their mean; the first axis for a flat one."""
    found = pictures.reshape(len(pictures), -1) / 255.0
    found = found - found.mean(axis=1, keepdims=True)
    length = np.linalg.norm(found, axis=1, keepdims=True)
    flat = np.zeros_like(found)
    flat[:, 0] = 1.0
    return np.where(length > 1e-9, found / np.maximum(length, 1e-300), flat)


def upright(picture: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as it is to be seen, by the orientation its camera noted: 1 to 8, anything else as 1."""
    if orientation in (5, 6, 7, 8):
        picture = np.swapaxes(picture, 0, 1)
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(orientation, ())
    return np.flip(picture, flips) if flips else picture


def over_background(picture: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """Red, green and blue of a picture laid over a colour by its fourth channel."""
    if picture.shape[-1] != 4:
        return rgb_of(picture)
    alpha = picture[..., 3:].astype(np.int64)
    mixed = picture[..., :3] * alpha + np.array(background) * (255 - alpha) + 128
    return ((mixed + (mixed >> 8)) >> 8).astype(np.uint8)


# Linear sRGB from the profile connection space.
_TO_SRGB = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])


def _curve(tag: bytes) -> np.ndarray:
    """What the 256 levels of a channel are in linear light, by a curve of a colour profile."""
    x = np.arange(256) / 255
    if tag[:4] == b"curv":
        n = struct.unpack_from(">I", tag, 8)[0]
        if n == 0:
            return x
        values = np.frombuffer(tag, ">u2", n, 12)
        return x ** (values[0] / 256) if n == 1 else np.interp(x, np.arange(n) / (n - 1), values / 65535)
    if tag[:4] == b"para":
        kind = struct.unpack_from(">H", tag, 8)[0]
        g, *p = np.frombuffer(tag, ">i4", (1, 3, 4, 5, 7)[kind], 12) / 65536
        a, b = (p + [1, 0])[:2] if p else (1, 0)
        if kind == 0:
            return x**g
        if kind in (1, 2):
            c = p[2] if kind == 2 else 0
            return np.where(x >= -b / a, np.maximum(a * x + b, 0) ** g + c, c)
        c, d = p[2:4]
        e, f = p[4:6] if kind == 4 else (0, 0)
        return np.where(x >= d, np.maximum(a * x + b, 0) ** g + e, c * x + f)
    raise ValueError("a curve of another kind")


def to_srgb(picture: np.ndarray, profile: bytes) -> np.ndarray:
    """A colour picture of a profile made of three curves and a matrix, in sRGB; a ValueError for other profiles."""
    try:
        if profile[36:40] != b"acsp" or profile[16:20] != b"RGB ":
            raise ValueError("no profile of red, green and blue")
        tags = {}
        for i in range(struct.unpack_from(">I", profile, 128)[0]):
            name, at, size = struct.unpack_from(">4sII", profile, 132 + 12 * i)
            tags[name] = profile[at : at + size]
        curves = [_curve(tags[name]) for name in (b"rTRC", b"gTRC", b"bTRC")]
        columns = np.array([np.frombuffer(tags[name], ">i4", 3, 8) / 65536 for name in (b"rXYZ", b"gXYZ", b"bXYZ")]).T
    except (KeyError, IndexError, struct.error) as why:
        raise ValueError(f"a broken profile: {why}") from why
    linear = np.stack([curve[picture[..., i]] for i, curve in enumerate(curves)], axis=-1) @ (_TO_SRGB @ columns).T
    linear = np.clip(linear, 0, 1)
    seen = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.floor(seen * 255 + 0.5).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(picture: np.ndarray, extra: tuple[tuple[bytes, bytes], ...] = ((b"sRGB", b"\0"),)) -> bytes:
    """PNG bytes of a gray, colour or colour and alpha picture, with chunks before its pixels."""
    height, width, channels = picture.shape
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = picture.reshape(height, -1)
    return b"".join((b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", head), *(_chunk(*e) for e in extra), _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)), _chunk(b"IEND", b"")))


def _orientation(exif: bytes) -> int | None:
    """The orientation in a block of camera notes, if it is there."""
    exif = exif.removeprefix(b"Exif\0\0")
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(exif[:4])
    try:
        at = struct.unpack_from(f"{order}I", exif, 4)[0] if order else 0
        for i in range(struct.unpack_from(f"{order}H", exif, at)[0] if order else 0):
            tag, kind, count, value = struct.unpack_from(f"{order}HHIH", exif, at + 2 + 12 * i)
            if tag == 0x0112 and kind == 3 and count == 1:
                return value
    except struct.error:
        pass
    return None


def picture_notes(content: bytes) -> tuple[int | None, bytes | None, bool]:
    """(orientation, colour profile, whether it is animated) from the parts of a PNG, JPEG or WEBP file around its pixels."""
    orientation, profile, animated = None, None, False
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while at + 8 <= len(content):
                size, kind = struct.unpack_from(">I4s", content, at)
                data = content[at + 8 : at + 8 + size] if kind in (b"eXIf", b"iCCP") else b""
                animated |= kind == b"acTL" and struct.unpack_from(">I", content, at + 8)[0] > 1
                if kind == b"eXIf":
                    orientation = _orientation(data)
                elif kind == b"iCCP":
                    profile = zlib.decompress(data[data.index(b"\0") + 2 :])
                at += 12 + size
        elif content[:2] == b"\xff\xd8":
            at, parts = 2, {}
            while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
                kind, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
                data = content[at + 4 : at + 2 + size]
                if kind == 0xE1 and data[:6] == b"Exif\0\0":
                    orientation = _orientation(data)
                elif kind == 0xE2 and data[:12] == b"ICC_PROFILE\0":
                    parts[data[12]] = data[14:]
                at += 2 + size
            profile = b"".join(parts[i] for i in sorted(parts)) or None
        elif content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            at = 12
            while at + 8 <= len(content):
                kind, size = struct.unpack_from("<4sI", content, at)
                data = content[at + 8 : at + 8 + size] if kind in (b"EXIF", b"ICCP") else b""
                animated |= kind == b"ANIM"
                if kind == b"EXIF":
                    orientation = _orientation(data)
                elif kind == b"ICCP":
                    profile = data
                at += 8 + size + size % 2
    except (struct.error, zlib.error, ValueError):
        pass
    return orientation, profile, animated
