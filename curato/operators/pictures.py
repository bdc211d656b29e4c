"""Hashes, descriptors and stand-in embeddings of decoded pictures, a batch of them at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.functions import pixels

#: Pictures of one size that a kernel takes at once.
TOGETHER = 256


def _kernel(kind: pa.DataType, result: T.DataType, prepare: Callable, run: Callable) -> Callable[[Column, Column, Column, Column, Column], Column]:
    """A column of ``run`` over pictures that ``prepare`` has brought to one size; null for a picture without data."""

    def batch(width: pa.Array, height: pa.Array, channels: pa.Array, data: pa.Array, orientation: pa.Array) -> pa.Array:
        out, held, places = [None] * len(data), [], []

        def flush() -> None:
            if held:
                for place, found in zip(places, run(np.stack(held))):
                    out[place] = found
            held.clear()
            places.clear()

        sizes = zip(width.to_pylist(), height.to_pylist(), channels.to_pylist(), orientation.to_pylist())
        for place, ((w, h, c, o), d) in enumerate(zip(sizes, data)):
            if d.is_valid and w and h and c:
                picture = np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, c)
                held.append(prepare(pixels.upright(picture, o or 1)))
                places.append(place)
            if len(held) == TOGETHER:
                flush()
        flush()
        return pa.array(out, kind)

    return F.arrow_udf(batch, result)


_hash = _kernel(pa.int64(), T.LongType(), lambda p: pixels.resize(pixels.brightness(pixels.rgb_of(p))[..., None], 32, 32, "lanczos")[..., 0], pixels.perceptual_hashes)
_descriptor = _kernel(pa.list_(pa.float64()), T.ArrayType(T.DoubleType()), lambda p: pixels.resize(pixels.rgb_of(p), 32, 32), pixels.descriptors)
_embedding = _kernel(pa.list_(pa.float64()), T.ArrayType(T.DoubleType()), lambda p: pixels.resize(pixels.rgb_of(p), 8, 8), pixels.tiny_embeddings)
_COLUMNS = ("width", "height", "channels", "data", "orientation")


def perceptual_hash(columns: tuple[str, ...] = _COLUMNS) -> Column:
    """A signed 64-bit hash of the picture in (width, height, channels, data, orientation): near pictures differ in few bits."""
    return _hash(*(F.col(c) for c in columns))


def descriptor(columns: tuple[str, ...] = _COLUMNS) -> Column:
    """A unit vector of 184 numbers: histograms, steps across and down, an 8 by 8 layout, means and spreads."""
    return _descriptor(*(F.col(c) for c in columns))


def tiny_embedding(columns: tuple[str, ...] = _COLUMNS) -> Column:
    """A unit vector of 192 numbers, the picture's 8 by 8 pixels less their mean: stands in for a learned embedding."""
    return _embedding(*(F.col(c) for c in columns))
