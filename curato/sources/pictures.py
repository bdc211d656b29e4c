"""Pictures with their pixels: reading, metrics and normalised copies.

Spark's image source decodes in the JVM; what stands around the pixels in a file (orientation, colour profile, whether it
is animated) is read from its bytes. Both are joined by path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from curato.functions import pixels
from curato.sources.files import MOST_FILE_BYTES, MOST_PIXELS, MOST_SIDE, luminance_metrics

# The colour behind transparent pixels, and the share of them from which there is a warning.
BACKGROUND, WARN_ALPHA = (127, 127, 127), 0.05

_NOTES = pa.struct([("orientation", pa.int32()), ("profile", pa.binary()), ("animated", pa.bool_())])


def _notes(contents: pa.Array) -> pa.Array:
    rows = (pixels.picture_notes(c.as_py() or b"") for c in contents)
    return pa.array([{"orientation": o, "profile": p, "animated": a} for o, p, a in rows], _NOTES)


def _place(path: str) -> Column:
    """A path without what file systems are named by, which the two sources write differently."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_pictures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, width, height, channels, data, orientation, profile, error): a row for each file of PNG, JPEG or WEBP.

    ``data`` holds the decoded bytes line by line, red first, as the camera took them; a fourth channel is alpha. Errors:
    animated_image (more than one frame), unsafe_image (too large a file or picture) and unreadable (it can't be
    decoded); such rows have no data. Files of no bytes aren't listed by Spark's sources.
    """
    glob = "*.{png,PNG,jpg,JPG,jpeg,JPEG,webp,WEBP}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    notes = F.arrow_udf(_notes, "struct<orientation:int,profile:binary,animated:boolean>")
    around = files.select(_place("path").alias("path"), "length", notes("content").alias("n"))
    images = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", glob).load(paths)
    decoded = images.select(_place("image.origin").alias("path"), *(F.when(F.col(f"image.{c}") > 0, F.col(f"image.{c}")).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"))), F.col("image.data").alias("data"))
    both = around.join(decoded, "path", "left")
    width, height = F.col("width"), F.col("height")
    unsafe = (F.col("length") > MOST_FILE_BYTES) | (F.greatest(width, height) > MOST_SIDE) | (width.cast("long") * height > MOST_PIXELS)
    error = F.when(F.col("n.animated"), "animated_image").when(unsafe, "unsafe_image").when(width.isNull() | height.isNull(), "unreadable")
    both = both.withColumn("error", error)
    return both.select("path", "length", "width", "height", "channels", F.when(F.col("error").isNull(), _red_first(F.col("channels"), F.col("data"))).alias("data"), F.col("n.orientation").alias("orientation"), F.col("n.profile").alias("profile"), "error")


def _red_first(channels: Column, data: Column) -> Column:
    def swap(batch_channels: pa.Array, batch: pa.Array) -> pa.Array:
        out = []
        for n, d in zip(batch_channels.to_pylist(), batch):
            if n in (3, 4) and d.is_valid:
                rows = np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, n)
                out.append(rows[:, [2, 1, 0, 3][:n]].tobytes())
            else:
                out.append(d.as_py())
        return pa.array(out, pa.binary())

    return F.arrow_udf(swap, "binary")(channels, data)


def picture_of(row) -> np.ndarray:
    """The upright picture of a row of ``read_pictures``."""
    return pixels.upright(np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels), row.orientation or 1)


def _each(pictures: DataFrame, result: pa.Schema, make: Callable) -> DataFrame:
    """A row for each picture, made by ``make``; of one with an error its path and error alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = SimpleNamespace(**{name: batch.column(name)[i].as_py() for name in batch.schema.names})
                found = {"path": row.path, "error": row.error} | ({} if row.error else make(row))
                yield pa.RecordBatch.from_pylist([found], result)

    return pictures.select("path", "width", "height", "channels", "data", "orientation", "profile", "error").mapInArrow(rows, from_arrow_schema(result))


_METRICS = pa.schema(
    [("path", pa.string()), *((n, pa.int32()) for n in ("width", "height", "channels"))]
    + [(n, pa.float64()) for n in ("luminance_mean", "luminance_stddev", "luminance_range", "sharpness", "compression_blockiness", "alpha_fraction")]
    + [("error", pa.string())]
)


def image_metrics(pictures: DataFrame) -> DataFrame:
    """Metrics of each upright picture from ``read_pictures``; those with an error have none."""

    def one(row) -> dict:
        picture = picture_of(row)
        alpha = float((picture[:, :, 3] < 255).mean()) if row.channels == 4 else 0.0
        return {"height": picture.shape[0], "width": picture.shape[1], "channels": row.channels, "alpha_fraction": alpha} | luminance_metrics(pixels.brightness(picture))

    return _each(pictures, _METRICS, one)


_NORMAL = pa.schema(
    [("path", pa.string()), ("png", pa.binary()), ("sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32())]
    + [(n, pa.bool_()) for n in ("exif_transposed", "icc_profile_present", "icc_converted_to_srgb", "assumed_srgb", "alpha_present")]
    + [("alpha_fraction", pa.float64()), ("warnings", pa.list_(pa.string())), ("error", pa.string())]
)


def normalise(pictures: DataFrame, background: tuple[int, int, int] = BACKGROUND, warn_alpha: float = WARN_ALPHA) -> DataFrame:
    """A PNG of each picture from ``read_pictures``: upright, in sRGB, laid over a background, never cut or resized.

    A profile that can't be read is a warning, and its pixels count as sRGB; so is alpha in ``warn_alpha`` of the pixels
    or more. Rows with an error stay, with their error and nothing else.
    """
    def one(row) -> dict:
        picture, warnings, converted = picture_of(row), [], False
        if row.profile:
            try:
                colours = pixels.to_srgb(pixels.rgb_of(picture), row.profile)
                picture = np.concatenate((colours, picture[:, :, 3:]), axis=2) if row.channels == 4 else colours
                converted = True
            except ValueError as why:
                warnings.append(f"colour profile ignored: {why}")
        alpha = float((picture[:, :, 3] < 255).mean()) if row.channels == 4 else 0.0
        if row.channels == 4 and alpha >= warn_alpha:
            warnings.append(f"{alpha:.1%} of the pixels are transparent")
        png = pixels.write_png(pixels.over_background(picture, background))
        return {
            "png": png, "sha256": hashlib.sha256(png).hexdigest(), "width": picture.shape[1], "height": picture.shape[0],
            "exif_transposed": (row.orientation or 1) != 1, "icc_profile_present": row.profile is not None, "icc_converted_to_srgb": converted, "assumed_srgb": not converted,
            "alpha_present": row.channels == 4, "alpha_fraction": alpha, "warnings": warnings,
        }

    return _each(pictures, _NORMAL, one)
