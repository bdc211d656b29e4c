"""File sources: scans of image folders, image headers, model headers, vocabularies and device lists."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.functions.tags import canonical
from curato.operators.constraints import unique

# Kinds of images, and the limits of a scan.
SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES = 2_000, 50 << 30, 512 << 20
MOST_SIDE, MOST_PIXELS = 32_768, 100_000_000
MOST_HEADER = 128 << 20


def scan_images(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(path, length, content) of the images in folders, in the order of their paths in lower case, then as they are.

    Empty files aren't listed by this source: they have to be found by a listing of their own.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = source.load(paths)
    kind = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    return files.where(kind.isin(*SUFFIXES)).select("path", "length", "content").orderBy(F.lower("path"), "path")


def image_size(head: bytes) -> tuple[int, int] | None:
    """(width, height) from the first bytes of a PNG, JPEG or WEBP file; None if they aren't one."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24 and head[12:16] == b"IHDR":
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                return None
            kind, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                return width, height
            at += 2 + size
        return None
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        kind = head[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            width, height = struct.unpack("<HH", head[26:30])
            return width & 0x3FFF, height & 0x3FFF
    return None


def image_headers(files: DataFrame, head: int = 1 << 16) -> DataFrame:
    """Adds ``width``, ``height`` and ``error`` (unsafe_image, or null) from the first bytes of ``content``."""
    kind = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

    def read(heads: pd.Series) -> pd.DataFrame:
        sizes = [image_size(bytes(h)) or (None, None) for h in heads]
        return pd.DataFrame(sizes, columns=["width", "height"], dtype="Int32")

    rows = files.withColumn("s", F.pandas_udf(read, kind)(F.substring("content", 1, head)))
    width, height = F.col("s.width"), F.col("s.height")
    unsafe = width.isNull() | (width <= 0) | (height <= 0) | (F.greatest(width, height) > MOST_SIDE) | (width.cast("long") * height > MOST_PIXELS) | (F.col("length") > MOST_FILE_BYTES)
    return rows.withColumn("width", width).withColumn("height", height).withColumn("error", F.when(unsafe, "unsafe_image")).drop("s")


def luminance_metrics(gray: np.ndarray) -> dict[str, float]:
    """Mean, spread, range, sharpness and blockiness of a picture's brightness.

    Sharpness is the variance of the difference of each inner pixel from its four neighbours; blockiness is the mean step
    across every eighth column and row over that across the others.
    """
    gray = gray.astype(np.float32)
    height, width = gray.shape
    out = {"luminance_mean": float(gray.mean()), "luminance_stddev": float(gray.std()), "luminance_range": float(gray.max() - gray.min()), "sharpness": 0.0, "compression_blockiness": 0.0}
    if min(height, width) >= 3:
        inner = gray[1:-1, 1:-1]
        around = gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:]
        out["sharpness"] = float((around - 4 * inner).var())
    if min(height, width) >= 16:
        across, down = np.abs(np.diff(gray, axis=1)), np.abs(np.diff(gray, axis=0))
        edge_x, edge_y = np.arange(7, width - 1, 8), np.arange(7, height - 1, 8)
        edge = np.concatenate((across[:, edge_x].ravel(), down[edge_y, :].ravel()))
        other = np.concatenate((np.delete(across, edge_x, 1).ravel(), np.delete(down, edge_y, 0).ravel()))
        out["compression_blockiness"] = float(edge.mean() / (other.mean() + 1e-6))
    return out


TENSORS = "path string, key string, dtype string, start long, end long, metadata map<string,string>, error string"


def tensor_headers(files: DataFrame) -> DataFrame:
    """A row for each tensor named in a model file's header, or one with an ``error``; ``files`` has path and content."""

    def parse(path: str, content: bytes) -> list[tuple]:
        bad = lambda why: [(path, None, None, None, None, None, why)]
        if len(content) < 8:
            return bad("too_short")
        size = struct.unpack("<Q", content[:8])[0]
        if size > MOST_HEADER or 8 + size > len(content):
            return bad("header_size")
        try:
            header = json.loads(content[8 : 8 + size])
        except ValueError:
            return bad("header_json")
        meta = header.pop("__metadata__", {}) if isinstance(header, dict) else None
        if not isinstance(header, dict) or not header:
            return bad("no_tensors")
        room, out = len(content) - 8 - size, []
        for key, entry in header.items():
            start, end = entry.get("data_offsets", (0, -1))
            if not 0 <= start <= end <= room:
                return bad("offsets")
            out.append((path, key, entry.get("dtype"), start, end, {str(k): str(v) for k, v in meta.items()}, None))
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in batch.itertuples(index=False) for r in parse(path, bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "key", "dtype", "start", "end", "metadata", "error"]).astype({"start": "Int64", "end": "Int64"})

    return files.select("path", "content").mapInPandas(read, TENSORS)


def checkpoint_index(files: DataFrame) -> DataFrame:
    """(path, epoch, step) of files with tensors whose metadata give a positive epoch and step, in that order."""
    heads = tensor_headers(files).where("error IS NULL").groupBy("path").agg(F.first("metadata").alias("m"))
    number = lambda *keys: F.coalesce(*(F.col("m")[k].try_cast("int") for k in keys))
    rows = heads.select("path", number("ss_epoch", "epoch").alias("epoch"), number("ss_steps", "step").alias("step"))
    return rows.where("epoch >= 1 AND step >= 1").orderBy("epoch", "step", "path")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(place, tag, model_category) of a CSV vocabulary with a name (or tag) and a category column.

    Category 9 is a rating, 4 a character, any other general; a byte order mark is dropped; an empty or repeated tag is
    an error.
    """
    lines = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = {c.lstrip("﻿"): c for c in lines.columns}
    name = names.get("name") or names.get("tag")
    if name is None:
        raise ValueError("the vocabulary needs a name or tag column")
    kind = F.trim(F.coalesce(F.col(f"`{names['category']}`"), F.lit("0"))) if "category" in names else F.lit("0")
    rows = lines.select(F.monotonically_increasing_id().alias("i"), canonical(F.col(f"`{name}`")).alias("tag"), F.when(kind == "9", "rating").when(kind == "4", "character").otherwise("general").alias("model_category"))
    # A vocabulary is one small file: its places follow the file's order.
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("i")) - 1).drop("i")
    if rows.where((F.col("tag") == "") | F.col("tag").isNull()).limit(1).count() or unique(rows, "tag").limit(1).count():
        raise ValueError("empty or repeated tags in the vocabulary")
    return rows


def parse_devices(lines: DataFrame, line: str) -> DataFrame:
    """(device_index, uuid, name, driver, total_mb, free_mb, capability) of lines of seven comma-separated fields.

    Blank lines are skipped; any other line, and an index or uuid that comes twice, is an error.
    """
    parts = F.transform(F.split(line, ","), lambda p: F.trim(p))
    wrong = F.raise_error(F.concat(F.lit("not a device: "), F.col(line))).cast("array<string>")
    rows = lines.where(F.trim(line) != "").withColumn("p", F.when(F.size(parts) == 7, parts).otherwise(wrong))
    for i in (0, 1):
        # A host's devices: a handful of rows.
        again = F.count("*").over(Window.partitionBy(F.col("p")[i])) > 1
        rows = rows.withColumn("p", F.when(again, F.raise_error(F.concat(F.lit("a device comes twice: "), F.col("p")[i])).cast("array<string>")).otherwise(F.col("p")))
    return rows.select(F.col("p")[0].cast("int").alias("device_index"), F.col("p")[1].alias("uuid"), F.col("p")[2].alias("name"), F.col("p")[3].alias("driver"), F.col("p")[4].cast("int").alias("total_mb"), F.col("p")[5].cast("int").alias("free_mb"), F.col("p")[6].alias("capability")).orderBy("device_index")


def parse_telemetry(lines: DataFrame, line: str, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples of the selected devices, selected devices without one): uuid, busy, used_mb, free_mb, celsius, watts."""
    parts = F.transform(F.split(line, ","), lambda p: F.trim(p))
    rows = lines.withColumn("p", parts).where(F.size("p") == 6)
    names = ("busy", "used_mb", "free_mb", "celsius", "watts")
    rows = rows.select(F.col("p")[0].alias("uuid"), *(F.col("p")[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)))
    return rows.join(selected.select("uuid"), "uuid", "left_semi"), selected.join(rows.select("uuid"), "uuid", "left_anti")
