"""Content-addressed ingest: manifests, limits, integrity and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest(files: DataFrame, digest: str, source: str) -> DataFrame:
    """(digest, sources, n_files): one entry for each content, with the sorted set of its sources."""
    return files.groupBy(digest).agg(F.sort_array(F.collect_set(source)).alias("sources"), F.count("*").alias("n_files"))


def merge_manifests(old: DataFrame, new: DataFrame, digest: str) -> DataFrame:
    """The old manifest with new contents, and new sources of old contents."""
    empty = F.array().cast("array<string>")
    both = old.alias("o").join(new.alias("n"), digest, "full_outer")
    return both.select(digest, F.sort_array(F.array_union(F.coalesce("o.sources", empty), F.coalesce("n.sources", empty))).alias("sources"))


def manifest_losses(old: DataFrame, new: DataFrame, digest: str) -> DataFrame:
    """Entries of the old manifest that the new one lacks or has with fewer sources: none in a monotonic import."""
    both = old.alias("o").join(new.alias("n"), digest, "left")
    lost = F.array_except("o.sources", F.coalesce("n.sources", F.array().cast("array<string>")))
    return both.select(digest, lost.alias("lost"), F.col("n.sources").isNull().alias("removed")).where((F.size("lost") > 0) | F.col("removed"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of what changed between two snapshots: missing, added or changed."""
    both = before.select(key, F.col(digest).alias("d1"), F.lit(True).alias("b")).join(after.select(key, F.col(digest).alias("d2"), F.lit(True).alias("a")), key, "full_outer")
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "added").when(~F.col("d1").eqNullSafe(F.col("d2")), "changed")
    return both.select(key, status.alias("status")).where(F.col("status").isNotNull())


def bounded_scan(files: DataFrame, key: str, size: str, most_files: int, most_bytes: int, most_file_bytes: int, salt: int = 64) -> DataFrame:
    """Adds ``issue`` to files in the order of their key: too large ones are left out, and the scan stops at a limit.

    Running counts are taken within ranges of keys and over the ranges' sums, so that no task gets all files.
    """
    rows = files.withColumn("large", F.col(size) > most_file_bytes).withColumn("own", F.when(F.col("large"), 0).otherwise(F.col(size)))
    edges = files.approxQuantile(key, [i / salt for i in range(1, salt)], 0.01) if dict(files.dtypes)[key] in ("bigint", "int", "double") else []
    part = F.lit(0)
    for edge in sorted(set(edges)):
        part = part + (F.col(key) > edge).cast("int")
    rows = rows.withColumn("part", part)
    small = lambda: F.count_if(~F.col("large"))
    sums = rows.groupBy("part").agg(F.sum("own").alias("bytes"), small().alias("files"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"), F.coalesce(F.sum("files").over(before), F.lit(0)).alias("files"))
    upto = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # As many rows as ranges.
    rows = rows.join(F.broadcast(sums), "part")
    n, total = F.col("files") + F.sum((~F.col("large")).cast("long")).over(upto), F.col("bytes") + F.sum("own").over(upto)
    issue = F.when(F.col("large"), "file_too_large").when(n > most_files, "too_many_images").when(total > most_bytes, "total_size_exceeded")
    return rows.withColumn("issue", issue).drop("large", "own", "part", "bytes", "files")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows without those whose keys the new ones have, and the new ones."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows, and the new ones whose keys they haven't."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The last row of each key by the order given, which should be descending."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
