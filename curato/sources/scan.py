"""A source that lists image inputs: files and folders, with the reason for everything that is left out.

The listing is a Python data source. Each input is a partition, and of a recursive one each folder right below it; a
partition stops by itself beyond the limits. What the limits mean over all inputs, in their order, is decided by Spark
from running sums over the partitions.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from curato.operators.graph import materialise
from curato.sources.files import MOST_BYTES, MOST_FILE_BYTES, MOST_FILES, SUFFIXES

#: Fixed value: entries that a scan looks at.
MOST_ENTRIES = 100_000

SCHEMA = "input int, part int, seq long, kind string, root string, path string, size long, code string"


@dataclass(frozen=True)
class ScanLimits:
    """Limits of a scan over all of its inputs."""

    entries: int = MOST_ENTRIES
    files: int = MOST_FILES
    file_bytes: int = MOST_FILE_BYTES
    bytes: int = MOST_BYTES

    def __post_init__(self) -> None:
        if min(asdict(self).values()) < 1 or self.files > MOST_FILES:
            raise ValueError(f"limits are at least 1, and files at most {MOST_FILES}")


def is_link(path: str) -> bool:
    """Whether a path is a symbolic link, a junction or another reparse point."""
    try:
        found = os.lstat(path)
    except OSError:
        return False
    return stat.S_ISLNK(found.st_mode) or os.path.isjunction(path) or bool(getattr(found, "st_file_attributes", 0) & stat.FILE_ATTRIBUTE_REPARSE_POINT)


def has_link(path: str) -> bool:
    """Whether a path or any folder above it is a link."""
    while True:
        if is_link(path):
            return True
        above = os.path.dirname(path)
        if above == path:
            return False
        path = above


def _by_name(name: str) -> tuple[str, str]:
    return name.casefold(), name


def _listed(folder: str) -> tuple[list[str], list[str]]:
    """(names of files and links, names of folders that aren't links), in order."""
    files, folders = [], []
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_file() or is_link(entry.path):
                files.append(entry.name)
            elif entry.is_dir(follow_symlinks=False):
                folders.append(entry.name)
    return sorted(files, key=_by_name), sorted(folders, key=_by_name)


def _walk(folder: str, deep: bool) -> Iterator[str]:
    """Files and links of a folder, and with ``deep`` those below; links to folders aren't followed."""
    files, folders = _listed(folder)
    for name in files:
        path = os.path.join(folder, name)
        # A tree tells of links to files only.
        if not deep or not (is_link(path) and os.path.isdir(path)):
            yield path
    for name in folders if deep else ():
        yield from _walk(os.path.join(folder, name), True)


@dataclass
class _Part(InputPartition):
    number: int
    part: int
    root: str
    folder: str
    #: What is listed: one file, a folder, a tree, or nothing because of ``code``.
    what: str
    code: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, inputs: Sequence[str], deep: bool, limits: ScanLimits):
        self.inputs, self.deep, self.limits = inputs, deep, limits

    def partitions(self) -> list[_Part]:
        parts = []
        for number, given in enumerate(self.inputs):
            root = os.path.abspath(os.path.expanduser(given))
            if has_link(root):
                parts.append(_Part(number, 0, root, root, "none", "filesystem_link"))
            elif not os.path.exists(root):
                parts.append(_Part(number, 0, root, root, "none", "missing"))
            elif os.path.isdir(root):
                parts.append(_Part(number, 0, root, root, "folder"))
                if self.deep:
                    try:
                        below = _listed(root)[1][: self.limits.entries]
                    except OSError:
                        below = []
                    parts += [_Part(number, i, root, os.path.join(root, name), "tree") for i, name in enumerate(below, 1)]
            else:
                parts.append(_Part(number, 0, root, root, "file" if os.path.isfile(root) else "odd"))
        return parts

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        p = partition
        # Spark reads one partition even where there are none.
        if p is None:
            return

        def row(seq: int, kind: str, path: str, size: int | None = None, code: str | None = None) -> tuple:
            return p.number, p.part, seq, kind, p.root, path, size, code

        if p.what == "none":
            yield row(0, "refused", p.root, code=p.code)
            return
        yield row(0, "there", p.root)
        if p.what == "odd":
            yield row(0, "issue", p.root, code="not_a_file_or_directory")
            return
        seq = 0
        try:
            for path in (p.folder,) if p.what == "file" else self._paths(p):
                seq += 1
                # Beyond the limits nothing more counts.
                if seq > self.limits.entries + 1:
                    return
                yield row(seq, "entry", *self._entry(path, p))
        except OSError:
            yield row(seq + 1, "end", p.root, code="unreadable")

    def _paths(self, p: _Part) -> Iterator[str]:
        if p.what == "tree":
            return _walk(p.folder, True)
        files = _walk(p.folder, False)
        return (f for f in files if not (is_link(f) and os.path.isdir(f))) if self.deep else files

    def _entry(self, path: str, p: _Part) -> tuple[str, int | None, str | None]:
        """(path, bytes, code) of an entry; neither bytes nor a code for what isn't an image."""
        if is_link(path) or has_link(os.path.dirname(path)):
            return path, None, "filesystem_link"
        if not path.lower().endswith(SUFFIXES):
            return path, None, "unsupported_extension" if p.what == "file" else None
        try:
            size = os.stat(path).st_size
        except OSError:
            return path, None, "unreadable"
        return path, size, "file_too_large" if size > self.limits.file_bytes else None


class ImageScan(DataSource):
    """``inputs`` is a JSON list of paths that all workers share, ``recursive`` true or false, ``limits`` a JSON object."""

    @classmethod
    def name(cls) -> str:
        return "image_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        options = self.options
        return _Reader(json.loads(options["inputs"]), options.get("recursive", "false") == "true", ScanLimits(**json.loads(options.get("limits", "{}"))))


_POSITION = ("input", "part", "seq")


def _before(other: Column) -> Column:
    return F.struct(*_POSITION) < other


def scan_inputs(spark: SparkSession, inputs: Sequence[str], recursive: bool = False, limits: ScanLimits | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, size) of the images, (path, code) of the issues) of files and folders, in their given order.

    Codes: missing, not_a_file_or_directory, unsupported_extension (of a file that is named itself), unreadable,
    too_many_entries, too_many_images, file_too_large, filesystem_link and total_size_exceeded. An input that is a link or
    lies below one is refused, and so is every link in a folder. Paths that differ in case only count once, the first one.
    A limit ends the scan at the entry that goes beyond it, with an issue of its input; after that inputs are looked at
    only until one is there. Both results are ordered by path, regardless of case.
    """
    limits = limits or ScanLimits()
    spark.dataSource.register(ImageScan)
    given = {"inputs": json.dumps([os.fspath(i) for i in inputs]), "recursive": str(recursive).lower(), "limits": json.dumps(asdict(limits))}
    rows = materialise(spark.read.format("image_scan").options(**given).load(), "scan")
    here = F.struct(*_POSITION)

    # A folder that can't be listed ends its input.
    ends = rows.where("kind = 'end'").groupBy("input").agg(F.min(here).alias("end"))
    rows = rows.join(F.broadcast(ends), "input", "left").where(F.col("end").isNull() | _before(F.col("end")) | (here == F.col("end"))).drop("end")

    own = Window.partitionBy("input", "part").orderBy("seq")
    earlier = Window.orderBy("input", "part").rowsBetween(Window.unboundedPreceding, -1)

    def running(of: DataFrame, **sums: Column) -> DataFrame:
        """Adds running sums in the order of the entries: within a partition, and over the few sums of partitions."""
        totals = of.groupBy("input", "part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
        totals = totals.select("input", "part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
        # As many rows as partitions, of which a scan has no more than entries.
        both = of.join(F.broadcast(totals), ["input", "part"])
        return both.select(*of.columns, *((F.col(f"_{n}") + F.sum(c).over(own)).alias(n) for n, c in sums.items()))

    entries = running(rows.where("kind = 'entry'"), n=F.lit(1))
    images = entries.where("size is not null and code is null").withColumn("key", F.lower("path"))
    images = images.withColumn("first", F.row_number().over(Window.partitionBy("key").orderBy(*_POSITION)) == 1).where("first")
    images = running(images.drop("n", "first"), n=F.lit(1), total=F.col("size"))
    over = entries.where(F.col("n") > limits.entries).select(*_POSITION, "root", F.lit("too_many_entries").alias("code"), F.lit(0).alias("rank"))
    many = images.where(F.col("n") > limits.files).select(*_POSITION, "root", F.lit("too_many_images").alias("code"), F.lit(1).alias("rank"))
    large = images.where(F.col("total") > limits.bytes).select(*_POSITION, "root", F.lit("total_size_exceeded").alias("code"), F.lit(2).alias("rank"))
    stop = materialise(over.unionByName(many).unionByName(large).agg(F.min(F.struct(*_POSITION, "rank", "root", "code")).alias("s")), "stop")
    # One row.
    at = F.struct(*(F.col(f"s.{c}") for c in _POSITION))
    until = lambda of: of.crossJoin(F.broadcast(stop)).where(F.col("s").isNull() | _before(at))

    files = until(images).select("path", "size").orderBy(F.lower("path"), "path")
    met = until(rows.where("code is not null and kind != 'refused'")).select("path", "code")
    first = rows.where("kind = 'there'").crossJoin(F.broadcast(stop)).where(F.col("input") > F.col("s.input")).agg(F.min("input").alias("live"))
    refused = rows.where("kind = 'refused'").crossJoin(F.broadcast(stop)).crossJoin(F.broadcast(first))
    refused = refused.where(F.col("s").isNull() | (F.col("input") <= F.col("s.input")) | F.col("live").isNull() | (F.col("input") < F.col("live"))).select("path", "code")
    ended = stop.where("s is not null").select(F.col("s.root").alias("path"), F.col("s.code").alias("code"))
    return files, met.unionByName(refused).unionByName(ended).orderBy(F.lower("path"), "path", "code")
