"""Shared tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder which driver and executors share, from ``spark.checkpoint.dir``; a new one only where that is unset and there are no executors but this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="curato-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lost executors cost no recomputation, and the plan is cut."""
    path = f"{shared_dir(df.sparkSession)}/curato/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges up to which the tables of their nodes may be broadcast: Parquet files of labels are so small that Spark takes larger ones for small.
FEW_EDGES = 100_000


def _keyed(rows: DataFrame, few: bool) -> DataFrame:
    """The rows, which are joined by key unless they are few."""
    return rows if few else rows.hint("merge")


def _roots(labels: DataFrame, few: bool) -> DataFrame:
    """Follows labels to the end of their chains, twice as far each time."""
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialise(labels.join(_keyed(up, few), "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), labelled by the smallest node it is connected with.

    Each node takes its smallest neighbour's label if that is smaller, and labels are followed to their ends. Edges are
    then rewritten to labels, and those left between different ones go on; few are left after a round. Every table is
    written to the shared folder; nothing but counts comes to the driver, and tables of many nodes are not broadcast.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = materialise(edges.where("a != b").select(*pair("a", "b")).distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    few, found = left.count() <= FEW_EDGES, None
    while found is None or left.limit(1).count():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"))
        labels = _roots(materialise(near, "near"), few)
        if found is None:
            found = labels
        else:
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            found = materialise(found.join(_keyed(up, few), "label", "left").select("node", F.coalesce("further", "label").alias("label")), "found")
        one = left.join(_keyed(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), few), "a").select("x", "b")
        two = one.join(_keyed(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), few), "b").where("x != y")
        left = materialise(two.select(*pair("x", "y")).distinct(), "edges")
    alone = loops.distinct().join(_keyed(found, few), "node", "left_anti").select("node", F.col("node").alias("label"))
    return found.unionByName(alone)
