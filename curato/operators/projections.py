"""What each stage of a run leaves in the tables: rows made of its output, and how they meet the rows that are there.

Rows are merged by key, inserted where their key is absent, put in the place of all rows of a key or of a run, or must
be new. Applied twice, a stage's output leaves what it left once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curato.operators.generate import sample_id
from curato.operators.graph import materialise
from curato.operators.logs import mask_paths


@dataclass(frozen=True)
class Context:
    """Whose output it is."""

    project_id: str
    run_id: str
    preset: str = "character"
    trigger: str = ""


@dataclass(frozen=True)
class Projection:
    """One table of a stage: ``rows`` makes them of the output's frame ``source``, ``how`` says how they meet the table's.

    merge replaces rows of equal keys, absent adds rows of other keys only, new is an error where a key is there, replace deletes
    all rows of the keys which the output has, and scope all rows of this run or project: ``keys`` then names that column.
    """

    table: str
    source: str
    keys: tuple[str, ...]
    how: str
    rows: Callable[[DataFrame, Context], DataFrame]


def _text(value: str) -> Column:
    return F.lit(value).cast("string")


def _raw_assets(assets: DataFrame, c: Context) -> DataFrame:
    notes = F.to_json(F.struct("extension", F.lit(True).alias("immutable")))
    return assets.select(F.col("asset_id").alias("id"), _text(c.project_id).alias("project_id"), _text("raw").alias("kind"), F.concat(F.lit("dataset/raw/"), "stored_filename").alias("relative_path"), "sha256", F.col("size_bytes").cast("long").alias("size_bytes"), notes.alias("metadata"))


def _sources(sources: DataFrame, c: Context) -> DataFrame:
    # One content may come from a path once.
    return sources.groupBy("asset_id", "original_path").agg(F.min("original_filename").alias("original_filename"))


def _working_assets(items: DataFrame, c: Context) -> DataFrame:
    notes = F.to_json(F.struct(F.col("asset_id").alias("source_asset_id"), "width", "height", "warnings"))
    return items.select(F.concat(F.lit("working-"), "asset_id").alias("id"), _text(c.project_id).alias("project_id"), _text("normalized").alias("kind"), F.col("path").alias("relative_path"), "sha256", F.col("size_bytes").cast("long").alias("size_bytes"), notes.alias("metadata"))


def _clusters(clusters: DataFrame, c: Context) -> DataFrame:
    return clusters.select(F.col("cluster_id").alias("id"), _text(c.project_id).alias("project_id"), F.col("representative_id").alias("representative_asset_id"), "members", F.col("kind").alias("method"), F.coalesce(F.get("scores", F.lit(0)).cast("double"), F.lit(0.0)).alias("confidence"))


def _tags(tags: DataFrame, c: Context) -> DataFrame:
    """The longer table of (asset_id, model_id, revision, tag, score) as one row for each asset."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", F.col("score").cast("double").alias("score")))))
    return tags.groupBy("asset_id", "model_id", F.col("revision").alias("model_revision")).agg(pairs.alias("tags"))


def _captions(captions: DataFrame, c: Context) -> DataFrame:
    return captions.select("asset_id", _text(c.preset).alias("preset"), _text(c.trigger).alias("trigger_token"), "caption", "audit")


def _splits(split: DataFrame, c: Context) -> DataFrame:
    return split.select(_text(c.run_id).alias("run_id"), "asset_id", "split", F.col("seed").cast("long").alias("seed"))


def _plan(plan: DataFrame, c: Context) -> DataFrame:
    return plan.select(_text(c.run_id).alias("run_id"), "plan", F.lit(True).alias("selected"))


def _calls(stage: str) -> Callable[[DataFrame, Context], DataFrame]:
    def rows(audits: DataFrame, c: Context) -> DataFrame:
        task = F.coalesce(F.nullif("task_type", F.lit("")), F.lit(stage))
        own = F.coalesce(F.nullif("call_id", F.lit("")), F.concat(F.lit(f"{c.run_id}-{stage}-"), task))
        return audits.select(own.alias("id"), _text(c.run_id).alias("run_id"), task.alias("task_type"), mask_paths(F.col("audit")).alias("audit"), mask_paths(F.coalesce("applied_changes", F.lit("{}"))).alias("applied_changes"))

    return rows


def _attempt(row: DataFrame, c: Context, status: Column, code: Column) -> DataFrame:
    return row.select(_text(c.run_id).alias("run_id"), F.col("attempt").cast("int").alias("attempt"), status.alias("status"), F.coalesce("command", F.array().cast("array<string>")).alias("command"), "recovery", code.cast("int").alias("return_code"))


def _started(row: DataFrame, c: Context) -> DataFrame:
    return _attempt(row, c, F.lit("running"), F.lit(None))


def _failed(row: DataFrame, c: Context) -> DataFrame:
    # The statuses that a failure may come with.
    said = F.when(F.col("status").isin("cancelled", "failed_recoverable", "failed_fatal"), F.col("status"))
    return _attempt(row, c, F.coalesce(said, F.when(F.coalesce("retry_applied", F.lit(False)), "failed_recoverable").otherwise("failed_fatal")), F.lit(1))


def _completed(row: DataFrame, c: Context) -> DataFrame:
    return _attempt(row, c, F.lit("completed"), F.lit(0))


def _checkpoints(rows: DataFrame, c: Context) -> DataFrame:
    return rows.select(F.col("checkpoint_id").alias("id"), _text(c.run_id).alias("run_id"), "path", F.col("epoch").cast("int").alias("epoch"), F.col("step").cast("long").alias("step"), "sha256", "validation_loss", "train_loss", F.lit("valid").alias("status"))


def _samples(rows: DataFrame, c: Context) -> DataFrame:
    asked = [("checkpoint_id", F.col("checkpoint_id")), ("prompt_id", F.col("prompt_id")), ("seed", F.col("seed").cast("long")), ("weight", F.col("weight").cast("double"))]
    own = F.concat(F.lit("sample-"), sample_id(*asked))
    return rows.select(own.alias("id"), "checkpoint_id", F.col("image_path").alias("path"), "prompt_id", F.col("seed").cast("long").alias("seed"), F.col("weight").cast("double").alias("weight"), "success", "error")


def _evaluations(rows: DataFrame, c: Context) -> DataFrame:
    return rows.select("checkpoint_id", F.col("score").cast("double").alias("score"), F.col("recommended_weight").cast("double").alias("recommended_weight"), "metrics", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


_SAMPLES = (Projection("samples", "samples", ("id",), "merge", _samples),)

#: The tables of each stage, in the order in which they are written.
STAGES: dict[str, tuple[Projection, ...]] = {
    "importing": (Projection("assets", "assets", ("id",), "merge", _raw_assets), Projection("source_files", "sources", ("asset_id", "original_path"), "absent", _sources)),
    "normalizing": (Projection("assets", "items", ("id",), "merge", _working_assets),),
    "deduplicating": (Projection("duplicate_clusters", "clusters", ("project_id",), "scope", _clusters),),
    "tagging": (Projection("tag_results", "tags", ("asset_id",), "replace", _tags),),
    "captioning": (Projection("captions", "captions", ("asset_id",), "replace", _captions),),
    "planning": (Projection("dataset_splits", "split", ("run_id",), "scope", _splits), Projection("training_plans", "plan", ("run_id",), "scope", _plan)),
    "pretrain_review": (Projection("calls", "audits", ("id",), "merge", _calls("pretrain_review")),),
    "refinement": (Projection("calls", "audits", ("id",), "merge", _calls("refinement")),),
    "final_review": (Projection("calls", "audits", ("id",), "merge", _calls("final_review")),),
    "training_started": (Projection("attempts", "attempt", ("run_id", "attempt"), "new", _started),),
    "training_failed": (Projection("attempts", "failures", ("run_id", "attempt"), "merge", _failed),),
    "training": (Projection("attempts", "failures", ("run_id", "attempt"), "merge", _failed), Projection("attempts", "attempt", ("run_id", "attempt"), "merge", _completed), Projection("checkpoints", "checkpoints", ("id",), "merge", _checkpoints)),
    "screening": _SAMPLES,
    "weight_sweep": _SAMPLES,
    "multi_seed_validation": _SAMPLES,
    "final_evaluation": (Projection("evaluations", "metrics", ("checkpoint_id",), "replace", _evaluations),),
}


def _once(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows; a key that comes twice in an output is an error when they are read."""
    wrong = F.raise_error(F.concat_ws(" ", F.lit("twice in one output:"), *(F.col(k).cast("string") for k in keys))).cast("boolean")
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return counted.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(wrong)).drop("_n")


def meet(old: DataFrame, new: DataFrame, how: str, keys: tuple[str, ...]) -> DataFrame:
    """The rows of a table after new ones have met them; ``old`` and ``new`` have the same columns."""
    if how == "replace":
        return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)
    new = _once(new, keys)
    if how == "merge":
        return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
    if how == "absent":
        return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))
    if how == "new":
        there = new.join(old.select(*keys, F.lit(True).alias("_there")), list(keys), "left")
        wrong = F.raise_error(F.concat_ws(" ", F.lit("already there:"), *(F.col(k).cast("string") for k in keys))).cast("boolean")
        return old.unionByName(there.where(F.when(F.col("_there").isNull(), F.lit(True)).otherwise(wrong)).drop("_there"))
    raise ValueError(f"no such way to meet: {how}")


class Store:
    """The tables as Parquet in a shared folder. Only the parts that a stage's rows fall into are read and written anew.

    A table is cut into ``parts`` by the hash of its keys, or, where a stage owns all rows of a run or project, by that column; parts
    are put in place by the writer's dynamic overwrite. What is written is made before, so that a lost executor repeats a read.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder, parts

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table; none before it was written."""
        return self.spark.read.parquet(self._path(name)).drop("_part") if self._there(name) else None

    def _there(self, name: str) -> bool:
        at, files = self._files(f"{self._path(name)}/_part=*")
        return len(files.globStatus(at) or ()) > 0

    def _write(self, rows: DataFrame, table: str, part: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(self._path(table))

    def apply(self, stage: str, outputs: Mapping[str, DataFrame], context: Context) -> None:
        """Writes what a stage's output leaves in its tables."""
        for p in STAGES[stage]:
            if p.source in outputs:
                self._apply(p, p.rows(outputs[p.source], context), context)

    def _apply(self, p: Projection, rows: DataFrame, context: Context) -> None:
        if p.how == "scope":
            # A name that is safe in paths.
            part = "k" + hashlib.sha256(getattr(context, p.keys[0]).encode()).hexdigest()[:32]
            own = materialise(rows, "rows").withColumn("_part", F.lit(part))
            self._write(own, p.table, "_part")
            if not own.limit(1).count():
                at, files = self._files(f"{self._path(p.table)}/_part={part}")
                files.delete(at, True)
            return
        part = F.pmod(F.xxhash64(*p.keys), F.lit(self.parts)).cast("int")
        new = materialise(rows.withColumn("_part", part), f"new-{uuid.uuid4().hex[:8]}")
        if self._there(p.table):
            # At most as many rows as parts.
            touched = F.broadcast(new.select("_part").distinct())
            old = self.spark.read.schema(new.schema).parquet(self._path(p.table)).join(touched, "_part", "left_semi").select(*new.columns)
        else:
            old = new.limit(0)
        self._write(materialise(meet(old, new, p.how, p.keys), "met"), p.table, "_part")
