"""Sinks: captions, tag records, dataset configurations, splits and packages."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.operators.constraints import strict
from curato.operators.evaluation import select_best


def caption_payloads(captions: DataFrame) -> DataFrame:
    """(asset_id, payload, digest): a caption's line as it is written; an unsafe id or an empty or broken line is an error."""
    line = F.regexp_replace("caption", "^\\s+|\\s+$", "")
    rules = {"asset_id": F.col("asset_id").cast("string").rlike("^[A-Za-z0-9._-]+$") & ~F.col("asset_id").cast("string").isin(".", ".."), "caption": (F.length(line) > 0) & ~F.col("caption").rlike("[\\r\\n]")}
    rows = strict(captions, rules).select("asset_id", F.concat(line, F.lit("\n")).alias("payload"))
    return rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))


def changed_captions(captions: DataFrame, written: DataFrame) -> DataFrame:
    """The payloads which differ from those written before (asset_id, digest)."""
    return caption_payloads(captions).join(written.select("asset_id", "digest"), ["asset_id", "digest"], "left_anti")


def write_captions(captions: DataFrame, path: str) -> DataFrame:
    """Appends new and changed captions to a table of versions and returns the current ones."""
    spark = captions.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # a first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = caption_payloads(captions).limit(0).withColumn("version", F.lit(0))
    current = old.groupBy("asset_id").agg(F.max_by("digest", "version").alias("digest"), F.max("version").alias("version"))
    version = (old.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1
    changed_captions(captions, current).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("asset_id").agg(F.max_by("payload", "version").alias("payload"), F.max_by("digest", "version").alias("digest"))


def write_tag_records(scores: DataFrame, path: str, revision: str) -> None:
    """A JSON record of tags for each asset, in a folder of the model's revision."""
    rows = scores.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("tag", "score"))).alias("tags")).withColumn("revision", F.lit(revision))
    rows.write.mode("overwrite").partitionBy("revision").option("partitionOverwriteMode", "dynamic").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """The accepted rows in folders of their split; what was there before goes."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def dataset_toml(plan: Mapping[str, object], image_dir: str, validation: bool = False) -> tuple[str, str]:
    """(name, text) of a dataset configuration; the name comes from the text, so that equal ones share a file."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    general = {"caption_extension": ".txt", "shuffle_caption": not validation and plan["shuffle_caption"], "keep_tokens": plan["keep_tokens"]}
    dataset = {"resolution": plan["resolution"], "batch_size": 1 if validation else plan["batch_size"], "enable_bucket": True, "bucket_no_upscale": True}
    subset = {"image_dir": image_dir, "num_repeats": 1 if validation else plan["repeats"]}
    blocks = [("[general]", general), ("[[datasets]]", dataset), ("[[datasets.subsets]]", subset)]
    text = "\n\n".join("\n".join([head, *(f"{k} = {show(v)}" for k, v in body.items())]) for head, body in blocks) + "\n"
    return f"dataset-{hashlib.sha256(text.encode()).hexdigest()[:16]}.toml", text


def package_manifest(scored: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """(key, role, digest): the best candidate and up to three alternatives with the digests of their files."""
    best = select_best(scored, key).select(key, "score")
    # Four rows at most.
    top = best.agg(F.max(F.struct("score", F.col(key).alias("k"))).alias("m"))
    rows = best.crossJoin(F.broadcast(top)).join(checkpoints.select(key, "digest"), key)
    return rows.select(key, F.when(F.col("score") == F.col("m.score"), "final").otherwise("alternative").alias("role"), "digest")


def reproducibility(samples: DataFrame, by: str) -> DataFrame:
    """The distinct seeds, weights and prompts of each run, sorted."""
    return samples.groupBy(by).agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("seed", "weight", "prompt_id")))
