"""Coverage, entropy and dominance of tag categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.functions import tags as ontology
from curato.functions.columns import clamp


def category_diversity(scores: DataFrame) -> DataFrame:
    """A row for each category of the ontology, those without tags included; a tag counts once in an asset."""
    model = F.col("model_category") if "model_category" in scores.columns else None
    rows = scores.select("asset_id", ontology.canonical(F.col("tag")).alias("tag"), ontology.category(ontology.canonical(F.col("tag")), model).alias("category")).distinct()
    total = scores.agg(F.count_distinct("asset_id").alias("total"))
    counts = rows.groupBy("category", "tag").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("category")
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
    per = shares.groupBy("category").agg(
        F.count("*").alias("unique_tags"),
        (-F.sum(F.col("share") * F.log("share"))).alias("raw"),
        F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("dominant_tag"),
        F.max("n").alias("most"),
    )
    covered = rows.groupBy("category").agg(F.count_distinct("asset_id").alias("covered"))
    every = scores.sparkSession.createDataFrame([(c,) for c in ontology.CATEGORIES], "category string")
    found = every.join(per, "category", "left").join(covered, "category", "left").crossJoin(F.broadcast(total))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return found.select(
        "category",
        F.coalesce("unique_tags", F.lit(0)).alias("unique_tags"),
        zero(F.try_divide("covered", "total")).alias("coverage"),
        clamp(zero(F.when(F.col("unique_tags") > 1, F.col("raw") / F.log("unique_tags")))).alias("normalized_entropy"),
        "dominant_tag",
        clamp(zero(F.try_divide("most", "total"))).alias("dominant_ratio"),
    )


def report(scores: DataFrame, clusters: DataFrame | None = None, similarities: DataFrame | None = None) -> DataFrame:
    """One row: content diversity, dominances, style consistency and warnings."""
    content = F.col("category").isin(*ontology.CONTENT) & (F.col("coverage") > 0)
    pick = lambda name: F.max(F.when(F.col("category") == name, F.col("dominant_ratio")))
    found = category_diversity(scores).agg(
        F.coalesce(F.avg(F.when(content, F.col("normalized_entropy"))), F.lit(0.0)).alias("content_diversity"),
        pick("character").alias("character_ratio"),
        pick("copyright").alias("copyright_ratio"),
    )
    assets = scores.select("asset_id").distinct()
    if clusters is None:
        dominance = assets.agg(F.lit(0.0).alias("duplicate_dominance"))
    else:
        sizes = assets.join(clusters, "asset_id", "left").groupBy(F.coalesce(F.col("cluster").cast("string"), F.col("asset_id").cast("string")).alias("c")).agg(F.count("*").alias("n"))
        dominance = sizes.agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("duplicate_dominance"))
    style = assets.limit(1).agg(F.lit(1.0).alias("style_consistency")) if similarities is None else similarities.agg(F.coalesce(clamp(F.avg("similarity")), F.lit(1.0)).alias("style_consistency"))
    # Each side is one row.
    rows = found.crossJoin(F.broadcast(dominance)).crossJoin(F.broadcast(style))
    warnings = F.array(
        F.when(F.col("content_diversity") < 0.25, "low_content_diversity"),
        F.when(F.col("character_ratio") > 0.75, "single_character"),
        F.when(F.col("duplicate_dominance") > 0.35, "near_duplicate_dominance"),
        F.when(F.col("style_consistency") < 0.25, "style_inconsistency"),
    )
    return rows.withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
