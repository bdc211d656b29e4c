"""Review of assets: overrides, categories and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("Accepted", "Rejected", "Warning", "Duplicate", "Validation")
PRIORITY = ("Rejected", "Validation", "Duplicate", "Warning", "Accepted")


def apply_overrides(assets: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Adds ``included`` and ``gate_disposition`` by overrides (key, forced: true in, false out).

    An asset is in if it was accepted and is no duplicate, unless an override says otherwise. For the gate a rejected
    asset that is forced in only warns, and an excluded one without fault is rejected.
    """
    rows = assets.join(overrides.select(key, "forced"), key, "left")
    kept = F.coalesce(F.col("forced"), (F.col("disposition") != "reject") & ~F.col("duplicate"))
    rows = rows.withColumn("included", kept)
    adjusted = F.when(F.col("included") & (F.col("disposition") == "reject"), "warn").when(~F.col("included") & (F.col("disposition") == "accept"), "reject").otherwise(F.col("disposition"))
    return rows.withColumn("gate_disposition", adjusted)


def categories(assets: DataFrame) -> DataFrame:
    """Adds ``categories``, in a fixed order: one asset may have several."""
    pick = lambda when, name: F.when(when, F.lit(name))
    found = F.array(
        F.when(F.col("included"), "Accepted").otherwise("Rejected"),
        pick((F.col("disposition") == "warn") | F.col("outlier"), "Warning"),
        pick(F.col("duplicate"), "Duplicate"),
        pick(F.col("included") & F.col("validation"), "Validation"),
    )
    return assets.withColumn("categories", F.filter(found, lambda c: c.isNotNull()))


def primary_category(assets: DataFrame) -> DataFrame:
    """Adds ``primary``, the weightiest of the categories."""
    return assets.withColumn("primary", F.coalesce(*(F.when(F.array_contains("categories", name), name) for name in PRIORITY)))


def facets(assets: DataFrame) -> DataFrame:
    """The number of assets of each category; an asset counts for each one it has."""
    return assets.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
