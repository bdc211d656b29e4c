"""Statistics over tag scores in long form: (asset_id, tag, score), weighted by clusters of near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.functions import tags as ontology
from curato.operators.quality import Rule, reasons

#: From which score a tag is present, and when classes and identity tags are stable.
PRESENT = 0.35
CLASS_SHARE, CLASS_MEAN, CLASS_MARGIN = 0.60, 0.45, 0.15
SAME_SHARE, SAME_MEAN, MOST_CONFLICT, MOST_DOMINANCE = 0.85, 0.55, 0.10, 0.50


def with_canonical(rows: DataFrame, raw: str, name: str = "tag") -> DataFrame:
    """Adds the canonical tag of ``raw``, by a broadcast join with the synonyms."""
    table = rows.sparkSession.createDataFrame(list(ontology.closure(ontology.SYNONYMS).items()), "_key string, _target string")
    rows = rows.withColumn("_key", ontology.normalize(F.col(raw))).join(F.broadcast(table), "_key", "left")
    return rows.withColumn(name, F.coalesce("_target", "_key")).drop("_key", "_target")


def with_category(rows: DataFrame, tag: str = "tag", model: str | None = None) -> DataFrame:
    """Adds ``category`` of a canonical tag, by a broadcast join with the ontology."""
    table = rows.sparkSession.createDataFrame(list(ontology.CATEGORY_OF.items()), f"`{tag}` string, _category string")
    found = F.coalesce(F.col("_category"), ontology.by_affix(F.col(tag)))
    return rows.join(F.broadcast(table), tag, "left").withColumn("category", ontology.of_model(found, F.col(model) if model else None)).drop("_category")


def normalize_scores(scores: DataFrame, least: float = PRESENT, selected_only: bool = False) -> DataFrame:
    """(asset_id, tag, score, category): the best score of each canonical tag of an asset, at ``least`` or more."""
    rows = scores.where(F.col("selected")) if selected_only else scores.where(F.col("score") >= least)
    model = F.col("model_category") if "model_category" in scores.columns else F.lit(None).cast("string")
    rows = with_canonical(rows.select("asset_id", "tag", "score", model.alias("model")), "tag")
    best = rows.groupBy("asset_id", "tag").agg(F.max("score").alias("score"), F.max_by("model", "score").alias("model"))
    return with_category(best, model="model").select("asset_id", "tag", "score", "category")


def classify(scores: DataFrame) -> DataFrame:
    """(tag, canonical, category) of every distinct raw tag."""
    return with_category(with_canonical(scores.select("tag").distinct(), "tag", "canonical"), "canonical").select("tag", "canonical", "category")


def by_cluster(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds ``cluster`` from (asset_id, cluster); an asset without one is its own."""
    return scores.join(clusters, "asset_id", "left").withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.col("asset_id").cast("string")))


def weighted(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """(tag, category, frequency, mean) over clusters, each counting once with its best score; without a tag it counts 0."""
    rows = by_cluster(normalize_scores(scores, 0.0), clusters)
    total = by_cluster(scores.select("asset_id").distinct(), clusters).agg(F.count_distinct("cluster").alias("total"))
    best = rows.groupBy("cluster", "tag", "category").agg(F.max("score").alias("score"))
    sums = best.groupBy("tag", "category").agg(F.count_if(F.col("score") >= PRESENT).alias("hits"), F.sum("score").alias("sum"))
    # One row.
    return sums.crossJoin(F.broadcast(total)).select("tag", "category", (F.col("hits") / F.col("total")).alias("frequency"), (F.col("sum") / F.col("total")).alias("mean"))


def class_statistics(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Weighted statistics of person classes with their rank and the next one's frequency."""
    rows = weighted(scores, clusters).where(F.col("category") == "person_class")
    # As many rows as the ontology has classes.
    order = Window.orderBy(F.desc("frequency"), F.desc("mean"), "tag")
    return rows.select("tag", "frequency", "mean", F.row_number().over(order).alias("rank"), F.coalesce(F.lead("frequency").over(order), F.lit(0.0)).alias("runner_up"))


def class_decision(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: the class if it is frequent, sure and well ahead, and how many tokens to keep in front."""
    rows = class_statistics(scores, clusters).where("rank = 1")
    stable = (F.col("frequency") >= CLASS_SHARE) & (F.col("mean") >= CLASS_MEAN) & (F.col("frequency") - F.col("runner_up") >= CLASS_MARGIN)
    found = rows.agg(F.first(F.when(stable, F.col("tag")), ignorenulls=True).alias("token"))
    return found.withColumn("keep_tokens", F.when(F.col("token").isNotNull(), 2).otherwise(1))


def conflict_ratios(scores: DataFrame) -> DataFrame:
    """(tag, conflict_ratio): of each tag with conflicts, the share of assets that have one of those, with it or not."""
    rows = normalize_scores(scores, 0.0)
    heads = scores.sparkSession.createDataFrame([(h, c) for h, others in ontology.CONFLICTS.items() for c in others], "head string, tag string")
    total = scores.agg(F.count_distinct("asset_id").alias("total"))
    hits = rows.where(F.col("score") >= PRESENT).join(F.broadcast(heads), "tag").groupBy("head").agg(F.count_distinct("asset_id").alias("n"))
    return hits.crossJoin(F.broadcast(total)).select(F.col("head").alias("tag"), (F.col("n") / F.col("total")).alias("conflict_ratio"))


def invariants(scores: DataFrame, clusters: DataFrame, clustered: bool = True) -> DataFrame:
    """Identity tags with their statistics, the reasons against binding them to the trigger, and ``selected``."""
    rows = normalize_scores(scores, 0.0).where(F.col("category").isin(*ontology.IDENTITY))
    total = scores.agg(F.count_distinct("asset_id").alias("total"))
    hits = by_cluster(rows.where(F.col("score") >= PRESENT), clusters).groupBy("tag", "cluster").agg(F.count("*").alias("n"))
    raw = hits.groupBy("tag").agg(F.sum("n").alias("hits"), F.max("n").alias("most"))
    found = weighted(scores, clusters).where(F.col("category").isin(*ontology.IDENTITY)).join(raw, "tag", "left").join(F.broadcast(conflict_ratios(scores)), "tag", "left").crossJoin(F.broadcast(total))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    found = found.select(
        "tag",
        "category",
        zero(F.col("hits") / F.col("total")).alias("raw_frequency"),
        F.col("frequency").alias("deduplicated_frequency"),
        F.col("mean").alias("mean_confidence"),
        zero(F.col("conflict_ratio")).alias("conflict_ratio"),
        zero(F.col("most") / F.col("hits")).alias("cluster_dominance"),
    )
    raw_, own, mean, conflict, dominance = (F.col(c) for c in ("raw_frequency", "deduplicated_frequency", "mean_confidence", "conflict_ratio", "cluster_dominance"))
    groups = [
        [Rule("raw_frequency", "reject", raw_ < SAME_SHARE, raw_, SAME_SHARE)],
        [Rule("deduplicated_frequency", "reject", own < SAME_SHARE, own, SAME_SHARE)],
        [Rule("mean_confidence", "reject", mean < SAME_MEAN, mean, SAME_MEAN)],
        [Rule("conflicts", "reject", conflict > MOST_CONFLICT, conflict, MOST_CONFLICT)],
    ]
    if clustered:
        groups.append([Rule("cluster_dominance", "reject", dominance > MOST_DOMINANCE, dominance, MOST_DOMINANCE)])
    found = found.withColumn("reasons", reasons(groups))
    return found.withColumn("selected", F.size("reasons") == 0).withColumn("warned", ~F.col("selected") & (raw_ >= SAME_SHARE))

