"""Evaluation of candidates: signals, compliance, weights and ranking."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.functions.columns import clamp, cosine, term, unit
from curato.operators.embeddings import nearest

# Weights of the metrics, and what else a score depends on.
CHARACTER_WEIGHTS = {"identity": 0.35, "prompt_compliance": 0.20, "flexibility": 0.15, "consistency": 0.10, "validation": 0.10, "technical": 0.05, "visual_heuristic": 0.05}
STYLE_WEIGHTS = {"style_similarity": 0.30, "prompt_compliance": 0.20, "flexibility": 0.20, "consistency": 0.10, "validation": 0.10, "technical": 0.05, "visual_heuristic": 0.05}
ALIASES = {"content_compliance": "prompt_compliance", "content_flexibility": "flexibility"}
MOST_FAILURES, OVERFIT, PENALTY, USUAL_WEIGHT = 0.25, 0.7, 0.2, 0.8


def is_blank(mean: Column, spread: Column) -> Column:
    """Whether a generated image, scaled to 0..1, is empty, black or white."""
    return (spread < 0.003) | (mean < 0.003) | (mean > 0.997)


def health(mean: Column, spread: Column) -> Column:
    """How usable an image looks by its brightness and contrast."""
    return clamp(spread / 0.18) * (1 - F.least(F.lit(1.0), F.abs(mean - 0.5)))


def prompt_terms(prompt: Column, trigger: str) -> Column:
    """The distinct terms that a prompt asks for, without quality words and the trigger."""
    own = "_".join(re.findall("[a-z0-9]+", trigger.lower()))
    terms = F.array_distinct(F.transform(F.split(prompt, ","), term))
    return F.array_except(terms, F.array(*map(F.lit, ["high_quality", "best_quality", "masterpiece", own, ""])))


def compliance(prompt: Column, tags: Column, trigger: str) -> Column:
    """The share of a prompt's terms that hold, or are held by, one of the tags; 1 if it asks for nothing."""
    asked = prompt_terms(prompt, trigger)
    seen = F.filter(F.transform(tags, term), lambda t: t != "")
    hit = F.filter(asked, lambda a: F.exists(seen, lambda t: t.contains(a) | a.contains(t)))
    return F.when(F.size(asked) == 0, F.lit(1.0)).otherwise(F.size(hit) / F.size(asked))


def min_max(value: Column, window: Window) -> Column:
    """The place of a value between the least and most of its window; 0.5 where they are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))


def recommended_weight(samples: DataFrame, key: str) -> DataFrame:
    """(key, recommended_weight): the weight whose usable samples score best, then the one nearest 0.8, then the lower."""
    rows = samples.withColumn("value", 0.5 * F.col("health") + 0.5 * F.col("compliance")).groupBy(key, "weight").agg(F.avg("value").alias("mean"))
    order = F.struct(F.round("mean", 9).alias("m"), (-F.abs(F.col("weight") - USUAL_WEIGHT)).alias("d"), (-F.col("weight")).alias("w"))
    return rows.groupBy(key).agg(F.max_by("weight", order).alias("recommended_weight"))


def mean_pairwise(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, pairwise): the mean cosine of all pairs of a group; 1 for a single vector.

    The sum over pairs follows from the length of the sum of unit vectors, so no pairs are made.
    """
    parts = vectors.select(*keys, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    sums = parts.groupBy(*keys, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    pairwise = F.when(F.col("n") > 1, clamp((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))).otherwise(F.lit(1.0))
    return whole.select(*keys, "n", pairwise.alias("pairwise"))


def candidate_signals(samples: DataFrame, key: str) -> DataFrame:
    """(key, failure_rate, technical, visual_heuristic, prompt_compliance, n, usable) from samples.

    Samples: success, mean, spread and compliance; a failed, unreadable or blank one isn't usable.
    """
    ok = F.col("success") & F.col("mean").isNotNull() & ~is_blank(F.col("mean"), F.col("spread"))
    rows = samples.withColumn("ok", F.coalesce(ok, F.lit(False)))
    own = lambda value: F.coalesce(F.avg(F.when(F.col("ok"), value)), F.lit(0.0))
    found = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("usable"),
        own(health(F.col("mean"), F.col("spread"))).alias("visual_heuristic"),
        own(F.col("compliance")).alias("prompt_compliance"),
    )
    rate = 1 - F.col("usable") / F.col("n")
    return found.withColumn("failure_rate", rate).withColumn("technical", F.greatest(F.lit(0.0), 1 - rate))


def _centroids(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, centroid): the mean vector of each group."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def vector_signals(samples: DataFrame, references: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, reference_similarity, nearest, consistency, prompt_similarity) of usable samples (sample_id, key, prompt, vector).

    Similarities to the references' centroid, and to the nearest reference; how alike a prompt's samples are, and how
    alike the prompts' centroids.
    """
    middle = references.select(F.lit(0).alias("all"), F.col(vector)).transform(lambda r: _centroids(r, ["all"], vector)).select("centroid")
    # One row.
    own = samples.crossJoin(F.broadcast(middle)).groupBy(key).agg(F.avg(cosine(F.col(vector), F.col("centroid"))).alias("reference_similarity"))
    near = nearest(samples.select("sample_id", vector), references.select(F.col("reference_id").alias("sample_id"), vector), "sample_id", vector, skip_self=False)
    near = samples.select("sample_id", key).join(near, "sample_id").groupBy(key).agg(F.max("cosine").alias("nearest"))
    alike = mean_pairwise(samples, [key, "prompt"], vector).groupBy(key).agg(F.avg("pairwise").alias("consistency"))
    prompts = mean_pairwise(_centroids(samples, [key, "prompt"], vector), [key], "centroid").select(key, F.col("pairwise").alias("prompt_similarity"))
    return own.join(near, key).join(alike, key).join(prompts, key)


def visual_signals(samples: DataFrame, references: DataFrame, key: str, invariants: Sequence[str] = (), semantic: bool = True) -> DataFrame:
    """All signals of candidates from samples (sample_id, key, prompt, success, mean, spread, compliance, weight, tags, pixel, semantic).

    References have reference_id, pixel and semantic. Pixels and learned embeddings count half each, invariant tags a
    quarter of the similarity to the references. A candidate without usable samples has zeros and the usual weight.
    """
    ok = F.coalesce(F.col("success") & F.col("mean").isNotNull() & ~is_blank(F.col("mean"), F.col("spread")), F.lit(False))
    usable = samples.where(ok)
    found = candidate_signals(samples, key)
    kinds = ["pixel", "semantic"] if semantic else ["pixel"]
    names = ("reference_similarity", "nearest", "consistency", "prompt_similarity")
    for kind in kinds:
        rows = vector_signals(usable, references, key, kind)
        found = found.join(rows.select(key, *(F.col(n).alias(f"{kind}_{n}") for n in names)), key, "left")
    for n in names:
        found = found.withColumn(n, sum((F.coalesce(f"{kind}_{n}", F.lit(0.0)) for kind in kinds), F.lit(0.0)) / len(kinds))
    own = sorted({"_".join(re.findall("[a-z0-9]+", t.lower())) for t in invariants})
    if own:
        held = F.size(F.array_intersect(F.array_distinct(F.transform("tags", term)), F.array(*map(F.lit, own)))) / len(own)
        found = found.join(usable.groupBy(key).agg(F.avg(held).alias("invariant_score")), key, "left")
        blend = F.when(F.col("usable") > 0, 0.75 * F.col("reference_similarity") + 0.25 * F.col("invariant_score")).otherwise(F.col("reference_similarity"))
        found = found.withColumn("reference_similarity", blend)
    best = usable.withColumn("health", health(F.col("mean"), F.col("spread")))
    found = found.join(recommended_weight(best, key), key, "left").withColumn("recommended_weight", F.coalesce("recommended_weight", F.lit(USUAL_WEIGHT)))
    some = F.col("usable") > 0
    return found.select(
        key,
        "n",
        "usable",
        clamp(F.col("reference_similarity")).alias("reference_similarity"),
        clamp(F.col("prompt_compliance")).alias("prompt_compliance"),
        F.when(some, clamp((1 - F.col("prompt_similarity")) * 5)).otherwise(F.lit(0.0)).alias("flexibility"),
        clamp(F.col("consistency")).alias("consistency"),
        "technical",
        clamp(F.col("visual_heuristic")).alias("visual_heuristic"),
        "failure_rate",
        memorisation_risk(F.col("nearest")).alias("memorisation_risk"),
        "recommended_weight",
    )


def memorisation_risk(nearest: Column) -> Column:
    """How near a sample is to a reference, from 0.985 to 1."""
    return clamp((nearest - 0.985) / 0.015)


def validation_score(loss: Column) -> Column:
    """1 minus the loss, not under 0; 0.5 without one."""
    return F.when(loss.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1 - loss))


def score(candidates: DataFrame, weights: Mapping[str, float] = CHARACTER_WEIGHTS, penalty: float = PENALTY) -> DataFrame:
    """Adds ``gate_passed``, ``score`` and ``warnings``: a corrupted or often failing candidate scores 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(ALIASES.get(name, name)) * weight
    passed = ~F.col("corrupted") & (F.col("failure_rate") <= MOST_FAILURES)
    warnings = F.array(F.when(F.col("corrupted"), "corrupted"), F.when(F.col("failure_rate") > MOST_FAILURES, "failure_rate"), F.when(F.col("overfit_risk") >= OVERFIT, "overfit"))
    rows = candidates.withColumn("gate_passed", passed).withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))
    return rows.withColumn("score", F.when(passed, clamp(total - F.col("overfit_risk") * penalty)).otherwise(F.lit(0.0)))


def rank(scored: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank`` within groups: passed ones first, then by score and key. Without groups candidates are few."""
    order = Window.partitionBy(*by).orderBy(F.desc("gate_passed"), F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order))


def select_best(scored: DataFrame, key: str, alternatives: int = 3) -> DataFrame:
    """The best candidate and the next ones that passed the gate."""
    return scored.where("gate_passed").orderBy(F.desc("score"), key).limit(1 + alternatives)
