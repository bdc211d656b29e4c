"""Explainable rules: reasons, dispositions, reports and the dataset gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.functions.columns import aspect_ratio
from curato.operators.graph import materialise
from curato.operators.statistics import median_of

REJECT, WARNING = "reject", "warning"


@dataclass(frozen=True)
class QualityLimits:
    """Thresholds of the image rules."""

    largest_side: int = 32_768
    largest_area: int = 100_000_000
    good_short_side: int = 512
    least_short_side: int = 64
    odd_aspect: float = 3.0
    extreme_aspect: float = 8.0
    blank_spread: float = 2.0
    blank_range: float = 8.0
    black: float = 1.0
    white: float = 254.0
    sharp: float = 35.0
    blocky: float = 1.8
    alpha: float = 0.05


@dataclass(frozen=True)
class Rule:
    """A reason that holds where ``when`` does."""

    code: str
    severity: str
    when: Column
    value: Column
    threshold: float
    message: str = ""


def reasons(groups: Sequence[Sequence[Rule]]) -> Column:
    """The reasons of a row in order: of each group of rules the first that holds."""

    def first(group: Sequence[Rule]) -> Column:
        found = F.lit(None)
        for rule in reversed(group):
            reason = F.struct(F.lit(rule.code).alias("code"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"), rule.value.cast("double").alias("value"), F.lit(float(rule.threshold)).alias("threshold"))
            found = F.when(rule.when, reason).otherwise(found)
        return found

    return F.filter(F.array(*map(first, groups)), lambda r: r.isNotNull())


def image_rules(limits: QualityLimits = QualityLimits()) -> list[list[Rule]]:
    """The rules over the columns of image metrics, in groups of which one reason counts."""
    width, height, short = F.col("width"), F.col("height"), F.col("short_side")
    mean, spread, span = F.col("luminance_mean"), F.col("luminance_stddev"), F.col("luminance_range")
    ratio = aspect_ratio(width, height)
    area = width.cast("long") * height.cast("long")
    impossible = (width <= 0) | (height <= 0) | (F.greatest(width, height) > limits.largest_side) | (area > limits.largest_area)
    return [
        [Rule("impossible_dimensions", REJECT, impossible, F.greatest(width, height), limits.largest_side, "The size is outside the supported limits")],
        [
            Rule("extremely_low_resolution", REJECT, short < limits.least_short_side, short, limits.least_short_side, "Too small to be useful"),
            Rule("low_resolution", WARNING, short < limits.good_short_side, short, limits.good_short_side, "The short side is under the preferred range"),
        ],
        [
            Rule("extreme_aspect_ratio", REJECT, ratio > limits.extreme_aspect, ratio, limits.extreme_aspect, "The sides are too unequal"),
            Rule("aspect_ratio_outlier", WARNING, ratio > limits.odd_aspect, ratio, limits.odd_aspect, "The sides are unusually unequal"),
        ],
        [
            Rule("all_black", REJECT, mean <= limits.black, mean, limits.black, "Nothing but black"),
            Rule("all_white", REJECT, mean >= limits.white, mean, limits.white, "Nothing but white"),
            Rule("near_empty", REJECT, (spread < limits.blank_spread) | (span < limits.blank_range), spread, limits.blank_spread, "Hardly any change of brightness"),
        ],
        [Rule("blur", WARNING, F.col("sharpness") < limits.sharp, F.col("sharpness"), limits.sharp, "Less sharp than the limit")],
        [Rule("compression_artifacts", WARNING, F.col("compression_blockiness") > limits.blocky, F.col("compression_blockiness"), limits.blocky, "Edges of blocks stand out")],
        [Rule("significant_alpha", WARNING, F.col("alpha_fraction") >= limits.alpha, F.col("alpha_fraction"), limits.alpha, "Much of it is transparent")],
    ]


def disposition(found: Column) -> Column:
    """``reject`` with a rejecting reason, ``warn`` with any other, else ``accept``."""
    return F.when(F.exists(found, lambda r: r["severity"] == REJECT), "reject").when(F.size(found) > 0, "warn").otherwise("accept")


def assess(metrics: DataFrame, limits: QualityLimits = QualityLimits(), early: Column | None = None) -> DataFrame:
    """Adds ``reasons``, ``disposition`` and ``accepted`` to image metrics.

    ``early`` is the code of a failure before the metrics were taken (missing, unreadable, unsafe_image,
    animated_image), null where there was none: such rows are rejected for that reason alone.
    """
    found = reasons(image_rules(limits))
    if early is not None:
        stop = F.struct(early.alias("code"), F.lit(REJECT).alias("severity"), F.lit("").alias("message"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"))
        found = F.when(early.isNotNull(), F.array(stop)).otherwise(found)
    rows = metrics.withColumn("reasons", found)
    return rows.withColumn("disposition", disposition(F.col("reasons"))).withColumn("accepted", F.col("disposition") != "reject")


def reason_rows(assessed: DataFrame, key: str) -> DataFrame:
    """A row for each reason: key, ordinal, code, severity. The outer form keeps Catalyst from computing the rules once more in a filter."""
    return assessed.select(key, F.posexplode_outer("reasons").alias("ordinal", "r")).where(F.col("r").isNotNull()).select(key, "ordinal", "r.code", "r.severity")


def reason_counts(assessed: DataFrame) -> DataFrame:
    """How often each reason was given."""
    return assessed.select(F.explode_outer("reasons.code").alias("code")).where(F.col("code").isNotNull()).groupBy("code").agg(F.count("*").alias("n"))


def report_counts(assessed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, accepted, warned and rejected rows, by group."""
    when = lambda name: F.count_if(F.col("disposition") == name)
    return assessed.groupBy(*by).agg(F.count("*").alias("total"), (when("accept") + when("warn")).alias("accepted"), when("warn").alias("warned"), when("reject").alias("rejected"))


def distribution(assessed: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Least, median (interpolated) and most of a column over accepted rows; 0 without any."""
    own = F.when(F.col("accepted"), F.col(column))
    zero = lambda x, name: F.coalesce(x, F.lit(0)).cast("double").alias(name)
    if not by:
        written = materialise(assessed.where("accepted").select(F.col(column).cast("double").alias("v")), "values")
        v = F.col("v")
        return written.agg(zero(F.min(v), "low"), zero(F.lit(median_of(written, v)), "mid"), zero(F.max(v), "high"))
    return assessed.groupBy(*by).agg(zero(F.min(own), "low"), zero(F.median(own), "mid"), zero(F.max(own), "high"))


def nth_share(rows: DataFrame, column: str, share: float, by: Sequence[str]) -> DataFrame:
    """By group, the element at index int(n * share) of the column's values in ascending order.

    Values are counted first, so the running sum goes over distinct values only.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    counted = counted.withColumn("n", F.sum("c").over(group)).withColumn("upto", F.sum("c").over(group.orderBy(column)))
    return counted.where(F.col("upto") > F.floor(F.col("n") * share)).groupBy(*by).agg(F.min(column).alias("nth"))


@dataclass(frozen=True)
class GateLimits:
    """Limits of the dataset gate; counts are those of character datasets."""

    least: int = 8
    guidance: int = 20
    dominance: float = 0.35
    diversity: float = 0.25
    character_ratio: float = 0.75
    consistency: float = 0.25
    style: bool = False


def gate(signals: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """Adds ``issues`` and ``passed`` to rows of dataset signals, one for each dataset.

    Signals: accepted, near_duplicate_dominance and, for style datasets, content_diversity, dominant_character_ratio
    and style_consistency.
    """
    accepted = F.col("accepted")
    groups = [
        [Rule("accepted_below_hard_minimum", REJECT, accepted < limits.least, accepted, limits.least), Rule("accepted_below_guidance", WARNING, accepted < limits.guidance, accepted, limits.guidance)],
        [Rule("near_duplicate_dominance", WARNING, F.col("near_duplicate_dominance") > limits.dominance, F.col("near_duplicate_dominance"), limits.dominance)],
    ]
    if limits.style:
        groups += [
            [Rule("low_style_content_diversity", REJECT, F.col("content_diversity") < limits.diversity, F.col("content_diversity"), limits.diversity)],
            [Rule("single_character_dominance", WARNING, F.col("dominant_character_ratio") > limits.character_ratio, F.col("dominant_character_ratio"), limits.character_ratio)],
            [Rule("style_inconsistency", WARNING, F.col("style_consistency") < limits.consistency, F.col("style_consistency"), limits.consistency)],
        ]
    rows = signals.withColumn("issues", reasons(groups))
    return rows.withColumn("passed", ~F.exists("issues", lambda r: r["severity"] == REJECT))


def tag_signals(tags: DataFrame, key: str, families: dict[str, tuple[Sequence[str], float]], severity: str = WARNING) -> DataFrame:
    """(key, code, tag, score): the strongest tag of each family that reaches its threshold; ties go to the first listed.

    ``tags`` is long: key, tag, score.
    """
    rows = []
    for code, (names, least) in families.items():
        place = F.lit(None).cast("int")
        for i, name in enumerate(names):
            place = F.when(F.col("tag") == name, i).otherwise(place)
        own = tags.withColumn("place", place).where(F.col("place").isNotNull())
        best = own.groupBy(key).agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "tag")).alias("b"))
        rows.append(best.select(key, F.lit(code).alias("code"), F.lit(severity).alias("severity"), "b.tag", "b.score").where(F.col("score") >= least))
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out
