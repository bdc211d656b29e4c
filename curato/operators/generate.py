"""Deterministic stand-ins for models: loss curves, checkpoints' epochs, tags and compatibility decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that the stand-in tagger draws from.
DRAWN_TAGS = "smile looking_at_viewer outdoors indoors standing sitting upper_body full_body white_dress school_uniform blue_hair brown_hair".split()


def target_epochs(epochs: Column) -> Column:
    """The distinct epochs at the quarters of a run, in order."""
    quarter = lambda f: F.greatest(F.lit(1), F.ceil(epochs * f)).cast("int")
    return F.array_sort(F.array_distinct(F.array(*map(quarter, (0.25, 0.5, 0.75, 1.0)))))


def loss_curves(runs: DataFrame) -> DataFrame:
    """(run_id, epoch, step, train_loss, validation_loss) of runs (run_id, epochs, total_steps): falling exponentials."""
    rows = runs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    rows = rows.withColumn("step", F.greatest(F.lit(1), F.ceil(F.col("total_steps") * F.col("epoch") / F.col("epochs"))))
    done = F.col("step") / F.col("total_steps")
    train = F.greatest(F.lit(0.02), 0.65 * F.exp(-2.2 * done))
    validation = F.greatest(F.lit(0.03), 0.58 * F.exp(-1.7 * done) + F.col("epoch") * 0.002)
    return rows.select("run_id", "epoch", "step", train.alias("train_loss"), validation.alias("validation_loss"))


def drawn_tags(assets: DataFrame, digest: str, class_tag: str = "1girl") -> DataFrame:
    """(asset_id, tag, score): a class, solo, and three to five tags drawn by the bytes of the digest's own digest."""
    seed = F.sha2(F.unhex(F.col(digest)), 256)
    byte = lambda i: F.conv(F.substring("seed", 2 * i + 1, 2), 16, 10).cast("int")
    rows = assets.select("asset_id", seed.alias("seed"))
    hit = F.filter(F.array(*(F.when(byte(i) % 5 == 0, F.lit(t)) for i, t in enumerate(DRAWN_TAGS))), lambda t: t.isNotNull())
    every = F.array(*map(F.lit, DRAWN_TAGS))
    chosen = F.slice(hit, 1, 5)
    chosen = F.when(F.size(chosen) >= 3, chosen).otherwise(F.slice(F.concat(chosen, F.filter(every, lambda t: ~F.array_contains(chosen, t))), 1, 3))
    rows = rows.withColumn("bytes", F.array(*map(byte, range(5)))).withColumn("chosen", chosen)
    tags = F.transform("chosen", lambda t, i: F.struct(t.alias("tag"), (0.55 + F.col("bytes")[i] / 1024).alias("score")))
    fixed = F.array(F.struct(F.lit(class_tag).alias("tag"), F.lit(0.97).alias("score")), F.struct(F.lit("solo").alias("tag"), F.lit(0.92).alias("score")))
    return rows.select("asset_id", F.explode(F.concat(fixed, tags)).alias("t")).select("asset_id", "t.tag", "t.score")


def compatibility(runtimes: DataFrame) -> DataFrame:
    """Adds ``reasons`` and ``compatible`` to (major, minor, arches, cuda_version, tensor_ok, bf16_ok)."""
    arches = F.transform("arches", lambda a: F.replace(F.lower(a), F.lit(" "), F.lit("")))
    wanted = F.concat(F.lit("sm_"), F.col("major").cast("string"), F.col("minor").cast("string"))
    numbers = F.transform(F.regexp_extract_all("cuda_version", F.lit("([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    newest = F.col("major") >= 12
    found = F.array(
        F.when(~F.array_contains(arches, wanted), "arch_missing"),
        F.when(~F.col("tensor_ok"), "tensor_failed"),
        F.when((F.col("major") >= 8) & ~F.col("bf16_ok"), "bf16_failed"),
        F.when(newest & (F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0))) < F.array(F.lit(12), F.lit(8))), "cuda_too_old"),
    )
    rows = runtimes.withColumn("reasons", F.filter(found, lambda r: r.isNotNull()))
    return rows.withColumn("compatible", F.size("reasons") == 0)


def sample_id(*fields: tuple[str, Column]) -> Column:
    """32 hexadecimal digits of the SHA-256 of the fields as JSON with sorted keys."""
    ordered = sorted(fields)
    whole = F.to_json(F.struct(*(value.alias(name) for name, value in ordered)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)
