"""Splits, buckets, capacity, plans, recovery, scheduling and sampling matrices."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.functions.columns import round_half_even, round_half_up


def holdout_size(n: Column, ratio: float, least: int, most: int, enabled_at: int, half_even: bool = False) -> Column:
    """How many of ``n`` are held out: none below ``enabled_at``, else the rounded share within limits."""
    share = n * F.lit(float(ratio))
    rounded = round_half_even(share) if half_even else round_half_up(share)
    return F.when(n < enabled_at, F.lit(0)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), rounded))).cast("long")


def group_rank(seed: int, key: Column) -> Column:
    """The order of groups: SHA-256 of seed, NUL and key."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), key.cast("string")).cast("binary"), 256)


def hash_holdout(assets: DataFrame, key: str, wanted: int, seed: int = 42, cluster: str | None = None) -> DataFrame:
    """Adds ``split``: whole groups go to validation in the order of their hashes while that doesn't take the
    number further from ``wanted``; at least one group does.

    With clusters the groups that may still be taken are read in order, a thousand at a time, until the number is reached:
    of those read at once the first is taken, so the reads are no more than the groups held out.
    """
    own = F.coalesce(F.col(cluster).cast("string"), F.col(key).cast("string")) if cluster else F.col(key).cast("string")
    if wanted <= 0:
        return assets.withColumn("split", F.lit("train"))
    groups = assets.groupBy(own.alias("_group")).agg(F.count("*").alias("n")).withColumn("rank", group_rank(seed, F.col("_group")))
    if cluster is None:
        taken = groups.orderBy("rank", "_group").limit(wanted).select("_group")
    else:
        taken, total, after = [], 0, None
        while total < wanted:
            # A group is taken if that leaves the number no further off: of those after the last one read, only such are asked for.
            small = groups.where(F.col("n") <= 2 * (wanted - total)) if taken else groups
            some = (small.where(F.struct("rank", "_group") > F.struct(*map(F.lit, after))) if after else small).orderBy("rank", "_group").limit(1000).collect()
            if not some:
                break
            for row in some:
                after = (row["rank"], row["_group"])
                if total < wanted and (not taken or abs(wanted - total - row.n) <= wanted - total):
                    taken.append((row["_group"],))
                    total += row.n
        taken = assets.sparkSession.createDataFrame(taken, "_group string")
    marked = assets.withColumn("_group", own).join(taken.withColumn("_held", F.lit(True)), "_group", "left")
    return marked.withColumn("split", F.when(F.col("_held"), "validation").otherwise("train")).drop("_group", "_held")


def shuffled_holdout(ids: Sequence[str], ratio: float, seed: int = 42) -> tuple[list[str], list[str]]:
    """(training, validation) by shuffling sorted ids with Python's generator: for the few ids of one dataset."""
    order = sorted(ids)
    random.Random(seed).shuffle(order)
    cut = math.ceil(len(order) * (1 - ratio))
    return order[:cut], order[cut:]


def bucket(width: Column, height: Column, most: Column, step: int = 64) -> tuple[Column, Column]:
    """(width, height) of the training bucket of an image that is never enlarged; null if it is too small for one.

    Images over the largest area are scaled to it. Of the sizes made by rounding the new width or the new height to
    the step, the one whose own aspect ratio is nearer is taken, the height's on a tie.
    """
    near = lambda v: F.floor(v + 0.5)
    stepped = lambda v: near(v) - near(v) % step
    w, h = width.cast("double"), height.cast("double")
    ratio, area = w / h, (most * most).cast("double")
    scaled = F.sqrt(area * ratio)
    w1 = stepped(scaled)
    h1 = stepped(w1 / ratio)
    h2 = stepped(area / scaled)
    w2 = stepped(h2 * ratio)
    error = lambda a, b: F.when(F.least(a, b) >= step, F.abs(F.try_divide(a.cast("double"), b.cast("double")) - ratio))
    e1, e2 = error(w1, h1), error(w2, h2)
    by_width = e1.isNotNull() & (e2.isNull() | (e1 < e2))
    large = width.cast("long") * height > most * most
    fits = ~large | e1.isNotNull() | e2.isNotNull()
    new_w = F.when(~large, width).when(by_width, w1).otherwise(near(h2 * ratio)).cast("long")
    new_h = F.when(~large, height).when(by_width, near(w1 / ratio)).otherwise(h2).cast("long")
    bw, bh = new_w - new_w % step, new_h - new_h % step
    good = (F.least(width, height) >= step) & fits & (F.least(bw, bh) >= step)
    return F.when(good, bw), F.when(good, bh)


def vram_estimate(resolution: Column, batch: Column, rank: Column, full_precision: Column) -> Column:
    """MiB that a training run needs."""
    # The estimate's parts.
    base = F.when(resolution == 768, 6144).when(resolution == 896, 8192).when(resolution == 1024, 10240)
    return base + (batch - 1) * 1536 + F.greatest(rank - 32, F.lit(0)) * 8 + F.when(full_precision, 2048).otherwise(0)


def auto_resolution(short_p10: Column, short_median: Column, free_mb: Column, rank: Column) -> Column:
    """The largest of 768, 896 and 1024 that images, memory and rank allow."""
    side = F.when(short_p10 == 0, short_median).otherwise(short_p10)
    images = F.when(side >= 960, 1024).when(side >= 832, 896).otherwise(768)
    memory = F.when(free_mb < 10 * 1024, 768).when(free_mb < 16 * 1024, 896).otherwise(1024)
    memory = F.when((rank >= 64) & (memory > 768), 896).otherwise(memory)
    return F.least(images, memory)


def auto_batch(resolution: Column, free_mb: Column, rank: Column) -> Column:
    """The batch size for a resolution and free memory; halved for high ranks."""
    gb = free_mb / 1024
    size = (
        F.when(resolution == 1024, F.when(gb >= 20, 2).otherwise(1))
        .when(resolution == 896, F.when(gb >= 24, 4).when(gb >= 14, 2).otherwise(1))
        .otherwise(F.when(gb >= 20, 4).when(gb >= 10, 2).otherwise(1))
    )
    return F.greatest(F.lit(1), F.floor(size / F.when(rank <= 32, 1).otherwise(2))).cast("int")


def target_steps(least: int, most: int, accepted: Column, guidance: int, diversity: Column, style: bool) -> Column:
    """Steps between two limits, by the number of images and their diversity; halves are rounded to even."""
    size = F.least(F.lit(1.0), accepted / F.lit(float(max(1, 2 * guidance))))
    quality = diversity if style else 0.75 + 0.25 * diversity
    return least + round_half_even(F.lit(float(most - least)) * size * quality).cast("long")


def repeats_and_epochs(images: Column, target: Column, effective: Column, checkpoints: int) -> tuple[Column, Column]:
    """How often images are repeated in an epoch, and the number of epochs, to come to the target."""
    work = (target * effective).cast("double")
    repeats = F.greatest(F.lit(1), F.least(F.lit(100), F.ceil(work / (images * checkpoints))))
    epochs = F.greatest(F.lit(checkpoints), F.least(F.lit(100), F.ceil(work / (images * repeats))))
    return repeats.cast("long"), epochs.cast("long")


def batch_ladder(most: Column) -> Column:
    """``most`` and its halves down to 1."""
    halves = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.floor(most / F.pow(F.lit(2), i)).cast("int"))
    return F.filter(halves, lambda x: x >= 1)


def largest_fitting(ladder: Column, resolution: Column, rank: Column, free_mb: Column) -> Column:
    """The first batch size of a ladder whose estimate fits; null if none does."""
    return F.array_max(F.filter(ladder, lambda b: vram_estimate(resolution, b, rank, F.lit(False)) <= free_mb))


def classify_failure(text: Column, code: Column) -> Column:
    """The class of a failed process by its output; the first that fits counts."""
    low = F.lower(text)
    has = lambda *words: F.lit(True) if not words else [low.contains(w) for w in words]
    any_of = lambda *words: has(*words)[0] if len(words) == 1 else has(*words)[0] | has(*words)[1]
    return (
        F.when(any_of("out of memory", "cuda oom"), "cuda_oom")
        .when(low.contains("nan") & low.contains("loss"), "nan_loss")
        .when(any_of("no space left", "disk full"), "disk_full")
        .when(any_of("no kernel image", "not compatible with the current pytorch"), "cuda_incompatible_arch")
        .when(low.contains("onnxruntime") & low.contains("cudaexecutionprovider"), "onnx_provider")
        .when(low.contains("caption") & any_of("missing", "not found"), "missing_caption")
        .when(code != 0, "process_crash")
        .otherwise("unknown")
    )


def recovery(plans: DataFrame) -> DataFrame:
    """Adds ``change``, the next thing to try after a failure, null if nothing is left.

    Columns: failure, attempt, other_gpu, previous (array), locked (array), batch_size, gradient_accumulation,
    gradient_checkpointing, optimizer, network_dim, network_alpha, resolution, no_half_vae.
    """
    free = lambda *names: ~F.arrays_overlap("locked", F.array(*map(F.lit, names)))
    lower = F.greatest(F.lit(8), F.floor(F.col("network_dim") / 2))
    oom = (
        F.when(F.col("other_gpu").isNotNull() & ~F.array_contains("previous", "gpu_fallback"), "gpu_fallback")
        .when(free("batch_size", "gradient_accumulation") & (F.col("batch_size") > 1) & (F.col("gradient_accumulation") <= 32), "batch_size")
        .when(~F.col("gradient_checkpointing") & free("gradient_checkpointing"), "gradient_checkpointing")
        .when(free("optimizer") & (F.col("optimizer") != "AdamW"), "optimizer")
        .when(free("network_dim") & (F.col("network_dim") > 8) & (free("network_alpha") | (F.col("network_alpha") <= lower)), "network_dim")
        .when(free("resolution") & (F.col("resolution") > 768), "resolution")
    )
    nan = F.when(free("no_half_vae") & ~F.col("no_half_vae"), "no_half_vae").when(free("unet_lr", "text_encoder_lr"), "learning_rate")
    change = F.when(F.col("attempt") >= 3, F.lit(None)).when(F.col("failure") == "cuda_oom", oom).when(F.col("failure") == "nan_loss", nan)
    return plans.withColumn("change", change)


def round_robin(items: DataFrame, devices: DataFrame, order: str) -> DataFrame:
    """Adds ``device`` to items: their places in order go round the compatible devices, those with most free memory first.

    Devices are few; places come from ranges of the order.
    """
    from curato.operators.captions import pack_items

    usable = devices.where("compatible").select("uuid", (F.row_number().over(Window.orderBy(F.desc("free_mb"), "device_index")) - 1).alias("slot"))
    n = usable.count()
    if not n:
        raise ValueError("no compatible device")
    rows = pack_items(items, order, 1).withColumn("slot", (F.col("batch") % n).cast("int")).drop("batch")
    return rows.join(F.broadcast(usable), "slot").withColumnRenamed("uuid", "device").drop("slot")


def assign_devices(tasks: DataFrame, devices: DataFrame, leases: DataFrame) -> DataFrame:
    """(task_id, uuid): each task's best device among those without a lease and with enough memory.

    Training takes the one with most free memory, others the least busy one; a preferred device wins if it can. The
    devices of a machine are few and are broadcast.
    """
    free = devices.where("compatible").join(leases.select("uuid"), "uuid", "left_anti")
    pairs = tasks.join(F.broadcast(free), F.col("free_mb") >= F.col("need_mb"), "left")
    busy, memory = F.col("busy"), -F.col("free_mb")
    first = F.when(F.col("kind") == "train", F.struct(memory.cast("double").alias("a"), busy.cast("double").alias("b"), "device_index")).otherwise(F.struct(busy.cast("double").alias("a"), memory.cast("double").alias("b"), "device_index"))
    preferred = F.when(F.col("uuid") == F.col("preferred"), 0).otherwise(1)
    return pairs.groupBy("task_id").agg(F.min_by("uuid", F.when(F.col("uuid").isNotNull(), F.struct(preferred.alias("p"), first.alias("f")))).alias("uuid"))


def sampling_matrix(checkpoints: DataFrame, prompts: DataFrame, weights: Sequence[float], seeds: Sequence[int], cap: int) -> DataFrame:
    """The first ``cap`` samples in the order checkpoint, weight, seed, prompt: (checkpoint, weight, seed, prompt, ordinal).

    Checkpoints and prompts are the few of one pass, with ``place`` columns c and p.
    """
    spark = checkpoints.sparkSession
    grid = spark.createDataFrame([(i, float(w), j, s) for i, w in enumerate(weights) for j, s in enumerate(seeds)], "w int, weight double, s int, seed int")
    rows = checkpoints.crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(prompts))
    top = rows.orderBy("c", "w", "s", "p").limit(cap)
    return top.withColumn("ordinal", F.row_number().over(Window.orderBy("c", "w", "s", "p")))


# Fixed values: (checkpoints, prompts, weights, seeds) of the three passes of a library run, in which 0 is all.
LIBRARY_PASSES = ((0, 0, (0.8,), (101,)), (5, 4, (0.6, 0.7, 0.8, 0.9, 1.0), (202,)), (3, 4, (0.7, 0.8, 0.9), (303, 404, 505)))
MOST_LIBRARY_SAMPLES = 256


def library_matrix(checkpoints: DataFrame, prompts: DataFrame, most: int = MOST_LIBRARY_SAMPLES) -> DataFrame:
    """(pass, c, weight, seed, p, ordinal): the first ``most`` samples of all passes over checkpoints (c) and prompts (p) by place.

    Later passes take the first checkpoints and prompts. All passes together are cut at the limit.
    """
    spark, rows = checkpoints.sparkSession, None
    for n, (some, texts, weights, seeds) in enumerate(LIBRARY_PASSES, 1):
        own = checkpoints.where(F.col("place") < some) if some else checkpoints
        asked = prompts.where(F.col("place") < texts) if texts else prompts
        grid = spark.createDataFrame([(i, w, j, s) for i, w in enumerate(weights) for j, s in enumerate(seeds)], "i int, weight double, j int, seed int")
        # The grid has nine rows at most, and prompts are a handful.
        made = own.select(F.col("place").alias("cp"), "c").crossJoin(F.broadcast(grid)).crossJoin(F.broadcast(asked.select(F.col("place").alias("pp"), "p")))
        made = made.orderBy("cp", "i", "j", "pp").limit(most).withColumn("pass", F.lit(n))
        rows = made if rows is None else rows.unionByName(made)
    # Three times the limit, at most.
    order = Window.orderBy("pass", "cp", "i", "j", "pp")
    return rows.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= most).select("pass", "c", "weight", "seed", "p", "ordinal")


def all_passes(passes: Sequence[DataFrame]) -> DataFrame:
    """The samples of all passes with ``pass``, the number of theirs from 1 on; repeated ones stay."""
    rows = None
    for n, made in enumerate(passes, 1):
        own = made.withColumn("pass", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def preferred_device(task: Column, selected: Column, preferred: Column) -> Column:
    """The device for tagging: a preferred one that must be among those selected, else the first, or the second for generated images."""
    turn = F.when(task == "generated_tag", 1).otherwise(0) % F.size(selected)
    wrong = F.raise_error(F.concat(F.lit("not a selected device: "), preferred)).cast("string")
    return F.when(preferred.isNull(), F.get(selected, turn)).when(F.array_contains(selected, preferred), preferred).otherwise(wrong)


def previews(samples: DataFrame, chosen: DataFrame, key: str, place: str, most: int = 12, columns: int = 4) -> tuple[DataFrame, DataFrame]:
    """(first successful sample of each chosen key, the grid's cells: successful ones of the first ``most`` with row and column)."""
    good = samples.where("success").join(chosen.select(key), key, "left_semi")
    first = good.groupBy(key).agg(F.min(place).alias(place))
    cells = samples.orderBy(place).limit(most).where("success")
    cell = F.row_number().over(Window.orderBy(place)) - 1
    return first, cells.withColumn("cell", cell).select(place, key, F.floor(F.col("cell") / columns).cast("int").alias("row"), (F.col("cell") % columns).alias("column"))


# From which score a tagger's tag is taken, by its category.
TAG_THRESHOLDS = {"general": 0.35, "character": 0.85, "rating": 0.0}


def tagger_selection(scores: DataFrame) -> DataFrame:
    """Adds ``selected`` to a tagger's scores (tag, score, model_category): over the threshold of its category."""
    limit = F.lit(TAG_THRESHOLDS["general"])
    for name in ("character", "rating"):
        limit = F.when(F.col("model_category") == name, TAG_THRESHOLDS[name]).otherwise(limit)
    return scores.withColumn("selected", F.col("score") > limit)


def prompt_set(prompts: DataFrame, trigger: str, least: int = 8) -> DataFrame:
    """(prompt_id, text) with the trigger in its place: fewer than ``least`` prompts, or one without a place for it, are errors."""
    # A prompt set is a handful of rows.
    n = F.count("*").over(Window.partitionBy())
    wrong = lambda text: F.raise_error(F.lit(text)).cast("string")
    text = F.when(n < least, wrong("too few prompts")).when(~F.contains("text", F.lit("{trigger}")), wrong("a prompt has no place for the trigger"))
    return prompts.select("prompt_id", text.otherwise(F.replace("text", F.lit("{trigger}"), F.lit(trigger))).alias("text"))
