"""One training plan for each run, with where each of its values comes from, and how a plan changes after failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curato.operators import planning
from curato.operators.graph import materialise


@dataclass(frozen=True)
class Profile:
    """What a preset lays down for the plans of its runs."""

    preset: str
    hard_minimum: int
    guidance: int
    holdout_at: int
    holdout_least: int
    holdout_most: int
    steps_least: int
    steps_most: int
    by_diversity: bool
    keep_tokens: int
    holdout_ratio: float = 0.10
    checkpoints: int = 8
    network_dim: int = 32
    network_alpha: int = 16
    unet_lr: float = 1e-4
    text_encoder_lr: float = 1e-5
    resolutions: tuple[int, ...] = (1024, 896, 768)
    optimizers: tuple[str, ...] = ("AdamW8bit", "AdamW")
    precisions: tuple[str, ...] = ("bf16", "fp16", "fp32")
    gradient_checkpointing: bool = True
    full_vae_for_fp16: bool = True

    def __post_init__(self) -> None:
        if not (0 < self.hard_minimum <= self.guidance and self.holdout_least <= self.holdout_most and self.steps_least <= self.steps_most):
            raise ValueError("limits of a profile go from the lower to the higher")
        if self.network_alpha > self.network_dim or not self.resolutions or not self.optimizers or not self.precisions:
            raise ValueError("a profile's alpha is no more than its rank, and each of its lists has an entry")


# The two presets.
CHARACTER = Profile("character", 8, 20, 24, 2, 8, 1000, 2200, False, 2)
STYLE = Profile("style", 16, 30, 40, 4, 16, 1400, 2800, True, 1)

#: What a run may ask for by a column ``want_<name>``; null leaves it to the plan.
WANTED = {
    "network_dim": "int", "network_alpha": "int", "resolution": "int", "batch_size": "int", "gradient_accumulation": "int", "repeats": "int", "epochs": "int",
    "optimizer": "string", "precision": "string", "unet_lr": "double", "text_encoder_lr": "double",
}
PLAN = (
    "resolution int, batch_size int, gradient_accumulation int, repeats int, epochs int, estimated_steps long, network_dim int, network_alpha int, unet_lr double, text_encoder_lr double, "
    "optimizer string, precision string, no_half_vae boolean, gradient_checkpointing boolean, keep_tokens int, validation_images int, gpu string, estimated_disk_mb long"
)


def _first_of(preferred: Sequence[str], there: Column) -> Column:
    """The first of the preferred values that is there; null if none is."""
    return F.coalesce(*(F.when(F.array_contains(there, p), F.lit(p)) for p in preferred))


def best_device(gpus: Column, selected: Column) -> Column:
    """Of the selected devices that can run, the one with most free memory, then most memory, then the lowest index."""
    fit = F.filter(gpus, lambda g: g["compatible"] & F.array_contains(selected, g["uuid"]))
    place = F.transform(fit, lambda g: F.struct(g["free_mb"], g["total_mb"], -g["index"], g["uuid"], g["bf16"]))
    return F.array_max(place)


def training_plan(runs: DataFrame, key: str, profile: Profile = CHARACTER, strict: bool = False) -> DataFrame:
    """(key, plan, provenance, error): the whole plan of each run, or the first reason why it has none.

    Columns: accepted, validation_count, diversity, short_p10, short_median (of the accepted pictures), gpus (array of uuid,
    index, compatible, free_mb, total_mb, bf16), selected (uuids), locked (names), optimizers (those the runtime has),
    has_class_token, probe_gpu, probe_batch, probe_version (of a tried batch size; null without one), and ``want_<name>``
    for each of ``WANTED``, which may be left out. ``provenance`` says of each value whether it was asked for (user_lock if
    it is locked, user_override) or what it follows from. With ``strict`` an error is raised when rows are read.
    """
    rows = runs.withColumns({f"want_{n}": F.lit(None).cast(kind) for n, kind in WANTED.items() if f"want_{n}" not in runs.columns})
    want = {n: F.col(f"want_{n}") for n in WANTED}
    own = lambda n: F.when(F.array_contains("locked", n), "user_lock").otherwise("user_override")
    source = lambda n, other: F.when(want[n].isNotNull(), own(n)).otherwise(other)

    missing = F.get(F.filter("selected", lambda u: ~F.exists("gpus", lambda g: g["uuid"] == u)), F.lit(0))
    rows = rows.withColumn("_gpu", best_device(F.col("gpus"), F.col("selected")))
    gpu = F.col("_gpu")
    rank = F.coalesce(want["network_dim"], F.lit(profile.network_dim))
    alpha = F.coalesce(want["network_alpha"], F.lit(profile.network_alpha))
    cap = planning.auto_resolution(F.coalesce("short_p10", F.lit(0)), F.col("short_median"), gpu["free_mb"], rank)
    eligible = F.array_max(F.filter(F.array(*map(F.lit, profile.resolutions)), lambda r: r <= cap))
    rows = rows.withColumn("_resolution", F.coalesce(want["resolution"], eligible))
    auto = planning.auto_batch(F.col("_resolution"), gpu["free_mb"], rank)
    rows = rows.withColumn("_batch", F.coalesce(want["batch_size"], F.col("probe_batch"), auto))
    rows = rows.withColumn("_accumulation", F.coalesce(want["gradient_accumulation"], F.greatest(F.lit(1), F.ceil(4 / F.col("_batch")).cast("int"))))
    planned = planning.holdout_size(F.col("accepted"), profile.holdout_ratio, profile.holdout_least, profile.holdout_most, profile.holdout_at, half_even=True)
    rows = rows.withColumn("_planned", planned).withColumn("_held", F.when(F.col("validation_count") > 0, F.col("validation_count")).otherwise(F.col("_planned")))
    images = F.greatest(F.col("accepted") - F.col("_held"), F.lit(1))
    target = planning.target_steps(profile.steps_least, profile.steps_most, F.col("accepted"), profile.guidance, F.col("diversity"), profile.by_diversity)
    effective = F.col("_batch") * F.col("_accumulation")
    work = (target * effective).cast("double")
    within = lambda low, value: F.greatest(F.lit(low), F.least(F.lit(100), F.ceil(value))).cast("int")
    repeats = F.coalesce(want["repeats"], within(1, work / (images * F.coalesce(want["epochs"], F.lit(profile.checkpoints)))))
    rows = rows.withColumn("_repeats", repeats)
    rows = rows.withColumn("_epochs", F.coalesce(want["epochs"], within(profile.checkpoints, work / (images * F.col("_repeats")))))
    optimizer = F.coalesce(want["optimizer"], _first_of(profile.optimizers, F.col("optimizers")))
    able = F.array_except(F.array(*map(F.lit, profile.precisions)), F.when(gpu["bf16"], F.array().cast("array<string>")).otherwise(F.array(F.lit("bf16"))))
    precision = F.coalesce(want["precision"], F.get(able, F.lit(0)), F.lit("fp32"))

    held = F.col("validation_count") > 0
    asked_batch = want["batch_size"].isNotNull() & F.col("probe_batch").isNotNull()
    error = (
        F.when(F.col("accepted") < profile.hard_minimum, F.lit(f"fewer than {profile.hard_minimum} accepted images"))
        .when(missing.isNotNull(), F.concat(F.lit("a selected device is missing: "), missing))
        .when(gpu.isNull(), "no selected device can run")
        .when(alpha > rank, "network_alpha over network_dim")
        .when(F.col("_resolution").isNull(), "no resolution fits")
        .when(asked_batch & (F.col("probe_batch") != want["batch_size"]), "another batch size was tried")
        .when(want["batch_size"].isNull() & F.col("probe_batch").isNotNull() & ~F.col("probe_gpu").eqNullSafe(gpu["uuid"]), "the batch size was tried on another device")
        .when(held & (F.col("_planned") == 0), "validation images below the threshold")
        .when(held & ~F.col("validation_count").between(profile.holdout_least, profile.holdout_most), "validation images out of limits")
        .when(F.col("_held") >= F.col("accepted"), "no training images are left")
        .when(want["optimizer"].isNotNull() & ~F.array_contains("optimizers", want["optimizer"]), "the optimizer isn't there")
        .when(optimizer.isNull(), "no optimizer is there")
        .when((precision == "bf16") & ~gpu["bf16"], "the device has no bf16")
    )
    disk = F.greatest(F.lit(256), profile.checkpoints * rank * 12 + F.floor(F.col("accepted") * F.col("_resolution") * F.col("_resolution") / 1_000_000))
    values = {
        "resolution": F.col("_resolution"), "batch_size": F.col("_batch"), "gradient_accumulation": F.col("_accumulation"), "repeats": F.col("_repeats"), "epochs": F.col("_epochs"),
        "estimated_steps": F.ceil(images.cast("double") * F.col("_repeats") * F.col("_epochs") / effective), "network_dim": rank, "network_alpha": alpha,
        "unet_lr": F.coalesce(want["unet_lr"], F.lit(profile.unet_lr)), "text_encoder_lr": F.coalesce(want["text_encoder_lr"], F.lit(profile.text_encoder_lr)),
        "optimizer": optimizer, "precision": precision, "no_half_vae": (precision == "fp16") & F.lit(profile.full_vae_for_fp16), "gradient_checkpointing": F.lit(profile.gradient_checkpointing),
        "keep_tokens": F.when(F.col("has_class_token") & F.lit(profile.keep_tokens == 2), 2).otherwise(1), "validation_images": F.col("_held"), "gpu": gpu["uuid"], "estimated_disk_mb": disk,
    }
    batch_source = F.when(want["batch_size"].isNotNull(), own("batch_size")).when(F.col("probe_batch").isNotNull(), F.concat(F.lit("batch_probe:"), F.col("probe_version"))).otherwise("gpu_plan_pending_probe")
    from_where = {
        **{n: source(n, "preset") for n in ("network_dim", "network_alpha", "unet_lr", "text_encoder_lr")},
        "resolution": source("resolution", "dataset_gpu_plan"),
        "batch_size": batch_source,
        "gradient_accumulation": source("gradient_accumulation", "effective_batch_plan"),
        **{n: source(n, "dataset_step_plan") for n in ("repeats", "epochs")},
        **{n: source(n, "runtime_capability") for n in ("optimizer", "precision")},
    }
    kinds = dict(f.split() for f in PLAN.split(", "))
    plan = F.struct(*(v.cast(kinds[n]).alias(n) for n, v in values.items()))
    rows = rows.withColumn("error", error)
    if strict:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")))
    fine = F.col("error").isNull()
    provenance = F.create_map(*(x for n, v in from_where.items() for x in (F.lit(n), v)))
    return rows.select(key, F.when(fine, plan).alias("plan"), F.when(fine, provenance).alias("provenance"), "error")


#: Attempts after which nothing is tried any more.
MOST_ATTEMPTS = 3
#: Attempts that are worked out in one plan; runs that go on are written down after as many.
STRIDE = 9
#: What of a plan a recovery reads and changes.
CHANGED = "resolution int, batch_size int, gradient_accumulation int, network_dim int, network_alpha int, unet_lr double, text_encoder_lr double, optimizer string, no_half_vae boolean, gradient_checkpointing boolean, gpu string"
_NAMES = [f.split()[0] for f in CHANGED.split(", ")]
QUALITY = ("network_dim", "resolution", "learning_rate")


def next_change(plan: Column, failure: Column, gpus: Column, locked: Column, previous: Column, attempt: Column, most: int = MOST_ATTEMPTS) -> Column:
    """What is tried next after a failure: another device, a smaller batch, checkpointing, AdamW, a lower rank, a lower resolution;
    after a loss that is no number, a full-precision decoder, then lower rates. Null if nothing is left that isn't locked."""
    free = lambda *names: ~F.arrays_overlap(locked, F.array(*map(F.lit, names)))
    lower = F.greatest(F.lit(8), F.floor(plan["network_dim"] / 2))
    oom = (
        F.when(other_device(plan, gpus).isNotNull() & ~F.array_contains(previous, "gpu_fallback"), "gpu_fallback")
        .when(free("batch_size", "gradient_accumulation") & (plan["batch_size"] > 1) & (plan["gradient_accumulation"] <= 32), "batch_size")
        .when(~plan["gradient_checkpointing"] & free("gradient_checkpointing"), "gradient_checkpointing")
        .when(free("optimizer") & (plan["optimizer"] != "AdamW"), "optimizer")
        .when(free("network_dim") & (plan["network_dim"] > 8) & (free("network_alpha") | (plan["network_alpha"] <= lower)), "network_dim")
        .when(free("resolution") & (plan["resolution"] > 768), "resolution")
    )
    nan = F.when(free("no_half_vae") & ~plan["no_half_vae"], "no_half_vae").when(free("unet_lr", "text_encoder_lr"), "learning_rate")
    return F.when(attempt >= most, F.lit(None).cast("string")).when(failure == "cuda_oom", oom).when(failure == "nan_loss", nan)


def other_device(plan: Column, gpus: Column) -> Column:
    """The device with most free memory of those beside the plan's that can run and are nine tenths free; the first of equal ones."""
    fit = F.filter(gpus, lambda g: (g["uuid"] != plan["gpu"]) & g["compatible"] & (g["free_mb"] >= 0.9 * g["total_mb"]))
    return F.array_max(F.transform(fit, lambda g, i: F.struct(g["free_mb"], -i, g["uuid"].alias("uuid"))))["uuid"]


def changed(plan: Column, change: Column, gpus: Column) -> Column:
    """The plan after a change, as a struct of ``CHANGED``; the same plan without one."""
    is_ = lambda name: F.coalesce(change == name, F.lit(False))
    dim = F.greatest(F.lit(8), F.floor(plan["network_dim"] / 2))
    new = {
        "gpu": F.when(is_("gpu_fallback"), other_device(plan, gpus)),
        "batch_size": F.when(is_("batch_size"), F.greatest(F.lit(1), F.floor(plan["batch_size"] / 2))),
        "gradient_accumulation": F.when(is_("batch_size"), plan["gradient_accumulation"] * 2),
        "gradient_checkpointing": F.when(is_("gradient_checkpointing"), F.lit(True)),
        "optimizer": F.when(is_("optimizer"), "AdamW"),
        "network_dim": F.when(is_("network_dim"), dim),
        "network_alpha": F.when(is_("network_dim"), F.least(plan["network_alpha"], dim)),
        "resolution": F.when(is_("resolution"), F.when(plan["resolution"] == 1024, 896).otherwise(768)),
        "no_half_vae": F.when(is_("no_half_vae"), F.lit(True)),
        "unet_lr": F.when(is_("learning_rate"), plan["unet_lr"] * 0.5),
        "text_encoder_lr": F.when(is_("learning_rate"), plan["text_encoder_lr"] * 0.5),
    }
    kinds = dict(f.split() for f in CHANGED.split(", "))
    return F.struct(*((F.coalesce(new[n].cast(kinds[n]), plan[n].cast(kinds[n])) if n in new else plan[n].cast(kinds[n])).alias(n) for n in _NAMES))


def recoveries(runs: DataFrame, key: str, most: int = MOST_ATTEMPTS, columns: Mapping[str, str] | None = None) -> DataFrame:
    """(key, attempt, failure, change, quality_impact, plan): a row for each failure of a run, up to the first without a way on.

    Columns: plan (a struct with ``CHANGED``), failures (array, in their order), gpus, locked. Each failure meets the plan that
    the one before left; ``change`` is null where nothing is left to try or attempts are used up.
    """
    names = {"plan": "plan", "failures": "failures", "gpus": "gpus", "locked": "locked"} | dict(columns or {})
    own = F.col(names["plan"])
    rows = runs.select(key, F.struct(*(own[n].alias(n) for n in _NAMES)).alias("_plan0"), F.array().cast("array<string>").alias("_tried"), F.col(names["failures"]).alias("_failures"), F.col(names["gpus"]).alias("_gpus"), F.coalesce(names["locked"], F.array().cast("array<string>")).alias("_locked"))
    every, least = max(1, most), 1
    done, rows = _attempts(rows, key, least, min(STRIDE, every), most)
    while least + STRIDE <= every:
        least, rows = least + STRIDE, materialise(rows, "recoveries").where("_going")
        if not rows.limit(1).count():
            break
        more, rows = _attempts(rows, key, least, min(least + STRIDE - 1, every), most)
        done = done.unionByName(more)
    return done.select(key, "attempt", "failure", "change", F.coalesce(F.col("change").isin(*QUALITY), F.lit(False)).alias("quality_impact"), "plan")


def _attempts(rows: DataFrame, key: str, least: int, last: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The attempts from ``least`` to ``last``, and the rows of runs with whether they go on after them.

    Each change and each plan is a column of its own, so that it is computed once: a change is part of each of the plan's values.
    """
    steps, previous, going = [], F.col("_tried"), F.lit(True)
    for i in range(least, last + 1):
        n = i - least + 1
        before, change, plan = F.col(f"_plan{n - 1}"), F.col(f"_change{n}"), F.col(f"_plan{n}")
        going = going & F.coalesce(F.size("_failures") >= i, F.lit(False))
        failure = F.get("_failures", F.lit(i - 1))
        rows = rows.withColumn(f"_change{n}", F.when(going, next_change(before, failure, F.col("_gpus"), F.col("_locked"), previous, F.lit(i), most)))
        rows = rows.withColumn(f"_plan{n}", changed(before, change, F.col("_gpus")))
        steps.append(F.when(going, F.struct(F.lit(i).alias("attempt"), failure.alias("failure"), change.alias("change"), plan.alias("plan"))))
        previous = F.concat("_tried", F.array(*(F.coalesce(f"_change{k}", F.lit("")) for k in range(1, n + 1))))
        going = change.isNotNull()
    # A plain inline adds a filter, and a filter is pushed below with all columns that it needs written out in it.
    made = rows.select(key, F.inline_outer(F.array_compact(F.array(*steps)))).where("attempt is not null")
    return made, rows.select(going.alias("_going"), key, plan.alias("_plan0"), previous.alias("_tried"), "_failures", "_gpus", "_locked")
