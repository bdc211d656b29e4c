import pytest
from pyspark.sql import functions as F

from curato.operators import trainplan
from curato.operators.trainplan import CHARACTER, STYLE, Profile

GPUS = "array<struct<uuid:string,index:int,compatible:boolean,free_mb:int,total_mb:int,bf16:boolean>>"
SCHEMA = f"id string, accepted int, validation_count int, diversity double, short_p10 int, short_median int, gpus {GPUS}, selected array<string>, locked array<string>, optimizers array<string>, has_class_token boolean, probe_gpu string, probe_batch int, probe_version string, want_batch_size int, want_network_alpha int, want_repeats int, want_epochs int"
A, B = ("a", 0, True, 12000, 24000, False), ("b", 1, True, 23000, 24000, True)


def _run(spark, **changes):
    row = {
        "id": "r", "accepted": 30, "validation_count": 0, "diversity": 0.5, "short_p10": 1000, "short_median": 900, "gpus": [A, B], "selected": ["a", "b"], "locked": [], "optimizers": ["AdamW"],
        "has_class_token": True, "probe_gpu": None, "probe_batch": None, "probe_version": None, "want_batch_size": None, "want_network_alpha": None, "want_repeats": None, "want_epochs": None,
    } | changes
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def test_a_plan_and_where_it_comes_from(spark):
    row = trainplan.training_plan(_run(spark), "id").first()
    plan = row.plan
    assert row.error is None
    assert (plan.gpu, plan.resolution, plan.batch_size, plan.gradient_accumulation, plan.precision, plan.optimizer) == ("b", 1024, 2, 2, "bf16", "AdamW")
    # 1000 + 1200 * 30 / 40 * 0.875, over 27 images in batches of 4.
    assert (plan.validation_images, plan.repeats, plan.epochs, plan.estimated_steps) == (3, 34, 8, 1836)
    assert (plan.keep_tokens, plan.no_half_vae, plan.estimated_disk_mb) == (2, False, 8 * 32 * 12 + 31)
    assert row.provenance["batch_size"] == "gpu_plan_pending_probe" and row.provenance["optimizer"] == "runtime_capability" and row.provenance["network_dim"] == "preset"


def test_wishes_and_locks_are_told_apart(spark):
    row = trainplan.training_plan(_run(spark, want_batch_size=3, want_repeats=5, locked=["batch_size"], selected=["a"]), "id").first()
    assert (row.plan.batch_size, row.plan.repeats, row.plan.precision, row.plan.no_half_vae) == (3, 5, "fp16", True)
    assert (row.provenance["batch_size"], row.provenance["repeats"]) == ("user_lock", "user_override")
    probed = trainplan.training_plan(_run(spark, probe_gpu="b", probe_batch=4, probe_version="v2"), "id").first()
    assert (probed.plan.batch_size, probed.provenance["batch_size"]) == (4, "batch_probe:v2")


@pytest.mark.parametrize(
    "changes,error",
    [
        ({"accepted": 7}, "fewer than 8"),
        ({"selected": ["a", "z"]}, "missing: z"),
        ({"gpus": [(*A[:2], False, *A[3:])], "selected": ["a"]}, "no selected device"),
        ({"want_network_alpha": 33}, "network_alpha"),
        ({"want_batch_size": 2, "probe_batch": 4, "probe_gpu": "b"}, "another batch size"),
        ({"probe_batch": 4, "probe_gpu": "a"}, "another device"),
        ({"accepted": 20, "validation_count": 2}, "below the threshold"),
        ({"validation_count": 9}, "out of limits"),
        ({"optimizers": ["Lion"]}, "no optimizer"),
    ],
)
def test_no_plan_without_its_reason(spark, changes, error):
    row = trainplan.training_plan(_run(spark, **changes), "id").first()
    assert error in row.error and row.plan is None and row.provenance is None
    with pytest.raises(Exception, match=error):
        trainplan.training_plan(_run(spark, **changes), "id", strict=True).collect()


def test_profiles(spark):
    style = trainplan.training_plan(_run(spark, accepted=50), "id", STYLE).first().plan
    assert (style.validation_images, style.keep_tokens) == (5, 1)
    with pytest.raises(ValueError, match="alpha"):
        Profile("x", 1, 2, 3, 1, 2, 1, 2, False, 1, network_dim=8)
    with pytest.raises(ValueError, match="lower to the higher"):
        Profile("x", 5, 2, 3, 1, 2, 1, 2, False, 1)
    assert CHARACTER.hard_minimum == 8


PLAN = f"struct<{', '.join(f.replace(' ', ':') for f in trainplan.CHANGED.split(', '))}>"
GPU = "array<struct<uuid:string,compatible:boolean,free_mb:int,total_mb:int>>"


def _ladder(spark, failures, locked=(), most=99, gpus=(("a", True, 24000, 24000), ("b", True, 23000, 24000), ("c", True, 23000, 24000), ("d", False, 24000, 24000))):
    plan = (1024, 3, 2, 32, 20, 1e-4, 1e-5, "AdamW8bit", False, False, "a")
    runs = spark.createDataFrame([("r", plan, list(failures), list(gpus), list(locked))], f"id string, plan {PLAN}, failures array<string>, gpus {GPU}, locked array<string>")
    return trainplan.recoveries(runs, "id", most).orderBy("attempt").collect()


def test_the_whole_ladder_of_memory(spark):
    rows = _ladder(spark, ["cuda_oom"] * 12)
    assert [r.change for r in rows] == ["gpu_fallback", "batch_size", "gradient_checkpointing", "optimizer", "network_dim", "network_dim", "resolution", "resolution", None]
    last = rows[-1].plan
    assert (last.gpu, last.batch_size, last.gradient_accumulation, last.network_dim, last.network_alpha, last.resolution, last.optimizer, last.gradient_checkpointing) == ("b", 1, 4, 8, 8, 768, "AdamW", True)
    assert [r.quality_impact for r in rows] == [False] * 4 + [True] * 4 + [False]
    assert rows[0].plan.gpu == "b" and rows[0].plan.batch_size == 3


def test_losses_that_are_no_numbers(spark):
    rows = _ladder(spark, ["nan_loss"] * 3)
    assert [r.change for r in rows] == ["no_half_vae", "learning_rate", "learning_rate"]
    assert rows[-1].plan.unet_lr == pytest.approx(2.5e-5) and rows[-1].plan.text_encoder_lr == pytest.approx(2.5e-6)
    assert [r.change for r in _ladder(spark, ["nan_loss"] * 3, ["text_encoder_lr", "no_half_vae"])] == [None]


def test_locks_attempts_and_other_failures(spark):
    assert [r.change for r in _ladder(spark, ["cuda_oom"] * 5, most=3)] == ["gpu_fallback", "batch_size", None]
    everything = ["batch_size", "gradient_checkpointing", "optimizer", "network_dim", "resolution"]
    assert [r.change for r in _ladder(spark, ["cuda_oom"] * 5, everything)] == ["gpu_fallback", None]
    # Alpha is locked over the lower rank.
    assert "network_dim" not in [r.change for r in _ladder(spark, ["cuda_oom"] * 9, ["network_alpha"])]
    assert [r.change for r in _ladder(spark, ["disk_full", "cuda_oom"])] == [None]
    assert _ladder(spark, []) == []
    assert [r.change for r in _ladder(spark, ["cuda_oom"], gpus=[("b", True, 100, 24000)])] == ["batch_size"]


def test_no_runs(spark):
    assert trainplan.training_plan(_run(spark).where(F.lit(False)), "id").count() == 0


def test_each_change_is_worked_out_once(spark):
    """A change holds the search for another device: the plan has it twice for each attempt, however many values depend on the change."""
    runs = spark.createDataFrame([], f"id string, plan {PLAN}, failures array<string>, gpus {GPU}, locked array<string>")
    for most in (1, 3):
        plan = trainplan.recoveries(runs, "id", most)._jdf.queryExecution().analyzed().toString()
        assert plan.count("filter(") <= 3 * most


def test_more_attempts_than_one_plan_holds(spark):
    rows = _ladder(spark, ["nan_loss"] * 30, most=25)
    assert [r.attempt for r in rows] == list(range(1, 26))
    assert [r.change for r in rows] == ["no_half_vae"] + ["learning_rate"] * 23 + [None]
    assert rows[-1].plan.unet_lr == pytest.approx(1e-4 * 0.5**23)
