import json

import pytest
from pyspark.sql import functions as F

from curato.operators import projections
from curato.operators.projections import STAGES, Context, Store

RUN, OTHER = Context("p1", "r1", trigger="tok"), Context("p2", "r2")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), 4)


def _rows(spark, store, table, *columns):
    found = store.table(table)
    return sorted(map(tuple, found.select(*columns).collect()), key=str)


def _outputs(spark, n=6, tag="a"):
    """An output of every stage."""
    frame = spark.createDataFrame
    ids = [f"x{i}" for i in range(n)]
    return {
        "importing": {
            "assets": frame([(i, f"{i}.png", f"sha-{i}", 10, ".png") for i in ids], "asset_id string, stored_filename string, sha256 string, size_bytes int, extension string"),
            "sources": frame([(i, f"/in/{i}-{j}", f"{i}-{j}") for i in ids for j in range(2)] + [("x0", "/in/x0-0", "x0-0")], "asset_id string, original_path string, original_filename string"),
        },
        "normalizing": {"items": frame([(i, f"w/{i}", f"s-{tag}", 5, 3, 4, ["soft"]) for i in ids], "asset_id string, path string, sha256 string, size_bytes int, width int, height int, warnings array<string>")},
        "deduplicating": {"clusters": frame([(f"c{tag}", "x0", ["x0", "x1"], "near", [0.9])], "cluster_id string, representative_id string, members array<string>, kind string, scores array<double>")},
        "tagging": {"tags": frame([(i, "m", "1", t, 0.5) for i in ids for t in (tag, "solo")], "asset_id string, model_id string, revision string, tag string, score double")},
        "captioning": {"captions": frame([(i, f"tok, {tag}", "{}") for i in ids], "asset_id string, caption string, audit string")},
        "planning": {"split": frame([(i, "validation" if i == ids[0] else "training", 42) for i in ids], "asset_id string, split string, seed int"), "plan": frame([(json.dumps({"tag": tag}),)], "plan string")},
        **{
            stage: {"audits": frame([(None, "", '{"log": "/home/me/x"}', None), ("call-9", "other", "{}", "{}")], "call_id string, task_type string, audit string, applied_changes string")}
            for stage in ("pretrain_review", "refinement", "final_review")
        },
        "training_failed": {"failures": frame([(1, None, True, ["run"], "{}"), (2, "cancelled", False, None, "{}"), (3, "odd", False, None, "{}")], "attempt int, status string, retry_applied boolean, command array<string>, recovery string")},
        "training": {
            "attempt": frame([(4, ["run", tag], "{}")], "attempt int, command array<string>, recovery string"),
            "checkpoints": frame([(f"k{i}", f"k/{i}", i, 10 * i, "s", None, 0.5) for i in range(3)], "checkpoint_id string, path string, epoch int, step int, sha256 string, validation_loss double, train_loss double"),
        },
        **{stage: {"samples": frame([("k1", "q1", s, 0.8, f"{tag}/{s}.png", True, None) for s in (1, 2)], "checkpoint_id string, prompt_id string, seed int, weight double, image_path string, success boolean, error string")} for stage in ("screening", "weight_sweep", "multi_seed_validation")},
        "final_evaluation": {"metrics": frame([(f"k{i}", 0.5, 0.8, "{}", None) for i in range(3)], "checkpoint_id string, score double, recommended_weight double, metrics string, warnings array<string>")},
    }


def test_every_stage_applied_again_leaves_the_same(spark, store):
    outputs = _outputs(spark)
    assert set(outputs) | {"training_started"} == set(STAGES)
    tables = {p.table for ps in STAGES.values() for p in ps}
    for stage, output in outputs.items():
        store.apply(stage, output, RUN)
    once = {t: sorted(map(str, store.table(t).collect())) for t in tables}
    for stage, output in outputs.items():
        store.apply(stage, output, RUN)
    assert {t: sorted(map(str, store.table(t).collect())) for t in tables} == once
    assert len(once["assets"]) == 12 and len(once["source_files"]) == 12 and len(once["samples"]) == 2 and len(once["calls"]) == 4
    assert _rows(spark, store, "attempts", "attempt", "status", "return_code") == [(1, "failed_recoverable", 1), (2, "cancelled", 1), (3, "failed_fatal", 1), (4, "completed", 0)]
    calls = {r.id: r.audit for r in store.table("calls").collect()}
    assert set(calls) == {"call-9", "r1-pretrain_review-pretrain_review", "r1-refinement-refinement", "r1-final_review-final_review"}
    assert "/home" not in calls["r1-refinement-refinement"]


def test_later_outputs_replace_what_is_theirs(spark, store):
    for tag, n in (("a", 6), ("b", 3)):
        output = _outputs(spark, n, tag)
        for stage in ("normalizing", "deduplicating", "tagging", "captioning", "planning", "screening"):
            store.apply(stage, output[stage], RUN)
    # Of assets that the later output lacks the rows stay; what a run or project owns is replaced as a whole.
    assert [r[1] for r in _rows(spark, store, "captions", "asset_id", "caption")] == ["tok, b"] * 3 + ["tok, a"] * 3
    assert [sorted(r[1]) for r in _rows(spark, store, "tag_results", "asset_id", "tags")] == [["b", "solo"]] * 3 + [["a", "solo"]] * 3
    assert [r[0] for r in _rows(spark, store, "assets", "sha256")] == ["s-a"] * 3 + ["s-b"] * 3
    assert _rows(spark, store, "duplicate_clusters", "id", "confidence") == [("cb", 0.9)]
    assert len(_rows(spark, store, "dataset_splits", "asset_id")) == 3 and _rows(spark, store, "training_plans", "plan") == [('{"tag": "b"}',)]
    assert [r[0] for r in _rows(spark, store, "samples", "path")] == ["b/1.png", "b/2.png"]


def test_runs_and_projects_do_not_touch_each_other(spark, store):
    output = _outputs(spark)
    for run in (RUN, OTHER):
        store.apply("planning", output["planning"], run)
        store.apply("deduplicating", output["deduplicating"], run)
    store.apply("deduplicating", {"clusters": output["deduplicating"]["clusters"].limit(0)}, RUN)
    assert _rows(spark, store, "duplicate_clusters", "project_id") == [("p2",)]
    store.apply("planning", {"split": output["planning"]["split"].limit(0)}, OTHER)
    assert {r[0] for r in _rows(spark, store, "dataset_splits", "run_id")} == {"r1"}
    assert {r[0] for r in _rows(spark, store, "training_plans", "run_id")} == {"r1", "r2"}


def test_an_attempt_starts_once(spark, store):
    attempt = spark.createDataFrame([(1, None, "{}")], "attempt int, command array<string>, recovery string")
    store.apply("training_started", {"attempt": attempt}, RUN)
    store.apply("training_started", {"attempt": attempt}, OTHER)
    with pytest.raises(Exception, match="already there: r1 1"):
        store.apply("training_started", {"attempt": attempt}, RUN)
    store.apply("training", {"attempt": attempt}, RUN)
    assert _rows(spark, store, "attempts", "run_id", "status") == [("r1", "completed"), ("r2", "running")]


def test_a_key_twice_in_one_output_is_an_error(spark, store):
    items = _outputs(spark)["normalizing"]["items"]
    with pytest.raises(Exception, match="twice in one output: working-x0"):
        store.apply("normalizing", {"items": items.unionByName(items.where("asset_id = 'x0'"))}, RUN)
    with pytest.raises(ValueError, match="no such way"):
        projections.meet(items, items, "guess", ("asset_id",))


def test_only_touched_parts_are_written(spark, store):
    output = _outputs(spark, 40)["normalizing"]["items"]
    store.apply("normalizing", {"items": output}, RUN)
    path = store._path("assets")
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    before = files()
    store.apply("normalizing", {"items": output.limit(1)}, RUN)
    assert len(before - files()) == 1 and store.table("assets").count() == 40
