"""Approval of refinement proposals: what is safe to accept, what has to be reviewed, and what an approval gets wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curato.functions import tags as ontology
from curato.operators.captions import audit, valid_trigger

#: Fixed value: bytes of a request, at most.
MOST_PAYLOAD = 100_000


def has_content(tags: Column) -> Column:
    """Whether a tag says what is to be seen: one outside quality, rating, resolution and text."""
    return F.exists(tags, lambda t: ~ontology.category(ontology.canonical(t)).isin(*ontology.EMPTY_OF_CONTENT))


def _fixed(tags: Sequence[str]) -> Column:
    return F.array(*map(F.lit, tags)).cast("array<string>")


def automatic_approval(items: DataFrame, mode: str, trigger: str, invariants: Sequence[str] = (), requires_review: bool = True, requires_trigger: bool = False) -> DataFrame:
    """(asset_id, decision) of items (asset_id, factory_accepted, proposed); no rows unless the mode is auto and there is a trigger.

    A proposal is accepted if it was found valid and, with the invariants, has content; else the draft stays. Nothing is
    decided where no review is asked for.
    """
    if mode != "auto" or requires_trigger or not trigger.strip() or not requires_review:
        return items.select("asset_id", F.lit("").alias("decision")).where(F.lit(False))
    good = F.col("factory_accepted") & has_content(F.concat("proposed", _fixed(invariants)))
    return items.select("asset_id", F.when(good, "accept").otherwise("reject").alias("decision"))


def bulk_accept(items: DataFrame, class_token: str | None, invariants: Sequence[str] = ()) -> DataFrame:
    """(asset_id, decision) for a reviewer's one click: here the class token counts as content too."""
    fixed = [class_token] * bool(class_token) + list(invariants)
    good = F.col("factory_accepted") & has_content(F.concat("proposed", _fixed(fixed)))
    return items.select("asset_id", F.when(F.coalesce(good, F.lit(False)), "accept").otherwise("reject").alias("decision"))


def review_state(items: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(run_id, trigger, requires_trigger, requires_review, without_content, rejected) of runs.

    Runs: run_id, mode, suggests, trigger, token. The trigger is the run's own, else its first candidate (run_id, place,
    value), else in auto mode with suggestions its token if that may be one. A review is asked for in review mode, where
    an asset's proposal has no content, and in auto mode where one was rejected.
    """
    first = candidates.groupBy("run_id").agg(F.min_by("value", "place").alias("candidate"))
    counts = items.groupBy("run_id").agg(F.count_if(~has_content(F.col("proposed"))).alias("without_content"), F.count_if(~F.col("factory_accepted")).alias("rejected"))
    own = F.when(F.trim("trigger") != "", F.trim("trigger"))
    made = F.when((F.col("mode") == "auto") & F.col("suggests") & valid_trigger(F.col("token")), F.col("token"))
    rows = runs.join(first, "run_id", "left").join(counts, "run_id", "left").fillna(0, ["without_content", "rejected"])
    rows = rows.withColumn("resolved", F.coalesce(own, F.when(F.col("suggests"), F.col("candidate")), made, F.lit("")))
    asked = (F.col("mode") == "review") | (F.col("without_content") > 0) | ((F.col("mode") == "auto") & (F.col("rejected") > 0))
    return rows.select("run_id", F.col("resolved").alias("trigger"), (F.col("suggests") & (F.col("resolved") == "")).alias("requires_trigger"), asked.alias("requires_review"), "without_content", "rejected")


def decided_tags(drafts: DataFrame, approvals: DataFrame) -> DataFrame:
    """(asset_id, tags, problem): each draft (asset_id, baseline, proposed) with the tags that its approval chooses.

    Every asset has to be decided exactly once: missing, duplicate, unknown; an edit needs tags: edited_tags_required.
    """
    counts = approvals.groupBy("asset_id").agg(F.count("*").alias("n"), F.min("decision").alias("decision"), F.min_by("edited", "decision").alias("edited"))
    both = drafts.withColumn("_draft", F.lit(True)).join(counts, "asset_id", "full_outer")
    problem = (
        F.when(F.col("_draft").isNull(), "unknown")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "duplicate")
        .when((F.col("decision") == "edit") & F.col("edited").isNull(), "edited_tags_required")
    )
    tags = F.when(F.col("decision") == "accept", F.col("proposed")).when(F.col("decision") == "reject", F.col("baseline")).otherwise(F.col("edited"))
    return both.select("asset_id", F.when(problem.isNull(), tags).alias("tags"), problem.alias("problem"))


def approval_problems(drafts: DataFrame, approvals: DataFrame, trigger: str, class_token: str | None = None, invariants: Sequence[str] = (), style: bool = False) -> DataFrame:
    """(asset_id, problem) of an approval: undecided assets, else the first issue of the final caption, or no content in it."""
    decided = decided_tags(drafts, approvals)
    fixed = [trigger, *([class_token.replace("_", " ")] if class_token else [])]
    caption = F.array_join(F.concat(_fixed(fixed), F.transform("tags", lambda t: ontology.display(t))), ", ")
    audited = audit(decided.where("problem IS NULL").select("asset_id", caption.alias("caption")), trigger, class_token, invariants, style)
    found = audited.select("asset_id", F.coalesce(F.try_element_at("issues", F.lit(1)), F.when(~F.col("semantic"), "no_content")).alias("problem"))
    return decided.select("asset_id", "problem").unionByName(found).where(F.col("problem").isNotNull())


def fallback_refinement(drafts: DataFrame) -> DataFrame:
    """The reply that stands in for a model's: each asset's tags are kept as they are, with full confidence."""
    return drafts.select("asset_id", F.lit("keep").alias("decision"), F.col("baseline").alias("effective"), F.lit(1.0).alias("confidence"))


def fallback_review(payloads: DataFrame) -> DataFrame:
    """(task_id, approved, recommended) where no model answers: the gate's own result (task, gate_passed, ranking) stands."""
    gated = F.when(F.col("task").isin("dataset_review", "caption_review", "training_plan"), F.coalesce("gate_passed", F.lit(False)))
    first = F.when(~F.col("task").isin("dataset_review", "caption_review", "training_plan", "recovery", "dataset_refinement"), F.try_element_at("ranking", F.lit(1)))
    return payloads.select("task_id", gated.alias("approved"), first.alias("recommended"))


def reusable(requests: DataFrame, records: DataFrame, most_bytes: int = MOST_PAYLOAD) -> DataFrame:
    """(batch_id, reused): whether the record kept for a batch answers its request.

    It must be complete, small enough and for the same profile and images; the inputs' hashes must agree, or, where only
    the working files changed, the hash of the request made with the recorded ones (legacy_hash).
    """
    kept = records.select("batch_id", *(F.col(c).alias(f"_{c}") for c in ("complete", "bytes", "profile", "images", "working", "input_hash")))
    rows = requests.join(kept, "batch_id", "left")
    same = (F.col("_profile") == F.col("profile")) & (F.col("_images") == F.col("images")) & (F.col("_bytes") <= most_bytes) & F.col("_complete")
    inputs = F.when(F.col("_input_hash") == F.col("input_hash"), F.col("_working") == F.col("working")).otherwise((F.size("_working") == F.size("working")) & (F.col("_input_hash") == F.col("legacy_hash")))
    return rows.select("batch_id", F.coalesce(same & inputs, F.lit(False)).alias("reused"))
