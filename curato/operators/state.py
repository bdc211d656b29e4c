"""Run and stage state: latest rows, attempts, preferred runs, recovery and leases."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.functions.columns import lookup

# Which run stands for its project.
PRIORITY = {"active": 5, "awaiting_review": 4, "completed": 3, "failed_recoverable": 2, "cancelled": 2}
#: Fixed value: attempts at training, at most.
MOST_ATTEMPTS = 3


def latest_stage(stages: DataFrame) -> DataFrame:
    """Of each (run_id, stage) the row of the last successful attempt."""
    return stages.where("status = 'succeeded'").groupBy("run_id", "stage").agg(F.max_by(F.struct(*stages.columns), F.col("attempt")).alias("r")).select("r.*")


def next_attempt(stages: DataFrame) -> DataFrame:
    """(run_id, stage, next): one more than the last attempt."""
    return stages.groupBy("run_id", "stage").agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).alias("next"))


def stage_rank(stages: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """(run_id, rank): the furthest stage that a run finished; -1 if it is unknown."""
    done = stages.where("status = 'succeeded'")
    return done.groupBy("run_id").agg(F.max(F.coalesce(lookup(F.col("stage"), dict(ranks)), F.lit(-1))).alias("rank"))


def preferred_run(runs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(project_id, run_id): the run by its status, then its furthest stage, then its time; ties to the larger id."""
    rows = runs.join(ranks, "run_id", "left")
    key = F.struct(F.coalesce(lookup(F.col("status"), PRIORITY), F.lit(1)).alias("p"), F.coalesce("rank", F.lit(-1)).alias("r"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("t"), F.col("run_id").alias("i"))
    return rows.groupBy("project_id").agg(F.max_by("run_id", key).alias("run_id"))


def recover_interrupted(runs: DataFrame, stages: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a crash: attempts of active runs and those runs fail recoverably, running stages fail."""
    active = runs.where("status = 'active'").select("run_id")
    failed = attempts.join(active.withColumn("hit", F.lit(True)), "run_id", "left")
    failed = failed.withColumn("status", F.when(F.col("hit"), "failed_recoverable").otherwise(F.col("status"))).drop("hit")
    ended = stages.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))
    freed = runs.withColumn("status", F.when(F.col("status") == "active", "failed_recoverable").otherwise(F.col("status")))
    return freed, ended, failed


def stale_leases(leases: DataFrame, now: Column, timeout: str, alive: DataFrame) -> DataFrame:
    """Leases without a heartbeat for longer than ``timeout`` whose process isn't among those alive (pid)."""
    late = leases.where(F.col("heartbeat_at") < now - F.expr(f"INTERVAL {timeout}"))
    return late.join(alive.select("pid"), "pid", "left_anti")


def lease_conflicts(leases: DataFrame) -> DataFrame:
    """Devices that more than one lease holds."""
    return leases.groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1")


def resumable_attempt(attempts: DataFrame, fingerprint: Column) -> DataFrame:
    """(run_id, resume_from, next): the state of the newest earlier attempt with the same request, and the next number."""
    same = F.when((F.col("fingerprint") == fingerprint) & F.col("state").isNotNull(), F.col("attempt"))
    found = attempts.groupBy("run_id").agg(F.max_by("state", same).alias("resume_from"), (F.max("attempt") + 1).alias("next"))
    return found.withColumn("allowed", F.col("next") <= MOST_ATTEMPTS)


def resolve_layers(rows: DataFrame, layers: list[str], keys: list[str]) -> DataFrame:
    """For each key the last layer's value that isn't null, and that layer's name as ``<key>_from``.

    Columns are ``<layer>_<key>``; layers go from the weakest to the strongest.
    """
    out = rows
    for key in keys:
        strong = [f"{layer}_{key}" for layer in reversed(layers)]
        out = out.withColumn(key, F.coalesce(*strong)).withColumn(f"{key}_from", F.coalesce(*(F.when(F.col(c).isNotNull(), c.removesuffix(f"_{key}")) for c in strong)))
    return out


def throttled(samples: DataFrame, key: str, seconds: Column, interval: float) -> DataFrame:
    """(key, at): the samples taken when one is due again, an interval after the last taken one of the key.

    Which are taken depends on the one before: times come in order, and only the last taken one is kept in mind.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, 0.0
        for batch in batches:
            taken = []
            for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != own or at - last >= interval:
                    own, last = key, at
                    taken.append(True)
                else:
                    taken.append(False)
            yield batch.filter(pa.array(taken, pa.bool_()))

    times = samples.select(key, seconds.cast("double").alias("at")).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    return times.repartition(key).sortWithinPartitions(key, "at").mapInArrow(take, times.schema)


def first_free_name(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``free`` to names: the name, or with the smallest suffix from _v2 on that doesn't exist.

    A wanted name that has such a suffix itself is a name like any other.
    """
    suffix = "^(.*)_v([1-9][0-9]{0,8})$"
    taken = existing.select(F.regexp_extract("name", suffix, 1).alias("stem"), F.regexp_extract("name", suffix, 2).try_cast("int").alias("v")).where("v >= 2")
    used = taken.groupBy("stem").agg(F.collect_set("v").alias("used"))
    plain = existing.select("name").distinct().withColumn("there", F.lit(True))
    rows = wanted.join(plain, "name", "left").join(used, F.col("name") == F.col("stem"), "left").drop("stem")
    used = F.coalesce("used", F.array().cast("array<int>"))
    number = F.array_min(F.array_except(F.sequence(F.lit(2), F.size(used) + 2), used))
    free = F.when(F.col("there"), F.concat_ws("_v", F.col("name"), number.cast("string"))).otherwise(F.col("name"))
    return rows.withColumn("free", free).drop("used", "there")


def ordered_distinct(rows: DataFrame, value: str, place: str) -> DataFrame:
    """The distinct values with the place where each is first seen."""
    return rows.groupBy(value).agg(F.min(place).alias("first_place"))


def adjacent_overlaps(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (start, end) that begin before the one ahead of them ends, by key."""
    before = F.lag("end").over(Window.partitionBy(key).orderBy("start", "end"))
    return ranges.withColumn("before", before).where(F.col("before") > F.col("start")).drop("before")


def recovery_counts(runs: DataFrame, stages: DataFrame, leases: DataFrame) -> DataFrame:
    """One row: stages, runs and leases that a recovery would end."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    # One row each.
    return count(stages.where("status = 'running'"), "stages").crossJoin(F.broadcast(count(runs.where("status = 'active'"), "runs"))).crossJoin(F.broadcast(count(leases, "leases")))


def mark_crashed(recovery: Column) -> Column:
    """A recovery map with the marks of a crash, which win over what is there."""
    marks = {"classification": "PROCESS_CRASH", "recoverable": "true", "retry_applied": "false"}
    kept = F.map_filter(recovery, lambda k, v: ~k.isin(*marks))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.create_map(*(F.lit(x) for pair in marks.items() for x in pair)))


def lease_requests(requests: DataFrame, leases: DataFrame) -> DataFrame:
    """(request_id, result) of requests (request_id, kind, uuid, owner): ok, conflict, or not_owner.

    A device without a lease is given to the first request for it; a heartbeat or a release is the owner's own.
    """
    rows = requests.join(leases.select("uuid", F.col("owner").alias("holder")), "uuid", "left")
    turn = F.min(F.when(F.col("kind") == "acquire", F.col("request_id"))).over(Window.partitionBy("uuid"))
    gained = F.when(F.col("holder").isNull() & (F.col("request_id") == turn), "ok").otherwise("conflict")
    return rows.select("request_id", F.when(F.col("kind") == "acquire", gained).when(F.col("holder") == F.col("owner"), "ok").otherwise("not_owner").alias("result"))


def attempt_outcomes(started: DataFrame, ended: DataFrame) -> DataFrame:
    """(run_id, attempt, status) of started attempts with what ended them, if anything.

    A failure has the status that it names, else it is recoverable if a retry was applied, else fatal.
    """
    failed = F.coalesce("status", F.when(F.col("retry_applied"), "failed_recoverable").otherwise("failed_fatal"))
    rows = started.join(ended.withColumn("_ended", F.lit(True)), ["run_id", "attempt"], "left")
    return rows.select("run_id", "attempt", F.when(F.col("_ended").isNull(), "running").when(F.col("success"), "succeeded").otherwise(failed).alias("status"))


def repeated_attempts(started: DataFrame) -> DataFrame:
    """(run_id, attempt) that were started more than once, which none may be."""
    return started.groupBy("run_id", "attempt").agg(F.count("*").alias("n")).where("n > 1").select("run_id", "attempt")


def recent_projects(projects: DataFrame, preferred: DataFrame, most: int = 20) -> DataFrame:
    """(project_id, status, run_id): the latest changed projects (project_id, modified_at, draft).

    A draft has no run; others have the status of their preferred run (project_id, run_id, status), or are just created.
    """
    runs = preferred.select("project_id", "run_id", F.lower("status").alias("_status"))
    latest = projects.orderBy(F.desc("modified_at"), "project_id").limit(most).join(runs, "project_id", "left")
    shown = F.when(F.col("draft"), "draft").otherwise(F.coalesce("_status", F.lit("created")))
    return latest.select("project_id", shown.alias("status"), F.when(~F.col("draft"), F.col("run_id")).alias("run_id"), "modified_at")


def run_summary(steps: DataFrame) -> DataFrame:
    """(run_id, completed, any_impact): the last completed step and whether any change touched quality."""
    return steps.groupBy("run_id").agg(F.coalesce(F.max("step"), F.lit(0)).alias("completed"), F.coalesce(F.bool_or("impact"), F.lit(False)).alias("any_impact"))
