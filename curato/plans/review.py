"""Queries over approvals, candidate signals, attempts, joins and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from curato.functions import tags as ontology
from curato.functions.columns import json_bytes, map_rows, path_key
from curato.operators import approval, captions, evaluation, joins, planning, state
from curato.plans.assets import read
from curato.plans.state import RUNS, _runs

TAGS = ["smile", "masterpiece", "text", "dress", "highres", "1girl", "zzz unknown", "blue_eyes"]
_PICK = lambda k: F.array(*map(F.lit, TAGS))[(F.col("id") * k % len(TAGS)).cast("int")]


def _items(spark, sf):
    """Documents as refinement items of runs."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    few = F.array(F.lit("masterpiece"), F.lit("text"))
    proposed = F.when(F.col("id") % 4 == 0, few).otherwise(F.array(_PICK(3), _PICK(5)))
    return docs.select(F.col("id").alias("asset_id"), (F.col("id") % 50).alias("run_id"), (F.col("id") % 5 != 0).alias("factory_accepted"), proposed.alias("proposed"), F.array(_PICK(1), F.lit("coat")).alias("baseline"))


_T = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"
_KIND = "CASE WHEN t IN ('masterpiece', 'highres', 'text') THEN 0 ELSE 1 END"
ITEMS = f"""items AS (SELECT doc_id AS asset_id, doc_id % 50 AS run_id, doc_id % 5 <> 0 AS factory_accepted,
  CASE WHEN doc_id % 4 = 0 THEN ['masterpiece', 'text'] ELSE [{_T}[doc_id * 3 % 8 + 1], {_T}[doc_id * 5 % 8 + 1]] END AS proposed, [{_T}[doc_id % 8 + 1], 'coat'] AS baseline FROM documents),
content AS (SELECT *, list_bool_or(list_transform(proposed, lambda t: t NOT IN ('masterpiece', 'highres', 'text'))) AS says FROM items)"""


def automatic_approval(spark, sf):
    return approval.automatic_approval(_items(spark, sf), "auto", "tok", ["best_quality"])


def bulk_accept(spark, sf):
    """By one click, with invariants without content and no class token."""
    return approval.bulk_accept(_items(spark, sf), None, ["best_quality"])


def review_state(spark, sf):
    runs = spark.range(50).select(
        F.col("id").alias("run_id"),
        F.when(F.col("id") % 3 == 0, "auto").when(F.col("id") % 3 == 1, "review").otherwise("off").alias("mode"),
        (F.col("id") % 2 == 0).alias("suggests"),
        F.when(F.col("id") % 7 == 0, " own ").otherwise("").alias("trigger"),
        F.when(F.col("id") % 4 == 0, "solo").otherwise(F.concat(F.lit("tok"), F.col("id").cast("string"))).alias("token"),
    )
    found = read(spark, sf, "nation").select((F.col("n_nationkey") * 2 % 50).alias("run_id"), F.col("n_nationkey").alias("place"), F.lower("n_name").alias("value")).where("place % 3 = 0")
    return approval.review_state(_items(spark, sf), runs, found)


def _approvals(spark, sf):
    rows = _items(spark, sf).where("asset_id % 13 <> 0")
    kind = F.when(F.col("asset_id") % 3 == 0, "accept").when(F.col("asset_id") % 3 == 1, "reject").otherwise("edit")
    rows = rows.select("asset_id", kind.alias("decision"), F.when(F.col("asset_id") % 6 == 5, F.array(F.lit("smile"), F.lit("solo"))).alias("edited"))
    return rows.unionByName(rows.where("asset_id % 17 = 0"))


APPROVALS = f"""{ITEMS}, sent AS (SELECT asset_id, CASE asset_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END AS decision, CASE WHEN asset_id % 6 = 5 THEN ['smile', 'solo'] END AS edited FROM items WHERE asset_id % 13 <> 0),
twice AS (SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE asset_id % 17 = 0), counted AS (SELECT asset_id, count(*) AS n, any_value(decision) AS decision, any_value(edited) AS edited FROM twice GROUP BY 1),
decided AS (SELECT asset_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN decision = 'edit' AND edited IS NULL THEN 'edited_tags_required' END AS problem,
  CASE decision WHEN 'accept' THEN proposed WHEN 'reject' THEN baseline ELSE edited END AS tags FROM items LEFT JOIN counted USING (asset_id))"""


def approval_tags(spark, sf):
    rows = approval.decided_tags(_items(spark, sf).select("asset_id", "baseline", "proposed"), _approvals(spark, sf))
    return rows.select("asset_id", F.array_join("tags", "|").alias("tags"), "problem")


def approval_problems(spark, sf):
    return approval.approval_problems(_items(spark, sf).select("asset_id", "baseline", "proposed"), _approvals(spark, sf), "tok")


def fallback_refinement(spark, sf):
    rows = approval.fallback_refinement(_items(spark, sf))
    return rows.select("asset_id", "decision", F.array_join("effective", "|").alias("effective"), "confidence")


def fallback_review(spark, sf):
    key = F.col("p_partkey")
    task = F.array(*map(F.lit, ["dataset_review", "training_plan", "recovery", "final_review"]))[(key % 4).cast("int")]
    rows = read(spark, sf, "part").select(key.alias("task_id"), task.alias("task"), F.when(key % 5 > 0, key % 2 == 0).alias("gate_passed"), F.when(key % 3 > 0, F.array(F.concat(F.lit("c"), key.cast("string")), F.lit("x"))).alias("ranking"))
    return approval.fallback_review(rows)


def prepared_cache(spark, sf):
    key = F.col("p_partkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    asked = read(spark, sf, "part").select(key.alias("batch_id"), F.lit("p1").alias("profile"), F.array(text("i", key)).alias("images"), F.array(text("w", key)).alias("working"), text("h", key).alias("input_hash"), text("l", key).alias("legacy_hash"))
    kept = read(spark, sf, "part").where("p_partkey % 11 <> 0").select(
        key.alias("batch_id"),
        (key % 7 != 0).alias("complete"),
        F.when(key % 10 == 0, 200_000).otherwise(500).alias("bytes"),
        F.when(key % 9 == 0, "p2").otherwise("p1").alias("profile"),
        F.array(text("i", key)).alias("images"),
        F.array(text("w", F.when(key % 4 == 0, key + 1).otherwise(key))).alias("working"),
        F.when(key % 8 == 0, text("l", key)).when(key % 5 == 0, text("z", key)).otherwise(text("h", key)).alias("input_hash"),
    )
    return approval.reusable(asked, kept)


def quoted_audit(spark, sf):
    """Captions with quotes and lines: nations' names in several forms."""
    key, name = F.col("n_nationkey"), F.lower("n_name")
    caption = (
        F.when(key % 5 == 0, F.concat(F.lit('tok, 1girl, "'), name, F.lit(', b"')))
        .when(key % 5 == 1, F.concat(F.lit("tok, 1girl\n"), name))
        .when(key % 5 == 2, F.concat(F.lit("1girl, tok, "), name))
        .when(key % 5 == 3, F.lit(" \n "))
        .otherwise(F.concat(F.lit("tok, 1girl, smile, smile, "), name, F.lit("\n")))
    )
    rows = read(spark, sf, "nation").select(key.alias("asset_id"), caption.alias("caption"))
    return captions.audit(rows, "tok", "1girl").select("asset_id", F.array_join("tags", "|").alias("tags"), F.array_join("issues", ",").alias("issues"))


def free_name_chain(spark, sf):
    """Names, some of which end in a version themselves, against existing names and versions."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    wanted = read(spark, sf, "supplier").select(F.when(key % 4 == 0, F.concat(name, F.lit("_v3"))).otherwise(name).alias("name"))
    version = lambda n: F.concat(name, F.lit(f"_v{n}"))
    held = F.when(key % 4 == 0, F.array(version(3), F.concat(version(3), F.lit("_v2")))).when(key % 4 == 1, F.array(name, version(2), version(4))).when(key % 4 == 2, F.array(version(2)))
    return state.first_free_name(wanted, read(spark, sf, "supplier").select(F.explode(held).alias("name")))


def _samples(spark, sf):
    rows, key = read(spark, sf, "embeddings"), F.col("vec_id")
    return rows.select(
        key.alias("sample_id"),
        (key % 7).alias("checkpoint"),
        (key % 3).alias("prompt"),
        (key % 11 != 0).alias("success"),
        ((key % 100) / 100.0).alias("mean"),
        ((key % 9) / 50.0).alias("spread"),
        ((key % 5) / 4.0).alias("compliance"),
        ((key % 4) / 10.0 + 0.6).alias("weight"),
        F.array(F.lit("Blue Eyes"), F.when(key % 2 == 0, "dress").otherwise("hat")).alias("tags"),
        F.col("embedding").alias("pixel"),
        F.reverse("embedding").alias("semantic"),
        "label",
    )


def _signals(spark, sf):
    rows = _samples(spark, sf)
    references = rows.where("label = 1").select(F.col("sample_id").alias("reference_id"), "pixel", "semantic")
    return evaluation.visual_signals(rows, references, "checkpoint", ["blue_eyes", "dress"])


SIGNALS = ("reference_similarity", "prompt_compliance", "flexibility", "consistency", "technical", "visual_heuristic", "failure_rate", "memorisation_risk", "recommended_weight")


def visual_signals(spark, sf):
    return _signals(spark, sf).select("checkpoint", "n", "usable", *(F.round(c, 5).alias(c) for c in SIGNALS))


def visual_ranking(spark, sf):
    """Candidates ranked by their signals."""
    rows = _signals(spark, sf).withColumns({"identity": F.col("reference_similarity"), "validation": evaluation.validation_score(F.lit(None).cast("double")), "corrupted": F.lit(False), "overfit_risk": F.col("memorisation_risk")})
    rows = evaluation.rank(evaluation.score(rows).withColumn("score", F.round("score", 9)), "checkpoint")
    return rows.select("checkpoint", "gate_passed", F.round("score", 5).alias("score"), "rank")


def _vector(kind: str, of: str) -> str:
    return f"""{kind}_v AS (SELECT sample_id, checkpoint, prompt, ok, ref, list_transform({of}, lambda x: CAST(x AS DOUBLE)) AS v FROM samples),
{kind}_c AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(0, len(v))) AS i FROM {kind}_v WHERE ref) GROUP BY i), {kind}_m AS (SELECT list(x ORDER BY i) AS c FROM {kind}_c),
{kind}_s AS (SELECT checkpoint, avg(least(1, greatest(0, list_cosine_similarity(v, c)))) AS s FROM {kind}_v, {kind}_m WHERE ok GROUP BY 1),
{kind}_n AS (SELECT a.checkpoint, max(list_cosine_similarity(a.v, b.v)) AS n FROM {kind}_v a, {kind}_v b WHERE a.ok AND b.ref GROUP BY 1),
{kind}_g AS (SELECT checkpoint, prompt, count(*) AS n FROM {kind}_v WHERE ok GROUP BY ALL),
{kind}_q AS (SELECT a.checkpoint, a.prompt, avg(list_cosine_similarity(a.v, b.v)) AS p FROM {kind}_v a JOIN {kind}_v b ON a.checkpoint = b.checkpoint AND a.prompt = b.prompt AND a.sample_id < b.sample_id WHERE a.ok AND b.ok GROUP BY ALL),
{kind}_k AS (SELECT checkpoint, avg(CASE WHEN n > 1 THEN least(1, greatest(0, p)) ELSE 1 END) AS k FROM {kind}_g LEFT JOIN {kind}_q USING (checkpoint, prompt) GROUP BY 1),
{kind}_d AS (SELECT checkpoint, prompt, i, avg(x) AS x FROM (SELECT checkpoint, prompt, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM {kind}_v WHERE ok) GROUP BY ALL), {kind}_e AS (SELECT checkpoint, prompt, list(x ORDER BY i) AS c FROM {kind}_d GROUP BY ALL),
{kind}_f AS (SELECT a.checkpoint, avg(list_cosine_similarity(a.c, b.c)) AS f FROM {kind}_e a JOIN {kind}_e b ON a.checkpoint = b.checkpoint AND a.prompt < b.prompt GROUP BY 1)"""


_METRICS = f"""samples AS (SELECT vec_id AS sample_id, vec_id % 7 AS checkpoint, vec_id % 3 AS prompt, label = 1 AS ref, embedding AS pixel, list_reverse(embedding) AS semantic,
  vec_id % 11 <> 0 AND NOT ((vec_id % 9) / CAST(50 AS DOUBLE) < 0.003 OR (vec_id % 100) / CAST(100 AS DOUBLE) < 0.003) AS ok, least(1, greatest(0, (vec_id % 9) / CAST(50 AS DOUBLE) / 0.18)) * (1 - least(1, abs((vec_id % 100) / CAST(100 AS DOUBLE) - 0.5))) AS health,
  (vec_id % 5) / CAST(4 AS DOUBLE) AS compliance, (vec_id % 4) / CAST(10 AS DOUBLE) + 0.6 AS weight, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0.5 END AS held FROM embeddings),
base AS (SELECT checkpoint, count(*) AS n, count(*) FILTER (ok) AS usable, avg(health) FILTER (ok) AS visual_heuristic, avg(compliance) FILTER (ok) AS prompt_compliance, avg(held) FILTER (ok) AS held FROM samples GROUP BY 1),
means AS (SELECT checkpoint, weight, round(avg(0.5 * health + 0.5 * compliance), 9) AS m FROM samples WHERE ok GROUP BY ALL),
weights AS (SELECT checkpoint, weight, row_number() OVER (PARTITION BY checkpoint ORDER BY m DESC, abs(weight - 0.8), weight) AS r FROM means),
{_vector("pixel", "pixel")}, {_vector("semantic", "semantic")},
metrics AS (SELECT checkpoint, b.n, usable, least(1, greatest(0, 0.75 * (ps.s + ss.s) / 2 + 0.25 * held)) AS reference_similarity, prompt_compliance,
  least(1, greatest(0, (1 - (least(1, greatest(0, coalesce(pf.f, 1))) + least(1, greatest(0, coalesce(sf.f, 1)))) / 2) * 5)) AS flexibility, (pk.k + sk.k) / 2 AS consistency, usable / CAST(b.n AS DOUBLE) AS technical, visual_heuristic,
  1 - usable / CAST(b.n AS DOUBLE) AS failure_rate, least(1, greatest(0, ((pn.n + sn.n) / 2 - 0.985) / 0.015)) AS memorisation_risk, weight AS recommended_weight
  FROM base b JOIN weights w USING (checkpoint) JOIN pixel_s ps USING (checkpoint) JOIN semantic_s ss USING (checkpoint) JOIN pixel_n pn USING (checkpoint) JOIN semantic_n sn USING (checkpoint) JOIN pixel_k pk USING (checkpoint) JOIN semantic_k sk USING (checkpoint)
  LEFT JOIN pixel_f pf USING (checkpoint) LEFT JOIN semantic_f sf USING (checkpoint) WHERE w.r = 1)"""


def strict_join(spark, sf):
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_name")
    return joins.one_to_one(rows, rows.select("s_suppkey", F.length("s_name").alias("n")), "s_suppkey").select("s_suppkey", "n")


def complete_join(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.complete(orders, read(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("o_orderkey", "c_nationkey")


def related_pairs(spark, sf):
    """Suppliers of a nation whose balances differ by little."""
    rows = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return joins.related_pairs(rows, "s_suppkey", F.col("s_nationkey"), lambda left, right: F.abs(left("s_acctbal") - right("s_acctbal")) < 500)


def ranking_metrics(spark, sf):
    """Signals of candidates joined with their ranks."""
    ranks = visual_ranking(spark, sf).select("checkpoint", "rank")
    return joins.one_to_one(visual_signals(spark, sf).select("checkpoint", "consistency"), ranks, "checkpoint").select("checkpoint", "consistency", "rank")


def recovery_counts(spark, sf):
    runs = _runs(spark, sf)
    stages = runs.select("run_id", F.when(F.col("run_id") % 3 == 0, "running").otherwise("succeeded").alias("status"))
    return state.recovery_counts(runs, stages, read(spark, sf, "supplier"))


def crash_marks(spark, sf):
    marks = F.create_map(F.lit("step"), F.col("run_id").cast("string"), F.lit("recoverable"), F.lit("no"))
    rows = _runs(spark, sf).where("status = 'active'").select("run_id", map_rows(state.mark_crashed(marks)).alias("m"))
    return rows.select("run_id", F.array_join(F.transform("m", lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("recovery"))


def lease_requests(spark, sf):
    key = F.col("p_partkey")
    asked = read(spark, sf, "part").select(key.alias("request_id"), F.when(key % 3 == 0, "acquire").when(key % 3 == 1, "heartbeat").otherwise("release").alias("kind"), (key % 40).alias("uuid"), (key % 5).alias("owner"))
    held = spark.range(40).where("id % 2 = 0").select(F.col("id").alias("uuid"), (F.col("id") % 5).alias("owner"))
    return state.lease_requests(asked, held)


def attempt_outcomes(spark, sf):
    key = F.col("o_orderkey")
    started = read(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), key.alias("attempt"))
    ended = read(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("run_id"), key.alias("attempt"), (key % 4 == 0).alias("success"), F.when(key % 7 == 0, "cancelled").alias("status"), (key % 3 == 0).alias("retry_applied"))
    return state.attempt_outcomes(started, ended)


def repeated_attempts(spark, sf):
    return state.repeated_attempts(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 3).alias("attempt")))


def recent_projects(spark, sf):
    runs = _runs(spark, sf)
    preferred = state.preferred_run(runs, runs.select("run_id", "rank")) if "rank" not in runs.columns else state.preferred_run(runs.drop("rank"), runs.select("run_id", "rank"))
    preferred = preferred.join(runs.select("run_id", "status"), "run_id")
    projects = read(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") * 37 % 1000).alias("modified_at"), (F.col("c_custkey") % 4 == 0).alias("draft"))
    return state.recent_projects(projects, preferred)


def run_summary(spark, sf):
    return state.run_summary(read(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("step"), (F.col("event_type") == "error").alias("impact")))


def library_matrix(spark, sf):
    place = lambda table, key, name: read(spark, sf, table).select(F.col(key).alias("place"), F.col(key).alias(name))
    return planning.library_matrix(place("nation", "n_nationkey", "c"), place("region", "r_regionkey", "p"))


def sampling_union(spark, sf):
    from curato.plans.training import QUERIES as training

    return planning.all_passes([training[f"sampling_matrix_pass{n}"][0](spark, sf) for n in (1, 2, 3)])


def sample_previews(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("checkpoint"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_linestatus") == "O").alias("success"))
    return planning.previews(rows, rows.select("checkpoint").distinct(), "checkpoint", "place")[0]


def grid_cells(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("checkpoint"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_linestatus") == "O").alias("success"))
    return planning.previews(rows, rows, "checkpoint", "place")[1]


def preferred_devices(spark, sf):
    key = F.col("p_partkey")
    names = F.when(key % 2 == 0, F.array(F.lit("g0"), F.lit("g1"))).otherwise(F.array(F.lit("g0")))
    return read(spark, sf, "part").select("p_partkey", planning.preferred_device(F.when(key % 3 == 0, "generated_tag").otherwise("tag"), names, F.when(key % 5 == 0, "g0")).alias("device"))


def tagger_selection(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "general").when(F.col("event_id") % 3 == 1, "character").otherwise("rating")
    rows = read(spark, sf, "events").select("event_id", (F.col("value") / 250).alias("score"), kind.alias("model_category"))
    return planning.tagger_selection(rows).select("event_id", "selected")


def prompt_set(spark, sf):
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").alias("prompt_id"), F.concat(F.lit("{trigger}, "), F.lower("n_name")).alias("text"))
    return planning.prompt_set(rows, "tok")


def path_order(spark, sf):
    """Pages' addresses as paths: what they share where case doesn't count, and the first of each."""
    path = F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.replace("url", F.lit("/"), F.lit("\\")))
    rows = read(spark, sf, "pages").select("page_id", path.alias("path")).withColumn("path_key", path_key(F.col("path")))
    return rows.groupBy("path_key").agg(F.min_by("page_id", F.struct("path", "page_id")).alias("first"), F.count("*").alias("n"))


def tag_map_rows(spark, sf):
    """A map of scores as rows in the order of the tags."""
    tags = F.create_map(F.col("s_name"), F.col("s_acctbal"), F.lit("zz"), F.lit(1.0), F.lit("A"), F.lit(2.0))
    rows = read(spark, sf, "supplier").select("s_suppkey", F.posexplode(map_rows(tags)).alias("place", "e"))
    return rows.select("s_suppkey", "place", F.col("e.key").alias("tag"), F.col("e.value").alias("score"))


def serialized_sizes(spark, sf):
    rows = read(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("asset_id"), F.array(F.lit("é"), F.lit("b")).alias("tags")).alias("s"))
    return rows.select("n_nationkey", json_bytes(F.col("s")).alias("bytes"))


_NEST = " UNION ALL ".join(f"SELECT {n} AS pass, c, i, j, weight, seed, p FROM (SELECT n_nationkey AS c FROM nation{f' WHERE n_nationkey < {some}' if some else ''}), (VALUES {', '.join(f'({i}, CAST({w} AS DOUBLE))' for i, w in enumerate(ws))}) w(i, weight), (VALUES {', '.join(f'({j}, {s})' for j, s in enumerate(ss))}) s(j, seed), (SELECT r_regionkey AS p FROM region{f' WHERE r_regionkey < {texts}' if texts else ''})" for n, (some, texts, ws, ss) in enumerate(planning.LIBRARY_PASSES, 1))
_ROUND = ", ".join(f"round({c}, 5) AS {c}" for c in SIGNALS)
_SCORE = "CASE WHEN failure_rate <= 0.25 THEN least(1, greatest(0, 0.35 * reference_similarity + 0.2 * prompt_compliance + 0.15 * flexibility + 0.1 * consistency + 0.1 * 0.5 + 0.05 * technical + 0.05 * visual_heuristic - 0.2 * memorisation_risk)) ELSE 0 END"
_RANKED = f"ranked AS (SELECT checkpoint, failure_rate <= 0.25 AS gate_passed, round({_SCORE}, 9) AS score FROM metrics), placed AS (SELECT *, CAST(row_number() OVER (ORDER BY gate_passed DESC, score DESC, checkpoint) AS INTEGER) AS rank FROM ranked)"
_PREVIEW = "SELECT l_suppkey AS checkpoint, l_orderkey * 10 + l_linenumber AS place, l_linestatus = 'O' AS success FROM lineitem"

QUERIES = {
    "automatic_approval": (automatic_approval, f"WITH {ITEMS} SELECT asset_id, CASE WHEN factory_accepted AND says THEN 'accept' ELSE 'reject' END AS decision FROM content"),
    "bulk_accept": (bulk_accept, f"WITH {ITEMS} SELECT asset_id, CASE WHEN factory_accepted AND says THEN 'accept' ELSE 'reject' END AS decision FROM content"),
    "review_state": (review_state, f"WITH {ITEMS}, runs AS (SELECT id AS run_id, CASE id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'off' END AS mode, id % 2 = 0 AS suggests, CASE WHEN id % 7 = 0 THEN 'own' END AS own, CASE WHEN id % 4 = 0 THEN 'solo' ELSE 'tok' || id END AS token FROM range(50) r(id)), f AS (SELECT n_nationkey * 2 % 50 AS run_id, arg_min(lower(n_name), n_nationkey) AS c FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1), k AS (SELECT run_id, count(*) FILTER (NOT says) AS a, count(*) FILTER (NOT factory_accepted) AS b FROM content GROUP BY 1), t AS (SELECT run_id, mode, suggests, coalesce(own, CASE WHEN suggests THEN c END, CASE WHEN mode = 'auto' AND suggests AND token <> 'solo' THEN token END, '') AS trigger, coalesce(a, 0) AS without_content, coalesce(b, 0) AS rejected FROM runs LEFT JOIN f USING (run_id) LEFT JOIN k USING (run_id)) SELECT run_id, trigger, suggests AND trigger = '' AS requires_trigger, mode = 'review' OR without_content > 0 OR (mode = 'auto' AND rejected > 0) AS requires_review, without_content, rejected FROM t"),
    "approval_tags": (approval_tags, f"WITH {APPROVALS} SELECT asset_id, CASE WHEN problem IS NULL THEN array_to_string(tags, '|') END AS tags, problem FROM decided"),
    "approval_problems": (approval_problems, f"WITH {APPROVALS}, c AS (SELECT asset_id, tags, CASE WHEN len(list_distinct(tags)) < len(tags) THEN 'duplicated_tags' WHEN list_has_any(tags, ['masterpiece', 'highres', 'text']) THEN 'forbidden_tags' END AS issue FROM decided WHERE problem IS NULL) SELECT asset_id, problem FROM decided WHERE problem IS NOT NULL UNION ALL SELECT asset_id, issue FROM c WHERE issue IS NOT NULL"),
    "fallback_refinement": (fallback_refinement, f"WITH {ITEMS} SELECT asset_id, 'keep' AS decision, array_to_string(baseline, '|') AS effective, CAST(1 AS DOUBLE) AS confidence FROM items"),
    "fallback_review": (fallback_review, "SELECT p_partkey AS task_id, CASE WHEN p_partkey % 4 < 2 THEN p_partkey % 5 > 0 AND p_partkey % 2 = 0 END AS approved, CASE WHEN p_partkey % 4 = 3 AND p_partkey % 3 > 0 THEN 'c' || p_partkey END AS recommended FROM part"),
    "prepared_cache": (prepared_cache, "SELECT p_partkey AS batch_id, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 9 <> 0 AND CASE WHEN p_partkey % 8 = 0 THEN true WHEN p_partkey % 5 = 0 THEN false ELSE p_partkey % 4 <> 0 END AS reused FROM part"),
    "quoted_audit": (quoted_audit, "WITH k AS (SELECT n_nationkey AS asset_id, n_nationkey % 5 AS m, lower(n_name) AS name FROM nation) SELECT asset_id, CASE m WHEN 0 THEN 'tok|1girl|' || name || ', b' WHEN 2 THEN '1girl|tok|' || name WHEN 4 THEN 'tok|1girl|smile|smile|' || name ELSE '' END AS tags, CASE m WHEN 0 THEN '' WHEN 1 THEN 'invalid_caption,empty_caption' WHEN 2 THEN 'trigger_not_first,class_token_inconsistent' WHEN 3 THEN 'empty_caption' ELSE 'duplicated_tags' END AS issues FROM k"),
    "free_name_chain": (free_name_chain, "WITH RECURSIVE w AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN s_name || '_v3' ELSE s_name END AS name FROM supplier), e AS (SELECT s_name || s AS name FROM supplier, (VALUES (0, '_v3'), (0, '_v3_v2'), (1, ''), (1, '_v2'), (1, '_v4'), (2, '_v2')) x(m, s) WHERE s_suppkey % 4 = m), t AS (SELECT name, 1 AS n, name AS free FROM w UNION ALL SELECT name, n + 1, name || '_v' || (n + 1) FROM t WHERE free IN (SELECT name FROM e)) SELECT name, free FROM t WHERE free NOT IN (SELECT name FROM e)"),
    "visual_signals": (visual_signals, f"WITH {_METRICS} SELECT checkpoint, n, usable, {_ROUND} FROM metrics"),
    "visual_ranking": (visual_ranking, f"WITH {_METRICS}, {_RANKED} SELECT checkpoint, gate_passed, round(score, 5) AS score, rank FROM placed"),
    "ranking_metrics": (ranking_metrics, f"WITH {_METRICS}, {_RANKED} SELECT checkpoint, round(consistency, 5) AS consistency, rank FROM metrics JOIN placed USING (checkpoint)"),
    "strict_join": (strict_join, "SELECT s_suppkey, CAST(length(s_name) AS INTEGER) AS n FROM supplier"),
    "complete_join": (complete_join, "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey"),
    "related_pairs": (related_pairs, "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) < 500"),
    "recovery_counts": (recovery_counts, f"WITH {RUNS} SELECT (SELECT count(*) FROM runs WHERE run_id % 3 = 0) AS stages, (SELECT count(*) FROM runs WHERE status = 'active') AS runs, (SELECT count(*) FROM supplier) AS leases"),
    "crash_marks": (crash_marks, f"WITH {RUNS} SELECT run_id, 'classification=PROCESS_CRASH,recoverable=true,retry_applied=false,step=' || run_id AS recovery FROM runs WHERE status = 'active'"),
    "lease_requests": (lease_requests, "WITH r AS (SELECT p_partkey AS request_id, p_partkey % 3 AS kind, p_partkey % 40 AS uuid, p_partkey % 5 AS owner FROM part), t AS (SELECT *, min(request_id) FILTER (kind = 0) OVER (PARTITION BY uuid) AS first FROM r) SELECT request_id, CASE WHEN kind = 0 THEN CASE WHEN uuid % 2 = 1 AND request_id = first THEN 'ok' ELSE 'conflict' END WHEN uuid % 2 = 0 AND uuid % 5 = owner THEN 'ok' ELSE 'not_owner' END AS result FROM t"),
    "attempt_outcomes": (attempt_outcomes, "SELECT o_custkey AS run_id, o_orderkey AS attempt, CASE WHEN o_orderkey % 5 = 0 THEN 'running' WHEN o_orderkey % 4 = 0 THEN 'succeeded' WHEN o_orderkey % 7 = 0 THEN 'cancelled' WHEN o_orderkey % 3 = 0 THEN 'failed_recoverable' ELSE 'failed_fatal' END AS status FROM orders"),
    "repeated_attempts": (repeated_attempts, "SELECT l_orderkey AS run_id, l_linenumber % 3 AS attempt FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "recent_projects": (recent_projects, f"WITH {RUNS}, p AS (SELECT project_id, arg_max(run_id, (CASE status WHEN 'active' THEN 5 WHEN 'completed' THEN 3 ELSE 2 END, rank, created_at, run_id)) AS run_id FROM runs GROUP BY 1), l AS (SELECT c_custkey AS project_id, c_custkey * 37 % 1000 AS modified_at, c_custkey % 4 = 0 AS draft FROM customer ORDER BY modified_at DESC, project_id LIMIT 20) SELECT l.project_id, CASE WHEN draft THEN 'draft' ELSE coalesce(status, 'created') END AS status, CASE WHEN NOT draft THEN p.run_id END AS run_id, modified_at FROM l LEFT JOIN p ON p.project_id = l.project_id LEFT JOIN runs ON runs.run_id = p.run_id"),
    "run_summary": (run_summary, "SELECT user_id AS run_id, coalesce(max(event_id) FILTER (event_type <> 'error'), 0) AS completed, bool_or(event_type = 'error') AS any_impact FROM events GROUP BY 1"),
    "library_matrix": (library_matrix, f'WITH n AS ({_NEST}), o AS (SELECT *, CAST(row_number() OVER (ORDER BY pass, c, i, j, p) AS INTEGER) AS ordinal FROM n) SELECT pass, c, weight, seed, p, ordinal FROM o WHERE ordinal <= 256'),
    "sample_previews": (sample_previews, f"WITH s AS ({_PREVIEW}) SELECT checkpoint, min(place) AS place FROM s WHERE success GROUP BY 1"),
    "grid_cells": (grid_cells, f'WITH s AS ({_PREVIEW} ORDER BY place LIMIT 12), g AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS cell FROM s WHERE success) SELECT place, checkpoint, CAST(cell // 4 AS INTEGER) AS "row", CAST(cell % 4 AS INTEGER) AS "column" FROM g'),
    "preferred_devices": (preferred_devices, "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'g1' ELSE 'g0' END AS device FROM part"),
    "tagger_selection": (tagger_selection, "SELECT event_id, value / 250 > CASE event_id % 3 WHEN 0 THEN 0.35 WHEN 1 THEN 0.85 ELSE 0 END AS selected FROM events"),
    "prompt_set": (prompt_set, "SELECT n_nationkey AS prompt_id, 'tok, ' || lower(n_name) AS text FROM nation"),
    "path_order": (path_order, "WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE replace(url, '/', chr(92)) END AS path FROM pages), k AS (SELECT *, lower(regexp_replace(replace(path, chr(92), '/'), '/+', '/', 'g')) AS path_key FROM p) SELECT path_key, arg_min(page_id, (path, page_id)) AS \"first\", count(*) AS n FROM k GROUP BY 1"),
    "tag_map_rows": (tag_map_rows, "WITH r AS (SELECT s_suppkey, s_name AS tag, s_acctbal AS score FROM supplier UNION ALL SELECT s_suppkey, 'zz', 1 FROM supplier UNION ALL SELECT s_suppkey, 'A', 2 FROM supplier) SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY tag) - 1 AS INTEGER) AS place, tag, score FROM r"),
    "serialized_sizes": (serialized_sizes, "SELECT n_nationkey, CAST(strlen('{\"asset_id\":\"' || n_name || '\",\"tags\":[\"é\",\"b\"]}') AS INTEGER) AS bytes FROM nation"),
}


def _union_sql() -> str:
    from curato.plans.training import QUERIES as training

    return " UNION ALL ".join(f"SELECT *, {n} AS pass FROM ({training[f'sampling_matrix_pass{n}'][1]})" for n in (1, 2, 3))


QUERIES["sampling_union"] = (sampling_union, _union_sql())
