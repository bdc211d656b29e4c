"""Queries over embeddings, splits, buckets, plans, sampling and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curato.operators import captions, duplicates, embeddings, evaluation, planning, trainplan
from curato.plans.assets import read


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def embedding_centroid_similarity(spark, sf):
    return embeddings.centroid_similarity(_vectors(spark, sf), "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


def embedding_outlier_threshold(spark, sf):
    rows = embeddings.outlier_threshold(embeddings.centroid_similarity(_vectors(spark, sf), "vec_id", "embedding"))
    return rows.select(*(F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")))


def embedding_outliers(spark, sf):
    """With a smaller gap than usual, as the test vectors lie far apart."""
    rows = embeddings.outliers(_vectors(spark, sf), "vec_id", "embedding", least_gap=0.0, spreads=0.9)
    return rows.select("vec_id", F.round("similarity", 6).alias("similarity"), F.round("threshold", 6).alias("threshold"))


NEAR = 0.40


def embedding_near_pairs(spark, sf):
    rows = duplicates.cosine_pairs(_vectors(spark, sf), "vec_id", "embedding", NEAR, all_pairs=True)
    return rows.select("a", "b", F.round("cosine", 5).alias("cosine"))


def embedding_clusters(spark, sf):
    rows = duplicates.cluster_pairs(duplicates.cosine_pairs(_vectors(spark, sf), "vec_id", "embedding", NEAR, forest=True))
    return rows.select(F.col("node").alias("vec_id"), F.col("label").alias("cluster"))


def embedding_label_nearest(spark, sf):
    rows = _vectors(spark, sf)
    return embeddings.nearest(rows, rows, "vec_id", "embedding").select("vec_id", "other", F.round("cosine", 5).alias("cosine"))


def cluster_merge(spark, sf):
    """Groups of equal texts and of near vectors, taken together by id."""
    docs = read(spark, sf, "documents")
    texts = docs.select(F.col("doc_id").alias("member"), F.sha2(F.col("text").cast("binary"), 256).alias("group"))
    pairs = duplicates.cosine_pairs(_vectors(spark, sf), "vec_id", "embedding", NEAR, forest=True)
    near = duplicates.cluster_pairs(pairs).select(F.col("node").alias("member"), F.col("label").cast("string").alias("group"))
    return duplicates.merge_groupings([texts, near]).select(F.col("node").alias("member"), F.col("label").alias("cluster"))


_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"
_COS = "pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.v, y.v) AS c FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_inner_product(x.v, y.v) >= 0.40)"
_SIM = f"""{_UNIT}, dims AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM u), mean AS (SELECT i, avg(x) AS m FROM dims GROUP BY i), len AS (SELECT sqrt(sum(m * m)) AS l FROM mean),
sims AS (SELECT vec_id, least(1, greatest(0, sum(x * m / l))) AS s FROM dims JOIN mean USING (i), len GROUP BY vec_id), med AS (SELECT median(s) AS med FROM sims), mads AS (SELECT any_value(med) AS med, median(abs(s - med)) AS mad FROM sims, med)"""
_REACH = "both_ AS (SELECT {e}), reach AS (SELECT node, other FROM both_ UNION SELECT reach.node, y.other FROM reach JOIN both_ y ON reach.other = y.node)"


def holdout_hash_split(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id")
    n = docs.count()
    wanted = docs.sparkSession.range(1).select(planning.holdout_size(F.lit(n), 0.1, 2, 50, 24)).first()[0]
    return planning.hash_holdout(docs, "doc_id", wanted)


def holdout_cluster_split(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang")
    rows = docs.withColumn("cluster", F.when(F.col("doc_id") % 3 == 0, F.concat_ws("-", "source", "lang")))
    return planning.hash_holdout(rows, "doc_id", 40, cluster="cluster").select("doc_id", "split")


def holdout_sizes(spark, sf):
    n = F.col("p_partkey")
    return read(spark, sf, "part").select(n.alias("n"), planning.holdout_size(n, 0.1, 2, 50, 24).alias("half_up"), planning.holdout_size(n, 0.1, 2, 50, 24, half_even=True).alias("half_even"))


def _sizes(spark, sf):
    key = F.col("p_partkey")
    return read(spark, sf, "part").select(key.alias("asset_id"), (F.col("p_size") * 61 + 17).cast("long").alias("w"), (key % 1900 + 40).cast("long").alias("h"), F.when(key % 3 == 0, 768).when(key % 3 == 1, 896).otherwise(1024).alias("most"))


def bucket_assignment(spark, sf):
    rows = _sizes(spark, sf)
    w, h = planning.bucket(F.col("w"), F.col("h"), F.col("most"))
    return rows.select("asset_id", w.alias("bucket_w"), h.alias("bucket_h"))


def bucket_histogram(spark, sf):
    return bucket_assignment(spark, sf).groupBy("bucket_w", "bucket_h").agg(F.count("*").alias("n"))


_BUCKETS = """z AS (SELECT p_partkey AS asset_id, p_size * 61 + 17 AS w, p_partkey % 1900 + 40 AS h, CASE WHEN p_partkey % 3 = 0 THEN 768 WHEN p_partkey % 3 = 1 THEN 896 ELSE 1024 END AS m FROM part),
z1 AS (SELECT *, w / CAST(h AS DOUBLE) AS r, CAST(m * m AS DOUBLE) AS area FROM z), z2 AS (SELECT *, sqrt(area * r) AS sw FROM z1),
z3 AS (SELECT *, floor(sw + 0.5) - floor(sw + 0.5) % 64 AS w1, floor(area / sw + 0.5) - floor(area / sw + 0.5) % 64 AS h2 FROM z2),
z4 AS (SELECT *, floor(w1 / r + 0.5) - floor(w1 / r + 0.5) % 64 AS h1, floor(h2 * r + 0.5) - floor(h2 * r + 0.5) % 64 AS w2 FROM z3),
z5 AS (SELECT *, CASE WHEN least(w1, h1) >= 64 THEN abs(w1 / h1 - r) END AS e1, CASE WHEN least(w2, h2) >= 64 THEN abs(w2 / h2 - r) END AS e2, w * h > m * m AS large FROM z4),
z6 AS (SELECT *, CASE WHEN NOT large THEN w WHEN e1 IS NOT NULL AND (e2 IS NULL OR e1 < e2) THEN w1 ELSE floor(h2 * r + 0.5) END AS nw, CASE WHEN NOT large THEN h WHEN e1 IS NOT NULL AND (e2 IS NULL OR e1 < e2) THEN floor(w1 / r + 0.5) ELSE h2 END AS nh FROM z5),
z7 AS (SELECT asset_id, least(w, h) >= 64 AND (NOT large OR e1 IS NOT NULL OR e2 IS NOT NULL) AND least(nw - nw % 64, nh - nh % 64) >= 64 AS good, nw - nw % 64 AS bw, nh - nh % 64 AS bh FROM z6),
buckets AS (SELECT asset_id, CASE WHEN good THEN CAST(bw AS BIGINT) END AS bucket_w, CASE WHEN good THEN CAST(bh AS BIGINT) END AS bucket_h FROM z7)"""


def _plan_rows(spark, sf):
    key = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(
        key.alias("run_id"),
        ((key * 37) % 30).alias("gb"),
        ((key * 37) % 30 * 1024).alias("free_mb"),
        F.when(key % 4 == 0, 16).when(key % 4 == 1, 32).when(key % 4 == 2, 64).otherwise(128).alias("rank"),
        (key * 53 % 1200).alias("p10"),
        (key % 70 + 8).alias("images"),
        (F.pmod(key * 17, F.lit(100)) / 100).alias("diversity"),
    )


def plan_batch(spark, sf):
    rows = _plan_rows(spark, sf)
    rows = rows.withColumn("resolution", planning.auto_resolution(F.col("p10"), F.lit(900), F.col("free_mb"), F.col("rank")))
    rows = rows.withColumn("batch", planning.auto_batch(F.col("resolution"), F.col("free_mb"), F.col("rank")))
    return rows.select("run_id", "resolution", "batch", planning.vram_estimate(F.col("resolution"), F.col("batch"), F.col("rank"), F.col("run_id") % 2 == 0).cast("long").alias("vram_mb"))


def plan_steps(spark, sf):
    rows = _plan_rows(spark, sf).withColumn("target", planning.target_steps(1000, 2200, F.col("images"), 20, F.col("diversity"), False))
    repeats, epochs = planning.repeats_and_epochs(F.col("images"), F.col("target"), F.lit(4), 8)
    rows = rows.withColumn("repeats", repeats).withColumn("epochs", epochs)
    return rows.select("run_id", "target", "repeats", "epochs", F.ceil(F.col("images") * F.col("repeats") * F.col("epochs") / 4).alias("steps"))


def vram_ladder(spark, sf):
    rows = _plan_rows(spark, sf).withColumn("ladder", planning.batch_ladder((F.col("run_id") % 32 + 1).cast("int")))
    fit = planning.largest_fitting(F.col("ladder"), F.lit(896), F.lit(32), F.col("free_mb"))
    return rows.select("run_id", F.array_join(F.col("ladder").cast("array<string>"), ",").alias("ladder"), fit.alias("batch"))


_PLAN = """p0 AS (SELECT s_suppkey AS run_id, (s_suppkey * 37) % 30 * 1024 AS free_mb, CASE s_suppkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 32 WHEN 2 THEN 64 ELSE 128 END AS rank, s_suppkey * 53 % 1200 AS p10, s_suppkey % 70 + 8 AS images, (s_suppkey * 17) % 100 / CAST(100 AS DOUBLE) AS diversity FROM supplier),
p1 AS (SELECT *, CASE WHEN p10 = 0 THEN 900 ELSE p10 END AS side, CASE WHEN free_mb < 10240 THEN 768 WHEN free_mb < 16384 THEN 896 ELSE 1024 END AS mem FROM p0),
p2 AS (SELECT *, least(CASE WHEN side >= 960 THEN 1024 WHEN side >= 832 THEN 896 ELSE 768 END, CASE WHEN rank >= 64 AND mem > 768 THEN 896 ELSE mem END) AS resolution FROM p1),
p3 AS (SELECT *, greatest(1, CASE WHEN resolution = 1024 THEN CASE WHEN free_mb >= 20480 THEN 2 ELSE 1 END WHEN resolution = 896 THEN CASE WHEN free_mb >= 24576 THEN 4 WHEN free_mb >= 14336 THEN 2 ELSE 1 END ELSE CASE WHEN free_mb >= 20480 THEN 4 WHEN free_mb >= 10240 THEN 2 ELSE 1 END END // CASE WHEN rank <= 32 THEN 1 ELSE 2 END) AS batch FROM p2),
s1 AS (SELECT *, 1000 + CAST(round_even(1200 * least(1, images / CAST(40 AS DOUBLE)) * (0.75 + 0.25 * diversity), 0) AS BIGINT) AS target FROM p0),
s2 AS (SELECT *, greatest(1, least(100, ceil(target * 4 / CAST(images * 8 AS DOUBLE)))) AS repeats FROM s1),
s3 AS (SELECT *, greatest(8, least(100, ceil(target * 4 / CAST(images * repeats AS DOUBLE)))) AS epochs FROM s2)"""


def recovery_ladder(spark, sf):
    key, none = F.col("o_orderkey"), F.array().cast("array<string>")
    rows = read(spark, sf, "orders").select(
        key.alias("run_id"),
        planning.classify_failure(F.element_at(F.array(*map(F.lit, ["CUDA out of memory", "loss is NaN", "disk full", "missing caption", "done"])), (key % 5 + 1).cast("int")), (key % 2).cast("int")).alias("failure"),
        (key % 4).cast("int").alias("attempt"),
        F.when(key % 7 == 0, "gpu-b").alias("other_gpu"),
        F.when(key % 14 == 0, F.array(F.lit("gpu_fallback"))).otherwise(none).alias("previous"),
        F.when(key % 11 == 0, F.array(F.lit("batch_size"), F.lit("optimizer"))).when(key % 13 == 0, F.array(F.lit("unet_lr"))).otherwise(none).alias("locked"),
        (key % 3 + 1).cast("int").alias("batch_size"),
        F.lit(2).alias("gradient_accumulation"),
        (key % 17 < 9).alias("gradient_checkpointing"),
        F.when(key % 19 < 9, "AdamW").otherwise("Prodigy").alias("optimizer"),
        F.when(key % 23 < 8, 8).otherwise(32).alias("network_dim"),
        F.lit(16).alias("network_alpha"),
        F.when(key % 29 < 14, 768).otherwise(1024).alias("resolution"),
        (key % 31 < 15).alias("no_half_vae"),
    )
    return planning.recovery(rows).select("run_id", "failure", "change")


_RECOVERY = """r AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'cuda_oom' WHEN 1 THEN 'nan_loss' WHEN 2 THEN 'disk_full' WHEN 3 THEN 'missing_caption' ELSE CASE WHEN o_orderkey % 2 <> 0 THEN 'process_crash' ELSE 'unknown' END END AS failure FROM orders)
SELECT k AS run_id, failure, CASE WHEN k % 4 >= 3 THEN NULL WHEN failure = 'cuda_oom' THEN
  CASE WHEN k % 7 = 0 AND k % 14 <> 0 THEN 'gpu_fallback' WHEN k % 11 <> 0 AND k % 3 + 1 > 1 THEN 'batch_size' WHEN NOT k % 17 < 9 THEN 'gradient_checkpointing' WHEN k % 11 <> 0 AND NOT k % 19 < 9 THEN 'optimizer' WHEN NOT k % 23 < 8 THEN 'network_dim' WHEN NOT k % 29 < 14 THEN 'resolution' END
  WHEN failure = 'nan_loss' THEN CASE WHEN NOT k % 31 < 15 THEN 'no_half_vae' WHEN k % 13 <> 0 OR k % 11 = 0 THEN 'learning_rate' END END AS change FROM r"""


def _devices(spark, sf):
    key = F.col("n_nationkey")
    return read(spark, sf, "nation").select(F.concat(F.lit("gpu-"), key.cast("string")).alias("uuid"), key.alias("device_index"), ((key * 7 % 24) * 1024).alias("free_mb"), (key * 13 % 100).alias("busy"), (key % 5 != 0).alias("compatible"))


_DEVICES = "devices AS (SELECT 'gpu-' || n_nationkey AS uuid, n_nationkey AS device_index, n_nationkey * 7 % 24 * 1024 AS free_mb, n_nationkey * 13 % 100 AS busy, n_nationkey % 5 <> 0 AS compatible FROM nation)"


def shard_round_robin(spark, sf):
    items = read(spark, sf, "customer").select("c_custkey")
    return planning.round_robin(items, _devices(spark, sf), "c_custkey").select("c_custkey", "device")


def gpu_assign(spark, sf):
    key = F.col("s_suppkey")
    tasks = read(spark, sf, "supplier").select(key.alias("task_id"), F.when(key % 2 == 0, "train").otherwise("tag").alias("kind"), (key % 26 * 1024).alias("need_mb"), F.when(key % 3 == 0, F.concat(F.lit("gpu-"), (key % 25).cast("string"))).alias("preferred"))
    leases = _devices(spark, sf).where("device_index % 4 = 1")
    return planning.assign_devices(tasks, _devices(spark, sf), leases)


def _grid(spark, sf):
    checkpoints = read(spark, sf, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("checkpoint"), F.col("s_suppkey").alias("c"))
    prompts = read(spark, sf, "part").where("p_partkey < 8").select(F.col("p_partkey").alias("prompt"), F.col("p_partkey").alias("p"))
    return checkpoints, prompts


def _pass(number):
    # Checkpoints (all, or the last ones), weights, seeds and prompts of each pass.
    last, weights, seeds, low, high = {1: (None, [0.8], [101], 0, 2), 2: (3, [0.6, 0.8, 1.0], [202], 2, 5), 3: (2, [0.7, 0.9], [303, 404], 5, 8)}[number]

    def query(spark, sf):
        checkpoints, prompts = _grid(spark, sf)
        if last:
            checkpoints = checkpoints.orderBy(F.desc("c")).limit(last)
        rows = planning.sampling_matrix(checkpoints, prompts.where((F.col("p") >= low) & (F.col("p") < high)), weights, seeds, 96)
        return rows.select("checkpoint", "weight", "seed", "prompt", F.col("ordinal").cast("long").alias("ordinal"))

    chosen = "SELECT s_suppkey AS c FROM supplier WHERE s_suppkey < 10" + (f" ORDER BY c DESC LIMIT {last}" if last else "")
    values = lambda items, kind: ", ".join(f"({i}, CAST({x} AS {kind}))" for i, x in enumerate(items))
    sql = f"WITH c AS ({chosen}), w(i, weight) AS (VALUES {values(weights, 'DOUBLE')}), s(j, seed) AS (VALUES {values(seeds, 'INTEGER')}), p AS (SELECT p_partkey AS p FROM part WHERE p_partkey >= {low} AND p_partkey < {high}) SELECT c AS checkpoint, weight, seed, p AS prompt, row_number() OVER (ORDER BY c, i, j, p) AS ordinal FROM c, w, s, p ORDER BY ordinal LIMIT 96"
    return query, sql


def _samples(spark, sf):
    rows = read(spark, sf, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("checkpoint"),
        F.round(F.col("l_discount") * 10, 0).alias("weight"),
        (F.col("l_linestatus") == "O").alias("success"),
        (F.col("l_quantity") / 50).alias("mean"),
        (F.col("l_tax") * 2).alias("spread"),
        ((F.col("l_partkey") % 11) / 10).alias("compliance"),
    )


_SAMPLES = """samples AS (SELECT l_suppkey AS checkpoint, round(l_discount * 10, 0) AS weight, l_linestatus = 'O' AS success, l_quantity / 50 AS mean, l_tax * 2 AS spread, (l_partkey % 11) / CAST(10 AS DOUBLE) AS compliance FROM lineitem),
judged AS (SELECT *, success AND NOT (spread < 0.003 OR mean < 0.003 OR mean > 0.997) AS ok, least(1, greatest(0, spread / 0.18)) * (1 - least(1, abs(mean - 0.5))) AS health FROM samples),
signals AS (SELECT checkpoint, count(*) AS n, count(*) FILTER (ok) AS usable, coalesce(avg(health) FILTER (ok), 0) AS visual_heuristic, coalesce(avg(compliance) FILTER (ok), 0) AS prompt_compliance FROM judged GROUP BY checkpoint),
metrics AS (SELECT *, 1 - usable / CAST(n AS DOUBLE) AS failure_rate, usable / CAST(n AS DOUBLE) AS technical FROM signals),
cands AS (SELECT *, checkpoint % 17 = 0 AS corrupted, (checkpoint % 100) / CAST(100 AS DOUBLE) AS overfit_risk,
  0.35 * ((checkpoint * 7 % 100) / CAST(100 AS DOUBLE)) + 0.2 * prompt_compliance + 0.15 * 0.4 + 0.1 * 0.6 + 0.1 * 0.5 + 0.05 * technical + 0.05 * visual_heuristic AS total FROM metrics),
scored AS (SELECT *, NOT corrupted AND failure_rate <= 0.75 AS gate_passed, round(CASE WHEN NOT corrupted AND failure_rate <= 0.75 THEN least(1, greatest(0, total - overfit_risk * 0.2)) ELSE 0 END, 9) AS score FROM cands)"""


def candidate_signals(spark, sf):
    rows = evaluation.candidate_signals(_samples(spark, sf), "checkpoint")
    return rows.select("checkpoint", "n", "usable", *(F.round(c, 6).alias(c) for c in ("visual_heuristic", "prompt_compliance", "failure_rate", "technical")))


def recommended_weight(spark, sf):
    rows = _samples(spark, sf)
    rows = rows.where(F.col("success") & ~evaluation.is_blank(F.col("mean"), F.col("spread"))).withColumn("health", evaluation.health(F.col("mean"), F.col("spread")))
    return evaluation.recommended_weight(rows, "checkpoint")


def _scored(spark, sf):
    rows = evaluation.candidate_signals(_samples(spark, sf), "checkpoint")
    key = F.col("checkpoint")
    rows = rows.withColumns({"identity": (key * 7 % 100) / 100, "flexibility": F.lit(0.4), "consistency": F.lit(0.6), "validation": evaluation.validation_score(F.lit(None).cast("double")), "corrupted": key % 17 == 0, "overfit_risk": (key % 100) / 100})
    # Half of the test samples fail, so the gate is set wider here.
    rows = rows.withColumn("failure_rate", F.col("failure_rate") - 0.5)
    return evaluation.score(rows).withColumn("failure_rate", F.col("failure_rate") + 0.5).withColumn("score", F.round("score", 9))


def candidate_ranking(spark, sf):
    rows = evaluation.rank(_scored(spark, sf), "checkpoint")
    return rows.select("checkpoint", "gate_passed", F.round("score", 6).alias("score"), "rank", F.array_join("warnings", ",").alias("warnings"))


def selection_top4(spark, sf):
    return evaluation.select_best(_scored(spark, sf), "checkpoint").select("checkpoint", F.round("score", 6).alias("score"))


def minmax_normalize(spark, sf):
    rows = read(spark, sf, "supplier")
    place = evaluation.min_max(F.col("s_acctbal"), Window.partitionBy("s_nationkey"))
    return rows.select("s_suppkey", F.round(place, 6).alias("place"))


def prompt_compliance(spark, sf):
    items = read(spark, sf, "benchmark").select("item_id", F.expr("replace(text, ' ', ', ')").alias("prompt"))
    tags = F.array(*map(F.lit, ["the", "of_the", "tion", "est", "er x"]))
    return items.select("item_id", F.round(evaluation.compliance(F.col("prompt"), tags, "That and"), 6).alias("compliance"))


def vector_consistency(spark, sf):
    """Mean cosine of all pairs of vectors of a label."""
    rows = evaluation.mean_pairwise(_vectors(spark, sf), ["label"], "embedding")
    return rows.select("label", "n", F.round("pairwise", 6).alias("pairwise"))


def holdout_batches(spark, sf):
    """Packed batches of the validation half of a split."""
    rows = holdout_hash_split(spark, sf).where("split = 'validation'").select("doc_id")
    return captions.pack_items(rows, "doc_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


_HASHED_SPLIT = "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42' || chr(0) || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) <= (SELECT least(50, greatest(2, floor(count(*) * 0.1 + 0.5))) FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents"
_PASSES = {n: _pass(n) for n in (1, 2, 3)}
def _planned_runs(spark, sf):
    key = F.col("p_partkey")
    some = lambda divisor, value, kind: F.when(key % divisor == 0, value).otherwise(F.lit(None)).cast(kind)
    gpu = lambda uuid, index, ok, free, total, bf16: F.struct(F.lit(uuid).alias("uuid"), F.lit(index).alias("index"), ok.alias("compatible"), free.cast("int").alias("free_mb"), F.lit(total).alias("total_mb"), bf16.alias("bf16"))
    return read(spark, sf, "part").select(
        key.alias("run_id"),
        (key % 90 + 5).cast("int").alias("accepted"),
        F.when(key % 6 == 0, key % 11).otherwise(0).cast("int").alias("validation_count"),
        (key % 100 / 100).alias("diversity"),
        (key * 53 % 1200).cast("int").alias("short_p10"),
        F.lit(900).alias("short_median"),
        F.array(gpu("a", 0, key % 13 != 0, key * 37 % 30 * 1024, 24576, key % 3 != 0), gpu("b", 1, key % 2 == 0, key * 11 % 24 * 1024, 24576, F.lit(True))).alias("gpus"),
        F.when(key % 17 == 0, F.array(F.lit("a"), F.lit("c"))).when(key % 5 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("selected"),
        F.when(key % 4 == 0, F.array(F.lit("network_dim"), F.lit("repeats"))).otherwise(F.array().cast("array<string>")).alias("locked"),
        F.when(key % 19 == 0, F.array(F.lit("Prodigy"))).when(key % 2 == 0, F.array(F.lit("AdamW"), F.lit("AdamW8bit"))).otherwise(F.array(F.lit("AdamW"))).alias("optimizers"),
        (key % 3 == 0).alias("has_class_token"),
        some(7, F.lit("a"), "string").alias("probe_gpu"),
        some(7, F.lit(2), "int").alias("probe_batch"),
        some(7, F.lit("p1"), "string").alias("probe_version"),
        some(4, F.lit(64), "int").alias("want_network_dim"),
        some(22, F.lit(40), "int").alias("want_network_alpha"),
        some(9, F.lit(896), "int").alias("want_resolution"),
        some(10, F.lit(2), "int").alias("want_batch_size"),
        some(8, F.lit(3), "int").alias("want_repeats"),
        some(12, F.lit(9), "int").alias("want_epochs"),
        some(23, F.lit("Lion"), "string").alias("want_optimizer"),
        some(29, F.lit("bf16"), "string").alias("want_precision"),
        some(31, F.lit(0.0005), "double").alias("want_unet_lr"),
    )


def training_plans(spark, sf):
    rows = trainplan.training_plan(_planned_runs(spark, sf), "run_id", trainplan.CHARACTER)
    plan = F.col("plan")
    shown = ("resolution", "batch_size", "gradient_accumulation", "repeats", "epochs", "estimated_steps", "network_dim", "network_alpha", "optimizer", "precision", "no_half_vae", "keep_tokens", "validation_images", "gpu", "estimated_disk_mb")
    sources = ("network_dim", "batch_size", "repeats", "optimizer", "unet_lr")
    return rows.select("run_id", *(plan[n].alias(n) for n in shown), F.round(plan["unet_lr"], 8).alias("unet_lr"), F.concat_ws(",", *(F.col("provenance")[n] for n in sources)).alias("sources"), "error")


_TRAINING_PLANS = """r AS (SELECT p_partkey AS k, CAST(p_partkey % 90 + 5 AS INTEGER) AS accepted, CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 11 ELSE 0 END AS vc, p_partkey % 100 / CAST(100 AS DOUBLE) AS diversity, p_partkey * 53 % 1200 AS p10,
  p_partkey % 13 <> 0 AND p_partkey % 5 <> 0 AS ok_a, p_partkey * 37 % 30 * 1024 AS free_a, p_partkey % 2 = 0 AND p_partkey % 17 <> 0 AS ok_b, p_partkey * 11 % 24 * 1024 AS free_b FROM part),
r1 AS (SELECT *, CASE WHEN k % 17 = 0 THEN (CASE WHEN k % 13 <> 0 THEN 'a' END) WHEN ok_a AND (NOT ok_b OR free_a >= free_b) THEN 'a' WHEN ok_b THEN 'b' END AS gpu FROM r),
r2 AS (SELECT *, CASE gpu WHEN 'a' THEN free_a WHEN 'b' THEN free_b END AS free, CASE gpu WHEN 'a' THEN k % 3 <> 0 WHEN 'b' THEN true END AS bf16, CASE WHEN k % 4 = 0 THEN 64 ELSE 32 END AS rank, CASE WHEN k % 22 = 0 THEN 40 ELSE 16 END AS alpha FROM r1),
r3 AS (SELECT *, CASE WHEN p10 = 0 THEN 900 ELSE p10 END AS side, CASE WHEN free < 10240 THEN 768 WHEN free < 16384 THEN 896 ELSE 1024 END AS mem FROM r2),
r4 AS (SELECT *, CASE WHEN k % 9 = 0 THEN 896 ELSE least(CASE WHEN side >= 960 THEN 1024 WHEN side >= 832 THEN 896 ELSE 768 END, CASE WHEN rank >= 64 AND mem > 768 THEN 896 ELSE mem END) END AS resolution FROM r3),
r5 AS (SELECT *, CASE WHEN k % 10 = 0 THEN 2 WHEN k % 7 = 0 THEN 2 ELSE greatest(1, CASE WHEN resolution = 1024 THEN CASE WHEN free >= 20480 THEN 2 ELSE 1 END WHEN resolution = 896 THEN CASE WHEN free >= 24576 THEN 4 WHEN free >= 14336 THEN 2 ELSE 1 END ELSE CASE WHEN free >= 20480 THEN 4 WHEN free >= 10240 THEN 2 ELSE 1 END END // CASE WHEN rank <= 32 THEN 1 ELSE 2 END) END AS batch FROM r4),
r6 AS (SELECT *, greatest(1, CAST(ceil(4 / CAST(batch AS DOUBLE)) AS INTEGER)) AS acc, CASE WHEN accepted < 24 THEN 0 ELSE least(8, greatest(2, CAST(round_even(accepted * CAST(0.1 AS DOUBLE), 0) AS INTEGER))) END AS planned FROM r5),
r7 AS (SELECT *, CASE WHEN vc > 0 THEN vc ELSE planned END AS held, 1000 + CAST(round_even(1200 * least(1, accepted / CAST(40 AS DOUBLE)) * (0.75 + 0.25 * diversity), 0) AS BIGINT) AS target FROM r6),
r8 AS (SELECT *, greatest(accepted - held, 1) AS images, CAST(target * batch * acc AS DOUBLE) AS work FROM r7),
r9 AS (SELECT *, CASE WHEN k % 8 = 0 THEN 3 ELSE greatest(1, least(100, ceil(work / (images * CASE WHEN k % 12 = 0 THEN 9 ELSE 8 END)))) END AS repeats FROM r8),
r10 AS (SELECT *, CASE WHEN k % 12 = 0 THEN 9 ELSE greatest(8, least(100, ceil(work / (images * repeats)))) END AS epochs, CASE WHEN k % 23 = 0 THEN 'Lion' WHEN k % 19 = 0 THEN NULL WHEN k % 2 = 0 THEN 'AdamW8bit' ELSE 'AdamW' END AS optimizer,
  CASE WHEN k % 29 = 0 OR bf16 THEN 'bf16' ELSE 'fp16' END AS precision FROM r9),
e AS (SELECT *, CASE WHEN accepted < 8 THEN 'fewer than 8 accepted images' WHEN k % 17 = 0 THEN 'a selected device is missing: c' WHEN gpu IS NULL THEN 'no selected device can run' WHEN alpha > rank THEN 'network_alpha over network_dim'
  WHEN k % 10 <> 0 AND k % 7 = 0 AND gpu <> 'a' THEN 'the batch size was tried on another device' WHEN vc > 0 AND planned = 0 THEN 'validation images below the threshold' WHEN vc > 0 AND vc NOT BETWEEN 2 AND 8 THEN 'validation images out of limits'
  WHEN held >= accepted THEN 'no training images are left' WHEN k % 23 = 0 THEN 'the optimizer isn''t there' WHEN optimizer IS NULL THEN 'no optimizer is there' WHEN precision = 'bf16' AND NOT bf16 THEN 'the device has no bf16' END AS error FROM r10)
SELECT k AS run_id, CASE WHEN error IS NULL THEN CAST(resolution AS INTEGER) END AS resolution, CASE WHEN error IS NULL THEN CAST(batch AS INTEGER) END AS batch_size, CASE WHEN error IS NULL THEN acc END AS gradient_accumulation, CASE WHEN error IS NULL THEN CAST(repeats AS INTEGER) END AS repeats,
  CASE WHEN error IS NULL THEN CAST(epochs AS INTEGER) END AS epochs, CASE WHEN error IS NULL THEN CAST(ceil(images * repeats * epochs / (batch * acc)) AS BIGINT) END AS estimated_steps, CASE WHEN error IS NULL THEN rank END AS network_dim, CASE WHEN error IS NULL THEN alpha END AS network_alpha,
  CASE WHEN error IS NULL THEN optimizer END AS optimizer, CASE WHEN error IS NULL THEN precision END AS precision, CASE WHEN error IS NULL THEN precision = 'fp16' END AS no_half_vae, CASE WHEN error IS NULL THEN CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END END AS keep_tokens,
  CASE WHEN error IS NULL THEN CAST(held AS INTEGER) END AS validation_images, CASE WHEN error IS NULL THEN gpu END AS gpu, CASE WHEN error IS NULL THEN CAST(greatest(256, 8 * rank * 12 + accepted * resolution * resolution // 1000000) AS BIGINT) END AS estimated_disk_mb,
  CASE WHEN error IS NULL THEN CASE WHEN k % 31 = 0 THEN 0.0005 ELSE 0.0001 END::DOUBLE END AS unet_lr,
  CASE WHEN error IS NULL THEN concat_ws(',', CASE WHEN k % 4 = 0 THEN 'user_lock' ELSE 'preset' END, CASE WHEN k % 10 = 0 THEN 'user_override' WHEN k % 7 = 0 THEN 'batch_probe:p1' ELSE 'gpu_plan_pending_probe' END,
    CASE WHEN k % 8 = 0 THEN 'user_lock' ELSE 'dataset_step_plan' END, 'runtime_capability', CASE WHEN k % 31 = 0 THEN 'user_override' ELSE 'preset' END) ELSE '' END AS sources, error FROM e"""


def recovery_plans(spark, sf):
    """Up to nine failures of each run, tried to the end of the ladder."""
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    gpu = lambda uuid, free: F.struct(F.lit(uuid).alias("uuid"), F.lit(True).alias("compatible"), free.cast("int").alias("free_mb"), F.lit(24000).alias("total_mb"))
    plan = {
        "resolution": F.when(key % 3 == 0, 1024).otherwise(896), "batch_size": key % 5 + 1, "gradient_accumulation": F.lit(2), "network_dim": F.when(key % 4 == 0, 8).otherwise(64), "network_alpha": F.lit(40), "unet_lr": F.lit(0.0001), "text_encoder_lr": F.lit(0.00001),
        "optimizer": F.when(key % 2 == 0, "AdamW").otherwise("AdamW8bit"), "no_half_vae": key % 7 == 0, "gradient_checkpointing": key % 3 != 0, "gpu": F.lit("a"),
    }
    failures = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.when((key + i) % 6 == 0, "nan_loss").when((key % 50 == 0) & (i == 3), "disk_full").otherwise("cuda_oom"))
    runs = read(spark, sf, "part").select(
        key.alias("run_id"), F.struct(*(v.alias(n) for n, v in plan.items())).alias("plan"), failures.alias("failures"), F.array(gpu("a", F.lit(24000)), gpu("b", F.when(key % 8 == 0, 23000).otherwise(9000))).alias("gpus"),
        F.when(key % 11 == 0, F.array(F.lit("batch_size"))).when(key % 13 == 0, F.array(F.lit("unet_lr"), F.lit("network_alpha"))).otherwise(none).alias("locked"),
    )
    found = trainplan.recoveries(runs, "run_id", most=9)
    return found.select("run_id", "attempt", "failure", "change", "quality_impact", *(F.col("plan")[n].alias(n) for n in ("resolution", "batch_size", "gradient_accumulation", "network_dim", "network_alpha", "optimizer", "no_half_vae", "gradient_checkpointing", "gpu")), F.round(F.col("plan.unet_lr") * 1e9).alias("unet_lr"))


_RECOVERIES = """s AS (SELECT p_partkey AS k, 0 AS attempt, NULL::VARCHAR AS failure, 'start'::VARCHAR AS change, CASE WHEN p_partkey % 3 = 0 THEN 1024 ELSE 896 END AS res, CAST(p_partkey % 5 + 1 AS INTEGER) AS batch, 2 AS acc, CASE WHEN p_partkey % 4 = 0 THEN 8 ELSE 64 END AS dim, 40 AS alpha, 0.0001::DOUBLE AS lr,
  CASE WHEN p_partkey % 2 = 0 THEN 'AdamW' ELSE 'AdamW8bit' END AS opt, p_partkey % 7 = 0 AS vae, p_partkey % 3 <> 0 AS ckpt, 'a' AS gpu, false AS moved FROM part
UNION ALL SELECT k, attempt, failure, change, CASE WHEN change = 'resolution' THEN CASE WHEN res = 1024 THEN 896 ELSE 768 END ELSE res END, CASE WHEN change = 'batch_size' THEN greatest(1, batch // 2) ELSE batch END, CASE WHEN change = 'batch_size' THEN acc * 2 ELSE acc END,
  CASE WHEN change = 'network_dim' THEN greatest(8, dim // 2) ELSE dim END, CASE WHEN change = 'network_dim' THEN least(alpha, greatest(8, dim // 2)) ELSE alpha END, CASE WHEN change = 'learning_rate' THEN lr * 0.5 ELSE lr END, CASE WHEN change = 'optimizer' THEN 'AdamW' ELSE opt END,
  vae OR coalesce(change = 'no_half_vae', false), ckpt OR coalesce(change = 'gradient_checkpointing', false), CASE WHEN change = 'gpu_fallback' THEN 'b' ELSE gpu END, moved OR coalesce(change = 'gpu_fallback', false)
FROM (SELECT *, CASE WHEN attempt >= 9 THEN NULL WHEN failure = 'cuda_oom' THEN CASE WHEN k % 8 = 0 AND gpu = 'a' AND NOT moved THEN 'gpu_fallback' WHEN k % 11 <> 0 AND batch > 1 AND acc <= 32 THEN 'batch_size' WHEN NOT ckpt THEN 'gradient_checkpointing' WHEN opt <> 'AdamW' THEN 'optimizer'
    WHEN dim > 8 AND (NOT (k % 13 = 0 AND k % 11 <> 0) OR alpha <= greatest(8, dim // 2)) THEN 'network_dim' WHEN res > 768 THEN 'resolution' END
  WHEN failure = 'nan_loss' THEN CASE WHEN NOT vae THEN 'no_half_vae' WHEN NOT (k % 13 = 0 AND k % 11 <> 0) THEN 'learning_rate' END END AS change
  FROM (SELECT k, attempt + 1 AS attempt, CASE WHEN (k + attempt + 1) % 6 = 0 THEN 'nan_loss' WHEN k % 50 = 0 AND attempt + 1 = 3 THEN 'disk_full' ELSE 'cuda_oom' END AS failure, res, batch, acc, dim, alpha, lr, opt, vae, ckpt, gpu, moved FROM s WHERE change IS NOT NULL AND attempt < 9)))"""


QUERIES = {
    "embedding_centroid_similarity": (embedding_centroid_similarity, f"WITH {_SIM} SELECT vec_id, round(s, 6) AS similarity FROM sims"),
    "embedding_outlier_threshold": (embedding_outlier_threshold, f"WITH {_SIM} SELECT round(med, 6) AS median, round(mad, 6) AS mad, round(least(0.75, greatest(0, med - greatest(0.1, 3.5 * mad))), 6) AS threshold FROM mads"),
    "embedding_outliers": (embedding_outliers, f"WITH {_SIM}, t AS (SELECT least(0.75, greatest(0, med - greatest(0, 0.9 * mad))) AS t FROM mads) SELECT vec_id, round(s, 6) AS similarity, round(t, 6) AS threshold FROM sims, t WHERE s < t"),
    "embedding_near_pairs": (embedding_near_pairs, f"WITH {_UNIT}, {_COS} SELECT a, b, round(c, 5) AS cosine FROM pairs"),
    "embedding_clusters": (embedding_clusters, f"WITH RECURSIVE {_UNIT}, {_COS}, {_REACH.format(e='a AS node, b AS other FROM pairs UNION SELECT b, a FROM pairs')} SELECT node AS vec_id, least(node, min(other)) AS cluster FROM reach GROUP BY node"),
    "embedding_label_nearest": (embedding_label_nearest, f"WITH {_UNIT}, n AS (SELECT x.vec_id, y.vec_id AS other, list_inner_product(x.v, y.v) AS c FROM u x JOIN u y ON x.vec_id <> y.vec_id) SELECT vec_id, arg_max(other, (c, -other)) AS other, round(max(c), 5) AS cosine FROM n GROUP BY vec_id"),
    "cluster_merge": (cluster_merge, f"WITH RECURSIVE {_UNIT}, {_COS}, f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents), e AS (SELECT f AS a, doc_id AS b FROM f WHERE f <> doc_id UNION SELECT a, b FROM pairs), {_REACH.format(e='a AS node, b AS other FROM e UNION SELECT b, a FROM e')} SELECT node AS member, least(node, min(other)) AS cluster FROM reach GROUP BY node"),
    "holdout_hash_split": (holdout_hash_split, _HASHED_SPLIT),
    "holdout_cluster_split": (holdout_cluster_split, "WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '-' || lang ELSE CAST(doc_id AS VARCHAR) END AS k FROM documents), g AS (SELECT k, count(*) AS n, row_number() OVER (ORDER BY sha256('42' || chr(0) || k), k) AS r FROM d GROUP BY k), t AS (SELECT r, k, n AS total, true AS held FROM g WHERE r = 1 UNION ALL SELECT g.r, g.k, CASE WHEN total < 40 AND abs(40 - total - n) <= 40 - total THEN total + n ELSE total END, total < 40 AND abs(40 - total - n) <= 40 - total FROM t JOIN g ON g.r = t.r + 1) SELECT doc_id, CASE WHEN held THEN 'validation' ELSE 'train' END AS split FROM d JOIN t USING (k)"),
    "holdout_batches": (holdout_batches, f"WITH s AS ({_HASHED_SPLIT}), b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM s WHERE split = 'validation') SELECT batch, count(*) AS n, min(doc_id) AS \"first\" FROM b GROUP BY batch"),
    "holdout_sizes": (holdout_sizes, "SELECT p_partkey AS n, CAST(CASE WHEN p_partkey < 24 THEN 0 ELSE least(50, greatest(2, floor(p_partkey * CAST(0.1 AS DOUBLE) + 0.5))) END AS BIGINT) AS half_up, CAST(CASE WHEN p_partkey < 24 THEN 0 ELSE least(50, greatest(2, round_even(p_partkey * CAST(0.1 AS DOUBLE), 0))) END AS BIGINT) AS half_even FROM part"),
    "bucket_assignment": (bucket_assignment, f"WITH {_BUCKETS} SELECT * FROM buckets"),
    "bucket_histogram": (bucket_histogram, f"WITH {_BUCKETS} SELECT bucket_w, bucket_h, count(*) AS n FROM buckets GROUP BY ALL"),
    "plan_batch": (plan_batch, f"WITH {_PLAN} SELECT run_id, CAST(resolution AS INTEGER) AS resolution, CAST(batch AS INTEGER) AS batch, CAST(CASE resolution WHEN 768 THEN 6144 WHEN 896 THEN 8192 ELSE 10240 END + (batch - 1) * 1536 + greatest(rank - 32, 0) * 8 + CASE WHEN run_id % 2 = 0 THEN 2048 ELSE 0 END AS BIGINT) AS vram_mb FROM p3"),
    "plan_steps": (plan_steps, f"WITH {_PLAN} SELECT run_id, target, CAST(repeats AS BIGINT) AS repeats, CAST(epochs AS BIGINT) AS epochs, CAST(ceil(images * repeats * epochs / 4) AS BIGINT) AS steps FROM s3"),
    "vram_ladder": (vram_ladder, "WITH l AS (SELECT s_suppkey AS run_id, (s_suppkey * 37) % 30 * 1024 AS free_mb, list_filter([(s_suppkey % 32 + 1) // d FOR d IN [1, 2, 4, 8, 16, 32]], lambda x: x >= 1) AS ladder FROM supplier) SELECT run_id, array_to_string(ladder, ',') AS ladder, CAST(list_max(list_filter(ladder, lambda b: 8192 + (b - 1) * 1536 <= free_mb)) AS INTEGER) AS batch FROM l"),
    "training_plans": (training_plans, f"WITH {_TRAINING_PLANS}"),
    "recovery_plans": (recovery_plans, f"WITH RECURSIVE {_RECOVERIES} SELECT k AS run_id, CAST(attempt AS INTEGER) AS attempt, failure, change, coalesce(change IN ('network_dim', 'resolution', 'learning_rate'), false) AS quality_impact, CAST(res AS INTEGER) AS resolution, CAST(batch AS INTEGER) AS batch_size, CAST(acc AS INTEGER) AS gradient_accumulation, CAST(dim AS INTEGER) AS network_dim, CAST(alpha AS INTEGER) AS network_alpha, opt AS optimizer, vae AS no_half_vae, ckpt AS gradient_checkpointing, gpu, round(lr * 1e9) AS unet_lr FROM s WHERE attempt > 0"),
    "recovery_ladder": (recovery_ladder, f"WITH {_RECOVERY}"),
    "shard_round_robin": (shard_round_robin, f"WITH {_DEVICES}, d AS (SELECT uuid, row_number() OVER (ORDER BY free_mb DESC, device_index) - 1 AS slot, count(*) OVER () AS n FROM devices WHERE compatible), i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) SELECT c_custkey, uuid AS device FROM i JOIN d ON place % n = slot"),
    "gpu_assign": (gpu_assign, f"WITH {_DEVICES}, f AS (SELECT * FROM devices WHERE compatible AND device_index % 4 <> 1), t AS (SELECT s_suppkey AS task_id, s_suppkey % 2 = 0 AS train, s_suppkey % 26 * 1024 AS need, CASE WHEN s_suppkey % 3 = 0 THEN 'gpu-' || (s_suppkey % 25) END AS preferred FROM supplier), r AS (SELECT task_id, uuid, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN uuid = preferred THEN 0 ELSE 1 END, CASE WHEN train THEN -free_mb ELSE busy END, CASE WHEN train THEN busy ELSE -free_mb END, device_index) AS k FROM t LEFT JOIN f ON free_mb >= need) SELECT task_id, uuid FROM r WHERE k = 1"),
    "sampling_matrix_pass1": _PASSES[1],
    "sampling_matrix_pass2": _PASSES[2],
    "sampling_matrix_pass3": _PASSES[3],
    "candidate_signals": (candidate_signals, f"WITH {_SAMPLES} SELECT checkpoint, n, usable, round(visual_heuristic, 6) AS visual_heuristic, round(prompt_compliance, 6) AS prompt_compliance, round(failure_rate, 6) AS failure_rate, round(technical, 6) AS technical FROM metrics"),
    "recommended_weight": (recommended_weight, f"WITH {_SAMPLES}, w AS (SELECT checkpoint, weight, round(avg(0.5 * health + 0.5 * compliance), 9) AS m FROM judged WHERE ok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY checkpoint ORDER BY m DESC, abs(weight - 0.8), weight) AS k FROM w) SELECT checkpoint, weight AS recommended_weight FROM r WHERE k = 1"),
    "candidate_ranking": (candidate_ranking, f"WITH {_SAMPLES} SELECT checkpoint, gate_passed, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY gate_passed DESC, score DESC, checkpoint) AS INTEGER) AS rank, concat_ws(',', CASE WHEN corrupted THEN 'corrupted' END, CASE WHEN failure_rate > 0.75 THEN 'failure_rate' END, CASE WHEN overfit_risk >= 0.7 THEN 'overfit' END) AS warnings FROM scored"),
    "selection_top4": (selection_top4, f"WITH {_SAMPLES} SELECT checkpoint, round(score, 6) AS score FROM scored WHERE gate_passed ORDER BY scored.score DESC, checkpoint LIMIT 4"),
    "minmax_normalize": (minmax_normalize, "SELECT s_suppkey, round(CASE WHEN max(s_acctbal) OVER w > min(s_acctbal) OVER w THEN (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) ELSE 0.5 END, 6) AS place FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"),
    "prompt_compliance": (prompt_compliance, "WITH p AS (SELECT item_id, unnest(string_split(replace(text, ' ', ', '), ',')) AS seg FROM benchmark), t AS (SELECT DISTINCT item_id, array_to_string(regexp_extract_all(lower(seg), '[a-z0-9]+'), '_') AS term FROM p), a AS (SELECT * FROM t WHERE term NOT IN ('high_quality', 'best_quality', 'masterpiece', 'that_and', '')), m AS (SELECT item_id, avg(CASE WHEN list_bool_or([contains(g, term) OR contains(term, g) FOR g IN ['the', 'of_the', 'tion', 'est', 'er_x']]) THEN 1.0 ELSE 0 END) AS c FROM a GROUP BY item_id) SELECT item_id, round(coalesce(CAST(c AS DOUBLE), 1), 6) AS compliance FROM benchmark LEFT JOIN m USING (item_id)"),
    "vector_consistency": (vector_consistency, f"WITH {_UNIT}, l AS (SELECT label, v, vec_id FROM u JOIN embeddings USING (vec_id)), n AS (SELECT label, count(*) AS n FROM l GROUP BY label), c AS (SELECT x.label, avg(list_inner_product(x.v, y.v)) AS m FROM l x JOIN l y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label) SELECT label, n, round(CASE WHEN n > 1 THEN least(1, greatest(0, m)) ELSE 1 END, 6) AS pairwise FROM n LEFT JOIN c USING (label)"),
}
