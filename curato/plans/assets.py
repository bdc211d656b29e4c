"""Queries over assets: ingest, duplicates, rules and review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.operators import duplicates, ingest, quality, review


def read(spark, sf: str, table: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf}/{table}.parquet")


def assets(spark, sf: str) -> DataFrame:
    """Documents as assets, with numbers in the place of image metrics."""
    docs = read(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("asset_id"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        F.col("n_chars").alias("area"),
        (F.col("doc_id") % 97).cast("double").alias("sharpness"),
        ((F.col("doc_id") % 7) / 2.0).alias("compression_blockiness"),
        ((F.col("doc_id") % 5) / 5.0).alias("alpha_fraction"),
        F.lit(1.0).alias("crop_completeness"),
        F.lit(0.0).alias("watermark_probability"),
        "lang",
        "source",
    )


ASSETS = """assets AS (SELECT doc_id AS asset_id, sha256(text) AS sha, n_chars AS area, CAST(doc_id % 97 AS DOUBLE) AS sharpness,
  (doc_id % 7) / CAST(2 AS DOUBLE) AS compression_blockiness, (doc_id % 5) / CAST(5 AS DOUBLE) AS alpha_fraction, lang, source FROM documents)"""


def dims(spark, sf: str) -> DataFrame:
    """Parts as image metrics."""
    p, key = read(spark, sf, "part"), F.col("p_partkey")
    rows = p.select(
        key.alias("asset_id"),
        (64 * F.col("p_size")).alias("width"),
        (64 * (1 + key % 40)).cast("int").alias("height"),
        (key % 256).cast("double").alias("luminance_mean"),
        ((key * 7 % 50) / 10).alias("luminance_stddev"),
        (key * 3 % 60).cast("double").alias("luminance_range"),
        (key * 11 % 90).cast("double").alias("sharpness"),
        ((key % 25) / 10).alias("compression_blockiness"),
        ((key % 60) / 1000).alias("alpha_fraction"),
    )
    return rows.withColumn("short_side", F.least("width", "height"))


DIMS = """d0 AS (SELECT p_partkey AS asset_id, 64 * p_size AS width, 64 * (1 + p_partkey % 40) AS height, CAST(p_partkey % 256 AS DOUBLE) AS m,
  (p_partkey * 7 % 50) / CAST(10 AS DOUBLE) AS s, CAST(p_partkey * 3 % 60 AS DOUBLE) AS r, CAST(p_partkey * 11 % 90 AS DOUBLE) AS sharp,
  (p_partkey % 25) / CAST(10 AS DOUBLE) AS blocky, (p_partkey % 60) / CAST(1000 AS DOUBLE) AS alpha FROM part),
d1 AS (SELECT *, least(width, height) AS short_side, greatest(width, height) / CAST(least(width, height) AS DOUBLE) AS ratio FROM d0),
codes AS (SELECT asset_id, short_side, list_filter([
  CASE WHEN greatest(width, height) > 32768 OR width * height > 100000000 THEN 'impossible_dimensions' END,
  CASE WHEN short_side < 64 THEN 'extremely_low_resolution' WHEN short_side < 512 THEN 'low_resolution' END,
  CASE WHEN ratio > 8 THEN 'extreme_aspect_ratio' WHEN ratio > 3 THEN 'aspect_ratio_outlier' END,
  CASE WHEN m <= 1 THEN 'all_black' WHEN m >= 254 THEN 'all_white' WHEN s < 2 OR r < 8 THEN 'near_empty' END,
  CASE WHEN sharp < 35 THEN 'blur' END, CASE WHEN blocky > 1.8 THEN 'compression_artifacts' END, CASE WHEN alpha >= 0.05 THEN 'significant_alpha' END], lambda x: x IS NOT NULL) AS codes FROM d1),
found AS (SELECT *, len(list_filter(codes, lambda c: c IN ('impossible_dimensions', 'extremely_low_resolution', 'extreme_aspect_ratio', 'all_black', 'all_white', 'near_empty'))) AS bad FROM codes),
rated AS (SELECT asset_id, short_side, codes, CASE WHEN bad > 0 THEN 'reject' WHEN len(codes) > 0 THEN 'warn' ELSE 'accept' END AS disposition FROM found)"""


def asset_exact_duplicates(spark, sf):
    return duplicates.exact_clusters(assets(spark, sf), "asset_id", "sha")


def asset_dedup_accepted(spark, sf):
    return duplicates.drop_exact(assets(spark, sf), "asset_id", "sha").select("asset_id", "sha")


def duplicate_representative(spark, sf):
    rows = assets(spark, sf)
    twice = rows.join(duplicates.exact_clusters(rows, "asset_id", "sha").select("sha", "cluster_id"), "sha")
    return duplicates.representative_scores(twice, "cluster_id").select("cluster_id", "asset_id", F.round("total", 6).alias("total"), "rank")


def _hashed(spark, sf):
    rows = assets(spark, sf)
    base = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    return rows.select("asset_id", base.bitwiseXOR(F.col("asset_id") % 8).alias("hash"))


def hamming_pairs(spark, sf):
    return duplicates.hamming_pairs(_hashed(spark, sf), "asset_id", "hash", 4, bits=60)


def hamming_clusters(spark, sf):
    return duplicates.cluster_pairs(hamming_pairs(spark, sf)).select(F.col("node").alias("asset_id"), F.col("label").alias("cluster"))


def duplicate_summary(spark, sf):
    # Clusters may hold every asset: they are joined by key.
    rows = assets(spark, sf).join(hamming_clusters(spark, sf).hint("merge"), "asset_id")
    return duplicates.cluster_summary(duplicates.representative_scores(rows, "cluster"), "cluster", "sha")


def manifest_sources(spark, sf):
    rows = ingest.manifest(assets(spark, sf), "sha", "source")
    return rows.select("sha", F.array_join("sources", ",").alias("sources"), "n_files")


def manifest_monotonic_diff(spark, sf):
    rows = assets(spark, sf)
    old = ingest.manifest(rows.where("asset_id % 3 != 0"), "sha", "source")
    return ingest.manifest_losses(old, ingest.manifest(rows.where("asset_id % 2 = 0"), "sha", "source"), "sha").select("sha", F.array_join("lost", ",").alias("lost"), "removed")


def manifest_merge(spark, sf):
    rows = assets(spark, sf)
    merged = ingest.merge_manifests(ingest.manifest(rows.where("asset_id % 3 != 0"), "sha", "source"), ingest.manifest(rows.where("asset_id % 2 = 0"), "sha", "source"), "sha")
    return merged.select("sha", F.array_join("sources", ",").alias("sources"))


def snapshot_diff(spark, sf):
    rows = assets(spark, sf)
    after = rows.where("asset_id % 3 != 0").withColumn("sha", F.when(F.col("asset_id") % 11 == 0, F.lit("x")).otherwise(F.col("sha")))
    return ingest.snapshot_diff(rows.where("asset_id % 2 = 0"), after, "asset_id", "sha")


def scan_limit_cut(spark, sf):
    rows = assets(spark, sf).select("asset_id", "area")
    return ingest.bounded_scan(rows, "asset_id", "area", 700, 2_000_000, 9_000).select("asset_id", "issue")


def quality_rules(spark, sf):
    return quality.reason_rows(quality.assess(dims(spark, sf)), "asset_id")


def quality_disposition_counts(spark, sf):
    return quality.report_counts(quality.assess(dims(spark, sf)))


def quality_reason_counts(spark, sf):
    return quality.reason_counts(quality.assess(dims(spark, sf)))


def quality_distribution(spark, sf):
    return quality.distribution(quality.assess(dims(spark, sf)), "short_side")


def dataset_statistics(spark, sf):
    """Tenth-percentile element, truncated median, and range of aspect ratios of accepted rows, by parts' last digit."""
    rows = quality.assess(dims(spark, sf)).where("accepted").withColumn("set", F.col("asset_id") % 10)
    nth = quality.nth_share(rows, "short_side", 0.1, ["set"])
    ratio = F.col("width") / F.col("height")
    others = rows.groupBy("set").agg(F.count("*").alias("accepted"), F.median("short_side").cast("long").alias("short_side_median"), F.round(F.min(ratio), 6).alias("least_ratio"), F.round(F.max(ratio), 6).alias("most_ratio"))
    return others.join(nth, "set").select("set", "accepted", F.col("nth").cast("long").alias("short_side_p10"), "short_side_median", "least_ratio", "most_ratio")


def _review(spark, sf):
    rows = assets(spark, sf)
    first = rows.groupBy("sha").agg(F.min("asset_id").alias("first"), F.count("*").alias("n"))
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("asset_id"), "quality", "toxic")
    rows = rows.join(first, "sha").join(labels, "asset_id", "left")
    rows = rows.withColumn("disposition", F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "warn").otherwise("accept"))
    rows = rows.withColumn("duplicate", (F.col("n") > 1) & (F.col("asset_id") != F.col("first"))).withColumn("validation", F.col("asset_id") % 10 == 0).withColumn("outlier", F.col("area") > 15000)
    overrides = labels.where("asset_id % 4 = 0").select("asset_id", (F.col("quality") == 0).alias("forced"))
    return review.apply_overrides(rows, overrides, "asset_id")


REVIEW = f"""{ASSETS},
firsts AS (SELECT sha, min(asset_id) AS first, count(*) AS n FROM assets GROUP BY sha),
joined AS (SELECT asset_id, lang, CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'warn' ELSE 'accept' END AS disposition,
  n > 1 AND asset_id <> first AS duplicate, asset_id % 10 = 0 AS validation, area > 15000 AS outlier,
  CASE WHEN quality IS NOT NULL AND asset_id % 4 = 0 THEN quality = 0 END AS forced
  FROM assets JOIN firsts USING (sha) LEFT JOIN labels ON labels.doc_id = assets.asset_id),
reviewed AS (SELECT *, coalesce(forced, disposition <> 'reject' AND NOT duplicate) AS included FROM joined),
adjusted AS (SELECT *, CASE WHEN included AND disposition = 'reject' THEN 'warn' WHEN NOT included AND disposition = 'accept' THEN 'reject' ELSE disposition END AS gate_disposition FROM reviewed),
labelled AS (SELECT *, list_filter([CASE WHEN included THEN 'Accepted' ELSE 'Rejected' END, CASE WHEN disposition = 'warn' OR outlier THEN 'Warning' END,
  CASE WHEN duplicate THEN 'Duplicate' END, CASE WHEN included AND validation THEN 'Validation' END], lambda c: c IS NOT NULL) AS cats FROM adjusted)"""


def override_adjustment(spark, sf):
    return _review(spark, sf).select("asset_id", "disposition", "included", "gate_disposition")


def review_categories(spark, sf):
    return review.categories(_review(spark, sf)).select("asset_id", F.array_join("categories", ",").alias("categories"))


def review_primary(spark, sf):
    return review.primary_category(review.categories(_review(spark, sf))).select("asset_id", "primary")


def review_facets(spark, sf):
    return review.facets(review.categories(_review(spark, sf)))


def dataset_gate(spark, sf):
    rows = _review(spark, sf)
    signals = rows.groupBy("lang").agg(F.count_if(F.col("gate_disposition") != "reject").alias("accepted"), (F.count_if("duplicate") / F.count("*")).alias("near_duplicate_dominance"), F.avg(F.col("validation").cast("double")).alias("content_diversity"), F.lit(0.8).alias("dominant_character_ratio"), F.lit(1.0).alias("style_consistency"))
    found = quality.gate(signals, quality.GateLimits(least=16, guidance=300, dominance=0.07, style=True))
    return found.select("lang", "accepted", F.array_join("issues.code", ",").alias("issues"), "passed")


_PRIMARY = "CASE " + " ".join(f"WHEN list_contains(cats, '{c}') THEN '{c}'" for c in review.PRIORITY) + " END"
_TOTAL = """least(1, greatest(0, 0.35 * CASE WHEN max(area) OVER c <= min(area) OVER c THEN 1 ELSE (ln(1 + area) - ln(1 + min(area) OVER c)) / (ln(1 + max(area) OVER c) - ln(1 + min(area) OVER c)) END
  + 0.25 * CASE WHEN max(sharpness) OVER c <= min(sharpness) OVER c THEN 1 ELSE (ln(1 + sharpness) - ln(1 + min(sharpness) OVER c)) / (ln(1 + max(sharpness) OVER c) - ln(1 + min(sharpness) OVER c)) END
  + 0.15 * greatest(0, least(1, 1 - compression_blockiness / 3)) + 0.1 * (1 - alpha_fraction) + 0.1 + 0.05))"""
_HASHED = "hashed AS (SELECT asset_id, xor(CAST('0x' || substr(sha, 1, 15) AS BIGINT), asset_id % 8) AS h FROM assets)"
_NEAR = "near AS (SELECT x.asset_id AS a, y.asset_id AS b, bit_count(xor(x.h, y.h)) AS distance FROM hashed x JOIN hashed y ON x.asset_id < y.asset_id AND bit_count(xor(x.h, y.h)) <= 4)"
_GROUPS = "reach AS (SELECT a AS node, b AS other FROM near UNION SELECT b, a FROM near UNION SELECT reach.node, y.other FROM reach JOIN (SELECT a AS node, b AS other FROM near UNION SELECT b, a FROM near) y ON reach.other = y.node)"

QUERIES = {
    "asset_exact_duplicates": (asset_exact_duplicates, f"WITH {ASSETS} SELECT sha, min(asset_id) AS representative, count(*) AS n, substr(sha256(sha || chr(0) || CAST(min(asset_id) AS VARCHAR)), 1, 16) AS cluster_id FROM assets GROUP BY sha HAVING count(*) > 1"),
    "asset_dedup_accepted": (asset_dedup_accepted, f"WITH {ASSETS} SELECT min(asset_id) AS asset_id, sha FROM assets GROUP BY sha"),
    "duplicate_representative": (duplicate_representative, f"WITH {ASSETS}, twice AS (SELECT *, min(asset_id) OVER (PARTITION BY sha) AS f, count(*) OVER (PARTITION BY sha) AS n FROM assets), t AS (SELECT substr(sha256(sha || chr(0) || CAST(f AS VARCHAR)), 1, 16) AS cluster_id, asset_id, {_TOTAL} AS t FROM twice WHERE n > 1 WINDOW c AS (PARTITION BY sha)) SELECT cluster_id, asset_id, round(t, 6) AS total, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY t DESC, asset_id) AS INTEGER) AS rank FROM t"),
    "hamming_pairs": (hamming_pairs, f"WITH {ASSETS}, {_HASHED}, {_NEAR}, firsts AS (SELECT asset_id, min(asset_id) OVER (PARTITION BY h) AS f FROM hashed) SELECT a, b, CAST(min(distance) AS INTEGER) AS distance FROM (SELECT least(fa, fb) AS a, greatest(fa, fb) AS b, distance FROM (SELECT f.f AS fa, g.f AS fb, distance FROM near JOIN firsts f ON f.asset_id = near.a JOIN firsts g ON g.asset_id = near.b WHERE f.f <> g.f) UNION ALL SELECT f, asset_id, 0 FROM firsts WHERE f <> asset_id) GROUP BY a, b"),
    "hamming_clusters": (hamming_clusters, f"WITH RECURSIVE {ASSETS}, {_HASHED}, {_NEAR}, {_GROUPS} SELECT node AS asset_id, least(node, min(other)) AS cluster FROM reach GROUP BY node"),
    "duplicate_summary": (duplicate_summary, f"WITH RECURSIVE {ASSETS}, {_HASHED}, {_NEAR}, {_GROUPS}, m AS (SELECT node AS asset_id, least(node, min(other)) AS cluster FROM reach GROUP BY node), t AS (SELECT asset_id, sha, cluster, {_TOTAL} AS t FROM assets JOIN m USING (asset_id) WINDOW c AS (PARTITION BY cluster)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY t DESC, asset_id) AS rank FROM t) SELECT cluster, CASE WHEN count(DISTINCT sha) = 1 THEN 'exact' ELSE 'near' END AS kind, count(*) AS n, arg_min(asset_id, rank) AS representative, count(*) - count(DISTINCT sha) AS rejected FROM r GROUP BY cluster"),
    "manifest_sources": (manifest_sources, f"WITH {ASSETS} SELECT sha, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n_files FROM assets GROUP BY sha"),
    "manifest_monotonic_diff": (manifest_monotonic_diff, f"WITH {ASSETS}, o AS (SELECT DISTINCT sha, source FROM assets WHERE asset_id % 3 <> 0), n AS (SELECT DISTINCT sha, source FROM assets WHERE asset_id % 2 = 0) SELECT sha, string_agg(source, ',' ORDER BY source) AS lost, sha NOT IN (SELECT sha FROM n) AS removed FROM (SELECT * FROM o EXCEPT SELECT * FROM n) GROUP BY sha"),
    "manifest_merge": (manifest_merge, f"WITH {ASSETS} SELECT sha, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM assets WHERE asset_id % 3 <> 0 OR asset_id % 2 = 0 GROUP BY sha"),
    "snapshot_diff": (snapshot_diff, f"WITH {ASSETS}, b AS (SELECT asset_id, sha FROM assets WHERE asset_id % 2 = 0), a AS (SELECT asset_id, CASE WHEN asset_id % 11 = 0 THEN 'x' ELSE sha END AS sha FROM assets WHERE asset_id % 3 <> 0) SELECT * FROM (SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, CASE WHEN a.sha IS NULL THEN 'missing' WHEN b.sha IS NULL THEN 'added' WHEN a.sha <> b.sha THEN 'changed' END AS status FROM b FULL JOIN a ON a.asset_id = b.asset_id) WHERE status IS NOT NULL"),
    "scan_limit_cut": (scan_limit_cut, "WITH t AS (SELECT doc_id AS asset_id, n_chars > 9000 AS large, sum(CASE WHEN n_chars > 9000 THEN 0 ELSE n_chars END) OVER (ORDER BY doc_id) AS b, sum(CASE WHEN n_chars > 9000 THEN 0 ELSE 1 END) OVER (ORDER BY doc_id) AS n FROM documents) SELECT asset_id, CASE WHEN large THEN 'file_too_large' WHEN n > 700 THEN 'too_many_images' WHEN b > 2000000 THEN 'total_size_exceeded' END AS issue FROM t"),
    "quality_rules": (quality_rules, f"WITH {DIMS}, l AS (SELECT asset_id, unnest(codes) AS code, CAST(unnest(range(0, len(codes))) AS INTEGER) AS ordinal FROM codes) SELECT asset_id, ordinal, code, CASE WHEN code IN ('low_resolution', 'aspect_ratio_outlier', 'blur', 'compression_artifacts', 'significant_alpha') THEN 'warning' ELSE 'reject' END AS severity FROM l"),
    "quality_disposition_counts": (quality_disposition_counts, f"WITH {DIMS} SELECT count(*) AS total, count(*) FILTER (disposition <> 'reject') AS accepted, count(*) FILTER (disposition = 'warn') AS warned, count(*) FILTER (disposition = 'reject') AS rejected FROM rated"),
    "quality_reason_counts": (quality_reason_counts, f"WITH {DIMS} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM codes) GROUP BY code"),
    "quality_distribution": (quality_distribution, f"WITH {DIMS} SELECT CAST(min(short_side) AS DOUBLE) AS low, CAST(median(short_side) AS DOUBLE) AS mid, CAST(max(short_side) AS DOUBLE) AS high FROM rated WHERE disposition <> 'reject'"),
    "dataset_statistics": (dataset_statistics, f"WITH {DIMS}, k AS (SELECT asset_id % 10 AS set, rated.short_side, width / CAST(height AS DOUBLE) AS ratio FROM rated JOIN d1 USING (asset_id) WHERE disposition <> 'reject') SELECT set, count(*) AS accepted, CAST(list_sort(list(short_side))[CAST(floor(count(*) * 0.1) AS INTEGER) + 1] AS BIGINT) AS short_side_p10, CAST(floor(median(short_side)) AS BIGINT) AS short_side_median, round(min(ratio), 6) AS least_ratio, round(max(ratio), 6) AS most_ratio FROM k GROUP BY set"),
    "override_adjustment": (override_adjustment, f"WITH {REVIEW} SELECT asset_id, disposition, included, gate_disposition FROM labelled"),
    "review_categories": (review_categories, f"WITH {REVIEW} SELECT asset_id, array_to_string(cats, ',') AS categories FROM labelled"),
    "review_primary": (review_primary, f"WITH {REVIEW} SELECT asset_id, {_PRIMARY} AS \"primary\" FROM labelled"),
    "review_facets": (review_facets, f"WITH {REVIEW} SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM labelled) GROUP BY category"),
    "dataset_gate": (dataset_gate, f"WITH {REVIEW}, s AS (SELECT lang, count(*) FILTER (gate_disposition <> 'reject') AS accepted, count(*) FILTER (duplicate) / CAST(count(*) AS DOUBLE) AS dominance, avg(CAST(validation AS INTEGER)) AS diversity FROM labelled GROUP BY lang) SELECT lang, accepted, concat_ws(',', CASE WHEN accepted < 16 THEN 'accepted_below_hard_minimum' WHEN accepted < 300 THEN 'accepted_below_guidance' END, CASE WHEN dominance > 0.07 THEN 'near_duplicate_dominance' END, CASE WHEN diversity < 0.25 THEN 'low_style_content_diversity' END, 'single_character_dominance') AS issues, NOT (accepted < 16 OR diversity < 0.25) AS passed FROM s"),
}
