"""Queries over tags and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.functions import tags as ontology
from curato.operators import captions, diversity, quality, tags
from curato.operators.graph import materialise
from curato.plans.assets import read

#: Raw tags which stand for the events' types.
RAW = ["1girl", "1boy", "solo", " Blue  Eyes", "gray_hair", "dress", "T-Shirt", "smiling", "outdoors", "masterpiece", "artist:foo", "character:alice", "sword", "text", "Long Hair", "zzz unknown", "2girls", "black_hair"]
TRIGGER = "my token"


def scores(spark, sf: str) -> DataFrame:
    """Events as tag scores: an asset is a user's day, and two tags are added to each."""
    events = read(spark, sf, "events")
    asset = F.col("user_id") * 100 + F.dayofmonth("ts")
    raw = F.array(*map(F.lit, RAW))[((F.col("event_id") * 7 + F.col("user_id")) % len(RAW)).cast("int")]
    rows = events.select(asset.alias("asset_id"), raw.alias("tag"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))
    assets = events.select(asset.alias("asset_id"), "user_id").distinct()
    girls = assets.where("user_id % 10 <> 0").select("asset_id", F.lit("1girl").alias("tag"), F.lit(0.9).alias("score"))
    hair = assets.select("asset_id", F.lit("white_hair").alias("tag"), (0.8 + (F.col("asset_id") % 10) / 100).alias("score"))
    return rows.unionByName(girls).unionByName(hair)


def clusters(spark, sf: str) -> DataFrame:
    """Users as clusters of their assets."""
    return _users(scores(spark, sf))


def _users(rows: DataFrame) -> DataFrame:
    return rows.select("asset_id").distinct().withColumn("cluster", F.floor(F.col("asset_id") / 100))


def _values(items) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in items)


SCORES = f"""ev AS (SELECT user_id * 100 + day(ts) AS asset_id, user_id, [{", ".join(f"'{t}'" for t in RAW)}][(event_id * 7 + user_id) % {len(RAW)} + 1] AS tag, least(1.0, value / 100) AS score FROM events),
scores AS (SELECT asset_id, tag, CAST(score AS DOUBLE) AS score FROM ev UNION ALL SELECT DISTINCT asset_id, '1girl', CAST(0.9 AS DOUBLE) FROM ev WHERE user_id % 10 <> 0
  UNION ALL SELECT DISTINCT asset_id, 'white_hair', CAST(0.8 AS DOUBLE) + (asset_id % 10) / CAST(100 AS DOUBLE) FROM ev),
cats(tag, category) AS (VALUES {_values(ontology.CATEGORY_OF.items())}),
syn(tag, target) AS (VALUES {_values(ontology.SYNONYMS.items())}),
conf(head, tag) AS (VALUES {_values((h, c) for h, o in ontology.CONFLICTS.items() for c in o)}),
ranks(category, r) AS (VALUES {", ".join(f"('{c}', {i})" for c, i in ontology.RANK.items())}),
keyed AS (SELECT tag AS raw, regexp_replace(replace(lower(trim(tag)), ' ', '_'), '_+', '_', 'g') AS k FROM (SELECT DISTINCT tag FROM scores)),
kinds AS (SELECT raw, coalesce(target, k) AS canonical FROM keyed LEFT JOIN syn ON syn.tag = k),
tagged AS (SELECT raw, canonical, coalesce(category, CASE WHEN canonical LIKE 'artist:%' OR canonical LIKE '%\\_(artist)' ESCAPE '\\' THEN 'artist' WHEN canonical LIKE 'character:%' THEN 'character'
  WHEN canonical LIKE 'copyright:%' OR canonical LIKE 'series:%' THEN 'copyright' WHEN canonical LIKE 'rating:%' THEN 'rating' WHEN canonical LIKE '%\\_quality' ESCAPE '\\' THEN 'quality' ELSE 'unclassified' END) AS category
  FROM kinds LEFT JOIN cats ON cats.tag = canonical),
norm AS (SELECT asset_id, canonical AS tag, category, max(score) AS score FROM scores JOIN tagged ON raw = tag GROUP BY ALL),
total AS (SELECT count(DISTINCT asset_id) AS n, count(DISTINCT asset_id // 100) AS c FROM scores),
best AS (SELECT asset_id // 100 AS cluster, tag, category, max(score) AS score FROM norm GROUP BY ALL),
weighted AS (SELECT tag, category, count(*) FILTER (score >= 0.35) / CAST(any_value(c) AS DOUBLE) AS frequency, sum(score) / any_value(c) AS mean FROM best, total GROUP BY tag, category),
classes AS (SELECT tag, frequency, mean, row_number() OVER o AS rank, coalesce(lead(frequency) OVER o, 0) AS runner_up FROM weighted WHERE category = 'person_class' WINDOW o AS (ORDER BY frequency DESC, mean DESC, tag)),
decision AS (SELECT max(CASE WHEN frequency >= 0.6 AND mean >= 0.45 AND frequency - runner_up >= 0.15 THEN tag END) AS token FROM classes WHERE rank = 1),
hits AS (SELECT tag, sum(h) AS hits, max(h) AS most FROM (SELECT tag, asset_id // 100 AS cluster, count(*) AS h FROM norm WHERE score >= 0.35 GROUP BY ALL) GROUP BY tag),
clash AS (SELECT head AS tag, count(DISTINCT asset_id) / CAST(any_value(n) AS DOUBLE) AS conflict_ratio FROM norm JOIN conf USING (tag), total WHERE score >= 0.35 GROUP BY head),
inv0 AS (SELECT tag, category, coalesce(hits / CAST(n AS DOUBLE), 0) AS raw_frequency, frequency, mean, coalesce(conflict_ratio, 0) AS conflict_ratio, coalesce(most / CAST(hits AS DOUBLE), 0) AS dominance
  FROM weighted LEFT JOIN hits USING (tag) LEFT JOIN clash USING (tag), total WHERE category IN ('appearance', 'species', 'permanent_accessory')),
inv AS (SELECT *, concat_ws(',', CASE WHEN raw_frequency < 0.85 THEN 'raw_frequency' END, CASE WHEN frequency < 0.85 THEN 'deduplicated_frequency' END, CASE WHEN mean < 0.55 THEN 'mean_confidence' END,
  CASE WHEN conflict_ratio > 0.1 THEN 'conflicts' END, CASE WHEN dominance > 0.5 THEN 'cluster_dominance' END) AS reasons FROM inv0),
usable AS (SELECT asset_id, tag, category, score FROM norm WHERE score >= 0.35),
kept AS (SELECT asset_id, tag, r, score, row_number() OVER (PARTITION BY asset_id ORDER BY r, score DESC, tag) AS place FROM usable JOIN ranks USING (category), decision
  WHERE category NOT IN ({", ".join(f"'{c}'" for c in ontology.SOURCES)}) AND tag NOT IN (SELECT tag FROM inv WHERE reasons = '') AND NOT (token IS NOT NULL AND category = 'person_class')),
caps AS (SELECT asset_id, concat_ws(', ', '{TRIGGER}', replace(any_value(token), '_', ' '), string_agg(replace(tag, '_', ' '), ', ' ORDER BY place)) AS caption
  FROM (SELECT DISTINCT asset_id FROM scores) CROSS JOIN decision LEFT JOIN kept USING (asset_id) GROUP BY asset_id),
div AS (SELECT category, tag, count(DISTINCT asset_id) AS n FROM norm GROUP BY ALL),
divs AS (SELECT category, count(*) AS unique_tags, -sum(n / CAST(t AS DOUBLE) * ln(n / CAST(t AS DOUBLE))) AS raw, arg_min(tag, (-n, tag)) AS dominant_tag, max(n) AS most FROM (SELECT *, sum(n) OVER (PARTITION BY category) AS t FROM div) GROUP BY category),
covers AS (SELECT category, count(DISTINCT asset_id) AS covered FROM norm GROUP BY category),
diversity AS (SELECT category, coalesce(unique_tags, 0) AS unique_tags, coalesce(covered / CAST(total.n AS DOUBLE), 0) AS coverage, coalesce(CASE WHEN unique_tags > 1 THEN raw / ln(unique_tags) END, 0) AS normalized_entropy,
  dominant_tag, coalesce(most / CAST(total.n AS DOUBLE), 0) AS dominant_ratio FROM ranks LEFT JOIN divs USING (category) LEFT JOIN covers USING (category), total)"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


def tag_normalize(spark, sf):
    return tags.normalize_scores(scores(spark, sf))


def tag_classify(spark, sf):
    return tags.classify(scores(spark, sf))


def tag_conflicts(spark, sf):
    return _round(tags.conflict_ratios(scores(spark, sf)), "conflict_ratio")


def class_token_stats(spark, sf):
    return _round(tags.class_statistics(scores(spark, sf), clusters(spark, sf)), "frequency", "mean", "runner_up")


def class_token_decision(spark, sf):
    return tags.class_decision(scores(spark, sf), clusters(spark, sf))


def identity_invariants(spark, sf):
    rows = tags.invariants(scores(spark, sf), clusters(spark, sf))
    rows = _round(rows, "raw_frequency", "deduplicated_frequency", "mean_confidence", "conflict_ratio", "cluster_dominance")
    return rows.withColumn("reasons", F.array_join("reasons.code", ","))


def category_diversity(spark, sf):
    return _round(diversity.category_diversity(scores(spark, sf)), "coverage", "normalized_entropy", "dominant_ratio").withColumn("unique_tags", F.col("unique_tags").cast("long"))


def diversity_report(spark, sf):
    rows = diversity.report(scores(spark, sf), clusters(spark, sf))
    return _round(rows, "content_diversity", "character_ratio", "copyright_ratio", "duplicate_dominance").withColumn("warnings", F.array_join("warnings", ","))


def _captions(spark, sf):
    """Captions from scores that are written once; the decision and the invariants are a few rows."""
    rows = materialise(scores(spark, sf), "scores")
    groups = _users(rows)
    decision = materialise(tags.class_decision(rows, groups), "decision")
    return captions.build(rows, TRIGGER, decision, materialise(tags.invariants(rows, groups).select("tag", "selected"), "invariants"))


def caption_build(spark, sf):
    return _captions(spark, sf).select("asset_id", "caption")


def _faulty(spark, sf):
    """Captions with faults put into some of them."""
    rows, n = caption_build(spark, sf), F.col("asset_id")
    text = F.when(n % 7 == 0, F.lit("")).when(n % 5 == 0, F.concat(F.lit("x, "), "caption")).when(n % 3 == 0, F.concat("caption", F.lit(", best quality, Dress, dress"))).when(n % 11 == 0, F.lit("nothing, here")).otherwise(F.col("caption"))
    return rows.withColumn("caption", text)


FAULTY = f"""{SCORES},
faulty AS (SELECT asset_id, CASE WHEN asset_id % 7 = 0 THEN '' WHEN asset_id % 5 = 0 THEN 'x, ' || caption WHEN asset_id % 3 = 0 THEN caption || ', best quality, Dress, dress' WHEN asset_id % 11 = 0 THEN 'nothing, here' ELSE caption END AS caption FROM caps),
parsed AS (SELECT asset_id, list_filter(string_split(caption, ', '), lambda t: t <> '') AS tags FROM faulty),
rest AS (SELECT asset_id, unnest(tags[2:]) AS tag FROM parsed),
restk AS (SELECT asset_id, regexp_replace(replace(lower(trim(tag)), ' ', '_'), '_+', '_', 'g') AS k FROM rest),
restc AS (SELECT asset_id, coalesce(target, k) AS canonical FROM restk LEFT JOIN syn ON syn.tag = k),
restt AS (SELECT asset_id, canonical, coalesce(category, CASE WHEN canonical LIKE 'artist:%' THEN 'artist' WHEN canonical LIKE 'character:%' THEN 'character' WHEN canonical LIKE '%\\_quality' ESCAPE '\\' THEN 'quality' ELSE 'unclassified' END) AS category FROM restc LEFT JOIN cats ON cats.tag = canonical),
facts AS (SELECT asset_id, count(*) > count(DISTINCT canonical) AS dup, bool_or(category IN ('quality', 'rating', 'resolution', 'text_watermark', 'character', 'copyright')) AS bad, bool_or(canonical = 'white_hair') AS leak,
  bool_or(category = 'clothing') AS clothing, bool_or(category NOT IN ('quality', 'rating', 'resolution', 'text_watermark')) AS semantic FROM restt GROUP BY asset_id),
audited AS (SELECT asset_id, len(tags) AS n, list_filter([CASE WHEN len(tags) = 0 THEN 'empty_caption' END, CASE WHEN len(tags) > 0 AND tags[1] <> '{TRIGGER}' THEN CASE WHEN list_contains(tags, '{TRIGGER}') THEN 'trigger_not_first' ELSE 'trigger_missing' END END,
  CASE WHEN dup THEN 'duplicated_tags' END, CASE WHEN bad THEN 'forbidden_tags' END, CASE WHEN leak THEN 'identity_invariant_leak' END,
  CASE WHEN len(tags) > 0 AND coalesce(tags[2], '') <> '1girl' THEN 'class_token_inconsistent' END], lambda i: i IS NOT NULL) AS issues,
  coalesce(clothing, false) AS clothing, coalesce(semantic, false) AS semantic, len(tags) > 0 AND coalesce(tags[2], '') = '1girl' AS consistent FROM parsed LEFT JOIN facts USING (asset_id))"""


def _audited(spark, sf):
    return captions.audit(_faulty(spark, sf), TRIGGER, "1girl", ["white_hair"])


def caption_audit_issues(spark, sf):
    return captions.issue_rows(_audited(spark, sf))


def caption_audit_summary(spark, sf):
    rows = captions.audit_summary(_audited(spark, sf))
    return _round(rows, "tags_mean", "clothing_coverage", "semantic_coverage", "class_consistency")


def tag_signal_rules(spark, sf):
    rows = tags.normalize_scores(scores(spark, sf), 0.0)
    # Families of tags and the score from which they count.
    families = {"text_watermark": (["text", "watermark", "signature", "logo"], 0.65), "multi_subject": (["2girls", "2boys", "multiple_girls", "multiple_boys", "group"], 0.70)}
    return quality.tag_signals(rows, "asset_id", families)


def _proposals(spark, sf):
    """Tags of an asset as its draft, and a changed list as its proposal."""
    rows = tags.normalize_scores(scores(spark, sf)).groupBy("asset_id").agg(F.sort_array(F.collect_list("tag")).alias("original"))
    change = F.concat(F.filter("original", lambda t: t != "dress"), F.array(F.lit("Sword"), F.lit("smiling"), F.lit("not in it"), F.lit("sword"), F.lit("masterpiece"), F.lit("a,b"), F.lit("forest"), F.lit("city")))
    keep = F.col("asset_id") % 3 == 0
    return rows.select("asset_id", F.when(keep, "keep").otherwise("edit").alias("decision"), "original", F.when(keep & (F.col("asset_id") % 2 == 0), F.col("original")).otherwise(change).alias("effective"))


PROPOSALS = f"""{SCORES},
drafts AS (SELECT asset_id, list_sort(list(tag)) AS original FROM usable GROUP BY asset_id),
proposals AS (SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN 'keep' ELSE 'edit' END AS decision, original, CASE WHEN asset_id % 6 = 0 THEN original
  ELSE list_concat(list_filter(original, lambda t: t <> 'dress'), ['Sword', 'smiling', 'not in it', 'sword', 'masterpiece', 'a,b', 'forest', 'city']) END AS effective FROM drafts)"""


def refinement_diff(spark, sf):
    rows = captions.proposal_diff(_proposals(spark, sf))
    return rows.select("asset_id", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


def refinement_contract(spark, sf):
    rows = _proposals(spark, sf)
    sent = rows.where("asset_id % 5 != 0").unionByName(rows.where("asset_id % 7 = 0")).unionByName(rows.where("asset_id % 9 = 0").withColumn("asset_id", -F.col("asset_id")))
    return captions.proposal_contract(rows, sent)


def proposal_validation(spark, sf):
    known = [(t, "general") for t in [*ontology.CATEGORY_OF, "zzz_unknown"]]
    vocabulary = spark.createDataFrame(known, "tag string, model_category string")
    rows = captions.validate_proposals(_proposals(spark, sf), vocabulary, 6)
    return rows.select("asset_id", F.array_join("accepted", "|").alias("accepted"), F.array_join("rejected", "|").alias("rejected"))


def trigger_candidates(spark, sf):
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("value"))
    more = spark.createDataFrame([(-5, "1girl"), (-4, "a, b"), (-3, "two  blanks"), (-2, " ok word "), (-1, "OK Word"), (-6, "sword"), (-7, "x" * 65)], "place int, value string")
    return captions.trigger_candidates(rows.unionByName(more))


def batch_packing_items(spark, sf):
    return captions.pack_items(read(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "batch")


def batch_packing_bytes(spark, sf):
    rows = read(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return captions.pack_bytes(rows, "source", "doc_id", "n_chars", 8, 120_000)


_R = "round({0}, 6) AS {0}"
_FULL = "items = 8 OR used + n_chars > 120000"
_KNOWN = ", ".join(f"'{t}'" for t in [*ontology.CATEGORY_OF, "zzz_unknown"])
_CLOSED = ", ".join(f"'{t}'" for t, c in ontology.CATEGORY_OF.items() if c in ontology.SOURCES)
VALIDATED = f"""{PROPOSALS}, e AS (SELECT asset_id, decision, original, list_transform(effective, lambda t: CASE t WHEN 'Sword' THEN 'sword' WHEN 'smiling' THEN 'smile' WHEN 'not in it' THEN 'not_in_it' ELSE t END) AS c FROM proposals),
x AS (SELECT asset_id, original, unnest(c) AS tag, unnest(range(0, len(c))) AS place FROM e), y AS (SELECT *, row_number() OVER (PARTITION BY asset_id, tag ORDER BY place) AS k, list_contains(original, tag) AS own FROM x),
z AS (SELECT *, CASE WHEN k > 1 THEN 'duplicate' WHEN contains(tag, ',') THEN 'separator' WHEN own THEN NULL WHEN tag NOT IN ({_KNOWN}) THEN 'unknown' WHEN tag IN ({_CLOSED}) THEN 'forbidden' END AS why FROM y),
n AS (SELECT *, count(*) FILTER (why IS NULL AND own) OVER (PARTITION BY asset_id) AS owned, count(*) FILTER (why IS NULL AND NOT own) OVER (PARTITION BY asset_id ORDER BY place) AS nth FROM z),
f AS (SELECT *, CASE WHEN why IS NULL AND NOT own AND nth > greatest(6 - owned, 0) THEN 'too_many' ELSE why END AS end_ FROM n),
g AS (SELECT asset_id, coalesce(string_agg(tag, '|' ORDER BY place) FILTER (end_ IS NULL), '') AS a, coalesce(string_agg(tag || ':' || end_, '|' ORDER BY place) FILTER (end_ IS NOT NULL), '') AS r FROM f GROUP BY 1)"""
QUERIES = {
    "tag_normalize": (tag_normalize, f"WITH {SCORES} SELECT asset_id, tag, score, category FROM usable"),
    "tag_classify": (tag_classify, f"WITH {SCORES} SELECT raw AS tag, canonical, category FROM tagged"),
    "tag_conflicts": (tag_conflicts, f"WITH {SCORES} SELECT tag, {_R.format('conflict_ratio')} FROM clash"),
    "class_token_stats": (class_token_stats, f"WITH {SCORES} SELECT tag, {_R.format('frequency')}, {_R.format('mean')}, CAST(rank AS INTEGER) AS rank, {_R.format('runner_up')} FROM classes"),
    "class_token_decision": (class_token_decision, f"WITH {SCORES} SELECT token, CASE WHEN token IS NULL THEN 1 ELSE 2 END AS keep_tokens FROM decision"),
    "identity_invariants": (identity_invariants, f"WITH {SCORES} SELECT tag, category, {_R.format('raw_frequency')}, round(frequency, 6) AS deduplicated_frequency, round(mean, 6) AS mean_confidence, {_R.format('conflict_ratio')}, round(dominance, 6) AS cluster_dominance, reasons, reasons = '' AS selected, reasons <> '' AND raw_frequency >= 0.85 AS warned FROM inv"),
    "category_diversity": (category_diversity, f"WITH {SCORES} SELECT category, unique_tags, {_R.format('coverage')}, {_R.format('normalized_entropy')}, dominant_tag, {_R.format('dominant_ratio')} FROM diversity"),
    "diversity_report": (diversity_report, f"WITH {SCORES}, r AS (SELECT avg(normalized_entropy) FILTER (coverage > 0 AND category IN ({', '.join(repr(c) for c in ontology.CONTENT)})) AS d, max(dominant_ratio) FILTER (category = 'character') AS c, max(dominant_ratio) FILTER (category = 'copyright') AS p FROM diversity), s AS (SELECT max(n) / CAST(sum(n) AS DOUBLE) AS m FROM (SELECT asset_id // 100, count(DISTINCT asset_id) AS n FROM scores GROUP BY 1)) SELECT round(d, 6) AS content_diversity, round(c, 6) AS character_ratio, round(p, 6) AS copyright_ratio, round(m, 6) AS duplicate_dominance, CAST(1 AS DOUBLE) AS style_consistency, concat_ws(',', CASE WHEN d < 0.25 THEN 'low_content_diversity' END, CASE WHEN c > 0.75 THEN 'single_character' END, CASE WHEN m > 0.35 THEN 'near_duplicate_dominance' END) AS warnings FROM r, s"),
    "caption_build": (caption_build, f"WITH {SCORES} SELECT asset_id, caption FROM caps"),
    "caption_audit_issues": (caption_audit_issues, f"WITH {FAULTY} SELECT asset_id, CAST(unnest(range(0, len(issues))) AS INTEGER) AS ordinal, unnest(issues) AS code FROM audited"),
    "caption_audit_summary": (caption_audit_summary, f"WITH {FAULTY} SELECT count(*) FILTER (len(issues) > 0) = 0 AS passed, count(*) AS captions, CAST(min(n) AS INTEGER) AS tags_min, CAST(max(n) AS INTEGER) AS tags_max, round(avg(n), 6) AS tags_mean, round(avg(CAST(clothing AS INTEGER)), 6) AS clothing_coverage, round(avg(CAST(semantic AS INTEGER)), 6) AS semantic_coverage, round(avg(CAST(consistent AS INTEGER)), 6) AS class_consistency FROM audited"),
    "tag_signal_rules": (tag_signal_rules, f"WITH {SCORES}, f AS (SELECT asset_id, CASE WHEN tag IN ('text', 'watermark', 'signature', 'logo') THEN 'text_watermark' ELSE 'multi_subject' END AS code, tag, score FROM norm WHERE tag IN ('text', 'watermark', 'signature', 'logo', '2girls', '2boys', 'multiple_girls', 'multiple_boys', 'group')) SELECT asset_id, code, 'warning' AS severity, arg_max(tag, score) AS tag, max(score) AS score FROM f GROUP BY asset_id, code HAVING max(score) >= CASE WHEN code = 'text_watermark' THEN 0.65 ELSE 0.7 END"),
    "refinement_diff": (refinement_diff, f"WITH {PROPOSALS} SELECT asset_id, array_to_string(list_filter(effective, lambda t: NOT list_contains(original, t)), '|') AS added, array_to_string(list_filter(original, lambda t: NOT list_contains(effective, t)), '|') AS removed FROM proposals"),
    "refinement_contract": (refinement_contract, f"WITH {PROPOSALS}, sent AS (SELECT asset_id FROM drafts WHERE asset_id % 5 <> 0 UNION ALL SELECT asset_id FROM drafts WHERE asset_id % 7 = 0 UNION ALL SELECT -asset_id FROM drafts WHERE asset_id % 9 = 0), c AS (SELECT asset_id, count(*) AS n FROM sent GROUP BY 1) SELECT * FROM (SELECT coalesce(c.asset_id, d.asset_id) AS asset_id, CASE WHEN n IS NULL THEN 'missing' WHEN d.asset_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' END AS problem FROM drafts d FULL JOIN c ON c.asset_id = d.asset_id) WHERE problem IS NOT NULL"),
    "proposal_validation": (proposal_validation, f"WITH {VALIDATED} SELECT asset_id, CASE WHEN decision = 'keep' AND c <> original THEN array_to_string(original, '|') ELSE coalesce(a, '') END AS accepted, CASE WHEN decision = 'keep' AND c <> original THEN '*:keep_changed' ELSE coalesce(r, '') END AS rejected FROM e LEFT JOIN g USING (asset_id)"),
    "trigger_candidates": (trigger_candidates, "WITH c AS (SELECT n_nationkey AS place, n_name AS value FROM nation UNION ALL VALUES (-2, 'ok word'), (-1, 'OK Word')) SELECT CAST(place AS INTEGER) AS place, value FROM (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY place) AS k FROM c) WHERE k = 1 ORDER BY place LIMIT 5"),
    "batch_packing_items": (batch_packing_items, "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM documents"),
    "batch_packing_bytes": (batch_packing_bytes, f"WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), t AS (SELECT source, doc_id, r, 0 AS batch, 1 AS items, n_chars AS used FROM o WHERE r = 1 UNION ALL SELECT o.source, o.doc_id, o.r, CASE WHEN {_FULL} THEN batch + 1 ELSE batch END, CASE WHEN {_FULL} THEN 1 ELSE items + 1 END, CASE WHEN {_FULL} THEN n_chars ELSE used + n_chars END FROM t JOIN o ON o.source = t.source AND o.r = t.r + 1) SELECT source, doc_id, CAST(batch AS BIGINT) AS batch FROM t"),
}
