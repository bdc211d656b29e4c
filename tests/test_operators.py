import hashlib
import json
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.functions import columns, tags as ontology
from curato.operators import captions, constraints, diversity, duplicates, embeddings, evaluation, graph, ingest, joins, logs, planning, quality, state, statistics, tags
from curato.plans import state as plan_state, training
from curato.plans.stages import Pipeline, Stage
from curato.sources import files
from curato.streaming import events


def _clusters(spark, rows=()):
    return spark.createDataFrame(list(rows), "asset_id string, cluster string")


def _scores(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, tag string, score double")


IDENTITY = [
    (f"a{i}", tag, score)
    for i in range(10)
    for tag, score in [("1girl", 0.96), ("solo", 0.90), ("white_hair", 0.91), ("blue_eyes", 0.88), (["dress", "jacket"][i % 2], 0.82), (["smile", "angry"][i % 2], 0.75), (["outdoors", "indoors"][i % 2], 0.72), ("masterpiece", 0.99), ("character:alice", 0.93)]
]


def test_identity_captions(spark):
    rows, none = _scores(spark, IDENTITY), _clusters(spark)
    decision, found = tags.class_decision(rows, none), tags.invariants(rows, none, clustered=False)
    assert decision.collect()[0][:] == ("1girl", 2)
    assert {r.tag for r in found.where("selected").collect()} == {"white_hair", "blue_eyes"}
    made = captions.build(rows, "tok", decision, found)
    assert all(r.caption.startswith("tok, 1girl, solo, ") for r in made.collect())
    audited = captions.audit(made, "tok", "1girl", ["white_hair", "blue_eyes"])
    summary = captions.audit_summary(audited).first()
    assert summary.passed and summary.clothing_coverage == 1.0 and summary.class_consistency == 1.0


def test_mixed_classes_give_no_token(spark):
    rows = _scores(spark, [(f"a{i}", ["1girl", "1boy"][i % 2], 0.9) for i in range(10)])
    assert tags.class_decision(rows, _clusters(spark)).first()[:] == (None, 1)
    made = captions.build(rows.withColumn("tag", F.lit("1girl")).where("asset_id = 'a0'"), "mixed_token", tags.class_decision(rows, _clusters(spark)), tags.invariants(rows, _clusters(spark)))
    assert made.first().caption == "mixed_token, 1girl"


def test_one_cluster_does_not_make_an_invariant(spark):
    rows = _scores(spark, [(f"a{i}", "blue_hair", 0.9) for i in range(9)] + [("b", "brown_hair", 0.9)])
    found = tags.invariants(rows, _clusters(spark, [(f"a{i}", "c") for i in range(9)])).where("tag = 'blue_hair'").first()
    assert not found.selected and found.warned
    assert [r.code for r in found.reasons] == ["deduplicated_frequency", "mean_confidence", "cluster_dominance"]


def test_style_forbids_sources(spark):
    rows = _scores(spark, [("a", t, 0.9) for t in ("watercolor", "artist:x", "character:y", "copyright:z", "best_quality", "forest", "dress")])
    made = captions.build(rows, "tok", tags.class_decision(rows, _clusters(spark)), tags.invariants(rows, _clusters(spark))).first()
    assert made.caption == "tok, dress, forest" and len(made.removed) == 5


def test_caption_audit(spark):
    rows = spark.createDataFrame([("a", "1girl, token, best quality, best quality"), ("b", ""), ("c", None), ("d", '"x, y", z')], "asset_id string, caption string")
    found = {r.asset_id: r.issues for r in captions.audit(rows, "token").collect()}
    assert found["a"] == ["trigger_not_first", "duplicated_tags", "forbidden_tags"]
    assert found["b"] == found["c"] == ["empty_caption"] and found["d"] == ["trigger_missing"]
    parsed = {r.asset_id: r.t for r in rows.select("asset_id", captions.parse_quoted(F.col("caption")).alias("t")).collect()}
    assert parsed["d"] == ["x, y", "z"] and parsed["a"][1] == "token" and parsed["b"] == []


def test_model_category_and_diversity(spark):
    rows = spark.createDataFrame([(a, t, 0.97, m) for a, ts in (("a", "dress smile alice"), ("b", "coat sad bob"), ("c", "dress smile alice")) for t, m in zip(ts.split(), ("general", "general", "character"))], "asset_id string, tag string, score double, model_category string")
    found = diversity.report(rows, _clusters(spark, [("a", "k"), ("c", "k")])).first()
    assert found.character_ratio == pytest.approx(2 / 3) and found.duplicate_dominance == pytest.approx(2 / 3) and found.content_diversity > 0
    assert diversity.report(rows).first().duplicate_dominance == 0.0
    assert diversity.category_diversity(rows).count() == len(ontology.CATEGORIES)


def test_ontology(spark):
    rows = spark.createDataFrame([(t,) for t in (" T-Shirt ", "Long  Hair", "gray_hair", "x_(artist)", "series:a", "odd_quality", "zzz")], "tag string")
    found = {r.tag: (r.canonical, r.category) for r in tags.classify(rows.withColumn("score", F.lit(1.0))).collect()}
    assert found[" T-Shirt "] == ("tshirt", "unclassified") and found["Long  Hair"] == ("long_hair", "appearance")
    assert found["gray_hair"][0] == "grey_hair" and found["x_(artist)"][1] == "artist" and found["series:a"][1] == "copyright" and found["odd_quality"][1] == "quality"
    assert ontology.closure({"a": "b", "b": "a", "c": "a"})["c"] in ("a", "b")


def test_proposals(spark):
    rows = spark.createDataFrame([("a", "edit", ["smile"], ["smile", "zzz", "blue_hair", "blue_hair", "a,b", "green_hair", "masterpiece", "red_hair"]), ("k", "keep", ["smile"], ["sad"]), ("n", "edit", ["smile"], [])], "asset_id string, decision string, original array<string>, effective array<string>")
    vocabulary = spark.createDataFrame([(t, "general") for t in ("smile", "blue_hair", "green_hair", "red_hair", "masterpiece", "sad")], "tag string, model_category string")
    found = {r.asset_id: r for r in captions.validate_proposals(rows, vocabulary, 3).collect()}
    assert found["a"].accepted == ["smile", "blue_hair", "green_hair"]
    assert found["a"].rejected == ["zzz:unknown", "blue_hair:duplicate", "a,b:separator", "masterpiece:forbidden", "red_hair:too_many"]
    assert found["k"].accepted == ["smile"] and found["n"].accepted == []


def test_packing(spark):
    rows = spark.createDataFrame([(i,) for i in range(17)], "id long")
    assert [r["count"] for r in captions.pack_items(rows, "id").groupBy("batch").count().orderBy("batch").collect()] == [8, 8, 1]
    sized = rows.select(F.lit("g").alias("g"), "id", F.lit(900).alias("n"))
    found = captions.pack_bytes(sized, "g", "id", "n", 8, 2000).orderBy("id").collect()
    assert [r.batch for r in found] == [i // 2 for i in range(17)]
    with pytest.raises(Exception, match="over the limit"):
        captions.pack_bytes(sized, "g", "id", "n", 8, 500).collect()


def test_quality_rules(spark):
    cols = "asset_id string, width int, height int, short_side int, luminance_mean double, luminance_stddev double, luminance_range double, sharpness double, compression_blockiness double, alpha_fraction double, error string"
    rows = spark.createDataFrame([("black", 128, 128, 128, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None), ("bad", None, None, None, None, None, None, None, None, None, "unsafe_image"), ("fine", 800, 900, 800, 99.0, 50.0, 200.0, 99.0, 1.0, 0.0, None)], cols)
    found = {r.asset_id: r for r in quality.assess(rows, early=F.col("error")).collect()}
    assert [r.code for r in found["black"].reasons] == ["low_resolution", "all_black", "blur"] and not found["black"].accepted
    assert [r.code for r in found["bad"].reasons] == ["unsafe_image"] and found["fine"].disposition == "accept"


def test_tag_signals_and_gate(spark):
    rows = _scores(spark, [("a", "watermark", 0.91), ("a", "2girls", 0.82), ("b", "text", 0.5), ("c", "logo", 0.7), ("c", "text", 0.7)])
    found = {(r.asset_id, r.code): r.tag for r in quality.tag_signals(rows, "asset_id", {"text_watermark": (["text", "watermark", "logo"], 0.65), "multi_subject": (["2girls"], 0.7)}).collect()}
    assert found == {("a", "text_watermark"): "watermark", ("a", "multi_subject"): "2girls", ("c", "text_watermark"): "text"}
    signals = spark.createDataFrame([(16, 0.0, 0.1, 0.9, 1.0)], "accepted int, near_duplicate_dominance double, content_diversity double, dominant_character_ratio double, style_consistency double")
    gate = quality.gate(signals, quality.GateLimits(least=16, guidance=16, style=True)).first()
    assert not gate.passed and [i.code for i in gate.issues] == ["low_style_content_diversity", "single_character_dominance"]


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", "h", 0, 100.0, 10.0), ("b", "h", 0, 200.0, 20.0), ("c", "k", 7, 150.0, 15.0)], "asset_id string, sha string, hash long, area double, sharpness double").withColumns({"compression_blockiness": F.lit(0.0), "alpha_fraction": F.lit(0.0), "crop_completeness": F.lit(1.0), "watermark_probability": F.lit(0.0)})
    pairs = duplicates.hamming_pairs(rows, "asset_id", "hash", 8)
    assert {(r.a, r.b, r.distance) for r in pairs.collect()} == {("a", "b", 0), ("a", "c", 3)}
    assert {(r.a, r.b, r.distance) for r in duplicates.hamming_pairs(rows, "asset_id", "hash", 8, all_pairs=True).collect()} == {("a", "b", 0), ("a", "c", 3), ("b", "c", 3)}
    members = rows.join(duplicates.cluster_pairs(pairs).select(F.col("node").alias("asset_id"), F.col("label").alias("cluster")), "asset_id")
    found = duplicates.cluster_summary(duplicates.representative_scores(members, "cluster"), "cluster", "sha").first()
    assert (found.kind, found.representative, found.rejected, found.n) == ("near", "b", 1, 3)
    with pytest.raises(ValueError, match="pairs"):
        duplicates.check_pair_budget(spark.range(2002))


@pytest.mark.parametrize("all_pairs", [False, True])
def test_hamming_pairs_broadcast_no_table_of_hashes(spark, all_pairs):
    rows = spark.range(1000).select("id", F.xxhash64("id").alias("h"))
    found = duplicates.hamming_pairs(rows, "id", "h", 4, all_pairs=all_pairs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_components_of_many_edges_broadcast_nothing(spark, monkeypatch):
    edges = spark.range(500).select(F.col("id").alias("a"), F.when(F.col("id") % 100 == 99, F.col("id")).otherwise(F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(900, 900)], "a long, b long"))
    want = {(i, i // 100 * 100) for i in range(500)} | {(900, 900)}
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    found = graph.components(edges)
    assert {tuple(r) for r in found.collect()} == want
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_number_have_their_own_place(spark):
    """As a frame of ROWS in SQL: each line's own epoch stands, and what is carried or last does not depend on how rows are dealt."""
    rows = [(1, 10, 2, None), (1, 10, 1, 0.5), (1, 11, 0, 0.25), (2, 10, 0, 0.1), (2, 10, 3, 0.2), (2, 10, 3, 0.3)]
    for parts in (1, 5):
        lines = spark.createDataFrame(rows, "run long, line_no long, epoch int, train_loss double").withColumn("validation_loss", F.lit(None).cast("double")).repartition(parts, "train_loss")
        carried = logs.carry_epoch(lines, "run", "line_no")
        assert sorted((r.run, r.line_no, r.epoch) for r in carried.collect()) == [(1, 10, 1), (1, 10, 2), (1, 11, 2), (2, 10, 0), (2, 10, 3), (2, 10, 3)]
        assert {(r.run, r.epoch, r.train_loss) for r in logs.losses_by_epoch(carried, "run", "line_no").collect()} == {(1, 1, 0.5), (1, 2, 0.25), (2, 3, 0.3)}


@pytest.mark.parametrize("name", ["log_parse", "loss_carry_forward", "loss_by_epoch"])
def test_log_lines_with_nulls_equal_sql(spark, tmp_path, name):
    """Lines without a number come last, as in SQL, and a line with a null value is no line."""
    rows = [(1, 3, 1, 0.1, 0.2), (1, 1, 2, 0.2, 0.3), (1, None, 2, 0.3, 0.1), (1, 7, None, 0.4, 0.1), (2, None, 4, 0.5, 0.1), (2, 6, 5, None, 0.1), (2, 9, 6, None, None), (2, 7, 7, 0.6, 0.2), (3, None, 1, None, 0.2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INTEGER, l_tax DOUBLE, l_discount DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    query, sql = plan_state.QUERIES[name]
    want = con.execute(sql)
    columns_ = [d[0] for d in want.description]
    want = [tuple(r) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r) for r in query(spark, str(tmp_path)).select(columns_).collect()))) == sorted(map(str, want))


def test_hamming_bands_equal_all_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(60)]
    values = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base] + base[:5]
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 4}
    rows = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    found = duplicates.hamming_pairs(rows, "id", "h", 4, all_pairs=True)
    assert {(r.a, r.b, r.distance) for r in found.collect()} == want
    # Pairs of representatives and each hash's members put the same rows together.
    few = duplicates.hamming_pairs(rows, "id", "h", 4)
    assert few.count() < len(want)
    classes = lambda pairs: {tuple(r) for r in duplicates.cluster_pairs(pairs).collect()}
    assert classes(few) == classes(found)


@pytest.mark.parametrize("threshold,block", [(0.9, 40), (0.4, 40), (-0.5, 64), (0.995, 7)])
def test_cosine_pairs_are_compared_once(spark, threshold, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 6))
    vectors = np.concatenate((base, base[:60] + rng.normal(0, 0.05, (60, 6)), base[:5]))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    first = {v.tobytes(): i for i, v in reversed(list(enumerate(vectors)))}
    own = sorted(first.values())
    want = {(i, j): float(unit[i] @ unit[j]) for i in own for j in own if i < j and unit[i] @ unit[j] >= threshold}
    want |= {(first[v.tobytes()], j): 1.0 for j, v in enumerate(vectors) if first[v.tobytes()] != j}
    found = duplicates.cosine_pairs(rows, "id", "v", threshold, block=block).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.cosine for r in found} == pytest.approx(want)


@pytest.mark.parametrize("block", [40, 4000])
def test_all_pairs_of_copies_are_given(spark, block):
    """As SQL has them: pairs of copies with each other, and of copies with near vectors; rows without a vector have none."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 6))
    vectors = np.concatenate((base, base[:30], np.repeat(base[:1], 200, axis=0)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None)], "id long, v array<double>").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.4, 1))
    found = duplicates.cosine_pairs(rows, "id", "v", 0.4, block=block, all_pairs=True).collect()
    assert len(found) == len(a) and {(r.a, r.b): r.cosine for r in found} == pytest.approx({(i, j): float(unit[i] @ unit[j]) for i, j in zip(a.tolist(), b.tolist())})


def test_near_pairs_of_repeated_embeddings_equal_sql(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet' UNION ALL SELECT vec_id + 10000 * r AS vec_id, * EXCLUDE (vec_id, r) FROM '{sf}/embeddings.parquet', range(1, 4) t(r) WHERE vec_id % 5 = 0")
    con.execute(f"COPY (SELECT * FROM embeddings) TO '{tmp_path}/embeddings.parquet'")
    query, sql = training.QUERIES["embedding_near_pairs"]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_comparisons_of_many_vectors(spark):
    # Twenty thousand vectors: at a low threshold every pair meets once, at a high one few do.
    rows = spark.range(1, 20_001).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i * 12.9898)).alias("v"))
    n = 20_000
    for threshold, share in ((0.4, 1.0), (0.999, 0.6)):
        blocks = duplicates.cosine_blocks(rows, threshold)
        sizes = blocks.select("kind", "i", "j", F.size("left").cast("long").alias("l"), F.size("right").cast("long").alias("r"))
        same = (F.col("kind") == "own") & (F.col("i") == F.col("j"))
        made = sizes.agg(F.sum(F.when(same, F.col("l") * (F.col("l") - 1) / 2).otherwise(F.col("l") * F.col("r")))).first()[0]
        assert made <= share * n * (n - 1) / 2


def test_nearest_and_vectors_of_zeros(spark):
    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(70, 5)), rng.normal(size=(90, 5))
    r[7] = r[3]
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>").repartition(3)
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, r))
    for skip in (True, False):
        cos = u @ w.T
        if skip:
            cos[np.arange(70), np.arange(70)] = -2
        found = {x.id: (x.other, x.cosine) for x in embeddings.nearest(frame(q), frame(r), "id", "v", block=16, skip_self=skip).collect()}
        assert found == {i: (int(c.argmax()), pytest.approx(float(c.max()))) for i, c in enumerate(cos)}
    assert embeddings.nearest(frame(q[:1]), frame(q[:1]), "id", "v").collect() == []
    with pytest.raises(Exception, match="zero"):
        embeddings.nearest(frame(np.zeros((2, 3))), frame(np.ones((3, 3))), "id", "v").collect()
    with pytest.raises(Exception, match="zero"):
        duplicates.cosine_pairs(frame(np.zeros((2, 3))), "id", "v", 0.5).collect()


def test_nearest_sends_each_row_a_few_times_and_ties_go_to_the_smallest_key(spark):
    rng = np.random.default_rng(11)
    some = rng.normal(size=(3000, 6))
    rows = spark.createDataFrame([(i, some[i % 3000].tolist()) for i in range(9000)], "id long, v array<double>").repartition(7)
    found = embeddings.nearest(rows, rows, "id", "v")
    assert {r.id: r.other for r in found.collect()} == {i: i % 3000 + (3000 if i < 3000 else 0) for i in range(9000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "BroadcastExchange" not in plan
    chunks = embeddings.packed(rows, "id", "v", 8).select("at", (F.octet_length("k") / 8).alias("n")).collect()
    assert sum(c.n for c in chunks) == 9000 and max(c.n for c in chunks) <= 2048 and {c.at for c in chunks} <= set(range(8))


def test_vectors_visit_few_cells_at_a_low_threshold(spark):
    """Where no cell can be ruled out, cells are not written for each pivot: before, sixteen pivots made 7.5 visits a vector."""
    rows = spark.range(1, 2_001).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i * 12.9898)).alias("v"))
    blocks = duplicates.cosine_blocks(rows, 0.0, block=125)
    guests = blocks.where("kind = 'guest'").select("cell", "j", "right", F.col("i").alias("own")).groupBy("cell", "j").agg(F.max(F.size("right")).alias("n"))
    assert (guests.agg(F.sum("n")).first()[0] or 0) <= 1.5 * duplicates.VISITS * 2_000


def test_forest_of_near_vectors_connects_what_pairs_connect(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 8))
    vectors = [(i, (middle[i % 40] + rng.normal(0, 0.1, 8)).tolist()) for i in range(800)]
    rows = spark.createDataFrame(vectors, "id long, v array<double>").repartition(3)
    for block in (100, 5000):
        pairs, forest = (duplicates.cosine_pairs(rows, "id", "v", 0.93, block=block, forest=f) for f in (False, True))
        found = {tuple(r) for r in duplicates.cluster_pairs(forest).collect()}
        assert found == {tuple(r) for r in duplicates.cluster_pairs(pairs).collect()} and len(found) > 700
        assert block == 100 or forest.count() < 800 < pairs.count()


def test_merged_groupings(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "1"), ("single", "2")], "member string, group string")
    two = spark.createDataFrame([("b", "x"), ("c", "x")], "member string, group string")
    assert {(r.node, r.label) for r in duplicates.merge_groupings([one, two]).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_embedding_review(spark):
    rows = spark.createDataFrame([("near-a", [1.0, 0.0, 0.0]), ("near-b", [0.99999, 0.001, 0.0]), ("ordinary", [0.9, 0.3, 0.0]), ("outlier", [-1.0, 0.0, 0.0])], "asset_id string, v array<double>")
    assert [(r.asset_id, r.similarity) for r in embeddings.outliers(rows, "asset_id", "v").collect()] == [("outlier", 0.0)]
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.95, 0.2]), ("c", [0.85, 0.35])], "asset_id string, v array<double>")
    assert embeddings.outliers(few, "asset_id", "v").count() == 0
    with pytest.raises(Exception, match="zero"):
        spark.createDataFrame([([0.0],)], "v array<double>").select(columns.unit(F.col("v"))).collect()


@pytest.mark.parametrize("w,h,most,want", [(1024, 1024, 1024, (1024, 1024)), (1920, 1080, 1024, (1344, 768)), (1080, 1920, 1024, (768, 1344)), (1600, 1200, 1024, (1088, 832)), (2048, 1365, 1024, (1216, 832)), (1920, 1080, 768, (1024, 576)), (48, 128, 768, (None, None)), (10000, 64, 768, (None, None)), (64, 10000, 768, (None, None))])
def test_buckets(spark, w, h, most, want):
    rows = spark.createDataFrame([(w, h, most)], "w int, h int, m int")
    bw, bh = planning.bucket(F.col("w"), F.col("h"), F.col("m"))
    assert rows.select(bw, bh).first()[:] == want


def test_holdouts(spark):
    rows = spark.createDataFrame([(f"a{i:02}", f"g{i % 5}") for i in range(40)], "id string, g string")
    split = planning.hash_holdout(rows, "id", 4)
    assert split.where("split = 'validation'").count() == 4
    again = planning.hash_holdout(rows.orderBy(F.desc("id")), "id", 4)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    grouped = planning.hash_holdout(rows, "id", 4, cluster="g")
    assert grouped.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert planning.hash_holdout(rows, "id", 0).where("split = 'validation'").count() == 0
    first = sorted(range(40), key=lambda i: hashlib.sha256(f"42\0a{i:02}".encode()).hexdigest())[:4]
    assert {r.id for r in split.where("split = 'validation'").collect()} == {f"a{i:02}" for i in first}
    train, held = planning.shuffled_holdout([f"x{i}" for i in range(24)], 0.1)
    assert len(held) == 2 and not set(train) & set(held) and planning.shuffled_holdout([f"x{i}" for i in reversed(range(24))], 0.1) == (train, held)


def test_evaluation(spark):
    rows = spark.createDataFrame([("c", 0.8, True, 0.5, 0.2, 1.0), ("c", 0.8, True, 0.0, 0.0, 1.0), ("c", 1.0, True, 0.5, 0.2, 1.0)], "k string, weight double, success boolean, mean double, spread double, compliance double")
    found = evaluation.candidate_signals(rows, "k").first()
    assert found.failure_rate == pytest.approx(1 / 3) and found.usable == 2 and found.prompt_compliance == 1.0
    ok = rows.where("mean > 0").withColumn("health", evaluation.health(F.col("mean"), F.col("spread")))
    assert evaluation.recommended_weight(ok, "k").first().recommended_weight == 0.8
    metrics = dict.fromkeys(("identity", "prompt_compliance", "flexibility", "consistency", "validation", "technical", "visual_heuristic"), F.lit(1.0))
    both = spark.createDataFrame([("bad", True), ("good", False)], "k string, corrupted boolean").withColumns(metrics).withColumns({"failure_rate": F.lit(0.0), "overfit_risk": F.lit(0.5)})
    ranked = evaluation.rank(evaluation.score(both), "k").orderBy("rank").collect()
    assert [(r.k, r.score) for r in ranked] == [("good", pytest.approx(0.9)), ("bad", 0.0)]
    assert evaluation.select_best(evaluation.score(both), "k").count() == 1
    assert spark.range(1).select(evaluation.validation_score(F.lit(None).cast("double")), evaluation.validation_score(F.lit(1.5))).first()[:] == (0.5, 0.0)


def test_mean_pairwise_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    v = np.abs(rng.normal(size=(6, 4)))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([(unit[i] @ unit[j]) for i in range(6) for j in range(i)])
    rows = spark.createDataFrame([("g", x.tolist()) for x in v] + [("one", [1.0, 0.0, 0.0, 0.0])], "g string, v array<double>")
    found = {r.g: r.pairwise for r in evaluation.mean_pairwise(rows, ["g"], "v").collect()}
    assert found["g"] == pytest.approx(want) and found["one"] == 1.0


LINES = [("epoch 3 step 120/400 loss=0.123 val_loss=0.151", (3, 120, 400, 0.123, 0.151)), ("epoch validation steps: 8/8 val_epoch_avg_loss=0.2468", (0, 8, 8, None, 0.2468)), ("steps: 100%|####| 6/6 [00:01, avr_loss=0.0438]", (0, 6, 6, 0.0438, None))]


@pytest.mark.parametrize("line,want", LINES)
def test_progress_lines(spark, line, want):
    rows = spark.createDataFrame([(line,), ("nothing",)], "line string")
    found = logs.parse_progress(rows, "line", 50).collect()
    assert len(found) == 1 and tuple(found[0])[1:] == want


def test_redaction(spark):
    text = "api_key: abc, Token=xyz; bearer a.b-c /home/u/f 'C:\\x y'"
    found = spark.createDataFrame([(text,)], "t string").select(logs.redact(F.col("t"), "/home/u"), logs.mask_paths(F.col("t"))).first()
    assert "abc" not in found[0] and "xyz" not in found[0] and "a.b-c" not in found[0] and "%USERPROFILE%" in found[0]
    assert "/home" not in found[1] and "C:" not in found[1]


def test_ingest(spark):
    old = spark.createDataFrame([("x", ["a"]), ("y", ["b"])], "sha string, sources array<string>")
    new = spark.createDataFrame([("x", ["a", "c"])], "sha string, sources array<string>")
    assert {r.sha: r.sources for r in ingest.merge_manifests(old, new, "sha").collect()} == {"x": ["a", "c"], "y": ["b"]}
    assert [(r.sha, r.removed) for r in ingest.manifest_losses(old, new, "sha").collect()] == [("y", True)]
    last = ingest.latest(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int"), ["k"], [F.desc("n")])
    assert sorted(map(tuple, last.collect())) == [("a", 2), ("b", 1)]


def test_constraints(spark):
    rows = spark.createDataFrame([("a" * 64, 1), ("A" * 64, 2), (None, 3)], "id string, n int")
    good, bad = constraints.validate(rows, "n", {"id": constraints.safe_asset_id(F.col("id"))})
    assert good.count() == 1 and {r.n for r in bad.collect()} == {2, 3}
    with pytest.raises(Exception, match="violated: id"):
        constraints.strict(rows, {"id": constraints.safe_asset_id(F.col("id"))}).collect()
    changes = spark.createDataFrame([("rate", 0.5, False), ("rate", 5.0, False), ("rate", 0.5, True), ("odd", 1.0, False)], "field string, value double, locked boolean")
    assert [r.problem for r in constraints.allowed_changes(changes, {"rate": (0, 1)}).collect()] == [None, "range", "locked", "unknown"]


def test_state(spark):
    leases = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h")], "id int, uuid string")
    assert [r.uuid for r in state.lease_conflicts(leases).collect()] == ["g"]
    samples = spark.createDataFrame([("a", float(t)) for t in (0, 1, 5, 6, 11)], "k string, t double")
    assert [r.at for r in state.throttled(samples, "k", F.col("t"), 5.0).orderBy("at").collect()] == [0.0, 5.0, 11.0]


def test_components_of_strings(spark):
    found = graph.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string"))
    assert {(r.node, r.label) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_stages_are_kept_by_fingerprint(spark, tmp_path):
    calls = []

    def double(df, by):
        calls.append(by)
        return df.withColumn("id", F.col("id") * by)

    def run(by, until=None):
        pipeline = Pipeline(spark, [Stage("double", double, ["src"], {"by": by}), Stage("more", double, ["double"], {"by": 3})], str(tmp_path))
        return pipeline.run({"src": spark.range(3)}, {"src": "v1"}, until), pipeline.log

    tables, log = run(2, "double")
    assert log == [("double", "run")] and "more" not in tables
    tables, log = run(2)
    assert log == [("double", "cached"), ("more", "run")] and sorted(r.id for r in tables["more"].collect()) == [0, 6, 12]
    assert run(4)[1] == [("double", "run"), ("more", "run")] and calls == [2, 3, 4, 3]


def _png(pixels):
    height, width = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_sources(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "noise.png").write_bytes(_png(rng.integers(0, 256, (40, 56, 3), np.uint8)))
    (tmp_path / "black.png").write_bytes(_png(np.zeros((32, 32, 3), np.uint8)))
    (tmp_path / "bad.webp").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_bytes(b"x")
    found = files.image_headers(files.scan_images(spark, [str(tmp_path)])).select(F.substring_index("path", "/", -1).alias("f"), "width", "height", "error").collect()
    assert {tuple(r) for r in found} == {("noise.png", 56, 40, None), ("black.png", 32, 32, None), ("bad.webp", None, None, "unsafe_image")}
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + bytes(9)
    assert files.image_size(jpeg) == (32, 16) and files.image_size(b"") is None


def test_model_headers(spark, tmp_path):
    def model(header, room=16):
        body = json.dumps(header).encode()
        return struct.pack("<Q", len(body)) + body + bytes(room)

    good = {"a": {"dtype": "F16", "data_offsets": [0, 8]}, "b": {"dtype": "F16", "data_offsets": [8, 16]}, "__metadata__": {"ss_epoch": "2", "ss_steps": "40"}}
    (tmp_path / "good.safetensors").write_bytes(model(good))
    (tmp_path / "lap.safetensors").write_bytes(model({"a": {"dtype": "F16", "data_offsets": [0, 9]}, "b": {"dtype": "F16", "data_offsets": [8, 16]}}))
    (tmp_path / "out.safetensors").write_bytes(model({"a": {"dtype": "F16", "data_offsets": [0, 99]}}))
    (tmp_path / "short.safetensors").write_bytes(b"abc")
    (tmp_path / "none.safetensors").write_bytes(model({}))
    heads = files.tensor_headers(spark.read.format("binaryFile").load(str(tmp_path)))
    errors = {r.path.rsplit("/", 1)[-1]: r.error for r in heads.where("error IS NOT NULL").collect()}
    assert errors == {"out.safetensors": "offsets", "short.safetensors": "too_short", "none.safetensors": "no_tensors"}
    assert [r.path.rsplit("/", 1)[-1] for r in state.adjacent_overlaps(heads.where("error IS NULL"), "path").collect()] == ["lap.safetensors"]
    assert [(r.epoch, r.step) for r in files.checkpoint_index(spark.read.format("binaryFile").load(str(tmp_path))).collect()] == [(2, 40)]


def test_vocabulary_and_devices(spark, tmp_path):
    (tmp_path / "v.csv").write_text("﻿name,category\nSmile,0\nalice,4\nrating:safe,9\n", encoding="utf-8")
    found = files.read_vocabulary(spark, str(tmp_path / "v.csv")).orderBy("place").collect()
    assert [(r.place, r.tag, r.model_category) for r in found] == [(0, "smile", "general"), (1, "alice", "character"), (2, "rating:safe", "rating")]
    (tmp_path / "w.csv").write_text("name,category\nSmile,0\nsmile,0\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_vocabulary(spark, str(tmp_path / "w.csv"))
    lines = spark.createDataFrame([("1, GPU-b, card, 5.0, 100, 60, 8.9",), ("0, GPU-a, card, 5.0, 100, 50, 8.9",), (" ",)], "line string")
    assert [r.uuid for r in files.parse_devices(lines, "line").collect()] == ["GPU-a", "GPU-b"]
    samples, missing = files.parse_telemetry(spark.createDataFrame([("GPU-a, 5, 1, 2, 40, [N/A]",), ("GPU-x, 1, 1, 1, 1, 1",)], "line string"), "line", spark.createDataFrame([("GPU-a",), ("GPU-b",)], "uuid string"))
    assert [(r.uuid, r.watts) for r in samples.collect()] == [("GPU-a", None)] and [r.uuid for r in missing.collect()] == ["GPU-b"]


def test_streams(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    query = events.append_events(events.read_events(spark, path, "click"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    batch = spark.read.parquet(path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.where("event_type = 'click'").count()
    appended = events.drain(events.sessions(events.read_events(spark, path), "1 hour"), "append")
    assert 0 < appended.count() <= batch.count()


def test_sinks(spark, tmp_path):
    from curato.sources import sinks

    path = str(tmp_path / "captions")
    first = spark.createDataFrame([("a", "x, y "), ("b", "z")], "asset_id string, caption string")
    assert {r.asset_id: r.payload for r in sinks.write_captions(first, path).collect()} == {"a": "x, y\n", "b": "z\n"}
    second = spark.createDataFrame([("a", "x, y"), ("b", "new")], "asset_id string, caption string")
    assert {r.asset_id: r.payload for r in sinks.write_captions(second, path).collect()} == {"a": "x, y\n", "b": "new\n"}
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="violated: caption"):
        sinks.caption_payloads(spark.createDataFrame([("a", " ")], "asset_id string, caption string")).collect()
    name, text = sinks.dataset_toml({"shuffle_caption": True, "keep_tokens": 2, "resolution": 1024, "batch_size": 4, "repeats": 3}, "/x")
    assert name == sinks.dataset_toml({"shuffle_caption": True, "keep_tokens": 2, "resolution": 1024, "batch_size": 4, "repeats": 3}, "/x")[0] and "batch_size = 4" in text and "shuffle_caption = true" in text
    sinks.write_tag_records(_scores(spark, [("a", "t", 0.5), ("a", "s", 0.7)]), str(tmp_path / "tags"), "r1")
    assert spark.read.json(str(tmp_path / "tags")).first().tags[0].tag == "s"
    scored = spark.createDataFrame([("c1", 0.9, True), ("c2", 0.8, True), ("c3", 0.99, False)], "k string, score double, gate_passed boolean")
    digests = spark.createDataFrame([(f"c{i}", f"d{i}") for i in (1, 2, 3)], "k string, digest string")
    assert {tuple(r) for r in sinks.package_manifest(scored, digests, "k").collect()} == {("c1", "final", "d1"), ("c2", "alternative", "d2")}


def test_links_of_many_equal_rows(spark):
    """Twenty thousand equal hashes, and as many vectors in few directions, make as many links and no more."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, F.lit(7)).otherwise(F.lit(1 << 40)).alias("hash"))
    pairs = duplicates.hamming_pairs(rows, "id", "hash", 3, bits=60)
    assert pairs.count() == 20_000 - 2 + 0 and duplicates.cluster_pairs(pairs).select("label").distinct().count() == 2
    axis = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i == k, F.lit(1.0)).otherwise(F.lit(0.0)))
    vectors = spark.range(20_000).select("id", F.transform(F.zip_with(axis(F.col("id") % 16), F.sequence(F.lit(0), F.lit(15)), lambda x, i: x * 50 + F.pmod(F.xxhash64("id", i), F.lit(100)) / 100.0), lambda x: x).alias("v"))
    found = duplicates.cosine_pairs(vectors.where("id < 3000"), "id", "v", 0.9995, block=128)
    own = np.array([r.v for r in vectors.where("id < 3000").orderBy("id").collect()])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(own @ own.T >= 0.9995, 1))
    assert {(r.a, r.b) for r in found.collect()} == set(zip(a.tolist(), b.tolist())) and len(a)
    same = spark.range(20_000).select("id", axis(F.col("id") % 16).alias("v"))
    assert duplicates.cosine_pairs(same, "id", "v", 0.9).count() == 20_000 - 16
    with pytest.raises(ValueError, match="pairs"):
        duplicates.cosine_pairs(same, "id", "v", 0.9, budget=duplicates.PAIR_BUDGET)


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 9.0], [5.0] * 999, [float(i * 7919 % 1013) for i in range(5000)]])
def test_exact_median(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = float(np.median(values)) if values else None
    assert statistics.exact_median(rows, F.col("v")).first().median == want
    # Brackets are narrowed until few values are left.
    assert statistics.median_of(rows, F.col("v"), few=3) == want


def test_free_names(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    found = state.first_free_name(names("a", "a_v3", "b", "c"), names("a_v3", "a", "a_v2", "c", "c_v3", "b_v2"))
    assert {r.name: r.free for r in found.collect()} == {"a": "a_v4", "a_v3": "a_v3_v2", "b": "b", "c": "c_v2"}


def test_trigger_candidates_need_three(spark):
    rows = spark.createDataFrame([(1, "abc one"), (2, "ABC one"), (3, "xyz"), (4, "1girl")], "place int, value string")
    with pytest.raises(Exception, match="trigger candidates"):
        captions.trigger_candidates(rows).collect()
    more = rows.union(spark.createDataFrame([(5, "third")], "place int, value string"))
    assert [r.value for r in captions.trigger_candidates(more).orderBy("place").collect()] == ["abc one", "xyz", "third"]


def test_devices_that_are_not_ones(spark):
    line = "0, GPU-a, n, 1, 8, 4, 9.0"
    for lines in (["0, GPU-a"], [line, line.replace("GPU-a", "GPU-b")], [line, line.replace("0,", "1,", 1)]):
        with pytest.raises(Exception, match="device"):
            files.parse_devices(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()


def test_strict_joins(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    for joined in (joins.one_to_one(left, right, "k"), joins.complete(left, right, "k"), joins.one_to_one(right.union(right), right.withColumnRenamed("v", "w"), "k")):
        with pytest.raises(Exception, match="missing|one to one"):
            joined.collect()


def test_prompts_and_devices_that_fail(spark):
    few = spark.createDataFrame([(i, "{trigger} x") for i in range(7)], "prompt_id int, text string")
    with pytest.raises(Exception, match="too few"):
        planning.prompt_set(few, "tok").collect()
    with pytest.raises(Exception, match="no place"):
        planning.prompt_set(few.union(few).limit(8).withColumn("text", F.lit("plain")), "tok").collect()
    with pytest.raises(Exception, match="selected"):
        spark.range(1).select(planning.preferred_device(F.lit("tag"), F.array(F.lit("g0")), F.lit("g9"))).collect()


def test_decoded_lines(spark):
    rows = spark.createDataFrame([(b"\xef\xbb\xbfstep 1",), (b"a\xffb",), ("\u00e9".encode(),)], "raw binary")
    assert [r.t for r in rows.select(columns.decode_line(F.col("raw")).alias("t")).collect()] == ["step 1", "a\ufffdb", "\u00e9"]
