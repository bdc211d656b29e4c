import zlib

import numpy as np

import corpus_pipeline
from curato.llm import decontaminate, mixing, neardup, tokenfile, toxicity
from curato.llm.common import materialise


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = materialise(stage(spark, docs, sf), name)
    raw, untoxic, unique, clean, mixed = inputs
    assert all(d.columns == raw.columns for d in inputs)
    rows = [{r.doc_id: r.text for r in d.collect()} for d in inputs]

    model = toxicity.train(raw, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"))
    assert set(rows[1]) == {i for i, t in rows[0].items() if not t or model.above(t.encode())[0] < toxicity.REJECT}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & set(rows[1])) <= 0.1 * len(toxic)

    hashes = {i: neardup.word_hashes((t or "").encode()).astype(np.uint32) for i, t in rows[1].items()}
    alike = lambda a, b: rows[1][a] == rows[1][b] or neardup.similarity(hashes[a], hashes[b]) >= 0.8
    kept = sorted(rows[2])
    assert sum(alike(a, b) for n, a in enumerate(kept) for b in kept[:n]) <= 1
    for lost in set(rows[1]) - set(rows[2]):
        assert any(alike(lost, b) for b in rows[1] if b != lost)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(rows[3]) == {i for i, t in rows[2].items() if not decontaminate.brute_force(t, items)[1]}

    taken = {r.doc_id: r for r in mixing.mix(clean, share=corpus_pipeline.MIXED_SHARE, epochs=1).collect()}
    assert set(taken) == set(rows[4])
    for i, r in taken.items():
        words = rows[3][i].split()
        assert rows[4][i] == rows[3][i] if r["take"] == r.n_tokens else rows[4][i].split() == words[: r["take"]]

    encoder, at = tokenfile.Encoder(tokenfile.tokenizer_path()), 0
    found = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == sorted(rows[4])
    for r in found:
        ids = encoder.inner.encode(rows[4][r.doc_id], add_special_tokens=False).ids + [tokenfile.END]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, long and repeated texts, null ids and clashing columns go through all stages; an empty table gives no rows."""
    rows = [(1, None), (2, ""), (3, "long text " * 15_000), (4, "same words here"), (4, "same words here"), (5, "same words here"), (None, "no id at all"), (6, "a benchmark text of ten words or more stands in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source", "cast(length(text) as long) AS n_chars", "1 AS node", "'x' AS label", "2 AS row")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark text of ten words or more stands in here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for own, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            made = materialise(stage(spark, own, str(tmp_path)), name)
            assert made.count() <= own.count() and (made.count() == 0) == empty
            if name != "token_output":
                assert made.columns == own.columns
            own = made
        assert {r.doc_id for r in own.collect()} <= {None, 1, 2, 3, 4, 6}
