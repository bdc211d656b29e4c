import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.llm import quality, toxicity


def _labelled(spark):
    words = "the of and to in on was that by for".split()
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, 40))
        toxic, good = int(i % 10 == 0), int(i % 4 != 0)
        if toxic:
            text += " idiot scum" * int(rng.integers(1, 5))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, good, toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")


def test_ordinal_regression_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    model = toxicity.train(docs, labels, training=F.col("doc_id") < 300)
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.score(docs.where("doc_id >= 300"), model).join(labels, "doc_id").select("tox.*", F.col("toxic").alias("label")).toPandas()
    scored["toxic"] = (scored.toxicity >= toxicity.REJECT).astype(int)
    found = toxicity.evaluate(scored)
    assert found["precision"] > 0.95 and found["recall"] > 0.95
    assert scored.severity[scored.label == 1].min() > scored.severity[scored.label == 0].max()
    assert ((scored.severity >= scored.toxicity) & (scored.severity <= toxicity.GRADES - 1)).all()


def test_knn_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    voters = quality.train(docs, labels, training=F.col("doc_id") < 300)
    scored = quality.score(docs.where("doc_id >= 300"), voters).join(labels, "doc_id").toPandas()
    assert ((scored.quality_score >= quality.GOOD) == (scored.quality == 1)).mean() > 0.95
    assert scored.quality_score.between(0, 1).all()


def test_blocked_cosines_equal_plain_ones():
    texts = [f"a{i % 7} b{i % 5} c{i % 3} !!".encode() for i in range(90)] + [b""]
    voters = quality.fit([quality.vector(t, {}) for t in texts[:60]], [i % 2 for i in range(60)])
    scores = voters.score(texts)
    for text, got in zip(texts, scores):
        cosines = voters.vectors @ voters.project([text])[0]
        best = np.sort(cosines)[::-1][: quality.NEIGHBOURS]
        if not cosines.any():
            assert got == voters.prior
        else:
            near = np.flatnonzero(cosines >= best[-1] - 1e-6)
            w = np.clip(cosines[near].astype(float), 0, None) ** 4
            assert 0 <= got <= 1 and (len(near) > quality.NEIGHBOURS or got == pytest.approx((w * voters.labels[near]).sum() / w.sum(), abs=1e-5))


def _plain_loss(w, theta, y, rows, ridge=4e-4):
    """The penalised negative log-likelihood, document by document."""
    total = 0.0
    for grade, (columns, values) in zip(y, rows):
        z = sum(w[c] * v for c, v in zip(columns, values))
        above = [1.0, *(1 / (1 + np.exp(t - z)) for t in theta), 0.0]
        total -= np.log(max(above[grade] - above[grade + 1], 1e-12))
    return total / len(y) + ridge / 2 * float((w**2).sum())


def test_fit_is_near_the_optimum_of_the_plain_likelihood():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["mild", "bad", "worse", "tree", "lake", "hill"], 12)).encode() for _ in range(150)]
    y = np.array([min(3, (t.count(b"bad") + 2 * t.count(b"worse")) // 3) for t in texts])
    rows = [toxicity.features(t) for t in texts]
    model = toxicity.fit(y, rows)
    best = _plain_loss(model.weights, model.thresholds, y, rows)
    used = np.flatnonzero(model.weights)
    assert best < _plain_loss(np.zeros(toxicity.BUCKETS), np.log([(np.sum(y <= k) + 1) / (np.sum(y > k) + 1) for k in range(3)]), y, rows) / 2
    for step in (1e-3, -1e-3):
        for c in used[:12]:
            w = model.weights.copy()
            w[c] += step
            assert _plain_loss(w, model.thresholds, y, rows) > best - 2e-4
        for k in range(3):
            theta = model.thresholds.copy()
            theta[k] += step
            assert _plain_loss(model.weights, theta, y, rows) > best - 2e-4


def test_grades_against_plain_counts():
    texts = [b"scum idiot tree", b"scum scum scum scum", b"tree lake", b"lake scum idiot idiot scum idiot scum scum idiot"] * 3 + [b"tree hill lake"] * 40
    toxic = [int(b"scum" in t) for t in texts]
    grades, marks = toxicity.grade_of(toxic, [toxicity.stems(t) for t in texts])
    plain = [0 if not x else 1 + min(2, int(np.log2(max(1, sum(w[:4] in (b"scum", b"idio") for w in t.split()))))) for x, t in zip(toxic, texts)]
    assert grades.tolist() == plain and {int.from_bytes(b"scum", "big"), int.from_bytes(b"idio", "big")} == set(marks)


@pytest.mark.parametrize("column,adder,trainer", [("tox", toxicity.score, toxicity.train), ("quality_score", quality.score, quality.train)])
def test_classifiers_on_odd_rows(spark, column, adder, trainer):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a " * 50_000)], "doc_id long, text string").withColumn(column, F.lit(1)).withColumn("row", F.lit(2))
    labels = spark.createDataFrame([(1, None, None), (1, 1, 0), (1, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    model = trainer(docs, labels)
    assert adder(docs, model).count() == 4 and adder(docs.limit(0), model).count() == 0
    empty = trainer(docs, labels.limit(0))
    assert adder(docs, empty).count() == 4
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels.limit(0)))
    assert kept.columns == docs.columns and kept.count() == 4


def test_toxicity_is_fitted_in_a_task(spark, sf, monkeypatch):
    """The driver gets the model alone, which is that of all rows at once, in the order of ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    texts = [(r.text or "").encode() for r in rows]
    y, _ = toxicity.grade_of([r.toxic for r in rows], [toxicity.stems(t) for t in texts])
    want = toxicity.fit(y, [toxicity.features(t) for t in texts])

    def fit(*_):
        raise AssertionError("fitted by the driver")

    monkeypatch.setattr(toxicity, "fit", fit)
    model = toxicity.train(docs, labels)
    assert (model.weights == want.weights).all() and (model.thresholds == want.thresholds).all()
