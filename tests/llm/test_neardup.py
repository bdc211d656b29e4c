import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.llm import common, neardup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_the_plain_one():
    rng = random.Random(1)
    for trial in range(400):
        a = np.array([rng.randrange(4 if trial % 2 else 60) for _ in range(rng.randrange(0, 40))], np.uint32)
        b = a.tolist() if trial % 3 else [rng.randrange(5) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(60)] * rng.randrange(2)
        b = np.array(b, np.uint32)
        want = plain_distance(a.tolist(), b.tolist())
        for most in (0, 2, 5, 12, 50):
            assert neardup.edit_distance(a, b, most) == min(want, most + 1)
            if len(a) and len(b) and abs(len(a) - len(b)) <= most:
                assert neardup._banded(a.tolist(), b.tolist(), most) == min(want, most + 1)


def _edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.choice([60, 90, 150]))
        texts += [base] + [_edited(base, rng, max(1, len(base) // 50)) for _ in range(rng.choice([0, 1, 3]))] + [base] * rng.choice([0, 2])
    big = rng.choices(vocabulary, k=80)
    texts += [_edited(big, rng, 2) for _ in range(150)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    hashes = [neardup.word_hashes(t.encode()).astype(np.uint32) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and neardup.similarity(hashes[i], hashes[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert found == dict(enumerate(label))


def test_pairs_behind_an_unlike_first(spark):
    """Texts that share keys with many unlike ones by a common passage are compared with each other all the same."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    own = [[f"t{group}x{i}" for i in range(40)] for group in range(40)]
    texts = [" ".join(passage + words) for words in own] + [" ".join(passage[:1] + _edited(passage[1:] + words, rng, 12)) for words in own]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    hashes = [neardup.word_hashes(t.encode()).astype(np.uint32) for t in texts]
    keys = [set(neardup.keys_of(neardup.word_hashes(t.encode()))) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and neardup.similarity(hashes[i], hashes[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert found == dict(enumerate(label)) and len(set(label)) < 60


@pytest.mark.parametrize("n,edits", [(5, 1), (8, 1), (12, 2), (19, 3), (20, 4), (30, 6), (100, 20), (100, 15), (400, 80)])
def test_keys_shared_at_the_threshold(n, edits):
    """Of pairs planted at similarity 0.80 to 0.88, nine in ten share a key; of short ones all do."""
    rng, hit = random.Random(n * 1000 + edits), 0
    for _ in range(300):
        a = np.array([rng.getrandbits(63) for _ in range(n)], np.uint64)
        b = a.copy()
        for at in rng.sample(range(n), edits):
            b[at] = rng.getrandbits(63)
        hit += bool(set(neardup.keys_of(a)) & set(neardup.keys_of(b)))
    assert hit == 300 if n < neardup.SHORT else hit >= 0.9 * 300


@pytest.mark.parametrize("n", [30, 100, 400])
def test_recall_by_share_of_edits(spark, n):
    rng, texts, share = random.Random(n), [], [0.05, 0.10, 0.15, 0.19]
    for i in range(240):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        own = list(base)
        for at in rng.sample(range(n), int(n * share[i % 4])):
            own[at] = f"v{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(own)]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for s in range(4):
        assert sum(found[2 * i] == found[2 * i + 1] for i in range(s, 240, 4)) >= 0.9 * 60
    assert len(set(found.values())) >= 240


def test_pairs_among_thousands_with_a_common_passage(spark):
    """Five thousand texts share thirty words of sixty; planted pairs among them are found, and nothing else."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    texts = [passage + [f"t{rng.randrange(10**6)}" for _ in range(30)] for _ in range(5000)]
    texts += [passage + _edited(t[30:], rng, 6) for t in texts[:100]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert sum(found[5000 + i] == found[i] for i in range(100)) >= 90 and len(set(found.values())) >= 5000


def test_what_else_is_there_changes_no_links(spark):
    """Pairs among texts that share sixty words are the same whether many easy pairs lie elsewhere or not."""
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"t{rng.randrange(10**7)}" for _ in range(40)] for _ in range(1500)]
    texts += [passage + _edited(t[60:], rng, 8) for t in texts[:300]]
    easy = [[f"e{rng.randrange(10**8)}" for _ in range(30)] for _ in range(5000)]
    easy += [t[:-1] + ["other"] for t in easy]
    found = []
    for more in ([], easy):
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + more)], "doc_id long, text string")
        classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
        found.append([classes[i] for i in range(len(texts))])
        assert sum(classes[1500 + i] == classes[i] for i in range(300)) >= 285
        assert sum(classes[len(texts) + i] == classes[len(texts) + 5000 + i] for i in range(5000 if more else 0)) == (5000 if more else 0)
    assert sum(a != b for a, b in zip(*found)) <= 3


def test_no_pair_of_a_large_key_is_missed(spark):
    """Of 1650 texts that share sixty words of a hundred, all pairs at the threshold that have a key in common are found."""
    rng = random.Random(31)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"t{rng.randrange(10**7)}" for _ in range(40)] for _ in range(1500)]
    texts += [passage + t[60:80] + [f"v{rng.randrange(10**7)}" for _ in range(20)] for t in texts[:150]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    keys = [set(neardup.keys_of(neardup.word_hashes(" ".join(t).encode()))) for t in texts]
    pairs = [i for i in range(150) if keys[i] & keys[1500 + i]]
    assert len(pairs) > 140 and all(found[i] == found[1500 + i] for i in pairs)
    assert len(set(found.values())) == 1650 - len(pairs)


def test_a_group_of_near_copies_has_few_hubs(spark):
    """The keys of near copies name the same hubs, so that pairs grow with the copies and not with their keys."""
    rng = random.Random(32)
    base = [f"w{i}" for i in range(100)]
    texts = [_edited(base, rng, 2) for _ in range(3000)]
    rows = neardup.sketches(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text")
    assert neardup.candidates(rows.select("node", F.explode("keys").alias("key")).distinct()).count() < 6 * 3000


def test_shared_words_are_not_counted_short():
    rng = random.Random(33)
    texts = [[rng.randrange(60) for _ in range(rng.choice([0, 1, 30, 3000]))] for _ in range(40)]
    bits, beyond = neardup.marks([np.array(t, np.uint32) for t in texts])
    common = bits @ bits.T + np.minimum(beyond[:, None], beyond[None, :])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert sum((Counter(a) & Counter(b)).values()) <= common[i, j] <= min(len(a), len(b))


def test_recall_on_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    hashes = {r.doc_id: neardup.word_hashes((r.text or "").encode()).astype(np.uint32) for r in rows}
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    ids, pairs, hit = sorted(hashes), 0, 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if neardup.similarity(hashes[a], hashes[b]) >= 0.8:
                pairs += 1
                hit += found[a] == found[b]
    assert pairs and hit >= 0.9 * pairs


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (5, "long text " * 20_000), (6, "long text " * 20_000 + "end"), (7, "tie x y z"), (7, "tie x y z"), (None, "only here"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("row", F.lit(1))
    found = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (None, None), (None, 3)}
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 5 and "only here" in texts
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(9, i) for i in range(10, 40)] + [(5, 6)]])
def test_components(spark, edges):
    found = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = min(a for a, _ in edges if a != 5)
    assert all(v == (5 if k in (5, 6) and edges[0][0] == 9 else low) for k, v in found.items())
