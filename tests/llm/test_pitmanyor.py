import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.llm import pitmanyor as py


def test_scores_against_plain_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = {r.doc_id: r for r in py.lm_scores(docs, held, contexts=50, part_tokens=20_000, restaurants=16).collect()}
    texts = {r.doc_id: py.tokens_of((r.text or "").encode()) + [py.END] for r in docs.collect()}
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    gain = 0.0
    for i, words in texts.items():
        r = found[i]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(w in train for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        gain += (r.score - r.base_score) if r.held_out else 0
    assert gain > 0


def test_probabilities_add_up_to_one(spark):
    rows = [(i, "a b a c b a " * (i % 3) + f"x{i} a c") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").select(F.encode("text", "UTF-8").alias("t"), F.lit(False).alias("held"), "id")
    shared, parts, samples, tokens = py.fit(docs, contexts=4, part_tokens=60, restaurants=3)
    layout = shared.value
    found: dict = {}
    for r in parts.collect():
        found.setdefault(r.part, {})[r.kind] = bytes(r.content)
    assert len(found) > 2 and layout.hot > 0
    for context in range(layout.size):
        total = 0.0
        for i, own in found.items():
            part = py.Part(own["pairs"], own["seats"], samples)
            words = part.words[~np.isin(part.words, layout.hot_hashes)]
            total += py.probabilities(part, samples, words, np.arange(len(words)), np.full(len(words), context))[1].sum()
        for h in layout.hot_hashes:
            # A hot word's pairs lie in the part that the hash of both words says.
            own = found.get(int((py.mix(py.mix(np.array([h]) + np.array([context + 1], np.uint64) * py._M)) % np.uint64(layout.parts))[0]))
            part = py.Part(own["pairs"], own["seats"], samples) if own else None
            counts, chance = py.probabilities(part, samples, np.array([h]), np.array([0]), np.array([context]))
            assert counts[0] > 0
            total += chance[0]
        total += py.probabilities(None, samples, np.array([1], np.uint64), np.array([0]), np.array([context]))[1][0]
        assert total == pytest.approx(1, abs=1e-9)


def _tables(count: int, new: float, d: float) -> np.ndarray:
    """The chance of each number of tables of a pair's customers: weights new ** tables times generalized Stirling numbers."""
    weight = np.zeros(count + 2)
    weight[1] = 1.0
    for n in range(1, count):
        weight[1:] = new * weight[:-1] + np.maximum(n - d * np.arange(1, count + 2), 0) * weight[1:]
        weight /= weight.sum()
    return weight[: count + 1]


def test_a_sweep_moves_all_customers_of_a_frequent_pair():
    """A thousand tables of one customer: all are left in one sweep, not 64 of them."""
    rng = np.random.default_rng(1)
    count = np.array([3, 1000, 5000])
    own, size = np.repeat(np.arange(3), count), np.ones(6003, np.int64)
    own, size = py.move_all(own, size, count, np.full(3, 0.01), 0.3, rng)
    assert np.bincount(own, size).tolist() == [3, 1000, 5000] and (np.diff(own) >= 0).all()
    assert (np.bincount(own)[1:] < 0.6 * count[1:]).all()


@pytest.mark.parametrize("new,d", [(0.6, 0.4), (15.0, 0.75)])
def test_sweeps_of_a_frequent_pair_reach_the_right_number_of_tables(new, d):
    rng = np.random.default_rng(2)
    count = np.array([80] * 200)
    weights, state = np.full(200, new), py.seat(count, np.full(200, new), d, rng)
    seen = []
    for turn in range(100):
        state = py.move_all(*state, count, weights, d, rng)
        if turn >= 30:
            seen.append(np.bincount(state[0], minlength=200))
    seen, chance = np.concatenate(seen), _tables(80, new, d)
    n = np.arange(81)
    mean = (n * chance).sum()
    assert seen.mean() == pytest.approx(mean, abs=0.05 * math.sqrt((n * n * chance).sum() - mean**2) + 0.02)
    assert seen.var() == pytest.approx((n * n * chance).sum() - mean**2, rel=0.1)


@pytest.mark.parametrize("new", [0.4, 1.2, 6.0])
def test_tables_in_the_parent_are_drawn_from_their_distribution(new):
    rng = np.random.default_rng(3)
    for count in (2, 3, 7, 64, 700):
        found = np.bincount(py.root_tables(np.full(40_000, count), new, rng), minlength=count + 1)[: count + 1] / 40_000
        assert np.abs(found - _tables(count, new, py.ROOT_DISCOUNT)).max() < 0.012
    assert (py.root_tables(np.array([0, 1, 10**9]), new, rng)[:2] == 1).all()


def test_gibbs_steps_keep_customers_and_reach_the_right_number_of_tables():
    rng = np.random.default_rng(0)
    count = np.array([2] * 4000 + [3] * 4000)
    new, d = np.full(len(count), 0.6), 0.4
    own, size = py.seat(count, new, d, rng)
    for _ in range(12):
        own, size = py.reseat(own, size, count, new, d, rng)
        assert (np.bincount(own, size, len(count)) == count).all() and (size > 0).all()
    tables = np.bincount(own, minlength=len(count))
    assert (tables[:4000] - 1).mean() == pytest.approx(0.6 / (0.6 + 1 - d), abs=0.03)
    # Three customers: by the product of the seating probabilities of each arrangement.
    w1, w2, w3 = (1 - d) * (2 - d), 3 * 0.6 * (1 - d), 0.6 * 0.6
    assert tables[4000:].mean() == pytest.approx((w1 + 2 * w2 + 3 * w3) / (w1 + w2 + w3), abs=0.04)


def _plain_sampler(train, sweeps, kept, discount, rng):
    """Seats customers one by one with python lists, the parent's too, and gives p(word | context) averaged over kept sweeps."""
    pairs = Counter(p for text in train for p in zip([None, *text[:-1]], text))
    words, contexts = sorted({w for _, w in pairs}), {c for c, _ in pairs}
    tables = {p: [1] * n for p, n in pairs.items()}
    roots = {w: [1] * sum(len(t) for p, t in tables.items() if p[1] == w) for w in words}
    even = (1 - py.UNKNOWN) / len(words)

    def root(w):
        n, r, every = sum(roots[w]), len(roots[w]), sum(map(len, roots.values()))
        return (n - py.ROOT_DISCOUNT * r + (py.STRENGTH + py.ROOT_DISCOUNT * every) * even) / (py.STRENGTH + sum(sum(t) for t in roots.values()))

    def draw(sizes, less, new):
        at = rng.random() * (sum(s - less for s in sizes) + new)
        for i, s in enumerate(sizes):
            at -= s - less
            if at < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        at = rng.random() * sum(sizes)
        for i, s in enumerate(sizes):
            at -= s
            if at < 0:
                break
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    total = Counter()
    for sweep in range(sweeps + kept):
        for (c, w), n in pairs.items():
            for _ in range(n):
                if leave(tables[c, w]):
                    leave(roots[w])
                every = sum(len(t) for p, t in tables.items() if p[0] == c)
                if draw(tables[c, w], discount, (py.STRENGTH + discount * every) * root(w)):
                    every = sum(map(len, roots.values()))
                    draw(roots[w], py.ROOT_DISCOUNT, (py.STRENGTH + py.ROOT_DISCOUNT * every) * even)
        if sweep >= sweeps:
            for c in contexts:
                n, t = sum(v for p, v in pairs.items() if p[0] == c), sum(len(x) for p, x in tables.items() if p[0] == c)
                for w in words:
                    own = pairs[c, w] - discount * len(tables[c, w]) if (c, w) in pairs else 0
                    total[c, w] += (own + (py.STRENGTH + discount * t) * root(w)) / (py.STRENGTH + n) / kept
    return total


def test_scores_equal_those_of_a_plain_sampler(spark, monkeypatch):
    """Every word has its own restaurant here; both samplers draw, so sums over texts agree nearly."""
    monkeypatch.setattr(py, "BURN_IN", 12)
    monkeypatch.setattr(py, "KEPT", 16)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d e f g".split(), [8, 5, 3, 2, 1, 1, 1], k=12)) for _ in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in py.lm_scores(docs, F.lit(False), part_tokens=80).collect()}
    train = [[*t.encode().split(), py.END] for t in texts]
    pairs = Counter(p for text in train for p in zip([None, *text[:-1]], text))
    ones, twos = (sum(n == k for n in pairs.values()) for k in (1, 2))
    discount = float(np.clip((ones + 0.5) / (ones + 2 * twos + 1), 0.05, 0.95))
    chance = _plain_sampler(train, 10, 40, discount, rng)
    want = [sum(math.log10(chance[p]) for p in zip([None, *t[:-1]], t)) for t in train]
    assert sum(found.values()) == pytest.approx(sum(want), rel=0.02)
    assert np.corrcoef([found[i] for i in range(16)], want)[0, 1] > 0.97


def test_texts_that_occur_twice_score_apart(spark):
    """Rare words have contexts too: a text of them that the model has met twice is likelier than one met once."""
    rng = random.Random(7)
    fresh = lambda: " ".join(f"r{rng.randrange(10**7)}" for _ in range(40))
    once, twice = [fresh() for _ in range(60)], [fresh() for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(once + twice + twice)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in py.lm_scores(docs, F.lit(False), contexts=20, restaurants=4096).collect()}
    assert min(found[60 + i] for i in range(60)) > max(found[i] for i in range(60))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "z " * 40_000), (4, "t t"), (4, "t t"), (None, "q")], "doc_id long, text string").withColumn("part", F.lit(1))
    found = py.lm_scores(docs, F.lit(False)).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 2, 3, 3, 40_001] and all(r.n_known == r.n_tokens for r in found)
    assert py.lm_scores(docs.limit(0), F.lit(False)).count() == 0
    unseen = py.lm_scores(docs, F.lit(True)).collect()
    assert len(unseen) == 6 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in unseen)
