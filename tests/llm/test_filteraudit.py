import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest

from curato.llm import filteraudit


def brute_profile(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))


def _profiles(texts):
    found = filteraudit.profile(pa.array([t.encode() for t in texts], pa.binary()))
    return list(zip(*(found[n].tolist() for n in filteraudit._ARROW.names)))


@pytest.mark.parametrize("window", [8, 64, 1 << 18])
def test_transducer_equals_plain_counts(monkeypatch, window):
    monkeypatch.setattr(filteraudit, "WINDOW", window)
    rng = random.Random(window)
    bits = ["a", "b", "A ", " ", "\n", "\x0b", " ", "é", "#", "ß ", "日本", " ", "longer", "\x00", "🙂", *("x" * n for n in (1, 9, 17, 63, 64, 65, 70))]
    for _ in range(200):
        texts = ["".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(rng.randrange(10))]
        assert _profiles(texts) == [brute_profile(t) for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filteraudit.Words, "_hash", lambda self, starts, lengths, docs: (starts * 0 + 7).astype("uint64"))
    texts = [" ".join(f"{'p' * (i % 90)}{i % 13}" for i in range(300)), "a b a", "a b a"]
    assert _profiles(texts) == [brute_profile(t) for t in texts]


def test_long_texts_and_words():
    rng = random.Random(2)
    texts = ["", " ".join(f"w{rng.randrange(50000)}" for _ in range(300_000)), "y" * 3_000_000 + " y", "tail tail"]
    assert _profiles(texts) == [brute_profile(t) for t in texts]


def brute_audit(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    said = {c: {d for d, *values in labels if d is not None and values[i] == 1} for i, c in enumerate(("good", "toxic"))}
    rows = []
    for doc_id, text, lang in docs:
        words, distinct, capitals, points, symbols = brute_profile(text or "")
        fails = "".join(
            name for name, bad in zip("ABCDE", (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0, doc_id is not None and doc_id > first[text or ""])) if bad
        )
        rows.append((lang or "", fails, doc_id in said["good"], doc_id in said["toxic"]))
    removed_by, out = Counter(), {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(5):
                before, now = set(order[:step]), order[step]
                gone = [r for r in own if now in r[1] and not before & set(r[1])]
                out[(part, order, step + 1)] = [
                    sum(now not in r[1] and not before & set(r[1]) for r in own), len(gone), sum(now in r[1] and bool(before & set(r[1])) for r in own),
                    sum(r[1] == now for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                removed_by[(part, now)] += len(gone)
    return {key: (*v, removed_by[(key[0], key[1][key[2] - 1])]) for key, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(n)}" for _ in range(rng.choice([20, 120, 150]))) + rng.choice(["", " $", " ABC" * 30]) for n in (30, 400, 4000) for _ in range(12)]
    docs = [(i, rng.choice(texts + [None, ""]), rng.choice(["en", "de", None])) for i in range(200)]
    docs += [(i, texts[0], rng.choice(["en", "fr"])) for i in range(1000, 1150)] + [(None, texts[0], "en"), (None, texts[0], "en"), (0, texts[0], "en"), (0, texts[0], "en"), (3, texts[0], "de"), (7, "", "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    frame = spark.createDataFrame([(*d, 5, "clash") for d in docs], "doc_id long, text string, lang string, failed int, part string").repartition(4)
    counts = filteraudit.failure_counts(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.interactions(counts).collect()}
    assert found == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.interactions(filteraudit.failure_counts(docs, labels)).count() == 0
