import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curato.llm import common, decontaminate, pii, tokenfile


def _odd_docs(spark):
    """Null, empty, long and repeated texts, and a column whose name clashes."""
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b " * 20_000, None), (4, "same", "z"), (4, "same", "z"), (None, "no id here", "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, hit string")


def test_word_hashes_stand_for_the_words():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "Bé", "c1", "d-e", "日本", "A", "x" * 40]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", " ", "x" * 700_000 + " y", "é"]
    array = pa.array([t.encode() for t in texts], pa.binary())
    seen: dict = {}
    at = 0
    for piece in common.pieces(iter([pa.RecordBatch.from_arrays([array], ["t"])]), 0):
        hashes, bounds = common.hash_words(piece.column(0))
        for a, b in zip(bounds[:-1], bounds[1:]):
            words = common.words_of(texts[at].encode())
            assert len(words) == b - a
            for word, found in zip(words, hashes[a:b].tolist()):
                assert seen.setdefault(word, found) == found
            at += 1
    assert at == len(texts) and len(set(seen.values())) == len(seen)
    assert len(common.hash_words(pa.array([], pa.binary()))[0]) == 0


def test_wu_manber_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["aa", "bb", "cc", "Dé", "e1"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for i in range(12)]
    docs = [(i, ", ".join(rng.choices(words, k=rng.randint(0, 80))) + rng.choice(["", " " + rng.choice(items)[1]])) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):
        found = decontaminate.find_contamination(d, b, block_bytes=block).collect()
        for row in found:
            n_words, n_hit, n_items, sha = decontaminate.brute_force(row.text, items)
            own = (row.hit.n_words, row.hit.n_hit, len(row.hit["items"]), hashlib.sha256(",".join(row.hit["items"]).encode()).hexdigest())
            assert own == (n_words, n_hit, n_items, sha)


def test_decontamination_of_odd_rows(spark):
    b = spark.createDataFrame([(1, "same"), (2, None)], "item_id long, text string")
    docs = _odd_docs(spark)
    kept = decontaminate.decontaminate(docs, b)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert decontaminate.decontaminate(docs, b.limit(0)).count() == 6
    assert decontaminate.decontaminate(docs.limit(0), b).count() == 0


@pytest.mark.parametrize("bits,n", [(1, 9), (4, 0), (4, 1), (16, 3000)])
def test_wavelet_matrix(bits, n):
    ids = np.random.default_rng(n).integers(0, min(1 << bits, 40), n).astype(np.uint32)
    shard = tokenfile.Shard(np.array([7]), np.array([n]), tokenfile.WaveletMatrix.build(ids, bits))
    back = tokenfile.Shard.from_bytes(shard.to_bytes())
    assert back.matrix.decode().tolist() == ids.tolist()
    assert [back.matrix.access(i) for i in range(min(n, 300))] == ids[:300].tolist()
    for token in set(ids[:20].tolist()) | {0}:
        places = np.flatnonzero(ids == token)
        assert back.matrix.count(token) == len(places)
        assert back.matrix.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())
        for k in range(0, len(places), 17):
            assert back.matrix.occurrence(token, k) == places[k]
        assert back.matrix.occurrence(token, len(places)) == -1


def test_pieces_encode_as_the_whole_text():
    encoder = tokenfile.Encoder(tokenfile.tokenizer_path())
    for text in ["a b", " a  b\n c ", "don't we'll x", "été  là\t\n\n z", "", "<|endoftext|> a", "1 22  333", "a\x1c b", "日本 語 ½ ²", "\nab\ncd, ef!!\n", "x.\n\ny ", "don't, we''ll. a's", "a_b_, c1. d²! \0e f\0", " lead", "trail ", "!! ?? ..", "a\u00a0b c\u00a0 d", "é, É!"]:
        whole = encoder.inner.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text])[0].tolist() == [*whole, tokenfile.END]


def test_added_tokens_encode_as_by_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    fresh, encoder = Tokenizer.from_file(tokenfile.tokenizer_path()), tokenfile.Encoder(tokenfile.tokenizer_path())
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    for text in ["plain words, no token", *(form.format(t) for t in added for form in ("x {} y", "{}", "a{0}b {0}\n\nc", "x {} "))]:
        assert encoder.encode([text])[0].tolist() == [*fresh.encode(text, add_special_tokens=False).ids, tokenfile.END]


def test_token_shards_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "x y " * 9000), (5002, "tie"), (-1, "minus"), (-9, "less"), (None, "no id"), (None, "no id"), (None, None)], docs.schema)
    docs = docs.unionByName(odd)
    rows = tokenfile.read_documents(tokenfile.write_shards(docs, shard_tokens=3000)).orderBy("start").collect()
    from tokenizers import Tokenizer

    fresh, at = Tokenizer.from_file(tokenfile.tokenizer_path()), 0
    first = {r.text: r.h for r in odd.where("doc_id IS NULL").select("text", F.xxhash64("text").alias("h")).collect()}
    order = lambda r: (r.doc_id is not None, r.doc_id or 0, 0 if r.doc_id is not None else first[r.text], r.text is not None, r.text)
    for row, doc in zip(rows, sorted(docs.collect(), key=order), strict=True):
        ids = np.array([*fresh.encode(doc.text or "", add_special_tokens=False).ids, tokenfile.END])
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
    assert tokenfile.read_documents(tokenfile.write_shards(docs.limit(0))).count() == 0


TEXTS = [
    None, "", "a@b.c", "x@y", "a@b.c@d.e", "@@a@b..c a@-.x", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 01.02.03.004", "4111 1111 1111 1111",
    "4111-1111-1111-1112", "+1 (234) 567-8901 +12", "é" * 5 + " j@k.lm 9.9.9.9", "1" * 3000, "a" * 3000 + "@", "++++1 2 3 4 5 6 7 8 9", "1  2",
]


def test_plain_spans_equal_the_patterns(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in texts:
        assert pii.joined(pii.base_spans(text or "")) == pii.brute_force(text)[0]


@pytest.mark.parametrize(
    "text,found",
    [
        ("mail john (at) foo [dot] com ok", [("email", "john (at) foo [dot] com")]),
        ("john at foo dot com", [("email", "john at foo dot com")]),
        ("call plus four nine one two three four five six seven eight nine.", [("phone", "plus four nine one two three four five six seven eight nine")]),
        ("ｊohn@fоо.com x", [("email", "ｊohn@fоо.com")]),
        ("pay " + "four" + " one" * 15, [("card", "four" + " one" * 15)]),
        ("ip 192[.]168[.]1[.]1!", [("ip", "192[.]168[.]1[.]1")]),
        ("we met at noon and the dot was one two three", []),
        ("write john at foo.com now", [("email", "john at foo.com")]),
        ("jane@foo dot com", [("email", "jane@foo dot com")]),
        ("\U0001d423ohn@fo\u200bo.com!", [("email", "\U0001d423ohn@fo\u200bo.com")]),
        ("tel +four 9 one two 3 four double five six 7", [("phone", "+four 9 one two 3 four double five six 7")]),
        ("ip one nine two dot one six eight dot 1 dot one ok", [("ip", "one nine two dot one six eight dot 1 dot one")]),
        ("192 dot one six eight dot 1 dot 1", [("ip", "192 dot one six eight dot 1 dot 1")]),
        ("+\u0664\u0669 123 456 7890", [("phone", "+\u0664\u0669 123 456 7890")]),
        ("look at the dot com", []),
    ],
)
def test_disguises_map_to_the_source(text, found):
    spans = pii.all_spans(text)
    if text.startswith("look"):
        assert all(k == "email" for k, _, _ in spans)
    else:
        assert [(k, text[s:e]) for k, s, e in spans] == found
    assert set(pii.base_spans(text)) <= set(spans)


def test_disguises_by_brute_force():
    """Plain identifiers, disguised piece by piece at random between plain words, are found where they were put."""
    rng = random.Random(6)
    names = "zero one two three four five six seven eight nine".split()
    strange = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "m": "\U0001d426", "1": "\uff11", "n": "n\u200b"}
    filler = lambda: " ".join(rng.choice(["the", "a", "house", "été", "42", "run,", "low."]) for _ in range(rng.randint(1, 6)))
    for _ in range(400):
        kind = rng.choice(pii.KINDS)
        if kind == "email":
            parts = ["joe.mann", rng.choice(["@", " at ", " (at) ", "[at]"]), "acme", rng.choice([".", " dot ", " [dot] "]), "com"]
            glyph = rng.random() < 0.5
            hidden = "".join(strange.get(c, c) if glyph and c.isalpha() and part not in (" at ", " dot ", " (at) ", "[at]", " [dot] ") and rng.random() < 0.5 else c for part in parts for c in part)
        elif kind == "ip":
            dot = rng.choice([".", " dot "])
            hidden = dot.join(" ".join(names[int(d)] for d in str(n)) if rng.random() < 0.5 else str(n) for n in (10, 2, 255, rng.randrange(256)))
        else:
            digits = "4111111111111111" if kind == "card" else "".join(rng.choice("23456789") for _ in range(11))
            hidden = ("+" if kind == "phone" else "") + " ".join(names[int(d)] if rng.random() < 0.7 else d for d in digits)
        before = filler() + ". So: "
        text = before + hidden + " ! " + filler()
        start = len(before)
        found = pii.all_spans(text)
        assert any(k == kind and s <= start < e and abs(e - start - len(hidden)) <= 1 and s >= start - 1 for k, s, e in found) or (kind, start, start + len(hidden)) in found, (text, found)
        assert set(pii.base_spans(text)) <= set(found)


def test_pii_of_odd_rows(spark):
    docs = _odd_docs(spark).withColumn("pii", F.lit(1))
    rows = pii.find_pii(docs).collect()
    assert len(rows) == 6 and all(r.pii.spans == "" for r in rows)


def test_no_character_beside_a_spelled_digit_is_an_error():
    for c in map(chr, (p for p in range(0x11000) if not 0xD800 <= p < 0xE000)):
        if c.lower() != c or c.upper() != c or c < "⺀":
            for text in (f"f{c}ve six one five", f"five {c}ix one two {c}"):
                assert all(0 <= s < e <= len(text) for _, s, e in pii.all_spans(text))


def test_random_texts_are_no_error():
    rng = random.Random(12)
    bits = ["five", "SIX", "zéro", "fünf", " at ", " dot ", ".", "@", "-", " ", "+", "plus ", "double ", "(at)", "[dot]", "example", "org", "7", "İ", "ſ", "K", "ß", "日", "🙂", "​", "٣", "İve"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) if rng.random() < 0.9 else chr(rng.randrange(0xD800)) for _ in range(rng.randrange(14)))
        plain = pii.base_spans(text)
        found = pii.all_spans(text, plain)
        assert set(plain) <= set(found) and all(0 <= s < e <= len(text) for _, s, e in found)


def test_prose_with_at_is_no_address():
    prose = ["Meet us at example.org today", "You can look at www.example.com", "It was published at news.example.net.", "They are online at example.de", "see more at example.com/x"]
    for text in prose:
        assert pii.all_spans(text) == [], text
    for name in ("john", "jane.doe", "sales", "r2d2", "m_m"):
        for host in ("example.org", "mail dot example dot com"):
            text = f"write {name} at {host} now"
            assert pii.all_spans(text) == [("email", 6, 6 + len(name) + 4 + len(host))], text
