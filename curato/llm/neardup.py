"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's three-word shingles are labelled by their occurrence. Each of several hash functions picks the text's smallest
labelled shingles, which are kept in text order and hashed to a key: texts share a key with a probability that follows
their edit similarity, as shared shingles must also stand in the same order. Short texts have each shingle as a key besides. Texts with a key in common are candidates;
an alignment within the band that the similarity allows decides. A first round links the texts of a key by hubs; of a key whose
texts that leaves in different classes, all pairs of different classes are compared, or ruled out by the words that they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm.common import components, hash_words, join_counted, materialise, mix, node_of, pieces, raw, real_id

SHINGLE = 3
#: Keys of a text, and smallest shingles in a key.
BANDS, PICKED = 32, 2
SIMILARITY = 0.8
#: Texts of fewer words have all their shingles as keys too, and those of at most ``TINY`` words their word pairs: one of
#: these is in both of two such texts of similarity 0.8, wherever the edits are.
SHORT, TINY = 20, 5
#: Into so many parts a key's texts are dealt before each part is linked to one of its texts, and these to one another.
PARTS = 64
#: Texts, and words in all, of a block of a key's texts, about; blocks are held against each other.
BLOCK, BLOCK_WORDS = 1024, 2_000_000
#: Buckets of a text's words, each occurrence of a word being one of its own.
BUCKETS = 4096

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLY)
_ODD = mix(_SEEDS) | np.uint64(1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words."""
    return hash_words(pa.array([text], pa.binary()))[0]


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in order; fewer words than ``size``, but not none, are one shingle."""
    size = min(size, len(words))
    if not size:
        return words
    out = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        out = mix(out * _MULTIPLY + words[i : len(words) - size + 1 + i])
    return out


def bands_of(words: np.ndarray) -> np.ndarray:
    """The text's Order MinHash keys, one for each hash function; none for a text without words."""
    found = shingles(words)
    if not len(found):
        return np.zeros(0, np.int64)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
    occurrence = np.empty(len(found), np.uint64)
    occurrence[order] = np.arange(len(ranked)) - starts
    labelled = mix(found + occurrence * _MULTIPLY)
    # The labels are scrambled already: one multiplication by an odd number draws anew for each hash function.
    drawn = (labelled[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    picked, rows = min(PICKED, len(found)), np.arange(BANDS)
    places = np.empty((BANDS, picked), np.int64)
    for i in range(picked):
        places[:, i] = drawn.argmin(axis=1)
        drawn[rows, places[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    places.sort(axis=1)
    keys = _SEEDS.copy()
    for i in range(picked):
        keys = mix(keys * _MULTIPLY + labelled[places[:, i]])
    return keys.view(np.int64)


def keys_of(words: np.ndarray, bands: np.ndarray | None = None) -> list[int]:
    """The keys of the hash functions and, for a short text, those of its shingles."""
    keys = bands_of(words) if bands is None else bands
    if 0 < len(words) < SHORT:
        more = [mix(shingles(words, size)).view(np.int64) for size in ((SHINGLE, 2) if len(words) <= TINY else (SHINGLE,))]
        keys = np.unique(np.concatenate((keys, *more)))
    return keys.tolist()


def marks(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that hold an occurrence of a word, occurrences beyond one in each bucket) of each text.

    The buckets that two texts have in common and the lesser of the numbers beyond are at least as many as the words they share.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    text, flat = np.repeat(np.arange(len(words)), sizes), np.concatenate([*words, np.zeros(0, np.uint32)]).astype(np.uint64)
    order = np.lexsort((flat, text))
    text, flat = text[order], flat[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(flat))
    occurrence = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    found = np.zeros((len(words), BUCKETS), np.float32)
    found[text, (mix(flat + occurrence * _MULTIPLY) % np.uint64(BUCKETS)).astype(np.int64)] = 1
    return found, sizes - found.sum(axis=1).astype(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The number of words to insert, delete or replace, or ``most`` + 1 if it is more, within a band of diagonals."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return min(max(len(a), len(b)), most + 1)
    values, counts = np.unique(np.concatenate((a, b)), return_inverse=True)
    gap = np.bincount(counts[: len(a)], minlength=len(values)) - np.bincount(counts[len(a) :], minlength=len(values))
    if max(gap[gap > 0].sum(), -gap[gap < 0].sum()) > most:
        return most + 1
    a, b = a.tolist(), b.tolist()
    few = min(most, 10)
    found = _furthest(a, b, few)
    return found if found <= few or most <= few else _banded(a, b, most)


def _furthest(a: list[int], b: list[int], most: int) -> int:
    """Edit distance by furthest points on each diagonal, for few edits."""
    n, m = len(a), len(b)
    reach: dict[int, int] = {}
    for e in range(most + 1):
        now = {}
        for d in range(-e, e + 1):
            x = max(reach.get(d - 1, -2) + 1, reach.get(d, -2) + 1, reach.get(d + 1, -2)) if e else 0
            x = min(x, n, m + d)
            if x < 0 or x - d < 0:
                continue
            while x < n and x - d < m and a[x] == b[x - d]:
                x += 1
            if x == n and x - d == m:
                return e
            now[d] = x
        reach = now
    return most + 1


def _banded(a: list[int], b: list[int], most: int) -> int:
    """Edit distance within ``most`` diagonals of the main one, a column of the band at a time as bits of integers.

    After Hyyro (2003): the bits say where the next row of a column is larger (``up``) or smaller (``down``). Bit i of
    the band stands for row j - most + i in column j, so the band moves down a row with each column.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * most + 1
    full = (1 << width) - 1
    # In column 0 each row below the first is larger by one.
    up, down = full >> most << most, 0
    middle = 1 << most
    distance = 0
    for j in range(m):
        shift = j - most
        mask = where.get(b[j], 0)
        same = (mask >> shift if shift >= 0 else mask << -shift) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        distance += not diagonal & middle
        if distance > most + abs(n - m):
            return most + 1
        moved = diagonal >> 1
        up = (right_down | ~(moved | right_up)) & full
        down = moved & right_up
    # From the main diagonal's end, row m of the last column, along the column to row n.
    at, steps = most, n - m
    while steps > 0:
        distance += (up >> at & 1) - (down >> at & 1)
        at, steps = at + 1, steps - 1
    while steps < 0:
        at -= 1
        distance -= (up >> at & 1) - (down >> at & 1)
        steps += 1
    return min(distance, most + 1)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - edits / words of the longer text, or 0 if that is under ``least``."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    edits = edit_distance(a, b, most)
    return 1 - edits / longest if longest and edits <= most else 0.0


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, sha, size, bands, keys) of every row; size is in words."""
    sha = F.substring(F.unhex(F.sha2(raw(text), 256)), 1, 16)
    rows = docs.select(node_of(doc_id, text).alias("node"), sha.alias("sha"), raw(text).alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 2):
            found, bounds = hash_words(piece.column(2))
            words = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            bands = [bands_of(w) for w in words]
            columns = [
                pa.array(np.diff(bounds), pa.int32()),
                pa.array([x.tobytes() or bytes(8 * BANDS) for x in bands], pa.binary()),
                pa.array(map(keys_of, words, bands), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["node", "sha", "size", "bands", "keys"])

    return rows.mapInArrow(sketch, "node:long,sha:binary,size:int,bands:binary,keys:array<long>")


def _linked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each row of (``by``, node, draw) with the first node of its group."""
    return rows.withColumn("first", F.first("node").over(Window.partitionBy(*by).orderBy("draw", "node")))


def candidates(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a key, for the first round: never all pairs of one.

    The nodes of a key are dealt into parts by a hash. Each is paired with its part's first node, in an order drawn once
    for all keys, and the parts' firsts with the first of them: near-duplicates share many keys, and have few hubs in them.
    """
    rows = keyed.select("key", "node", F.xxhash64("node").alias("draw"), F.pmod(F.xxhash64("node", F.lit("part")), F.lit(PARTS)).alias("part"))
    parts = _linked(rows, ["key", "part"])
    firsts = _linked(parts.where("node = first").select("key", "node", "draw").distinct(), ["key"])
    pairs = parts.select("node", "first").unionByName(firsts.select("node", "first")).where("node != first")
    return pairs.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, blocks) of the rows (key, node, size) whose key has nodes of different labels, and how many blocks it makes."""
    tagged = materialise(rows.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label")), "tagged")
    keys = tagged.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n_key"), F.sum("size").alias("words"))
    blocks = F.ceil(F.greatest(F.col("n_key") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("int")
    keys = materialise(keys.where("low < high").select("key", "n_key", blocks.alias("blocks")), "keys")
    return materialise(join_counted(tagged.drop("size"), keys, "key", tagged.count()), "mixed")


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def compared(key: int, alike: bool, left: tuple, right: tuple, least: float) -> list[tuple[int, int]]:
    """Similar pairs of (nodes, labels, bands, words) of two blocks of a key, or of one with itself, that join all the labels which similar pairs join.

    Pairs that share too few words are ruled out, and pairs that share several hash functions' keys are compared in the first of
    these. The others are aligned, those that share most words first, if no pair before has joined their labels.
    """
    (nodes, labels, bands, words), (nodes2, labels2, bands2, words2) = left, right
    known, place = np.unique(np.concatenate((labels, labels2)), return_inverse=True)
    own, other, up = place[: len(labels)], place[len(labels) :], list(range(len(known)))
    bits, beyond = marks(words)
    bits2, beyond2 = (bits, beyond) if alike else marks(words2)
    common = bits @ bits2.T + np.minimum(beyond[:, None], beyond2[None, :])
    longest = np.maximum(*(np.array([len(w) for w in ws], np.int64).reshape(shape) for ws, shape in ((words, (-1, 1)), (words2, (1, -1)))))
    maybe = (longest - common <= (1 - least) * longest + 1e-9) & (own[:, None] != other[None, :])
    x, y = np.nonzero(np.triu(maybe, 1) if alike else maybe)
    order = np.argsort(longest[x, y] - common[x, y], kind="stable")
    found = []
    for at in np.array_split(order, len(order) // 20_000 + 1):
        shared = bands[x[at]] == bands2[y[at]]
        at = at[(bands[x[at], shared.argmax(axis=1)] == key) | ~shared.any(axis=1)]
        for i, j in zip(x[at].tolist(), y[at].tolist()):
            a, b = _root(up, int(own[i])), _root(up, int(other[j]))
            if a != b and similarity(words[i], words2[j], least):
                up[max(a, b)] = min(a, b)
                found.append((int(nodes[i]), int(nodes2[j])))
    return found


def remaining(rows: DataFrame, keyed: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(a, b): similar pairs of nodes of a key that join all labels which its similar pairs join.

    The nodes of a key are dealt into blocks by a hash, and every two blocks are rows of their own, so that no key is one
    task's and a task holds two blocks at a time.
    """
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    held = rows.select("key", "node", "label", "blocks", at.alias("at")).join(keyed.select("node", "bands").hint("merge"), "node").join(words.hint("merge"), "node")
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("at"), k).alias("i"), F.greatest(F.col("at"), k).alias("j")))
    dealt = held.select("key", "node", "label", "at", "bands", "words", F.explode(both).alias("s")).select("key", "s.*", "node", "label", "at", "bands", "words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), block in _runs(batches):
            nodes, labels, place = (block.column(c).to_numpy() for c in ("node", "label", "at"))
            bands = np.frombuffer(b"".join(block.column("bands").to_pylist()), np.int64).reshape(len(nodes), -1)
            words = [np.frombuffer(w, np.uint32) for w in block.column("words").to_pylist()]
            left, right = ((nodes[p], labels[p], bands[p], [words[x] for x in p.tolist()]) for p in (np.flatnonzero(place == i), np.flatnonzero(place == j)))
            pairs = np.array(compared(key, i == j, left, right, least), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a:long,b:long").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The rows of each (key, i, j), which follow each other."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        which = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        bounds = [0, *(np.flatnonzero((which[:, 1:] != which[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            now = tuple(which[:, low].tolist())
            if held and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield last, pa.Table.from_batches(held)


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) after further links (a, b): only labels that a link joins are looked at again."""
    own = lambda node: labels.select(F.col("node").alias(node), F.col("label").alias(f"{node}_label"))
    ends = links.select("a", "b").join(own("a").hint("merge"), "a", "left").join(own("b").hint("merge"), "b", "left")
    ends = materialise(ends.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")), "ends")
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("further"))
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("label")), F.struct(F.col("b").alias("node"), F.col("y").alias("label")))).alias("s")).select("s.*").where("node = label").distinct()
    every = labels.unionByName(fresh.join(labels.select("node").hint("merge"), "node", "left_anti"))
    return materialise(every.join(joined.hint("merge"), "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")


def known_words(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, words) of the documents in pairs, words as 32 bits each."""
    # A table of its own, so that Spark knows its size: few nodes are broadcast, and no texts are shuffled then.
    ends = (pairs.select(F.col(end).alias("node")).distinct() for end in ("a", "b"))
    nodes = materialise(next(ends).union(next(ends)).distinct(), "nodes")
    texts = docs.select(node_of(doc_id, text).alias("node"), raw(text).alias("t")).join(nodes, "node", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):
            found, bounds = hash_words(piece.column(1))
            data, ends = found.astype(np.uint32).tobytes(), (4 * bounds).tolist()
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["node", "words"])

    return materialise(texts.mapInArrow(hashed, "node:long,words:binary"), "words")


def verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """The pairs whose texts are similar enough, with their similarity."""
    words = known_words(pairs, docs, doc_id, text)
    left = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("x")).hint("merge"), "a")
    # A hub has many partners, a partner few hubs: joined by the partner last, alignments are spread evenly.
    both = left.join(words.select(F.col("node").alias("b"), F.col("words").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [similarity(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(align, "a:long,b:long,similarity:double").where(F.col("similarity") >= least)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(node, label, n_links) for every row, where a node is an id or stands for a null one's text."""
    rows = materialise(sketches(docs, doc_id, text), "sketches")
    total = rows.count()
    reps = materialise(rows.groupBy("sha").agg(F.min("node").alias("rep"), F.count("*").alias("n_key")), "texts")
    # Representatives are a table of their own, so that Spark knows its size: few are broadcast.
    keyed = rows.join(reps.select(F.col("rep").alias("node"), "sha"), ["node", "sha"]).select("node", "size", "bands", "keys")
    keyed = materialise(keyed, "keyed")
    left = keyed.select("node", "size", F.explode("keys").alias("key")).distinct()
    links = materialise(verified(materialise(candidates(left), "pairs"), docs, doc_id, text, least).select("a", "b"), "links")
    labels = components(links)
    rest = mixed(left, labels)
    words = known_words(rest.select(F.col("node").alias("a"), F.col("node").alias("b")), docs, doc_id, text)
    more = materialise(remaining(rest, keyed, words, least), "links")
    if more.limit(1).count():
        links, labels = links.unionByName(more), relabelled(labels, more)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    made = reps.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(degree, "rep", "left")
    made = materialise(made.select("sha", "n_key", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return join_counted(rows.select("sha", "node"), made, "sha", total).select("node", "label", "n_links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the class is the smallest id that the row's text is linked with.

    Equal texts are one class before anything else, a null text being empty; texts without words are like nothing else.
    Ids are whole numbers; rows with one id count as one document, so that their texts share a class; a null id stands
    for the text, and a class of such rows alone has no id. A class is a component of all similar pairs that share a key:
    a first round compares few pairs of each key, and of what that leaves in different classes every pair is compared or
    ruled out, however many texts a key has. Links are the distinct similar texts met on the way for the row's own: pairs of
    one class are not all compared, so they are at most the similar texts there are. An empty table gives no rows.
    """
    return classes(docs, doc_id, text, least).select(real_id("node").alias("doc_id"), real_id("label").alias("class_id"), "n_links")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, the one with the smallest id, with its own columns; of rows with that id, one.

    Rows without an id come after those with one. Null, empty and repeated texts are as in ``near_duplicates``.
    """
    found = materialise(classes(docs.select("doc_id", "text"), **options), "found")
    kept = found.where("node = label").select("node").distinct()
    rows = docs.select(F.struct("*").alias("row"), node_of("doc_id", "text").alias("node")).join(kept.hint("merge"), "node", "left_semi")
    one = Window.partitionBy("node").orderBy(F.col("row.text"))
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
