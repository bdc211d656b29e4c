"""LM scoring by a hierarchical Pitman-Yor model of word pairs.

Every frequent word has a context restaurant for the words that follow it; rarer words share restaurants by their hash,
and starts of texts have one. All context restaurants have the same parent, a restaurant over words, whose base measure
is half for unknown words and even over the rest. Customers (training tokens) are seated at tables by Gibbs sampling, a
table being a customer of the parent, where it is seated in turn. A text's probability is averaged over kept seatings,
token by token.

Pairs are dealt by a hash of the second word, those of words with a thousandth of all tokens by a hash of both, so no
task gets all of one. Tasks pass arrays, packed for each part. What all parts need comes from sums over contexts and
over those frequent words, both of bounded number; counts of words and pairs grow with the corpus and stay in parts.
Within a sweep a part sees the other parts' tables as they were before it.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.llm.common import materialise, mix, pieces, raw, tokens_of

#: Words with a context restaurant of their own, found by counts over the whole corpus, and restaurants that the others
#: share: together as many as two bytes tell apart, so that messages stay short; more are possible.
CONTEXTS, SHARED = 40_960, 24_000
#: Tokens in a part, about; tokens in a message for a part, about, and in the batch of texts that makes the messages.
PART_TOKENS = 3_000_000
MESSAGE_TOKENS, BATCH_TOKENS = 500, (500_000, 4_000_000)
#: Sweeps before the first kept one and kept ones; pairs of up to so many customers are swept together, those of more one after another; draws made at a time.
BURN_IN, KEPT, TOGETHER, DRAWS = 2, 2, 64, 1 << 16
STRENGTH, ROOT_DISCOUNT = 1.0, 0.8
UNKNOWN = 0.5
END = b"\n"
#: Bits of a context's number, and numbers in a block of sums.
BITS, BLOCK = 20, 1 << 14

_M = np.uint64(0x9E3779B97F4A7C15)


def pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, 5))


def unpack(content: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(content))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def common_words(docs: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int, int]:
    """The most frequent training words with their counts, the number of training tokens and of training texts.

    Tasks count words and pass all counts on whenever they hold half a million; Spark adds them up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        texts = total = 0
        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist()):
                if not held:
                    words = tokens_of(text.as_py())
                    counts.update(words)
                    texts, total = texts + 1, total + len(words) + 1
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts = Counter()
        counts.update({b" texts": texts, b" tokens": total})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = materialise(docs.select("t", "held").mapInArrow(count, "word:binary,n:long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = {bytes(r.word): r.n for r in found.where(F.col("word").isin(b" texts", b" tokens")).collect()}
    words = found.where(~F.col("word").isin(b" texts", b" tokens")).withColumn("size", F.floor(F.log("n") * 50))
    # Classes of nearly equal counts tell from which count on there are enough words: little more than those is collected.
    classes = sorted(((r["size"], r["count"]) for r in words.groupBy("size").count().collect()), reverse=True)
    least, enough = 0, 0
    for least, n in classes:
        enough += n
        if enough >= most:
            break
    top = [(bytes(r.word), r.n) for r in words.where(F.col("size") >= least).select("word", "n").collect()] if classes else []
    top = sorted(top, key=lambda r: (-r[1], r[0]))[:most] + ([(END, sums[b" texts"])] if sums.get(b" texts") else [])
    return sorted(top, key=lambda r: (-r[1], r[0])), sums.get(b" tokens", 0), sums.get(b" texts", 0)


class Layout:
    """What tasks need to know to deal tokens: the contexts, how many of them are hot words, the number of parts."""

    def __init__(self, top: list[tuple[bytes, int]], tokens: int, part_tokens: int, shared: int):
        self.index = {w: i for i, (w, _) in enumerate(top)}
        self.hot = sum(n * 1000 >= tokens for _, n in top)
        self.hot_hashes = np.array([xxhash.xxh64_intdigest(w) for w, _ in top[: self.hot]], np.uint64)
        self.own, self.shared, self.start, self.size = len(top), shared, len(top) + shared, len(top) + shared + 1
        self.parts = max(1, -(-tokens // part_tokens))
        self.batch_tokens = min(max(MESSAGE_TOKENS * self.parts, BATCH_TOKENS[0]), BATCH_TOKENS[1])

    def contexts(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The context restaurants of words."""
        found = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        return np.where(found >= 0, found, self.own + (mix(hashes ^ _M) % np.uint64(self.shared)).astype(np.int64))

    def cut(self, texts: list[bytes], with_docs: bool):
        """Yields (part, distinct word hashes, runs, contexts, counts, docs) for a batch of texts."""
        ids, lengths, flat = _Ids(), [], []
        for text in texts:
            words = tokens_of(text)
            words.append(END)
            flat.extend(map(ids.__getitem__, words))
            lengths.append(len(words))
        if not flat:
            return
        word = np.array(flat, np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        context = self.contexts(list(ids), hashes)
        before = np.concatenate(([0], context[word[:-1]]))
        before[np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(int)] = self.start
        dealt = hashes[word]
        hot = context[word] < self.hot
        dealt[hot] = mix(dealt[hot] + (before[hot].astype(np.uint64) + np.uint64(1)) * _M)
        part = (mix(dealt) % np.uint64(self.parts)).astype(np.int64)
        # By part, word, context and text: two numbers, as one may not hold them all.
        high, low = part * len(ids) + word, before * (len(texts) + 1)
        if with_docs:
            low += np.repeat(np.arange(len(texts)), lengths)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
        counts = np.diff(np.concatenate((first, [len(high)])))
        high, low = high[first], low[first]
        narrow = lambda x, most: x.astype(np.uint16 if most <= 1 << 16 else np.uint32)
        doc, before = narrow(low % (len(texts) + 1), len(texts)), narrow(low // (len(texts) + 1), self.size)
        part, word = high // len(ids), high % len(ids)
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        small = np.uint8 if counts.max() < 256 else np.uint32
        for a, b in zip(edges[:-1], edges[1:]):
            own = word[a:b]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            runs = np.diff(np.concatenate((first, [b - a]))).astype(np.uint32)
            yield int(part[a]), hashes[own[first]], runs, before[a:b], counts[a:b].astype(small), doc[a:b] if with_docs else None


def _batches(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that hold about so many tokens together, as a part of the text's bytes; one row at least."""
    held, size = [], 0
    for piece in pieces(batches, 0):
        held.append(piece)
        size += piece.column(0).nbytes
        if size >= 6 * tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def pair_counts(docs: DataFrame, shared) -> DataFrame:
    """(part, content) of training pairs, counted within batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        for held in _batches(batches, layout.batch_tokens):
            texts = [t.as_py() for batch in held for t, out in zip(batch.column(0), batch.column(1).to_pylist()) if not out]
            found = [(part, pack(*arrays)) for part, *arrays in layout.cut(texts, False)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], ["part", "content"])

    return docs.select("t", "held").mapInArrow(count, "part:int,content:binary")


def _joined(contents) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted word hashes, and by pair: word, context, count."""
    parts = [unpack(c.as_py()) for c in contents]
    words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    word = np.repeat(of, np.concatenate([p[1] for p in parts]))
    key = word.astype(np.int64) << BITS | np.concatenate([p[2] for p in parts]).astype(np.int64)
    counts = np.concatenate([p[3].astype(np.int64) for p in parts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return words, key[first] >> BITS, key[first] & ((1 << BITS) - 1), np.add.reduceat(counts[order], first)


def _lookup(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted ones, -1 for those that aren't there."""
    if not len(sorted_hashes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == wanted, at, -1)


def dealt_by_part(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows dealt to as many tasks as there are parts, at least, so that a task gets few."""
    return rows.repartition(max(layout.parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")


def build_parts(counted: DataFrame, shared) -> DataFrame:
    """(part, kind, content): ``pairs`` has all pairs of a part, ``seats`` what sampling needs."""

    def build(table: pa.Table) -> pa.Table:
        layout = shared.value
        words, word, context, count = _joined(table.column("content"))
        runs = np.bincount(word, minlength=len(words)).astype(np.uint32)
        small = np.uint8 if count.max() < 256 else np.uint32
        hot = np.full(len(words), -1)
        order = np.argsort(layout.hot_hashes)
        at = _lookup(layout.hot_hashes[order], words)
        hot[at >= 0] = order[at[at >= 0]]
        many = np.flatnonzero(count >= 2)
        # By count, so that the pairs with customers left to move are the last ones.
        many = many[np.argsort(count[many], kind="stable")]
        single = count == 1
        seats = {
            "word": word[many].astype(np.int32),
            "context": context[many].astype(np.int32),
            "count": count[many],
            "single_word": np.bincount(word[single], minlength=len(words)).astype(np.int32),
            "single_context": np.bincount(context[single], minlength=layout.size),
            "word_count": np.bincount(word, count, len(words)).astype(np.int64),
            "context_count": np.bincount(context, count, layout.size).astype(np.int32),
            "hot": hot.astype(np.int32),
            "twos": int((count == 2).sum()),
            "kept": [],
            "kept_roots": [],
        }
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part, part], pa.int32()), "kind": ["pairs", "seats"], "content": [pack(words, runs, context.astype(np.uint16 if layout.size <= 1 << 16 else np.uint32), count.astype(small)), pack(seats)]})

    return dealt_by_part(counted, shared.value).groupBy("part").applyInArrow(build, "part:int,kind:string,content:binary")


def seat(count: np.ndarray, new: np.ndarray, discount: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """A first seating of each pair's customers one after another: (pair, customers) of tables.

    ``new`` is the weight of a new table. Pairs with many customers take them in growing groups.
    """
    tables, seated = np.ones(len(count), np.int64), np.ones(len(count), np.int64)
    left = np.flatnonzero(count > 1)
    while len(left):
        step = np.minimum(1 + seated[left] // 16, count[left] - seated[left])
        chance = new[left] / (new[left] + seated[left] - discount * tables[left])
        tables[left] += rng.binomial(step, np.clip(chance, 0, 1))
        seated[left] += step
        left = left[seated[left] < count[left]]
    own = np.repeat(np.arange(len(count)), tables)
    size = np.ones(len(own), np.int64)
    size[np.cumsum(tables) - tables] += count - tables
    return own, size


def reseat(own: np.ndarray, size: np.ndarray, count: np.ndarray, new: np.ndarray, discount: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """A Gibbs step for one customer of each pair, drawn at random: it leaves its table and sits down anew."""
    pairs = len(count)
    ends = np.cumsum(size)
    left = np.searchsorted(ends, np.cumsum(count) - count + np.floor(rng.random(pairs) * count).astype(np.int64), "right")
    size = size.copy()
    size[left] -= 1
    open_ = size > 0
    weight = np.where(open_, size - discount, 0.0)
    total = np.bincount(own, weight, pairs)
    drawn = rng.random(pairs) * (total + new)
    fresh = drawn >= total
    ends = np.cumsum(weight)
    start = np.concatenate(([0.0], np.cumsum(total)[:-1]))
    # Rounding may point past a pair's tables or at one that has just been left empty: the first table then.
    chosen = np.minimum(np.searchsorted(ends, start + drawn, "right"), len(own) - 1)
    first = np.searchsorted(own, np.arange(pairs))
    good = (own[chosen] == np.arange(pairs)) & open_[chosen]
    fresh |= ~good & ~open_[first]
    np.add.at(size, np.where(good, chosen, first)[~fresh], 1)
    own, size = np.concatenate((own, np.flatnonzero(fresh))), np.concatenate((size, np.ones(int(fresh.sum()), np.int64)))
    own, size = own[size > 0], size[size > 0]
    order = np.argsort(own, kind="stable")
    return own[order], size[order]


def sit_anew(size: np.ndarray, new: float, discount: float, rng) -> np.ndarray:
    """A sweep over one pair: each of its customers leaves its table and sits down anew, in an order that isn't that of the tables.

    A table is chosen by one of the other customers, drawn evenly, and taken with the share of its weight that the discount leaves.
    """
    total = int(size.sum())
    table, held = rng.permutation(np.repeat(np.arange(len(size)), size)).tolist(), size.tolist()

    def draw(n: int) -> Iterator[tuple[float, float]]:
        chair = np.minimum(rng.random(n) * (new + total - 1) - new, total - 1.5)
        return zip(chair.tolist(), (discount / (1 - rng.random(n))).tolist())

    again = iter(())
    for begin in range(0, total, DRAWS):
        for u, (chair, least) in enumerate(draw(min(DRAWS, total - begin)), begin):
            i = table[u]
            held[i] -= 1
            while chair >= 0:
                v = int(chair)
                j = table[v if v < u else v + 1]
                if held[j] >= least:
                    break
                found = next(again, None)
                if found is None:
                    again = draw(1024)
                    found = next(again)
                chair, least = found
            else:
                j = i
                if held[i]:
                    j = len(held)
                    held.append(0)
            held[j] += 1
            table[u] = j
    return np.array([n for n in held if n], np.int64)


def move_all(own: np.ndarray, size: np.ndarray, count: np.ndarray, new: np.ndarray, discount: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """A sweep: as many Gibbs steps for each pair as it has customers; pairs are sorted by count."""
    few = int(np.searchsorted(count, TOGETHER, "right"))
    cut = int(np.searchsorted(own, few))
    edges = np.searchsorted(own, np.arange(few, len(count) + 1))
    anew = [sit_anew(size[a:b], float(new[few + i]), discount, rng) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    own, size = own[:cut], size[:cut]
    for move in range(1, int(count[few - 1]) + 1 if few else 1):
        low = int(np.searchsorted(count[:few], move))
        at = int(np.searchsorted(own, low))
        moved, sizes = reseat(own[at:] - low, size[at:], count[low:few], new[low:few], discount, rng)
        own, size = np.concatenate((own[:at], moved + low)), np.concatenate((size[:at], sizes))
    return np.concatenate((own, np.repeat(np.arange(few, len(count)), [len(t) for t in anew]))), np.concatenate((size, *anew))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_share(size: np.ndarray, discount: float) -> np.ndarray:
    """The logarithm of a table's weight by its customers, divided by the ways to order them, but for a constant."""
    return (_lgamma(size - discount) - _lgamma(size + 1.0)).astype(float)


def root_tables(customers: np.ndarray, new: float, rng) -> np.ndarray:
    """Tables in the parent of words with so many customers there, drawn for all of a word's customers at once.

    Tables of a word are as those of a Poisson number with sizes drawn one by one (of k customers with the chance that the k-th of
    trials, each a success by discount / its number, is the first one), given that sizes add up to the customers. All but the largest
    are drawn so, the largest takes what is left, and the draw is kept with the chance that the largest has that size: a draw of the
    distribution itself, whatever the number of customers.
    """
    found = np.ones(len(customers), np.int64)
    left = np.flatnonzero(customers > 1)
    if not len(left):
        return found
    rate = new / ROOT_DISCOUNT
    distinct, of = np.unique(customers[left].astype(np.int64), return_inverse=True)
    # Beyond so many tables a Poisson number has a chance of less than 1e-15.
    n = np.arange(1, int(rate + 12 * math.sqrt(rate) + 40))
    most = -(-distinct[:, None] // n)
    log = (n - 1) * math.log(rate) - _lgamma(n.astype(float)).astype(float) + _log_share(np.arange(1, 4097.0), ROOT_DISCOUNT)[np.minimum(most, 4096) - 1]
    large = most > 4096
    log[large] += _log_share(most[large].astype(float), ROOT_DISCOUNT) - _log_share(np.array([4096.0]), ROOT_DISCOUNT)
    log[n > distinct[:, None]] = -np.inf
    chance = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
    while len(left):
        total = customers[left].astype(float)
        others = (rng.random(len(left))[:, None] * chance[of, -1:] >= chance[of]).sum(axis=1)
        row = np.repeat(np.arange(len(left)), others)
        success = np.clip(rng.beta(ROOT_DISCOUNT, 1 - ROOT_DISCOUNT, len(row)), 1e-300, 1 - 1e-16)
        size = np.maximum(1, np.ceil(np.log1p(-rng.random(len(row))) / np.log1p(-success)))
        largest = total - np.bincount(row, size, len(left))
        next_ = np.zeros(len(left))
        np.maximum.at(next_, row, size)
        fits = np.flatnonzero(largest >= np.maximum(next_, 1))
        as_large = np.bincount(row[size == largest[row]], minlength=len(left))[fits]
        bound = np.ceil(total[fits] / (others[fits] + 1))
        kept = fits[rng.random(len(fits)) * (1 + as_large) < np.exp(_log_share(largest[fits], ROOT_DISCOUNT) - _log_share(bound, ROOT_DISCOUNT))]
        found[left[kept]] = others[kept] + 1
        again = np.ones(len(left), bool)
        again[kept] = False
        left, of = left[again], of[again]
    return found


class Sums:
    """The sums over all parts that every part needs, and the model's parameters from them."""

    def __init__(self, layout: Layout, total: np.ndarray, turn: int):
        at = np.cumsum([layout.size, layout.size, layout.hot, layout.hot])
        self.tables, self.customers, self.hot_tables, self.hot_count, scalars = np.split(total, at)
        self.hot_order = np.argsort(layout.hot_hashes)
        self.hot_hashes = layout.hot_hashes[self.hot_order]
        self.words = int(scalars[0]) + int((self.hot_count > 0).sum())
        self.total_tables = self.tables.sum()
        rate = lambda ones, twos: float(np.clip((ones + 0.5) / (ones + 2 * twos + 1), 0.05, 0.95))
        self.discount = rate(scalars[1], scalars[2])
        self.even = (1 - UNKNOWN) / max(1, self.words)
        # The hot words' tables in the parent are drawn here, once they have tables below; before any sweep each word has one.
        self.hot_roots = np.where(self.hot_count > 0, 1, 0)
        if turn >= 0 and layout.hot:
            self.hot_roots = np.where(self.hot_count > 0, root_tables(np.maximum(self.hot_tables, 1), self.even * (STRENGTH + ROOT_DISCOUNT * self.words), np.random.default_rng([11, turn])), 0)
        self.root_total = float(scalars[3] + self.hot_roots.sum())

    def root(self, tables: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The parent's probability of known words by the tables they have in all contexts and in the parent."""
        return (tables - ROOT_DISCOUNT * roots + self.fresh * self.even) / (STRENGTH + self.total_tables)

    @property
    def fresh(self) -> float:
        return STRENGTH + ROOT_DISCOUNT * self.root_total

    @property
    def unknown(self) -> float:
        """The parent's probability of all unknown words together."""
        return self.fresh * UNKNOWN / (STRENGTH + self.total_tables) if self.words else UNKNOWN

    def new_table(self, context: np.ndarray) -> np.ndarray:
        """A context's weight of its parent."""
        return STRENGTH + self.discount * self.tables[context]


def _word_roots(seats: dict, roots: np.ndarray, sums: Sums) -> np.ndarray:
    """Tables of each word in the parent; hot words have them from the sums."""
    return np.where(seats["hot"] >= 0, sums.hot_roots[seats["hot"]], roots) if len(sums.hot_roots) else roots


def _word_tables(seats: dict, tables: np.ndarray, sums: Sums | None) -> np.ndarray:
    """Tables of each word over all contexts; hot words have them from the sums."""
    found = seats["single_word"] + np.bincount(seats["word"], tables, len(seats["single_word"]))
    if sums is not None and len(sums.hot_tables):
        found = np.where(seats["hot"] >= 0, sums.hot_tables[seats["hot"]], found)
    return found


def gather(parts: DataFrame, layout: Layout, shared, turn: int) -> Sums:
    """Sums over all parts: a vector of fixed length from every task, added up block by block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        tables, customers, hot, scalars = np.zeros(layout.size), np.zeros(layout.size), np.zeros((2, layout.hot)), np.zeros(4)
        for batch in batches:
            for content in batch.column(0):
                seats = unpack(content.as_py())[0]
                own = np.bincount(seats["own"], minlength=len(seats["count"])) if "own" in seats else np.ones(len(seats["count"]))
                tables += seats["single_context"] + np.bincount(seats["context"], own, layout.size)
                customers += seats["context_count"]
                words, is_hot = _word_tables(seats, own, None), seats["hot"] >= 0
                np.add.at(hot[0], seats["hot"][is_hot], words[is_hot])
                np.add.at(hot[1], seats["hot"][is_hot], seats["word_count"][is_hot])
                roots = seats["roots"][~is_hot].sum() if "roots" in seats else (~is_hot).sum()
                scalars += [(~is_hot).sum(), seats["single_word"].sum(), seats["twos"], roots]
        total = np.concatenate((tables, customers, *hot, scalars))
        blocks = [total[at : at + BLOCK] for at in range(0, len(total), BLOCK)]
        some = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(blocks[i]) for i in some], pa.binary())], ["block", "content"])

    def add_up(table: pa.Table) -> pa.Table:
        total = sum(unpack(c.as_py())[0] for c in table.column("content"))
        return pa.table({"block": table.column("block")[:1], "content": pa.array([pack(total)], pa.binary())})

    rows = parts.where("kind = 'seats'").select("content").mapInArrow(add, "block:int,content:binary")
    total = np.zeros(2 * layout.size + 2 * layout.hot + 4)
    for block, content in rows.groupBy("block").applyInArrow(add_up, "block:int,content:binary").collect():
        found = unpack(bytes(content))[0]
        total[block * BLOCK : block * BLOCK + len(found)] = found
    return Sums(layout, total, turn)


def sweep(parts: DataFrame, sums: Sums, turn: int, keep: bool) -> DataFrame:
    """One Gibbs sweep over all parts, the first of which seats the customers; then the tables are seated in the parent."""
    given = parts.sparkSession.sparkContext.broadcast(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = given.value
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                seats = unpack(content.as_py())[0]
                rng = np.random.default_rng([part, turn])
                word, context, count = seats["word"], seats["context"], seats["count"]
                if "own" not in seats:
                    share = (seats["word_count"] + 1.0) / (sums.customers.sum() + 1)
                    hot = seats["hot"] >= 0
                    share[hot] = sums.hot_count[seats["hot"][hot]] / sums.customers.sum()
                    own, size = seat(count, sums.new_table(context) * share[word], sums.discount, rng)
                else:
                    own, size = seats["own"].astype(np.int64), seats["size"]
                    tables = np.bincount(own, minlength=len(count))
                    root = sums.root(_word_tables(seats, tables, sums), _word_roots(seats, seats["roots"], sums))
                    own, size = move_all(own, size, count, sums.new_table(context) * root[word], sums.discount, rng)
                tables = np.bincount(own, minlength=len(count)).astype(np.int32)
                roots = root_tables(_word_tables(seats, tables, None), sums.fresh * sums.even, rng).astype(np.int32)
                seats |= {"own": own.astype(np.int32), "size": size, "roots": roots}
                if keep:
                    seats["kept"].append(tables)
                    seats["kept_roots"].append(roots)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(["seats"]), pa.array([pack(seats)], pa.binary())], ["part", "kind", "content"])

    return parts.where("kind = 'seats'").select("part", "content").mapInArrow(run, "part:int,kind:string,content:binary")


class Part:
    """A part's pairs with the kept seatings: probabilities of tokens."""

    def __init__(self, pairs: bytes, seats: bytes, samples: list[Sums]):
        self.words, runs, context, count = unpack(pairs)
        self.count = count.astype(np.int64)
        word = np.repeat(np.arange(len(self.words)), runs)
        self.key = word.astype(np.int64) << BITS | context.astype(np.int64)
        found = unpack(seats)[0]
        self.word_count = found["word_count"].astype(float)
        hot = found["hot"] >= 0
        self.word_count[hot] = samples[-1].hot_count[found["hot"][hot]]
        self.tables, self.roots = [], []
        many = np.flatnonzero(self.count >= 2)
        many = many[np.argsort(self.count[many], kind="stable")]
        for kept, roots, sums in zip(found["kept"], found["kept_roots"], samples):
            tables = np.ones(len(self.count), np.int64)
            tables[many] = kept
            self.tables.append(tables)
            self.roots.append(sums.root(_word_tables(found, kept, sums), _word_roots(found, roots, sums)))


def probabilities(part: Part | None, samples: list[Sums], hashes: np.ndarray, of: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts in training, probability) of tokens: ``of`` points into ``hashes``."""
    at = _lookup(part.words, hashes)[of] if part else np.full(len(of), -1)
    known = at >= 0
    place = _lookup(part.key, np.where(known, at, 0).astype(np.int64) << BITS | context) if part else np.full(len(of), -1)
    seen = known & (place >= 0)
    # A hot word may be known though none of its pairs is in this part.
    hot = _lookup(samples[-1].hot_hashes, hashes)[of]
    elsewhere = ~known & (hot >= 0)
    hot = np.where(elsewhere, samples[-1].hot_order[hot] if len(samples[-1].hot_order) else 0, 0)
    total = np.zeros(len(of))
    for s, sums in enumerate(samples):
        root = np.full(len(of), sums.unknown)
        root[elsewhere] = sums.root(sums.hot_tables[hot[elsewhere]], sums.hot_roots[hot[elsewhere]])
        own = np.zeros(len(of))
        if part:
            root[known] = part.roots[s][at[known]]
            own[seen] = part.count[place[seen]] - sums.discount * part.tables[s][place[seen]]
        total += (own + sums.new_table(context) * root) / (STRENGTH + sums.customers[context])
    counts = np.zeros(len(of))
    counts[elsewhere] = samples[-1].hot_count[hot[elsewhere]]
    if part:
        counts[known] = part.word_count[at[known]]
    return counts, total / max(1, len(samples))


def score_texts(docs: DataFrame, parts: DataFrame, samples: list[Sums], tokens: int, shared) -> DataFrame:
    """(id, held, n_tokens, n_known, base_score, score) of every row."""
    given = docs.sparkSession.sparkContext.broadcast(samples)
    words = samples[-1].words

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, task = shared.value, TaskContext.get().partitionId()
        for n, held in enumerate(_batches(batches, layout.batch_tokens)):
            texts = [t.as_py() for batch in held for t in batch.column(0)]
            own, ids = [[x for batch in held for x in batch.column(i).to_pylist()] for i in (1, 2)]
            number = task << 32 | n
            rows = [(part, "texts", pack(*arrays)) for part, *arrays in layout.cut(texts, True)]
            rows.append((number % layout.parts, "ids", pack(ids, own, len(texts))))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([k for _, k, _ in rows]), pa.array([c for _, _, c in rows], pa.binary())], ["part", "batch", "kind", "content"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        samples, part = given.value, None
        own = {k: c.as_py() for k, c in zip(right.column("kind").to_pylist(), right.column("content"))}
        if own:
            part = Part(own["pairs"], own["seats"], samples)
        batches, kinds, contents = [], [], []
        for number, kind, content in zip(left.column("batch").to_pylist(), left.column("kind").to_pylist(), left.column("content")):
            content = content.as_py()
            if kind == "texts":
                hashes, runs, context, n, doc = unpack(content)
                of = np.repeat(np.arange(len(hashes)), runs)
                counts, chance = probabilities(part, samples, hashes, of, context.astype(np.int64))
                docs_, inside = np.unique(doc, return_inverse=True)
                add = lambda x: np.bincount(inside, x * n, len(docs_))  # noqa: E731, B023
                base = np.log10((counts + 1) / (tokens + words + 1))
                content = pack(docs_, add(np.ones(len(n))).astype(np.int32), add(counts > 0).astype(np.int32), add(base), add(np.log10(chance)))
            batches.append(number)
            kinds.append(kind)
            contents.append(content)
        return pa.table({"batch": pa.array(batches, pa.int64()), "kind": pa.array(kinds, pa.string()), "content": pa.array(contents, pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("kind").to_pylist(), table.column("content")))
        ids, held, n = next(unpack(c.as_py()) for k, c in rows if k == "ids")
        sums = np.zeros((4, n))
        for kind, content in rows:
            if kind == "texts":
                docs_, *values = unpack(content.as_py())
                for i, value in enumerate(values):
                    sums[i, docs_] += value
        return pa.table({"id": pa.array(ids, pa.int64()), "held": held, "n_tokens": pa.array(sums[0].astype(np.int64)), "n_known": pa.array(sums[1].astype(np.int64)), "base_score": sums[2], "score": sums[3]})

    dealt = docs.select("t", "held", "id").mapInArrow(deal, "part:int,batch:long,kind:string,content:binary")
    layout = shared.value
    scored = dealt_by_part(dealt, layout).groupBy("part").cogroup(dealt_by_part(parts, layout).groupBy("part")).applyInArrow(score, "batch:long,kind:string,content:binary")
    return scored.groupBy("batch").applyInArrow(add_up, "id:long,held:boolean,n_tokens:long,n_known:long,base_score:double,score:double")


def fit(rows: DataFrame, contexts: int = CONTEXTS, part_tokens: int = PART_TOKENS, restaurants: int = SHARED):
    """Counts, seats and samples: (broadcast layout, parts, kept sums, training tokens)."""
    top, tokens, _ = common_words(rows, contexts)
    layout = Layout(top, tokens, part_tokens, restaurants)
    shared = rows.sparkSession.sparkContext.broadcast(layout)
    built = materialise(build_parts(pair_counts(rows, shared), shared), "parts")
    seats, kept = built, []
    sums = gather(seats, layout, shared, -1)
    for turn in range(1 + BURN_IN + KEPT):
        keep = turn > BURN_IN
        seats = materialise(sweep(seats, sums, turn, keep), f"seats{turn}")
        sums = gather(seats, layout, shared, turn)
        if keep:
            kept.append(sums)
    parts = built.where("kind = 'pairs'").unionByName(seats)
    return shared, parts, kept, tokens


def lm_scores(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Scores every row of ``docs`` by a model of those that aren't held out.

    Ids are whole numbers or null. Null and empty texts are an end alone; repeated rows are counted and scored each; other columns play no part.
    Without training tokens every token is unknown and has the same probability. An empty table gives no rows.
    """
    rows = docs.select(raw(text).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(doc_id).cast("long").alias("id"))
    shared, parts, samples, tokens = fit(rows, **options)
    found = score_texts(rows, parts, samples, tokens, shared)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
