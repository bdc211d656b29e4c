"""A trie of conversation prefixes, kept as balanced parentheses in shards.

Conversations are sequences of turns, a turn being 16 bytes of the hash of its role and text. The distinct sequences are
sorted by ranges; consecutive ones make a shard, whose trie is written as balanced parentheses in preorder, with a
directory of blocks that holds the least and greatest excess of each. Reading a shard, ``close`` finds the end of a
node's subtree by that directory, ranks of ``()`` count its leaves, and running sums over the preorder give what else
is summed over subtrees. Neighbouring shards share the spine of prefixes that both the last sequence of one and the
first of the other begin with: what they hold of such a node is summed up afterwards, and each node counts for the
first shard that has it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm.common import materialise

#: Bytes of a turn in a sequence; turns at which a shard is closed; decimal ids that are hashed at a time.
STEP, SHARD, CHUNK = 16, 1 << 18, 1 << 16
#: Parentheses in a block of the excess directory.
BLOCK = 64
#: A conversation begins with at most this many turns of another one.
MOST_SHARED = 8
MAGIC = b"BPT1"
NOTHING = hashlib.sha256().hexdigest()


class PrefixTrie:
    """Balanced parentheses of a trie in preorder, with a range min-max directory over blocks of their excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int8) * 2 - 1, dtype=np.int32)
        self.opens = np.flatnonzero(bits)
        n = -(-len(bits) // BLOCK)
        self.leaves = 1 << max(0, n - 1).bit_length()
        edges = np.arange(0, len(bits), BLOCK)
        # A tree over the blocks: node i has the children 2i and 2i + 1, and the blocks are its last level.
        self.low, self.high = np.full(2 * self.leaves, 1 << 30, np.int32), np.full(2 * self.leaves, -(1 << 30), np.int32)
        self.low[self.leaves : self.leaves + n] = np.minimum.reduceat(self.excess, edges)
        self.high[self.leaves : self.leaves + n] = np.maximum.reduceat(self.excess, edges)
        at = self.leaves
        while at > 1:
            at //= 2
            for tree, pick in ((self.low, np.minimum), (self.high, np.maximum)):
                tree[at : 2 * at] = pick(tree[2 * at : 4 * at : 2], tree[2 * at + 1 : 4 * at : 2])

    def _scan(self, start: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from ``start`` and before ``stop`` whose excess is ``target``; -1 if there is none."""
        found, left, step = np.full(len(start), -1, np.int64), np.arange(len(start)), 0
        while len(left):
            at = start[left] + step
            left, at = left[at < stop[left]], at[at < stop[left]]
            hit = self.excess[at] == target[left]
            found[left[hit]] = at[hit]
            left, step = left[~hit], step + 1
        return found

    def close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place whose excess is what it was before it."""
        target = self.excess[opens] - 1
        block = opens // BLOCK
        found = self._scan(opens + 1, np.minimum((block + 1) * BLOCK, len(self.bits)), target)
        left = np.flatnonzero(found < 0)
        if len(left):
            node, goal = block[left] + self.leaves, target[left]
            # Up to the first right sibling whose blocks reach the excess; the next block's least one suffices, as excess falls by ones.
            climbing = np.arange(len(left))
            while len(climbing):
                right = (node[climbing] & 1) == 0
                reached = climbing[right & (self.low[(node[climbing] + 1) % len(self.low)] <= goal[climbing])]
                node[reached] += 1
                climbing = np.setdiff1d(climbing, reached, assume_unique=True)
                node[climbing] >>= 1
            while True:
                down = np.flatnonzero(node < self.leaves)
                if not len(down):
                    break
                node[down] *= 2
                node[down] += self.low[node[down]] > goal[down]
            begin = (node - self.leaves) * BLOCK
            found[left] = self._scan(begin, np.minimum(begin + BLOCK, len(self.bits)), goal)
        return found

    def depths(self) -> np.ndarray:
        """How far each node is from the root."""
        return self.excess[self.opens] - 1

    def leaf_ranks(self) -> np.ndarray:
        """How many ``()`` begin before each place."""
        pairs = self.bits[:-1] & (self.bits[1:] ^ 1)
        return np.concatenate(([0], np.cumsum(pairs)))

    def parents(self) -> np.ndarray:
        """The parent of each node, by number in preorder: the last node before it that is one level up; -1 for the root."""
        depth, n = self.depths().astype(np.int64), len(self.opens)
        keys = np.sort(depth * n + np.arange(n))
        up = keys[np.maximum(np.searchsorted(keys, (depth - 1) * n + np.arange(n)) - 1, 0)] % n
        up[0] = -1
        return up


def shared_steps(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with alike."""
    n = min(len(a), len(b)) // STEP * STEP
    if a[:n] == b[:n]:
        return n // STEP
    return int((np.frombuffer(a, "<u8", n // 8) != np.frombuffer(b, "<u8", n // 8)).argmax()) // 2


def encode(rows: list[tuple]) -> bytes:
    """A shard of sorted distinct (path, sizes, n, least, sha): parentheses, the turns' bytes, and who ends where."""
    paths = [r[0] for r in rows]
    lengths = np.array([len(p) // STEP for p in paths])
    alike = np.array([0] + [shared_steps(a, b) for a, b in zip(paths, paths[1:])])
    opens, closes = lengths - alike, np.append(lengths[:-1] - alike[1:], lengths[-1])
    runs = np.column_stack((opens, closes)).ravel()
    bits = np.concatenate(([1], np.repeat(np.tile([1, 0], len(rows)), runs), [0])).astype(np.uint8)
    sizes = np.concatenate([[0], *(np.asarray(r[1][a:]) for r, a in zip(rows, alike.tolist()))]).astype("<i8")
    ends = np.cumsum(opens).astype("<i8")
    numbers = np.array([r[2:4] for r in rows], "<i8")
    body = b"".join((np.packbits(bits).tobytes(), sizes.tobytes(), ends.tobytes(), numbers.tobytes(), b"".join(r[4] for r in rows)))
    return MAGIC + struct.pack("<QQ", len(bits), len(rows)) + zstandard.compress(body, 1)


def decode(content: bytes) -> tuple[PrefixTrie, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(trie, bytes of each node's turn, node that each sequence ends at, its members and the smallest one, their hash)."""
    n, m = struct.unpack_from("<QQ", content, len(MAGIC))
    body, at = zstandard.decompress(content[len(MAGIC) + 16 :]), 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(body, kind, count, at)
        at += found.nbytes
        return found

    bits = np.unpackbits(take("u1", -(-n // 8)), count=n)
    sizes, ends, numbers = take("<i8", n // 2), take("<i8", m), take("<i8", 2 * m).reshape(m, 2)
    return PrefixTrie(bits), sizes, ends, numbers, [body[at + 32 * i : at + 32 * i + 32] for i in range(m)]


def _least_in(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least value from each start and before its stop, by minima over powers of two."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][: len(values) - 2 * width + 1], levels[-1][width : len(values) - width + 1]))
        width *= 2
    level = np.frexp((stop - start).astype(float))[1] - 1
    found = np.empty(len(start), np.int64)
    for i, row in enumerate(levels):
        on = np.flatnonzero(level == i)
        found[on] = np.minimum(row[start[on]], row[stop[on] - (1 << i)])
    return found


def _digests(path: bytes, depth: int) -> list[bytes]:
    """A digest of each prefix of a path, from the root's to that of ``depth`` turns."""
    running, found = hashlib.blake2b(digest_size=16), []
    for at in range(depth + 1):
        found.append(running.digest())
        running.update(path[at * STEP : (at + 1) * STEP])
    return found


NODES = pa.schema(
    [("pid", pa.int32()), ("sub", pa.int32()), ("shared", pa.bool_()), ("key", pa.binary()), ("up", pa.binary()), ("parent_conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "weighed", "once")]
    + [("ends_sha256", pa.string())]
)
NODES_DDL = "pid int, sub int, shared boolean, key binary, up binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, weighed long, once long, ends_sha256 string"


def shard_nodes(pid: int, sub: int, first: bytes, last: bytes, before: int, after: int, content: bytes) -> pa.RecordBatch:
    """The nodes of a shard. ``before`` and ``after`` are the turns that it shares with its neighbours, -1 without one.

    ``weighed`` sums members times bytes over a subtree, ``once`` the bytes of those of its nodes that no earlier shard
    has. Of a shared node (with ``key``) the numbers are this shard's part of them.
    """
    trie, sizes, ends, numbers, shas = decode(content)
    n, depth, parent = len(trie.opens), trie.depths(), trie.parents()
    close = trie.close(trie.opens)
    start = np.arange(n)
    stop = start + (close - trie.opens + 1) // 2
    over = lambda values: (lambda c: c[stop] - c[start])(np.concatenate(([0], np.cumsum(values))))
    ended, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    ended[ends], least[ends] = numbers[:, 0], numbers[:, 1]
    members = over(ended)
    own = np.ones(n, bool)
    own[: before + 1] = False
    ranks = trie.leaf_ranks()
    leaves = ranks[close] - ranks[trie.opens]
    right = []
    at = n - 1
    while at >= 0:
        right.append(at)
        at = parent[at]
    right = np.array(right[::-1])
    if after >= 0 and after == len(last) // STEP:
        # The next shard goes on where this one ends.
        leaves[right] -= 1
    children = np.bincount(parent[1:][own[1:]], minlength=n)
    shared = np.zeros(n, bool)
    shared[: before + 1] = True
    shared[right[: after + 1]] = True
    keys: list[bytes | None] = [None] * n
    for places, path, deep in ((start[: before + 1], first, before), (right[: after + 1], last, after)):
        for i, key in zip(places.tolist(), _digests(path, deep)):
            keys[i] = key
    hashed = [NOTHING] * n
    for i, sha in zip(ends.tolist(), shas):
        hashed[i] = sha.hex()
    minima = _least_in(least, start, stop)
    above = np.maximum(parent, 0)
    known = (parent >= 0) & ~shared[above]
    columns = [
        pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, sub, np.int32)), pa.array(shared), pa.array(keys, pa.binary()),
        pa.array([keys[p] if p >= 0 else None for p in parent.tolist()], pa.binary()), pa.array(minima[above], mask=~known),
        pa.array(minima), pa.array(depth.astype(np.int64)), pa.array(members), pa.array(children.astype(np.int64)), pa.array(leaves.astype(np.int64)),
        pa.array(over(members * sizes)), pa.array(over(sizes * own)), pa.array(hashed),
    ]
    return pa.record_batch(columns, schema=NODES)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation rebuilt, as the digests of its turns and their texts' bytes.

    Conversation c begins with the first h turns of conversation c - c % 5, h being the CRC-32 of its decimal number
    modulo 9, and goes on with its own ones after the first h. Turns go by number, null first, and equal numbers by role
    and a hash; null roles and texts are empty; rows without a conversation's id are left out.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    step = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * STEP)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), step.alias("step"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "step")
    own = turns.select("c", F.row_number().over(order).alias("pos"), "step", "bytes")
    own = own.withColumn("h", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(MOST_SHARED + 1))).withColumn("from", F.col("c") - F.col("c") % 5)
    own = materialise(own, "turns")
    rest = own.where((F.col("from") == F.col("c")) | (F.col("pos") > F.col("h"))).select("c", F.lit(1).alias("part"), "pos", "step", "bytes")
    heads = own.where(F.col("pos") <= MOST_SHARED).select(F.col("c").alias("from"), F.col("pos").alias("at"), "step", "bytes")
    takers = own.where((F.col("pos") == 1) & (F.col("from") != F.col("c"))).select("c", "from", "h")
    taken = takers.join(heads, "from").where("at <= h").select("c", F.lit(0).alias("part"), F.col("at").alias("pos"), "step", "bytes")
    # A conversation that is left without turns is still one.
    there = own.where("pos = 1").select("c", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("long").alias("bytes"))
    whole = rest.unionByName(taken).unionByName(there).groupBy(F.col("c").alias("conv_id")).agg(F.filter(F.array_sort(F.collect_list(F.struct("part", "pos", "step", "bytes"))), lambda t: t["step"].isNotNull()).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["step"]), "")).alias("path"), F.transform("t", lambda t: t["bytes"]).alias("sizes"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (digest, id): (digest, first id, number, decimal ids joined by commas), ``CHUNK`` ids at most in a row."""
    names, now, ids = ["digest", "first", "n", "ids"], None, []

    def row():
        return pa.record_batch([pa.array([now], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids)).encode()], pa.binary())], names)

    for batch in batches:
        out = []
        for digest, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now or len(ids) == CHUNK:
                out += [row()] if ids else []
                now, ids = digest, []
            ids.append(i)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield row()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks sorted by digest and first id: (digest, members, smallest id, SHA-256 of their ids in a row)."""
    names, now, found, n, least = ["digest", "n", "least", "sha"], None, None, 0, 0
    pack = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names)
    for batch in batches:
        out = []
        for digest, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "first", "n", "ids"))):
            if digest != now:
                if found:
                    out.append((now, n, least, found.digest()))
                now, found, n, least = digest, hashlib.sha256(ids), 0, first
            else:
                found.update(b"," + ids)
            n += count
        if out:
            yield pack(out)
    if found:
        yield pack([(now, n, least, found.digest())])


def sequences(paths: DataFrame) -> DataFrame:
    """(path, sizes, n, least, sha): the distinct sequences, their members, the smallest one, and the SHA-256 of all of them.

    Members of a sequence that very many conversations have are joined in chunks by ranges of (sequence, id); the hash
    then runs over these, which one task gets in order and never holds together.
    """
    rows = materialise(paths.withColumn("digest", F.unhex(F.substring(F.sha2("path", 256), 1, 32))), "paths")
    chunks = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_chunks, "digest binary, first long, n long, ids binary")
    members = chunks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashes, "digest binary, n long, least long, sha binary")
    distinct = rows.groupBy("digest").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    return distinct.join(members, "digest").select("path", "sizes", "n", "least", "sha")


SHARDS_DDL = "pid int, sub int, first binary, last binary, final boolean, before int, after int, n_nodes long, content binary"


def write_shards(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each shard of the ``sequences``, of about ``shard`` turns: a file of parentheses and numbers, and its neighbours' shared turns.

    Shards are numbered by range and place in it. The table is written in the shared folder.
    """
    names = [f.split()[0] for f in SHARDS_DDL.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sub, before, held, turns = TaskContext.get().partitionId(), 0, None, [], 0

        def close(after: int | None) -> pa.RecordBatch:
            content = encode(held)
            values = (pid, sub, held[0][0], held[-1][0], after is None, before, after, struct.unpack_from("<Q", content, len(MAGIC))[0] // 2, content)
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "least", "sha"))):
                if turns >= shard:
                    alike = shared_steps(held[-1][0], row[0])
                    yield close(alike)
                    sub, before, held, turns = sub + 1, alike, [], 0
                held.append(row)
                turns += len(row[0]) // STEP
        if held:
            yield close(None)

    ranged = materialise(rows, "sequences").repartitionByRange("path").sortWithinPartitions("path")
    written = materialise(ranged.mapInArrow(shards, SHARDS_DDL), "tries")
    # As many rows as there are ranges, each of a number; then the two sequences where ranges meet.
    firsts = written.where("sub = 0").select("pid", "first")
    ranges = firsts.select("pid", F.lag("pid").over(Window.orderBy("pid")).alias("earlier")).where("earlier is not null")
    lasts = written.where("final").select(F.col("pid").alias("earlier"), "last")
    alike = F.arrow_udf(lambda a, b: pa.array([shared_steps(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.int32()), "int")
    links = ranges.join(firsts, "pid").join(lasts, "earlier").select("pid", "earlier", alike("first", "last").alias("alike"))
    # At most as many pairs of numbers as there are ranges.
    links = materialise(links, "links")
    into = written.join(F.broadcast(links.select("pid", F.col("alike").alias("in"))), "pid", "left")
    both = into.join(F.broadcast(links.select(F.col("earlier").alias("pid"), F.col("alike").alias("out"))), "pid", "left")
    none = F.lit(-1)
    return both.select("pid", "sub", "first", "last", F.when(F.col("sub") == 0, F.coalesce("in", none)).otherwise(F.col("before")).alias("before"), F.when(F.col("final"), F.coalesce("out", none)).otherwise(F.col("after")).alias("after"), "n_nodes", "content")


def read_nodes(shards: DataFrame) -> DataFrame:
    """The nodes of the whole trie from its shards: those that shards share are summed up, all others are as they are."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                values = (batch.column(c)[row].as_py() for c in ("pid", "sub", "first", "last", "before", "after", "content"))
                yield shard_nodes(*values)

    found = materialise(shards.mapInArrow(nodes, NODES_DDL), "nodes")
    parts = found.where("shared")
    total = parts.groupBy("key").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weighed", "once")),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256"),
    )
    total = materialise(total, "spines")
    smallest = total.select("key", F.col("conv_id").alias("smallest"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("weighed") - F.col("once")).alias("saved_tokens"), "ends_sha256"]
    spines = total.join(smallest.withColumnRenamed("key", "up"), "up", "left").withColumn("parent_conv_id", F.col("smallest")).select(*columns)
    # The smallest members of a shard's shared nodes, by shard: children of one node may be most of all nodes.
    by_shard = parts.select("pid", "sub", "key").join(smallest, "key").withColumnRenamed("key", "up")
    inner = found.where("not shared")
    below = inner.where("up is not null").join(by_shard, ["pid", "sub", "up"]).withColumn("parent_conv_id", F.col("smallest")).select(*columns)
    return inner.where("up is null").select(*columns).unionByName(below).unionByName(spines)


def prefix_trie(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of (conv_id, path, sizes): a row for each distinct beginning of a sequence, the empty one included.

    conv_id is the smallest member, parent_conv_id that of the node one turn shorter (null for the root), n_convs the
    members, n_children and n_leaves the nodes one turn longer and the childless ones in its subtree, saved_tokens the
    bytes that sharing saves in it, ends_sha256 the hash of those members that end here. Repeated members count as often
    as they are there; no paths give no nodes.
    """
    return read_nodes(write_shards(sequences(paths), shard))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt."""
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, turn, role, substr(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), 1, 32) AS step, CAST(strlen(text) AS BIGINT) AS bytes FROM t),
own AS (SELECT c, step, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, step) AS pos FROM s),
k AS (SELECT c, c - c % 5 AS src, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(c AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT)) % 9 AS h FROM (SELECT DISTINCT c FROM own)),
u AS (SELECT c, 1 AS part, pos, step, bytes FROM own JOIN k USING (c) WHERE src = c OR pos > h
  UNION ALL SELECT k.c, 0, pos, step, bytes FROM k JOIN own ON own.c = k.src WHERE k.src <> k.c AND pos <= h),
p AS (SELECT k.c, coalesce(steps, []) AS steps, coalesce(sizes, []) AS sizes FROM k LEFT JOIN (SELECT c, list(step ORDER BY part, pos) AS steps, list(bytes ORDER BY part, pos) AS sizes FROM u GROUP BY c) USING (c)),
m AS (SELECT c, d, len(steps) AS n, array_to_string(steps[1:d], '') AS key, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS d FROM p)),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY key, d),
c AS (SELECT substr(key, 1, 32 * (CAST(d AS INTEGER) - 1)) AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key, d)),
a AS (SELECT substr(key, 1, 32 * CAST(up AS INTEGER)) AS key, up AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN a USING (key, d) LEFT JOIN n g ON f.d > 0 AND g.d = f.d - 1 AND g.key = substr(f.key, 1, 32 * (CAST(f.d AS INTEGER) - 1))
"""
