"""Exact and near duplicates: pairs, clusters, representatives and merged groupings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.functions.columns import clamp, hamming, normalize_log, unit
from curato.operators.graph import components, materialise

#: Fixed value: comparisons which an all-pairs operator may make; it can be lowered, never raised.
PAIR_BUDGET = 2_000_000
#: Vectors of a block at most and of a cell on average, blocks that the vectors are split into before these grow, and cells that a vector visits.
BLOCK, CELL, SPLIT, VISITS = 32_768, 2048, 16, 4
#: Vectors whose products are held at a time, and pairs that are given at a time.
TILE, GIVEN = 2048, 1 << 18


def check_pair_budget(rows: DataFrame, budget: int = PAIR_BUDGET) -> int:
    """The number of rows, or an error if all their pairs are more than the budget."""
    n = rows.count()
    if n * (n - 1) // 2 > min(budget, PAIR_BUDGET):
        raise ValueError(f"{n} rows make more than {min(budget, PAIR_BUDGET)} pairs")
    return n


def exact_clusters(assets: DataFrame, key: str, digest: str) -> DataFrame:
    """(digest, representative, n, cluster_id) of digests that more than one asset has.

    The cluster's id is the first half of the first half of the SHA-256 of its digest and smallest key.
    """
    groups = assets.groupBy(digest).agg(F.min(key).alias("representative"), F.count("*").alias("n")).where("n > 1")
    return groups.withColumn("cluster_id", F.substring(F.sha2(F.concat_ws("\0", digest, F.col("representative").cast("string")).cast("binary"), 256), 1, 16))


def drop_exact(assets: DataFrame, key: str, digest: str) -> DataFrame:
    """The assets that are the smallest of their digest."""
    kept = assets.groupBy(digest).agg(F.min(key).alias(key))
    return assets.join(kept.select(key), key, "left_semi")


def _representatives(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(value, smallest key) of distinct values, and links (a, b) of the smallest key with the others of its value."""
    first = rows.groupBy(F.col(value).alias("h")).agg(F.min(key).alias("a"))
    links = rows.select(F.col(key).alias("b"), F.col(value).alias("h")).join(first.hint("merge"), "h").where("a != b").select("a", "b")
    return first, links


def hamming_pairs(hashes: DataFrame, key: str, value: str, distance: int, bits: int = 64, same: int = 3, all_pairs: bool = False) -> DataFrame:
    """(a, b, distance) of nearly equal hashes, each hash standing by its smallest key, and of that key with the hash's others.

    Of ``distance`` + ``same`` bands of bits ``same`` are equal in two such hashes: a join on every choice of as many
    bands finds all of them, and few others are compared. With ``all_pairs`` all keys of both hashes are paired, of
    which there may be as many as the square of a hash's keys. All joins are by key: a table of all hashes is never
    broadcast, however few bytes its rows have.
    """
    bands = distance + same
    edges = [i * bits // bands for i in range(bands + 1)]
    band = lambda i: F.shiftrightunsigned("h", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    choices = list(combinations(range(bands), same))
    parts = [F.struct(F.lit(n).alias("choice"), F.xxhash64(*(band(i) for i in chosen)).alias("part")) for n, chosen in enumerate(choices)]
    first, links = _representatives(hashes, key, value)
    banded = first.select("h", F.explode(F.array(*parts)).alias("s")).select("h", "s.choice", "s.part")
    other = banded.select(F.col("h").alias("h2"), "choice", "part")
    near = banded.join(other.hint("merge"), ["choice", "part"]).where(F.col("h") < F.col("h2")).withColumn("distance", hamming(F.col("h"), F.col("h2"))).where(F.col("distance") <= distance).drop("choice", "part").distinct()
    if all_pairs:
        left, right = hashes.select(F.col(key).alias("x"), F.col(value).alias("h")), hashes.select(F.col(key).alias("y"), F.col(value).alias("h2"))
        same_hash = first.select("h", F.col("h").alias("h2"), F.lit(0).alias("distance"))
        pairs = near.unionByName(same_hash).join(left.hint("merge"), "h").join(right.hint("merge"), "h2").where((F.col("h") != F.col("h2")) | (F.col("x") < F.col("y")))
    else:
        pairs = near.join(first.select("h", F.col("a").alias("x")).hint("merge"), "h").join(first.select(F.col("h").alias("h2"), F.col("a").alias("y")).hint("merge"), "h2")
        pairs = pairs.select("x", "y", "distance").unionByName(links.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).alias("distance")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def _pivots(drawn: np.ndarray, sample: np.ndarray, angle: float) -> np.ndarray:
    """The most of the drawn pivots, halved as need be, with which a vector of the sample visits VISITS cells at most on average."""
    while len(drawn) > 1 and len(sample):
        far = np.arccos(np.clip(sample @ drawn.T, -1, 1))
        later = np.arange(len(drawn))[None, :] > far.argmin(axis=1)[:, None]
        if ((far <= far.min(axis=1)[:, None] + angle) & later).sum() <= VISITS * len(sample):
            break
        drawn = drawn[: len(drawn) // 2]
    return drawn


def cosine_blocks(vectors: DataFrame, threshold: float, block: int = BLOCK, cells: int = 1024) -> DataFrame:
    """(cell, kind, i, j, left, right): blocks of vectors (k, v) to be held against each other, every pair of vectors in one of them at most.

    Vectors belong to the cell of the nearest of ``cells`` pivots at most, and visit the later cells whose pivot isn't further
    off than their own and twice the threshold's angle: of two vectors within that angle the one of the earlier cell visits the other's.
    A cell's vectors are held against each other and against its visitors. Where the threshold is too low to rule out a cell,
    that is each pair once. Blocks carry the pair of blocks that they are for, so that no cell is one task's. There are as many
    cells as leave a vector few visits, by a sample, and blocks of ``block`` vectors at most: vectors are sent a bounded number of times
    until that makes more than SPLIT of them, and then as often as there are blocks.
    """
    vectors = materialise(vectors.select("k", unit(F.col("v")).alias("v")), "vectors")
    n = vectors.count()
    most = min(cells, max(1, n // min(block, CELL)))
    # At most twice as many rows as cells, whatever the input.
    drawn = np.array([r.v for r in vectors.orderBy(F.xxhash64("k"), "k").select("v").limit(2 * most).collect()], float)
    pivots = _pivots(drawn[:most], drawn[most:], 2 * np.arccos(np.clip(threshold, -1, 1)) + 1e-6)
    block = min(block, max(CELL, -(-n // SPLIT)))
    angle = 2 * np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(dict(vectors.dtypes)["k"], pa.string())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = rows_of(batch.column("v"))
            far = np.arccos(np.clip(own @ pivots.T, -1, 1)) if len(own) else np.zeros((0, len(pivots)))
            home = far.argmin(axis=1)
            later = np.arange(len(pivots))[None, :] > home[:, None]
            i, cell = np.nonzero((far <= far.min(axis=1, initial=np.inf)[:, None] + angle) & later)
            at = np.concatenate((np.arange(len(own)), i))
            data = pa.array([x.tobytes() for x in own], pa.binary())
            columns = [batch.column("k").cast(kind).take(pa.array(at)), data.take(pa.array(at)), pa.array(np.concatenate((home, cell)).astype(np.int32)), pa.array(np.arange(len(at)) < len(own))]
            yield pa.record_batch(columns, ["k", "v", "cell", "home"])

    rows = materialise(vectors.mapInArrow(visit, f"k {dict(vectors.dtypes)['k']}, v binary, cell int, home boolean"), "cells")
    sizes = rows.groupBy("cell").agg(*(F.ceil(F.count_if(c) / block).cast("int").alias(name) for c, name in ((F.col("home"), "homes"), (~F.col("home"), "visits"))))
    # As many rows as there are cells.
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("at", F.pmod(F.xxhash64("k"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int"))
    packed = materialise(dealt.groupBy("cell", "home", "homes", "visits", "at").agg(F.collect_list(F.struct("k", "v")).alias("rows")), "blocks")
    own, guests = packed.where("home"), packed.where("not home")
    upto = lambda low, high: F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    at, zero = F.col("at"), F.lit(0)
    left = own.select("cell", "rows", F.explode(F.concat(F.transform(upto(at, F.col("homes")), lambda j: F.struct(F.lit("own").alias("kind"), at.alias("i"), j.alias("j"))), F.transform(upto(zero, F.col("visits")), lambda j: F.struct(F.lit("guest").alias("kind"), at.alias("i"), j.alias("j"))))).alias("p"))
    right = own.select("cell", "rows", F.lit("own").alias("kind"), F.explode(upto(zero, at + 1)).alias("i"), at.alias("j")).unionByName(guests.select("cell", "rows", F.lit("guest").alias("kind"), F.explode(upto(zero, F.col("homes"))).alias("i"), at.alias("j")))
    return left.select("cell", "p.*", F.col("rows").alias("left")).join(right.withColumnRenamed("rows", "right"), ["cell", "kind", "i", "j"])


def rows_of(vectors: pa.Array) -> np.ndarray:
    """A matrix of an Arrow array of lists of equal length."""
    if not len(vectors):
        return np.zeros((0, 0))
    return np.asarray(vectors.flatten()).astype(float).reshape(len(vectors), -1)


def packed_rows(block: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
    """(keys, matrix) of a block of (k, v) whose vectors are the bytes of doubles."""
    keys, data = block.values.field("k"), block.values.field("v").to_pylist()
    return keys, np.frombuffer(b"".join(data), float).reshape(len(data), -1)


def _join_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Joins the trees of the edges (x, y), where ``root`` has each node's root, and returns which edges were needed for it."""
    used, left = [], np.arange(len(x))
    while True:
        low, high = np.minimum(root[x[left]], root[y[left]]), np.maximum(root[x[left]], root[y[left]])
        left, low, high = (c[low < high] for c in (left, low, high))
        if not len(left):
            return np.concatenate(used) if used else np.zeros(0, np.int64)
        # Each root hangs on a smaller one by one edge, so that no circle arises.
        hung, at = np.unique(high, return_index=True)
        used.append(left[at])
        root[hung] = low[at]
        while (root[root] != root).any():
            root[:] = root[root]


def cosine_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK, cells: int = 1024, budget: int | None = None, forest: bool = False, all_pairs: bool = False) -> DataFrame:
    """(a, b, cosine) of all pairs of distinct vectors at or over the threshold, and of each vector's smallest key with the others that have it.

    Vectors meet in blocks (see ``cosine_blocks``), each pair once at most. A vector of zeros is an error. ``budget``, if given, is the
    number of comparisons that all pairs would make at most. With ``forest`` all pairs are compared, but of the near ones of two blocks
    only as many are given as connect what these connect, fewer than the blocks have vectors: enough for ``cluster_pairs``.
    With ``all_pairs`` vectors don't stand by their smallest key: all pairs of keys are given, of which there may be as many as the square
    of a vector's keys; copies are dealt to blocks by their keys as other vectors are. Rows without a vector have no pairs.
    """
    vectors = vectors.where(F.col(vector).isNotNull())
    if budget is not None:
        check_pair_budget(vectors, budget)
    first, links = _representatives(vectors, key, vector)
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")) if all_pairs else first.select(F.col("a").alias("k"), F.col("h").alias("v"))
    blocks = cosine_blocks(rows, threshold, block, cells)
    kind = dict(vectors.dtypes)[key]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                (k1, v1), (k2, v2) = packed_rows(batch.column("left")[row]), packed_rows(batch.column("right")[row])
                alike = batch.column("kind")[row].as_py() == "own" and batch.column("i")[row] == batch.column("j")[row]
                # Roots of the vectors in either block; a block held against itself has one set.
                root = np.arange(len(k1) + (0 if alike else len(k2)))
                for x0 in range(0, len(k1), TILE):
                    for y0 in range(x0 if alike else 0, len(k2), TILE):
                        found = v1[x0 : x0 + TILE] @ v2[y0 : y0 + TILE].T
                        hit = found >= threshold
                        x, y = np.nonzero(np.triu(hit, 1) if alike and x0 == y0 else hit)
                        if forest:
                            used = _join_roots(root, x0 + x, y0 + y + (0 if alike else len(k1)))
                            x, y = x[used], y[used]
                        for at in range(0, len(x), GIVEN):
                            u, w = x[at : at + GIVEN], y[at : at + GIVEN]
                            a, b = k1.take(pa.array(x0 + u)), k2.take(pa.array(y0 + w))
                            yield pa.record_batch([pc.if_else(pc.less(a, b), a, b), pc.if_else(pc.less(a, b), b, a), pa.array(found[u, w])], ["a", "b", "cosine"])

    pairs = blocks.select("kind", "i", "j", "left", "right").mapInArrow(multiply, f"a {kind}, b {kind}, cosine double")
    return pairs.where("a != b") if all_pairs else pairs.unionByName(links.select("a", "b", F.lit(1.0).alias("cosine")))


def cluster_pairs(pairs: DataFrame) -> DataFrame:
    """(node, label): the members of groups that pairs connect, however far; the label is the smallest member."""
    return components(pairs)


def representative_scores(members: DataFrame, cluster: str) -> DataFrame:
    """Adds ``total`` and ``rank`` within the cluster to its members.

    Resolution and sharpness count by their place between the cluster's least and most, on a logarithmic scale.
    Columns: asset_id, area, sharpness, compression_blockiness, alpha_fraction, crop_completeness,
    watermark_probability; nulls count as 0.
    """
    group = Window.partitionBy(cluster)
    own = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    place = lambda name: normalize_log(own(name), F.min(own(name)).over(group), F.max(own(name)).over(group))
    # The shares of the parts.
    total = 0.35 * place("area") + 0.25 * place("sharpness") + 0.15 * clamp(1 - own("compression_blockiness") / 3) + 0.10 * (1 - own("alpha_fraction")) + 0.10 * own("crop_completeness") + 0.05 * (1 - own("watermark_probability"))
    rows = members.withColumn("total", clamp(total))
    return rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("total"), "asset_id")))


def cluster_summary(scored: DataFrame, cluster: str, digest: str) -> DataFrame:
    """(cluster, kind, n, representative, rejected): the kind is exact if there is one digest only.

    Of each digest in a cluster all but the best member are rejected.
    """
    best = Window.partitionBy(cluster, digest).orderBy("rank")
    rows = scored.withColumn("again", F.row_number().over(best) > 1)
    return rows.groupBy(cluster).agg(
        F.when(F.min(digest) == F.max(digest), "exact").otherwise("near").alias("kind"),
        F.count("*").alias("n"),
        F.min_by("asset_id", "rank").alias("representative"),
        F.count_if("again").alias("rejected"),
    )


def merge_groupings(groupings: Sequence[DataFrame]) -> DataFrame:
    """(node, label) of the union of groupings (member, group): what any of them puts together stays together."""
    edges = None
    for rows in groupings:
        # A star from the smallest member stands for the group.
        group = rows.groupBy("group").agg(F.min("member").alias("a"), F.count("*").alias("n")).where("n > 1")
        star = rows.join(group, "group").where("member != a").select("a", F.col("member").alias("b"))
        edges = star if edges is None else edges.unionByName(star)
    return components(edges.distinct())


def group_or_self(cluster: Column, key: Column) -> Column:
    """The cluster of an asset, or the asset itself where it has none."""
    return F.coalesce(cluster, key)
