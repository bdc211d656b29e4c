"""Document fingerprints of closed syncmers, with DataFrame functions only.

A k-mer of words is an anchor if the smallest hash among its inner s-mers is that of its first or last one. Whether it
is depends on the k-mer alone, so an edit elsewhere never moves an anchor, and anchors in text order can be matched by
position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.llm.common import materialise

K, S = 4, 2
#: Rows of a bucket of consecutive ids, and how many buckets there are at most; beyond that they get larger.
PER_BUCKET, BUCKETS = 1024, 1 << 14
#: Stands for a null id.
LEAST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, which a lambda would otherwise compute for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The lower-cased runs of non-blanks, none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")


def _positions(low: Column) -> Column:
    return F.sequence(F.lit(0), low)


def _chosen(h: Column, k: int, s: int) -> Column:
    """Positions of the closed syncmers among the word hashes ``h``, which are ``k`` at least."""
    width = k - s + 1
    inner = F.transform(_positions(F.size(h) - s), lambda i: F.xxhash64(*(h[i + j] for j in range(s))))
    smallest = lambda m, i: F.least(*(m[i + j] for j in range(width)))
    return let(inner, lambda m: F.filter(_positions(F.size(h) - k), lambda i: let(smallest(m, i), lambda low: (low == m[i]) | (low == m[i + width - 1]))))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in order as unsigned 32-bit hashes; a text of fewer than ``k`` words has one for all its words."""
    high = lambda h: F.shiftrightunsigned(h, 32)
    of = lambda h: F.transform(_chosen(h, k, s), lambda i: high(F.xxhash64(*(h[i + j] for j in range(k)))))
    few = lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(high(F.xxhash64(h))))
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= k, of(h)).otherwise(few(h)))


def fingerprint(found: Column) -> Column:
    """Anchors as text: their hexadecimal hashes in order."""
    return F.array_join(F.transform(found, lambda a: F.hex(a)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two sets of anchors, 0 to 1; two empty ones are alike."""
    both = lambda x, y: F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1)))
    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: both(x, y)))


def anchor_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """A row (doc_id, position, anchor) for each closed syncmer, for positional matching by a join on ``anchor``."""
    h = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    one = lambda h, i: F.struct(i.alias("position"), F.xxhash64(*(h[i + j] for j in range(k))).alias("anchor"))
    found = let(h, lambda h: F.when(F.size(h) >= k, F.transform(_chosen(h, k, s), lambda i: one(h, i))))
    return docs.select(F.col(doc_id), F.explode(found).alias("a")).select(doc_id, "a.position", "a.anchor")


def _cuts(ids: DataFrame, per_bucket: int, most: int) -> tuple[list[int], dict[int, int]]:
    """Where buckets of ids begin, and the number of slices of each id that holds a bucket's share of rows or more.

    The driver gets a few numbers for each of ``most`` buckets, whatever the rows: ids drawn by their hash, of which
    every eighth is a cut, and the hot ids, which are buckets of their own.
    """
    total = ids.count()
    n = min(most, max(1, total // per_bucket))
    if n == 1:
        return [], {}
    counts = ids.groupBy("id").agg(F.count("*").alias("c"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(8 * n * (1 << 40) // total)
    found = sorted((r["id"], r.c) for r in counts.where(drawn | (F.col("c") * n >= total)).collect())
    slices = {i: -(-c * n // total) for i, c in found if c * n >= total}
    after = {i + 1 for i in slices if i < -(LEAST + 1)}
    return sorted({i for i, _ in found[4::8]} | set(slices) | after), slices


def _placed(rows: DataFrame, cuts: list[int], slices: dict[int, int]) -> DataFrame:
    """Adds the ``bucket`` of ``id`` and, for hot ids, the ``slice`` of ``tie``; both go up with what they cut."""
    bucket, at = F.lit(0), F.lit(0)
    if cuts:
        starts = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
        steps = F.array(*(F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)))
        bucket = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(starts, low + step - 1) <= F.col("id"), low + step).otherwise(low))
    if slices:
        hot = rows.sparkSession.createDataFrame(list(slices.items()), "id long, n_slices long")
        rows = rows.join(F.broadcast(hot), "id", "left")
        high = F.shiftright("tie", 32) + F.lit(1 << 31)
        at = F.shiftright(high * F.coalesce("n_slices", F.lit(1)), 32).cast("int")
    return rows.select("doc_id", "id", "tie", "text", bucket.alias("bucket"), at.alias("slice"))


def with_next(docs: DataFrame, doc_id: str, text: str, per_bucket: int = PER_BUCKET, most: int = BUCKETS) -> DataFrame:
    """(doc_id, text, next): next is the text of the following row by descending id; after the last comes the first.

    Ids are long numbers, a null one counts as the least of all, a null text is empty. Rows of one id follow each other
    by descending hash of their text, repeated rows one after another. Ids go to buckets of about as many rows, however
    they are spread; a hot id is cut by that hash. Only the first row's key of each bucket goes to one task.
    """
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST)).alias("id")
    rows = docs.select(F.col(doc_id).alias("doc_id"), number, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = _placed(rows.withColumn("tie", F.xxhash64("text")), *_cuts(docs.select(number), per_bucket, most))
    place = ["bucket", "slice"]
    heads = materialise(rows.groupBy(*place).agg(F.max(F.struct("id", "tie")).alias("key")).select(*place, "key.*"), "heads")
    turn = Window.orderBy(*map(F.desc, place))
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(turn), F.first(c).over(whole)).alias(c)
    # At most a few keys for each of ``most`` buckets.
    keys = F.broadcast(heads.select("id", "tie"))
    texts = rows.join(keys, ["id", "tie"]).groupBy("id", "tie").agg(F.max("text").alias("after"))
    after = heads.select(*place, following("id"), following("tie")).join(texts, ["id", "tie"]).select(*place, "after")
    order = [F.desc("id"), F.desc("tie"), F.desc("text")]
    inside = rows.withColumn("next", F.lead("text").over(Window.partitionBy(*place).orderBy(*order)))
    return inside.join(after, place).select("doc_id", "text", F.coalesce("next", "after").alias("next"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text (the last third replaced by the start of the next document's).

    An empty table gives no rows; a table of one row follows itself. Empty texts have an empty fingerprint.
    """
    rows = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - tail).cast("int")), F.substring("next", F.lit(1), tail)))
    together = F.struct(anchors(F.col("text")).alias("a"), anchors(F.col("edited")).alias("e"), anchors(F.col("next")).alias("n"))
    report = lambda x: F.struct(
        fingerprint(x["a"]).alias("fingerprint"),
        fingerprint(x["e"]).alias("edited_fingerprint"),
        likeness(x["a"], x["e"]).alias("near_edited"),
        likeness(x["a"], x["n"]).alias("near_next"),
    )
    found = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), let(together, report).alias("r"))
    return found.select("doc_id", "n_chars", "edited_sha256", "r.*")


def op10_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
