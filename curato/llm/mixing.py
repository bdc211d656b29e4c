"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A budget of tokens is handed down a tree of domain, language and source by weight. A node that hasn't enough tokens
takes all it has, and its shortage goes to its siblings by weight; only what a whole parent lacks goes to the
parent's siblings. Each leaf then takes the token-prefix of its documents in a seeded order, epoch after epoch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREE = ("domain", "lang", "source")
SEED = "mix"
BLANK = "[^ \\t\\n\\r\\f\\x0B]+"
SPACE = "[ \\t\\n\\r\\f\\x0B]*"

# Fixed values of the registered query: relative weights, and the share of all tokens to take.
WEIGHTS = {"domain": {"web": 5.0, "reference": 3.0, "books": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
SHARE, EPOCHS = 0.6, 2


def domain_of(source: Column) -> Column:
    """The domain of a source in the synthetic tables, which have none of their own."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "reference").otherwise("books")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    found = F.lit(1.0)
    for key, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == key, F.lit(float(weight))).otherwise(found)
    return found


def _share_out(nodes: DataFrame, parents: list[str], level: str, weights) -> DataFrame:
    """Adds ``given`` to nodes with ``cap`` and their parent's ``budget``: by weight, no more than the cap."""
    # A constant key keeps the windows of the root's children partitioned like the others.
    by = parents or ["root"]
    nodes = nodes.withColumn("root", F.lit(0)).withColumn("weight", _weight(level, weights))
    order = Window.partitionBy(*by).orderBy(F.col("cap") / F.col("weight"), level)
    taken = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("rate", (F.col("budget") - taken) / left).withColumn("full", F.col("cap") / F.col("weight") <= F.col("rate"))
    rate = F.max(F.when(~F.col("full"), F.col("rate"))).over(Window.partitionBy(*by))
    return nodes.withColumn("given", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rate * F.col("weight"))).drop("root", "weight", "rate", "full")


def targets(leaves: DataFrame, budget_share: float, epochs: int, weights) -> DataFrame:
    """A row for each leaf with its own ``tokens`` and ``target``; ``leaves`` has domain, lang, source and tokens."""
    caps = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * epochs)
    whole = leaves.agg((F.sum("tokens") * F.lit(float(budget_share))).alias("budget"))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(whole))
    domains = _share_out(domains, [], "domain", weights).select("domain", F.col("given").alias("budget"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = _share_out(langs, ["domain"], "lang", weights).select("domain", "lang", F.col("given").alias("budget"))
    found = _share_out(caps.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", weights)
    return found.select(*TREE, "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("target"))


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, seed: str = SEED, domain: Column | None = None, carry: bool = False) -> DataFrame:
    """The documents taken: doc_id, domain, lang, source, epoch, start, n_tokens and take.

    ``start`` counts the leaf's tokens before the document, ``take`` the tokens taken of it (fewer than it has only for
    the last one of a leaf). A null language or source is its own, empty, key; null or empty texts have no tokens and
    are never taken; repeated rows are taken one after another; an empty table gives no rows. With ``carry``, ``row``
    holds the document's own columns.

    Running sums never gather a leaf: the seeded order is that of a hash, whose first two bytes cut a leaf into 256
    times 256 bins, summed before they are added up.
    """
    key = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = docs.select(
        F.col("doc_id"),
        (domain_of(F.coalesce(F.col("source"), F.lit(""))) if domain is None else domain).alias("domain"),
        key("lang"),
        key("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(BLANK)).cast("long").alias("n_tokens"),
        # Orders rows of one id, and draws for those without one.
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    planned = targets(rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), share, epochs, weights)

    drawn = rows.where("n_tokens > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    drawn = drawn.withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("tie")))).cast("binary")))
    drawn = drawn.withColumn("b1", F.substring("draw", 1, 2)).withColumn("b2", F.substring("draw", 3, 2))
    leaf = [*TREE, "epoch"]
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = drawn.groupBy(*leaf, "b1", "b2").agg(F.sum("n_tokens").alias("n"))
    coarse = fine.groupBy(*leaf, "b1").agg(F.sum("n").alias("n"))
    coarse = coarse.select(*leaf, "b1", before(leaf, "b1").alias("earlier")).join(planned, [*TREE])
    coarse = coarse.select(*leaf, "b1", "target", (F.col("earlier") + F.col("epoch") * F.col("tokens")).alias("earlier")).where("earlier < target")
    bins = fine.withColumn("inside", before([*leaf, "b1"], "b2")).join(coarse, [*leaf, "b1"])
    bins = bins.select(*leaf, "b1", "b2", "target", (F.col("earlier") + F.col("inside")).alias("at")).where("at < target")

    place = Window.partitionBy(*leaf, "b1", "b2").orderBy("draw", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = drawn.join(bins, [*leaf, "b1", "b2"]).withColumn("start", F.col("at") + F.coalesce(F.sum("n_tokens").over(place), F.lit(0)))
    taken = taken.where("start < target").withColumn("take", F.least("n_tokens", F.col("target") - F.col("start")))
    return taken.select("doc_id", *leaf, "start", "n_tokens", "take", *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents taken, with their own columns; a document taken in part is cut where its first ``take`` tokens end."""
    taken = mix(docs, carry=True, **options)
    # Each token with the blanks before it.
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"{SPACE}{BLANK}"), F.lit(0)), F.lit(1), F.col("take").cast("int")), "")
    text = F.when(F.col("take") < F.col("n_tokens"), part).otherwise(F.col("row.text"))
    return taken.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """The documents that the registered weights take of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in WEIGHTS.get(level, {}).items()) + " ELSE CAST(1 AS DOUBLE) END" if level in WEIGHTS else "CAST(1 AS DOUBLE)"


def _level_sql(name: str, source: str, parents: str, level: str) -> str:
    by = f"PARTITION BY {parents} " if parents else ""
    keys = f"{parents}, {level}" if parents else level
    return f"""
{name}_w AS (SELECT *, {_case(level)} AS weight FROM ({source})),
{name}_r AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by}ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({by}ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {name}_w),
{name} AS (SELECT {keys}, tokens, CASE WHEN cap / weight <= rate THEN CAST(cap AS DOUBLE) ELSE weight * max(CASE WHEN cap / weight > rate THEN rate END) OVER ({by}) END AS given FROM {name}_r)"""


OP4_SQL = f"""
WITH rows AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(coalesce(source, ''), '^src[1-9]$') THEN 'reference' ELSE 'books' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    md5(coalesce(text, '')) AS tie, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM rows GROUP BY ALL),
caps AS (SELECT *, tokens * {EPOCHS} AS cap FROM leaves WHERE tokens > 0),
{_level_sql("domains", f"SELECT domain, 0 AS tokens, sum(cap) AS cap, (SELECT sum(tokens) * CAST({SHARE} AS DOUBLE) FROM leaves) AS budget FROM caps GROUP BY domain", "", "domain")},
{_level_sql("langs", "SELECT domain, lang, 0 AS tokens, sum(cap) AS cap, any_value(given) AS budget FROM caps JOIN (SELECT domain, given FROM domains) USING (domain) GROUP BY domain, lang", "domain", "lang")},
{_level_sql("sources", "SELECT caps.*, langs.given AS budget FROM caps JOIN langs USING (domain, lang)", "domain, lang", "source")},
planned AS (SELECT domain, lang, source, tokens AS total, CAST(floor(given + 1e-6) AS BIGINT) AS target FROM sources),
drawn AS (SELECT rows.*, epoch, md5(concat_ws(':', '{SEED}', epoch, coalesce(CAST(doc_id AS VARCHAR), '#' || tie))) AS draw FROM rows, (SELECT unnest(range(0, {EPOCHS})) AS epoch) WHERE n_tokens > 0),
placed AS (SELECT *, epoch * total + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY draw, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM drawn JOIN planned USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(start AS BIGINT) AS start, n_tokens, CAST(least(n_tokens, target - start) AS BIGINT) AS take
FROM placed WHERE start < target
"""
