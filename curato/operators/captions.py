"""Captions: assembly, parsing, audit, refinement proposals and trigger candidates."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.functions import tags as ontology
from curato.operators.tags import normalize_scores

#: Tags of a caption at most, and separators that no tag may hold.
MOST_TAGS = 75
SEPARATOR = "[,;|\\n\\r]"
# Trigger words that would be taken for common tags.
COLLISIONS = "1boy 1girl 2boys 2girls animal best_quality furry group highres indoors lowres masterpiece multiple_boys multiple_girls outdoors person portrait signature solo text watermark".split()


def build(scores: DataFrame, trigger: str, decision: DataFrame, invariants: DataFrame, forbidden: Sequence[str] = ontology.SOURCES, most: int = MOST_TAGS) -> DataFrame:
    """(asset_id, caption, removed): trigger, class token if there is one, then the kept tags by category, score and name.

    Source and quality tags, invariants and, with a class token, person classes are removed. ``decision`` has one row,
    ``invariants`` the selected tags: no more than the ontology's identity tags.
    """
    assets = scores.select("asset_id").distinct()
    gone = sorted({*ontology.SOURCES, *forbidden})
    bound = invariants.where("selected").agg(F.collect_set("tag").alias("bound"))
    rows = normalize_scores(scores).crossJoin(F.broadcast(decision.select("token"))).crossJoin(F.broadcast(bound))
    drop = F.col("category").isin(*gone) | F.array_contains("bound", F.col("tag")) | (F.col("token").isNotNull() & (F.col("category") == "person_class"))
    rows = rows.withColumn("drop", drop)
    entry = F.struct(ontology.rank(F.col("category")).alias("r"), (-F.col("score")).alias("s"), F.col("tag").alias("tag"))
    found = rows.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.when(~F.col("drop"), entry))).alias("kept"), F.sort_array(F.collect_set(F.when(F.col("drop"), F.col("tag")))).alias("removed"))
    found = assets.join(found, "asset_id", "left").crossJoin(F.broadcast(decision.select("token")))
    fixed = F.filter(F.array(F.lit(trigger), ontology.display(F.col("token"))), lambda x: x.isNotNull())
    variable = F.transform(F.slice(F.coalesce("kept", F.array().cast(T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("tag", T.StringType())])))), F.lit(1), F.lit(most) - F.size(fixed)), lambda e: ontology.display(e["tag"]))
    return found.select("asset_id", F.array_join(F.concat(fixed, variable), ", ").alias("caption"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed"))


def parse(caption: Column) -> Column:
    """The tags of a caption without quotes: cut at commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(caption, ","), lambda t: F.regexp_replace(t, "^\\s+|\\s+$", "")), lambda t: t != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _quoted(captions: pd.Series) -> pd.Series:
    def tags(caption):
        if caption is None:
            return None
        rows = list(csv.reader(io.StringIO(caption), skipinitialspace=True))
        return [t.strip() for t in rows[0] if t.strip()] if len(rows) == 1 else None

    return captions.map(tags)


def parse_quoted(caption: Column) -> Column:
    """As ``parse``, with quoted tags that may hold commas; null for more than one line. Only quotes and lines go to Python."""
    special = caption.rlike("[\"\r\n]") & (F.length(F.regexp_replace(caption, "\\s", "")) > 0)
    return F.when(special, _quoted(F.when(special, caption))).otherwise(parse(caption))


def audit(captions: DataFrame, trigger: str, class_token: str | None = None, invariant_tags: Sequence[str] = (), style: bool = False) -> DataFrame:
    """Adds ``tags``, ``issues`` and flags to captions (asset_id, caption).

    Tags may stand in quotes. Issues in order: invalid_caption for more than one line, empty_caption (and no other), trigger_missing or trigger_not_first, duplicated_tags,
    forbidden_tags, identity_invariant_leak, class_token_inconsistent.
    """
    gone = ["quality", "rating", "resolution", "text_watermark", "character", "copyright"] + ["artist", "style"] * style
    rows = captions.withColumn("parsed", parse_quoted(F.col("caption")))
    rows = rows.withColumn("invalid", F.col("parsed").isNull() & F.col("caption").isNotNull()).withColumn("tags", F.coalesce("parsed", F.array().cast("array<string>"))).drop("parsed")
    rest = F.transform(F.slice("tags", F.lit(2), F.greatest(F.size("tags") - 1, F.lit(0))), lambda t: ontology.canonical(t))
    rows = rows.withColumn("canonical", F.when(F.size("tags") > 1, rest).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("kinds", F.transform("canonical", lambda t: ontology.category(t)))
    empty = F.size("tags") == 0
    second = F.lit(True) if class_token is None else (F.size("tags") > 1) & (F.try_element_at("tags", F.lit(2)) == class_token.replace("_", " "))
    leak = F.size(F.array_intersect("canonical", F.array(*map(F.lit, invariant_tags)).cast("array<string>"))) > 0
    first = F.try_element_at("tags", F.lit(1)) == trigger
    issues = F.array(
        F.when(F.col("invalid"), "invalid_caption"),
        F.when(empty, "empty_caption"),
        F.when(~empty & ~first, F.when(F.array_contains("tags", trigger), "trigger_not_first").otherwise("trigger_missing")),
        F.when(~empty & (F.size(F.array_distinct("canonical")) < F.size("canonical")), "duplicated_tags"),
        F.when(~empty & F.exists("kinds", lambda k: k.isin(*gone)), "forbidden_tags"),
        F.when(~empty & leak, "identity_invariant_leak"),
        F.when(~empty & ~F.coalesce(second, F.lit(False)), "class_token_inconsistent"),
    )
    rows = rows.withColumn("issues", F.filter(issues, lambda i: i.isNotNull())).drop("invalid")
    rows = rows.withColumn("clothing", ~empty & F.array_contains("kinds", "clothing"))
    rows = rows.withColumn("semantic", ~empty & F.exists("kinds", lambda k: ~k.isin(*ontology.EMPTY_OF_CONTENT)))
    return rows.withColumn("consistent", ~empty & F.coalesce(second, F.lit(False)))


def issue_rows(audited: DataFrame, key: str = "asset_id") -> DataFrame:
    """(key, ordinal, code): a row for each issue.

    The outer form, as the plain one makes a filter on the issues, which Catalyst moves below the audit with all its expressions repeated.
    """
    return audited.select(key, F.posexplode_outer("issues").alias("ordinal", "code")).where(F.col("code").isNotNull())


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row over audited captions."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    n = F.size("tags")
    return audited.agg(
        (F.count_if(F.size("issues") > 0) == 0).alias("passed"),
        F.count("*").alias("captions"),
        F.coalesce(F.min(n), F.lit(0)).alias("tags_min"),
        F.coalesce(F.max(n), F.lit(0)).alias("tags_max"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("tags_mean"),
        share("clothing").alias("clothing_coverage"),
        share("semantic").alias("semantic_coverage"),
        F.coalesce(F.avg(F.col("consistent").cast("double")), F.lit(1.0)).alias("class_consistency"),
    )


def proposal_diff(proposals: DataFrame) -> DataFrame:
    """Adds ``added`` and ``removed`` to (original, effective), in their order and as often as they stand there."""
    rows = proposals.withColumn("added", F.filter("effective", lambda t: ~F.array_contains("original", t)))
    return rows.withColumn("removed", F.filter("original", lambda t: ~F.array_contains("effective", t)))


def proposal_contract(drafts: DataFrame, proposals: DataFrame) -> DataFrame:
    """(asset_id, problem) where proposals aren't one for each draft: missing, unknown or repeated."""
    counts = proposals.groupBy("asset_id").agg(F.count("*").alias("n"))
    both = drafts.select("asset_id", F.lit(True).alias("d")).join(counts, "asset_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("d").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select("asset_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def validate_proposals(proposals: DataFrame, vocabulary: DataFrame, most: int, forbidden: Sequence[str] = ontology.SOURCES) -> DataFrame:
    """(asset_id, accepted, rejected) of proposals (asset_id, decision, original, effective).

    Tags are taken in order: repeated, empty and separator-holding ones are rejected, original ones stay, others must
    be in the vocabulary, of an allowed category, and leave room for the original ones that are kept. A decision to
    keep that changes tags keeps the original. ``vocabulary`` (tag, model_category) is joined, not broadcast.
    """
    rows = proposals.withColumn("canonical", F.transform("effective", lambda t: ontology.canonical(t)))
    tags = rows.select("asset_id", "original", F.posexplode("canonical").alias("place", "tag")).join(vocabulary.select(F.col("tag"), F.col("model_category").alias("model"), F.lit(True).alias("known")), "tag", "left")
    before = Window.partitionBy("asset_id", "tag").orderBy("place")
    kind = ontology.category(F.col("tag"), F.col("model"))
    tags = tags.withColumn("own", F.array_contains("original", F.col("tag")))
    why = (
        F.when(F.row_number().over(before) > 1, "duplicate")
        .when(F.col("tag") == "", "empty")
        .when(F.col("tag").rlike(SEPARATOR), "separator")
        .when(F.col("own"), F.lit(None))
        .when(F.col("known").isNull(), "unknown")
        .when(kind.isin(*forbidden), "forbidden")
    )
    tags = tags.withColumn("why", why)
    entry = F.struct("place", "tag", F.coalesce("why", F.lit("")).alias("why"), "own")
    folded = tags.groupBy("asset_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    kept = F.filter("e", lambda e: e["why"] == "")
    owned = F.size(F.filter(kept, lambda e: e["own"]))
    # Room for the original tags that are kept is set apart: others are taken in order until the rest is full.
    others = F.filter(kept, lambda e: ~e["own"])
    taken = F.slice(others, F.lit(1), F.greatest(F.lit(most) - owned, F.lit(0)))
    late = F.slice(others, F.greatest(F.lit(most) - owned, F.lit(0)) + 1, F.greatest(F.size(others), F.lit(1)))
    accepted = F.transform(F.array_sort(F.concat(F.filter(kept, lambda e: e["own"]), taken)), lambda e: e["tag"])
    refused = F.concat(F.filter("e", lambda e: e["why"] != ""), F.transform(late, lambda e: F.struct(e["place"].alias("place"), e["tag"].alias("tag"), F.lit("too_many").alias("why"), e["own"].alias("own"))))
    rejected = F.transform(F.array_sort(refused), lambda e: F.concat_ws(":", e["tag"], e["why"]))
    found = rows.join(folded.select("asset_id", accepted.alias("a"), rejected.alias("r")), "asset_id", "left")
    kept_as_is = (F.col("decision") == "keep") & (F.col("canonical") != F.col("original"))
    none = F.array().cast("array<string>")
    return found.select("asset_id", F.when(kept_as_is, F.col("original")).otherwise(F.coalesce("a", none)).alias("accepted"), F.when(kept_as_is, F.array(F.lit("*:keep_changed"))).otherwise(F.coalesce("r", none)).alias("rejected"))


def valid_trigger(value: Column) -> Column:
    """Whether a trimmed text may be a trigger: 1 to 64 characters, no separator, single blanks, no common tag."""
    bare = F.regexp_replace(value, "^\\s+|\\s+$", "")
    return (F.length(bare) > 0) & (F.length(bare) <= 64) & ~bare.rlike(SEPARATOR) & ~bare.rlike("\\s\\s|[^\\S ]") & ~ontology.canonical(bare).isin(*COLLISIONS)


def trigger_candidates(candidates: DataFrame, place: str = "place", value: str = "value", least: int = 3, most: int = 5) -> DataFrame:
    """(place, value): the first five valid candidates, one for each lower-cased text and none that is a known tag.

    Fewer than ``least`` of them are an error.
    """
    bare = F.regexp_replace(F.col(value), "^\\s+|\\s+$", "")
    rows = candidates.where(valid_trigger(F.col(value))).select(F.col(place), bare.alias(value))
    rows = rows.where(ontology.category(ontology.canonical(F.col(value))) == "unclassified")
    first = rows.groupBy(F.lower(value).alias("k")).agg(F.min(F.struct(place, value)).alias("f"))
    # One row of five candidates at most.
    found = first.select("f.*").orderBy(place).limit(most).agg(F.sort_array(F.collect_list(F.struct(place, value))).alias("c"))
    few = F.raise_error(F.lit(f"fewer than {least} valid trigger candidates")).cast(found.schema["c"].dataType)
    return found.select(F.explode(F.when(F.size("c") >= least, F.col("c")).otherwise(few)).alias("c")).select("c.*")


def pack_items(rows: DataFrame, order: str, most: int = 8, ranges: int = 64) -> DataFrame:
    """Adds ``batch``: consecutive rows by ``order``, ``most`` to a batch.

    Positions come from counts of ranges of ids and places within them.
    """
    edges = sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.01)))
    part = F.lit(0)
    for edge in edges:
        part = part + (F.col(order) > edge).cast("int")
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return rows.join(F.broadcast(sizes), "part").withColumn("batch", F.floor(place / most)).drop("part", "earlier")


def pack_bytes(rows: DataFrame, group: str, key: str, size: str, most_items: int, most_bytes: int) -> DataFrame:
    """(group, key, batch) within each group: a new batch when the next item would make it too large.

    An item over the limit alone is an error. A group's items come in order, and only the open batch is kept in mind.
    """

    schema = T.StructType([rows.schema[group], rows.schema[key], T.StructField("batch", T.LongType())])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, batch, items, used = None, 0, 0, 0
        for some in batches:
            out = []
            for name, n in zip(some[group], some[size]):
                if n > most_bytes:
                    raise ValueError("an item is over the limit")
                if name != own:
                    own, batch, items, used = name, 0, 0, 0
                elif items == most_items or used + n > most_bytes:
                    batch, items, used = batch + 1, 0, 0
                items, used = items + 1, used + n
                out.append(batch)
            yield some[[group, key]].assign(batch=out)

    return rows.select(group, key, size).repartition(group).sortWithinPartitions(group, key).mapInPandas(pack, schema)
