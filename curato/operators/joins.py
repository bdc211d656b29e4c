"""Joins with a promise: complete, one to one, or by any relation of two rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of both sides with one key; a key that is missing or repeated on a side is an error when the rows are read."""
    counts = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    both = counts(left, "_l").join(counts(right, "_r"), key, "full_outer")
    wrong = F.raise_error(F.concat(F.lit("not one to one: "), F.col(key).cast("string"))).cast("boolean")
    fine = (F.coalesce("_l", F.lit(0)) == 1) & (F.coalesce("_r", F.lit(0)) == 1)
    checked = both.where(F.when(fine, F.lit(True)).otherwise(wrong)).select(key)
    return checked.join(left, key).join(right, key)


def complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each row of ``left`` with the one of ``right``; a key without one is an error when the rows are read."""
    rows = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    wrong = F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))).cast("boolean")
    return rows.where(F.coalesce("_there", wrong)).drop("_there")


def related_pairs(rows: DataFrame, key: str, block: Column, relation) -> DataFrame:
    """(a, b) of rows of one block for which ``relation(left, right)`` of their columns holds.

    The block, an expression over a row, must be equal wherever the relation holds: it is what the join goes by.
    """
    own = rows.withColumn("_block", block)
    left, right = own.select(*(F.col(c).alias(f"l_{c}") for c in own.columns)), own.select(*(F.col(c).alias(f"r_{c}") for c in own.columns))
    near = left.join(right, F.col("l__block") == F.col("r__block")).where(F.col(f"l_{key}") < F.col(f"r_{key}"))
    return near.where(relation(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"))).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"))
