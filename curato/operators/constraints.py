"""Constraints as operators: what holds of each row, and what doesn't."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Device names that no file may have.
RESERVED = "con prn aux nul com1 com2 com3 com4 com5 com6 com7 com8 com9 lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9".split()


def validate(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations): violations are (key, rule); a rule that is null for a row is violated."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda r: r.isNotNull())
    checked = rows.withColumn("_broken", broken)
    return checked.where(F.size("_broken") == 0).drop("_broken"), checked.select(key, F.explode("_broken").alias("rule"))


def strict(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows, or an error at the first one that violates a rule."""
    out = rows
    for name, rule in rules.items():
        out = out.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"violated: {name}")).cast("boolean")))
    return out


def safe_name(name: Column) -> Column:
    """Whether a file name is allowed everywhere: no reserved sign, control character, device or trailing blank or dot."""
    stem = F.lower(F.substring_index(name, ".", 1))
    return (F.length(name) > 0) & ~name.rlike("[<>:\"/\\\\|?*\\x00-\\x1f]") & ~name.rlike("[ .]$") & ~stem.isin(*RESERVED)


def safe_asset_id(value: Column) -> Column:
    """Whether an id is 64 hexadecimal digits in lower case."""
    return value.rlike("^[0-9a-f]{64}$")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def allowed_changes(changes: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Adds ``problem`` to (field, value, locked): unknown fields, locked ones and values out of range."""
    low = F.create_map(*(F.lit(x) for k, (a, _) in limits.items() for x in (k, float(a))))[F.col("field")]
    high = F.create_map(*(F.lit(x) for k, (_, b) in limits.items() for x in (k, float(b))))[F.col("field")]
    problem = F.when(low.isNull(), "unknown").when(F.col("locked"), "locked").when((F.col("value") < low) | (F.col("value") > high), "range")
    return changes.withColumn("problem", problem)
