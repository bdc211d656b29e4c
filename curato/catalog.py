"""All queries of the library outside ``curato.llm``, by name."""

from __future__ import annotations

from curato.plans import assets, pictures, review, state, tagging, training

_ALL = {**assets.QUERIES, **tagging.QUERIES, **training.QUERIES, **state.QUERIES, **review.QUERIES, **pictures.QUERIES}


def flagship(spark, sf_dir):
    """Review categories of all assets: hashing, duplicates, rules and overrides."""
    return _ALL["review_categories"][0](spark, sf_dir)


def queries() -> dict:
    """Each query by name."""
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict:
    """The DuckDB SQL of each query that has one."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
