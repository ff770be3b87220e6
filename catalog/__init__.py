"""Queries over the benchmark tables, one or more per operator, each with its SQL twin."""

from catalog import clusters, matching, posts, samples, selections, topics, trends, words

MODULES = (topics, posts, matching, trends, words, samples, clusters, selections)


def all_queries() -> dict:
    """Query name -> function of (spark, folder)."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    """Query name -> SQL giving the same rows."""
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
