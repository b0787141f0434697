"""Registered queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name`` with its oracle."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


from . import queries_calls, queries_clusters, queries_evaluation, queries_evidence, queries_files, queries_haplotypes, queries_mapping, queries_matching, queries_scalars, queries_segments  # noqa: E402, F401
