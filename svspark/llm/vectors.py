"""What the vector operators share: usable rows, and a grid where blocks of vectors meet blocks of queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def usable(v: str, zero: bool = True) -> Column:
    """Whether a column holds a vector without null or non-finite components; ``zero``: also if all are 0."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def floored(v: str, scale: float) -> Column:
    """Components as longs: floor(``scale`` * x), at most a long's greatest."""
    return F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once with a number ``row`` for each, so that rows that repeat an id stay apart."""
    return cut(rows.select("*", F.monotonically_increasing_id().alias("row")), name)


def parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def meet(
    candidates: DataFrame,
    asked: DataFrame,
    keys: list[str],
    blocks: int,
    query_blocks: int,
    run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """``run`` on every cell of the grid: a block of candidates and a block of queries with equal ``keys``.

    Rows are dealt to blocks by a hash of ``row``, so no key and no id is crowded in one; a task holds
    one cell at a time.
    """
    left = candidates.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
        "*",
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
        F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(query_blocks)).cast("int").alias("q"),
        "*",
    )
    on = [*keys, "b", "q"]
    tasks = min(4096, blocks * query_blocks * (4 if len(keys) > 1 else 1))  # a cell is much work on little data
    return (
        left.repartition(tasks, *on).groupBy(*on)
        .cogroup(right.repartition(tasks, *on).groupBy(*on))
        .applyInPandas(run, schema)
    )
