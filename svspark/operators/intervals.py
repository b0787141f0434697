"""Interval operators: islands, merging, overlap and tolerance joins, depth.

Positions are longs; an interval is (start, end). Running state along a chromosome is kept in coarse
bins and carried over bins by a summary with one row a bin, so no task ever sorts a whole chromosome.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN = 1_000_000


def _binned(df: DataFrame, keys: list[str], pos: str, width: int) -> DataFrame:
    """Rows dealt out once by (keys, bin); what follows in a bin needs no other exchange."""
    return df.where(F.col(pos).isNotNull()).withColumn("_bin", F.floor(F.col(pos) / F.lit(width))).repartition(*keys, "_bin")


def islands(
    df: DataFrame, keys: list[str], pos: str, gap: int, inclusive: bool = True, name: str = "cid", width: int = BIN
) -> DataFrame:
    """Adds ``name``: the number of the gap-and-island cluster within ``keys``, from 1.

    A row starts a cluster if its position is more than ``gap`` after the one before (``inclusive``:
    a distance of ``gap`` still joins; else it doesn't). Rows with equal positions share a cluster;
    rows with a null position have none and are left out. ``keys`` must not be null.

    Clusters are counted in bins; a table with one row a bin, made of keys and positions alone, says
    how many there are before each bin and whether the bin's first goes on from the one before.
    """
    inside = Window.partitionBy(*keys, "_bin").orderBy(pos)
    step = F.col(pos) - F.lag(pos).over(inside)
    new = F.when(step > gap if inclusive else step >= gap, 1).otherwise(0)
    rows = _binned(df, keys, pos, width).withColumn("_new", new)
    ends = rows.select(*keys, "_bin", pos, "_new").groupBy(*keys, "_bin").agg(
        F.min(pos).alias("_low"), F.max(pos).alias("_high"), F.sum("_new").alias("_n")
    )
    across = Window.partitionBy(*keys).orderBy("_bin")
    border = F.col("_low") - F.lag("_high").over(across)
    ends = ends.withColumn("_border", F.when(border.isNull() | (border > gap if inclusive else border >= gap), 1).otherwise(0))
    before = F.sum(F.col("_n") + F.col("_border")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ends = ends.select(*keys, "_bin", before.alias("_before"))
    return (
        rows.withColumn("_in", F.sum("_new").over(inside))  # rows with equal positions count alike
        .join(ends, [*keys, "_bin"])
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_before", "_in", "_new", "_bin")
    )


def merge_islands(
    df: DataFrame, keys: list[str], start: str, end: str, gap: int, name: str = "cid", width: int = BIN
) -> DataFrame:
    """Adds ``name``, the first start of the island: intervals join while start - (greatest end so far) < ``gap``.

    Rows with a null start or end are left out. What earlier bins reach, and where their last island
    starts, comes from a table with one row a bin.
    """
    inside = Window.partitionBy(*keys, "_bin").orderBy(start, end)
    so_far = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(so_far.isNull() | (F.col(start) - so_far >= gap), F.col(start))  # the start, if nothing in the bin reaches it
    rows = _binned(df.where(F.col(end).isNotNull()), keys, start, width).withColumn("_apart", apart)
    ends = rows.select(*keys, "_bin", end, "_apart").groupBy(*keys, "_bin").agg(F.max(end).alias("_max"), F.max("_apart").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_reach", F.max("_max").over(earlier))
    free = lambda c: F.col("_reach").isNull() | (F.col(c) - F.col("_reach") >= gap)
    ends = ends.withColumn("_last", F.when(free("_last"), F.col("_last"))).select(
        *keys, "_bin", "_reach", F.max("_last").over(earlier).alias("_open")
    )
    rows = rows.join(ends, [*keys, "_bin"]).withColumn("_first", F.when(free("_apart"), F.col("_apart")))
    return rows.withColumn(name, F.coalesce(F.max("_first").over(inside), "_open")).drop("_bin", "_apart", "_reach", "_open", "_first")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int, flank: int = 0, clamp: bool = True) -> DataFrame:
    """Merged regions: keys, start, end, n; widened by ``flank`` on either side and cut off at 0."""
    merged = merge_islands(df, keys, start, end, gap).groupBy(*keys, "cid").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")
    )
    low = F.col("start") - flank
    return merged.select(*keys, (F.greatest(low, F.lit(0)) if clamp else low).alias("start"), (F.col("end") + flank).alias("end"), "n")


def fold_islands(parted: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable, name: str) -> DataFrame:
    """Adds a long column ``name`` that ``kernel`` gives for the rows of each island of ``parted`` (column ``_island``).

    For what depends on order row by row. The kernel is a generator: it gets an island's rows in
    ``order``, as tuples of a number and ``columns``, and yields (number, value) for each once it's
    known. Islands are dealt out and sorted by Spark and streamed; what a task holds are the Arrow
    batches with rows that the kernel hasn't answered yet.
    """
    fields = T.StructType([*parted.schema.fields, T.StructField(name, T.LongType())])
    buckets = 4 * int(parted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[list] = deque()  # [batch, values, number of its first row, rows to answer]
        total = 0

        def rows() -> Iterator[tuple]:
            nonlocal total
            for batch in batches:
                if len(batch):
                    first, total = total, total + len(batch)
                    held.append([batch, np.zeros(len(batch), dtype=np.int64), first, len(batch)])
                    island = zip(*[batch[c].tolist() for c in [*keys, "_island"]], strict=True)
                    yield from zip(island, range(first, total), *[batch[c].tolist() for c in columns], strict=True)

        for _, island in groupby(rows(), key=lambda row: row[0]):
            for number, value in kernel(row[1:] for row in island):
                at = next(h for h in held if number < h[2] + len(h[1]))
                at[1][number - at[2]] = value
                at[3] -= 1
                while held and not held[0][3]:
                    batch, values, *_ = held.popleft()
                    batch[name] = values
                    yield batch

    return parted.repartition(buckets, *keys, "_island").sortWithinPartitions(*keys, "_island", *order).mapInPandas(run, fields)


#: Widths of bins of one level and the next; intervals of a level touch this many bins at most, but for the last.
WIDER = 64


def _level_bins(low: str, high: str, width: int, levels: int) -> tuple[Column, Column]:
    """The level of an interval by its length, and its (level, bin)s there and on all coarser levels."""
    own = F.lit(levels - 1)
    for level in reversed(range(levels - 1)):
        own = F.when(F.col(high) - F.col(low) < WIDER * width * WIDER**level, level).otherwise(own)

    def bins(level: int) -> Column:
        wide = width * WIDER**level
        numbers = F.sequence(F.floor(F.col(low) / wide), F.floor(F.col(high) / wide))
        found = F.transform(numbers, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))
        return F.when(own <= level, found).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

    return own, F.concat(*[bins(level) for level in range(levels)])


def _sided_bins(low: str, high: str, width: int, levels: int, left: bool) -> Column:
    """The (level, bin)s of an interval with whom it meets there, so that no two meet above their own levels.

    On side 0 a left one on its own level meets the right ones of that level and of finer ones, on side 1 a left one of a
    finer level those on their own.
    """
    own, bins = _level_bins(low, high, width, levels)
    at = lambda b, side: F.struct(b["level"].alias("level"), b["bin"].alias("bin"), F.lit(side).alias("side"))
    if left:
        return F.transform(bins, lambda b: F.when(b["level"] == own, at(b, 0)).otherwise(at(b, 1)))
    return F.flatten(F.transform(bins, lambda b: F.when(b["level"] == own, F.array(at(b, 0), at(b, 1))).otherwise(F.array(at(b, 0)))))


def overlap_pairs(
    left: DataFrame, right: DataFrame, on: list[str], ls: Column, le: Column, rs: Column, re: Column, width: int = 20_000, levels: int = 1
) -> DataFrame:
    """Inner join of intervals that touch or overlap: least(ends) - greatest(starts) >= 0.

    Both sides are dealt to bins of ``width`` and meet in equal (``on``, bin); a pair is kept in the
    bin where its common part starts, so it comes once. ``on`` columns come once; other columns of
    the two sides must have different names. Intervals with nulls or end < start meet nothing.

    With more ``levels`` an interval has the bins of the level that its length asks for and of all
    coarser ones, and a pair meets on the coarser of its two levels alone. A few rows more for short
    intervals, but 64 bins and not length / ``width`` for long ones.
    """
    a = left.withColumn("_ls", ls).withColumn("_le", le).where("_ls <= _le")
    b = right.withColumn("_rs", rs).withColumn("_re", re).where("_rs <= _re")
    start = F.greatest("_ls", "_rs")
    if levels == 1:
        a = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_ls") / width), F.floor(F.col("_le") / width))))
        b = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_rs") / width), F.floor(F.col("_re") / width))))
        pairs = a.join(b, [*on, "_bin"]).where(F.floor(start / width) == F.col("_bin"))
    else:
        key = ["_level", "_bin", "_side"]
        dealt = lambda rows, bins: rows.withColumn("_b", F.explode(bins)).withColumns({k: F.col("_b." + k.strip("_")) for k in key}).drop("_b")
        a, b = dealt(a, _sided_bins("_ls", "_le", width, levels, True)), dealt(b, _sided_bins("_rs", "_re", width, levels, False))
        wide = F.lit(width) * F.pow(F.lit(WIDER), F.col("_level")).cast("long")
        pairs = a.join(b, [*on, *key]).where(F.floor(start / wide) == F.col("_bin")).drop("_level", "_side")
    return pairs.where((F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le"))).drop("_bin", "_ls", "_le", "_rs", "_re")


def depth(intervals: DataFrame, reads: DataFrame, on: list[str], width: int = 20_000) -> DataFrame:
    """Mean depth over the positions of each interval that some read covers: adds bases, covered, depth.

    ``intervals``: on, iid, start, end (half-open); ``reads``: on, r_start, r_end (half-open). The
    covered length is that of the merged, clipped reads, so no position is listed.
    """
    pairs = overlap_pairs(
        intervals, reads, on, F.col("start"), F.col("end") - 1, F.col("r_start"), F.col("r_end") - 1, width
    ).select(*on, "iid", F.greatest("start", "r_start").alias("s"), F.least("end", "r_end").alias("e"))
    merged = merge_islands(pairs, ["iid"], "s", "e", 1).groupBy("iid", "cid").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("bases")
    )
    sums = merged.groupBy("iid").agg(F.sum("bases").alias("bases"), F.sum(F.col("e") - F.col("s")).alias("covered"))
    return intervals.join(sums, "iid", "left").select(
        *intervals.columns, F.coalesce("bases", F.lit(0)).alias("bases"), F.coalesce("covered", F.lit(0)).alias("covered"),
        F.try_divide("bases", "covered").alias("depth"),
    )


def coverage_bins(reads: DataFrame, on: list[str], width: int) -> DataFrame:
    """Bases of reads in each bin of ``width``: on, bin, bases, n_reads; bins without reads are absent."""
    rows = reads.where("r_start < r_end").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("r_start") / width), F.floor((F.col("r_end") - 1) / width)))
    )
    part = F.least("r_end", (F.col("bin") + 1) * width) - F.greatest("r_start", F.col("bin") * width)
    return rows.groupBy(*on, "bin").agg(F.sum(part).alias("bases"), F.count("*").alias("n_reads"))
