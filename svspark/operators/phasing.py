"""Accuracy of phasing against a truth: kinds of switch errors, adjusted lengths of blocks and of what lies between errors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import fold_islands, overlap_pairs

#: Codes of ``error``; those from UNDETERMINED to POINT are switches.
CORRECT, UNDETERMINED, LONG, POINT, FIRST = range(5)


def phase_errors(snps: DataFrame, block: list[str], pos: str, phase: str, cutoff: int = 3) -> DataFrame:
    """Phased SNPs with ``error``: FIRST of the block, CORRECT, or the kind of a switch against the one before.

    A switch that ``cutoff`` SNPs without one follow is LONG; two with fewer between them are both
    POINT, and a third starts anew. One among a block's first ``cutoff`` SNPs can't be told to be
    long, nor one with too few SNPs after it: UNDETERMINED. Rows without a phase are left out. Blocks
    are streamed in order; what is held are the SNPs from an open switch on, ``cutoff`` at most.
    """

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
        before, opened, since = None, None, 0  # opened: (number of its row, whether it may be long)
        for at, (number, value) in enumerate(rows):
            if before is None:
                yield number, FIRST
            elif value != before:
                if opened and since < cutoff:
                    yield opened[0], POINT
                    yield number, POINT
                    opened = None
                else:
                    opened = (number, at >= cutoff)
                since = 0
            else:
                since += 1
                yield number, CORRECT
                if opened and since == cutoff:
                    yield opened[0], LONG if opened[1] else UNDETERMINED
                    opened = None
            before = value
        if opened:
            yield opened[0], UNDETERMINED

    phased = snps.where(F.col(phase).isNotNull()).withColumn("_island", F.lit(0))
    return fold_islands(phased, block, [pos, phase], [phase], kernel, "error").drop("_island")


def switch_rate(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Switches in per cent of the SNPs that have one before them in their block: keys, measured, switches, rate."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    code = F.col("error")
    sums = errors.groupBy(*keys).agg(count(code != FIRST).alias("measured"), count(code.between(UNDETERMINED, POINT)).alias("switches"))
    return sums.withColumn("rate", F.round(F.try_divide(100 * F.col("switches"), F.col("measured")), 6))


def adjusted_blocks(snps: DataFrame, errors: DataFrame, cut: bool = False) -> DataFrame:
    """Lengths of blocks, adjusted by the share of SNPs in them that are phased there.

    ``snps`` (chrom, pos): all of them; ``errors`` (chrom, ps, pos, error): the phased ones of block
    ``ps``. With ``cut``, blocks are parted at switches; a part starts at its switch and ends at its
    last SNP without one. The first SNP of a block or part isn't counted, and parts without another
    are left out. Returns chrom, ps, part, total, phased, length, adjusted.
    """
    spans = errors.groupBy("chrom", F.col("ps").alias("block")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    every = snps.select("chrom", F.col("pos").alias("at")).distinct()
    inside = overlap_pairs(spans, every, ["chrom"], F.col("first") + 1, F.col("last"), F.col("at"), F.col("at"))
    own = errors.select("chrom", F.col("ps").alias("block"), F.col("pos").alias("at"), "error")
    rows = inside.join(own, ["chrom", "block", "at"], "left")
    switch = F.coalesce(F.col("error").between(UNDETERMINED, POINT), F.lit(False)) if cut else F.lit(False)
    order = Window.partitionBy("chrom", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_switch", switch).withColumn("part", F.sum(F.col("_switch").cast("int")).over(order).cast("long"))
    phased = ~F.col("_switch") & F.col("error").isNotNull()
    found = rows.groupBy("chrom", "block", "part").agg(
        F.sum((~F.col("_switch")).cast("int")).alias("total"), F.sum(phased.cast("int")).alias("phased"),
        F.coalesce(F.max(F.when(F.col("_switch"), F.col("at"))), F.min("first")).alias("low"), F.max(F.when(phased, F.col("at"))).alias("high"),
    ).where("phased > 0")
    length = F.col("high") - F.col("low") + 1
    return found.select(
        "chrom", F.col("block").alias("ps"), "part", "total", "phased", length.alias("length"), F.round(length * F.col("phased") / F.col("total"), 4).alias("adjusted")
    )
