"""Evaluation operators: confusion by size, precision and recall, consensus, phasing measures."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settled
from .intervals import BIN

#: So many wanted ranks at most are sent to every task.
FEW_RANKS = 100_000

#: Size limits of the evaluation bins.
SIZE_CUTS = [50, 100, 200, 400, 800, 1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000, 50000]


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, null where nothing was called or true."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1")]


def size_bin(svlen: str) -> Column:
    """Number of the size bin: 0 below the first limit; limits open a bin."""
    return sum((F.when(F.col(svlen) >= c, 1).otherwise(0) for c in SIZE_CUTS), F.lit(0))


def confusion_by_size(rows: DataFrame) -> DataFrame:
    """From ``rows(svtype, svlen, outcome)`` with outcomes TP, FP and FN: counts and scores by type and size bin."""
    n = lambda k: F.sum(F.when(F.col("outcome") == k, 1).otherwise(0))
    sums = rows.withColumn("bin", size_bin("svlen")).groupBy("svtype", "bin").agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"))
    return sums.select("svtype", "bin", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def consensus_sweep(members: DataFrame, cluster: list[str], tool: str, most: int) -> DataFrame:
    """For every k from 2 to ``most``: clusters with k or more tools, and each tool's share in them.

    Returns k, tool, bench (clusters), found (of them with the tool), recall and precision.
    """
    votes = members.select(*cluster, tool).distinct()
    support = votes.groupBy(*cluster).agg(F.count("*").alias("support"))
    k = F.explode(F.sequence(F.lit(2), F.lit(most)))
    bench = support.select(k.alias("k"), "support").where("support >= k").groupBy("k").agg(F.count("*").alias("bench"))
    called = votes.groupBy(tool).agg(F.count("*").alias("called"))
    found = votes.join(support, cluster).select(tool, k.alias("k"), "support").where("support >= k").groupBy("k", tool).agg(F.count("*").alias("found"))
    return found.join(bench, "k").join(called, tool).select(
        "k", tool, "bench", "found", F.round(F.col("found") / F.col("bench"), 6).alias("recall"), F.round(F.col("found") / F.col("called"), 6).alias("precision")
    )


def majority_vote(votes: DataFrame, keys: list[str], value: str, missing: str = "./.") -> DataFrame:
    """The most frequent value of each key, or ``missing`` where two are equally frequent."""
    counts = votes.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    best = counts.join(top, [*keys, "n"]).groupBy(*keys).agg(F.count("*").alias("_ties"), F.min(value).alias("_v"), F.first("n").alias("n"))
    return best.select(*keys, F.when(F.col("_ties") == 1, F.col("_v")).otherwise(missing).alias(value), "n")


def n50(blocks: DataFrame, keys: list[str], length: str, share: float = 0.5) -> DataFrame:
    """The greatest length that blocks of at least it hold ``share`` of all.

    Equal lengths are summed up first, so what is sorted is the distinct lengths of a key.
    """
    sums = blocks.groupBy(*keys, length).agg(F.sum(length).alias("_s"))
    w = Window.partitionBy(*keys)
    running = F.sum("_s").over(w.orderBy(F.desc(length)))
    rows = sums.withColumn("_run", running).withColumn("_all", F.sum("_s").over(w))
    return rows.where(F.col("_run") >= share * F.col("_all")).groupBy(*keys).agg(F.max(length).alias("n50"))


def strand_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Watson and Crick counts and (c - w) / (c + w), null without reads."""
    w, c = F.sum(F.when(F.col("strand") == "-", 1).otherwise(0)), F.sum(F.when(F.col("strand") == "+", 1).otherwise(0))
    return rows.groupBy(*keys).agg(w.alias("w"), c.alias("c")).withColumn("ratio", F.round(F.try_divide(F.col("c") - F.col("w"), F.col("c") + F.col("w")), 6))


def _with_bins(rows: DataFrame, bins: DataFrame, block: list[str]) -> DataFrame:
    """``rows`` with the columns that ``bins`` has for their (block, bin), which may be null."""
    for c in [*block, "_bin"]:
        bins = bins.withColumnRenamed(c, "_of_" + c)
    same = [F.col(c).eqNullSafe(F.col("_of_" + c)) for c in [*block, "_bin"]]
    return rows.join(bins, reduce(and_, same)).drop(*["_of_" + c for c in [*block, "_bin"]])


def _neighbours(rows: DataFrame, block: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``_prev`` and ``_next``: the ``value`` of the rows before and after in the block, as structs
    that are null at its ends. Rows are ordered in bins; what crosses a border comes from one row a bin."""
    inside, across = Window.partitionBy(*block, "_bin").orderBy(*order), Window.partitionBy(*block).orderBy("_bin")
    v = F.struct(F.col(value).alias("v"))
    ends = rows.groupBy(*block, "_bin").agg(F.min_by(v, F.struct(*order)).alias("_first"), F.max_by(v, F.struct(*order)).alias("_last"))
    ends = ends.select(*block, "_bin", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    rows = rows.withColumn("_prev", F.lag(v).over(inside)).withColumn("_next", F.lead(v).over(inside))
    rows = _with_bins(rows, ends, block)
    return rows.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after")).drop("_before", "_after")


def switch_flags(snps: DataFrame, block: list[str], pos: str, phase: str, width: int = BIN) -> DataFrame:
    """Marks phase switches against the SNP before in the block: adds switch (0, 1) and, by the SNPs
    next to it, its class: POINT if the neighbour switches too, else LONG."""
    rows = _neighbours(snps.withColumn("_bin", F.floor(F.col(pos) / width)), block, [pos, phase], phase)
    rows = rows.withColumn("switch", F.when(F.col("_prev.v") != F.col(phase), 1).otherwise(0)).drop("_prev", "_next")
    rows = _neighbours(rows.withColumn("_steady", 1 - F.col("switch")), block, [pos, phase, "_steady"], "switch")
    near = (F.coalesce("_prev.v", F.lit(0)) + F.coalesce("_next.v", F.lit(0))) > 0
    rows = rows.withColumn("kind", F.when(F.col("switch") == 0, "CORRECT").when(near, "POINT").otherwise("LONG"))
    return rows.select(*snps.columns, "switch", "kind")


def blocks_between_errors(snps: DataFrame, block: list[str], pos: str, width: int = BIN) -> DataFrame:
    """Splits blocks at switches and returns each piece: block, piece, start, end, n."""
    rows = snps.withColumn("_bin", F.floor(F.col(pos) / width))
    inside = Window.partitionBy(*block, "_bin").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*block).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*block, "_bin").agg(F.sum("switch").alias("_n"))
    sums = sums.select(*block, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rows = _with_bins(rows.withColumn("_in", F.sum("switch").over(inside)), sums, block)
    rows = rows.withColumn("piece", F.col("_off") + F.col("_in"))
    return rows.groupBy(*block, "piece").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n"))


def pairs_by_distance(snps: DataFrame, keys: list[str], pos: str, agree: str, most: int, step: int, chunk: int | None = None) -> DataFrame:
    """Pairs of SNPs up to ``most`` apart by distance bin: bin, pairs, accurate, cumulative pairs.

    ``agree`` is 0 or 1; a pair is accurate if both agree alike. No pair is listed: a chunk of positions
    is a histogram, and how many pairs of two chunks are at each distance comes from the Fourier
    transforms of their histograms, exact after rounding while numbers of pairs are below 2^40 or so. Chunks meet
    those up to ``most`` ahead, one task a pair of chunks. Rows with a null position or agreement are left out.
    """
    width = chunk or min(1 << 21, 1 << max(12, int(most).bit_length()))
    reach = -(-most // width)
    sums = snps.where(F.col(pos).isNotNull() & F.col(agree).isNotNull()).groupBy(*keys, pos).agg(
        F.sum(F.when(F.col(agree) == 1, 1).otherwise(0)).alias("_yes"), F.count("*").alias("_all")
    )
    sums = sums.withColumn("_c", F.floor(F.col(pos) / width)).select(*keys, "_c", (F.col(pos) - F.col("_c") * width).cast("int").alias("_at"), "_yes", "_all")
    ahead = F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_j")
    left = sums.select("*", ahead)
    right = sums.select(*keys, "_c", "_at", "_yes", "_all", ahead).withColumn("_c", F.col("_c") - F.col("_j"))
    on = [*keys, "_c", "_j"]

    def spectra(rows: pd.DataFrame) -> list[np.ndarray]:
        at, every, signed = rows["_at"].to_numpy(), np.zeros(2 * width), np.zeros(2 * width)
        every[at] = rows["_all"].to_numpy()
        signed[at] = 2 * rows["_yes"].to_numpy() - rows["_all"].to_numpy()
        return [np.fft.rfft(every), np.fft.rfft(signed)]

    def count(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"bin": [], "pairs": [], "accurate": []}, dtype="int64")
        j = int(one["_j"].iloc[0])
        found = [np.rint(np.fft.irfft(np.conj(a) * b, 2 * width)) for a, b in zip(spectra(one), spectra(two), strict=True)]
        distance = j * width + np.concatenate([np.arange(width), np.arange(-width, 0)])
        mine = (distance > 0) & (distance <= most) & (found[0] > 0)
        bins, at = np.unique((distance[mine] - 1) // step, return_inverse=True)
        pairs, signed = (np.bincount(at, weights=f[mine], minlength=len(bins)) for f in found)
        return pd.DataFrame({"bin": bins, "pairs": pairs.astype(np.int64), "accurate": ((pairs + signed) / 2).astype(np.int64)})

    tasks = 4 * int(snps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(tasks, *on).groupBy(*on).cogroup(right.repartition(tasks, *on).groupBy(*on)).applyInPandas(count, "bin long, pairs long, accurate long")
    bins = met.groupBy("bin").agg(F.sum("pairs").alias("pairs"), F.sum("accurate").alias("accurate"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # most / step rows
    return bins.select("bin", "pairs", "accurate", F.sum("pairs").over(w).alias("cumulative"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], ranges: int = 1024) -> DataFrame:
    """The exact quantiles of each key, between two neighbouring values in proportion: keys, share, q, n.

    Selection by counts: a wanted rank lies in one of ``ranges`` equal parts of its key's values, so
    each pass counts the rows of every part and goes on with the one that holds the rank, until
    its least and greatest value are the same. What is kept is a row a part, whatever the number of
    values. Null and non-finite values are left out; keys may be null.
    """
    data = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    ends = data.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("n"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = F.col("share") * (F.col("n") - 1)
    open_ = ends.select("*", share).select("*", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    open_ = settled(open_.withColumn("_rank", F.col("rank")))
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    done = None
    while True:
        ready = open_.where("_low = _high").select(*keys, "share", "n", "rank", F.col("_low").alias("v"))
        done = ready if done is None else done.unionByName(ready)
        left = open_.where("_low < _high")
        ranks = left.count()
        if not ranks:
            break
        half = lambda a, b: F.col(a) / 2 - F.col(b) / 2  # noqa: E731  the difference itself may be infinite
        part = F.least(F.floor(half("d._v", "t._low") / (half("t._high", "t._low") / ranges)), F.lit(ranges - 1))
        names = [F.col(f"t.{k}").alias(k) for k in keys]
        near = F.broadcast(left) if ranks <= FEW_RANKS else left
        inside = data.alias("d").join(near.alias("t"), same("d", "t") & F.col("d._v").between(F.col("t._low"), F.col("t._high")))
        counts = inside.select(*names, "t.share", "t.n", "t.rank", "t._rank", part.alias("_part"), "d._v").groupBy(*keys, "share", "n", "rank", "_rank", "_part").agg(
            F.count("*").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = F.sum("_k").over(Window.partitionBy(*keys, "share", "rank").orderBy("_part"))  # up to ``ranges`` rows
        hit = counts.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_k")))
        open_ = settled(hit.select(*keys, "share", "n", "rank", (F.col("_rank") - F.col("_upto") + F.col("_k")).alias("_rank"), "_low", "_high"))
    low, high = F.min(F.struct("rank", "v")), F.max(F.struct("rank", "v"))
    part = F.col("share") * (F.col("n") - 1) - F.col("low.rank")
    return done.groupBy(*keys, "share", "n").agg(low.alias("low"), high.alias("high")).select(
        *keys, "share", (F.col("low.v") + (F.col("high.v") - F.col("low.v")) * part).alias("q"), "n"
    )


def quantile_band(rows: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Rows whose value is from ``low`` to ``high`` times the exact median of their key."""
    median = exact_quantiles(rows, keys, value, [0.5]).select(*keys, F.col("q").alias("_m"))
    return rows.join(median, keys).where(F.col(value).between(low * F.col("_m"), high * F.col("_m"))).drop("_m")


def sample_by_hash(rows: DataFrame, name: Column, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, by the order of a digest of ``seed`` and ``name``; all if there are fewer."""
    return rows.withColumn("_digest", F.md5(F.concat(F.lit(str(seed)), name))).orderBy("_digest").limit(k).drop("_digest")


def rank_classes(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Adds class: bottom or top share of the rows by ``value`` (bottom10, top50, ...), else middle.

    Equal values share a class: one is in the bottom share if all rows up to it fit there, and in the
    top share if all from it on do. Shares come from the counts of distinct values, so no task sorts
    the rows.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("_k"))
    upto = counts.withColumn("_upto", F.sum("_k").over(Window.orderBy(value))).withColumn("_all", F.sum("_k").over(Window.partitionBy(F.lit(0))))
    found = F.lit("middle")
    for share in sorted(shares, reverse=True):
        high, low = 1 - share, share
        name = str(round(100 * share))
        found = F.when(F.col("_upto") <= low * F.col("_all"), "bottom" + name).when(F.col("_upto") - F.col("_k") >= high * F.col("_all"), "top" + name).otherwise(found)
    return rows.join(upto.withColumn("class", found).select(value, "class"), value).select(*rows.columns, "class")
