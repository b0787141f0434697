"""Matching operators between call sets, signatures, regions and reads."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edits import edits
from ..functions.scalars import overlap_over_greatest, overlap_over_least, size_similarity
from ..lineage import settled
from .intervals import fold_islands, islands, overlap_pairs


#: Levels of bins where intervals may be of any length.
LEVELS = 3


def within(left: DataFrame, right: DataFrame, on: list[str], lpos: str, rpos: str, radius: Column | int, width: int = 5_000) -> DataFrame:
    """Pairs with |lpos - rpos| <= ``radius`` (a number or a column of the left side), each once.

    A radius that is a column may be of any size: bins then follow it.
    """
    r = F.lit(radius) if isinstance(radius, int) else radius
    return overlap_pairs(left, right, on, F.col(lpos) - r, F.col(lpos) + r, F.col(rpos), F.col(rpos), width, 1 if isinstance(radius, int) else LEVELS)


def overlap_support(calls: DataFrame, sigs: DataFrame, on: list[str], flank: int = 1000) -> DataFrame:
    """Per call (cid, start, end) the signatures (s_start, s_end) that touch it widened by ``flank``: n, length."""
    pairs = overlap_pairs(calls, sigs, on, F.col("start") - flank, F.col("end") + flank, F.col("s_start"), F.col("s_end"), levels=LEVELS)
    sums = pairs.groupBy("cid").agg(F.count("*").alias("n"), F.sum(F.col("s_end") - F.col("s_start")).alias("length"))
    return calls.join(sums, "cid", "left").select(*calls.columns, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("length", F.lit(0)).alias("length"))


def tolerance_support(calls: DataFrame, sigs: DataFrame, on: list[str], similarity: float = 0.6, ratio: float = 2.3, floor: int = 500) -> DataFrame:
    """Reads that support each call (cid, pos, svlen): signatures (s_pos, s_len, reads) near it and of like length.

    Near is within the greater of ``floor`` and ``ratio`` times the call's length.
    """
    radius = F.greatest(F.lit(floor), F.floor(ratio * F.col("svlen"))).cast("long")
    pairs = within(calls, sigs, on, "pos", "s_pos", radius).where(
        (F.col("s_len") >= similarity * F.col("svlen")) & (F.col("s_len") <= F.col("svlen") / similarity)
    )
    sums = pairs.groupBy("cid").agg(F.sum("reads").alias("support"))
    return calls.join(sums, "cid", "left").select(*calls.columns, F.coalesce("support", F.lit(0)).alias("support"))


def supported_calls(calls: DataFrame, sigs: DataFrame, on: list[str], sure: int = 250, shift: int = 500, similarity: float = 0.5) -> DataFrame:
    """Calls longer than ``sure``, and shorter ones that some signature near and of like size backs."""
    short = calls.where(F.col("svlen") <= sure)
    pairs = within(short, sigs, on, "pos", "s_pos", shift).where(size_similarity("svlen", "s_len") >= similarity)
    return calls.where(F.col("svlen") > sure).unionByName(short.join(pairs.select("cid").distinct(), "cid", "left_semi").select(*calls.columns))


def spanning_reads(windows: DataFrame, reads: DataFrame, on: list[str]) -> DataFrame:
    """Per window (wid, start, end) the reads (r_start, r_end) that reach beyond both its ends."""
    pairs = overlap_pairs(windows, reads, on, F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    n = pairs.where((F.col("r_start") < F.col("start")) & (F.col("r_end") > F.col("end"))).groupBy("wid").agg(F.count("*").alias("n"))
    return windows.join(n, "wid", "left").select(*windows.columns, F.coalesce("n", F.lit(0)).alias("n"))


def capped_spanning(windows: DataFrame, reads: DataFrame, on: list[str], most: int) -> DataFrame:
    """Of the first ``most`` spanning reads in order of start and name: distinct names and forward reads."""
    pairs = overlap_pairs(windows, reads, on, F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")).where(
        (F.col("r_start") < F.col("start")) & (F.col("r_end") > F.col("end"))
    )
    order = Window.partitionBy("wid").orderBy("r_start", "qname", "r_end", "forward")
    first = pairs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    return first.groupBy("wid").agg(F.count_distinct("qname").alias("names"), F.sum("forward").alias("forward"), F.count("*").alias("looked_at"))


def counted_spanning(windows: DataFrame, reads: DataFrame, on: list[str], cap: Column, rounds: int = 500) -> DataFrame:
    """Distinct names of primary reads that span each window (wid, start, end), counted until enough is known.

    Reads (r_start, r_end, qname, flag) are met in order of start and name. Only flags 0 and 16 count.
    Counting stops when ``cap`` names are found (status 1), or at the first primary read from the
    ``rounds``-th read on (status 1 if at most a fifth were primary, else -1); else the status is 0.
    Returns wid, names, status, looked_at; windows that no read touches have 0, 0, 0.
    """
    pairs = overlap_pairs(windows.withColumn("_cap", cap), reads, on, F.col("start"), F.col("end") - 1, F.col("r_start"), F.col("r_end") - 1)
    order = Window.partitionBy("wid").orderBy("r_start", "qname", "r_end", "flag")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    primary = F.col("flag").isin(0, 16)
    spans = primary & (F.col("r_start") < F.col("start")) & (F.col("r_end") > F.col("end"))
    first = F.row_number().over(Window.partitionBy("wid", "qname", "_spans").orderBy("r_start", "r_end", "flag")) == 1
    rows = pairs.withColumn("_spans", spans).withColumn("_new", (F.col("_spans") & first).cast("int"))
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_names", F.sum("_new").over(so_far)).withColumn("_primary", F.sum(primary.cast("int")).over(so_far))
    full = F.col("_spans") & (F.col("_names") >= F.col("_cap"))
    late = primary & (F.col("_k") >= rounds)
    status = F.when(full, 1).when(late, F.when(F.col("_primary") <= 0.2 * F.col("_k"), 1).otherwise(-1))
    ends = rows.withColumn("_status", status).groupBy("wid").agg(
        F.min_by(F.struct("_names", "_status", "_k"), F.when(F.col("_status").isNotNull(), F.col("_k"))).alias("stop"),
        F.max("_names").alias("_all"), F.max("_k").alias("_last"),
    )
    return windows.join(ends, "wid", "left").select(
        "wid", F.coalesce("stop._names", "_all", F.lit(0)).alias("names"), F.coalesce("stop._status", F.lit(0)).alias("status"),
        F.coalesce("stop._k", "_last", F.lit(0)).alias("looked_at"),
    )


def best_match(calls: DataFrame, candidates: DataFrame, on: list[str], radius: int = 1000, similarity: float = 0.5) -> DataFrame:
    """Each call (cid, pos, svlen, gt) with the genotype of its most similar candidate (k_pos, k_len, k_gt, kid).

    Ties go to the least signed distance, then to the least ``kid``; calls without a match keep theirs.
    """
    score = size_similarity("svlen", "k_len")
    pairs = within(calls, candidates, on, "pos", "k_pos", radius).withColumn("_s", score).where(F.col("_s") >= similarity)
    best = pairs.groupBy("cid").agg(F.min_by(F.struct("k_gt"), F.struct(-F.col("_s"), F.col("k_pos") - F.col("pos"), "kid"))["k_gt"].alias("_gt"))
    return calls.join(best, "cid", "left").withColumn("gt", F.coalesce("_gt", "gt")).select(*calls.columns)


def replace_by_longest(drafts: DataFrame, candidates: DataFrame, on: list[str], radius: int = 200) -> DataFrame:
    """Each draft (cid, pos, svlen) with place and length of the longest candidate (kid, k_pos, k_len) near it."""
    pairs = within(drafts, candidates, on, "pos", "k_pos", radius)
    best = pairs.groupBy("cid").agg(F.max_by(F.struct("k_pos", "k_len"), F.struct("k_len", -F.col("kid"))).alias("_k"))
    rows = drafts.join(best, "cid", "left")
    return rows.withColumn("pos", F.coalesce("_k.k_pos", "pos")).withColumn("svlen", F.coalesce("_k.k_len", "svlen")).select(
        *drafts.columns, F.col("_k").isNotNull().alias("replaced")
    )


def truth_match(calls: DataFrame, truth: DataFrame, on: list[str], shift: int = 500, similarity: float = 0.5) -> DataFrame:
    """Calls (cid, start, end) with the first truth row (tid, t_start, t_end) whose ends are both near, or null."""
    pairs = within(calls, truth, on, "start", "t_start", shift).where(
        (F.abs(F.col("end") - F.col("t_end")) <= shift)
        & (size_similarity(F.col("end") - F.col("start"), F.col("t_end") - F.col("t_start")) >= similarity)
    )
    hits = pairs.groupBy("cid").agg(F.min("tid").alias("tid"))
    return calls.join(hits, "cid", "left").select(*calls.columns, "tid")


#: Size classes of calls, by the least length of the next, and how far apart calls of one may be.
CLASSES = [(101, 50), (501, 101), (1001, 501), (10000, 1001), (None, 10000)]


def merge_callsets(calls: DataFrame, callers: int, breakend_gap: int = 1000) -> DataFrame:
    """Calls of several callers merged into one each: chrom, svtype, chrom2, class, start, end, n, supp_vec, callers.

    ``calls``: caller (0, 1, ... below ``callers``), chrom, svtype, chrom2 (null but for BND), start, end,
    svlen. Calls of a type and size class are merged if their starts chain within the class's distance
    and, inside such a chain, their ends do; so merging is transitive. BND calls have no size and chain
    within ``breakend_gap`` between the same two sequences. A merged call begins at its first start and ends at its
    last end; supp_vec has a 1 for each caller in it, in order.
    """
    size = F.abs("svlen")
    number = F.lit(len(CLASSES) - 1)
    for k, (below, _) in reversed(list(enumerate(CLASSES[:-1]))):
        number = F.when(size < below, k).otherwise(number)
    rows = calls.withColumn("class", F.when(F.col("svtype") == "BND", -1).otherwise(number)).withColumn("_two", F.coalesce("chrom2", F.lit("")))
    keys, out = ["chrom", "svtype", "_two", "class"], None
    for k, gap in [(-1, breakend_gap), *((k, far) for k, (_, far) in enumerate(CLASSES))]:
        part = islands(rows.where(F.col("class") == k), keys, "start", gap, name="_c1")
        part = islands(part, [*keys, "_c1"], "end", gap, name="_c2")
        out = part if out is None else out.unionByName(part)
    bits = [F.max(F.when(F.col("caller") == i, "1").otherwise("0")).alias(f"_b{i}") for i in range(callers)]
    merged = out.groupBy(*keys, "_c1", "_c2").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("chrom2").alias("chrom2"), *bits)
    vector = F.concat(*[F.col(f"_b{i}") for i in range(callers)])
    return merged.select("chrom", "svtype", "chrom2", "class", "start", "end", "n", vector.alias("supp_vec"), F.length(F.regexp_replace(vector, "0", "")).alias("callers"))


def translocation_match(calls: DataFrame, truth: DataFrame, shift: int = 1000) -> DataFrame:
    """Calls (cid, chrom, pos, chrom2, pos2) with the first truth row (tid, t_chrom, t_pos, t_chrom2, t_pos2) that matches, or null.

    Both ends must be within ``shift``, in either orientation: a truth row also counts with its ends
    changed over.
    """
    names = ["chrom", "t_pos", "chrom2", "t_pos2"]
    forth = truth.select("tid", *[F.col(c).alias(n) for c, n in zip(("t_chrom", "t_pos", "t_chrom2", "t_pos2"), names, strict=True)])
    back = truth.select("tid", *[F.col(c).alias(n) for c, n in zip(("t_chrom2", "t_pos2", "t_chrom", "t_pos"), names, strict=True)])
    pairs = within(calls, forth.unionByName(back), ["chrom", "chrom2"], "pos", "t_pos", shift).where(F.abs(F.col("pos2") - F.col("t_pos2")) <= shift)
    return calls.join(pairs.groupBy("cid").agg(F.min("tid").alias("tid")), "cid", "left").select(*calls.columns, "tid")


def somatic(tumor: DataFrame, normal: DataFrame, on: list[str]) -> DataFrame:
    """Tumor calls (cid, pos, svlen) without a normal call (n_pos, n_len) of their size class near them.

    Size classes part at 101, 501, 1001 and 10000; calls of a class may be as far apart as 50, 101,
    501, 1001 or 10000.
    """
    steps = [(101, 50), (501, 101), (1001, 501), (10000, 1001)]
    size = F.abs(F.col("svlen"))
    reach = F.lit(10000)
    for below, far in reversed(steps):
        reach = F.when(size < below, far).otherwise(reach)
    group = lambda c: F.when(F.abs(F.col(c)) < 101, 0).when(F.abs(F.col(c)) < 501, 1).when(F.abs(F.col(c)) < 1001, 2).when(F.abs(F.col(c)) < 10000, 3).otherwise(4)
    pairs = within(tumor.withColumn("_g", group("svlen")), normal.withColumn("_g", group("n_len")), [*on, "_g"], "pos", "n_pos", reach.cast("long"))
    return tumor.join(pairs.select("cid").distinct(), "cid", "left_anti")


@F.pandas_udf(T.LongType())
def _edits(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=left.index, dtype="Int64")
    known = (left.notna() & right.notna()).to_numpy()
    out[known] = edits(list(zip(left[known], right[known], strict=True)))
    return out


def with_texts(pairs: DataFrame, rows: DataFrame, keys: dict[str, str], text: str, name: str) -> DataFrame:
    """``pairs`` with the text of the row that they name in ``name``; ``keys``: columns of ``pairs`` and those of ``rows``.

    Texts that no pair asks for are left out before they are dealt anywhere. Of several such rows each gives a pair.
    """
    same = lambda x, y: reduce(lambda p, q: p & q, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(x, y, strict=True)])
    names, asked, own = list(keys.values()), [f"_w{i}" for i in range(len(keys))], [f"_t{i}" for i in range(len(keys))]
    wanted = pairs.select(*[F.col(c).alias(w) for c, w in zip(keys, asked, strict=True)]).distinct()
    found = rows.join(wanted, same(asked, names), "left_semi").select(*[F.col(c).alias(t) for c, t in zip(names, own, strict=True)], F.col(text).alias(name))
    return pairs.join(found, same(keys, own)).drop(*own)


def compared(pairs: DataFrame, ids: list[str], left: str, right: str, name: str, *others: Column | str) -> DataFrame:
    """``ids`` and ``others`` of ``pairs`` with the edit similarity of two texts in ``name``, written without the texts.

    The same as ``edit_similarity`` (upper-cased), worked out for many pairs at once.
    """
    a, b = F.upper(left), F.upper(right)
    total = F.length(a) + F.length(b)
    return settled(pairs.select(*ids, F.try_divide(total - _edits(a, b), total).alias(name), *others))


def match_links(calls: DataFrame, on: list[str], radius: int, similarity: float, sequence: float | None = None, overlap: float | None = None) -> DataFrame:
    """(a, b): calls (cid, pos, svlen[, seq]) near each other and alike in size, and in sequence if asked for.

    ``overlap``: the least share of the longer one that both have; at 0 they overlap or touch.
    """
    slim = calls.select(*on, "cid", "pos", "svlen")
    other = slim.select(*on, *[F.col(c).alias("o_" + c) for c in ("cid", "pos", "svlen")])
    pairs = within(slim, other, on, "pos", "o_pos", radius).where("cid < o_cid")
    pairs = pairs.where(size_similarity("svlen", "o_svlen") >= similarity)
    if overlap is not None:
        common = F.least(F.col("pos") + F.col("svlen"), F.col("o_pos") + F.col("o_svlen")) - F.greatest("pos", "o_pos")
        pairs = pairs.where(common >= overlap * F.greatest("svlen", "o_svlen"))
    if sequence is not None:
        own, mate = [*on, "cid", "pos", "svlen"], [*on, "o_cid", "o_pos", "o_svlen"]
        pairs = settled(pairs.select(*own, *mate[len(on) :]).distinct())
        pairs = with_texts(pairs, calls, dict(zip(own, own, strict=True)), "seq", "seq")
        pairs = with_texts(pairs, calls, dict(zip(mate, own, strict=True)), "seq", "o_seq")
        pairs = compared(pairs, ["cid", "o_cid"], "seq", "o_seq", "_s").where(F.col("_s") >= sequence)
    return pairs.select(F.col("cid").alias("a"), F.col("o_cid").alias("b"))


def pair_haplotypes(hap1: DataFrame, hap2: DataFrame, keys: list[str], distance: int = 200, similarity: float = 0.5) -> DataFrame:
    """Greedy one-to-one pairing of two haplotypes' calls: keys, pos, svlen, gt.

    In order of position each call of the first takes the first free call of the second within
    ``distance`` that is of like size (for deletions also overlapping by half of the shorter). Pairs
    are 1/1 with the longer allele, the second's of equals; the rest are 0/1. Calls are streamed by
    islands of positions; those within reach are held.
    """
    both = hap1.select(*keys, "pos", "svlen", F.lit(1).alias("hap")).unionByName(hap2.select(*keys, "pos", "svlen", F.lit(2).alias("hap")))

    def alike(kind: str, p: int, n: int, q: int, m: int) -> bool:
        if min(n, m) < similarity * max(n, m):
            return False
        return kind != "DEL" or min(p + n, q + m) - max(p, q) >= similarity * min(n, m)

    def kernel(island: Iterator[tuple]) -> Iterator[tuple[int, int]]:
        """0 for a call that its mate stands for, 1 for 0/1, 2 for 1/1."""
        ones: deque[tuple] = deque()  # calls of the first haplotype whose reach isn't read yet
        twos: deque[list] = deque()  # those of the second in reach of one: [number, pos, length, value]

        def take() -> Iterator[tuple[int, int]]:
            number, p, n, kind = ones.popleft()
            while twos and twos[0][1] < p - distance:
                yield twos[0][0], max(0, twos.popleft()[3])
            value = 1
            for two in twos:
                if two[1] > p + distance:
                    break
                if two[3] == 1 and alike(kind, p, n, two[1], two[2]):
                    value, two[3] = (2, -1) if n > two[2] else (0, 2)
                    break
            yield number, value

        for number, p, n, hap, kind in island:
            while ones and p > ones[0][1] + distance:
                yield from take()
            if not ones:  # what is behind no later call can reach
                while twos and twos[0][1] < p - distance:
                    yield twos[0][0], max(0, twos.popleft()[3])
            if hap == 1:
                ones.append((number, p, n, kind))
            else:
                twos.append([number, p, n, 1])
        while ones:
            yield from take()
        for number, _, _, value in twos:
            yield number, max(0, value)

    parted = islands(both, keys, "pos", distance, name="_island")
    found = fold_islands(parted, keys, ["pos", "svlen", "hap"], ["pos", "svlen", "hap", "svtype"], kernel, "_gt")
    return found.where("_gt > 0").select(*keys, "pos", "svlen", F.when(F.col("_gt") == 2, "1/1").otherwise("0/1").alias("gt"))


def similar_calls(left: DataFrame, right: DataFrame, on: list[str], distance: int = 500, size: float = 0.5, overlap: float = 0.01) -> DataFrame:
    """(cid, bid, score): calls (cid, start, end) and benchmark rows (bid, b_start, b_end) near, alike and overlapping."""
    pairs = within(left, right, on, "start", "b_start", distance)
    score = size_similarity(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))
    return pairs.withColumn("score", score).where(
        (F.col("score") >= size) & (overlap_over_least("start", "end", "b_start", "b_end") >= overlap)
    ).select("cid", "bid", "score")


def alike_calls(
    left: DataFrame, right: DataFrame, on: list[str], distance: int = 500, size: float = 0.5, overlap: float = 0.01,
    sequence: float = 0.5, least: int = 30, least_right: int = 50,
) -> DataFrame:
    """(cid, bid, score): as :func:`similar_calls`, of minimal sizes and alike in sequence as well.

    Calls have (cid, start, end, seq), benchmark rows (bid, b_start, b_end, b_seq); a call of under
    ``least`` and a benchmark row of under ``least_right`` bases take no part. The score is the mean of the likeness
    in sequence and size and of the reciprocal overlap. Null or empty sequences on both sides are like nothing.
    """
    a = left.where(F.col("end") - F.col("start") >= least).select(*on, "cid", "start", "end")
    b = right.where(F.col("b_end") - F.col("b_start") >= least_right).select(*on, "bid", "b_start", "b_end")
    return _alike(a, b, left, right, on, distance, size, overlap, sequence)


def _alike(
    a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame, on: list[str], distance: int = 500, size: float = 0.5, overlap: float = 0.01, sequence: float = 0.5
) -> DataFrame:
    """Pairs of ``a`` and ``b``, places that take part, by the sequences that ``left`` and ``right`` have for them."""
    own, mate = [*on, "cid", "start", "end"], [*on, "bid", "b_start", "b_end"]
    z = size_similarity(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))
    near = within(a, b, on, "start", "b_start", distance).where((z >= size) & (overlap_over_least("start", "end", "b_start", "b_end") >= overlap))
    near = settled(near.select(*own, *mate[len(on) :]).distinct())
    near = with_texts(near, left, dict(zip(own, own, strict=True)), "seq", "seq")
    near = with_texts(near, right, dict(zip(mate, mate, strict=True)), "b_seq", "b_seq")
    overlapped = overlap_over_greatest("start", "end", "b_start", "b_end").alias("_o")
    near = compared(near, ["cid", "bid"], "seq", "b_seq", "_s", z.alias("_z"), overlapped).where(F.col("_s") >= sequence)
    return near.select("cid", "bid", ((F.col("_s") + F.col("_z") + F.col("_o")) / 3).alias("score"))


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(cid, bid, score)`` that a greedy choice by falling score takes, each cid and bid once at most.

    Ties go to the lesser cid, then bid; repeated pairs and null ids or scores count nothing. In each
    round every pair that is the best of both its ends is taken, and what shares an end with it goes; that is
    what the greedy choice takes as well, whose order matters between pairs with a common end alone.
    Each round takes the best of all at least, so the rounds end without a bound; each is a written table.
    """
    rest = settled(pairs.groupBy("cid", "bid").agg(F.max("score").alias("score")).where("cid is not null and bid is not null and score is not null"))
    taken, order = None, F.struct(-F.col("score"), "cid", "bid")
    while not rest.isEmpty():
        ones = rest.groupBy("cid").agg(F.min_by("bid", order).alias("bid"))
        twos = rest.groupBy("bid").agg(F.min_by("cid", order).alias("cid"))
        best = settled(ones.join(twos, ["cid", "bid"]).join(rest, ["cid", "bid"]).select("cid", "bid", "score"))
        taken = best if taken is None else taken.unionByName(best)
        rest = settled(rest.join(best.select("cid"), "cid", "left_anti").join(best.select("bid"), "bid", "left_anti"))
    return rest if taken is None else taken


def benchmark(calls: DataFrame, truth: DataFrame, on: list[str], regions: DataFrame | None = None, least: int = 30, least_truth: int = 50, **bars) -> DataFrame:
    """Calls against a benchmark: side (call or truth), id, mate (its partner's id or null), score.

    ``calls`` and ``truth`` as for :func:`alike_calls`, whose ``bars`` apply; with ``regions`` (chrom, start, end) rows
    that don't lie in one of them whole take no part. Partners are chosen one to one. Truth rows without a mate are false
    negatives, calls without one false positives; calls under ``least`` and truth rows under ``least_truth`` bases aren't listed.
    """
    a = calls.where(F.col("end") - F.col("start") >= least).select(*on, "cid", "start", "end")
    b = truth.where(F.col("b_end") - F.col("b_start") >= least_truth).select(*on, "bid", "b_start", "b_end")
    if regions is not None:
        places = regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))

        def inside(rows: DataFrame, key: str, s: str, e: str) -> DataFrame:
            pairs = overlap_pairs(rows.where(F.col(key).isNotNull()), places, ["chrom"], F.col(s), F.col(e), F.col("r_start"), F.col("r_end"), levels=LEVELS)
            return pairs.where((F.col("r_start") <= F.col(s)) & (F.col(e) <= F.col("r_end"))).select(*rows.columns).distinct()

        a, b = inside(a, "cid", "start", "end"), inside(b, "bid", "b_start", "b_end")
    a, b = settled(a), settled(b)
    mates = one_to_one(_alike(a, b, calls, truth, on, **bars))
    found = lambda rows, key, other, side: rows.select(key).distinct().join(mates, key, "left").select(
        F.lit(side).alias("side"), F.col(key).alias("id"), F.col(other).alias("mate"), "score"
    )
    return found(a, "cid", "bid", "call").unionByName(found(b, "bid", "cid", "truth"))


def regions_of_points(regions: DataFrame, points: DataFrame, on: list[str], edge: int = 0) -> DataFrame:
    """How many points lie in each region (rid, start, end), ``edge`` away from its ends: adds n."""
    pairs = overlap_pairs(regions, points, on, F.col("start") + edge, F.col("end") - edge, F.col("pos"), F.col("pos"))
    n = pairs.groupBy("rid").agg(F.count("*").alias("n"))
    return regions.join(n, "rid", "left").select(*regions.columns, F.coalesce("n", F.lit(0)).alias("n"))


def overlapping_rows(rows: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Rows (vid, v_start, v_end) that some region (start, end) touches: a semi join by overlap."""
    pairs = overlap_pairs(rows, regions.select(*on, "start", "end"), on, F.col("v_start"), F.col("v_end"), F.col("start"), F.col("end"))
    return rows.join(pairs.select("vid").distinct(), "vid", "left_semi")
