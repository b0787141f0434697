"""Pairing the candidates of two haplotypes: by edit distance of what they make of the reference, or by breakend places.

Complete linkage in which no two candidates of one haplotype may stand together gives clusters of one
or two, and takes the closest free pair first. So pairs are matched in the order of their distance,
in rounds that take every pair that is the best one of both its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import edits
from ..lineage import settled
from ..sources.reference import BLOCK, with_slices
from .intervals import islands

#: Types whose place is where something is put in; the others change a stretch.
INTO = ("INS", "DUP_INT")
COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """Edits between two texts, or ``most`` + 1 if there are more.

    Furthest reaching points of each diagonal for 0, 1, 2, ... edits, so time follows the edits and the
    common runs; it ends early at ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    unequal = np.flatnonzero(x[:n] != y[:n])  # what is common at both ends doesn't matter
    head = int(unequal[0]) if len(unequal) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    unequal = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(unequal[0]) if len(unequal) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return min(most + 1, max(len(x), len(y)))
    goal, step = len(y) - len(x), 16
    # ends of the texts that equal nothing, so that runs stop there
    x, y = np.concatenate([x, np.full(step, 1, np.uint8)]), np.concatenate([y, np.full(step, 2, np.uint8)])
    ahead = np.arange(step)

    def slide(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Along each diagonal d = (place in y) - (place in x) as far as the texts agree."""
        left = np.arange(len(i))
        while len(left):
            p = i[left][:, None] + ahead
            same = x[np.minimum(p, len(x) - 1)] == y[np.minimum(p + d[left][:, None], len(y) - 1)]
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            i[left] += run
            left = left[run == step]
        return i

    rows, columns = len(x) - step, len(y) - step
    reach = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    d = np.zeros(1, np.int64)
    for edits in range(most + 1):
        if abs(goal) <= edits and reach[goal - d[0]] >= rows:
            return edits
        wider = np.arange(d[0] - 1, d[-1] + 2)
        none = np.full(1, -2, np.int64)
        deleted = np.concatenate([reach + 1, none, none])  # from the diagonal above
        inserted = np.concatenate([none, none, reach])  # from the one below
        changed = np.concatenate([none, reach + 1, none])
        i = np.maximum(np.maximum(deleted, inserted), changed)
        i = np.minimum(i, np.minimum(rows, columns - wider))
        keep = (i >= 0) & (i + wider >= 0)
        first, last = np.flatnonzero(keep)[[0, -1]]
        d, reach = wider[first : last + 1], slide(i[first : last + 1], wider[first : last + 1])
    return most + 1


#: Up to this length texts are compared many at a time; of longer ones the diagonals alone are followed.
LONG = 2048


def edit_distances(pairs: list[tuple[bytes, bytes]], most: int) -> np.ndarray:
    """:func:`edit_distance` of many pairs; short ones go by bits, whatever their number of edits."""
    found = np.full(len(pairs), most + 1)
    near = [i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= most]
    short = [i for i in near if max(map(len, pairs[i])) <= LONG]
    found[short] = np.minimum(edits([pairs[i] for i in short]), most + 1)
    for i in near:
        if max(map(len, pairs[i])) > LONG:
            found[i] = edit_distance(*pairs[i], most)
    return found


def altered(kind: str, region: str, start: int, end: int, seq: str | None, copies: int | None, source: str | None) -> bytes:
    """What a candidate makes of ``region``; start and end are places in it."""
    text = region.encode()
    before, inside, after = text[:start], text[start:end], text[end:]
    if kind == "DEL":
        return before + after
    if kind == "INV":
        return before + inside[::-1].translate(COMPLEMENT) + after
    if kind == "DUP_TAN":
        return before + inside * ((copies or 0) + 1) + after
    return before + (seq if kind == "INS" else source or "").upper().encode() + text[start:] if seq or source else text


def match_greedily(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, d) taken in the order of (d, a, b), each a and each b once.

    A pair is taken once it is the best of both its members, so a round takes many at a time and no
    task sees a group of pairs.
    """
    pair = F.struct("d", "a", "b")
    left, taken = settled(pairs.select("a", "b", "d")), []
    while left.limit(1).count():
        best = left.groupBy("a").agg(F.min(pair).alias("p")).select("p.*")
        back = left.groupBy("b").agg(F.min(pair).alias("p")).select("p.*")
        now = settled(best.join(back, ["d", "a", "b"]))
        taken.append(now)
        left = settled(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
    out = pairs.select("a", "b", "d").limit(0) if not taken else taken[0]
    for now in taken[1:]:
        out = out.unionByName(now)
    return out.select("a", "b", "d")


def haplotype_distances(candidates: DataFrame, blocks: DataFrame, most: int = 200, gap: int = 1000, flank: int = 100, block: int = BLOCK) -> DataFrame:
    """Pairs of candidates of both haplotypes within ``most`` edits: a (of haplotype 1), b (of 2), d.

    ``candidates``: cid, hap (1 or 2), svtype (DEL, INV, DUP_TAN, INS, DUP_INT), chrom, start, end (0-based,
    half-open; of what is put in, its place), seq (INS), copies (DUP_TAN: how many more), src_chrom, src_start,
    src_end (DUP_INT). Candidates of a type are compared inside chains of places (middles of stretches)
    at most ``gap`` apart, whatever their size; a pair whose lengths differ by more than ``most`` can't be
    within it, so pairs meet by classes of length. The texts compared are both alleles over the
    stretch that both candidates touch and ``flank`` bases on either side.
    """
    into = F.col("svtype").isin(*INTO)
    place = F.when(into, F.col("start")).otherwise(F.floor((F.col("start") + F.col("end")) / 2))
    stop = F.when(into, F.col("start")).otherwise(F.col("end"))
    # by how much the text grows
    size = F.col("end") - F.col("start")
    grows = (
        F.when(F.col("svtype") == "DEL", -size).when(F.col("svtype") == "DUP_TAN", size * F.coalesce("copies", F.lit(0)))
        .when(F.col("svtype") == "INS", F.coalesce(F.length("seq"), F.lit(0))).when(F.col("svtype") == "DUP_INT", F.coalesce(F.col("src_end") - F.col("src_start"), F.lit(0))).otherwise(0)
    )
    rows = candidates.withColumns({"_place": place.cast("long"), "_stop": stop, "_grows": grows.cast("long")})
    rows = rows.withColumn("seq", F.when(F.col("svtype") == "INS", F.col("seq")))  # no other type's allele has it
    rows = settled(islands(rows, ["svtype", "chrom"], "_place", gap, name="_chain").withColumn("_class", F.floor(F.col("_grows") / (most + 1))))
    fields = ["cid", "start", "_stop", "seq", "copies", "src_chrom", "src_start", "src_end", "_grows"]
    one = rows.where("hap = 1").select("svtype", "chrom", "_chain", "_class", *[F.col(c).alias(f"a_{c.strip('_')}") for c in fields])
    two = rows.where("hap = 2").select("svtype", "chrom", "_chain", F.explode(F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)).alias("_class"), *[F.col(c).alias(f"b_{c.strip('_')}") for c in fields])
    pairs = one.join(two, ["svtype", "chrom", "_chain", "_class"]).where(F.abs(F.col("a_grows") - F.col("b_grows")) <= most)
    low = F.greatest(F.least("a_start", "b_start") - flank, F.lit(0))
    wanted = {
        "region": (F.col("chrom"), low, F.greatest("a_stop", "b_stop") + flank),
        **{f"{s}_source": (F.when(F.col("svtype") == "DUP_INT", F.col(f"{s}_src_chrom")), F.col(f"{s}_src_start"), F.col(f"{s}_src_end")) for s in "ab"},
    }
    pairs = with_slices(pairs.withColumn("low", low), blocks, wanted, block)
    columns = ["svtype", "region", "low", *[f"{s}_{c}" for s in "ab" for c in ("cid", "start", "stop", "seq", "copies", "source")]]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda v: v if isinstance(v, str) else None
        for batch in batches:
            ids, alleles = list(zip(batch["a_cid"], batch["b_cid"], strict=True)), []
            for r in batch.to_dict("records"):
                alleles.append(tuple(
                    altered(r["svtype"], r["region"] or "", int(r[f"{s}_start"] - r["low"]), int(r[f"{s}_stop"] - r["low"]), text(r[f"{s}_seq"]), 0 if pd.isna(r[f"{s}_copies"]) else int(r[f"{s}_copies"]), text(r[f"{s}_source"]))
                    for s in "ab"
                ))
            found = edit_distances(alleles, most)
            out = [(*ids[i], found[i]) for i in np.flatnonzero(found <= most)]
            yield pd.DataFrame(out, columns=["a", "b", "d"]).astype({"a": "int64", "b": "int64", "d": "int64"})

    known = pairs.where("region is not null").select(*columns)
    return known.mapInPandas(measure, "a long, b long, d long")


def _paired(candidates: DataFrame, pairs: DataFrame, place: Column) -> DataFrame:
    """Candidates by pair: those of a pair once, by the place that comes first, with both ids and the genotype."""
    met = pairs.select(F.col("a").alias("cid"), "a", "b", "d").unionAll(pairs.select(F.col("b").alias("cid"), "a", "b", "d"))
    rows = candidates.withColumn("_place", place).join(met, "cid", "left")
    single = rows.where("a is null").withColumns({"other": F.lit(None).cast("long"), "gt": F.when(F.col("hap") == 1, "1/0").otherwise("0/1")})
    first = F.min(F.struct("_place", "hap", "cid", *[c for c in candidates.columns if c not in ("hap", "cid")])).alias("f")
    double = rows.where("a is not null").groupBy("a", "b", "d").agg(first)
    double = double.select("f.*", "a", "b", "d").withColumns({"other": F.when(F.col("cid") == F.col("a"), F.col("b")).otherwise(F.col("a")), "gt": F.lit("1/1")})
    return single.select(*candidates.columns, "other", "gt", "d").unionByName(double.select(*candidates.columns, "other", "gt", "d"))


def pair_haplotypes(candidates: DataFrame, blocks: DataFrame, most: int = 200, gap: int = 1000, flank: int = 100, block: int = BLOCK) -> DataFrame:
    """Candidates of both haplotypes as calls: the columns of ``candidates`` with other, gt and d.

    Pairs within ``most`` edits (see :func:`haplotype_distances`) are one call, 1/1, told by the candidate
    that comes first; the rest are 1/0 (of haplotype 1) and 0/1. Ids must be unique; ties go to the least ids.
    """
    pairs = match_greedily(haplotype_distances(candidates, blocks, most, gap, flank, block))
    place = F.when(F.col("svtype").isin(*INTO), F.col("start")).otherwise(F.floor((F.col("start") + F.col("end")) / 2))
    return _paired(candidates, pairs, place)


def breakend_distances(candidates: DataFrame, most: int = 900) -> DataFrame:
    """Pairs of breakends of both haplotypes whose places differ by ``most`` in all: a, b, d.

    ``candidates``: cid, hap, chrom, start, chrom2, end, form (the directions). Both ends must lie on
    the same sequences and go the same ways. Pairs meet by bins of both places: differences of at most
    ``most`` touch the same or neighbouring bins of that width, so no pair within it is lost.
    """
    width = most + 1
    rows = candidates.withColumns({"_x": F.floor(F.col("start") / width), "_y": F.floor(F.col("end") / width)})
    on = ["chrom", "chrom2", "form", "_x", "_y"]
    one = rows.where("hap = 1").select(*on, F.col("cid").alias("a"), F.col("start").alias("s"), F.col("end").alias("e"))
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    two = rows.where("hap = 2").withColumn("_x", near("_x")).withColumn("_y", near("_y")).select(*on, F.col("cid").alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    d = F.abs(F.col("s") - F.col("s2")) + F.abs(F.col("e") - F.col("e2"))
    return one.join(two, on).select("a", "b", d.cast("long").alias("d")).where(F.col("d") <= most)


#: The places of a breakend: what two must share, and where they may differ.
ENDS = ["chrom", "chrom2", "form"]


def match_breakends(candidates: DataFrame, most: int = 900, spare: int = 2_000_000) -> DataFrame:
    """Pairs (a, b, d) that :func:`match_greedily` takes of :func:`breakend_distances`, without listing all of these.

    The nearest pairs are taken first, so those within a distance are taken before any other counts. Pairs at one place
    go by their ranks; then the distance widens step by step, each time as far as what is left
    makes about half as many pairs again as there are rows, or ``spare`` pairs, and what was taken leaves the rest.
    """
    left = settled(candidates.where(F.col("hap").isin(1, 2)).select("cid", "hap", *ENDS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna())
    place = [*ENDS, "start", "end"]
    rank = F.row_number().over(Window.partitionBy(*place, "hap").orderBy("cid"))
    ranked = left.withColumn("_rank", rank).groupBy(*place, "_rank").agg(
        *[F.max(F.when(F.col("hap") == h, F.col("cid"))).alias(c) for h, c in ((1, "a"), (2, "b"))]
    )
    taken = [settled(ranked.where("a is not null and b is not null").select("a", "b", F.lit(0).cast("long").alias("d")))]
    radius = 0
    while radius < most:
        gone = taken[-1].select(F.explode(F.array("a", "b")).alias("cid"))
        left = settled(left.join(gone, "cid", "left_anti"))
        wider = sorted({min(most, w) for k in range(1, 12) for w in [max(radius + 1, radius * k // 4 + radius)]} | {min(most, max(4, radius) << k) for k in range(1, 10)} | {most})
        wider = [w for w in wider if w > radius]
        # twice the pairs in one bin of each width is about how many there are within it
        bins = left.select("hap", *ENDS, "start", "end", F.explode(F.array(*[F.lit(w) for w in wider])).alias("_w"))
        bins = bins.groupBy("_w", *ENDS, F.floor(F.col("start") / (F.col("_w") + 1)).alias("_x"), F.floor(F.col("end") / (F.col("_w") + 1)).alias("_y")).agg(*[F.sum((F.col("hap") == h).cast("double")).alias(f"_n{h}") for h in (1, 2)])
        counts = bins.groupBy("_w").agg(F.sum(2 * F.col("_n1") * F.col("_n2")).alias("pairs"), F.sum(F.col("_n1") + F.col("_n2")).alias("rows")).collect()
        if not counts:
            break
        fits = [r["_w"] for r in counts if r["pairs"] <= max(spare, 1.5 * r["rows"])]
        radius = max(fits, default=min(wider))
        taken.append(settled(match_greedily(breakend_distances(left, radius))))
    return reduce(DataFrame.unionByName, taken)


def pair_breakends(candidates: DataFrame, most: int = 900) -> DataFrame:
    """Breakends of both haplotypes as calls: as :func:`pair_haplotypes`, by (d1 + d2) / 3000 <= 0.3."""
    return _paired(candidates, match_breakends(candidates, most), F.col("start"))
