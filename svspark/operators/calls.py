"""Operators that finish call sets: filters, phase blocks, diploid genotypes, recovery of duplications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import corrected_genotype, is_autosome, size_similarity
from .clustering import first_fit
from .intervals import islands, overlap_pairs
from .matching import best_match, overlapping_rows, replace_by_longest
from .segments import adjacent, segment_pairs

#: Second filter of duplications by technology and state. Ranges are inclusive.
DUP_RULES = [
    ("HIFI", "Tumor", 1.1, 3.0, 0.25, 1.5, 59.8, 0.6, 5.0, 1e12, 0, 10**15, 1.4),
    ("HIFI", "Normal", 1.3, 4.0, 0.25, 1.2, 59.5, 1.0, 4.0, 1e12, 0, 10**15, 1.4),
    ("CLR", "Tumor", 1.15, 8.0, 0.22, 4.6, 50.0, 0.7, 9.0, 2.0, 3000, 35_000_000, 25.0),
    ("CLR", "Normal", 1.15, 8.0, 0.22, 4.6, 50.0, 0.8, 4.0, 0.5, 3000, 35_000_000, 15.0),
    ("ONT", "Tumor", 1.15, 8.0, 0.22, 4.6, 50.0, 0.7, 9.0, 2.0, 3000, 35_000_000, 25.0),
    ("ONT", "Normal", 1.15, 8.0, 0.22, 4.6, 50.0, 0.8, 4.0, 0.5, 3000, 35_000_000, 15.0),
]
DUP_RULE_FIELDS = "dtype string, state string, diff_low double, diff_high double, sup_low double, sup_high double, mapq_over double, cov_low double, cov_high double, std_under double, size_low long, size_high long, either_under double"


def second_duplication_filter(rows: DataFrame, rules: DataFrame, coverage: float) -> DataFrame:
    """Duplications (n_sup, mapq, size, std_left, std_right, cov_sv, cov_left, cov_right) that pass a rule.

    Each rule of the small table ``rules`` gives its own rows: coverage inside against the flanks,
    support against the flanks, coverage against the genome's, spread of the ends. A ratio without a
    denominator fails.
    """
    flanks = F.col("cov_left") + F.col("cov_right")
    measured = (
        rows.withColumn("rel_diff", F.try_divide(2 * F.col("cov_sv"), flanks))
        .withColumn("rel_sup", F.try_divide(2 * F.col("n_sup"), flanks))
        .withColumn("rel_cov", F.col("cov_sv") / coverage)
        .withColumn("least_std", F.least("std_left", "std_right"))
    )
    passes = (
        F.col("rel_diff").between(F.col("diff_low"), F.col("diff_high")) & F.col("rel_sup").between(F.col("sup_low"), F.col("sup_high"))
        & (F.col("mapq") > F.col("mapq_over")) & F.col("rel_cov").between(F.col("cov_low"), F.col("cov_high"))
        & (F.col("least_std") / F.col("n_sup") < F.col("std_under")) & F.col("size").between(F.col("size_low"), F.col("size_high"))
        & (F.col("least_std") < F.col("either_under"))
    )
    return measured.join(F.broadcast(rules), passes).select(*rows.columns, "dtype", "state")


def quiet_alignments(reads: DataFrame, cigar: str, most_inserted: float = 0.13, least_run: int = 200) -> DataFrame:
    """Alignments with few inserted bases, or with long runs of matches on average."""
    total = lambda ops: F.aggregate(F.filter(F.col(cigar), lambda c: F.lit(ops).contains(c["op"])), F.lit(0).cast("long"), lambda a, c: a + c["len"])
    runs = F.size(F.filter(F.col(cigar), lambda c: c["op"] == "M"))
    inserted = F.try_divide(total("I"), total("MIS=X"))
    return reads.where((inserted <= most_inserted) | (F.try_divide(total("M"), runs) >= least_run))


def informative_cells(ratios: DataFrame, least: float = 0.75) -> DataFrame:
    """Cells (cell, mat, pat) whose two ratios have opposite signs and are both over ``least``; nulls fail."""
    return ratios.where((F.col("mat") * F.col("pat") < 0) & (F.least(F.abs("mat"), F.abs("pat")) > least))


def breakpoint_shift(pairs: DataFrame, most: int = 201) -> DataFrame:
    """Adds shift: the greater of the differences of starts and of ends of matched calls, clipped."""
    wide = F.greatest(F.abs(F.col("start") - F.col("t_start")), F.abs(F.col("end") - F.col("t_end")))
    return pairs.withColumn("shift", F.least(wide, F.lit(most)))


def best_by_z_scores(candidates: DataFrame, key: str, likes: list[str], dislikes: list[str], order: str) -> DataFrame:
    """Per ``key`` the candidate with the greatest sum of z-scores, counting ``dislikes`` against it."""
    w = Window.partitionBy(key)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-4)
    score = sum((z(c) for c in likes), F.lit(0.0)) - sum((z(c) for c in dislikes), F.lit(0.0))
    rows = candidates.withColumn("score", F.round(score, 6))
    return rows.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), order))).where("_k = 1").drop("_k")


def phase_blocks(reads: DataFrame) -> DataFrame:
    """Blocks (ps) of phased reads: least start and greatest end with the number of reads of each haplotype."""
    hap = lambda h: F.sum(F.when(F.col("hp") == h, 1).otherwise(0)).alias(f"hp{h}")
    return reads.where("ps is not null").groupBy("chrom", "ps").agg(F.min("r_start").alias("start"), F.max("r_end").alias("end"), hap(1), hap(2))


def assign_unphased(reads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Unphased reads (qname, chrom, r_start, r_end) with the block they overlap most: qname, ps, overlap.

    Ties go to the least ps; reads that touch no block aren't assigned.
    """
    pairs = overlap_pairs(
        reads, blocks.select("chrom", "ps", "start", "end"), ["chrom"], F.col("r_start"), F.col("r_end") - 1, F.col("start"), F.col("end") - 1
    )
    common = F.least("r_end", "end") - F.greatest("r_start", "start")
    best = pairs.groupBy("qname").agg(F.max(F.struct(common.alias("overlap"), (-F.col("ps")).alias("p"))).alias("b"))
    return best.select("qname", (-F.col("b.p")).alias("ps"), F.col("b.overlap").alias("overlap"))


def diploid_genotypes(calls: DataFrame, keys: list[str], gap: int = 1000) -> DataFrame:
    """Clusters of two haplotypes' calls (pos, svlen, hap) by midpoint: 1/1 if both have one, else 1/0 or 0/1."""
    mid = calls.withColumn("_mid", F.floor((2 * F.col("pos") + F.col("svlen")) / 2))
    rows = islands(mid, keys, "_mid", gap)
    haps = F.bit_or(F.col("hap").cast("int"))
    return rows.groupBy(*keys, "cid").agg(
        F.floor(F.avg("pos")).cast("long").alias("pos"), F.bround(F.avg("svlen")).cast("long").alias("svlen"), haps.alias("_h"), F.count("*").alias("n")
    ).select(*keys, "pos", "svlen", F.when(F.col("_h") == 3, "1/1").when(F.col("_h") == 1, "1/0").otherwise("0/1").alias("gt"), "n")


def block_quality(counts: DataFrame) -> DataFrame:
    """Quality of phase blocks from (block, hp, parent) rows: |score1 - score2| / 2, one-sided blocks left out.

    A haplotype's score is the share of maternal less paternal rows.
    """
    share = lambda h: F.avg(F.when(F.col("hp") == h, F.when(F.col("parent") == "M", 1.0).otherwise(-1.0)))
    rows = counts.groupBy("block").agg(share(1).alias("s1"), share(2).alias("s2")).where("s1 is not null and s2 is not null")
    return rows.select("block", F.round(F.abs(F.col("s1") - F.col("s2")) / 2, 6).alias("quality"))


#: Fixed values. Of noisy technologies: ratio, low and high of :func:`split_indels_by_ratio`.
SPLIT_RATIOS = {"CLR": (0.3, 0.3, 0.3), "ONT": (0.5, 0.8, 0.5)}


def split_indels_by_ratio(segments: DataFrame, key: str, order: list[str], ratio: float, low: float, high: float, least: int = 30, most: int = 50_000, far: int = 400) -> DataFrame:
    """Split-read indels of noisy reads: limits follow the size of the difference.

    A deletion's read distance is at most ``ratio`` of it; an insertion's overlap lies between
    ``low`` times the (negative) difference and ``high`` times its size. A deletion is placed at the
    first segment's end, an insertion at the second's start or, if that is over ``far`` away from the
    first's end, midway. Differences over ``most`` are left out.
    """
    columns = ["chrom", "strand", "ref_start", "ref_end", "q_start", "q_end"]
    rows = adjacent(segments, key, order, columns).where("chrom = n_chrom and strand = n_strand and n_ref_start >= ref_start")
    rows = rows.withColumn("diff", (F.col("n_ref_start") - F.col("ref_end")) - (F.col("n_q_start") - F.col("q_end")))
    rows = rows.withColumn("olap", F.col("ref_end") - F.col("n_ref_start"))
    rows = rows.where(F.abs("diff") <= most)
    kind = F.when((F.col("diff") >= least) & (F.abs(F.col("q_end") - F.col("n_q_start")) <= F.col("diff") * ratio), "DEL").when(
        (F.col("diff") <= -least) & (F.col("olap") >= F.col("diff") * low) & (F.col("olap") <= F.abs("diff") * high), "INS"
    )
    midway = F.floor((F.col("ref_end") + F.col("n_ref_start")) / 2).cast("long")
    pos = F.when(kind == "DEL", F.col("ref_end")).when(F.abs("olap") > far, midway).otherwise(F.col("n_ref_start"))
    return rows.withColumn("svtype", kind).where("svtype is not null").select(key, "chrom", "svtype", pos.alias("pos"), F.abs("diff").alias("len"))


def inversion_evidence(segments: DataFrame, key: str, ordinal: str, gap: int = 100, cluster: int = 500, least: int = 30) -> DataFrame:
    """Inversions from forward and reverse segments of a read that follow each other: chrom, start, end, n."""
    pairs = segment_pairs(segments, key, ordinal, ["chrom", "strand", "ref_start", "ref_end", "q_start", "q_end"])
    near = pairs.where("chrom = n_chrom and strand <> n_strand").where(F.abs(F.col("n_q_start") - F.col("q_end")) <= gap)
    ends = near.select("chrom", F.least("ref_end", "n_ref_end").alias("a"), F.greatest("ref_end", "n_ref_end").alias("b"), key)
    ends = ends.where(F.col("b") - F.col("a") >= least)
    found = first_fit(ends, ["chrom"], "a", "b", cluster, [key])
    return found.groupBy("chrom", "_island", "cluster").agg(
        F.floor(F.avg("a")).cast("long").alias("start"), F.floor(F.avg("b")).cast("long").alias("end"), F.count("*").alias("n")
    ).drop("_island", "cluster")


def translocation_clusters(segments: DataFrame, key: str, ordinal: str, gap: int = 1000, cluster: int = 2000) -> DataFrame:
    """Translocations from segments of a read on two chromosomes: chrom1, pos1, chrom2, pos2, strands, n."""
    pairs = segment_pairs(segments, key, ordinal, ["chrom", "strand", "ref_start", "ref_end", "q_start", "q_end"])
    near = pairs.where("chrom <> n_chrom").where(F.abs(F.col("n_q_start") - F.col("q_end")) <= gap)
    swap = F.regexp_extract("chrom", r"(\d+)", 1).try_cast("int") > F.regexp_extract("n_chrom", r"(\d+)", 1).try_cast("int")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = near.select(
        pick("chrom", "n_chrom").alias("chrom1"), pick("ref_end", "n_ref_start").alias("a"), pick("n_chrom", "chrom").alias("chrom2"),
        pick("n_ref_start", "ref_end").alias("b"), F.concat("strand", "n_strand").alias("strands"), key,
    )
    keys = ["chrom1", "chrom2", "strands"]
    found = first_fit(ends, keys, "a", "b", cluster, [key])
    return found.groupBy(*keys, "_island", "cluster").agg(
        F.floor(F.avg("a")).cast("long").alias("pos1"), F.floor(F.avg("b")).cast("long").alias("pos2"), F.count("*").alias("n")
    ).drop("_island", "cluster")


def recovered_duplications(aligned: DataFrame, similarity: float = 0.7, shift: int = 300, ratio: float = 0.3) -> DataFrame:
    """Insertions (cid, chrom, pos, svlen) aligned back (k_chrom, k_start, k_end) beside their own site.

    The aligned length must be alike and its nearer edge at most ``shift`` and ``ratio`` lengths
    away; of several alignments the one with the best z-scores stays.
    """
    length = F.col("k_end") - F.col("k_start")
    edge = F.least(F.abs(F.col("pos") - F.col("k_start")), F.abs(F.col("pos") - F.col("k_end")))
    rows = aligned.where("chrom = k_chrom").withColumn("like", size_similarity("svlen", length)).withColumn("edge", edge)
    rows = rows.withColumn("rel", F.try_divide("edge", "svlen"))
    rows = rows.where((F.col("like") >= similarity) & (F.col("edge") <= shift) & (F.col("rel") <= ratio))
    return best_by_z_scores(rows, "cid", ["like"], ["edge", "rel"], "k_start")


def renumbered(parts: list[DataFrame], keys: list[str], order: Column) -> DataFrame:
    """Union of ``parts`` with a running number in each of ``keys``."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def finished_calls(calls: DataFrame, drafts: DataFrame, technology: str, flank: int = 100, least: int = 30, most: int = 50_000) -> DataFrame:
    """Calls with their final genotypes by ``technology``: cid, chrom, svtype, pos, svlen, gt.

    ``calls``: cid, chrom, svtype, pos, svlen, gt and, for "Hifi", ratio and the limits lh, sh, lt, st of
    :func:`corrected_genotype`; ``drafts``, candidates called from reads: kid, chrom, svtype, k_pos, k_len, k_gt.
    "Hifi" holds a call's own genotype against its share of supporting reads. "CLR" and "ONT" take the
    genotype of the most similar draft and keep their own without one. "ONT" then gives insertions place
    and length of the longest draft near them and keeps those of ``least`` to ``most`` bases, and keeps
    deletions that come within ``flank`` of the start of a draft of any type on an autosome. Null limits
    or ratios change nothing; without drafts "ONT" has no deletions.
    """
    columns = ["cid", "chrom", "svtype", "pos", "svlen", "gt"]
    if technology == "Hifi":
        return calls.withColumn("gt", corrected_genotype("svlen", "gt", "ratio", "lh", "sh", "lt", "st")).select(*columns)
    on = ["chrom", "svtype"]
    told = best_match(calls.select(*columns), drafts, on)
    if technology == "CLR":
        return told
    if technology != "ONT":
        raise ValueError(f"no rules for {technology}")
    longest = replace_by_longest(told.where("svtype = 'INS'"), drafts.where("svtype = 'INS'").drop("k_gt"), on)
    starts = drafts.where(is_autosome("chrom") & (F.abs("k_len") >= least)).select(
        "chrom", F.greatest(F.col("k_pos") - flank + 1, F.lit(1)).alias("start"), (F.col("k_pos") + flank).alias("end")
    )
    places = told.where("svtype = 'DEL'").withColumns({"vid": F.col("cid"), "v_start": F.col("pos"), "v_end": F.col("pos") + F.abs("svlen")})
    deletions = overlapping_rows(places, starts, ["chrom"])
    return longest.where(F.abs("svlen").between(least, most)).select(*columns).unionByName(deletions.select(*columns))
