"""Operators on alignments: CIGAR events and adjacent or paired segments of split reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_cigar(text: str) -> Column:
    """array<struct<op, len>> of a CIGAR text."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(
        parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"^(\d+)", 1).cast("long").alias("len"))
    )


def _sum_ops(cigar: str, ops: str) -> Column:
    return F.aggregate(
        F.filter(F.col(cigar), lambda c: F.lit(ops).contains(c["op"])), F.lit(0).cast("long"), lambda a, c: a + c["len"]
    )


def read_length(cigar: str) -> Column:
    return _sum_ops(cigar, "MIS=X")


def reference_length(cigar: str) -> Column:
    return _sum_ops(cigar, "MDN=X")


def clips(cigar: str) -> tuple[Column, Column]:
    """Clipped bases before and after the aligned part."""
    first, last = F.element_at(F.col(cigar), 1), F.element_at(F.col(cigar), -1)
    clip = lambda c: F.when(c["op"].isin("S", "H"), c["len"]).otherwise(0)
    return clip(first), clip(last)


def cigar_indels(reads: DataFrame, key: str, ref_start: str, cigar: str, least: int = 30, step: int = 0) -> DataFrame:
    """Insertions and deletions of at least ``least`` bases: key, svtype, ref_pos, q_pos, len.

    Positions are running sums of the operations before: deletions and matches move along the
    reference, insertions, clips and matches along the read. An insertion stands ``step`` bases
    further for itself and each one before it (1 in scans of raw reads).
    """
    moves_ref = lambda c: F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0)
    moves_read = lambda c: F.when(c["op"].isin("M", "I", "S", "=", "X"), c["len"]).otherwise(0)
    start = F.struct(
        F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("more"),
        F.expr("cast(array() as array<struct<op:string,len:bigint,r:bigint,q:bigint>>)").alias("out"),
    )

    def move(acc: Column, c: Column) -> Column:
        more = acc["more"] + F.when((c["op"] == "I") & (c["len"] >= least), step).otherwise(0)
        at = acc["r"] + F.when(c["op"] == "I", more).otherwise(0)
        event = F.struct(c["op"].alias("op"), c["len"].alias("len"), at.alias("r"), acc["q"].alias("q"))
        return F.struct(
            (acc["r"] + moves_ref(c)).alias("r"), (acc["q"] + moves_read(c)).alias("q"), more.cast("long").alias("more"),
            F.when(c["op"].isin("I", "D") & (c["len"] >= least), F.concat(acc["out"], F.array(event))).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(F.col(cigar), start, move, lambda acc: acc["out"])
    return reads.select(key, F.col(ref_start).alias("_start"), F.explode(found).alias("e")).select(
        key, F.when(F.col("e.op") == "I", "INS").otherwise("DEL").alias("svtype"),
        (F.col("_start") + F.col("e.r")).alias("ref_pos"), F.col("e.q").alias("q_pos"), F.col("e.len").alias("len"),
    )


def merge_within_read(sigs: DataFrame, keys: list[str], pos: str, length: str, rule) -> DataFrame:
    """Folds the signatures of one read in order of position: ``rule(last, next)`` says whether they merge.

    Merged signatures keep the first position and add up lengths; the rule sees the merged one.
    """
    item = F.struct(F.col(pos).cast("long").alias("pos"), F.col(length).cast("long").alias("len"))
    gathered = sigs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))  # one read's own
    empty = F.expr("cast(array() as array<struct<pos:bigint,len:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["pos"].alias("pos"), (last["len"] + x["len"]).alias("len")))
        )
        return F.when(F.size(acc) == 0, F.array(x)).when(rule(last, x), merged).otherwise(F.concat(acc, F.array(x)))

    return gathered.select(*keys, F.explode(F.aggregate("items", empty, step)).alias("m")).select(*keys, F.col("m.pos").alias("pos"), F.col("m.len").alias("len"))


def adjacent(segments: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each segment with the next one of its read: ``columns`` and the same with n_ before."""
    w = Window.partitionBy(key).orderBy(*order)
    return segments.select(key, *columns, *[F.lead(c).over(w).alias("n_" + c) for c in columns]).where(f"n_{columns[0]} is not null")


def split_indels(segments: DataFrame, key: str, order: list[str], least: int = 30, overlap: int = 30, deletion_overlap: int = 3000, far: int = 50_000) -> DataFrame:
    """Insertions and deletions between neighbouring alignments of a read on one strand and chromosome.

    The reference distance less the read distance is ``diff``, their overlap on the reference is
    ``olap``, below ``deletion_overlap``. A deletion has diff >= ``least`` and stands where the first
    alignment ends, shifted left by its length if they overlap by ``overlap`` or more. An insertion has
    diff <= -``least``; its length is the read distance plus the overlap, its place the middle of large
    overlaps, else the start of the second. Returns key, chrom, svtype, pos, len.
    """
    columns = ["chrom", "strand", "ref_start", "ref_end", "q_start", "q_end"]
    rows = adjacent(segments, key, order, columns).where("chrom = n_chrom and strand = n_strand and n_ref_start >= ref_start")
    rows = rows.withColumn("diff", (F.col("n_ref_start") - F.col("ref_end")) - (F.col("n_q_start") - F.col("q_end")))
    rows = rows.withColumn("olap", F.col("ref_end") - F.col("n_ref_start"))
    rows = rows.where((F.abs("diff") <= far) & (F.abs("diff") >= least) & (F.col("olap") < deletion_overlap))
    deletion = F.col("diff") > 0
    middle = F.floor((F.col("ref_end") + F.col("n_ref_start")) / 2)
    length = F.when(deletion, F.col("diff")).otherwise(F.abs(F.col("n_q_start") - F.col("q_end") + F.col("olap")))
    pos = F.when(deletion, F.col("ref_end") - F.when(F.col("olap") >= overlap, F.col("diff")).otherwise(0)).otherwise(
        F.when(F.abs("olap") > 400, middle).otherwise(F.col("n_ref_start"))
    )
    return rows.select(key, "chrom", F.when(deletion, "DEL").otherwise("INS").alias("svtype"), pos.cast("long").alias("pos"), length.alias("len"))


def segment_classes(segments: DataFrame, key: str, order: list[str], gap: int = 100, least: int = 30, most: int = 100_000) -> DataFrame:
    """What neighbouring segments of a read tell: DEL, INS, DUP, INV or TRA, with both places.

    Segments on one strand and chromosome differ by a deletion, an insertion or a step back (a
    duplication); on two strands by an inversion; on two chromosomes by a translocation.
    """
    columns = ["chrom", "strand", "ref_start", "ref_end", "q_start", "q_end"]
    rows = adjacent(segments, key, order, columns)
    forward = F.when(F.col("strand") == "+", F.col("n_ref_start") - F.col("ref_end")).otherwise(F.col("ref_start") - F.col("n_ref_end"))
    read_gap = F.col("n_q_start") - F.col("q_end")
    rows = rows.withColumn("ref_gap", forward).withColumn("read_gap", read_gap).withColumn("size", F.col("ref_gap") - F.col("read_gap"))
    kind = (
        F.when(F.col("chrom") != F.col("n_chrom"), "TRA")
        .when(F.col("strand") != F.col("n_strand"), "INV")
        .when((F.col("ref_gap") < -least) & (F.col("read_gap") <= gap), "DUP")
        .when(F.col("size").between(least, most), "DEL")
        .when((-F.col("size")).between(least, most), "INS")
    )
    return rows.withColumn("svtype", kind).where("svtype is not null").select(
        key, "svtype", "chrom", F.col("ref_end").alias("pos"), F.col("n_chrom").alias("chrom2"), F.col("n_ref_start").alias("pos2"), "size"
    )


def segment_triples(segments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Inversions seen as strand changes there and back (+-+ or -+-) on one chromosome: key, chrom, start, end."""
    w = Window.partitionBy(key).orderBy(*order)
    columns = ["chrom", "strand", "ref_start", "ref_end"]
    rows = segments.select(key, *columns, *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in columns])
    return rows.where("chrom = chrom1 and chrom = chrom2 and strand <> strand1 and strand = strand2").select(
        key, "chrom", F.col("ref_start1").alias("start"), F.col("ref_end1").alias("end"), F.concat("strand", "strand1", "strand2").alias("strands")
    )


def segment_pairs(segments: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """All pairs i < j of a read's segments: ``columns`` of the first, and of the second with n_ before.

    A read has few segments, so its own pairs are few; reads are dealt out by ``key``.
    """
    second = segments.select(key, F.col(ordinal).alias("n_" + ordinal), *[F.col(c).alias("n_" + c) for c in columns])
    return segments.select(key, ordinal, *columns).join(second, key).where(F.col(ordinal) < F.col("n_" + ordinal))


def split_evidence(segments: DataFrame, key: str, least_mapq: int = 10) -> DataFrame:
    """Reads with at least two good segments: key, n, chroms, strands and which pools they feed."""
    return (
        segments.where(F.col("mapq") >= least_mapq).groupBy(key)
        .agg(F.count("*").alias("n"), F.count_distinct("chrom").alias("chroms"), F.count_distinct("strand").alias("strands"))
        .where("n >= 2")
        .select(key, "n", (F.col("chroms") > 1).alias("tra"), (F.col("strands") > 1).alias("inv"), (F.col("strands") < F.col("n")).alias("dup"))
    )


def lift_window(cigars: DataFrame, key: str, ref_start: str, cigar: str, start: str, end: str) -> DataFrame:
    """Contig coordinates of a reference window: key, q_start, q_end over the aligned blocks it meets."""
    blocks = cigars.select(key, ref_start, start, end, F.posexplode(cigar).alias("at", "c"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    move = lambda ops: F.when(F.col("c.op").isin(*ops), F.col("c.len")).otherwise(0)
    blocks = blocks.withColumn("r", F.col(ref_start) + F.coalesce(F.sum(move("MDN=X")).over(w), F.lit(0))).withColumn(
        "q", F.coalesce(F.sum(move("MIS=X")).over(w), F.lit(0))
    )
    low, high = F.greatest("r", start), F.least(F.col("r") + F.col("c.len"), F.col(end))
    hit = blocks.where(F.col("c.op").isin("M", "=", "X")).withColumn("low", low).withColumn("high", high).where("low < high")
    return hit.groupBy(key).agg(
        F.min(F.col("q") + F.col("low") - F.col("r")).alias("q_start"), F.max(F.col("q") + F.col("high") - F.col("r")).alias("q_end")
    )
