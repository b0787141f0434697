"""Queries of the alignment of inserted sequences beside their own place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import settled
from ..operators import calls as K
from ..operators import mapping
from ..sources import reference as R
from . import adapters as A
from . import query


def placed_insertions(sequences):
    """An insertion a text (cid, chrom, pos, seq): a part of it as it is, turned, with changed bases, or recoded; behind that part or far from it."""
    s = sequences.withColumn("n", F.length("seq").cast("long")).where("n >= 600")
    s = s.withColumn("size", 150 + (F.col("sid") * 37) % F.expr("n div 3")).withColumn("start", F.expr("n div 3"))
    part = F.substring("seq", (F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    kind = F.col("sid") % 4
    changed = (
        F.when(kind == 0, part).when(kind == 1, F.reverse(F.translate(part, "ACGT", "TGCA")))
        .when(kind == 2, F.regexp_replace(part, "ACGAC", "ACTAC")).otherwise(F.translate(part, "ACGT", "CATG"))
    )
    place = F.col("start") + F.col("size") + F.when(F.col("sid") % 8 < 4, F.col("sid") % 50).otherwise(F.col("size") + 1000)
    return s.select(F.col("sid").alias("cid"), F.concat(F.lit("s"), F.col("sid").cast("string")).alias("chrom"), place.alias("pos"), changed.alias("seq"))


def aligned_insertions(spark, d):
    sequences = settled(A.sequences(spark, d))
    blocks = R.blocks_of(sequences.select(F.concat(F.lit("s"), F.col("sid").cast("string")).alias("name"), "seq"))
    return mapping.align_beside(placed_insertions(sequences), blocks, R.BLOCK)


@query("K16_aligned_insertions")
def insertions_beside(spark, d):
    return aligned_insertions(spark, d)


@query("K16_duplications_from_sequences")
def duplications_from_sequences(spark, d):
    """From inserted sequences to duplications: aligned beside their place, judged, the best of several kept."""
    found = K.recovered_duplications(aligned_insertions(spark, d))
    return found.select("cid", F.col("k_chrom").alias("chrom"), F.col("k_start").alias("start"), F.col("k_end").alias("end"), "strand", "score", F.col("edge").alias("shift"))
