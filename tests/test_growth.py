"""Queries whose work once grew faster than their rows; each of these took minutes before."""

import random
import time

from pyspark.sql import functions as F

from svspark.operators import evidence as V
from svspark.operators import haplotypes as H


def test_edit_distances_of_unlike_alleles():
    rng = random.Random(6)
    word = lambda n: bytes(rng.choices(b"ACGT", k=n))
    pairs = [(word(rng.randrange(1, 90)), word(rng.randrange(1, 90))) for _ in range(60)] + [(b"", b""), (b"A" * 300, b"A" * 20)]
    long = word(5000)
    pairs += [(long, long[:100] + b"T" + long[100:]), (long, word(5000)), (b"", b"AC")]
    for most in (5, 200):
        assert H.edit_distances(pairs, most).tolist() == [H.edit_distance(a, b, most) for a, b in pairs]
    many = [(word(400), word(400)) for _ in range(3000)]  # most have about 200 edits
    began = time.process_time()
    assert len(H.edit_distances(many, 200)) == 3000
    assert time.process_time() - began < 15


def test_targets_meet_pairs_and_not_segments(spark):
    """8,000 targets on one place with 8,000 reads that have a segment each, and two that have a pair."""
    one = spark.range(8000).select(
        F.col("id").alias("q"), F.lit("chr1").alias("chrom"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(1000).cast("long").alias("ref_start"),
        F.lit(1500).cast("long").alias("ref_end"), F.lit(0).cast("long").alias("q_start"), F.lit(500).cast("long").alias("q_end"),
    )
    pairs = [(9000, "chr1", "+", 900, 1400, 0, 500), (9000, "chr1", "-", 2300, 2800, 520, 1020), (9001, "chr1", "+", 910, 1410, 0, 500), (9001, "chr1", "-", 2310, 2805, 520, 1020)]
    segments = one.unionByName(spark.createDataFrame([*pairs, pairs[0]], one.schema))
    targets = spark.range(8000).select(F.col("id").alias("tid"), F.lit("chr1").alias("chrom"), *[F.lit(x).cast("long").alias(c) for c, x in (("start1", 800), ("end1", 2900), ("start2", 1800), ("end2", 3000))])
    began = time.time()
    found = V.inversions_in_targets(segments, targets.unionByName(targets.limit(5)), "q").collect()
    assert time.time() - began < 60
    assert sorted(r["tid"] for r in found) == list(range(8000))
    assert {tuple(r)[1:] for r in found} == {("chr1", 1405, 2802, 2)}


def test_breakends_are_matched_without_all_pairs(spark):
    """The greedy choice over all pairs, in steps as narrow as they get and in one."""
    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 2]), "chr1", rng.randrange(300), "chr2", rng.choice([5, 5, 40, rng.randrange(300)]), rng.choice(["x", "y"])) for i in range(250)]
    rows += [(900, 1, "chr1", 5000, "chr2", 5000, "x"), (901, 2, "chr1", 5400, "chr2", 5500, "x"), (902, 2, "chr1", 5000, "chr2", 5901, "x"), (903, 1, None, 5400, "chr2", 5500, "x")]
    df = spark.createDataFrame(rows, "cid long, hap int, chrom string, start long, chrom2 string, end long, form string")
    want = {tuple(r) for r in H.match_greedily(H.breakend_distances(df, 900)).collect()}
    assert (900, 901, 900) in want
    for spare in (0, 2_000_000):
        assert {tuple(r) for r in H.match_breakends(df, 900, spare=spare).collect()} == want


def test_first_fit_looks_at_clusters_near_a_row():
    """30,000 clusters open at a time; each row was held against all of them."""
    from svspark.operators.clustering import _Fit

    fit = _Fit(10, [])
    began = time.process_time()
    assert [fit.add(0, b * 100) for b in range(30_000)] == list(range(30_000))
    assert [fit.add(5, b * 100 + 10) for b in range(30_000)] == list(range(30_000))
    assert fit.add(16, 10) == 30_000  # out of reach of all in the first coordinate
    assert fit.add(16, float("nan")) == 30_001
    assert fit.add(16, 20) == 30_000
    assert time.process_time() - began < 10
