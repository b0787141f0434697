"""Intervals of any length meet on one level only."""

import random

from pyspark.sql import functions as F

from svspark.operators import intervals as I


def test_pairs_of_all_lengths(spark):
    rng = random.Random(4)
    rows = lambda n: [(i, s, s + rng.choice([0, 10, 500, 5000, 100_000, 900_000])) for i in range(n) for s in [rng.randrange(1_000_000)]]
    a, b = rows(150), rows(150)
    df = lambda x, p: spark.createDataFrame([("c", *r) for r in x], f"chrom string, {p}i long, {p}s long, {p}e long")
    for width in (20, 1000):
        found = I.overlap_pairs(df(a, "a"), df(b, "b"), ["chrom"], F.col("as"), F.col("ae"), F.col("bs"), F.col("be"), width=width, levels=3)
        assert sorted((r["ai"], r["bi"]) for r in found.collect()) == sorted((i, j) for i, s, e in a for j, x, y in b if s <= y and x <= e)


def test_short_intervals_do_not_meet_on_coarse_levels(spark):
    """2,000 short intervals far from each other meet a few others; on a level above, all met all."""
    df = spark.range(2000).select((F.col("id") * 1000).alias("s"), (F.col("id") * 1000 + 10).alias("e"))
    a = df.select(F.explode(I._sided_bins("s", "e", 500, 3, True)).alias("b"))
    b = df.select(F.explode(I._sided_bins("s", "e", 500, 3, False)).alias("b"))
    assert a.join(b, "b").count() < 5000
