"""Operators whose work is dealt to ranges, levels and chunks, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from svspark.operators import clustering as C
from svspark.operators import evaluation as E
from svspark.operators import intervals as I
from svspark.operators import matching as M
from svspark.plans import QUERIES

from .conftest import SF


def plain_first_fit(rows, within):
    clusters = []
    for a, b in rows:
        for c in clusters:
            if abs(a - c[-1][0]) <= within and abs(b - c[-1][1]) <= within:
                c.append((a, b))
                break
        else:
            clusters.append([(a, b)])
    return sorted(map(sorted, clusters))


def test_first_fit_hands_open_clusters_over_ranges(spark):
    r = random.Random(3)
    sets = {"chain": [(40 * i + r.randint(0, 60), r.choice([0, 1, 2, 3]) * 90 + r.randint(-40, 40)) for i in range(160)]}
    sets["dense"] = [(r.randint(0, 300), r.randint(0, 600)) for _ in range(120)]
    sets["far"] = [(5000 * i, 5) for i in range(40)]
    sets["over"] = [(i * 50, 0) for i in range(90)]  # one cluster over all ranges
    rows = [(k, a, b, 1.5, "x") for k, v in sets.items() for a, b in v] + [("null", None, 3, 1.0, "x")]
    df = spark.createDataFrame(rows, "chrom string, a long, b long, in_x double, cluster2 string").repartition(3)
    for range_rows in (7, 50, 10_000):
        found = C.first_fit(df, ["chrom"], "a", "b", 60, [], range_rows=range_rows)
        assert set(found.columns) == {*df.columns, "_island", "cluster"}
        got = {}
        for x in found.collect():
            got.setdefault(x["chrom"], {}).setdefault((x["_island"], x["cluster"]), []).append((x["a"], x["b"]))
        assert {k: sorted(map(sorted, v.values())) for k, v in got.items()} == {k: plain_first_fit(sorted(v), 60) for k, v in sets.items()}
    assert C.first_fit(df.limit(0), ["chrom"], "a", "b", 60, []).count() == 0


def test_intervals_of_any_length_meet_by_levels(spark):
    r = random.Random(5)
    make = lambda n, longest: [(i, r.choice("ab"), s := r.randint(-2000, 200_000), s + int(longest ** r.random())) for i in range(n)]
    left, right = [*make(150, 50_000), (900, "a", 0, 9_000_000), (901, "b", 5, 4)], [*make(150, 3000), (900, "a", -50, 400_000)]
    a = spark.createDataFrame(left, "i long, k string, s long, e long")
    b = spark.createDataFrame(right, "j long, k string, u long, v long")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= x[3] and x[2] <= y[3] and y[2] <= x[3])
    for levels in (1, 2, 3):
        found = I.overlap_pairs(a, b, ["k"], F.col("s"), F.col("e"), F.col("u"), F.col("v"), 500, levels)
        assert sorted((x["i"], x["j"]) for x in found.collect()) == want
    # a call of 10 Mb whose radius is 2.3 times its length touches few bins
    far = spark.createDataFrame([(1, 30_000_000 - 23_000_000, 30_000_000 + 23_000_000)], "i long, _ls long, _le long")
    _, bins = I._level_bins("_ls", "_le", 5000, M.LEVELS)
    assert far.select(F.size(bins)).first()[0] <= I.WIDER + 2


@pytest.mark.parametrize("chunk", [None, 64, 1000])
def test_pairs_by_distance_without_listing_pairs(spark, chunk):
    r = random.Random(7)
    rows = [(k, r.randint(-500, 3000) if k == "a" else 10**9 + r.randint(0, 200), r.randint(0, 1)) for k in "ab" for _ in range(250)]
    rows += [("a", None, 1), ("a", 5, None), ("b", 10**9, 1), ("b", 10**9, 0)]
    df = spark.createDataFrame(rows, "chrom string, pos long, ok int")
    pairs, accurate = {}, {}
    good = [x for x in rows if x[1] is not None and x[2] is not None]
    for i, x in enumerate(good):
        for y in good[i + 1 :]:
            d = abs(x[1] - y[1])
            if x[0] == y[0] and 0 < d <= 700:
                k = (d - 1) // 90
                pairs[k] = pairs.get(k, 0) + 1
                accurate[k] = accurate.get(k, 0) + (x[2] == y[2])
    want, total = [], 0
    for k in sorted(pairs):
        total += pairs[k]
        want.append((k, pairs[k], accurate[k], total))
    assert sorted(map(tuple, E.pairs_by_distance(df, ["chrom"], "pos", "ok", 700, 90, chunk).collect())) == want


def test_quantiles_by_counts_of_ranges(spark):
    r = random.Random(9)
    sets = {
        "long": [r.randint(0, 10**12) for _ in range(801)], "few": [r.choice([1, 2, 2, 7]) for _ in range(500)], "one": [5.5], "two": [1.0, 2.0], "far": [-1.7e308, 1.7e308, 0.0],
        "steep": [1.5**k for k in range(300)], "near": [1 + k * 2.0**-52 for k in range(40)], None: [3.0, 4.0, 9.0],
    }
    rows = [(k, float(v), "x") for k, vs in sets.items() for v in vs] + [("few", None, "x"), ("gone", None, "x"), ("few", float("nan"), "x")]
    df = spark.createDataFrame(rows, "k string, v double, n string").repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {(x["k"], x["share"]): (x["q"], x["n"]) for x in E.exact_quantiles(df, ["k"], "v", shares, ranges=8).collect()}
    assert len(found) == len(sets) * len(shares)
    for k, vs in sets.items():
        vs = sorted(map(float, vs))
        for s in shares:
            at = s * (len(vs) - 1)
            low, high = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            want = low + (high - low) * (at - int(at)) if high != low else low
            assert found[k, s][1] == len(vs)
            assert found[k, s][0] == pytest.approx(want, rel=1e-15, abs=0) or not np.isfinite(want)
    ints = spark.range(101).select(F.lit("a").alias("k"), (F.col("id") * 3).alias("v"))
    assert sorted(x["q"] for x in E.exact_quantiles(ints, ["k"], "v", [0.5, 0.005]).collect()) == [1.5, 150.0]
    assert E.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_callsets_merge_by_class(spark):
    rows = [
        (0, "c1", "DEL", None, 100, 180, 80), (1, "c1", "DEL", None, 150, 230, 80), (2, "c1", "DEL", None, 200, 280, 80),  # a chain within 50
        (1, "c1", "DEL", None, 251, 331, 80), (0, "c1", "INS", None, 100, 180, 80),  # 51 further; another type
        (0, "c1", "DEL", None, 100, 5100, 5000), (2, "c1", "DEL", None, 900, 6900, 6000),  # starts near, ends not
        (0, "c1", "BND", "c2", 10, 500, 0), (1, "c1", "BND", "c2", 900, 1500, 0), (1, "c1", "BND", "c3", 10, 500, 0), (2, "c1", "DEL", None, 101, 181, -80),
    ]
    df = spark.createDataFrame(rows, "caller int, chrom string, svtype string, chrom2 string, start long, end long, svlen long")
    got = sorted((x["svtype"], x["chrom2"] or "", x["class"], x["start"], x["end"], x["n"], x["supp_vec"], x["callers"]) for x in M.merge_callsets(df, 3).collect())
    assert got == sorted([
        ("DEL", "", 0, 100, 280, 4, "111", 3), ("DEL", "", 0, 251, 331, 1, "010", 1), ("INS", "", 0, 100, 180, 1, "100", 1), ("DEL", "", 3, 100, 5100, 1, "100", 1),
        ("DEL", "", 3, 900, 6900, 1, "001", 1), ("BND", "c2", -1, 10, 1500, 2, "110", 2), ("BND", "c3", -1, 10, 500, 1, "010", 1),
    ])


def test_translocations_match_in_either_orientation(spark):
    calls = [(1, "a", 100, "b", 5000), (2, "a", 100, "b", 9000), (3, "b", 5100, "a", 50), (4, "a", 100, "c", 5000), (5, "a", 1100, "b", 6000)]
    truth = [(7, "b", 5000, "a", 100), (8, "a", 2000, "b", 6900)]
    found = M.translocation_match(
        spark.createDataFrame(calls, "cid long, chrom string, pos long, chrom2 string, pos2 long"),
        spark.createDataFrame(truth, "tid long, t_chrom string, t_pos long, t_chrom2 string, t_pos2 long"),
    )
    assert {x["cid"]: x["tid"] for x in found.collect()} == {1: 7, 2: None, 3: 7, 4: None, 5: 7}


def test_n50_of_parted_blocks_query(spark):
    parts = {}
    for x in QUERIES["K17_blocks_between_errors"](spark, SF).collect():
        parts.setdefault(x["chrom"], []).append((x["length"], x["adjusted"]))

    def n50(values):
        values, run = sorted(values, reverse=True), 0
        for v in values:
            run += v
            if run >= 0.5 * sum(values) - 1e-6:
                return v

    want = {c: tuple(n50(v) for v in zip(*rows, strict=True)) for c, rows in parts.items()}
    found = {x["chrom"]: (x["n50"], x["adjusted_n50"]) for x in QUERIES["K17_qan50"](spark, SF).collect()}
    assert found == want and len(found) > 5
