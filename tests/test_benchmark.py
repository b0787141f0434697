"""Benchmark matching against a plain greedy choice, final genotypes by technology, contigs with folded headers."""

import random

import pytest
from pyspark.sql import functions as F

from svspark.operators import calls as K
from svspark.operators import matching as M
from svspark.plans import QUERIES, adapters
from svspark.plans.queries_matching import ON, benchmark_rows, spelled
from svspark.sources import tables as T

from .conftest import SF

CALL = "chrom string, svtype string, cid long, start long, end long, seq string"
TRUTH = "chrom string, svtype string, bid long, b_start long, b_end long, b_seq string"


def greedy(pairs):
    """(cid, bid) taken by falling score, ties to the lesser ids."""
    ones, twos, out = set(), set(), set()
    for _, c, b in sorted((-s, c, b) for c, b, s in pairs):
        if c not in ones and b not in twos:
            ones.add(c)
            twos.add(b)
            out.add((c, b))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_to_one_is_the_greedy_choice(spark):
    rng = random.Random(3)
    # few scores, so that ties abound, and a chain in which each round takes a single pair
    pairs = list({(rng.randrange(60), rng.randrange(60)): rng.randrange(4) / 4 for _ in range(400)}.items())
    pairs = [(c, b, s) for (c, b), s in pairs]
    chain = [(1000 + (i + 1) // 2, 1000 + i // 2, 1.0 - i / 100) for i in range(12)]
    rows = [*pairs, *chain, pairs[0], (None, 1, 1.0), (1, None, 1.0), (70, 70, None)]
    found = M.one_to_one(spark.createDataFrame(rows, "cid long, bid long, score double").repartition(5)).collect()
    assert sorted((r["cid"], r["bid"]) for r in found) == sorted(greedy([*pairs, *chain]))


def test_one_to_one_of_nothing(spark):
    none = spark.createDataFrame([], "cid long, bid long, score double")
    assert M.one_to_one(none).collect() == []


def test_benchmark_against_plain_loops(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    calls, truth = [], []
    for i in range(60):
        at, n = rng.randrange(3000), rng.choice([20, 29, 30, 40, 49, 50, 60, 90])
        calls.append(("chr1", rng.choice(["INS", "DEL"]), i, at, at + n, rng.choice([word(n), "A" * n, None, "a" * n, ""])))
        at, n = rng.randrange(3000), rng.choice([30, 49, 50, 55, 70, 120])
        truth.append(("chr1", rng.choice(["INS", "DEL"]), i, at, at + n, rng.choice([word(n), "A" * n, "T" * n])))
    regions = [("chr1", 0, 1500), ("chr1", 1200, 2500), ("chr2", 0, 9000)]
    inside = lambda s, e: any(c == "chr1" and a <= s and e <= b for c, a, b in regions)
    a = [c for c in calls if c[4] - c[3] >= 30 and inside(c[3], c[4])]
    b = [t for t in truth if t[4] - t[3] >= 50 and inside(t[3], t[4])]
    pairs = []
    for _, kind, i, s, e, x in a:
        for _, kind2, j, s2, e2, y in b:
            n, m, common = e - s, e2 - s2, min(e, e2) - max(s, s2)
            if kind != kind2 or abs(s - s2) > 500 or min(n, m) < 0.5 * max(n, m) or common < 0.01 * min(n, m) or x is None or not len(x) + len(y):
                continue
            w = (len(x) + len(y) - edits(x.upper(), y)) / (len(x) + len(y))
            if w >= 0.6:
                pairs.append((i, j, (w + min(n, m) / max(n, m) + common / max(n, m)) / 3))
    want = greedy(pairs)
    assert want
    found = M.benchmark(
        spark.createDataFrame(calls, CALL).withColumn("mate", F.lit("other")), spark.createDataFrame(truth, TRUTH), ON,
        spark.createDataFrame(regions, "chrom string, start long, end long"), sequence=0.6,
    ).collect()
    assert {(r["id"], r["mate"]) for r in found if r["side"] == "call" and r["mate"] is not None} == want
    assert {(r["mate"], r["id"]) for r in found if r["side"] == "truth" and r["mate"] is not None} == want
    assert sorted(r["id"] for r in found if r["side"] == "call") == sorted(c[2] for c in a)
    assert sorted(r["id"] for r in found if r["side"] == "truth") == sorted(t[2] for t in b)


def test_benchmark_of_empty_sides(spark):
    calls, truth = spark.createDataFrame([], CALL), spark.createDataFrame([("chr1", "DEL", 1, 10, 90, "A" * 80)], TRUTH)
    assert [tuple(r) for r in M.benchmark(calls, truth, ON).collect()] == [("truth", 1, None, None)]


def test_benchmark_query(spark):
    """The registered query over its whole tables against the greedy choice over the pairs of the one with SQL."""
    within = lambda rows, s, e: rows.join(adapters.regions(spark, SF).select("chrom", "start", "end").withColumnsRenamed({"start": "x", "end": "y"}), "chrom").where(f"x <= {s} and {e} <= y")
    a = {r[0] for r in within(spelled(spark, SF, "R").where("end - start >= 30").withColumnsRenamed({"start": "s", "end": "e"}), "s", "e").select("cid").collect()}
    b = {r[0] for r in within(benchmark_rows(spark, SF).where("b_end - b_start >= 50"), "b_start", "b_end").select("bid").collect()}
    scored = M.alike_calls(spelled(spark, SF, "R"), benchmark_rows(spark, SF), ON).collect()
    want = greedy([tuple(r) for r in scored if r["cid"] in a and r["bid"] in b])
    found = QUERIES["J12_benchmark"](spark, SF).collect()
    assert {(r["id"], r["mate"]) for r in found if r["side"] == "call" and r["mate"] is not None} == want
    assert {r["id"] for r in found if r["side"] == "call"} == a
    assert {r["id"] for r in found if r["side"] == "truth"} == b


def test_the_sequence_condition_changes_the_result(spark):
    loose = M.alike_calls(spelled(spark, SF, "R"), benchmark_rows(spark, SF), ON, sequence=0.0).count()
    assert M.alike_calls(spelled(spark, SF, "R"), benchmark_rows(spark, SF), ON).count() < loose


def test_finished_calls_of_each_technology(spark):
    calls = spark.createDataFrame(
        [
            (1, "chr1", "DEL", 1000, 400, "1/1", 0.5, 0.6, 0.69, 0.71, 0.91), (2, "chr1", "DEL", 9000, 400, "0/1", 0.95, 0.6, 0.69, 0.71, 0.91),
            (3, "chr1", "INS", 5000, 100, "1/1", 0.1, None, None, 0.7, 0.8), (4, "chr2", "INS", 5000, 100, "0/1", None, None, 0.5, 0.7, 0.8),
            (5, "chrX", "DEL", 700, 90, "0/1", 0.2, 0.6, 0.69, 0.71, 0.91),
        ],
        "cid long, chrom string, svtype string, pos long, svlen long, gt string, ratio double, lh double, sh double, lt double, st double",
    )
    drafts = spark.createDataFrame(
        [
            (1, "chr1", "DEL", 1900, 500, "0/1"), (2, "chr1", "INS", 1499, 80, "0/1"), (3, "chr1", "INS", 5150, 20, "0/1"), (4, "chr2", "INS", 5100, 60000, "0/1"),
            (5, "chrX", "DEL", 700, 90, "1/1"), (6, "chr1", "DEL", 9100, 20, "0/1"),
        ],
        "kid long, chrom string, svtype string, k_pos long, k_len long, k_gt string",
    )
    done = lambda t, d=drafts: sorted((r["cid"], r["pos"], r["svlen"], r["gt"]) for r in K.finished_calls(calls, d, t).collect())
    # held against the share of reads: from 1/1 down, from 0/1 up, and unchanged without a limit or share
    assert done("Hifi") == [(1, 1000, 400, "0/1"), (2, 9000, 400, "1/1"), (3, 5000, 100, "1/1"), (4, 5000, 100, "0/1"), (5, 700, 90, "0/1")]
    # the like draft's genotype; drafts of another size don't count
    assert done("CLR") == [(1, 1000, 400, "0/1"), (2, 9000, 400, "0/1"), (3, 5000, 100, "1/1"), (4, 5000, 100, "0/1"), (5, 700, 90, "1/1")]
    # insertions of the longest draft's length, here too short and too long; the deletion that ends within reach of an insertion stays
    assert done("ONT") == [(1, 1000, 400, "0/1")]
    # its last base is 1400; a draft at 1500 begins to count at 1401
    assert done("ONT", drafts.withColumn("k_pos", F.when(F.col("kid") == 2, 1500).otherwise(F.col("k_pos")))) == []
    assert [r[0] for r in done("ONT", drafts.limit(0))] == [3, 4]
    with pytest.raises(ValueError):
        K.finished_calls(calls, drafts, "other")


def test_split_indels_of_both_noisy_technologies(spark):
    # read, segments: (ref_start, ref_end, q_start, q_end) twice
    pairs = [(1, (0, 1000, 0, 1000), (1300, 2000, 1100, 1800)), (2, (0, 1000, 0, 1000), (950, 2000, 1100, 2150)), (3, (0, 1000, 0, 1000), (1600, 2600, 3000, 4000)), (4, (0, 1000, 0, 1000), (70_000, 71_000, 1000, 2000)), (5, (0, 1000, 0, 1000), (1110, 2000, 1250, 2140))]
    rows = [(k, i, "chr1", "+", *s) for k, *two in pairs for i, s in enumerate(two)]
    s = spark.createDataFrame(rows, "q long, n int, chrom string, strand string, ref_start long, ref_end long, q_start long, q_end long")
    found = lambda t: sorted(tuple(r) for r in K.split_indels_by_ratio(s, "q", ["n"], *K.SPLIT_RATIOS[t]).collect())
    want = []
    for t in ("CLR", "ONT"):
        ratio, low, high = K.SPLIT_RATIOS[t]
        rows = []
        for k, (_, e, _, qe), (s2, _, q2, _) in pairs:
            diff, olap = (s2 - e) - (q2 - qe), e - s2
            if 30 <= diff <= 50_000 and abs(qe - q2) <= diff * ratio:
                rows.append((k, "chr1", "DEL", e, diff))
            if -50_000 <= diff <= -30 and diff * low <= olap <= -diff * high:
                rows.append((k, "chr1", "INS", (e + s2) // 2 if abs(olap) > 400 else s2, -diff))
        assert found(t) == rows
        want.append(rows)
    assert want[0] != want[1]


def test_contigs_with_folded_headers(spark, tmp_path):
    text = (
        ">asm/Region_chr1_S-50_E900/hap/\nblk7_hp1.p.fa\nACGT\nacgtN\n"
        ">asm/Region_chr1_S0_E9\n00/hap/blk7_hp1.p.fa\nTT\n"
        ">asm/Region_chr5_S10_E\n99999/blk8_hp2.fa\n"
        ">nothing of the kind!\nAC\n"
    )
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">Region_chr1_S0_E900/blk7.fa\r\nGG\r\n")
    ends = spark.createDataFrame([("chr1", 800)], "chrom string, length long")
    found = lambda hap: sorted(tuple(r) for r in T.read_folded_contigs(spark, str(tmp_path), ends, hap).where("name is not null").collect())
    assert found(None) == [("chr1_0_800_blk7-1", "ACGTacgtN"), ("chr1_0_800_blk7-2", "TT"), ("chr1_0_800_blk7-3", "GG"), ("chr5_10_99999_blk8-1", "")]
    assert [n for n, _ in found("hp1")][0] == "hp1_chr1_0_800_blk7-1"
    assert T.read_folded_contigs(spark, str(tmp_path), ends).where("name is null").select("seq").collect()[0][0] == "AC"
