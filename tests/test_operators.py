"""Known answers, brute force and edge cases of the operators."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from svspark.functions import scalars as X
from svspark.operators import clustering as C
from svspark.operators import evaluation as E
from svspark.operators import intervals as I
from svspark.operators import matching as M
from svspark.sources import tables as T

from .conftest import SF

def test_is_similar_against_plain_differences(spark):
    """Alike intervals lie on one chromosome with both ends less than 20 apart."""
    r = random.Random(6)
    rows = [(r.choice("xy"), s, s + r.randint(50, 70), r.choice("xy"), t, t + r.randint(50, 70)) for s in range(0, 40, 3) for t in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "c1 string, s1 long, e1 long, c2 string, s2 long, e2 long").withColumn("found", X.is_similar("c1", "s1", "e1", "c2", "s2", "e2"))
    for x in df.collect():
        assert x["found"] == (x["c1"] == x["c2"] and abs(x["s1"] - x["s2"]) < 20 and abs(x["e1"] - x["e2"]) < 20)


def test_genotype_against_plain_python(spark):
    def plain(r, a):
        if r + a > 100:
            r0 = int(100 * r / (r + a))
            r, a = r0, 100 - r0
        logs = [math.log10(0.9) * r + math.log10(0.1) * a + math.log10(1 / 3), math.log10(0.5) * (r + a) + math.log10(1 / 3), math.log10(0.1) * r + math.log10(0.9) * a + math.log10(1 / 3)]
        total = max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs))
        n = [x - total for x in logs]
        return ["0/0", "0/1", "1/1"][n.index(max(n))], [round(-10 * x) for x in n]

    pairs = [(r, a) for r in range(0, 21, 2) for a in range(21)] + [(150, 3), (80, 90)]
    df = spark.createDataFrame(pairs, "r long, a long").withColumn("g", X.genotype("r", "a"))
    for row in df.collect():
        assert (row["g"]["gt"], list(row["g"]["pl"])) == plain(row["r"], row["a"])


def test_supplementary_alignments(spark, tmp_path):
    sam = "@HD\tVN:1.6\nr1\t0\tchr1\t101\t60\t10S50M\t*\t0\t0\t" + "A" * 60 + "\t*\tSA:Z:chr2,201,-,30S30M,-5,2;bad,1;chr3,5,+,60M,40,0,extra;\nshort\tline\n"
    (tmp_path / "x.sam").write_text(sam)
    reads = T.read_sam(spark, str(tmp_path / "x.sam"))
    r = reads.collect()
    assert len(r) == 1 and (r[0]["ref_start"], r[0]["ref_end"]) == (100, 150)
    found = sorted((x["chrom"], x["ref_start"], x["strand"], x["mapq"]) for x in T.supplementary(reads).collect())
    assert found == [("chr2", 200, "-", 0), ("chr3", 4, "+", 40)]


def random_sigs(n, seed):
    rng = random.Random(seed)
    return [("chr%d" % rng.randint(1, 2), rng.choice(["DEL", "INS"]), rng.randint(0, 4000), rng.randint(30, 400), i) for i in range(n)]


def sig_frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, svtype string, pos long, svlen long, rname long")


@pytest.mark.parametrize("width", [7, 300, 10**6])
def test_islands_and_merging_do_not_depend_on_bins(spark, width):
    rows = random_sigs(150, 3)
    df = sig_frame(spark, rows)
    found = I.islands(df, ["chrom"], "pos", 40, width=width).groupBy("chrom", "cid").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"))
    want = set()
    for chrom in ("chr1", "chr2"):
        ps = sorted(r[2] for r in rows if r[0] == chrom)
        group = [ps[0]]
        for p in ps[1:] + [10**9]:
            if p - group[-1] > 40:
                want.add((chrom, group[0], group[-1], len(group)))
                group = []
            group.append(p)
    assert {(r["chrom"], r["a"], r["b"], r["n"]) for r in found.collect()} == want
    ivs = df.withColumn("end", F.col("pos") + F.col("svlen"))
    merged = I.merge_islands(ivs, ["chrom"], "pos", "end", 10, width=width).groupBy("chrom", "cid").agg(F.min("pos").alias("a"), F.max("end").alias("b"))
    want = set()
    for chrom in ("chr1", "chr2"):
        cur = None
        for a, b in sorted((r[2], r[2] + r[3]) for r in rows if r[0] == chrom):
            if cur and a - cur[1] < 10:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    want.add((chrom, *cur))
                cur = [a, b]
        want.add((chrom, *cur))
    assert {(r["chrom"], r["a"], r["b"]) for r in merged.collect()} == want


@pytest.mark.parametrize("width", [5, 100, 5000])
def test_overlap_pairs_against_all_pairs(spark, width):
    left, right = random_sigs(60, 1), random_sigs(60, 2)
    a = sig_frame(spark, left)
    b = sig_frame(spark, right).select("chrom", F.col("pos").alias("p2"), F.col("svlen").alias("n2"), F.col("rname").alias("r2"))
    found = I.overlap_pairs(a, b, ["chrom"], F.col("pos"), F.col("pos") + F.col("svlen"), F.col("p2"), F.col("p2") + F.col("n2"), width)
    want = sorted((x[4], y[4]) for x in left for y in right if x[0] == y[0] and x[2] <= y[2] + y[3] and y[2] <= x[2] + x[3])
    assert sorted((r["rname"], r["r2"]) for r in found.collect()) == want


def test_first_fit_and_leaders_against_plain_loops(spark):
    rows = random_sigs(120, 5)
    df = sig_frame(spark, rows)
    found = C.first_fit(df, ["chrom"], "pos", "svlen", 60, ["rname"])
    sizes = sorted(r["n"] for r in found.groupBy("chrom", "_island", "cluster").agg(F.count("*").alias("n")).collect())
    want = []
    for chrom in ("chr1", "chr2"):
        clusters = []
        for _, _, p, n, _ in sorted((r for r in rows if r[0] == chrom), key=lambda r: (r[2], r[3], r[4])):
            for c in clusters:
                if abs(c[-1][0] - p) <= 60 and abs(c[-1][1] - n) <= 60:
                    c.append((p, n))
                    break
            else:
                clusters.append([(p, n)])
        want += [len(c) for c in clusters]
    assert sizes == sorted(want)
    assert C.leaders(df, ["chrom", "svtype"], 100, 0.5, ["rname"]).agg(F.sum("n")).first()[0] == len(rows)


@pytest.mark.parametrize("width", [7, 100, 10**6])
def test_switches_do_not_depend_on_bins(spark, width):
    r = random.Random(5)
    rows = [(b, p, r.choice([0, 0, 0, 1, None])) for b in ("chr1", "chr2", None) for p in sorted(r.sample(range(400), 90))]
    df = spark.createDataFrame(rows, "chrom string, pos long, phase int")
    flags = E.switch_flags(df, ["chrom"], "pos", "phase", width)
    want, pieces = [], []
    for b in ("chr1", "chr2", None):
        of = [x for x in rows if x[0] == b]
        s = [int(i > 0 and None not in (x[2], of[i - 1][2]) and x[2] != of[i - 1][2]) for i, x in enumerate(of)]
        for i, x in enumerate(of):
            near = any(s[k] for k in (i - 1, i + 1) if 0 <= k < len(s))
            want.append((*x, s[i], "CORRECT" if not s[i] else "POINT" if near else "LONG"))
        for k in range(sum(s) + 1):
            at = [x[1] for i, x in enumerate(of) if sum(s[: i + 1]) == k]
            pieces.append((b, k, at[0], at[-1], len(at)))
    assert sorted(map(tuple, flags.collect()), key=repr) == sorted(want, key=repr)
    found = E.blocks_between_errors(flags, ["chrom"], "pos", width).select("chrom", "piece", "start", "end", "n").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(pieces, key=repr)
    # a whole block is never sorted in one task: windows over rows are per bin
    plan = E.switch_flags(df, ["chrom"], "pos", "phase", width)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_bin" in line for line in plan.splitlines() if "Window [lag(" in line or "Window [lead(" in line)


def test_first_fit_over_a_long_chain(spark):
    """One island of 60,000 rows in which a new cluster opens again and again: those out of reach must not be scanned."""
    n = 60_000
    df = spark.range(n).selectExpr("'chr1' AS chrom", "id * 50 AS s", "(id * 7919 % 60013) * 1000 AS e")
    start = time.time()
    found = C.first_fit(df, ["chrom"], "s", "e", 100, [])
    assert found.agg(F.count("*"), F.count_distinct("_island"), F.max("cluster")).first() == (n, 1, n - 1)
    assert time.time() - start < 60


def test_complete_linkage_keeps_every_signature(spark):
    """Islands of more than ten members too: each signature in one cluster, those of plain loops."""
    r = random.Random(8)
    spots = [("chr1", "DEL", 10_000 * k + r.randint(0, 60 * n), 50 + r.randint(0, 90)) for k, n in enumerate((1, 3, 10, 11, 40, 90)) for _ in range(n)]
    spots = sorted({*spots, *[("chr2", "INS", 100 * k, 50) for k in range(30)]})  # a chain of ties
    df = spark.createDataFrame(spots, "chrom string, svtype string, pos long, svlen long")
    found = C.complete_linkage(df, ["chrom", "svtype"], "pos", "svlen", 200).collect()
    want = set()
    for chrom in ("chr1", "chr2"):
        left = [[s[2:]] for s in spots if s[0] == chrom]
        far = lambda a, b: max(abs(p - q) + abs(m - n) for p, m in a for q, n in b)
        while True:
            d, a, b = min((far(left[a], left[b]), a, b) for a in range(len(left)) for b in range(a + 1, len(left)))
            if d > 200:
                break
            left[a] += left.pop(b)
        want |= {(chrom, frozenset(c)) for c in left}
    got = {}
    for row in found:
        got.setdefault((row["chrom"], row["_island"], row["cluster"]), []).append((row["pos"], row["svlen"]))
    assert len(found) == len(spots)
    assert {(k[0], frozenset(v)) for k, v in got.items()} == want


def test_complete_linkage_marks_islands_over_the_limit(spark):
    rows = [("c", 10 * k, 50) for k in range(12)] + [("c", 10_000, 50), ("c", 10_040, 50)]
    df = spark.createDataFrame(rows, "chrom string, pos long, svlen long")
    found = C.complete_linkage(df, ["chrom"], "pos", "svlen", 200, most=10).collect()
    assert len(found) == 14 and sum(r["cluster"] == -1 for r in found) == 12
    assert len({(r["_island"], r["cluster"]) for r in found if r["cluster"] >= 0}) == 1


def test_complete_linkage_query_reads_all_signatures(spark):
    from svspark.plans import QUERIES, adapters

    rows = adapters.sigs(spark, SF).select("chrom", "svtype", "pos", "svlen").distinct()
    assert QUERIES["A17_complete_linkage"](spark, SF).agg(F.sum("n")).first()[0] == rows.count()


def test_haplotype_pairs_use_each_call_once(spark):
    one, two = random_sigs(80, 7), random_sigs(80, 8)
    found = M.pair_haplotypes(sig_frame(spark, one), sig_frame(spark, two), ["chrom", "svtype"]).groupBy("gt").count().collect()
    n = {r["gt"]: r["count"] for r in found}
    assert 2 * n.get("1/1", 0) + n["0/1"] == 160 and n.get("1/1", 0) > 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_depth_of_overlapping_reads(spark):
    regions = spark.createDataFrame([("c", 1, 0, 100), ("c", 2, 200, 300)], "chrom string, iid long, start long, end long")
    reads = spark.createDataFrame([("c", 10, 40), ("c", 30, 60), ("c", 90, 150)], "chrom string, r_start long, r_end long")
    found = {r["iid"]: (r["bases"], r["covered"], r["depth"]) for r in I.depth(regions, reads, ["chrom"], 16).collect()}
    assert found == {1: (70, 60, 70 / 60), 2: (0, 0, None)}


def test_n50_and_votes(spark):
    blocks = spark.createDataFrame([("x", n) for n in (10, 20, 30, 40)], "k string, len long")
    assert E.n50(blocks, ["k"], "len").first()["n50"] == 30
    votes = spark.createDataFrame([(1, "0/1"), (1, "0/1"), (1, "1/1"), (2, "0/1"), (2, "1/1")], "k long, gt string")
    assert {r["k"]: r["gt"] for r in E.majority_vote(votes, ["k"], "gt").collect()} == {1: "0/1", 2: "./."}


def test_empty_inputs(spark):
    none = sig_frame(spark, [])
    assert I.islands(none, ["chrom"], "pos", 10).count() == 0
    assert C.signature_regions(none).count() == 0
    assert C.leaders(none, ["chrom", "svtype"], 10, 0.5, []).count() == 0
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_file_formats(spark, tmp_path):
    (tmp_path / "t.bed").write_text("chr1\t5\t9\tDUP\nchr2\t1\t2\t30\t40\tINV\nchr1\t1\t2\tchr5\t3\t4\tTRA\n")
    found = {r["svtype"]: (r["chrom"], r["start"], r["chrom2"], r["start2"], r["end2"]) for r in T.read_typed_bed(spark, str(tmp_path / "t.bed")).collect()}
    assert found == {"DUP": ("chr1", 5, None, None, None), "INV": ("chr2", 1, "chr2", 30, 40), "TRA": ("chr1", 1, "chr5", 3, 4)}
    (tmp_path / "x.fa").write_text(">a one\nacg\nT\n>b\n\nGG\n")
    assert sorted(map(tuple, T.read_fasta(spark, str(tmp_path / "x.fa")).collect())) == [("a", "ACGT"), ("b", "GG")]
    (tmp_path / "x.gfa").write_text("H\tVN\nS\tu1\tACGT\nL\tu1\n")
    assert [tuple(r) for r in T.read_gfa_segments(spark, str(tmp_path / "x.gfa")).collect()] == [("u1", "ACGT")]


def test_links_ask_for_a_common_part(spark):
    """Calls that touch are linked at 0, those apart aren't; a share is one of the longer call."""
    rows = [(1, "c", 0, 100), (2, "c", 100, 50), (3, "c", 300, 60), (4, "c", 310, 90), (5, "d", 0, 100), (6, "c", 151, 40)]
    df = spark.createDataFrame(rows, "cid long, chrom string, pos long, svlen long")

    def links(**more):
        return {(r["a"], r["b"]) for r in M.match_links(df, ["chrom"], 3000, 0.1, **more).collect()}

    plain = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1]}
    assert links() == plain
    for least in (0, 0.5, 0.6):
        want = {(a[0], b[0]) for a in rows for b in rows if (a[0], b[0]) in plain and min(a[2] + a[3], b[2] + b[3]) - max(a[2], b[2]) >= least * max(a[3], b[3])}
        assert links(overlap=least) == want
    assert links(overlap=0) == {(1, 2), (3, 4)} and links(overlap=0.6) == set()
