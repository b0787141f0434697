"""Queries that SQL can't express against plain loops over the same whole tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from svspark.operators import evidence as V
from svspark.operators import segments as S
from svspark.plans import QUERIES, adapters
from svspark.plans.queries_evidence import numbered, targets
from svspark.sources import tables as T

from .conftest import SF


def by(rows, n):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[:n]), []).append(tuple(r[n:]))
    return {k: sorted(v) for k, v in out.items()}


def first_fit(rows, within):
    """Clusters of sorted (x, y, ...): each joins the first whose last member is near in both."""
    clusters = []
    for r in rows:
        for c in clusters:
            if abs(c[-1][0] - r[0]) <= within and abs(c[-1][1] - r[1]) <= within:
                c.append(r)
                break
        else:
            clusters.append([r])
    return clusters


def mean(c, i):
    return sum(r[i] for r in c) // len(c)


def test_first_fit_query(spark):
    rows = adapters.segments(spark, SF).select("chrom", "strand", "ref_start", "ref_end").distinct().collect()
    want = Counter((*k, mean(c, 0), mean(c, 1), len(c)) for k, v in by(rows, 2).items() for c in first_fit(v, 100))
    found = QUERIES["A8_first_fit_clusters"](spark, SF).select("chrom", "strand", "start", "end", "n").collect()
    assert Counter(map(tuple, found)) == want


def alike(kind, p, n, q, m):
    if min(n, m) < 0.5 * max(n, m):
        return False
    return kind != "DEL" or min(p + n, q + m) - max(p, q) >= 0.5 * min(n, m)


def test_leader_query(spark):
    rows = adapters.sigs(spark, SF).select("chrom", "svtype", "pos", "svlen").distinct().collect()
    want = Counter()
    for k, v in by(rows, 2).items():
        free = [True] * len(v)
        for i, (p, n) in enumerate(v):
            if free[i]:
                mine = [j for j in range(i, len(v)) if free[j] and v[j][0] - p <= 100 and alike(k[1], p, n, *v[j])]
                for j in mine:
                    free[j] = False
                best = max(mine, key=lambda j: (v[j][1], -j))
                want[(*k, *v[best], len(mine))] += 1
    found = QUERIES["A9_leader_clusters"](spark, SF).select("chrom", "svtype", "pos", "svlen", "n").collect()
    assert Counter(map(tuple, found)) == want and any(k[1] == "DEL" and k[4] > 1 for k in want)


def test_haplotype_query(spark):
    rows = adapters.sigs(spark, SF).select("chrom", "svtype", "pos", "svlen", (F.col("ln") % 2).alias("h")).distinct().collect()
    want = Counter()
    for k, v in by(rows, 2).items():
        one, two = [x[:2] for x in v if x[2] == 0], [x[:2] for x in v if x[2] == 1]
        free = [True] * len(two)
        for p, n in one:
            for j, (q, m) in enumerate(two):
                if free[j] and abs(q - p) <= 200 and alike(k[1], p, n, q, m):
                    free[j] = False
                    want[(*k, *((p, n) if n > m else (q, m)), "1/1")] += 1
                    break
            else:
                want[(*k, p, n, "0/1")] += 1
        want.update((*k, *x, "0/1") for x, f in zip(two, free, strict=True) if f)
    found = QUERIES["J7_haplotype_pairs"](spark, SF).select("chrom", "svtype", "pos", "svlen", "gt").collect()
    assert Counter(map(tuple, found)) == want and any(k[4] == "1/1" for k in want)


def test_linkage_query(spark):
    rows = adapters.sigs(spark, SF).select("chrom", "svtype", "pos", "svlen").distinct().collect()
    want = Counter()
    for k, v in by(rows, 2).items():
        parts = [[v[0]]]
        for x in v[1:]:
            if x[0] - parts[-1][-1][0] > 200:
                parts.append([])
            parts[-1].append(x)
        for part in parts:
            left = [[x] for x in part]
            far = lambda a, b: max(abs(p - q) + abs(m - n) for p, m in a for q, n in b)
            while len(left) > 1:
                d, a, b = min((far(left[a], left[b]), a, b) for a in range(len(left)) for b in range(a + 1, len(left)))
                if d > 200:
                    break
                left[a] += left.pop(b)
            want.update((*k, min(x[0] for x in c), max(x[1] for x in c), len(c)) for c in left)
    found = QUERIES["A17_complete_linkage"](spark, SF).select("chrom", "svtype", "pos", "svlen", "n").collect()
    assert Counter(map(tuple, found)) == want and max(k[4] for k in want) > 2


def reads_of(spark):
    out = {}
    for r in numbered(spark, SF).collect():
        out.setdefault(r["qname"], []).append(r)
    return {k: sorted(v, key=lambda r: r["o"]) for k, v in out.items()}


def pairs_of(spark):
    return [(q, a, b) for q, v in reads_of(spark).items() for i, a in enumerate(v) for b in v[i + 1 :]]


def test_inversion_evidence_query(spark):
    ends = {}
    for q, a, b in pairs_of(spark):
        if a["chrom"] == b["chrom"] and a["strand"] != b["strand"] and abs(b["q_start"] - a["q_end"]) <= 700:
            x, y = sorted((a["ref_end"], b["ref_end"]))
            if y - x >= 30:
                ends.setdefault(a["chrom"], []).append((x, y, q))
    want = Counter((k, mean(c, 0), mean(c, 1), len(c)) for k, v in ends.items() for c in first_fit(sorted(v), 500))
    found = QUERIES["K11_inversion_evidence"](spark, SF).select("chrom", "start", "end", "n").collect()
    assert Counter(map(tuple, found)) == want


def test_translocations_in_passes_query(spark):
    rows = {}
    for q, a, b in pairs_of(spark):
        if a["chrom"] == b["chrom"]:
            continue
        a, b = sorted((a, b), key=lambda s: s["chrom"])
        begin = lambda s: s["ref_start"] if s["strand"] == "+" else s["ref_end"]
        finish = lambda s: s["ref_end"] if s["strand"] == "+" else s["ref_start"]
        if abs(a["q_start"] - b["q_end"]) <= 1000:
            x, y = begin(a), finish(b)
        elif abs(b["q_start"] - a["q_end"]) <= 1000:
            x, y = finish(a), begin(b)
        else:
            continue
        rows.setdefault((a["chrom"], b["chrom"], "++" if a["strand"] == b["strand"] else "+-"), []).append((x, y, q))
    last = {}
    for (one, two, _), v in rows.items():
        first = sorted((mean(c, 0), mean(c, 1), len(c)) for c in first_fit(sorted(v), 100))
        for c in first_fit(first, 2000):
            last.setdefault((one, two), []).append((mean(c, 0), mean(c, 1), sum(r[2] for r in c)))
    want = Counter()
    for (one, two), v in last.items():
        want.update((one, mean(c, 0), two, mean(c, 1), sum(r[2] for r in c)) for c in first_fit(sorted(v), 100))
    found = QUERIES["K12_translocations_in_passes"](spark, SF).select("chrom1", "pos1", "chrom2", "pos2", "n").collect()
    assert Counter(map(tuple, found)) == want and len(want) > 20


def test_inversions_in_targets_query(spark):
    some = targets(spark, SF).where("tid % 20 = 3")  # plain loops are slow: some targets, all segments
    segments = adapters.segments(spark, SF)
    every = [r.asDict() for r in segments.collect()]
    want = Counter()
    for t in some.collect():
        met = [s for s in every if s["chrom"] == t["chrom"] and any(s["ref_start"] <= e and s["ref_end"] >= b for b, e in ((t["start1"], t["end1"]), (t["start2"], t["end2"])))]
        place = lambda s: (s["strand"], s["ref_start"], s["ref_end"], s["q_start"], s["q_end"])
        by_read = {}
        for s in met:
            by_read.setdefault(s["qname"], set()).add(place(s))
        ends = []
        for q, places in by_read.items():
            for f in (p for p in places if p[0] == "+"):
                for r in (p for p in places if p[0] == "-"):
                    if f[3] < r[3]:
                        d, x, y = abs(f[4] - r[3]), f[2], r[2]
                    else:
                        d, x, y = abs(r[4] - f[3]), r[1], f[1]
                    if d <= 500:
                        ends.append((*sorted((x, y)), q))
        once = [(mean(c, 0), mean(c, 1), len(c)) for c in first_fit(sorted(ends), 100)]
        once = sorted(c for c in once if t["start1"] < c[0] < t["end1"] and t["start2"] < c[1] < t["end2"] and c[1] - c[0] >= 30)
        want.update((t["tid"], t["chrom"], mean(c, 0), mean(c, 1), sum(r[2] for r in c)) for c in first_fit(once, 500))
    found = V.inversions_in_targets(segments, some, "qname", reach=500).select("tid", "chrom", "start", "end", "n").collect()
    assert Counter(map(tuple, found)) == want and len(want) > 20


def kinds(phases):
    """Codes of a block's phased SNPs by rereading it from every switch."""
    switches = [i for i in range(1, len(phases)) if phases[i] != phases[i - 1]]
    out = [0] * len(phases)
    out[:1] = [4]
    k = 0
    while k < len(switches):
        at = switches[k]
        after = switches[k + 1] if k + 1 < len(switches) else None
        if after is not None and after - at - 1 < 3:
            out[at] = out[after] = 3
            k += 2
            continue
        follows = (after if after is not None else len(phases)) - at - 1
        out[at] = 2 if follows >= 3 and at >= 3 else 1
        k += 1
    return out


def test_phasing_queries(spark):
    from svspark.plans.queries_evaluation import blocks_of_snps

    rows = [tuple(r) for r in blocks_of_snps(spark, SF).select("chrom", "ps", "pos", "phase").collect()]
    codes, want = {}, Counter()
    for (chrom, ps), v in by([r for r in rows if r[3] is not None], 2).items():
        for (pos, _), code in zip(v, kinds([x[1] for x in v]), strict=True):
            codes[chrom, ps, pos] = code
            want[chrom, code] += 1
    found = {(r["chrom"], r["error"]): r["n"] for r in QUERIES["K17_switch_kinds"](spark, SF).collect()}
    assert found == want and len({c for _, c in want}) == 5
    parts = Counter()
    for chrom, ps in {k[:2] for k in codes}:
        mine = sorted(p for c, b, p in codes if (c, b) == (chrom, ps))
        every = sorted({r[2] for r in rows if r[0] == chrom and mine[0] < r[2] <= mine[-1]})
        number, low, high, total, phased = 0, mine[0], None, 0, 0
        for p in [*every, None]:
            code = codes.get((chrom, ps, p))
            if p is None or code in (1, 2, 3):
                if phased:
                    parts[chrom, ps, number, total, phased, high - low + 1, round((high - low + 1) * phased / total, 4)] += 1
                number, low, high, total, phased = number + 1, p, None, 0, 0
            else:
                total += 1
                if code is not None:
                    phased, high = phased + 1, p
    found = QUERIES["K17_blocks_between_errors"](spark, SF).select("chrom", "ps", "part", "total", "phased", "length", "adjusted").collect()
    assert Counter(map(tuple, found)) == parts and len(parts) > 20


def test_cigar_indels_against_a_loop(spark):
    r = random.Random(17)
    rows = []
    for i in range(300):
        inner = [(r.choice("MIDX="), r.choice([1, 7, 29, 30, 31, 80])) for _ in range(r.randint(1, 9))]
        ends = [[("S", r.randint(1, 40))], [("H", 5), ("S", 3)], []]
        rows.append((i, r.randint(0, 500), [*r.choice(ends), *inner, *r.choice(ends)]))
    for step in (0, 1):
        want = Counter()
        for i, start, ops in rows:
            ref, read, more = start, 0, 0
            for op, n in ops:
                if op == "I" and n >= 30:
                    more += step
                    want[i, "INS", ref + more, read, n] += 1
                if op == "D" and n >= 30:
                    want[i, "DEL", ref, read, n] += 1
                ref += n if op in "MDX=" else 0
                read += n if op in "MISX=" else 0
        df = spark.createDataFrame([(i, s, "".join(f"{n}{o}" for o, n in ops)) for i, s, ops in rows], "aid long, ref_start long, text string")
        found = S.cigar_indels(df.withColumn("cigar", S.parse_cigar("text")), "aid", "ref_start", "cigar", 30, step=step)
        assert Counter(map(tuple, found.select("aid", "svtype", "ref_pos", "q_pos", "len").collect())) == want


def test_fastq_with_quality_lines_that_start_with_an_at_sign(spark, tmp_path):
    r = random.Random(3)
    want, text = [], ""
    for i in range(3000):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(1, 90)))
        qual = r.choice("@I+") + "".join(r.choice("@IF+#") for _ in seq[1:])
        want.append((f"r{i}", seq, qual))
        text += f"@r{i} lane\n{seq}\n+\n{qual}\n"
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq").write_text("@only\nAC\n+\n@@\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # records cross the borders of splits
    try:
        found = T.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, found)) == sorted([*want, ("only", "AC", "@@")])


@pytest.mark.parametrize("text", ["@r1\nAC\n+\n", "@r1\nAC\n+\nII\n@r2\nA\n"])
def test_fastq_with_a_broken_record_is_refused(spark, tmp_path, text):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match="FASTQ"):
        T.read_fastq(spark, str(tmp_path)).collect()


EVENTS = "q long, at int, svtype string, form string, chrom string, start long, chrom2 string, end long, size long"


def test_tandem_runs_against_a_loop(spark):
    r = random.Random(12)
    rows, want = [], Counter()
    for q in range(200):
        runs, s = [], 1000
        for at in range(r.randint(1, 7)):
            s += r.choice([0, 3, 8, 19, 500])
            x = (s, s + 300 + r.choice([0, 5, 12, 25]), r.choice(["fwd", "fwd", "rev"]), r.random() < 0.3, r.choice(["c1", "c1", "c1", "c2"]))
            rows.append((q, at, "DUP", x[2] + "+" * x[3], x[4], x[0], x[4], x[1], 300))
            if runs:
                last = runs[-1]
                n = len(last)
                if last[0][4] == x[4] and last[0][2] == x[2] and abs(sum(y[0] for y in last) / n - x[0]) < 20 and abs(sum(y[1] for y in last) / n - x[1]) < 20:
                    last.append(x)
                    continue
            runs.append([x])
        want.update((q, v[0][4], mean(v, 0), mean(v, 1), len(v), any(y[3] for y in v)) for v in runs)
    rows.append((999, 1, "DEL", "", "c1", 5, "c1", 9, 4))
    found = V.tandem_runs(spark.createDataFrame(rows, EVENTS), "q").select("q", "chrom", "start", "end", "copies", "covered").collect()
    assert Counter(map(tuple, found)) == want and any(k[4] > 2 for k in want)


def test_paired_inversions_against_a_loop(spark):
    r = random.Random(13)
    rows, want = [], Counter()
    for q in range(200):
        mine = []
        for at in range(r.randint(1, 6)):
            s = r.choice([100, 110, 300])
            x = (at, r.random() < 0.5, r.choice(["c1", "c1", "c2"]), s, s + r.choice([90, 100, 110, 400]))
            mine.append(x)
            rows.append((q, at, "INV", ("left_" if x[1] else "right_") + "fwd", x[2], x[3], x[2], x[4], 0))
        free = {x[0]: x for x in mine}

        def far(a, b):
            common = min(a[4], b[4]) - max(a[3], b[3])
            return 1 - common / max(a[4] - a[3], b[4] - b[3]) if common > 0 else 1.0

        for d, i, j in sorted((far(a, b), a[0], b[0]) for a in mine for b in mine if a[1] and not b[1] and a[2] == b[2]):
            if d <= 0.3 and i in free and j in free:
                a, b = free.pop(i), free.pop(j)
                want[q, a[2], max(a[3], b[3]), min(a[4], b[4]), True] += 1
        want.update((q, x[2], x[3], x[4], False) for x in free.values())
    found = V.paired_inversions(spark.createDataFrame(rows, EVENTS), "q").select("q", "chrom", "start", "end", "complete").collect()
    assert Counter(map(tuple, found)) == want and sum(v for k, v in want.items() if k[4]) > 50
