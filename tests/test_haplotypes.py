"""Pairing of two haplotypes' candidates against plain loops."""

import random

import pytest

from svspark.operators import clustering as C
from svspark.operators import haplotypes as H
from svspark.plans import QUERIES, adapters
from svspark.plans.queries_haplotypes import breakends, candidates
from svspark.sources import reference

from .conftest import SF


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, text, n):
    text = list(text)
    for _ in range(n):
        at, what = r.randrange(len(text) + 1), r.choice("sid")
        if what == "i":
            text.insert(at, r.choice("ACGT"))
        elif text and at < len(text):
            text[at : at + 1] = [] if what == "d" else [r.choice("ACGT")]
    return "".join(text)


def test_edit_distance_with_an_early_end():
    r = random.Random(6)
    cases = [("", ""), ("", "ACG"), ("A", ""), ("ACGT", "ACGT"), ("AAAA", "TTTT"), ("ACGT" * 30, "ACGT" * 28), ("A" * 50, "A" * 45 + "C")]
    for _ in range(250):
        a = "".join(r.choice("ACGT" if r.random() < 0.7 else "AC") for _ in range(r.randint(0, 90)))
        cases.append((a, changed(r, a, r.randint(0, 25)) if r.random() < 0.7 else "".join(r.choice("ACGT") for _ in range(r.randint(0, 90)))))
    for a, b in cases:
        d = levenshtein(a, b)
        for most in (0, 3, 20, 200):
            assert H.edit_distance(a.encode(), b.encode(), most) == min(d, most + 1), (a, b, most)
            assert H.edit_distance(b.encode(), a.encode(), most) == min(d, most + 1)
    a = "".join(r.choice("ACGT") for _ in range(60_000))
    assert H.edit_distance(a.encode(), (a[:20_000] + "T" + a[20_000:50_000] + a[50_010:]).encode(), 200) in (10, 11)


def allele(c, ref, low, high):
    into = c["svtype"] in ("INS", "DUP_INT")
    s, e = c["start"], c["start"] if into else c["end"]
    mid = ref[c["chrom"]][s:e]
    put = {
        "DEL": "", "INV": mid[::-1].translate(str.maketrans("ACGT", "TGCA")), "DUP_TAN": mid * ((c["copies"] or 0) + 1),
        "INS": c["seq"] or "", "DUP_INT": ref[c["src_chrom"]][c["src_start"] : c["src_end"]] if c["src_chrom"] in ref else "",
    }[c["svtype"]]
    return ref[c["chrom"]][low:s] + put + ref[c["chrom"]][e:high]


def place(c):
    return c["start"] if c["svtype"] in ("INS", "DUP_INT") else (c["start"] + c["end"]) // 2


def plain_pairs(rows, ref, most, gap, flank=100):
    """Complete linkage with a distance without end inside a haplotype, chain by chain."""
    out, groups = [], {}
    for c in sorted(rows, key=lambda c: (c["svtype"], c["chrom"], place(c), c["hap"], c["cid"])):
        kind = c["svtype"], c["chrom"]
        chains = groups.setdefault(kind, [[]])
        if chains[-1] and place(c) - place(chains[-1][-1]) > gap:
            chains.append([])
        chains[-1].append(c)
    for (kind, chrom), chains in groups.items():
        for chain in chains:
            found = []
            for x in chain:
                for y in chain:
                    if x["hap"] == 1 and y["hap"] == 2 and chrom in ref:
                        into = kind in ("INS", "DUP_INT")
                        low = max(0, min(x["start"], y["start"]) - flank)
                        high = max(c["start"] if into else c["end"] for c in (x, y)) + flank
                        d = levenshtein(allele(x, ref, low, high), allele(y, ref, low, high))
                        if d <= most:
                            found.append((d, x["cid"], y["cid"]))
            met = {}
            for d, a, b in sorted(found):
                if a not in met and b not in met:
                    met[a], met[b] = (b, d), (a, d)
            done = set()
            for c in chain:
                if c["cid"] in met:
                    if c["cid"] not in done:
                        other, d = met[c["cid"]]
                        done |= {c["cid"], other}
                        out.append((c["cid"], other, "1/1", d))
                else:
                    out.append((c["cid"], None, "1/0" if c["hap"] == 1 else "0/1", None))
    return sorted(out, key=repr)


KINDS = "cid long, hap int, svtype string, chrom string, start long, end long, seq string, copies int, src_chrom string, src_start long, src_end long, a string, d int"


@pytest.mark.parametrize(("most", "gap", "block"), [(40, 1000, 64), (12, 60, 1 << 16)])
def test_haplotypes_against_a_plain_loop(spark, most, gap, block):
    r = random.Random(most)
    ref = {"chr1": "".join(r.choice("ACGT") for _ in range(1500)), "chr2": "CA" * 300}
    rows = []
    for i in range(120):
        chrom, kind = r.choice(["chr1", "chr2", "nowhere"] if i % 30 == 0 else ["chr1", "chr2"]), r.choice(["DEL", "INS", "INV", "DUP_TAN", "DUP_INT"])
        size, start = r.randint(1, 60), r.choice([5, 200, 230, 500, 520]) + r.randint(0, 20)
        rows.append((i, r.choice([1, 2]), kind, chrom, start, start + size, "".join(r.choice("ACGT") for _ in range(size)) if r.random() < 0.5 else "ACGTTGCA" * (size // 8 + 1), r.choice([1, 2, None]), r.choice(["chr1", "chr2"]), r.choice([700, 710]) % 590, 600, "x", 1))
    rows.append((900, 1, "INS", "chr1", 400, 400, None, None, None, None, None, "x", 1))
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    blocks = reference.blocks_of(spark.createDataFrame(list(ref.items()), "name string, seq string"), block=block)
    plain = df.drop("a", "d")
    found = H.pair_haplotypes(plain, blocks, most, gap, block=block).collect()
    named = [dict(zip(KINDS.replace(",", "").split()[::2], x, strict=True)) for x in rows]
    want = plain_pairs(named, ref, most, gap)
    assert sorted(((x["cid"], x["other"], x["gt"], x["d"]) for x in found), key=repr) == want
    assert sum(x[2] == "1/1" for x in want) >= 10 and len({x[2] for x in want}) == 3
    assert H.pair_haplotypes(plain.limit(0), blocks, block=block).count() == 0


def test_paired_haplotypes_query(spark):
    ref = {f"s{r['sid']}": r["seq"] for r in adapters.sequences(spark, SF).collect()}
    rows = [r.asDict() for r in candidates(spark, SF).collect()]
    chosen = {r["chrom"] for r in rows if r["cid"] % 11 == 0}  # plain loops over all of them take minutes
    want = plain_pairs([r for r in rows if r["chrom"] in chosen], ref, 200, 1000)
    found = [(x["cid"], x["other"], x["gt"], x["d"]) for x in QUERIES["A17_paired_haplotypes"](spark, SF).collect()]
    assert sum(2 if x[1] is not None else 1 for x in found) == len(rows)
    names = {r["cid"]: r["chrom"] for r in rows}
    assert sorted((x for x in found if names[x[0]] in chosen), key=repr) == want and any(x[3] for x in want if x[3])


def plain_breakends(rows, most):
    found = sorted(
        (abs(a["start"] - b["start"]) + abs(a["end"] - b["end"]), a["cid"], b["cid"])
        for a in rows for b in rows
        if a["hap"] == 1 and b["hap"] == 2 and all(a[c] == b[c] for c in ("chrom", "chrom2", "form")) and abs(a["start"] - b["start"]) + abs(a["end"] - b["end"]) <= most
    )
    met = {}
    for d, a, b in found:
        if a not in met and b not in met:
            met[a], met[b] = (b, d), (a, d)
    out, done = [], set()
    for c in sorted(rows, key=lambda c: (c["start"], c["hap"], c["cid"])):
        if c["cid"] in met and c["cid"] not in done:
            done |= {c["cid"], met[c["cid"]][0]}
            out.append((c["cid"], met[c["cid"]][0], "1/1", met[c["cid"]][1]))
        elif c["cid"] not in met:
            out.append((c["cid"], None, "1/0" if c["hap"] == 1 else "0/1", None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [900, 50])
def test_breakends_against_a_plain_loop(spark, most):
    r = random.Random(most)
    rows = [(i, r.choice([1, 2]), r.choice(["chr1", "chr2"]), r.randint(0, 6000), r.choice(["chr1", "chr3"]), r.randint(0, 3000), r.choice(["fwd_fwd", "fwd_rev"])) for i in range(400)]
    rows += [(1000 + i, i % 2 + 1, "chr5", 900 * i, "chr6", 10, "fwd_fwd") for i in range(12)]  # at the bar, over borders of bins
    df = spark.createDataFrame(rows, "cid long, hap int, chrom string, start long, chrom2 string, end long, form string").repartition(3)
    found = [(x["cid"], x["other"], x["gt"], x["d"]) for x in H.pair_breakends(df, most).collect()]
    named = [dict(zip(df.columns, x, strict=True)) for x in rows]
    assert sorted(found, key=repr) == plain_breakends(named, most) and any(x[2] == "1/1" for x in found)


def test_paired_breakends_query(spark):
    rows = [r.asDict() for r in breakends(spark, SF).collect()]
    found = [(x["cid"], x["other"], x["gt"], x["d"]) for x in QUERIES["A17_paired_breakends"](spark, SF).collect()]
    assert len({r["cid"] for r in rows}) == len(rows)
    assert sorted(found, key=repr) == plain_breakends(rows, 900)


def test_three_groups_of_deletions_give_three_clusters(spark):
    r = random.Random(8)
    rows = []
    for group, (centre, span) in enumerate([(100_000, 2000), (200_000, 2000), (100_000, 4000)]):
        rows += [("chr1", centre + r.randint(-100, 100), span + r.randint(-200, 200), group) for _ in range(10)]
    df = spark.createDataFrame(rows, "chrom string, pos long, svlen long, read int")
    clusters = {}
    for x in C.complete_linkage(df, ["chrom"], "pos", "svlen", 1000).collect():
        clusters.setdefault((x["_island"], x["cluster"]), []).append(x["read"])
    assert sorted(map(sorted, clusters.values())) == [[0] * 10, [1] * 10, [2] * 10]
