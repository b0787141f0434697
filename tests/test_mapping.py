"""Alignment beside a place, against plain loops and with planted copies."""

import random

import pytest
from pyspark.sql import functions as F

from svspark.operators import calls, mapping
from svspark.plans import adapters, queries_mapping
from svspark.sources import reference
from tests.conftest import SF

K, W = 7, 4
TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s.translate(TURN)[::-1]


def mixed(code):
    m = 2**64 - 1
    h = (code + 0x9E3779B97F4A7C15) & m
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
    return (h ^ h >> 31) >> 1


def plain_minimizers(s, k, w):
    """{(hash, place, forward)} window by window."""
    number = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
    each = []
    for i in range(len(s) - k + 1):
        x = s[i : i + k].upper()
        if set(x) <= set("ACGT"):
            a, b = number(x), number(turned(x))
            each.append((mixed(min(a, b)), i, a < b))
        else:
            each.append((2**63 - 1, i, None))
    size = min(w, len(each))
    picked = set()
    for j in range(len(each) - size + 1 if each else 0):
        least = min(each[j : j + size])[0]
        picked |= {e for e in each[j : j + size] if e[0] == least and e[2] is not None}
    return picked


def plain_chains(anchors, k, gap, least):
    """Chains over all earlier anchors, in plain arithmetic."""
    f, before = [k] * len(anchors), [-1] * len(anchors)
    for i, (r, q) in enumerate(anchors):
        for j in range(i):
            dr, dq = r - anchors[j][0], q - anchors[j][1]
            if 0 < dr <= gap and 0 < dq <= gap:
                lag = abs(dr - dq)
                value = f[j] + min(dr, dq, k) - lag // 4 - (lag > 0)
                if value > k and value >= f[i]:
                    f[i], before[i] = value, j
    used, out = set(), []
    for end in sorted(range(len(anchors)), key=lambda i: (-f[i], i)):
        i, walk = end, []
        while i >= 0 and i not in used and end not in used:
            walk.append(i)
            i = before[i]
        used |= set(walk)
        if walk and f[end] - (f[i] if i >= 0 else 0) >= least:
            (r1, q1), (r2, q2) = anchors[walk[-1]], anchors[end]
            out.append((r1, r2 + k, q1, q2 + k, len(walk), f[end] - (f[i] if i >= 0 else 0)))
    return out


def plain_extension(ours, theirs, drop=30):
    score = best = at = 0
    for i, (a, b) in enumerate(zip(ours, theirs), 1):
        score += 1 if a == b and a in "ACGT" else -2
        if best - score > drop:
            break
        if score > best:
            best, at = score, i
    return at


def plain_alignments(insertions, sequences, k, w, crowded, width, gap, least, similarity=0.7, shift=300):
    def thinned(rows):
        groups = {}
        for key, h, at, forward in rows:
            groups.setdefault((key, h, forward), []).append(at)
        return [(*g, at) for g, p in groups.items() for at in (sorted(p) if len(p) <= crowded else [min(p), max(p)])]

    out = []
    for cid, chrom, pos, seq in insertions:
        if chrom not in sequences or pos is None or seq is None:
            continue
        n, far = len(seq), shift + -int(-len(seq) / similarity // 1)
        low, high = max(0, pos - far), pos + far
        ours = thinned((None, h, at, fw) for h, at, fw in plain_minimizers(seq, k, w))
        there = thinned((at // width, h, at, fw) for h, at, fw in plain_minimizers(sequences[chrom], k, w))
        for strand in "+-":
            anchors = sorted(
                (r, q if strand == "+" else n - k - q) for _, h, fw, q in ours for _, g, gw, r in there
                if h == g and (fw == gw) == (strand == "+") and low <= r and r + k <= high
            )
            for r1, r2, q1, q2, m, score in plain_chains(anchors, k, gap, least):
                text, ref = seq.upper() if strand == "+" else turned(seq.upper()), sequences[chrom].upper()
                start, end = r1 - plain_extension(text[:q1][::-1], ref[low:r1][::-1]), r2 + plain_extension(text[q2:], ref[r2:high])
                out.append((cid, start, end, strand, m, score))
    return sorted(out)


def test_minimizers_window_by_window():
    rng = random.Random(1)
    for n in (0, 3, 7, 9, 10, 11, 40, 500):
        for letters in ("ACGT", "ACGTN", "A", "AC"):
            text = "".join(rng.choice(letters) for _ in range(n))
            at, hashes, forward = mapping.sequence_minimizers(text, K, W)
            assert set(zip(hashes.tolist(), at.tolist(), forward.tolist(), strict=True)) == plain_minimizers(text, K, W)


def test_alignments_against_plain_loops(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = word(11)
    sequences = {"a": word(400) + unit * 30 + word(500), "b": word(900).lower(), "runs": "A" * 300 + word(100) + "AC" * 150, "short": word(20), "empty": ""}
    rows = []
    for i in range(40):
        chrom = ["a", "b", "runs"][i % 3]
        at, n = rng.randrange(600), rng.randrange(30, 160)
        part = list(sequences[chrom][at : at + n].upper())
        for _ in range(i % 5):  # substitutions, lost and new bases
            if len(part) > 20:
                p = rng.randrange(len(part))
                part[p : p + rng.randrange(2)] = rng.choice(["", "A", "CG"])
        text = "".join(part)
        rows.append((i, chrom, at + n + rng.randrange(-20, 60), turned(text) if i % 4 == 1 else text))
    rows += [(100, "a", 600, unit * 12), (101, "short", 5, sequences["short"]), (102, "a", None, "ACGT" * 9), (103, None, 4, "ACGT" * 9), (104, "a", 4, None), (105, "a", 4, ""), (106, "empty", 0, "ACGT" * 9), (107, "no", 0, "ACGT" * 9), (108, "a", 4, "N" * 50)]
    settings = {"k": K, "w": W, "crowded": 3, "width": 128, "gap": 60, "least": 14}
    df = spark.createDataFrame(rows, "cid long, chrom string, pos long, seq string").withColumn("hash", F.lit("clash"))
    blocks = reference.blocks_of(spark.createDataFrame(list(sequences.items()), "name string, seq string"), block=50)
    found = mapping.align_beside(df, blocks, 50, look_back=10_000, **settings).collect()
    got = sorted((r["cid"], r["k_start"], r["k_end"], r["strand"], r["anchors"], r["score"]) for r in found)
    want = plain_alignments(rows, sequences, **settings)
    assert len(want) > 60 and {"+", "-"} == {w[3] for w in want}
    assert got == want
    assert mapping.align_beside(df.limit(0), blocks, 50, **settings).count() == 0
    with pytest.raises(ValueError):
        mapping.align_beside(df, blocks, 50, k=8)


def test_planted_copies_are_recovered(spark):
    """Exact, turned and changed copies beside their site come back at their places; foreign sequences and copies elsewhere don't."""
    rng = random.Random(9)
    whole = "".join(rng.choice("ACGT") for _ in range(60_000))
    rows, want = [], {}
    for i in range(30):
        at, n = 1000 + 1900 * i, 200 + 37 * i
        part = whole[at : at + n]
        if i % 5 == 1:
            part = turned(part)
        elif i % 5 == 2:
            part = "".join(rng.choice("ACGT") if rng.random() < 0.05 else c for c in part)
        elif i % 5 == 3:
            part = "".join(rng.choice("ACGT") for _ in range(n))
        pos = at + n + i if i % 5 != 4 else at + n + 2000
        rows.append((i, "c", pos, part))
        if i % 5 < 3:
            want[i] = (at, at + n)
    df = spark.createDataFrame(rows, "cid long, chrom string, pos long, seq string")
    blocks = reference.blocks_of(spark.createDataFrame([("c", whole)], "name string, seq string"), block=4096)
    found = {r["cid"]: (r["k_start"], r["k_end"]) for r in calls.recovered_duplications(mapping.align_beside(df, blocks, 4096)).collect()}
    assert set(found) == set(want)
    assert all(found[i] == want[i] for i in want if i % 5 != 2)
    assert all(abs(found[i][0] - want[i][0]) <= 25 and abs(found[i][1] - want[i][1]) <= 25 for i in want)


def test_query_finds_the_parts_that_are_there(spark):
    found = {r["cid"]: r for r in queries_mapping.duplications_from_sequences(spark, SF).collect()}
    given = queries_mapping.placed_insertions(adapters.sequences(spark, SF)).select("cid", "pos", F.length("seq").alias("n")).collect()
    beside = [r for r in given if r["cid"] % 8 in (0, 1) and r["cid"] % 50 <= 0.3 * r["n"]]
    assert beside and all(r["cid"] in found for r in beside)
    assert not any(r["cid"] % 4 == 3 and r["n"] > 400 for r in given if r["cid"] in found)
