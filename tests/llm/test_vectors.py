"""Hard negatives, whitening and nearest neighbours against brute force and on messy tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from svspark.llm import collisions, negatives, whitening

KINDS = "vec_id long, embedding array<double>, label int, row long, v string, x int, n string, size long, whitened int"
BAD = [None, [None, *[1.0] * 7], [float("nan")] * 8, [float("inf")] * 8, []]


def messy(seed=5, n=320, dim=8):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = np.round(centres[i % 6] + r.standard_normal(dim) * 0.3, 2)
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(1000 + i, rows[5][1], 1) for i in range(120)]  # copies of one vector
    rows += [(2000 + i, b, 0) for i, b in enumerate(BAD)]
    rows += [(2010, [0.0] * dim, 0), (2011, [0.001] * dim, 1), (2012, [1.0, 2.0], 1), (2050, [3.0, 1.0], 0), (2013, [2.0, 2.5], 0)]
    rows += [(2020, rows[0][1], None), (None, rows[0][1], 0), rows[50], rows[7], (2100, rows[3][1], 7)]
    return [(*r, 1, "v", 2, "n", 3, 4) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


# 11 hard negatives


@pytest.mark.parametrize("shape", [(64, 64, 64), (33, 47, 129), (1, 64, 50), (70, 1, 70), (40, 65, 200)])
@pytest.mark.parametrize("leaf", [1, 8, 32])
def test_recursive_products_are_exact(shape, leaf):
    rows, inner, columns = shape
    r = np.random.default_rng(1)
    a, b = r.integers(-(10**6), 10**6, (rows, inner)), r.integers(-(10**6), 10**6, (inner, columns))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()
    big = negatives.strassen(a.astype(object) * 10**15, b.astype(object), leaf)
    assert (big == a.astype(object) * 10**15 @ b.astype(object)).all()


def test_scores_by_the_limit_of_a_long():
    a, b = np.array([[2**31, 2**31, -(2**31)]] * 40), np.array([[2**31, 2**31 - 1, 2**31]] * 40)
    assert (negatives.scores(a, b) == 2**62 - 2**31).all()
    assert (negatives.scores(a * 4, b * 4) == 2**63 - 1).all()
    assert (negatives.scores(a * 4, -b * 4) == 1 - 2**63).all()


@pytest.mark.parametrize("p", [*range(-45, 46), 2**63 - 1, -(2**63) + 1, 2**62 + 7])
def test_window_of_scores(p):
    low, high = negatives.window(p)
    assert low == math.ceil(Fraction(50 * p, 100)) and high == math.floor(Fraction(95 * p, 100))


def hard_negatives(rows, anchor_every, relabel=lambda i, x: x, kept=(5, 3)):
    rows = [(i, [min(2**63 - 1, math.floor(256 * x)) for x in v], relabel(i, lab)) for i, v, lab, *_ in rows if i is not None and lab is not None and good(v)]
    out, clip = [], lambda s: max(1 - 2**63, min(2**63 - 1, s))
    for a, v, lab in rows:
        if a % anchor_every:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w))), i, k) for i, w, k in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == lab][: kept[0]]:
            ok = [(t, i) for t, i, k in scored if k != lab and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(ok[: kept[1]], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "anchor_block"), [(8192, 256), (40, 3)])
def test_hard_negatives_against_all_scores(spark, block, anchor_block, monkeypatch):
    monkeypatch.setattr(negatives, "STRIP", 16 if block == 40 else 2048)
    rows = messy()
    found = negatives.mine(frame(spark, rows), anchor_every=50, block=block, anchor_block=anchor_block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()))
    assert got == hard_negatives(rows, 50) and len(got) > 100
    assert {2050, 50, 100} <= {r[0] for r in got}
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), label, anchor_every=30, positives=2, negatives=7).collect()))
    assert got == hard_negatives(rows, 30, lambda i, x: (x + 1) % 10 if i % 7 == 0 else x, (2, 7))


def test_hard_negatives_of_large_components_and_of_none(spark):
    rows = [(i * 25, [1e15 * (i % 4 - 1), 2e15, float(i)], i % 2, 1, "v", 2, "n", 3, 4) for i in range(12)]
    assert sorted(map(tuple, negatives.mine(frame(spark, rows)).collect())) == hard_negatives(rows, 50)
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [r for r in messy() if (r[0] or 1) % 50])).count() == 0


def test_heaps_merge_to_the_best_of_all():
    r = np.random.default_rng(2)
    for _ in range(50):
        s, ids = r.integers(-3, 3, 300), np.arange(300)
        heap, parts = negatives.Best(7), []
        for at in range(0, 300, 60):
            own = negatives.Best(7)
            own.offer(s[at : at + 60], ids[at : at + 60])
            heap.offer(s[at : at + 60], ids[at : at + 60])
            parts += own.rows()
        want = sorted(zip(-s, ids))[:7]
        assert [(-x, i) for x, i in heap.rows()] == want == [(-x, i) for x, i in sorted(parts, key=lambda p: (-p[0], p[1]))[:7]]


# 12 whitening


def whitened(rows, counts, k=4):
    """(id, dim) -> deviation, whitened up to sign, and by length n, explained."""
    rows = [(i, tuple(math.floor(256 * c) for c in v)) for i, v, *_ in rows if good(v)]
    out, fits = {}, {}
    for dim in {len(x) for _, x in rows}:
        mine = [r for r in rows if len(r[1]) == dim]
        fit = [x for _, x in mine] if counts else sorted({x for _, x in mine})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in fit])
        e, v = np.linalg.eigh(z.T @ z / n)
        e, v = e[::-1][:k], v[:, ::-1][:, :k]
        v, e, trace = v[:, e > 1e-9], e[e > 1e-9], (z**2).sum() / n
        fits[dim] = n, e / trace
        for i, x in mine:
            y = [n * c - t for c, t in zip(x, s)]
            out.setdefault((i, dim), []).append((sum(c * c for c in y), np.array([c / n for c in y]) @ v / np.sqrt(e)))
    return out, fits


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_against_numpy(spark, weights):
    rows = messy()
    found = whitening.whiten(frame(spark, rows), weights=weights)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.toPandas()
    want, fits = whitened(rows, weights == "count")
    large = got[got.groupby("n").n.transform("size") > 20]
    n, explained = fits[8]
    assert set(large.n) == {n} and len(large) == 4 * sum(1 for r in rows if good(r[1]) and len(r[1]) == 8)
    assert got.identity_error.max() < 1e-9 and got.groupby("n").identity_error.nunique().max() == 1
    for c, part in large.groupby("component"):
        assert np.allclose(part.explained, explained[c - 1], rtol=1e-10)
        have = {i: (d, w) for i, d, w in zip(part.vec_id, part.deviation, part.whitened)}
        keys = [i for i in have if not np.isnan(i)]
        w = np.array([want[i, 8][0][1][c - 1] for i in keys])
        h = np.array([have[i][1] for i in keys])
        assert np.allclose(h, w, atol=1e-8) or np.allclose(h, -w, atol=1e-8)
        assert all(have[i][0] == want[i, 8][0][0] for i in keys)
    two = got[got.n == fits[2][0]]
    assert sorted(set(two.component)) == [1, 2] and len(two) == 6
    assert got.vec_id.isna().sum() == 4  # the row without an id stays


def test_whitening_of_what_does_not_vary_and_of_nothing(spark):
    one = [(i, [0.5, 1.5, -2.0], 0, 1, "v", 2, "n", 3, 4) for i in range(5)]
    assert whitening.whiten(frame(spark, one)).count() == 0
    flat = [(i, [float(i % 3), 7.0, 2.0 * (i % 3)], 0, 1, "v", 2, "n", 3, 4) for i in range(9)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert len(got) == 9 and {(r.component, r.n) for r in got} == {(1, 3)} and abs(got[0].explained - 1) < 1e-12
    assert whitening.whiten(frame(spark, [])).count() == 0


def test_whitening_of_large_numbers_is_exact(spark):
    big = [(i, [float(2**40 * i), float(i * i), 3.0 - i], 0, 1, "v", 2, "n", 3, 4) for i in range(40)]
    got = whitening.whiten(frame(spark, big), components=1).toPandas()
    want, _ = whitened(big, False)
    assert all(min(2**63 - 1, want[i, 3][0][0]) == d for i, d in zip(got.vec_id, got.deviation))
    y = np.array([[2**32 - 3, 5], [3037000499, 3037000500 % 7], [2**31, 2**31], [-(2**31), 2**31]])
    assert whitening.deviations(y).tolist() == [min(2**63 - 1, sum(int(c) ** 2 for c in r)) for r in y] == whitening.deviations(y.astype(object)).tolist()


# 13 nearest neighbours


def all_neighbours(rows, every, k):
    rows = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if i is not None and good(v) and any(v)]
    out = {}
    for q, v in rows:
        if q % every == 0:
            best = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out.setdefault(q, []).append(best)
    return out


def recall(got, want):
    hits = total = 0
    for q, lists in want.items():
        mine = [(r.score, r.vec_id) for r in got if r.query_id == q]
        assert len(mine) == sum(map(len, lists))
        for best in lists:
            total += len(best)
            hits += sum(any(i == j for _, j in mine) for _, i in best)
    return hits / total


@pytest.mark.parametrize(("block", "sample"), [(8192, 2048), (60, 100), (60, 5)])
def test_neighbours_against_all_distances(spark, block, sample):
    rows = messy()
    got = collisions.neighbours(frame(spark, rows), k=5, query_every=25, block=block, query_block=7, sample_rows=sample).collect()
    want = all_neighbours(rows, 25, 5)
    assert recall(got, want) >= (1 if sample != 100 else 0.95)
    vectors = {r[0]: r[1] for r in rows if good(r[1])}
    for q in want:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        if len(want[q]) == 1:
            assert [x[0] for x in mine] == list(range(1, len(mine) + 1)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        assert all(i != q and abs(s - math.dist(vectors[q], vectors[i])) < 1e-12 for _, s, i in mine)
    assert collisions.neighbours(frame(spark, [])).count() == 0


def test_recall_in_64_dimensions_in_many_blocks(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((40, 64))
    v = centres[r.integers(0, 40, 6000)] * r.uniform(0.5, 1.5, (6000, 1)) + r.standard_normal((6000, 64)) * r.uniform(0.1, 1, (6000, 1))
    v[4000:4400] = v[0]  # copies of a query's vector: ties by id
    rows = [(i, x.tolist(), 0, 1, "v", 2, "n", 3, 4) for i, x in enumerate(v)]
    got = collisions.neighbours(frame(spark, rows), block=1000, sample_rows=500).collect()
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(6000), d))[:10]
        mine = [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)]
        assert len(mine) == 10
        hits += len(set(mine) & set(best.tolist()))
        if d[best[-1]] == 0:
            assert mine == best.tolist()
    assert hits / 600 >= 0.95, hits


def test_windows_widen_until_enough_collide():
    r = np.random.default_rng(3)
    v = r.standard_normal((3000, 16))
    v[0] = v[1] + 0.01
    index = collisions.SortedProjections(v, 64)
    own = [np.array([0])] * 2
    (near, apart, read), (rows, _, whole) = index.search(v[[0, 0]], np.array([0.2, np.inf]), own, 1, 0.55)
    assert 1 in near and len(near) < 300 and read < 64 * 3000 / 5
    assert (apart == np.sqrt(((v[near] - v[0]) ** 2).sum(axis=1))).all()
    everything = next(index.search(v[[0]], np.array([np.inf]), own[:1], 5000, 0.55))
    assert len(everything[0]) == 2999 and everything[2] == 64 * 3000 and 1 in rows and whole <= 64 * 3000


def test_distances_outside_the_squares_of_doubles():
    a = np.array([[3e200, 4e200], [1e308, 0.0], [0.0, 0.0]])
    assert np.allclose(collisions.distances(a, np.zeros(2)), [5e200, 1e308, 0], rtol=1e-15)
    assert np.allclose(collisions.distances(np.array([[3e-200, 4e-200]]), np.zeros(2)), 5e-200, rtol=1e-15)
    assert collisions.distances(np.array([[1.7e308]]), np.array([-1.7e308]))[0] == np.inf
