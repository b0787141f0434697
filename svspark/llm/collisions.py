"""Approximate nearest neighbours by counting collisions on single projections.

Each random projection gives a block of vectors a sorted array. A query opens a window around its own
value in every array and widens all of them from radius to radius (virtual rehashing: arrays are never
built anew, only the entries that a wider window adds are read). A vector that lies in the windows of
enough projections collides, and is verified by its distance in double precision. A block is done when
it has enough neighbours within the radius, or when the radius comes to a distance within which
a sample of all rows has enough.

A window is the radius to either side, so a vector at distance r lies in it with probability 0.68 at
radius r, and in 55 % of 64 windows with probability 0.98; at half the radius that is nearly certain,
at twice the radius 0.4 %.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import meet, numbered, parts, usable

#: Radii below the greatest one, each this much smaller than the next; the same where no sample gives the greatest.
RADII, STEP, BLIND_RADII, BLIND_STEP = 8, 1.2, 12, 2.0


@functools.cache
def directions(dim: int, projections: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled by a power of two, which is exact, where squares would leave the doubles."""
    with np.errstate(over="ignore"):
        apart = rows - query
    if not np.isfinite(apart).all():
        return 2 * distances(rows / 2, query / 2)
    most = np.abs(apart).max(initial=0)
    if not most or 1e-140 < most < 1e140:
        return np.sqrt((apart * apart).sum(axis=1))
    power = int(np.frexp(most)[1])
    return np.ldexp(np.sqrt((np.ldexp(apart, -power) ** 2).sum(axis=1)), power)


def nearest(ids: np.ndarray, apart: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest distances, in order, ties by smaller id."""
    some = np.arange(len(apart))
    if len(apart) > k:
        some = np.flatnonzero(apart <= np.partition(apart, k - 1)[k - 1])
    return some[np.lexsort((ids[some], apart[some]))[:k]]


class SortedProjections:
    """A block of vectors with one sorted array a projection."""

    def __init__(self, vectors: np.ndarray, projections: int):
        self.vectors, self.turn = vectors, directions(vectors.shape[1], projections)
        values = vectors @ self.turn
        order = np.argsort(values, axis=0, kind="stable")
        self.order, self.values = order.T.astype(np.int32), np.take_along_axis(values, order, axis=0).T.copy()

    def radii(self, asked: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The radii of each query; where ``reach`` is infinite the last one takes in the whole block."""
        span = np.maximum(self.values[:, -1] - asked, asked - self.values[:, 0]).max(axis=1)
        known = reach[:, None] * STEP ** -np.arange(RADII, -1, -1.0)
        blind = span[:, None] * BLIND_STEP ** -np.arange(BLIND_RADII, -1, -1.0)
        first = np.repeat(known[:, :1], BLIND_RADII - RADII, axis=1)
        return np.where(np.isinf(reach)[:, None], blind, np.hstack([first, known]))

    def search(self, queries: np.ndarray, reach: np.ndarray, own: list[np.ndarray], k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query: vectors that were verified, their distances, and how many entries were read.

        ``own``: the places of vectors that are no candidates of a query.
        """
        n, m = len(self.vectors), len(self.values)
        need = int(np.ceil(share * m))
        asked = queries @ self.turn
        radii = self.radii(asked, reach)
        # equal vectors may differ in the last digits of a projection
        half = radii + 1e-9 * (np.abs(asked).max(axis=1) + np.abs(self.values[:, [0, -1]]).max())[:, None]
        low, high = (np.empty((m, *radii.shape), dtype=np.int64) for _ in range(2))
        for j, values in enumerate(self.values):
            low[j] = np.searchsorted(values, asked[:, j, None] - half, side="left")
            high[j] = np.searchsorted(values, asked[:, j, None] + half, side="right")
        for q, query in enumerate(queries):
            counts, read = np.zeros(n, dtype=np.int64), 0
            can = np.ones(n, dtype=bool)
            can[own[q]] = False
            rows, apart = np.empty(0, dtype=np.int64), np.empty(0)
            left = right = None
            for level, radius in enumerate(radii[q]):
                a, b = low[:, q, level], high[:, q, level]
                if left is None:
                    new = [self.order[j, a[j] : b[j]] for j in range(m)]
                else:
                    new = [x for j in range(m) for x in (self.order[j, a[j] : left[j]], self.order[j, right[j] : b[j]])]
                left, right = a, b
                entries = np.concatenate(new)
                if len(entries):
                    read += len(entries)
                    counts += np.bincount(entries, minlength=n)
                    found = np.flatnonzero(can & (counts >= need))
                    can[found] = False
                    rows = np.concatenate([rows, found])
                    apart = np.concatenate([apart, distances(self.vectors[found], query)])
                if len(apart) >= k and np.partition(apart, k - 1)[k - 1] <= radius:
                    break
            yield rows, apart, read


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64, copy=False)


def neighbours(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    projections: int = 64,
    share: float = 0.55,
    sample_rows: int = 2048,
    id: str = "vec_id",
    embedding: str = "embedding",
    block: int = 8192,
    query_block: int = 512,
) -> DataFrame:
    """Each query's ``k`` nearest rows found by Euclidean distance: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows but those
    with the query's own id, of the same length. Nearest first, ties to the smaller id; fewer candidates
    give all. score is the distance of the given vectors in doubles. Rows with null ids and vectors
    that are null, empty, zero or hold null or non-finite components take no part. Rows that repeat
    an id are candidates each and queries each. Extra columns aren't read; an empty table gives no rows.

    Every row is indexed in a block with ``projections`` sorted arrays, and verified where it collides in
    at least ``share`` of them. The greatest radius of a query is the distance of its k-th nearest of
    ``sample_rows`` rows (those with the least hashes; a bound for the k-th nearest of all, and whatever
    the sample gives is in the result too); a query without k of them looks through whole blocks.
    """
    rows = numbered(
        vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & usable("v", zero=False))
        .select("vec_id", F.size("v").alias("dim"), "v"),
        "vectors",
    )
    queries = rows.where(F.col("vec_id") % query_every == 0)
    n, m = rows.count(), queries.count()
    known: dict[int, tuple[np.ndarray, ...]] = {}
    # a share of twice the sample by hash, so that tasks send few rows for the least hashes
    by_hash = rows.withColumn("hash", F.xxhash64("vec_id", "v"))
    if n > 4 * sample_rows:
        by_hash = by_hash.where(F.pmod("hash", F.lit(1 << 40)) < int((1 << 40) * 2 * sample_rows / n)).withColumn("hash", F.pmod("hash", F.lit(1 << 40)))
    some = by_hash.orderBy("hash", "row").limit(sample_rows).toPandas()
    for dim, own in some.groupby("dim"):
        known[int(dim)] = own["row"].to_numpy(), own["vec_id"].to_numpy(), _matrix(own["v"])
    kinds = "row long, vec_id long, dim int, v array<double>, reach double, near array<long>, ids array<long>, apart array<double>"

    def reaches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reach, near, names, far = [], [], [], []
            for own, dim, v in zip(batch["vec_id"], batch["dim"], batch["v"], strict=True):
                numbers, ids, sample = known.get(dim, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim))))
                apart = distances(sample, np.asarray(v))
                best = np.flatnonzero(ids != own)
                best = best[nearest(ids[best], apart[best], k)]
                reach.append(apart[best[-1]] if len(best) == k else np.inf)
                for out, x in ((near, numbers), (names, ids), (far, apart)):
                    out.append(x[best])
            yield batch.assign(reach=reach, near=near, ids=names, apart=far)[[x.split()[0] for x in kinds.split(", ")]]

    asked = cut(queries.select("row", "vec_id", "dim", "v").mapInPandas(reaches, kinds), "queries")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, out = ["query", "query_id", "row", "vec_id", "score"], []
        if len(left) and len(right):
            index = SortedProjections(_matrix(left.pop("v")), projections)
            numbers, ids = left["row"].to_numpy(), left["vec_id"].to_numpy()
            own = [np.flatnonzero(ids == x) for x in right["vec_id"]]
            search = index.search(_matrix(right.pop("v")), right["reach"].to_numpy(), own, k, share)
            for q, q_id, (found, apart, _) in zip(right["row"], right["vec_id"], search, strict=True):
                best = nearest(ids[found], apart, k)
                rows = found[best]
                out.append((np.full(len(best), q), np.full(len(best), q_id), numbers[rows], ids[rows], apart[best]))
        if not out:
            return pd.DataFrame({x: np.empty(0, np.float64 if x == "score" else np.int64) for x in names})
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = meet(
        rows.select("dim", "row", "vec_id", "v"), asked.select("dim", "row", "vec_id", "v", "reach"), ["dim"],
        parts(n, block), parts(m, query_block), run, "query long, query_id long, row long, vec_id long, score double",
    )
    sampled = asked.select(
        F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("near", "ids", "apart")).alias("e")
    ).select("query", "query_id", F.col("e.near").alias("row"), F.col("e.ids").alias("vec_id"), F.col("e.apart").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    best = found.unionByName(sampled).groupBy("query", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
