"""Hard negatives of anchors by exact integer inner products.

Scores of a tile of anchors and candidates come from Strassen's recursive multiplication on 64-bit
integers. It only adds, subtracts and multiplies, so an intermediate that wraps around does no harm
as long as the scores themselves fit; tiles whose scores might not are done in Python's integers.
Scores go strip by strip into bounded heaps: one of positives for each anchor, then one for each
window of scores that a positive opens. Heaps of tiles are merged by Spark.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import floored, meet, numbered, parts, usable

LONG = np.iinfo(np.int64)
#: Sides up to this are multiplied plainly; candidates of a tile at a time.
LEAF, STRIP = 32, 2048


def _even(x: np.ndarray) -> np.ndarray:
    """``x`` with a row or column of zeros more where its number of them is odd."""
    if not any(n % 2 for n in x.shape):
        return x
    out = np.zeros([n + n % 2 for n in x.shape], dtype=x.dtype)
    out[: len(x), : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for integer matrices by seven products of half the size at each level."""
    (rows, inner), columns = a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b if a.dtype == object else np.einsum("ij,jk->ik", a, b)
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    out = np.empty((2 * i, 2 * k), dtype=a.dtype)
    c11, c12, c21, c22 = out[:i, :k], out[:i, k:], out[i:, :k], out[i:, k:]
    # each product is added where it counts and then let go
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two tiles, exact whatever the components' size; one beyond a long is the nearest long."""
    most = [int(max(-int(x.min()), int(x.max()))) if x.size else 0 for x in (anchors, candidates)]
    if most[0] * most[1] * anchors.shape[1] <= LONG.max:
        return strassen(anchors, candidates.T)
    return np.clip(strassen(anchors.astype(object), candidates.astype(object).T), -LONG.max, LONG.max).astype(np.int64)


class Best:
    """A bounded heap of the ``k`` highest scores, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, found: np.ndarray, ids: np.ndarray) -> None:
        if len(self.heap) == self.k:
            mine = found >= self.heap[0][0]
            found, ids = found[mine], ids[mine]
        if len(found) > 4 * self.k:
            mine = found >= np.partition(found, len(found) - self.k)[len(found) - self.k]
            found, ids = found[mine], ids[mine]
        if len(found) > 4 * self.k:  # many ties
            some = heapq.nsmallest(self.k, zip((-found).tolist(), ids.tolist(), strict=True))
            found, ids = np.array([-s for s, _ in some], dtype=found.dtype), np.array([i for _, i in some])
        for s, i in zip(found.tolist(), ids.tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i))
            elif (s, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i))

    def rows(self) -> list[tuple[int, int]]:
        """(score, id), the best first."""
        return [(s, -i) for s, i in sorted(self.heap, reverse=True)]


def window(positive: int) -> tuple[int, int]:
    """The least and the greatest n with 50 p <= 100 n <= 95 p, without products that could pass a long."""
    return -(-positive // 2), positive - -(-positive // 20)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64, copy=False)


def _table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)), strict=True)) if rows else {n: np.empty(0, np.int64) for n in names})


def mine(
    vectors: DataFrame,
    label: str | Column = "label",
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    scale: float = 256.0,
    id: str = "vec_id",
    embedding: str = "embedding",
    block: int = 8192,
    anchor_block: int = 256,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x), at most a long's greatest; a row's score is its integer
    inner product with the anchor. Anchors are the rows whose id is divisible by ``anchor_every``. An
    anchor's positives are the ``positives`` best other rows of its label; for each, the ``negatives``
    best rows of other labels with a score from 50 % to 95 % of the positive's are returned, ranked from
    1. Ties go to the smaller id; fewer candidates give all of them, and none give no row.

    Rows with a null id, label or vector, an empty vector, or null or non-finite components take no
    part; vectors of another length than the anchor's are no candidates. Rows that repeat an id are
    candidates each and anchors each, and none of them is a candidate of an anchor with their id.
    Scores are exact; one beyond a long counts as the greatest long or its negative throughout. Extra columns aren't read; an empty table gives no rows.

    Positives are looked for among rows of the anchor's label, negatives among all, in blocks, so that
    a label with a third of all rows is dealt to many tasks. A task returns at most ``positives`` rows an
    anchor, or ``negatives`` a window.
    """
    rows = numbered(
        vectors.select(
            F.col(id).cast("long").alias("vec_id"),
            (F.col(label) if isinstance(label, str) else label).alias("given"),
            F.col(embedding).cast("array<double>").alias("v"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("given").isNotNull() & usable("v"))
        .select("vec_id", F.xxhash64("given").alias("lab"), F.size("v").alias("dim"), floored("v", scale).alias("v")),
        "vectors",
    )
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    of_label = lambda x: x.groupBy("dim", "lab").count().agg(F.sum("count"), F.max("count")).first()
    (n, most), (m, most_anchors) = of_label(rows), of_label(anchors)
    if not n or not m:
        most = most_anchors = n = m = 1

    def best_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            ids, values, asked = left["vec_id"].to_numpy(), _matrix(left.pop("v")), _matrix(right.pop("v"))
            heaps = [Best(positives) for _ in range(len(right))]
            for at in range(0, len(ids), STRIP):
                own, tile = ids[at : at + STRIP], scores(asked, values[at : at + STRIP])
                for heap, found, anchor in zip(heaps, tile, right["vec_id"], strict=True):
                    other = own != anchor
                    heap.offer(found[other], own[other])
            out = [(r, a, i, s) for r, a, heap in zip(right["row"], right["vec_id"], heaps, strict=True) for s, i in heap.rows()]
        return _table(out, ["row", "anchor_id", "positive_id", "score"])

    near = meet(
        rows.select("dim", "lab", "row", "vec_id", "v"), anchors.select("dim", "lab", "row", "vec_id", "v"), ["dim", "lab"],
        parts(most, block), parts(most_anchors, anchor_block), best_positives, "row long, anchor_id long, positive_id long, score long",
    )
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "positive_id"))
    near = cut(near.select("*", place.alias("place")).where(F.col("place") <= positives), "positives")
    windows = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("near"))
    asked = cut(
        anchors.join(windows, "row").select(
            "dim", "lab", "row", "vec_id", "v", F.col("near.place").alias("places"), F.col("near.positive_id").alias("near"), F.col("near.score").alias("near_scores")
        ),
        "windows",
    )

    def best_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            ids, labels, values = left["vec_id"].to_numpy(), left["lab"].to_numpy(), _matrix(left.pop("v"))
            query = _matrix(right.pop("v"))
            heaps = [[Best(negatives) for _ in near] for near in right["near"]]
            bounds = [[window(int(s)) for s in near] for near in right["near_scores"]]
            for at in range(0, len(ids), STRIP):
                own, kinds, tile = ids[at : at + STRIP], labels[at : at + STRIP], scores(query, values[at : at + STRIP])
                for heap, bound, found, lab, anchor in zip(heaps, bounds, tile, right["lab"], right["vec_id"], strict=True):
                    low, high = min(x for x, _ in bound), max(x for _, x in bound)
                    some = np.flatnonzero((found >= low) & (found <= high) & (kinds != lab) & (own != anchor))
                    reach, names = found[some], own[some]
                    for one, (low, high) in zip(heap, bound, strict=True):
                        within = (reach >= low) & (reach <= high)
                        one.offer(reach[within], names[within])
            for r, a, places, near, near_scores, heap in zip(right["row"], right["vec_id"], right["places"], right["near"], right["near_scores"], heaps, strict=True):
                for place, p, score, one in zip(places, near, near_scores, heap, strict=True):
                    out += [(r, place, a, p, i, score, s) for s, i in one.rows()]
        return _table(out, ["row", "place", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = meet(
        rows.select("dim", "lab", "row", "vec_id", "v"), asked, ["dim"], parts(n, block), parts(m, anchor_block), best_negatives,
        "row long, place long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    order = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
