"""Exact top-k by inner product with sorted lists read in sequence only (no random access).

For each coordinate the vectors of a block are listed by its value; a query reads a list from the
top where its own coordinate is positive and from the bottom where it is negative, so that its
contributions fall. Reading goes down all lists together to one contribution, the halt. No entry that
is left contributes more, which bounds the score of every vector from above. The vectors with the
greatest bounds are read to the end; the k-th best of their scores is the bar. Then only vectors whose bound comes up
to the bar are read to the end, the others are never completed.

Blocks of vectors meet blocks of queries in a grid; a cell returns k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A halt is chosen among those at which about these shares of all entries are read, by so many places of each list.
HALTS, PLACES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 17
#: Vectors of the greatest bounds that set the bar. What an entry after the halt costs to look through, and to add up; one before it costs 1.
FIRST, LOOK, PICK = 256, 0.8, 3.0
NORMAL = NormalDist()
LONG = np.iinfo(np.int64)


class SortedLists:
    """A block of integer vectors as one list a coordinate, in ascending order: (vector, value).

    Only the lists are kept; nothing gives a vector's values by its number. Room for the entries
    that are read is kept too, for one reader at a time, as new memory for each query costs as much as the reading.
    """

    def __init__(self, values: np.ndarray):
        self.n, self.dim = values.shape
        values = values.T.copy()
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.doubles = self.values.astype(np.float64)
        self.rows, self.over, self.mask = (np.empty(values.size, dtype=x) for x in (self.order.dtype, np.float64, bool))
        self.largest = max(abs(int(self.values[:, 0].min())), abs(int(self.values[:, -1].max()))) if values.size else 0


class Reader:
    """One query's way down the lists of a block.

    ``sum`` has for every vector by how much the entries read exceed the most that they could still
    have been when reading halted (``base``), so with the sum of all bases it is the greatest
    possible score, and the score itself once all entries are read.
    """

    def __init__(self, lists: SortedLists, query: np.ndarray):
        self.lists, self.read = lists, 0
        q = [int(x) for x in query]
        self.dims = [d for d in range(lists.dim) if q[d]]  # the others contribute nothing
        self.q = q
        # exact sums: in doubles while they hold them, else in longs, else in Python's integers
        size = 4 * lists.largest * max(map(abs, q), default=0) * max(1, lists.dim)
        self.kind = np.float64 if size < 2**53 else np.int64 if size < 2**63 else object
        self.kept = lists.doubles if self.kind is np.float64 else lists.values
        self.at = dict.fromkeys(self.dims, 0)  # entries read of each list
        self.best = {d: q[d] * self._value(d, 0) for d in self.dims}  # the greatest contribution, and the least
        self.worst = {d: q[d] * self._value(d, lists.n - 1) for d in self.dims}
        self.base = self.best
        self.sum = np.zeros(lists.n, dtype=self.kind)
        self.over = np.empty(lists.values.size, dtype=object) if self.kind is object else lists.over.view(self.kind)
        self._left = None

    def _value(self, d: int, place: int) -> int:
        """The value at a place of list ``d`` in the direction of reading."""
        return int(self.lists.values[d][place if self.q[d] < 0 else self.lists.n - 1 - place])

    def _add(self, out: np.ndarray, rows: np.ndarray, what: np.ndarray) -> None:
        if self.kind is np.float64:
            out += np.bincount(rows, weights=what, minlength=len(out))
        else:
            np.add.at(out, rows, what)

    def _part(self, d: int, start: int, stop: int) -> slice:
        """Entries ``start`` to ``stop`` of list ``d``, counted in the direction of reading."""
        return slice(start, stop) if self.q[d] < 0 else slice(self.lists.n - stop, self.lists.n - start)

    def halt(self, k: int) -> int | None:
        """The halt that seems to cost least; None, where there is no list, to read nothing.

        Bounds and scores are sums over lists, taken for normal with the mean and variance of some
        places of each list. It is only a guess of how many vectors a halt leaves open: whatever the
        halt, results are exact.
        """
        if not self.dims:
            return None
        places = np.linspace(0, self.lists.n - 1, min(self.lists.n, PLACES)).astype(int)
        some = self.lists.doubles[np.ix_(self.dims, places)] * np.array([float(self.q[d]) for d in self.dims])[:, None]
        some /= np.abs(some).max() or 1.0  # squares of any components stay among the doubles
        order = np.argsort(-some, axis=None, kind="stable")
        chosen = order[[int(h * (len(order) - 1)) for h in HALTS]]
        bound = np.maximum(some, some.ravel()[chosen][:, None, None])
        mean, spread = bound.mean(axis=2).sum(axis=1), np.sqrt(bound.var(axis=2).sum(axis=1))
        bar = some.mean(axis=1).sum() + NORMAL.inv_cdf(1 - min(0.5, k / self.lists.n)) * np.sqrt(some.var(axis=1).sum())
        still = [1 - NORMAL.cdf((bar - m) / s) if s else float(m >= bar) for m, s in zip(mean, spread, strict=True)]
        cost = [h + (1 - h) * (LOOK + PICK * x) for h, x in zip(HALTS, still, strict=True)]
        d, place = divmod(int(chosen[int(np.argmin(cost))]), len(places))
        return self.q[self.dims[d]] * int(self.lists.values[self.dims[d]][places[place]])

    def down_to(self, halt: int) -> None:
        """Read every list while its contributions are at least ``halt``."""
        n, rows, over, size = self.lists.n, self.lists.rows, self.over, 0
        self.base = {d: min(best, halt) for d, best in self.best.items()}
        for d in self.dims:
            q, column = self.q[d], self.lists.values[d]
            if q > 0:  # values of at least halt / q, from the top
                low = -(-halt // q)
                new = 0 if low > LONG.max else n - int(np.searchsorted(column, max(low, LONG.min), side="left"))
            else:
                high = halt // q
                new = 0 if high < LONG.min else int(np.searchsorted(column, min(high, LONG.max), side="right"))
            if not new:
                continue
            part = self._part(d, 0, new)
            here = slice(size, size + new)
            rows[here] = self.lists.order[d][part]
            np.multiply(self.kept[d][part].astype(self.kind, copy=False), q, out=over[here])
            over[here] -= self.base[d]
            self.at[d], self.read, size = new, self.read + new, size + new
            if size > 4 * n:  # a few lists at a time stay in the processor's cache
                self._add(self.sum, rows[:size], over[:size])
                size = 0
        self._add(self.sum, rows[:size], over[:size])

    def to_the_end(self, only: np.ndarray) -> None:
        """Read on from the halt to the end of every list, and add up the entries of ``only``, none of them twice."""
        dims = [d for d in self.dims if self.at[d] < self.lists.n]
        if not dims:
            return
        parts = [self._part(d, self.at[d], self.lists.n) for d in dims]
        if self._left is None:
            size = sum(x.stop - x.start for x in parts)
            self._left = np.concatenate([self.lists.order[d][x] for d, x in zip(dims, parts, strict=True)], out=self.lists.rows[:size])
            self.read += size
        mine = np.flatnonzero(np.take(only, self._left, out=self.lists.mask[: len(self._left)], mode="clip"))
        first = np.cumsum([0, *(x.stop - x.start for x in parts)])
        of = np.searchsorted(first, mine, side="right") - 1  # the list of each entry
        places = mine - first[of] + np.array([x.start for x in parts])[of]
        over = self.kept[np.array(dims)[of], places].astype(self.kind)
        over *= np.array([self.q[d] for d in dims], dtype=self.kind)[of]
        over -= np.array([self.base[d] for d in dims], dtype=self.kind)[of]
        self._add(self.sum, self._left[mine], over)

    def greatest(self) -> np.ndarray:
        """The greatest score that each vector can have; its score, where all its entries are read."""
        return self.sum + sum(self.base.values())

    def _noted(self) -> Iterator[tuple[int, np.ndarray]]:
        for d in self.dims:
            yield d, self.lists.order[d][self._part(d, 0, self.at[d])]

    @property
    def seen(self) -> np.ndarray:
        """How many entries of each vector come before the halt."""
        out = np.zeros(self.lists.n, dtype=np.int64)
        for _, rows in self._noted():
            out[rows] += 1
        return out

    def bounds(self, halt: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of every vector after reading down to ``halt``."""
        low = self.sum + sum(self.worst.values())
        for d, rows in self._noted():
            low[rows] += self.base[d] - self.worst[d]
        return low, self.greatest()


def best_of_block(lists: SortedLists, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Vectors that hold the ``k`` best scores (with all ties), their scores, and how many entries were read.

    ``own``: whether a vector of the block is the query itself and no candidate.
    """
    reader, can = Reader(lists, query), ~own
    halt = reader.halt(k)
    if halt is None:  # all scores are 0
        return np.flatnonzero(can), reader.sum[can], reader.read
    reader.down_to(halt)
    first, most = can, max(FIRST, 4 * k)
    if can.sum() > most:
        high = reader.greatest()
        some = high[can]
        least = np.sort(some)[-most] if reader.kind is object else np.partition(some, len(some) - most)[len(some) - most]
        first = can & (high >= least).astype(bool)
    reader.to_the_end(first)
    scores = reader.greatest()
    if first.sum() < can.sum():
        bar = np.sort(scores[first])[-k]
        # ties at the bar stay in, also those by the limits of a long: the smaller id wins them later
        bar = -np.inf if bar <= LONG.min else min(bar, LONG.max)
        can &= (scores >= bar).astype(bool)
        rest = can & ~first
        if rest.any():
            reader.to_the_end(rest)
            scores = reader.greatest()
            can &= (scores >= bar).astype(bool)
    rows = np.flatnonzero(can)
    return rows, scores[rows], reader.read


def top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: float = 256.0,
    id: str = "vec_id",
    embedding: str = "embedding",
    block: int = 8192,
    query_block: int = 256,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank (from 1), vec_id, score.

    Components become floor(``scale`` * x), at most a long's greatest. Queries are the rows whose id
    is divisible by ``query_every``; candidates are all rows but the query's own id, of the same
    length as the query. Ties go to the smaller id. Vectors that are null or hold null or non-finite
    components, and rows with null ids, take no part; empty vectors neither. Rows that repeat an id
    are candidates each and queries each, and their results are ranked together. Scores are exact
    whatever the components' size, but one beyond a long counts as the nearest long. Extra columns
    aren't read; an empty table gives no rows; fewer than k candidates give all.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut(
        vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & good & (F.size("v") > 0))
        .select(
            "vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v")
        ),
        "vectors",
    )
    queries = rows.where(F.col("vec_id") % query_every == 0)
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    candidates = rows.select(
        "dim", own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "vec_id", "v"
    )
    asked = queries.select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
        F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(query_blocks)).cast("int").alias("q"),
        "vec_id",
        "v",
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in names})
        left = left.sort_values("vec_id")
        ids = left["vec_id"].to_numpy()
        lists = SortedLists(np.stack(left.pop("v").to_list()))
        out = []
        for q, v in zip(right["vec_id"].to_numpy(), right["v"], strict=True):
            found, scores, _ = best_of_block(lists, v, ids == q, k)
            whole = [max(LONG.min, min(LONG.max, int(x))) for x in scores]
            best = sorted((-x, i) for x, i in zip(whole, ids[found].tolist(), strict=True))[:k]
            out.append((np.full(len(best), q), np.array([i for _, i in best], dtype=np.int64), np.array([-x for x, _ in best], dtype=np.int64)))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    tasks = min(4096, blocks * query_blocks)  # a cell is much work on little data: one task each
    best = (
        candidates.repartition(tasks, "dim", "b", "q").groupBy("dim", "b", "q")
        .cogroup(asked.repartition(tasks, "dim", "b", "q").groupBy("dim", "b", "q"))
        .applyInPandas(run, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
