"""Near-duplicate embeddings by spherical-cap filters over structured random product codes.

A filter is a unit direction; it catches a vector whose cosine to it exceeds a bound. Directions are
products of short random codes, one for each block of coordinates after a random rotation, so a
vector's filters are decoded from a few block scores instead of all directions. Vectors that share
a filter meet, and all pairs that meet are verified in double precision.

The caps' width and the number of directions follow from the dimension, so that a vector has about
``FILTERS`` filters in any number of dimensions; a pair at cosine 0.93 shares about half of them. The
least number that any of 6,000 random pairs at exactly 0.93 shared was 3; seeds are fixed, so runs agree.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, with_group

#: Filters that catch a vector on average; rotations; the caps' cosine times sqrt(dim), and its greatest value.
FILTERS, TURNS, SPREAD, WIDEST = 48, 64, 3.0, 0.65
#: Pairs of a cell are listed up to so many vectors, and found by blocks of products beyond; pairs verified at a time.
SMALL, AT_ONCE = 32, 1 << 16


def cap_share(cosine: float, dim: int) -> float:
    """The share of the unit sphere in ``dim`` dimensions within ``cosine`` of a direction."""
    if dim == 1:
        return 0.5
    angle = np.linspace(0, np.pi, 200_001)
    weight = np.sin(angle) ** (dim - 2)
    return float(weight[np.cos(angle) > cosine].sum() / weight.sum())


class ProductCode:
    """Directions of ``dim`` coordinates: of each random rotation all pairs of a first and a second half code.

    Several rotations make the number of filters that catch a vector nearly the same for all vectors.
    """

    def __init__(self, dim: int, filters: int = FILTERS, turns: int = TURNS, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        cosine = min(SPREAD / np.sqrt(dim), WIDEST)
        self.size = max(2, int(np.ceil(np.sqrt(filters / cap_share(cosine, dim) / turns))))
        self.at = (dim + 1) // 2
        self.first, self.second = [], []
        for _ in range(turns):
            turned = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for half, out in ((turned[:, : self.at], self.first), (turned[:, self.at :], self.second)):
                words = rng.standard_normal((self.size, half.shape[1]))
                words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
                out.append(half @ words.T)
        self.bound = cosine * np.sqrt(2 if dim > 1 else 1)  # each half code has length 1

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that catch a row of ``units``, sorted."""
        rows, filters = [], []
        for turn, (first, second) in enumerate(zip(self.first, self.second, strict=True)):
            a, b = units @ first, units @ second
            # list decoding: only half codes that the best other half lifts over the bound
            n, i = np.nonzero(a + b.max(axis=1, keepdims=True) > self.bound)
            k, j = np.nonzero(a[n, i, None] + b[n] > self.bound)
            rows.append(n[k])
            filters.append((turn * self.size + i[k]) * self.size + j)
        row, found = np.concatenate(rows), np.concatenate(filters).astype(np.int32)
        order = np.lexsort((found, row))
        return row[order], found[order]


@functools.cache
def code(dim: int, filters: int, turns: int) -> ProductCode:
    return ProductCode(dim, filters, turns)


def units(rows: np.ndarray) -> np.ndarray:
    """``rows`` at length 1; scaled by powers of two first, which is exact, so that squares stay finite."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that agree in the first ``keys`` columns, from batches sorted by them.

    Batches are joined until a group ends in them, so a table holds a batch and a group at most.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in range(keys)]
        ends = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0))
        same = held and all(v[0] == held[-1].column(k)[held[-1].num_rows - 1].as_py() for k, v in enumerate(values))
        if held and not same:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(ends):
            at = int(ends[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks()
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each of the groups from ``starts`` to before ``stops``, about ``AT_ONCE`` at a time."""
    n = stops - starts
    row = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rest = np.repeat(stops, n) - 1 - row  # how many rows of its group come after a row
    ends = np.cumsum(rest)
    cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE)) + 1 if len(ends) else []
    for rows, k in zip(np.split(row, cuts), np.split(rest, cuts), strict=True):
        one = np.repeat(rows, k)
        yield one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k)


def _shared_before(pairs: tuple[np.ndarray, np.ndarray], at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether the two rows of a pair share one of the filters listed before this one; lists are sorted."""
    one, two = pairs
    n = at[one + 1] - at[one]
    if not n.sum():
        return np.zeros(len(one), dtype=bool)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at)) << 32
    known = owner + before
    pair = np.repeat(np.arange(len(one)), n)
    place = np.repeat(at[one], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    asked = (two[pair].astype(np.int64) << 32) + before[place]
    hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
    return np.bincount(pair[hit], minlength=len(one)) > 0


def _meet(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Verify the pairs of each cell. A pair counts in the first filter that it shares alone.

    Returns for each vector with links in a cell how many it counts there, and a vector that stands
    for its component in the cell.
    """
    for table in _cells(batches, 5):
        keys = np.stack([table.column(k).to_numpy() for k in range(5)], axis=1)
        bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        starts, stops = bounds[:-1], bounds[1:]
        node, own, mult = (table.column(k).to_numpy() for k in (5, 6, 7))
        offsets, values = _lists(table.column(8).chunk(0))
        at, before = _lists(table.column(9).chunk(0))
        before, at = before[at[0] : at[-1]], at - at[0]
        # two parts of a crowded filter: each part's own pairs have another cell
        parted = keys[:, 3] != keys[:, 4]
        counts, label = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def found(one: np.ndarray, two: np.ndarray) -> None:
            other = ~parted[one] | (own[one] != own[two])
            one, two = one[other], two[other]
            if not len(one):
                return
            new = ~_shared_before((one, two), at, before)
            np.add.at(counts, one[new], mult[two[new]])
            np.add.at(counts, two[new], mult[one[new]])
            links.append((one, two))

        size = stops - starts
        small = (size > 1) & (size <= SMALL)
        for dim in np.unique(keys[starts[small], 1]):
            mine = small & (keys[starts, 1] == dim)
            for one, two in _pairs(starts[mine], stops[mine]):
                kinds, place = np.unique(np.concatenate([one, two]), return_inverse=True)
                unit = units(values[offsets[kinds][:, None] + np.arange(dim)].astype(np.float64))
                near = np.einsum("ij,ij->i", unit[place[: len(one)]], unit[place[len(one) :]]) >= threshold
                found(one[near], two[near])
        for start, stop in zip(starts[size > SMALL], stops[size > SMALL], strict=True):
            unit = units(values[offsets[start] : offsets[stop]].astype(np.float64).reshape(stop - start, -1))
            for low in range(0, len(unit), 256):
                one, two = np.nonzero(np.triu(unit[low : low + 256] @ unit[low:].T >= threshold, 1))
                for part in range(0, len(one), AT_ONCE):
                    found(start + low + one[part : part + AT_ONCE], start + low + two[part : part + AT_ONCE])
        if not links:
            continue
        one, two = (np.concatenate(x) for x in zip(*links, strict=True))
        while True:  # components inside the cells
            old = label.copy()
            least = np.minimum(label[one], label[two])
            np.minimum.at(label, one, least)
            np.minimum.at(label, two, least)
            label = label[label]
            if (label == old).all():
                break
        rows = np.unique(np.concatenate([one, two]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[rows]), pa.array(counts[rows]), pa.array(node[label[rows]])], names=["node", "n", "other"]
        )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    filters: int = FILTERS,
    turns: int = TURNS,
    cell_rows: int = 1024,
) -> DataFrame:
    """Links between vectors of equal label with cosine >= ``threshold``, one row per input row.

    Returns id, n_links (other rows linked directly), component_id (least id reachable), kept.
    A null id, label or vector, a zero vector or one with null or non-finite components links with
    nothing (component_id is its own id); vectors of different lengths never link; equal vectors
    are met once and counted as often as they occur; rows that share an id are vectors of their own
    with equal ids. Cosines are of doubles, in any number of dimensions. Extra columns aren't read.
    An empty table gives no rows.

    Equal vectors are gathered by aggregates; a filter that catches more than ``cell_rows`` vectors
    is dealt out to cells of pairs of parts, so no task holds a whole crowded filter; each task
    returns counts and a spanning forest, not pairs. What is shuffled is about ``filters`` times the
    vectors. Distinct (label, vector)s are known by hashes of 128 bits, and as nodes of the graph of 64.
    """
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are doubles as they are
    rows = vectors.select(
        F.col(id).cast("long").alias("vec_id"),
        F.xxhash64(F.col(label)).alias("lab"),
        F.col(label).isNotNull().alias("has_label"),
        F.col(embedding).cast(kind).alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("has_label") & finite & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("good", good).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    reps = rows.where("good").groupBy("lab", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v")
    )
    reps = reps.select("lab", "h1", "h2", F.xxhash64("lab", "h1", "h2").alias("node"), "rep", "mult", "v")

    def catch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = _lists(batch.column(6))
            sizes = np.diff(at)
            lists = [None] * batch.num_rows
            for dim in np.unique(sizes):
                for rows in np.array_split(same := np.flatnonzero(sizes == dim), len(same) // 64 + 1):
                    unit = units(values[at[rows, None] + np.arange(dim)].astype(np.float64))
                    row, found = code(int(dim), filters, turns).decode(unit)
                    for r, own in zip(rows, np.split(found, np.searchsorted(row, np.arange(1, len(rows)))), strict=False):
                        lists[r] = own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "filters"]
            )

    kinds = f"lab long, h1 long, h2 long, node long, rep long, mult long, v {kind}, filters array<int>"
    caught = cut(reps.mapInArrow(catch, kinds), "caught")
    each = caught.select("lab", F.size("v").alias("dim"), "node", "mult", "v", "filters", F.posexplode("filters").alias("at", "filter"))
    crowded = cut(
        caught.select("lab", F.size("v").alias("dim"), F.explode("filters").alias("filter"))
        .groupBy("lab", "dim", "filter")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > cell_rows)
        .select("lab", "dim", "filter", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")),
        "crowded",
    )
    dealt = (
        each.join(crowded, ["lab", "dim", "filter"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.hash("node"), F.col("parts")).cast("int"))
        .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "lab", "dim", "filter", F.least("own", "partner").alias("p"), F.greatest("own", "partner").alias("q"),
            "node", "own", "mult", "v", F.slice("filters", F.lit(1), F.col("at")).alias("before"),
        )
        .repartition("lab", "dim", "filter", "p", "q")
        .sortWithinPartitions("lab", "dim", "filter", "p", "q")
    )
    met = cut(dealt.mapInArrow(lambda b: _meet(b, threshold), "node long, n long, other long"), "met")
    links = met.groupBy("node").agg(F.sum("n").alias("n"))
    groups = cut(components(met.select(F.col("node").alias("a"), F.col("other").alias("b"))), "groups")
    ids = groups.join(caught.select("node", "rep"), "node")
    least = ids.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("size"))
    by_node = with_group(groups, cut(least, "least"), ["component"]).select("node", "least")
    by_rep = (
        caught.select("lab", "h1", "h2", "node", "rep", "mult")
        .join(links, "node", "left")
        .join(by_node, "node", "left")
        .select(
            "lab", "h1", "h2", F.lit(True).alias("good"),
            (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
            F.coalesce("least", "rep").alias("component_id"), F.col("mult").alias("size"),
        )
    )
    plain = rows.select("vec_id", "good", "lab", "h1", "h2")
    # copies of one vector may hold a third of all rows
    found = with_group(plain.where("good"), cut(by_rep, "nodes"), ["good", "lab", "h1", "h2"])
    alone = plain.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.select("vec_id", "n_links", "component_id").unionByName(alone).select(
        F.col("vec_id").alias(id),
        "n_links",
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
