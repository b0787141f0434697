"""Whitening of embeddings by the covariance of their distinct integer vectors.

Rows with equal vectors are gathered first, and each distinct vector is multiplied once: sums in exact
integers, then the covariance as a weighted product of centred rows, partition by partition; what
reaches the driver is one sum a dimension and one a pair of dimensions. Each distinct vector is
whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_group
from .vectors import floored, usable

LONG = np.iinfo(np.int64)
#: An eigenvalue at most this share of the greatest counts as zero: nothing varies in its direction.
FLAT = 1e-13


def _by_length(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for the vectors of each length in column ``at`` of a batch."""
    column = batch.column(at)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, values[offsets[rows][:, None] + np.arange(dim)]


def _exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """``x`` as it is if sums of its entries times ``factor`` fit a long, else as Python's integers."""
    most = max(-int(x.min()), int(x.max()), 1) * factor
    return x if most <= LONG.max else x.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    s = np.array(sums, dtype=object)
    wide = max(max(map(abs, sums), default=0), max(-int(x.min()), int(x.max()), 1) * n)
    if 2 * wide <= LONG.max:
        return n * x - s.astype(np.int64)
    return x.astype(object) * n - s


def deviations(y: np.ndarray) -> np.ndarray:
    """Sums of squares by row, exact; one beyond a long counts as the greatest long."""
    about = (y.astype(np.float64) ** 2).sum(axis=1) / 2.0**63
    # sums that wrap around are right where the whole sum fits
    out = np.zeros(len(y), np.int64) if y.dtype == object else (y * y).sum(axis=1)
    out[about > 1] = LONG.max
    for i in np.flatnonzero(abs(about - 1) < 1e-6 if y.dtype != object else about < 1 + 1e-6):
        out[i] = min(LONG.max, sum(int(v) ** 2 for v in y[i]))
    return out


def fit(distinct: DataFrame, weight: Column) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """For each length of vectors: the sum n of weights, the weighted sum of each dimension, the covariance.

    ``distinct``: a written table with a column x of longs. The covariance's divisor is n, and rows
    are centred before they are multiplied.
    """
    rows = distinct.select("x", weight.cast("long").alias("w"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for dim, mine, x in _by_length(batch):
                w = weights[mine]
                x = _exact(x, int(w.sum()))
                own = kept.setdefault(dim, [0, np.zeros(dim, dtype=object)])
                own[0] += int(w.sum())
                own[1] += (x * w[:, None]).sum(axis=0).astype(object)
        for dim, (n, s) in kept.items():
            values = pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), values], names=["dim", "i", "n", "s"]
            )

    sums: dict[int, tuple[int, list[int]]] = {}
    for r in rows.mapInArrow(totals, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "i").collect():
        sums.setdefault(r.dim, (r.n, []))[1].append(int(r.s))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for dim, mine, x in _by_length(batch):
                n, s = sums[dim]
                z = centred(x, n, s).astype(np.float64) / n
                kept[dim] = kept.get(dim, 0) + (z * weights[mine][:, None]).T @ z
        for dim, c in kept.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(c[i, j])], names=["dim", "i", "j", "c"]
            )

    found = {dim: (n, s, np.zeros((dim, dim))) for dim, (n, s) in sums.items()}
    for r in rows.mapInArrow(products, "dim int, i int, j int, c double").groupBy("dim", "i", "j").agg(F.sum("c").alias("c")).collect():
        n, _, v = found[r.dim]
        v[r.i, r.j] = v[r.j, r.i] = r.c / n
    return found


def directions(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` of the greatest eigenvalues that aren't zero, falling, and their unit eigenvectors as columns."""
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1], found[:, ::-1]
    some = (values > max(values[0], 0) * FLAT)[:k]
    return values[:k][some], found[:, :k][:, some]


def whiten(
    vectors: DataFrame,
    components: int = 4,
    scale: float = 256.0,
    weights: str = "one",
    id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """Whitened rows: id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(``scale`` * c), at most a long's greatest. The fit counts each distinct x
    vector once (``weights`` "one") or as often as it occurs ("count"); n is the sum of weights, S the
    weighted sum of x. Components are eigenvectors of the covariance by falling eigenvalue e, from 1;
    one whose eigenvalue is zero to double precision has no rows, so n = 1 gives none. deviation is the
    sum of (n x - S)^2, exact, the greatest long if beyond; whitened is (x - S / n) on the component
    over sqrt(e), explained e over the trace, identity_error the largest entry by which the covariance
    of whitened differs from the identity, measured on the whitened rows themselves.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; null ids stay.
    Vectors of each length are a table of their own. Rows that repeat an id stay apart, copies of one
    vector may be a third of all rows. Extra columns aren't read; an empty table gives no rows.
    Distinct vectors are known by hashes of 128 bits.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be 'one' or 'count', not {weights!r}")
    rows = (
        vectors.select(F.col(id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(usable("v"))
        .select("vec_id", floored("v", scale).alias("x"))
        .select("vec_id", "x", F.size("x").alias("dim"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))
    )
    distinct = cut(rows.groupBy("dim", "h1", "h2").agg(F.first("x").alias("x"), F.count("*").alias("size")), "distinct")
    weight = F.col("size") if weights == "count" else F.lit(1)
    model = {}
    for dim, (n, sums, covariance) in fit(distinct, weight).items():
        values, found = directions(covariance, components)
        model[dim] = n, sums, found / np.sqrt(values), values / np.trace(covariance)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, x in _by_length(batch):
                n, sums, turned, share = model[dim]
                y = centred(x, n, sums)
                out = (y.astype(np.float64) / n) @ turned
                each = lambda a: pa.array(list(a), pa.list_(pa.float64()))
                kept = batch.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns[1:], pa.array(np.full(len(mine), n)), pa.array(deviations(y)), each(out), each(np.tile(share, (len(mine), 1)))],
                    names=[*kept.schema.names[1:], "n", "deviation", "whitened", "explained"],
                )

    kinds = "dim int, h1 long, h2 long, size long, n long, deviation long, whitened array<double>, explained array<double>"
    turned = cut(distinct.select("x", "dim", "h1", "h2", "size").mapInArrow(turn, kinds), "whitened")
    at = lambda i: F.get("whitened", F.lit(i))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    means = {r.dim: r for r in turned.groupBy("dim").agg(F.sum(weight).alias("n"), *(F.sum(at(i) * weight).alias(f"m{i}") for i in range(components))).collect()}
    errors = []
    for dim, m in means.items():
        centre = [None if m[f"m{i}"] is None else m[f"m{i}"] / m.n for i in range(components)]
        mine = [(i, j) for i, j in pairs if centre[i] is not None and centre[j] is not None]
        if mine:
            r = turned.where(F.col("dim") == dim).agg(*(F.sum((at(i) - centre[i]) * (at(j) - centre[j]) * weight).alias(f"c{i}_{j}") for i, j in mine)).first()
            errors.append((dim, max(abs(r[f"c{i}_{j}"] / m.n - (i == j)) for i, j in mine)))
    identity = rows.sparkSession.createDataFrame(errors, "dim int, identity_error double")
    found = with_group(rows.select("vec_id", "dim", "h1", "h2"), turned, ["dim", "h1", "h2"])
    return (
        found.join(F.broadcast(identity), "dim")  # a row for each length of vectors
        .select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            F.col("vec_id").alias(id), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
            F.get("explained", F.col("at")).alias("explained"), "identity_error",
        )
    )
