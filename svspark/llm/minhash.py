"""MinHash near-dedup with b-bit signatures.

Each distinct shingle set gets ``bands * rows`` minima. Bands of whole minima propose candidates;
of each minimum only the two lowest bits are kept, packed in longs, and candidates whose similarity,
estimated by counting equal bit pairs and corrected for chance collisions, is far below the
threshold are left out. The rest is confirmed on the full shingle sets.

Only components are asked for, so a bucket isn't expanded into pairs: its members are first linked
with the member that meets most others; only members that this leaves in different components are
paired, and the join itself tests them: by the estimate, by what two sets can have in common at most,
and, for sets that differ little from the first member's, by their exact number of common shingles,
which follows from those differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

#: Odd multipliers that turn five word hashes into one shingle hash, and the mixing step after it.
MULTIPLIERS = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Lower-case word -> its 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def shingle_hashes(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A to Z are lower-cased, words are runs of anything but ASCII white space. A text of fewer words
    has its whole sequence as one shingle, a null, empty or blank one has none.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array([len(w) for w in words])
    ends = np.cumsum(n)
    h = np.fromiter((WORDS[w] for doc in words for w in doc), dtype=np.uint64, count=int(ends[-1]) if len(n) else 0)
    sums = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width if len(sums) else 0):
        sums += h[k : len(h) - width + 1 + k] * MULTIPLIERS[k]
    sums = _mix(sums)
    out = []
    for start, k in zip(ends - n, n, strict=True):
        if k >= width:
            out.append(np.unique(sums[start : start + k - width + 1]))
        elif k:
            short = (h[start : start + k] * MULTIPLIERS[:k]).sum(dtype=np.uint64)
            out.append(_mix(np.array([short + np.uint64(k)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of nonempty sets: minima under ``bands * rows`` hash functions."""
    k = bands * rows
    rng = np.random.default_rng(5)
    a = (rng.integers(0, 2**31, k) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 2**32, k).astype(np.uint32)
    minima = np.empty((len(sets), k), dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for j in range(k):
        minima[:, j] = np.minimum.reduceat(x * a[j] + b[j], starts)
    # what is kept of each minimum: its two lowest bits, after mixing, 32 to a long
    kept = _mix(minima.astype(np.uint64) + a.astype(np.uint64)) & np.uint64(3)
    packed = (kept.reshape(len(sets), k // 32, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    grouped = minima.astype(np.uint64).reshape(len(sets), bands, rows)
    keys = _mix((grouped * MULTIPLIERS[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
    return packed.view(np.int64), keys.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int64)])))


def _summaries(width: int, bands: int, rows: int):
    """Arrow batches (doc_id, text) -> (doc_id, n, key1, key2, packed, keys); no lists for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = shingle_hashes(part.column(1).to_pylist(), width)
                full = [s for s in sets if len(s)]
                packed, keys = signatures(full, bands, rows) if full else (none, none)
                lists, digests, i = [], [], 0
                for s in sets:
                    lists.append((packed[i], keys[i]) if len(s) else (none, none))
                    i += bool(len(s))
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    digests.append((d >> 64, d & (2**64 - 1)))
                both = np.array(digests, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(both[:, 0]), pa.array(both[:, 1]),
                        _lists([x[0] for x in lists]), _lists([x[1] for x in lists]),
                    ],
                    names=["doc_id", "n", "key1", "key2", "packed", "keys"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [s.view(np.int64) for s in shingle_hashes(part.column(1).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=["rep", "shingles"])

    return run


def estimate(a: str, b: str, longs: int) -> F.Column:
    """Similarity of two packed signatures: equal bit pairs by bit counts, less the quarter equal by chance."""
    odd = 0x5555555555555555
    differ = F.lit(0)
    for i in range(longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(odd)))
    equal = 1 - differ / (32 * longs)
    return (equal - 0.25) / 0.75


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    width: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    bands: int = 32,
    rows: int = 4,
    slack: float = 0.25,
) -> DataFrame:
    """Classes of documents whose shingle sets have 100 * intersection >= ``percent`` * union.

    Returns doc_id, n_shingles (set size), component_id (least doc_id reachable by links), kept.
    Texts that are null, empty or blank have empty sets and link with nothing; rows with equal sets
    are one node; rows with a null id are returned in a class of their own (component_id null unless
    their set occurs elsewhere) and rows sharing an id share a class. Other columns aren't read.

    With 32 bands of 4 minima a pair at similarity 0.85 has no common band with chance 5e-11.
    ``slack``: how far below the threshold an estimate may be, over six standard errors.
    """
    longs = bands * rows // 32
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = "doc_id long, n long, key1 long, key2 long, packed array<long>, keys array<long>"
    each = cut(source.mapInArrow(_summaries(width, bands, rows), kinds), "signatures")
    reps = cut(
        each.where("n > 0 and doc_id is not null")
        .groupBy("key1", "key2")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("packed").alias("packed"), F.first("keys").alias("keys")),
        "distinct",
    )
    links = _links(source, reps, percent, width, longs, slack)
    groups = components(links)
    classes = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key1", "key2", F.coalesce("component", "rep").alias("least")
    )
    found = each.select("doc_id", "n", "key1", "key2").join(classes, ["key1", "key2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return found.select(
        F.col("doc_id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """``docs``, all columns, with the document of the least id of each class of :func:`near_duplicates`.

    Rows that share an id stay or go together, and so do all rows with a null id: they stay if one
    of them stands in a class of its own. Empty and null texts stay. Extra columns may have any names.
    """
    kept = near_duplicates(docs, doc_id=doc_id, **settings).where("kept").select(F.col(doc_id).alias("__kept_id")).distinct()
    return docs.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col("__kept_id")), "left_semi")


def _links(source: DataFrame, reps: DataFrame, percent: int, width: int, longs: int, slack: float) -> DataFrame:
    """(a, b): links that connect what the threshold connects, though not every link inside a class."""
    bound = percent / 100
    buckets = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    crowd = buckets.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rep").alias("low")).where("size > 1")
    members = cut(
        buckets.join(crowd.select("band", "key", "size"), ["band", "key"]).select("rep", "band", "key", "size"), "buckets"
    )
    met = members.groupBy("rep").agg(F.sum("size").alias("met"))
    slim = reps.select("rep", "n", "packed")
    close = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (estimate("packed", "packed2", longs) >= bound - slack)

    # first pass: every member with the member of its bucket that meets most others in all its buckets
    leaders = members.join(met, "rep").groupBy("band", "key").agg(
        F.max_by("rep", F.struct("met", -F.col("rep"))).alias("leader")
    )
    stars = (
        members.join(leaders, ["band", "key"])
        .where("rep <> leader")
        .select(F.col("rep").alias("a"), F.col("leader").alias("b"))
        .distinct()
    )
    texts = source.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = cut(texts.select("doc_id", "text").mapInArrow(_full_sets(width), "rep long, shingles array<long>"), "sets")
    first = _confirm(sets, _near(stars, slim, close), percent)
    label = components(first).withColumnRenamed("node", "rep")

    # second pass: members that their leader's component leaves out meet all others of the bucket
    left = (
        members.join(leaders, ["band", "key"])
        .join(label, "rep", "left")
        .join(label.select(F.col("rep").alias("leader"), F.col("component").alias("chief")), "leader", "left")
        .select("rep", "leader", "band", "key", F.coalesce("component", "rep").alias("component"), F.coalesce("chief", "leader").alias("chief"))
    )
    split = left.where("component <> chief").select("band", "key").distinct()
    open_ = cut(left.join(split, ["band", "key"]).select("band", "key", "component", "chief", "leader", "rep"), "open")
    alone = (
        sets.join(open_.select("rep").distinct(), "rep")
        .select("rep", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.min("rep").alias("rep"))
        .where("holders = 1")
        .groupBy("rep")
        .agg(F.count("*").alias("alone"))
    )
    # how each member differs from its leader: what it lacks, and what it has besides
    small = lambda c: F.when((F.size("lacks") <= 64) & (F.size("has") <= 64), F.col(c))
    differ = (
        open_.select("rep", "leader").distinct()
        .join(sets.withColumnRenamed("shingles", "x"), "rep")
        .join(sets.select(F.col("rep").alias("leader"), F.col("shingles").alias("y")), "leader")
        .select("rep", "leader", F.size("y").alias("whole"), F.array_except("y", "x").alias("lacks"), F.array_except("x", "y").alias("has"))
        .join(alone, "rep", "left")
        .select(
            "rep", "leader", "whole", F.size("lacks").alias("n_lacks"), F.size("has").alias("n_has"), small("lacks").alias("lacks"), small("has").alias("has"),
            F.greatest(F.size("has") - F.coalesce("alone", F.lit(0)), F.lit(0)).alias("n_has_shared"),
        )
    )
    open_ = cut(open_.join(differ, ["rep", "leader"]).join(slim, "rep"), "open")
    others = open_.where("component <> chief")
    second = open_.select(*[F.col(c).alias(c + "2") for c in open_.columns])
    enough = lambda common: 100 * common >= percent * (F.col("n") + F.col("n2") - common)
    # two sets share at most what both have of the leader, and of the rest what others have as well
    most = F.col("whole") - F.greatest("n_lacks", "n_lacks2") + F.least("n_has_shared", "n_has_shared2")
    exact = (
        F.col("whole") - F.col("n_lacks") - F.col("n_lacks2")
        + F.size(F.array_intersect("lacks", "lacks2")) + F.size(F.array_intersect("has", "has2"))
    )
    pairs = others.join(
        second,
        (F.col("band") == F.col("band2"))
        & (F.col("key") == F.col("key2"))
        & (F.col("component") != F.col("component2"))
        & ((F.col("component2") == F.col("chief2")) | (F.col("rep") < F.col("rep2")))
        & F.when(~enough(most), False).when(~close, False).when(F.col("lacks").isNull() | F.col("lacks2").isNull(), True).otherwise(enough(exact)),
    ).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = _confirm(sets, pairs.join(done, ["a", "b"], "left_anti"), percent)
    return first.unionByName(rest)


def _near(pairs: DataFrame, slim: DataFrame, close: F.Column) -> DataFrame:
    one = slim.select(F.col("rep").alias("a"), "n", "packed")
    two = slim.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("packed").alias("packed2"))
    return pairs.join(one, "a").join(two, "b").where(close).select("a", "b")


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets meet the threshold."""
    both = pairs.join(sets.withColumnRenamed("rep", "a").withColumnRenamed("shingles", "x"), "a").join(
        sets.withColumnRenamed("rep", "b").withColumnRenamed("shingles", "y"), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return cut(
        both.withColumn("common", common)
        .where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common")))
        .select("a", "b"),
        "links",
    )
