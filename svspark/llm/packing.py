"""Best-fit packing of documents into bins under conflicts.

A bin has a capacity in words and at most one piece of any source and of any duplicate cluster. Bins
are kept by what they have left; a piece goes to the fullest bin that holds it and has neither its
source nor its cluster, found by walking from the bin with just enough room to emptier ones.

Documents are dealt by a hash to shards of a bounded number of pieces, which are packed alone: best
fit among thousands of pieces fills bins about as well as best fit among all.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words


class Bins:
    """Open bins ordered by residual; bins with equal residual are grouped by their source bitmap.

    ``place`` walks the residuals upwards from the piece's size and returns the first compatible
    bin, which is the tightest. Bitmaps are integers over the sources and clusters of one shard.
    """

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.residuals: list[int] = []  # those that some bin has, ascending
        self.by_residual: dict[int, dict[int, list[tuple[int, int]]]] = {}  # residual -> sources -> [(bin, clusters)]

    def _add(self, residual: int, sources: int, clusters: int, number: int) -> None:
        if residual <= 0:
            return
        if residual not in self.by_residual:
            bisect.insort(self.residuals, residual)
            self.by_residual[residual] = {}
        self.by_residual[residual].setdefault(sources, []).append((number, clusters))

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for a piece; ``source`` and ``cluster`` are single bits or 0 for no conflict."""
        for at in range(bisect.bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[at]
            groups = self.by_residual[residual]
            for sources, bins in groups.items():
                if sources & source:
                    continue
                for i, (number, clusters) in enumerate(bins):
                    if clusters & cluster:
                        continue
                    bins[i] = bins[-1]
                    bins.pop()
                    if not bins:
                        del groups[sources]
                        if not groups:
                            del self.by_residual[residual]
                            self.residuals.pop(at)
                    self._add(residual - size, sources | source, clusters | cluster, number)
                    return number
        self.n += 1
        self._add(self.capacity - size, source, cluster, self.n - 1)
        return self.n - 1


def pack_shard(pieces: pd.DataFrame, capacity: int) -> pd.Series:
    """Bin numbers of ``pieces`` (size, source, cluster), packed in the given order."""
    source_bits: dict = {}
    cluster_bits: dict = {}
    repeated = set(pieces["cluster"][pieces["cluster"].duplicated(keep=False)])
    bins, out = Bins(capacity), []
    for size, source, cluster in zip(pieces["size"], pieces["source"], pieces["cluster"], strict=True):
        s = 0 if pd.isna(source) else 1 << source_bits.setdefault(source, len(source_bits))
        c = 1 << cluster_bits.setdefault(cluster, len(cluster_bits)) if cluster in repeated and not pd.isna(cluster) else 0
        out.append(bins.place(int(size), s, c))
    return pd.Series(out, index=pieces.index, dtype="int64")


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    shard_pieces: int = 4096,
) -> DataFrame:
    """Pack every document: doc_id, piece, start, size (words), shard, bin, fill (words in the bin).

    Documents longer than ``capacity`` are cut into full pieces, each a bin of its own (with a shard
    below 0), and a rest that is packed like a short document. ``cluster`` names a column of duplicate clusters; without
    it documents of equal text are one. Null sources and null clusters conflict with nothing. A
    document without words (null, empty or blank text) takes a bin number of -1 and no room. Rows
    that repeat are packed each, in different bins where text or cluster is equal. Extra columns
    aren't read; an empty table gives no rows.

    Shards and the order in them follow from ids, sizes and conflict keys alone, with a counter for
    equal rows, so equal rows give equal bins however they are partitioned. Only these are shuffled,
    not texts. Shards have about ``shard_pieces`` pieces; a source or cluster with a third of all
    rows is spread over all shards.
    """
    key = F.col(cluster).cast("string") if cluster else F.md5(F.encode(F.col(text), "utf-8"))
    kinds = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("cluster"), n_words(text).alias("words")
    )
    content = ["doc_id", "source", "cluster", "words"]
    rows = cut(
        kinds.groupBy(*content).agg(F.count("*").alias("n"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("row", F.xxhash64(*content, "copy")),
        "sizes",
    )
    full = F.floor(F.col("words") / capacity)
    whole = (
        rows.where(full > 0)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), full.cast("int") - 1)))
        .select(
            "doc_id", "row", "piece", (F.col("piece") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("size"),
            (-1 - F.col("piece")).cast("long").alias("shard"), F.col("row").alias("bin"),
        )
    )
    rest = rows.select(
        "doc_id", "row", full.cast("int").alias("piece"), (full * capacity).cast("long").alias("start"),
        (F.col("words") - full * capacity).alias("size"), "source", "cluster",
    )
    empty = rest.where("size = 0 and piece = 0").select(
        "doc_id", "row", "piece", "start", "size", F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("bin")
    )
    rest = rest.where("size > 0")
    shards = max(1, -(-rest.count() // shard_pieces))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        # the largest first; ties by what the row holds, so a rerun packs alike
        shard = shard.sort_values(["size", "doc_id", "row"], ascending=[False, True, True], na_position="last")
        shard["bin"] = pack_shard(shard, capacity)
        return shard[["doc_id", "row", "piece", "start", "size", "shard", "bin"]]

    packed = (
        rest.withColumn("shard", F.pmod("row", F.lit(shards)))
        .repartition(min(4096, shards), "shard")
        .groupBy("shard")
        .applyInPandas(run, "doc_id long, row long, piece int, start long, size long, shard long, bin long")
    )
    packed = cut(packed.unionByName(whole).unionByName(empty), "packed")
    fills = packed.where("shard >= 0").groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
    return packed.join(fills, ["shard", "bin"], "left").select(
        F.col("doc_id").alias(doc_id), "piece", "start", "size", "shard", "bin", F.coalesce("fill", "size").alias("fill")
    )
