"""Helpers that the operators share: shared folders, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below the shared folder that ``spark.checkpoint.dir`` names.

    Where that setting is absent a temporary folder takes its place on a local master; on a cluster
    executors would write to different disks, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, so that later jobs restart from files."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_group(rows: DataFrame, groups: DataFrame, on: list[str], size: str = "size", most: int = 50_000, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row a key and in ``size`` how many of ``rows`` it has.

    The rows of a crowded key don't meet in one task: keys that hold over a ``most``-th of all grouped
    rows, at most ``most`` of them whatever the input, are broadcast and meet their rows where these
    are; the others are joined by a shuffle. ``groups`` should be written (:func:`cut`), as it is
    read up to four times. ``sizes``: the sum of all sizes and the greatest, where these are known.
    """
    if sizes is None:
        found = groups.agg(F.sum(size), F.max(size)).first()
        sizes = found[0] or 0, found[1] or 0
    bar = max(1000, sizes[0] // most)
    if sizes[1] <= bar:
        return rows.join(groups, on)
    crowded = groups.where(F.col(size) > bar)
    here = rows.join(F.broadcast(crowded), on)
    rest = rows.join(F.broadcast(crowded.select(*on)), on, "left_anti").join(groups.where(F.col(size) <= bar), on)
    return here.unionByName(rest)


def n_words(text: str) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (node, component = smallest node reachable).

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the
    number of nodes whatever the shape of the graph; each round is written to the shared folder.
    Rows with a null end and loops are left out, repeated edges count once. A node of high degree
    is met by aggregates alone, never gathered in one task.
    """
    cur = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(
            both.groupBy("u").agg(
                F.least("u", F.min("v")).alias("m"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")
            ),
            "least",
        )
        # rows are distinct, so their number and a checksum that knows no order tell whether a round changed anything
        now = least.agg(F.sum("size"), F.max("size"), F.bit_xor("mark")).first()
        if now == before:
            break
        before = now
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        large = (
            with_group(both.where("v > u"), least.drop("mark"), ["u"], sizes=(now[0] or 0, now[1] or 0))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: the smaller neighbours of u, and u itself, are linked to their least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        cur = cut(small, "edges")
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        cur.select("v", "v").distinct()
    )
