"""Reference sequences as a table of blocks: (name, block, bases), and slices of them by place.

No row holds more than a block, whatever the length of a sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import settled

BLOCK = 1 << 16


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file, split and place in it: file, split, at, value."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )


def read_reference(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Sequences of FASTA files in blocks of ``block`` bases: name, block (from 0), bases in upper case.

    A line's place follows from running sums of line lengths inside a split and a table with one row a
    split for what came before, so a sequence may go over any number of splits. The name ends at the
    first blank; names must differ between sequences. Empty lines count nothing, a sequence without
    bases has no rows, and lines before the first header are an error of the file and left out.
    """
    lines = _numbered_lines(spark, path).withColumn("value", F.trim("value")).where("value <> ''")
    inside = Window.partitionBy("file", "split").orderBy("at")
    head = F.col("value").startswith(">")
    lines = lines.withColumn("head", head).withColumn("size", F.when(head, 0).otherwise(F.length("value")).cast("long"))
    lines = lines.withColumn("own", F.sum(F.col("head").cast("int")).over(inside))  # headers of the split so far
    here = Window.partitionBy("file", "split", "own").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    title = F.when(F.col("head"), F.regexp_extract("value", r"^>\s*(\S*)", 1))
    lines = lines.withColumn("begin", F.coalesce(F.sum("size").over(here), F.lit(0)))
    lines = lines.withColumn("title", F.last(title, ignorenulls=True).over(inside))
    # one row a split: its last title, and how many bases follow it (all, if it has none)
    ends = lines.groupBy("file", "split").agg(
        F.max("own").alias("heads"), F.max_by("title", "at").alias("last"), F.max_by(F.col("begin") + F.col("size"), "at").alias("tail")
    )
    along = Window.partitionBy("file").orderBy("split")
    ends = ends.withColumn("run", F.sum((F.col("heads") > 0).cast("int")).over(along))
    ends = ends.withColumn("so_far", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split")))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("open"), F.coalesce(F.lag("so_far").over(along), F.lit(0)).alias("carried"))
    placed = (
        lines.where("not head").join(ends, ["file", "split"])
        .select(
            F.coalesce("title", "open").alias("name"),
            (F.col("begin") + F.when(F.col("own") == 0, F.col("carried")).otherwise(0)).alias("begin"), F.upper("value").alias("value"), "size",
        )
        .where("name is not null")
    )
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    low, high = F.greatest("begin", F.col("block") * block), F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last))).select(
        "name", "block", low.alias("low"), F.substring("value", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("bases")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "bases"))), lambda p: p["bases"]), "")
    return pieces.groupBy("name", "block").agg(joined.alias("bases"))


def blocks_of(sequences: DataFrame, name: str = "name", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """(name, block, bases) of sequences that are in rows, such as contigs."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length(seq) - 1) / block)))
    return sequences.where(F.length(seq) > 0).select(F.col(name).alias("name"), number.alias("block"), F.col(seq).alias("_s")).select(
        "name", "block", F.upper(F.substring("_s", (F.col("block") * block + 1).cast("int"), F.lit(block))).alias("bases")
    )


def lengths(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name, length) of the sequences of a table of blocks."""
    return blocks.groupBy("name").agg(F.max(F.col("block") * block + F.length("bases")).alias("length"))


def with_slices(rows: DataFrame, blocks: DataFrame, wanted: dict[str, tuple[Column, Column, Column]], block: int = BLOCK) -> DataFrame:
    """Adds one column of bases for each entry of ``wanted``: name -> (sequence, start, end), 0-based and half-open.

    Parts beyond the ends of a sequence are left out; an empty stretch gives an empty text, a null
    place or an unknown sequence null. Each stretch is cut once however many rows want it, from the
    blocks that it touches, and joined in order.
    """
    names = {out: [f"_{out}_{k}" for k in ("name", "start", "end")] for out in wanted}
    keyed = rows
    for out, (chrom, start, end) in wanted.items():
        given = start.isNotNull() & end.isNotNull()
        low, high = F.greatest(start.cast("long"), F.lit(0)), F.greatest(end.cast("long"), start.cast("long"), F.lit(0))
        keyed = keyed.withColumns(dict(zip(names[out], (chrom, F.when(given, low), F.when(given, high)), strict=True)))
    keyed = settled(keyed)  # read for the stretches and again for what they give
    place = ["name", "start", "end"]
    stretches = reduce(DataFrame.unionAll, [keyed.select(*[F.col(k).alias(c) for k, c in zip(key, place, strict=True)]) for key in names.values()])
    stretches = stretches.where("name is not null and start is not null and end is not null").distinct()
    touched = stretches.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / block))))
    # the first block comes along even for an empty stretch, to tell it from an unknown sequence
    low = F.greatest("start", F.col("block") * block)
    size = F.greatest(F.least("end", (F.col("block") + 1) * block) - low, F.lit(0))
    part = F.substring("bases", (low - F.col("block") * block + 1).cast("int"), size.cast("int"))
    cut = touched.join(blocks, ["name", "block"]).select(*place, "block", part.alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "")
    known = blocks.select("name").distinct()
    found = cut.groupBy(*place).agg(text.alias("_text"))
    # stretches beyond the last block of a known sequence are empty
    found = stretches.join(found, place, "left").join(known.withColumn("_known", F.lit(True)), "name", "left").select(
        *place, F.coalesce("_text", F.when(F.col("_known"), F.lit(""))).alias("_text")
    )
    found, rows = settled(found), keyed
    for out, key in names.items():
        rows = rows.join(found.select(*[F.col(c).alias(k) for k, c in zip(key, place, strict=True)], F.col("_text").alias(out)), key, "left").drop(*key)
    return rows
