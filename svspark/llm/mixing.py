"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal size are in the order of a van der Corput sequence, the reversed bits of the points 0, 1,
2, ...; a slot falls to the source into whose stretch of the cumulative weights, counted in blocks, its
point falls, so that every prefix of the schedule is near the weights. The k-th slot of a source takes the k-th block of equally many words from the
source's documents in shuffled order, going round again when they are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` -> with rank, weight and target of each source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share the sum of all
    sizes by weight; a target stops at ``max_repeats`` times its source's size and what is over is
    shared again: the sources that stop are those with least size for their weight, so the level
    that the others share follows from running sums. One row a source, whatever the input.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", (F.col("rank") % 3 + 1).cast("double")
    )
    by_need = Window.orderBy(max_repeats * F.col("source_size") / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("limit", (max_repeats * F.col("source_size")).cast("double"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("sharing", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("sharing"))
        .withColumn("stops", F.col("limit") < F.col("level") * F.col("weight"))
    )
    # the level at the first source that doesn't stop holds for all after it
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(every)["level"]
    return rows.withColumn("target", F.least("limit", level * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target"
    )


def schedule(targets: DataFrame, chunk: int = 65536) -> DataFrame:
    """Slots of a van der Corput sequence: (rank of the source, slot, k = how many slots it had before).

    ``targets(rank, blocks)``: how many blocks each source needs. Sources lie one after another on the
    cumulative numbers of blocks; point j of 0, 1, 2, ... has the slot that the reversed bits of j
    give, so a source's slots are listed by themselves, every prefix of the slots in order is near the
    sources' shares (by a few slots, a logarithm of their number), and as many rows are dealt as
    blocks are needed, however small a source is. Slots leave gaps. Points are listed and ranked
    in chunks, so no task meets all slots of a source.
    """
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    stretches = cut(
        targets.where("blocks > 0").select("rank", F.col("blocks").cast("long").alias("blocks")).withColumn("from", F.coalesce(F.sum("blocks").over(upto), F.lit(0))),
        "stretches",
    )
    total = stretches.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    point = F.sequence(F.col("start"), F.least(F.col("start") + chunk, F.col("from") + F.col("blocks")) - 1)
    dealt = (
        stretches.withColumn("start", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1, F.lit(chunk).cast("long"))))
        .repartition(F.xxhash64("start"))
        .select("rank", F.explode(point).alias("j"))
        .select("rank", F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("long").alias("slot"))
        .withColumn("chunk", F.floor(F.col("slot") / chunk))
    )
    counts = dealt.groupBy("rank", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "chunk").orderBy("slot")
    return (
        dealt.withColumn("i", F.row_number().over(inside) - 1)
        .join(offsets, ["rank", "chunk"])
        .select("rank", "slot", (F.col("offset") + F.col("i")).cast("long").alias("k"))
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = 1024,
    max_repeats: int = 3,
    part_rows: int = 20_000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: (documents, draws).

    documents: doc_id, size (words), source_size, target, taken (words that the mix takes, repeats
    counted), first_slot (the earliest slot of the schedule that takes some of it, null if none does)
    and draws (how many slots take some). draws: one row per slot and piece of a document: slot,
    doc_id, start, words, so that draws in slot order are the mixed stream. Null text has size 0; null
    sources are one source; rows that repeat an id are documents of their own with equal ids. Extra
    columns aren't read. An empty table gives no rows.

    A source's words are taken up to its target, rounded down to whole words: its last block is cut.
    Documents are shuffled by a hash of id, text and seed, so reruns agree. Running sums go over
    ranges of the hash (256, or more of about ``part_rows`` rows) in each source and then over the ranges, so that a
    source with a third of all rows is spread over many tasks. A table of sources is met by windows
    without a key: sources must be few against rows, as names of collections are.
    """
    documents, draws, _ = _mix(docs, doc_id, text, source, block, max_repeats, part_rows, seed)
    names = ["size", "source_size", "target", "taken", "first_slot", "draws"]
    return documents.select(F.col("doc_id").alias(doc_id), *names), draws.drop("row")


def _mix(
    docs: DataFrame, doc_id: str, text: str, source: str, block: int = 1024, max_repeats: int = 3, part_rows: int = 20_000, seed: int = 17
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with ``row`` and ``order``, draws with ``row``, targets)."""
    rows = cut(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            n_words(text).alias("size"),
            _order(doc_id, text, source, seed).alias("order"),
            F.monotonically_increasing_id().alias("row"),  # tells equal rows apart, which change places freely
        ),
        "sizes",
    )
    parts = max(256, -(-rows.count() // part_rows))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(
        source_targets(sizes, max_repeats)
        .withColumn("per_round", F.ceil(F.col("source_size") / block))
        .withColumn("whole", F.floor("target"))
        .withColumn(
            "blocks",
            F.when(
                F.col("source_size") > 0,
                F.floor(F.col("whole") / F.col("source_size")) * F.col("per_round")
                + F.ceil(F.col("whole") % F.col("source_size") / block),
            ).otherwise(0),
        ),
        "targets",
    )
    known = targets.select(F.col("source").alias("known"), "rank", "source_size", "target", "per_round")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("known"))).withColumn("part", F.pmod("order", F.lit(parts)))
    in_part = Window.partitionBy("rank", "part").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("rank", "part").agg(F.sum("size").alias("n"))
        .select("rank", "part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("offset"))
    )
    placed = cut(
        placed.withColumn("begin", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
        .join(offsets, ["rank", "part"])
        .select("rank", "doc_id", "row", "order", "size", "source_size", "target", (F.col("offset") + F.col("begin")).alias("begin")),
        "placed",
    )
    pieces = (
        placed.where("size > 0")
        .withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
        .select("rank", "doc_id", "row", "size", "begin", F.col("b").alias("blk"))
    )
    slots = (
        schedule(targets.select("rank", "blocks"))
        .join(targets.select("rank", "source_size", "per_round", "whole"), "rank")
        .withColumn("blk", F.col("k") % F.col("per_round"))
        .withColumn("before", F.floor(F.col("k") / F.col("per_round")) * F.col("source_size") + F.col("blk") * block)
        .withColumn("words", F.least(F.lit(block), F.col("source_size") - F.col("blk") * block, F.col("whole") - F.col("before")))
        .where("words > 0")
        .select("rank", "slot", "blk", "words")
    )
    low = F.greatest(F.col("begin"), F.col("blk") * block)
    high = F.least(F.col("begin") + F.col("size"), F.col("blk") * block + F.col("words"))
    draws = (
        pieces.join(slots, ["rank", "blk"])
        .withColumn("low", low)
        .withColumn("n", high - low)
        .where("n > 0")
        .select("slot", "row", "doc_id", (F.col("low") - F.col("begin")).alias("start"), F.col("n").alias("words"))
    )
    taken = draws.groupBy("row").agg(F.sum("words").alias("got"), F.min("slot").alias("first_slot"), F.count("*").alias("draws"))
    documents = placed.join(taken, "row", "left").select(
        "doc_id", "row", "order", "size", "source_size", "target",
        F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("draws", F.lit(0)).alias("draws"),
    )
    return documents, draws, targets


def _order(doc_id: str, text: str, source: str, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col(source))


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **settings
) -> DataFrame:
    """Whole documents of the mix, in its order: every row as often as the mix takes most of it.

    A document is in as many times as the words taken from it, divided by its size and rounded;
    those that the mix takes less than half of are out. Documents without words stay once, at the
    end. All columns of ``docs`` are returned, whatever their names; rows that are equal share what
    the mix takes of them. Rows come sorted by slot of the schedule (the i-th time that a document is
    in by the i-th part of its slots), so that files written from them hold the mixed stream. As a
    source's blocks are taken whole but for its last one, its words differ from its target by
    less than its longest document.
    """
    documents, draws, _ = _mix(docs, doc_id, text, source, seed=seed, **settings)
    slots = draws.groupBy("row").agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # its blocks, max_repeats times
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    # equal rows have one key: how many of them are in how often, a few kinds at most
    kind = F.struct((-F.col("n")).alias("less"), "n", "c", "slots")
    times = (
        documents.join(slots, "row", "left")
        .select(F.coalesce("doc_id", F.lit(0)).alias("__mix_id"), F.col("order").alias("__mix_order"), n.alias("n"), "first_slot", "slots")
        .groupBy("__mix_id", "__mix_order", "n")
        .agg(F.count("*").alias("c"), F.min_by("slots", "first_slot").alias("slots"))
        .groupBy("__mix_id", "__mix_order")
        .agg(F.sort_array(F.collect_list(kind)).alias("__mix_kinds"))
    )
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    keyed = docs.select(
        "*", F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("__own_id"), _order(doc_id, text, source, seed).alias("__own_order"),
        F.xxhash64(*hashed).alias("__own_all"),
    )
    joined = keyed.join(times, (F.col("__own_id") == F.col("__mix_id")) & (F.col("__own_order") == F.col("__mix_order")))
    # the window needs no exchange after the join; the k-th of equal rows is of the kind that it falls to
    joined = joined.withColumn("__own_k", F.row_number().over(Window.partitionBy("__own_id", "__own_order").orderBy("__own_all")).cast("long"))
    none = F.expr("cast(null as struct<less:int,n:int,c:bigint,slots:array<bigint>>)")
    found = F.aggregate(
        "__mix_kinds",
        F.struct(F.col("__own_k").alias("left"), none.alias("hit")),
        lambda acc, x: F.struct(
            (acc["left"] - x["c"]).alias("left"), F.when(acc["hit"].isNull() & (acc["left"] <= x["c"]), x).otherwise(acc["hit"]).alias("hit")
        ),
        lambda acc: acc["hit"],
    )
    joined = joined.withColumn("__mix", found)
    slot = F.col("__mix.slots")[F.floor(F.col("__mix_i") * F.size("__mix.slots") / F.col("__mix.n")).cast("int")]
    return (
        joined.where("__mix.n > 0")
        .withColumn("__mix_i", F.explode(F.sequence(F.lit(0), F.col("__mix.n") - 1)))
        .withColumn("__mix_slot", slot)
        .orderBy(F.col("__mix_slot").asc_nulls_last(), "__mix_order", "__own_k", "__mix_i")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
