"""Substring dedup by level-wise doubling of repeated word windows.

A window of ``2 * w`` words can only repeat if each window of ``w`` words in it does. So windows are
first compared at a short length; those found in two documents alone are extended to twice that
length, and so on up to the length asked for or until none is left. At the first level it is enough
to compare one window of each neighbourhood, picked by its hash (the least of every ``w + 1`` hashes
in a row): equal stretches of ``2 * w`` words pick equal windows wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_group

#: What tells rows apart: the id, and a hash of id and text.
ROW = ["doc_id", "row_key"]
MULTIPLIERS = np.random.default_rng(23).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word -> its 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` words, by doubling: two halves make a window."""
    h = np.fromiter((WORDS[w] for w in words), dtype=np.uint64, count=len(words))
    return widen(h, width)


def widen(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of ``width`` items whose own hashes are ``h``; equal windows, equal hashes."""
    if len(h) < width:
        return np.empty(0, dtype=np.uint64)
    # powers of two are doubled; a width between them is two overlapping windows of the next lower one
    size, cur = 1, _mix(h)
    while size * 2 <= width:
        cur = _mix(cur[:-size] * MULTIPLIERS[0] + cur[size:] * MULTIPLIERS[1])
        size *= 2
    if size < width:
        step = width - size
        cur = _mix(cur[:-step] * MULTIPLIERS[2] + cur[step:] * MULTIPLIERS[3])
    return cur


def picked(h: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the least (last of equals) of some ``span`` hashes in a row; all of fewer hashes' least."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    if len(h) <= span:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], span)
    return np.unique(len(h) - 1 - (np.arange(len(view)) + view.argmin(axis=1)))


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, kind)]).astype(kind, copy=False)))


def _first_level(width: int, window: int):
    """(doc_id, row_key, text) -> (doc_id, row_key, n_words, sha256 of all words, hashes and positions of the picked windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, digests, hashes, positions = [], [], [], []
                for text in part.column(2).to_pylist():
                    words = words_of(text)
                    h = window_hashes(words, width) if len(words) >= window else np.empty(0, dtype=np.uint64)
                    p = picked(h, width + 1)
                    n.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    hashes.append(h[p].view(np.int64))
                    positions.append(p.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.string()),
                        _lists(hashes, np.int64), _lists(positions, np.int32),
                    ],
                    names=["doc_id", "row_key", "n_words", "sha", "hashes", "positions"],
                )

    return run


def _next_level(width: int):
    """(doc_id, row_key, text, positions of repeated windows of ``width``) -> with the windows of twice that holding one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hashes, positions = [], []
                for text, found in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    h = window_hashes(words_of(text), 2 * width)
                    mark = np.zeros(len(h) + 1, dtype=np.int32)
                    p = np.array(found)
                    np.add.at(mark, np.minimum(np.maximum(p - width, 0), len(h)), 1)
                    np.add.at(mark, np.minimum(p + 1, len(h)), -1)
                    starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    hashes.append(h[starts].view(np.int64))
                    positions.append(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], _lists(hashes, np.int64), _lists(positions, np.int32)],
                    names=["doc_id", "row_key", "text", "hashes", "positions"],
                )

    return run


def _strip(window: int):
    """(doc_id, row_key, text, starts) -> what is left of each text once the windows at ``starts`` are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                removed, digests, texts = [], [], []
                for text, starts in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = words_of(text)
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    starts = np.array(starts)
                    gone[starts] = 1
                    gone[starts + window] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "row_key", "n_gone", "rest_sha", "rest"],
                )

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """The hashes of (doc_id, row_key, hash, position) that two documents have: hash, first, size."""
    return cut(
        rows.groupBy("hash")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("size"))
        .where("first < last")
        .select("hash", "first", "size"),
        "shared",
    )


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("doc_id", "row_key", F.explode(F.arrays_zip("hashes", "positions")).alias("w")).select(
        "doc_id", "row_key", F.col("w.hashes").alias("hash"), F.col("w.positions").alias("position")
    )


def _spots(rows: DataFrame, name: str, later: bool = False) -> DataFrame:
    """Per (doc_id, row_key) the positions whose hash another document has; with ``later`` one with a smaller id."""
    found = with_group(rows, _shared(rows), ["hash"])
    if later:
        found = found.where("doc_id > first")
    return found.groupBy(*ROW).agg(F.collect_set("position").alias(name))


def remove_repeats(
    docs: DataFrame, window: int = 50, levels: int = 2, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Remove the words that windows cover which also start in a document with a smaller id.

    A window is ``window`` consecutive words of one document, judged on the input. Returns doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for,
    kept_text: the kept words, or null where nothing was removed.

    ``window`` must be divisible by 2 ** (levels - 1); the first level compares windows of
    ``window / 2 ** (levels - 1)`` words. Null, empty and blank texts have no words. Rows with a
    null id neither remove nor lose words. Rows that repeat an id are documents of their own with
    equal ids: each is returned once, and they don't remove from each other. Other columns aren't
    read. An empty table gives no rows.

    Documents with equal word sequences need no windows: all but the least id lose every word that
    a window covers. Hashes have 64 bits. Tasks see ranges of documents or of hashes; a frequent
    window is met by an aggregate and its rows by a broadcast of the few frequent ones. The texts of
    candidates are shuffled once, to meet their windows; rows are told apart by id and text.
    """
    found = _outcome(docs, window, levels, doc_id, text)
    columns = [F.col("doc_id").alias(doc_id), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
    return found.select(*columns)


def without_repeats(
    docs: DataFrame, window: int = 50, levels: int = 2, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None
) -> DataFrame:
    """``docs``, all columns, with the words gone that :func:`remove_repeats` removes.

    A document that loses words keeps the others joined by single spaces; one that loses all of them
    is out. Rows that lose none stay as they are, also those with null ids and texts; equal rows are
    each kept or cut alike. ``n_chars``: a column that holds the text's length, which follows where
    the text changes. Extra columns may have any names.
    """
    changed = _outcome(docs, window, levels, doc_id, text).where("n_removed > 0").dropDuplicates(ROW)
    changed = changed.select(
        F.col("doc_id").alias("__cut_id"), F.col("row_key").alias("__cut_key"), F.col("kept_text").alias("__cut_text")
    )
    key = _row_key(doc_id, text)
    joined = docs.withColumn("__own_key", key).join(
        changed, (F.col(doc_id).cast("long") == F.col("__cut_id")) & (F.col("__own_key") == F.col("__cut_key")), "left"
    )
    new = {text: F.coalesce("__cut_text", text)}
    if n_chars:
        new[n_chars] = F.coalesce(F.length("__cut_text").cast(docs.schema[n_chars].dataType), n_chars)
    return joined.where("__cut_text is null or __cut_text <> ''").select(
        *[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    )


def _row_key(doc_id: str, text: str) -> F.Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def _outcome(docs: DataFrame, window: int, levels: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, row_key, n_words, n_removed, kept_sha256 and kept_text of every row of ``docs``."""
    width = window >> (levels - 1)
    if width << (levels - 1) != window or width < 1 or levels < 2:
        raise ValueError("window must be divisible by 2 ** (levels - 1), and levels at least 2")
    # equal rows have equal keys, and equal results
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    kinds = "doc_id long, row_key long, n_words long, sha string, hashes array<long>, positions array<int>"
    each = cut(source.mapInArrow(_first_level(width, window), kinds), "picked")
    firsts = cut(
        each.where("doc_id is not null").groupBy("sha")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("size"))
        .where("first < last").select("sha", "first", "size"),
        "firsts",
    )
    copies = with_group(each.select(*ROW, "sha"), firsts, ["sha"]).where("doc_id > first").select(*ROW).distinct()
    each = cut(
        each.join(copies.withColumn("found", F.lit(True)), ROW, "left").withColumn("copy", F.coalesce("found", F.lit(False))).drop("found"),
        "sequences",
    )
    spots = _spots(_flat(each.where("not copy and doc_id is not null")), "positions")
    while True:
        # a key's rows are equal: one of them stands for all
        wider = cut(
            source.join(spots, ROW)
            .groupBy(*ROW).agg(F.first("text").alias("text"), F.first("positions").alias("positions"))
            .mapInArrow(_next_level(width), "doc_id long, row_key long, text string, hashes array<long>, positions array<int>"),
            "windows",
        )
        width *= 2
        if width == window:
            break
        spots = _spots(_flat(wider), "positions")
    rests = (
        wider.select(*ROW, "text")
        .join(_spots(_flat(wider), "starts", later=True), ROW)
        .mapInArrow(_strip(window), "doc_id long, row_key long, n_gone long, rest_sha string, rest string")
    )
    whole = F.col("copy") & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    return each.select(*ROW, "n_words", "sha", "copy").join(rests, ROW, "left").select(
        *ROW,
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("rest_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("rest")).alias("kept_text"),
    )
