"""Alignment of sequences to the reference beside their own site: minimizers, anchors, colinear chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.reference import with_slices

#: Bases by byte; what isn't A, C, G or T is in no k-mer.
BASES = np.full(256, 4, dtype=np.uint64)
for _letter, _code in zip(b"ACGTacgt", [0, 1, 2, 3, 0, 1, 2, 3], strict=True):
    BASES[_letter] = _code
TURN = str.maketrans("ACGT", "TGCA")
OUT = ["cid", "chrom", "pos", "svlen", "k_chrom", "k_start", "k_end", "strand", "anchors", "score"]
NEVER = np.uint64(2**63 - 1)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Hashes of 63 bits; different codes of up to 62 bits have different ones before the last shift."""
    h = codes + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1)


def _joined(there: np.ndarray, back: np.ndarray, size: int, there2: np.ndarray, back2: np.ndarray, size2: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of stretches, and of their reverse complements, from those of two neighbours of ``size`` and ``size2`` letters."""
    n = min(len(there), len(there2) - size)
    forth = (there[:n] << np.uint64(2 * size2)) | there2[size : size + n]
    return forth, back[:n] | (back2[size : size + n] << np.uint64(2 * size)), size + size2


def sequence_minimizers(bases: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, forward) of the k-mers with the least hash in some window of ``w`` in a row.

    A k-mer and its reverse complement hash alike; ``forward`` says which of the two it is. Of k-mers
    with equal hashes in a window all are taken. Sequences of fewer than ``w`` k-mers are one window.
    """
    letters = BASES[np.frombuffer(bases.encode("ascii", "replace"), dtype=np.uint8)]
    n = len(letters) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    strange = np.concatenate([[0], np.cumsum(letters > 3)])
    bad = strange[k:] > strange[:-k]
    # codes of 1, 2, 4, ... letters, put together to those of k
    there, back = letters & np.uint64(3), np.uint64(3) - (letters & np.uint64(3))
    size, codes, left = 1, None, k
    while left:
        if left & 1:
            codes = (there, back, size) if codes is None else _joined(*codes, there, back, size)
        left >>= 1
        if left:
            there, back, size = _joined(there, back, size, there, back, size)
    there, back = codes[0][:n], codes[1][:n]
    hashes = np.where(bad, NEVER, _mixed(np.minimum(there, back)))
    size = min(w, n)
    least = np.lib.stride_tricks.sliding_window_view(hashes, size).min(axis=1)
    around = np.pad(least, size - 1)  # windows that don't exist have a least hash of 0
    picked = (np.lib.stride_tricks.sliding_window_view(around, size).max(axis=1) == hashes) & ~bad
    at = np.flatnonzero(picked)
    return at, hashes[at].astype(np.int64), (there < back)[at]


def _thinned(found: tuple[np.ndarray, ...], bins: np.ndarray, crowded: int) -> tuple[np.ndarray, ...]:
    """Minimizers without those between the first and the last of over ``crowded`` alike in a bin."""
    at, hashes, forward = found
    if not len(at):
        return found
    order = np.lexsort((at, forward, hashes, bins))
    alike = np.all([c[order][1:] == c[order][:-1] for c in (hashes, forward, bins)], axis=0)
    group = np.concatenate([[0], np.cumsum(~alike)])
    stays = (np.bincount(group)[group] <= crowded) | ~np.concatenate([[False], alike]) | ~np.concatenate([alike, [False]])
    return tuple(c[order[stays]] for c in found)


def _anchors(ours: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the reference, place in the sequence, same direction) of each pair with equal hashes."""
    order = np.argsort(ours[1], kind="stable")
    at, hashes, forward = (c[order] for c in ours)
    low, high = np.searchsorted(hashes, theirs[1], "left"), np.searchsorted(hashes, theirs[1], "right")
    n = high - low
    mine = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(theirs[0], n), at[mine], np.repeat(theirs[2], n) == forward[mine]


def chains(r: np.ndarray, q: np.ndarray, k: int, gap: int, look_back: int, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """Colinear chains of anchors sorted by (r, q): (r_start, r_end, q_start, q_end, anchors, score).

    A chain's score counts the bases that its anchors add, ``k`` at most each, less one for a change
    of diagonal and one for each four bases of it. Both places must rise, by ``gap`` at most. The best
    chain comes first; the next ones have none of its anchors. Chains below ``least`` are left out. Ties
    go to the nearest predecessor and the first end.
    """
    n = len(r)
    rows, columns = r.tolist(), q.tolist()
    score, before, highest = [k] * n, [-1] * n, [k] * n  # the highest score up to an anchor bounds what earlier ones can give
    for i in range(1, n):
        low, best, at = max(0, i - look_back), k, -1
        for j in range(i - 1, low - 1, -1):
            if best >= highest[j] + k:
                break
            dr, dq = rows[i] - rows[j], columns[i] - columns[j]
            if dr > gap:
                break
            if 0 < dr and 0 < dq <= gap:
                lag = abs(dr - dq)
                value = score[j] + min(dr, dq, k) - lag // 4 - (lag > 0)
                if value > best:
                    best, at = value, j
        score[i], before[i], highest[i] = best, at, max(highest[i - 1], best)
    score = np.array(score, dtype=np.int64)
    used, found = np.zeros(n, dtype=bool), []
    for end in np.lexsort((np.arange(n), -score)):
        if used[end]:
            continue
        i, size, first = int(end), 0, int(end)
        while i >= 0 and not used[i]:
            used[i] = True
            first, size, i = i, size + 1, int(before[i])
        total = int(score[end] - (score[i] if i >= 0 else 0))
        if total >= least:
            found.append((int(r[first]), int(r[end]) + k, int(q[first]), int(q[end]) + k, size, total))
    return found


def extension(ours: str, theirs: str, drop: int) -> int:
    """How many bases two texts go on together from their starts, without gaps: where the score is best.

    An equal base scores 1, another -2; what is behind a fall of over ``drop`` isn't looked at.
    """
    n = min(len(ours), len(theirs))
    if not n:
        return 0
    a, b = (BASES[np.frombuffer(x[:n].encode("ascii", "replace"), dtype=np.uint8)] for x in (ours, theirs))
    score = np.cumsum(np.where((a == b) & (a < 4), 1, -2))
    fallen = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score > drop)
    score = score[: fallen[0]] if len(fallen) else score
    best = int(np.argmax(score))
    return best + 1 if score[best] > 0 else 0


def align_beside(
    insertions: DataFrame,
    blocks: DataFrame,
    block: int,
    k: int = 15,
    w: int = 10,
    similarity: float = 0.7,
    shift: int = 300,
    gap: int = 1000,
    look_back: int = 500,
    least: int = 40,
    drop: int = 30,
    crowded: int = 16,
    width: int = 4096,
) -> DataFrame:
    """Alignments of inserted sequences (cid, chrom, pos, seq) with the reference around their own place.

    Returns cid, chrom, pos, svlen (the sequence's length), k_chrom, k_start, k_end, strand, anchors, score;
    a row for each chain of shared minimizers. An alignment that begins or ends within ``shift`` of ``pos``
    and is as long as ``similarity`` asks for lies wholly in the stretch that is looked at. That stretch
    comes to its row from the table of reference blocks, so nothing but bases is shuffled, and a minimizer
    that is frequent in the genome meets only its occurrences there. One that is there over
    ``crowded`` times in a bin of ``width``, or in the inserted sequence, stands by its first and last place
    alone. Chains are extended at both ends base by base inside the stretch, as far as that scores
    best (see :func:`extension`).

    Rows with a null place or sequence, and sequences without a chain, have no alignments; rows that
    repeat have theirs each. What a task holds for a row is bounded by the sequence's length.
    """
    if k % 2 == 0 or not 3 <= k <= 31 or w < 1:
        raise ValueError("k must be odd and from 3 to 31, w at least 1")
    reach = F.lit(shift) + F.ceil(F.col("svlen") / similarity)
    rows = (
        insertions.where("chrom is not null and pos is not null and seq is not null")
        .select("cid", "chrom", F.col("pos").cast("long").alias("pos"), F.length("seq").cast("long").alias("svlen"), F.upper("seq").alias("_seq"))
        .withColumn("_low", F.greatest(F.col("pos") - reach, F.lit(0))).withColumn("_high", F.col("pos") + reach)
    )
    # with the bases of all windows over k-mers of the stretch
    rows = with_slices(rows, blocks, {"_bases": (F.col("chrom"), F.col("_low") - (w - 1), F.col("_high") + (w - 1))}, block).where("_bases <> ''")

    def aligned(seq: str, low: int, high: int, bases: str) -> Iterator[tuple]:
        first = max(0, low - (w - 1))
        here = bases[low - first : high - first].upper()
        at, *rest = sequence_minimizers(bases, k, w)
        inside = (at + first >= low) & (at + first + k <= high)
        at = at[inside] + first
        theirs = _thinned((at, *[c[inside] for c in rest]), at // width, crowded)
        ours = sequence_minimizers(seq, k, w)
        r, q, same = _anchors(_thinned(ours, np.zeros_like(ours[0]), crowded), theirs)
        for strand, mask in (("+", same), ("-", ~same)):
            text = seq if strand == "+" else seq.translate(TURN)[::-1]
            rs, qs = r[mask], q[mask] if strand == "+" else len(seq) - k - q[mask]
            order = np.lexsort((qs, rs))
            for start, end, q_start, q_end, n, score in chains(rs[order], qs[order], k, gap, look_back, least):
                front = extension(text[:q_start][::-1], here[: start - low][::-1], drop)
                yield start - front, end + extension(text[q_end:], here[end - low :], drop), strand, n, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = [], []
            for i, given in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_seq", "_low", "_high", "_bases")], strict=True)):
                for found in aligned(*given):
                    kept.append(i)
                    values.append(found)
            start, end, strand, n, score = zip(*values, strict=True) if values else ((),) * 5
            own = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("cid", "chrom", "pos", "svlen")]
            found = [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(strand, pa.string()), pa.array(n, pa.int64()), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, own[1], *found], names=OUT)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds.get(c, 'string' if c in ('k_chrom', 'strand') else 'long')}" for c in OUT)
    return rows.mapInArrow(run, schema)
