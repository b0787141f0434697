"""Levenshtein distances of many pairs of texts at once, 64 rows of a table in each word (Myers, Hyyrö)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Words that a step of :func:`edits` works on at once; the arrays stay in a core's cache.
WORDS = 8192
ONE, LAST = np.uint64(1), np.uint64(63)


def _letters(text: str | bytes) -> np.ndarray:
    if isinstance(text, bytes):
        return np.frombuffer(text, np.uint8)
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both texts without what is common at their starts and then at their ends, which needs no edits."""
    n = min(len(x), len(y))
    unequal = x[:n] != y[:n]
    head = int(unequal.argmax()) if unequal.any() else n
    x, y, n = x[head:], y[head:], n - head
    unequal = x[len(x) - n :][::-1] != y[len(y) - n :][::-1]
    tail = int(unequal.argmax()) if unequal.any() else n
    return x[: len(x) - tail], y[: len(y) - tail]


def edits(pairs: Sequence[tuple[str | bytes, str | bytes]]) -> np.ndarray:
    """The least number of letters to insert, delete or change in each pair.

    Time goes with the product of the lengths over 64, memory with their sum. Pairs of about one length go
    together; what is left of a pair without common ends counts.
    """
    found, left = np.zeros(len(pairs), np.int64), []
    for i, (a, b) in enumerate(pairs):
        if a != b:
            x, y = trimmed(_letters(a), _letters(b))
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            found[i] = len(x)
            if len(y):
                left.append((i, x, y))
    left.sort(key=lambda p: -len(p[1]))
    while left:
        words = (len(left[0][1]) + 63) // 64
        part = sorted(left[: max(1, WORDS // words)], key=lambda p: -(len(p[2]) + (len(p[1]) - 1) // 64))
        left = left[len(part) :]
        found[[p[0] for p in part]] = _columns(words, [p[1] for p in part], [p[2] for p in part])
    return found


def _planes(texts: list[np.ndarray], length: int, letters: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of the letters' numbers: one array (text, place) for each bit."""
    narrow = letters.dtype == np.uint8  # then a table of all letters tells the numbers
    table = np.searchsorted(letters, np.arange(256)).astype(np.uint8) if narrow else None
    codes = np.zeros((len(texts), length), np.uint8 if narrow else np.uint32)
    for row, text in zip(codes, texts, strict=True):
        row[: len(text)] = table[text] if narrow else np.searchsorted(letters, text)
    return [(codes >> k & 1).astype(np.uint8) for k in range(bits)]


def _columns(words: int, longer: list[np.ndarray], shorter: list[np.ndarray]) -> np.ndarray:
    """Distances of texts of up to ``words`` words from shorter ones, in falling order of the step that ends a pair.

    A word of a column follows from the word above and the one of the column before. So in one step word w does the
    column w before that of word 0, and all words of all pairs are done by one operation on an array.
    """
    count, sizes = len(longer), np.array([len(y) for y in shorter])
    columns, last = int(sizes.max()), np.array([(len(x) - 1) // 64 for x in longer])
    ends = sizes + last
    every = np.concatenate([*longer, *shorter])
    letters = np.flatnonzero(np.bincount(every, minlength=256)).astype(np.uint8) if every.dtype == np.uint8 else np.unique(every)
    bits = max(1, int(len(letters) - 1).bit_length())
    # (word, pair) of the longer texts' bits; (place from the last, pair) of the shorter ones', all ones or none
    rows = [np.ascontiguousarray(np.packbits(p, axis=1, bitorder="little").view("<u8").T) for p in _planes(longer, words * 64, letters, bits)]
    across = []
    for plane in _planes(shorter, columns, letters, bits):
        wide = np.zeros((columns + 2 * words, count), np.uint64)
        wide[words : words + columns] = (0 - plane.T.astype(np.uint64))[::-1]
        across.append(wide)
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    more, less = np.zeros((words + 1, count), np.uint64), np.zeros((words + 1, count), np.uint64)  # what each word gets from the one above
    more[0] = ONE
    score = np.array([len(x) for x in longer], np.int64)
    at = ((score - 1) % 64).astype(np.uint64)
    spare = [np.empty((words, count), np.uint64) for _ in range(5)]
    live = count
    place = last * live + np.arange(live)
    for t in range(int(ends[0])):
        if t % 32 == 0:  # pairs that ended go
            alive = int(np.searchsorted(-ends, -t, side="left"))
            if alive < live:
                live = alive
                rows, across = [np.ascontiguousarray(r[:, :live]) for r in rows], [np.ascontiguousarray(a[:, :live]) for a in across]
                up, down, more, less = (np.ascontiguousarray(a[:, :live]) for a in (up, down, more, less))
                spare, at = [np.empty((words, live), np.uint64) for _ in range(5)], at[:live]
                place = last[:live] * live + np.arange(live)
        n = min(words, t + 1)  # words whose first column has come
        e, xv, xh, ph, mh = (s[:n] for s in spare)
        first = words + columns - 1 - t
        vp, vn, hp, hm = up[:n], down[:n], more[:n], less[:n]
        np.bitwise_xor(rows[0][:n], across[0][first : first + n], out=e)
        for r, a in zip(rows[1:], across[1:], strict=True):
            np.bitwise_xor(r[:n], a[first : first + n], out=xv)
            np.bitwise_or(e, xv, out=e)
        np.invert(e, out=e)
        np.bitwise_or(e, vn, out=xv)
        np.bitwise_or(e, hm, out=e)
        np.bitwise_and(e, vp, out=xh)
        np.add(xh, vp, out=xh)
        np.bitwise_xor(xh, vp, out=xh)
        np.bitwise_or(xh, e, out=xh)
        np.bitwise_or(xh, vp, out=ph)
        np.invert(ph, out=ph)
        np.bitwise_or(ph, vn, out=ph)
        np.bitwise_and(vp, xh, out=mh)
        on = (last[:live] <= t) & (ends[:live] > t)
        step = (spare[3].take(place) >> at & ONE).view(np.int64) - (spare[4].take(place) >> at & ONE).view(np.int64)
        score[:live] += step * on
        np.right_shift(ph, LAST, out=xh)
        np.right_shift(mh, LAST, out=e)
        np.left_shift(ph, ONE, out=ph)
        np.bitwise_or(ph, hp, out=ph)
        np.left_shift(mh, ONE, out=mh)
        np.bitwise_or(mh, hm, out=mh)
        more[1 : n + 1], less[1 : n + 1] = xh, e
        np.bitwise_or(xv, ph, out=vp)
        np.invert(vp, out=vp)
        np.bitwise_or(vp, mh, out=vp)
        np.bitwise_and(ph, xv, out=vn)
    return score
