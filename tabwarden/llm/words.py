"""Words of whole texts, cut at byte level: a lookup table over the UTF-8 bytes of many texts laid end to end.

ASCII bytes and the bytes of other characters never mix in UTF-8, so a class of characters that holds some ASCII characters and
all others is a class of bytes, and a word found by bytes is a word found by characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are cut at once; a word is never cut in two.
WINDOW = 4 << 20


def lookup(digits: bool) -> np.ndarray:
    """For each byte what it is in a word: A-Z as a-z, letters, bytes from 0x80 on (and digits) as they are, 0 for what stands between words."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


@dataclass
class Cut:
    """Words of a window: bytes in lower case, where each word starts and ends in them, and the text it is of."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def cuts(texts: pa.Array, table: np.ndarray, window: int = WINDOW) -> Iterator[Cut]:
    """The words of an array of texts in order, window by window. A null text has none."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, stop = int(offsets[0]), int(offsets[-1])
    if texts.null_count:  # a null may have bytes under it
        sizes = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        data = np.concatenate([data[o : o + s] for o, s in zip(offsets[:-1], sizes)])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        at, stop = 0, int(offsets[-1])
    while at < stop:
        until = min(stop, at + window)
        if until < stop:
            until = whole_words(data, table, offsets, at, until, stop)
        low = table[data[at:until]]
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # A text's first byte starts a word of its own, whatever the text before it ends in.
        heads = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, until, "left")] - at
        first[heads] = inside[heads]
        last[heads - 1] = inside[heads - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Cut(low.tobytes(), start, end, np.searchsorted(offsets, start + at, "right") - 1)
        at = until


def whole_words(data: np.ndarray, table: np.ndarray, offsets: np.ndarray, at: int, until: int, stop: int) -> int:
    """Where a window may end: behind the last byte that is in no word, or at the start of a text; for a word longer than the window, behind it."""
    head = int(offsets[np.searchsorted(offsets, until, "right") - 1])
    gaps = np.flatnonzero(table[data[max(at, head) : until]] == 0)
    if len(gaps):
        return max(at, head) + int(gaps[-1]) + 1
    if head > at:
        return head
    end = int(offsets[np.searchsorted(offsets, until, "right")])  # the text's end, past texts without bytes
    while until < end:
        gaps = np.flatnonzero(table[data[until : min(end, until + WINDOW)]] == 0)
        if len(gaps):
            return until + int(gaps[0]) + 1
        until = min(end, until + WINDOW)
    return min(end, stop)


def grouped(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """(group of each word, a word of each group): words with the same bytes are a group.

    Words group by their hash; each is then compared, byte by byte, with the one that stands for its group, and those that differ
    get groups of their own.
    """
    n = len(cut.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    told = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(told, words_of(cut, np.arange(n))), np.uint64, n)
    _, chosen, group = np.unique(hashes, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~alike(cut, np.arange(n), chosen[group]))
    if len(odd):
        more, known = chosen.tolist(), {}
        for i in odd.tolist():
            word = cut.raw[cut.start[i] : cut.end[i]]
            if word not in known:
                known[word] = len(more)
                more.append(i)
            group[i] = known[word]
        chosen = np.array(more)
    return group, chosen


def alike(cut: Cut, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and words b, taken by pairs, have the same bytes: compared eight bytes at a time."""
    raw = np.frombuffer(cut.raw + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    size = cut.end - cut.start
    same = size[a] == size[b]
    live, at = np.flatnonzero(same & (a != b)), 0
    while len(live):
        left = np.minimum(size[a[live]] - at, 8)
        x, y = (eight[cut.start[z[live]] + at] for z in (a, b))
        differ = ((x != y) & (np.arange(8) < left[:, None])).any(axis=1)
        same[live[differ]] = False
        live = live[~differ & (left == 8)]
        at += 8
        live = live[size[a[live]] > at]
    return same


def tallied(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, how often each occurs, and the sum of each value over its occurrences."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begin], np.diff(np.append(begin, len(keys))), *(np.add.reduceat(v[order], begin) for v in values)


def words_of(cut: Cut, chosen: np.ndarray) -> list[bytes]:
    raw = cut.raw
    return [raw[s:e] for s, e in zip(cut.start[chosen].tolist(), cut.end[chosen].tolist())]


def word_array(cut: Cut, chosen: np.ndarray) -> pa.Array:
    """The chosen words as an array of texts."""
    return pa.array(words_of(cut, chosen), pa.binary()).cast(pa.string())
