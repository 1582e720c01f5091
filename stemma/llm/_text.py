"""Vectorised word hashing over Arrow string buffers.

A batch's texts stay one UTF-8 buffer; words become 64-bit hashes without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once, unless one word is longer.
SEGMENT = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _table(is_word, lower: bool) -> np.ndarray:
    # UTF-8 has no byte 0xFF, so every word byte can move up by one and 0 is left for separators.
    return np.array([((b + 32 if lower and 65 <= b <= 90 else b) + 1) & 255 if is_word(b) else 0 for b in range(256)], np.uint8)


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text with A-Z lower-cased.
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, True)
#: Words [^\x20\x09-\x0D]+ as they stand, and with A-Z lower-cased.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13, False)
SPACED_LOWER = _table(lambda b: b != 32 and not 9 <= b <= 13, True)

_powers = [np.ones(1, U), np.ones(1, U)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, SEGMENT)
        for k, p in enumerate((_P, _P_INV)):
            step = np.full(n, p, U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of the texts in them; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last+1 byte of each word, and each text's range of words."""
    n = len(data)
    hashes, firsts, lasts = [], [], []
    at = 0
    breaks = offsets[1:-1]
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:  # not inside a word
            look = np.flatnonzero(table[data[end - 1 : end + SEGMENT]] == 0)
            k = np.searchsorted(breaks, end)
            stop = min(n, end - 1 + int(look[0]) + 1 if len(look) else end + SEGMENT)
            if k < len(breaks) and breaks[k] <= stop:
                end = int(breaks[k])
                break
            end = stop
            if len(look):
                break
        x = table[data[at:end]]
        on = x != 0
        before = np.empty_like(on)
        before[0] = False
        before[1:] = on[:-1]
        lo, hi = np.searchsorted(breaks, [at, end])
        cuts = breaks[lo:hi] - at
        before[cuts] = False
        s = np.flatnonzero(on & ~before)
        after = np.empty_like(on)
        after[-1] = False
        after[:-1] = on[1:]
        inner = cuts[cuts > 0]
        after[inner - 1] = False
        e = np.flatnonzero(on & ~after) + 1
        pw, inv = _grow(end - at)
        total = np.cumsum(x * pw[: end - at], dtype=U)
        h = total[e - 1]
        h[1:] -= total[s[1:] - 1]
        if len(s) and s[0]:
            h[0] -= total[s[0] - 1]
        hashes.append(mix(h * inv[s] + (e - s).astype(U)))
        firsts.append(s + at)
        lasts.append(e + at)
        at = end
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets)


def grams(h: np.ndarray, ranges: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles that start at each word, and whether the shingle ends within its text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    g = np.full(n, (seed * _P + k) & (2**64 - 1), U)
    for i in range(k):
        g = mix(g + h[i : i + n])
    ok = np.ones(n, bool)
    for i in range(1, k):
        back = ranges[1:-1] - i
        ok[back[(back >= 0) & (back < n)]] = False
    return g, ok


def hash_words(items: list[bytes]) -> np.ndarray:
    """The hash that words() gives each of these words; bytes must be lower-cased already."""
    data = np.frombuffer(b"".join(items), np.uint8) if items else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    return words(data, offsets, np.array([(b + 1) & 255 for b in range(256)], np.uint8))[0]


def chunks(column: pa.Array, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many bytes together; a longer text stands alone."""
    size = np.diff(buffers(column)[1])
    at = total = 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(size):
        yield at, len(size)
