"""Words and word shingles of Arrow text batches as 64-bit hashes.

A word is a longest run of ASCII letters and digits and of non-ASCII
characters, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z is lower-cased.
Every byte of a non-ASCII character is at least 0x80, so words can be found on
the UTF-8 bytes of a batch without making Python strings: one table look-up per
byte, one grouped sum per word. Two words with equal 64-bit hashes count as the
same word; equal 64-bit shingle hashes as the same shingle.

Texts are worked through in pieces of about a megabyte that end between two
words, so memory does not depend on the length of a text or of a batch beyond
eight bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit pseudo-random numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def _byte_values() -> np.ndarray:
    values = stream(0x5EED, 256) | _U(1)
    b = np.arange(256)
    word = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    values[~word] = 0
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


_BYTE = _byte_values()
_ISWORD = _BYTE != 0
_RADIX = _U(0x9FB21C651E98DF25)


class _Powers:
    """Powers of the radix, grown on demand (at most the longest word seen)."""

    table = np.ones(1, dtype=_U)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            size = 1 << max(6, int(n - 1).bit_length())
            table = np.empty(size, dtype=_U)
            table[0] = 1
            with np.errstate(over="ignore"):
                table[1:] = _RADIX
                np.multiply.accumulate(table, out=table)
            cls.table = table
        return cls.table


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the buffer that end at a row's end or between two words."""
    a, total = 0, len(buf)
    while a < total:
        b = min(total, a + PIECE)
        while b < total:
            k = np.searchsorted(offsets, b, side="right") - 1
            if offsets[k] > a:  # a row starts in the piece: cut there
                b = int(offsets[k])
                break
            gap = np.flatnonzero(~_ISWORD[buf[a:b]])
            if len(gap):
                b = a + int(gap[-1]) + 1
                break
            b = min(total, b + PIECE)
        yield a, b
        a = b


def words(buf: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (),
          places: bool = False):
    """Hashes of all words of the rows, and how many words each row has.

    Returns ``(hashes, counts)``; with ``prefixes`` also a list of arrays with
    the hash of the first k bytes of every word (0 where the word is shorter
    than k bytes; a hash over bytes, so a character may be cut); with ``places``
    also the byte where each word starts.
    """
    hashes: list[np.ndarray] = []
    cut: list[list[np.ndarray]] = [[] for _ in prefixes]
    at: list[np.ndarray] = []
    starts_of_rows = offsets[:-1]
    with np.errstate(over="ignore"):
        for a, b in _pieces(buf, offsets):
            piece = buf[a:b]
            is_word = _ISWORD[piece]
            before = np.empty_like(is_word)
            before[0] = False
            before[1:] = is_word[:-1]
            i, j = np.searchsorted(starts_of_rows, [a, b])
            before[starts_of_rows[i:j] - a] = False
            starts = np.flatnonzero(is_word & ~before)
            if not len(starts):
                continue
            spans = np.diff(np.append(starts, len(piece)))
            rest = piece[starts[0]:]
            pos = np.arange(len(rest), dtype=np.int64) - np.repeat(starts - starts[0], spans)
            value = _BYTE[rest]
            # A gap after a word has value 0; only the longest word needs a power.
            lengths = np.add.reduceat((value != 0).astype(np.int64), starts - starts[0])
            powers = _Powers.upto(int(lengths.max()))
            np.minimum(pos, len(powers) - 1, out=pos)
            value *= powers[pos]
            hashes.append(mix64(np.add.reduceat(value, starts - starts[0])))
            for k, out in zip(prefixes, cut):
                p = mix64(np.add.reduceat(np.where(pos < k, value, _U(0)), starts - starts[0])
                          + _U(k))
                p[lengths < k] = 0
                out.append(p)
            at.append(starts + a)
    if not hashes:
        none = np.zeros(0, _U)
        return (none, np.zeros(len(offsets) - 1, np.int64),
                *([[none for _ in prefixes]] if prefixes else []),
                *([np.zeros(0, np.int64)] if places else []))
    where = np.concatenate(at)
    counts = np.diff(np.searchsorted(where, offsets))
    return (np.concatenate(hashes), counts,
            *([[np.concatenate(c) for c in cut]] if prefixes else []),
            *([where] if places else []))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of each row, in order, and their number.

    A row with fewer than ``n`` words (but at least one) has one shingle of all
    its words; a row without words has none.
    """
    ends = np.cumsum(counts)
    total = len(hashes)
    number = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    if total == 0:
        return np.zeros(0, _U), number
    radix = stream(0x51, n)
    with np.errstate(over="ignore"):
        runs = max(0, total - n + 1)
        full = np.zeros(runs, _U)
        for j in range(n):
            full += hashes[j:j + runs] * radix[j]
        starts = ends - counts
        out_starts = np.cumsum(number) - number
        rows = np.repeat(np.arange(len(counts)), number)
        pos = np.arange(number.sum()) - out_starts[rows] + starts[rows]
        long_row = (counts >= n)[rows]
        out = np.empty(len(pos), _U)
        out[long_row] = full[pos[long_row]]
        for k in np.flatnonzero((counts > 0) & (counts < n)):
            w = hashes[starts[k]:ends[k]]
            out[out_starts[k]] = (w * radix[:len(w)]).sum(dtype=_U) + _U(len(w))
    return mix64(out), number


def slices(offsets: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer row on its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def row_shingles(column, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row of a text column."""
    buf, offsets = text_bytes(column)
    for i, j in slices(offsets):
        h, c = words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        s, m = shingles(h, c, n)
        ends = np.cumsum(m)
        for k in range(j - i):
            yield i + k, np.unique(s[ends[k] - m[k]:ends[k]])
