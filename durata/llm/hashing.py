"""Words and word n-grams of whole texts as 64-bit hashes, in numpy.

A block of documents becomes one byte buffer; words, their places and their
hashes come out of a few array operations.  ASCII capitals fold to small
letters.  The hash of a word is a polynomial over random 64-bit byte codes,
mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SEGMENT = 1 << 20
_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)


def _byte_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: Maximal runs of bytes other than space and 0x09-0x0D.
SPACED = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Maximal runs of ASCII letters, digits and bytes of non-ASCII characters.
ALNUM = _byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def _codes() -> np.ndarray:
    t = np.random.default_rng(20_240_601).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


_CODES = _codes()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """r ** i and r ** -i for i < n, modulo 2 ** 64; kept between calls."""
    if len(_powers[0]) < n:
        r, inv = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2 ** 64)
        for k, base in enumerate((r, inv)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _segments(a: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a buffer at non-word bytes, about SEGMENT apart."""
    at, n = 0, len(a)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:
            gaps = np.flatnonzero(~is_word[a[end - 1:end + SEGMENT]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(n, end + SEGMENT)
        yield at, end
        at = end


def word_hashes(buf: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte places) and hashes of the words of ``buf``."""
    whole = np.frombuffer(buf, np.uint8)
    parts = []
    for lo, hi in _segments(whole, is_word):
        a = whole[lo:hi]
        edge = np.diff(is_word[a].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_CODES[a] * up[:len(a)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        parts.append((s + lo, e + lo, mix(h + (e - s).astype(np.uint64) * _ROOT)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Words:
    """The words of a block of texts: ``hash``, ``start``, ``end`` of each
    (byte places in ``buf``), ``doc`` (index of its text), and ``first``, the
    index of each text's first word with the total at the end."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray = SPACED):
        self.buf = b"\n".join(texts) + b"\n"
        self.start, self.end, self.hash = word_hashes(self.buf, is_word)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.base)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on; the last k - 1 places of
    ``h`` are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = mix(np.full(n, k, np.uint64))
    for j in range(k):
        g = mix(g + h[j:n + j])
    return g


def blocks(texts: Iterable[bytes], limit: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts holding about ``limit`` bytes each."""
    yield from _cuts(map(len, texts), limit)


def _cuts(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    at = size = n = 0
    for n, t in enumerate(sizes, 1):
        size += t + 1
        if size >= limit:
            yield at, n
            at, size = n, 0
    if at < n:
        yield at, n


def text_blocks(column, limit: int = 4 * SEGMENT) -> Iterator[tuple[int, int, list[bytes]]]:
    """``blocks`` of an Arrow string column with their texts as ``utf8``; only
    one block's texts are Python objects at a time."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in _cuts(sizes, limit):
        yield lo, hi, utf8(column.slice(lo, hi - lo))


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null counts as empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
