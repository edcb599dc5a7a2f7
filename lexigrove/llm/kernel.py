"""Vectorised text kernels over Arrow string buffers.

Every kernel works on a whole chunk of UTF-8 texts at once: bytes are classified by table, words are
found from the edges of the class mask, and words are hashed by eight bytes at a time, so no Python
object is made per word.  Hashes are 64 bits wide.  Each step of them is mixed, so that no pattern of
bytes or words makes two of them equal, as it does in polynomials modulo 2**64.
"""

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 19
LONG = 128  #: bytes of a word up to which it is hashed by eight bytes; longer ones one by one

WORD, SPACE = "word", "space"


def tables(kind: str):
    """(lower-casing table, mask of bytes inside a word) for a kind of word.

    word: digits, a-z and everything beyond ASCII.  space: everything but ASCII white space.
    """
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    mask = np.zeros(256, dtype=bool)
    if kind == WORD:
        mask[48:58] = mask[97:123] = mask[128:] = True
    else:
        mask[:] = True
        mask[[32, 9, 10, 11, 12, 13]] = False
    return low, mask


def mix(h):
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(base: int, n: int):
    p = np.full(n + 1, base % 2**64, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)  #: masks of the first n bytes of eight


def eights(text):
    """The eight bytes from each place of ``text`` on, as numbers; zeros follow its end."""
    padded = np.zeros(len(text) + 8, dtype=np.uint8)
    padded[: len(text)] = text
    return np.ndarray(len(text) + 1, "<u8", padded, 0, (1,))


def byte_hash(text, start, end, long: int = LONG):
    """Hashes of text[start:end] for arrays of places; beyond ``long`` bytes one by one."""
    view, size = eights(text), end - start
    h = mix((view[start] & _HEADS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    at, done = np.flatnonzero(size > 8), 8
    while len(at) and done < long:
        part = view[start[at] + done] & _HEADS[np.minimum(size[at] - done, 8)]
        h[at] = mix(mix(h[at] + part) ^ U(0xD6E8FEB86659FD93))
        done += 8
        at = at[size[at] > done]
    for i in at.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _join(a, b):
    return mix(a * U(0x9FB21C651E98DF25) + b * U(0xD1342543DE82EF95))


def window_hash(text, n: int):
    """Hashes of all n consecutive bytes, n at least 8: pieces of twice the size are joined from two."""
    m = len(text) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    piece, size = mix(eights(text)[: len(text) - 7]), 8
    while size * 2 <= n:
        piece = _join(piece[:-size], piece[size:])
        size *= 2
    return piece[:m] if size == n else _join(piece[:m], piece[n - size : n - size + m])


def chunks(column: pa.Array, most: int = CHUNK):
    """Yields (first row, row after the last, bytes, offsets) of pieces of a string column.

    A piece holds about ``most`` bytes, or one longer text.  Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a chunk: ``start``, ``end`` (bytes), ``hash``, ``doc`` (row), ``first`` (of each row, and the total); ``text``: the lower-cased chunk."""

    __slots__ = ("start", "end", "hash", "doc", "first", "text")

    def __init__(self, data, offs, tabs):
        low, mask = tabs
        text = low[data]
        n = len(text)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = mask[text]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = offs[:-1][offs[:-1] < n]
        begins[edge] = inside[edge]
        ends = np.zeros(n + 1, dtype=bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        last = offs[1:][offs[1:] > 0]
        ends[last] |= inside[last - 1]
        self.start, self.end = np.flatnonzero(begins[:n]), np.flatnonzero(ends)
        self.text, self.hash = text, byte_hash(text, self.start, self.end)
        self.first = np.searchsorted(self.start, offs, "left")
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def prefix(self, n: int):
        """Hashes of the words' first n bytes, eight at most."""
        return mix(eights(self.text)[self.start] & _HEADS[np.minimum(self.end - self.start, n)])

    def run(self, a: int, z: int) -> bytes:
        """Words a to z - 1, lower-cased, with a space between each two."""
        return b" ".join(self.text[s:e].tobytes() for s, e in zip(self.start[a:z].tolist(), self.end[a:z].tolist()))


def word_hash(word: str, kind: str = WORD) -> int:
    """The hash that Words gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(Words(data, np.array([0, len(data)]), tables(kind)).hash[0])


def grams(h, n: int):
    """Hashes of n consecutive word hashes, for every start (of rows taken together)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    c = powers(0xD1342543DE82EF95, n)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * c[j + 1]
    return mix(out ^ U(n * 0x632BE59BD9B4E019 % 2**64))


def within(doc, n: int):
    """Mask of the starts whose n words lie in one row."""
    return doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]


class Lookup:
    """Membership in a set of 64-bit hashes: a bitmap rejects nearly all, a sorted array decides."""

    def __init__(self, values):
        self.values = np.unique(np.asarray(values, dtype=np.uint64))
        self.bits = np.uint64(min(24, max(16, int(len(self.values)).bit_length() + 6)))
        self.map = np.zeros(1 << int(self.bits), dtype=bool)
        self.map[self.values >> (U(64) - self.bits)] = True

    def find(self, h):
        """(indexes of h that are members, their indexes in ``values``)"""
        at = np.flatnonzero(self.map[h >> (U(64) - self.bits)]) if len(self.values) else np.zeros(0, np.int64)
        k = np.searchsorted(self.values, h[at])
        k[k == len(self.values)] = 0
        ok = self.values[k] == h[at] if len(at) else np.zeros(0, bool)
        return at[ok], k[ok]


def signed(h):
    return h.view(np.int64)


def tidy(f):
    """f (over Arrow batches), and then the memory that it freed goes back to the system, as workers stay on."""

    def g(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return g
