"""Trigrams of whole columns of texts, by tables over their UTF-8 bytes.

The same as text.py's tokenize(), as ordinals, where documents are analysed: a JVM expression makes an object of
every trigram of a text, which is nearly all of the time that an index takes.  Here a text's bytes are mapped to the
37 characters of trigrams, three neighbours are one number, and the first of equal numbers of a document are kept.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import analyze as A
from .text import strip_tags

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(A)

BASE = len(A.ALPHABET)
TRIGRAMS = BASE**3
EDGE, NONE = BASE - 1, 255  #: codes of what separates words, and of a byte that stands for nothing
CHUNK = 1 << 19  #: bytes that are analysed at once, or one longer text


def _tables():
    """Codes of ASCII bytes, and up to three codes for each character of two or three bytes."""
    one, more = np.full(256, EDGE, np.uint8), np.full((1 << 16, 3), NONE, np.uint8)
    more[:, 0] = EDGE
    for code, text in A.CODES.items():
        if code < 128:
            one[code] = A.ALPHABET.index(text)
        else:
            more[code] = NONE
            more[code, : len(text)] = [A.ALPHABET.index(c) for c in text]  # no more of them than the character has bytes
    return one, more


ONE, MORE = _tables()


def codes(data):
    """A code for each byte of ``data``: of a letter or digit, EDGE, or NONE."""
    out, at = ONE[data], np.flatnonzero(data >= 0x80)
    if not len(at):
        return out
    data = np.append(data, np.zeros(2, np.uint8)).astype(np.uint16)
    lead, two, three = data[at], data[at + 1], data[at + 2]
    for size, ok in ((2, (lead >= 0xC2) & (lead < 0xE0) & (two & 0xC0 == 0x80)), (3, (lead & 0xF0 == 0xE0) & (two & 0xC0 == 0x80) & (three & 0xC0 == 0x80))):
        a, b, c = lead[ok], two[ok] & 63, three[ok] & 63
        found = MORE[(a & 31) << 6 | b if size == 2 else (a & 15) << 12 | b << 6 | c]
        for i in range(size):
            out[at[ok] + i] = found[:, i]
    return out


def _first(data, offs, owner, n: int):
    """(numbers, grams) of ``n`` documents: how many distinct trigrams each has, and these by first occurrence.

    Texts are data[offs[i]:offs[i + 1]], of document owner[i]; owners ascend.
    """
    code = codes(data)
    keep = code != NONE
    if not keep.all():
        offs = np.concatenate(([0], np.cumsum(keep)))[offs]
        code = code[keep]
    size = np.diff(offs)
    some = size > 0
    before, after = np.empty(len(code), np.int32), np.empty(len(code), np.int32)
    before[1:], after[:-1] = code[:-1], code[1:]
    before[offs[:-1][some]] = after[offs[1:][some] - 1] = EDGE
    at = np.flatnonzero(code != EDGE)
    if not len(at):
        return np.zeros(n, np.int64), np.zeros(0, np.int32)
    gram = (before[at] * BASE + code[at]) * BASE + after[at]
    doc = np.repeat(owner, size)[at]
    shift = np.int64(len(at)).item().bit_length()
    key = doc.astype(np.int64) * TRIGRAMS + gram
    if int(key[-1]) + TRIGRAMS < 1 << (62 - shift):
        key = np.sort(key << shift | np.arange(len(at)))
        first = np.sort(key[np.append(True, np.diff(key >> shift) != 0)] & ((1 << shift) - 1))
    else:
        first = np.sort(np.unique(key, return_index=True)[1])
    return np.bincount(doc[first], minlength=n), gram[first].astype(np.int32)


def distinct(column: pa.Array) -> pa.Array:
    """Ordinals of the distinct trigrams of each row's texts, without tags, by first occurrence; rows are texts or lists of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, texts = len(column), column
    starts = np.arange(n + 1)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        many = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts, texts = np.concatenate(([0], np.cumsum(many))), column.flatten()
    texts = texts.cast(pa.large_string()).fill_null("")
    refers = pc.match_substring(texts, "&")
    if pc.any(refers).as_py():
        texts = pc.replace_with_mask(texts, refers, pa.array([A.decode_entities(x) for x in texts.filter(refers).to_pylist()], pa.large_string()))
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    bounds = offs[starts]  # of each row's bytes
    sizes, grams, lo = [], [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK, "right")) - 1)
        a, z = starts[lo], starts[hi]
        own = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
        many, found = _first(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a], own, hi - lo)
        sizes.append(many)
        grams.append(found)
        lo = hi
    sizes = np.concatenate(([0], *sizes)).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int32)))


def ordinals(texts: Column, many: bool = False) -> Column:
    """Distinct trigrams of a text, or of an array of them (``many``), as ordinals in order of first occurrence; none for null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def analysed(column: pa.Array) -> pa.Array:
        return distinct(column)

    return analysed(F.transform(texts, strip_tags) if many else strip_tags(texts))


def spell(gram: Column) -> Column:
    """The trigram of an ordinal."""
    return F.concat(*[F.substring(F.lit(A.ALPHABET), (F.floor(gram / BASE**k) % BASE + 1).cast("int"), F.lit(1)) for k in (2, 1, 0)])


def spelled() -> list[str]:
    """All trigrams, by ordinal."""
    return [a + b + c for a in A.ALPHABET for b in A.ALPHABET for c in A.ALPHABET]
