"""Highlighting of the words of string fields that share a trigram with a query."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams as G
from ..functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matching(words: Column, trigrams: list[str]) -> Column:
    """For an array of words, whether each has one of the trigrams; all words of a text are analysed together."""
    wanted, distinct = np.isin(G.spelled(), trigrams), G.distinct  # workers need no copy of this package

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def found(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        grams = distinct(column.flatten())
        upto = np.concatenate(([0], np.cumsum(wanted[grams.flatten().to_numpy()])))
        has = np.diff(upto[grams.offsets.to_numpy()]) > 0
        many = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int32)
        offsets = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(has))

    return found(F.transform(words, X.strip_tags))


def highlight(col: Column, trigrams: list[str], tags: tuple[str, str] = ("<mark>", "</mark>"), excerpt: bool = True, window: int = 5) -> Column:
    """The field with its matching words between tags, or null if none matches or it is empty.

    Words are split at white space and joined by single spaces.  An excerpt holds ``window`` words on
    each side of the first match, with an ellipsis where something is cut off.
    """
    window = max(1, int(window))
    words = F.split(F.regexp_replace(col, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", ""), r"[ \t\n\x0B\f\r]+", -1)
    flags = matching(words, trigrams)
    shown = F.zip_with(words, flags, lambda w, has: F.when(has, F.concat(F.lit(tags[0]), w, F.lit(tags[1]))).otherwise(w))
    first = F.array_position(flags, True)
    if not excerpt:
        text = F.array_join(shown, " ")
    else:
        start = F.greatest(F.lit(1).cast("long"), first - window)
        end = F.least(F.size(words).cast("long"), first + window)
        text = F.concat(
            F.when(start > 1, F.lit("…")).otherwise(""),
            F.array_join(F.slice(shown, start.cast("int"), (end - start + 1).cast("int")), " "),
            F.when(end < F.size(words), F.lit("…")).otherwise(""),
        )
    return F.when((col != "") & (first > 0), text)


def highlights(schema: T.StructType, trigrams: list[str], **options) -> Column:
    """A map from each string field that matches to its highlighted text."""
    names = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if not names or not trigrams:
        return F.create_map().cast("map<string,string>")
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), highlight(F.col(f"`{n}`"), trigrams, **options))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())
