"""Text analysis as column expressions: markup, entities, accents, words, trigrams.

Everything here is built from JVM expressions, so that it stays inside Catalyst.  analyze.py has the
same functions for single Python strings, sql.py their DuckDB text, and grams.py the trigrams of whole
columns, which documents are analysed by.
"""

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import analyze as A

cloudpickle.register_pickle_by_value(A)  # for normalize_strict(): workers need no copy of this package

COMMENT = r"(?s)<!--.*?-->"
TAG = r"""<[^\s](?:[^'">]++|"[^"]*+"|'[^']*+')*+(?:>|$)"""
_AHEAD = "(?=(#[a-z0-9][a-z0-9#]|[a-z0-9]{2}[a-z0-9#]))"
COMBINING = r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]"


def strip_tags(text: Column) -> Column:
    """Removes tags and comments, without a space in their place."""
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(F.regexp_replace(text, COMMENT, ""), TAG, "")).otherwise(text)


def _map(pairs: dict) -> Column:
    """A constant map from strings to strings; as one literal it is folded once, and keeps plans short."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def decode_entities(text: Column) -> Column:
    """Replaces character references by what they amount to once a text is cleaned.

    Letters that transliterate() knows become those letters, marks that it drops vanish, and any
    other character becomes a space, as it separates words anyway.  A reference must end in ';';
    unknown names and invalid code points stay as they are.  One pass: what a reference yields is
    not read again.
    """
    pieces = F.split(text, "&", -1)

    def numeric(piece: Column) -> Column:
        code = F.coalesce(
            F.conv(F.regexp_extract(piece, "^#[xX]0*([0-9a-fA-F]{1,6});", 1), 16, 10).cast("int"),
            F.try_to_number(F.nullif(F.regexp_extract(piece, "^#0*([0-9]{1,7});", 1), F.lit("")), F.lit("9999999")).cast("int"),
        )
        valid = ((code >= 32) & (code < 127)) | code.isin(9, 10) | ((code >= 160) & ~code.between(0xD800, 0xDFFF) & (code <= 0x10FFFF) & ~code.between(0xFDD0, 0xFDEF) & (F.pmod(code, F.lit(65536)) < 65534))
        rest = F.regexp_replace(piece, "^#[0-9a-zA-Z]+;", "")
        return F.when(valid, F.concat(F.coalesce(F.try_element_at(_map(A.CODES), code.cast("string")), F.lit(" ")), rest)).otherwise(F.concat(F.lit("&"), piece))

    def named(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^([a-zA-Z][a-zA-Z0-9]*);", 1)
        return F.concat(F.coalesce(F.try_element_at(_map(A.NAMES), name), F.concat(F.lit("&"), name, F.lit(";"))), F.substring(piece, F.length(name) + 2, F.length(piece)))

    def one(piece: Column) -> Column:
        return F.when(F.startswith(piece, F.lit("#")), numeric(piece)).when(piece.rlike("^[a-zA-Z][a-zA-Z0-9]*;"), named(piece)).otherwise(F.concat(F.lit("&"), piece))

    decoded = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)  # most texts have none


def drop_marks(text: Column) -> Column:
    """Removes combining marks."""
    return F.regexp_replace(text, COMBINING, "")


def transliterate(text: Column) -> Column:
    """Accented letters, ligatures and A-Z as letters a to z."""
    for x, y in A.MULTI.items():
        text = F.replace(text, F.lit(x), F.lit(y))
    return F.translate(text, A.SINGLE_FROM, A.SINGLE_TO)


def clean(text: Column) -> Column:
    """Runs of anything but a-z and 0-9 as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalize(text: Column) -> Column:
    return clean(transliterate(drop_marks(decode_entities(strip_tags(text)))))


def words(normal: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def word_trigrams(word: Column) -> Column:
    """All runs of three characters of #word#."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit("#"), word, F.lit("#")), i, F.lit(3)))


def tokenize(text: Column) -> Column:
    """Distinct trigrams of the text's words, in order of first occurrence; none for null.

    One match for each trigram of #word##word#...#, found ahead of each place; none lies across two words.
    """
    marked = F.concat(F.lit("#"), F.replace(normalize(text), F.lit(" "), F.lit("##")), F.lit("#"))
    return F.coalesce(F.array_distinct(F.regexp_extract_all(marked, F.lit(_AHEAD), F.lit(1))), F.array().cast("array<string>"))


def ordinal(trigram: Column) -> Column:
    """The trigram's place in the order of all trigrams over a-z, 0-9 and #; null if it isn't one."""
    digits = [F.instr(F.lit(A.ALPHABET), F.substring(trigram, i, 1)) - 1 for i in (1, 2, 3)]
    value = digits[0] * 37 * 37 + digits[1] * 37 + digits[2]
    return F.when(trigram.rlike("^[a-z0-9#]{3}$"), value)


def normalize_strict(text: Column) -> Column:
    """normalize() with composition (NFC) in place of dropping marks; needs Python workers."""

    @F.pandas_udf("string")
    def strict(text):
        import pandas as pd

        return pd.Series([None if x is None else A.normalize(x, True) for x in text])

    return strict(text)
