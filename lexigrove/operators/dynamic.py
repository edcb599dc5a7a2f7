"""Documents without a schema, as JSON text: parsed to VARIANT, searched and filtered by their own types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams as G
from . import filters as P
from .index import Index, built

_STRING = r'"(?:[^"\\]++|\\.)*+":?'  #: a string in JSON text without white space; a name has a colon behind it


def texts(doc: Column) -> Column:
    """All strings of a variant, nested to any depth, as an array in the order of the document; null for null.

    A variant's text is one form of its JSON, in which every quote begins or ends a string, so that one expression
    finds them all, and no level is read for itself.
    """
    json = F.to_json(doc)
    found = F.filter(F.regexp_extract_all(json, F.lit(_STRING), F.lit(0)), lambda s: ~F.endswith(s, F.lit(":")))
    bare = F.transform(found, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
    read = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), T.ArrayType(T.StringType()))
    return F.when(F.contains(json, F.lit("\\")), read).otherwise(bare)


def strings(rows: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(key, at, value): all strings in the variant column, nested to any depth; at: their order in the document."""
    return rows.select(key, F.posexplode(texts(F.col(doc))).alias("at", "value"))


def build(df: DataFrame, id_col: str = "doc_id", json_col: str = "json", keep=None) -> Index:
    """An index over JSON texts; the documents have one field, the variant ``doc``.  What isn't JSON has no strings."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.try_parse_json(F.col(json_col)).alias("doc"))
    docs = docs.withColumn("_grams", G.ordinals(texts(F.col("doc")), True))
    return built(docs.withColumn("n_trigrams", F.size("_grams")), ("doc",), keep)


_KINDS = [("STRING", "string", T.StringType()), ("BIGINT", "long", T.LongType()), ("DOUBLE", "double", T.DoubleType()), ("BOOLEAN", "boolean", T.BooleanType())]


def condition(filters: dict | None, doc: str = "doc") -> Column:
    """Filters as a condition on a variant column.  Here a JSON null is present, unlike an absent field."""

    def one(f: dict) -> Column:
        if f["op"] not in P.OPERATORS:
            raise ValueError(f"unknown filter operator: {f['op']!r}")
        v = F.try_variant_get(F.col(doc), f"$['{f['field']}']", "variant")
        kind = F.schema_of_variant(v)
        out = F.lit(False)
        for name, sql, t in _KINDS:
            test = kind == name if name != "DOUBLE" else kind.rlike("^(DOUBLE|DECIMAL|FLOAT)")
            out = F.when(test, F.coalesce(P.single(F.try_variant_get(v, "$", sql), t, f["op"], f["value"]), F.lit(False))).otherwise(out)
        items = F.try_variant_get(v, "$", "array<string>")
        out = F.when(kind.startswith("ARRAY"), F.coalesce(P.single(items, T.ArrayType(T.StringType()), f["op"], f["value"]), F.lit(False))).otherwise(out)
        null = {"=": _null_equal(f["value"]), "!=": not _null_equal(f["value"])}
        if isinstance(f["value"], (list, tuple)):
            null |= {"in": any(map(_null_equal, f["value"])), "not in": not any(map(_null_equal, f["value"]))}
        return v.isNotNull() & F.when(kind == "VOID", F.lit(null.get(f["op"], False))).otherwise(out)

    filters = filters or {}
    out = reduce(lambda a, b: a & b, [one(f) for f in filters.get("and") or []], F.lit(True))
    either = [one(f) for f in filters.get("or") or []]
    return out & reduce(lambda a, b: a | b, either) if either else out


def _null_equal(value) -> bool:
    """Whether null equals a value in the loose sense."""
    return not value and value != "0"
