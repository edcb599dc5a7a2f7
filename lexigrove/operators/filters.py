"""Structured filters: {"and": [...], "or": [...]} of {"field", "op", "value"} as one condition.

All of "and" and, if there are any, one of "or" must hold.  A null field counts as absent: it fails
under "and", whatever the operator, and is passed over under "or".  Types are compared loosely, by
rules that are settled from the column's type and the literal's when the plan is built.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "contains", "not contains")


def _number(text) -> float | None:
    try:
        return float(text) if text.strip(" \t\n\r\v\f") == text.strip() and "_" not in text and text.strip().lower().lstrip("+-") not in ("inf", "infinity", "nan") else None
    except (ValueError, AttributeError):
        return None


def _text(value) -> str:
    if isinstance(value, bool):
        return "1" if value else ""
    return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else str(value)


def _equal(col: Column, kind: T.DataType, value) -> Column:
    """col = value in the loose sense, never null where col isn't."""
    if isinstance(value, (list, tuple, dict)):
        if not isinstance(kind, T.ArrayType) or isinstance(value, dict):
            return F.lit(False)
        same = [F.size(col) == len(value), *(_equal(F.get(col, F.lit(i)), kind.elementType, v) for i, v in enumerate(value))]
        return F.coalesce(reduce(lambda a, b: a & b, same), F.lit(False))
    if isinstance(kind, T.ArrayType):
        return (F.size(col) > 0) == F.lit(value) if isinstance(value, bool) else ((F.size(col) == 0) if value is None else F.lit(False))
    if isinstance(kind, T.BooleanType) or isinstance(value, bool) or (value is None and isinstance(kind, T.NumericType)):
        truth = bool(value) and value != "0"
        if isinstance(kind, T.BooleanType):
            return col == F.lit(truth)
        if isinstance(kind, T.StringType):
            return ~col.isin("", "0") == F.lit(truth)
        return (col != 0) == F.lit(truth)
    if value is None:
        return col == ""
    if isinstance(kind, T.NumericType):
        if isinstance(value, str):
            number = _number(value)
            return col.cast("string") == value if number is None else col.cast("double") == number
        return col == F.lit(value)
    if isinstance(value, str) and _number(value) is None:
        return col.cast("string") == value
    return F.coalesce(F.when(col.rlike(NUMERIC), col.try_cast("double")) == float(value), col.cast("string") == _text(value))


def _compare(col: Column, kind: T.DataType, op: str, value) -> Column:
    """An order comparison: false for fields that aren't numbers or strings of numbers."""
    if isinstance(kind, T.NumericType):
        left = col
    elif isinstance(kind, T.StringType):
        left = F.when(col.rlike(NUMERIC), col.try_cast("double"))
    else:
        return F.lit(False)
    if isinstance(value, str) and _number(value) is None:
        left, right = col.cast("string"), F.lit(value)
        left = F.when(col.cast("double" if isinstance(kind, T.NumericType) else "string").isNotNull(), left)
        if isinstance(kind, T.StringType):
            left = F.when(col.rlike(NUMERIC), left)
    elif isinstance(value, bool) or value is None:
        left, right = (left != 0).cast("int"), F.lit(int(bool(value)))
    elif isinstance(value, (list, tuple, dict)):
        return F.lit(op in ("<", "<="))  # an array is greater than any scalar
    else:
        right = F.lit(float(value) if isinstance(value, str) else value)
    out = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(out, F.lit(False))


def single(col: Column, kind: T.DataType, op: str, value) -> Column:
    """One filter on a field that is present."""
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator: {op!r}")
    if op in ("=", "!="):
        out = F.coalesce(_equal(col, kind, value), F.lit(False))
        return ~out if op == "!=" else out
    if op in (">", ">=", "<", "<="):
        return _compare(col, kind, op, value)
    if op in ("in", "not in"):
        if not isinstance(value, (list, tuple)):
            return F.lit(False)
        any_of = reduce(lambda a, b: a | b, [F.coalesce(_equal(col, kind, v), F.lit(False)) for v in value], F.lit(False))
        return ~any_of if op == "not in" else any_of
    if not isinstance(kind, T.ArrayType):
        return F.lit(False)
    has = F.coalesce(F.exists(col, lambda x: F.coalesce(_equal(x, kind.elementType, value), F.lit(False))), F.lit(False))
    return ~has if op == "not contains" else has


def condition(filters: dict | None, schema: T.StructType) -> Column:
    """The filters as one condition over columns of ``schema``; fields that aren't there are absent everywhere."""
    filters = filters or {}
    kinds = {f.name: f.dataType for f in schema.fields}

    def one(f: dict) -> Column:
        if f["op"] not in OPERATORS:
            raise ValueError(f"unknown filter operator: {f['op']!r}")
        if f["field"] not in kinds:
            return F.lit(False)
        col = F.col(f"`{f['field']}`")
        return col.isNotNull() & F.coalesce(single(col, kinds[f["field"]], f["op"], f["value"]), F.lit(False))

    out = reduce(lambda a, b: a & b, [one(f) for f in filters.get("and") or []], F.lit(True))
    either = [one(f) for f in filters.get("or") or []]
    return out & reduce(lambda a, b: a | b, either) if either else out
