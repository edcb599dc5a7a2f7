import itertools

import pytest

from lexigrove.operators import dynamic
from lexigrove.operators.filters import OPERATORS, condition
from pyspark.sql import functions as F

ROWS = [
    (1, "5", 5, 5.5, True, ["a", "5"]),
    (2, "abc", 0, 0.0, False, []),
    (3, "", -3, 1e3, None, None),
    (4, None, None, None, True, ["b"]),
    (5, "1e1", 10, 10.0, False, ["a", None]),
]
SCHEMA = "id int, s string, i int, d double, b boolean, t array<string>"
FIELDS = {"s": 1, "i": 2, "d": 3, "b": 4, "t": 5}


def number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def equal(a, b):
    if isinstance(a, list) or isinstance(b, list):
        return a == b if isinstance(a, list) and isinstance(b, list) else (bool(a) == bool(b) if isinstance(a, bool) or isinstance(b, bool) else False)
    if isinstance(a, bool) or isinstance(b, bool):
        truth = lambda x: bool(x) and x != "0"
        return truth(a) == truth(b)
    if isinstance(a, str) and isinstance(b, str):
        return number(a) == number(b) if number(a) is not None and number(b) is not None else a == b
    if isinstance(a, str) or isinstance(b, str):
        s, n = (a, b) if isinstance(a, str) else (b, a)
        return number(s) == n if number(s) is not None else s == str(n)
    return a == b


def expected(value, op, given):
    numeric = not isinstance(value, (bool, list)) and number(value) is not None
    if op in ("=", "!="):
        return equal(value, given) == (op == "=")
    if op in (">", ">=", "<", "<="):
        if not numeric:
            return False
        a, b = number(value), number(given)
        return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    if op in ("in", "not in"):
        return isinstance(given, list) and any(equal(value, g) for g in given) == (op == "in")
    return isinstance(value, list) and any(x is not None and equal(x, given) for x in value) == (op == "contains")


GIVEN = {"=": [5, "5", "abc", True, False, 5.5], ">": [0, "4"], "in": [[5, "abc"], "5", []], "contains": ["a", "5", 5]}
GIVEN |= {"!=": GIVEN["="], ">=": GIVEN[">"], "<": GIVEN[">"], "<=": GIVEN[">"], "not in": GIVEN["in"], "not contains": GIVEN["contains"]}


def test_all_operators_on_all_types(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cases = [(f, op, v) for f, op in itertools.product(FIELDS, OPERATORS) for v in GIVEN[op]]
    columns = [condition({"and": [{"field": f, "op": op, "value": v}]}, df.schema).alias(f"c{k}") for k, (f, op, v) in enumerate(cases)]
    for row in df.select("id", *columns).collect():
        raw = next(r for r in ROWS if r[0] == row["id"])
        for k, (f, op, v) in enumerate(cases):
            value = raw[FIELDS[f]]
            want = value is not None and expected(value, op, v)
            assert row[f"c{k}"] == want, (value, op, v, row[f"c{k}"])


def test_blocks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ids = lambda f: [r.id for r in df.where(condition(f, df.schema)).orderBy("id").collect()]
    positive, true, absent = {"field": "i", "op": ">", "value": 0}, {"field": "b", "op": "=", "value": True}, {"field": "nowhere", "op": "!=", "value": 1}
    assert ids(None) == ids({}) == ids({"or": []}) == [1, 2, 3, 4, 5]
    assert ids({"and": [positive]}) == [1, 5]
    assert ids({"or": [positive, true]}) == [1, 4, 5]
    assert ids({"and": [positive], "or": [true, absent]}) == [1]
    assert ids({"and": [absent]}) == []
    with pytest.raises(ValueError):
        condition({"and": [{"field": "i", "op": "like", "value": 1}]}, df.schema)


def test_json_documents(spark):
    rows = [(1, '{"a": "red ring", "n": 5, "t": ["x", {"y": "deep blue"}], "z": null}'), (2, '{"a": 7, "t": []}'), (3, "not json"), (4, None)]
    index = dynamic.build(spark.createDataFrame(rows, "doc_id long, json string"))
    got = {r.doc_id: r.n_trigrams for r in index.documents.collect()}
    assert got == {1: 3 + 4 + 1 + 4 + 4, 2: 0, 3: 0, 4: 0}

    def ids(*fs):
        return sorted(r.doc_id for r in index.documents.where(dynamic.condition({"and": list(fs)})).collect())

    assert ids({"field": "n", "op": "=", "value": "5"}) == [1]
    assert ids({"field": "a", "op": "!=", "value": 7}) == [1]
    assert ids({"field": "t", "op": "contains", "value": "x"}) == [1]
    assert ids({"field": "z", "op": "=", "value": False}) == [1]  # null is present here
    assert ids({"field": "z", "op": "!=", "value": False}) == []
    assert ids({"field": "t", "op": "not contains", "value": "x"}) == [2]
    assert dynamic.strings(index.documents).where(F.col("value") == "deep blue").count() == 1


def test_strings_of_deep_json(spark):
    depth = 40
    docs = [(1, '{"a":' * depth + '"deep"' + "}" * depth), (2, "[" * depth + '"deeper", {"b": ["x"]}' + "]" * depth), (3, '"plain"'), (4, "not json"), (5, None), (6, "{}")]
    index = dynamic.build(spark.createDataFrame(docs, "id long, json string"), "id", "json")
    assert {r.doc_id: r.n_trigrams for r in index.documents.collect()} == {1: 4, 2: 7, 3: 5, 4: 0, 5: 0, 6: 0}
