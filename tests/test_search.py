"""The search plan against a simulation of what it means, step by step."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import analyze as A
from lexigrove.operators import batch, retrieve
from lexigrove.operators.index import Index
from lexigrove.operators.index import build as lazy
from lexigrove.sources.workdir import written

WORDS = ["red", "green", "blue", "ring", "rings", "widget", "wide", "bolt", "bold", "gear", "plate", "late", "12", "x"]


def build(df):
    """An index whose tables are written down, as a stored one's are."""
    index = lazy(df, keep=lambda rows: written(rows, "test"))
    names = ("documents", "postings", "dictionary", "stats", "forward")
    own = {n: written(getattr(index, n).coalesce(2), "test") for n in names}
    return Index(own["documents"], own["postings"], own["dictionary"], own["stats"], None, index.fields, own["forward"])


def corpus(rng, n=40):
    out = {}
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
        out[i * 3] = {"name": text or None, "brand": rng.choice(["Acme", "Bolt & Co", "", None]), "size": rng.choice([None, 1, 5, 9]), "tags": rng.choice([None, [], ["red", "wide"], ["gear"]])}
    return out


def grams(value):
    if isinstance(value, str):
        return A.tokenize(value)
    if isinstance(value, list):
        return list(dict.fromkeys(g for v in value for g in grams(v)))
    return []


def simulate(docs, deleted, query, limit, cap, boosts, keep):
    own = {i: list(dict.fromkeys(g for v in d.values() for g in grams(v))) for i, d in docs.items()}
    lists = {}
    for i in docs:
        for g in own[i]:
            lists.setdefault(g, []).append(i)
    terms = sorted([g for g in A.tokenize(query) if g in lists], key=lambda g: len(lists[g]))
    if not terms:
        return []
    union = {}
    for g in terms:
        for i in lists[g][-cap:]:
            if i not in deleted:
                union[i] = union.get(i, 0) + 1
    both = {i: n for i, n in ((i, sum(i in lists[g][-cap:] for g in terms)) for i in lists[terms[0]][-cap:] if i not in deleted) if n == len(terms)}
    found = union if len(both) < limit else both
    n, average = max(1, len(docs)), sum(map(len, own.values())) / len(docs)
    most = math.log((n + 0.5) / 0.5 + 1) * 2.5

    def part(gs, length):
        norm = 0.25 + 0.75 * length / average
        return sum(math.log((n - len(lists[g]) + 0.5) / (len(lists[g]) + 0.5) + 1) * 2.5 / (1 + 1.5 * norm) for g in gs if g in terms)

    out = []
    for i, h in sorted(found.items(), key=lambda kv: -kv[1]):
        if len(out) >= limit:
            break
        if not keep(docs[i]):
            continue
        if boosts:
            fields = [(boosts.get(f, 1.0), A.tokenize(v)) for f, v in docs[i].items() if isinstance(v, str) and v]
            fields = [(b, g) for b, g in fields if g]
            weight = sum(b for b, _ in fields)
            s = sum(part(g, len(g)) / most * b for b, g in fields) / weight if weight else 0.0
        else:
            s = part(own[i], len(own[i])) / most
        out.append((i, round(min(s * 100, 100.0), 2), h))
    return sorted(out, key=lambda r: -r[1])


@pytest.mark.parametrize("seed", range(10))
def test_search_is_the_simulation(spark, seed):
    rng = random.Random(seed)
    docs = corpus(rng)
    df = spark.createDataFrame([(i, d["name"], d["brand"], d["size"], d["tags"]) for i, d in docs.items()], "doc_id long, name string, brand string, size int, tags array<string>")
    deleted = set(rng.sample(sorted(docs), rng.choice([0, 6])))
    index = build(df)
    if deleted:
        index = index.with_tombstones(spark.createDataFrame([(i,) for i in deleted], "doc_id long"))
    for _ in range(2):
        query = rng.choice(["widget red", "wdget", "bolt", "ring plate 12", "zzz", "x", "gear wide blue"])
        limit, cap = rng.choice([1, 4, 15, 100]), rng.choice([2, 7, 5000])
        boosts = rng.choice([None, {"name": 3.0, "brand": 0.5, "tags": 9.0}])
        filters, keep = rng.choice([(None, lambda d: True), ({"and": [{"field": "size", "op": ">", "value": 1}]}, lambda d: (d["size"] or 0) > 1)])
        got = [(r.doc_id, r.score, r.hits) for r in retrieve.search(index, query, limit, cap, boosts, filters).collect()]
        want = simulate(docs, deleted, query, limit, cap, boosts, keep)
        assert [(i, h) for i, _, h in got] == [(i, h) for i, _, h in want], (query, limit, cap, boosts)
        assert all(abs(a[1] - b[1]) < 0.011 for a, b in zip(got, want))


def test_many_is_one_by_one(spark):
    docs = corpus(random.Random(99))
    df = spark.createDataFrame([(i, d["name"], d["brand"]) for i, d in docs.items()], "doc_id long, name string, brand string")
    index = build(df)
    queries = ["widget red", "bolt", "", "ring plate 12"]
    many = retrieve.search_many(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), 5).collect()
    for q, text in enumerate(queries):
        one = [(r.doc_id, r.score) for r in retrieve.search(index, text, 5).collect()]
        assert [(r.doc_id, r.score) for r in sorted(many, key=lambda r: r["rank"]) if r.query_id == q] == one


@pytest.mark.parametrize("seed", range(4))
def test_many_queries_are_the_simulation(spark, monkeypatch, seed):
    monkeypatch.setattr(batch, "BLOCK", 2)  # several blocks, passes and products
    monkeypatch.setattr(batch, "PASS", 2)
    monkeypatch.setattr(batch, "DOCS", 7)
    rng = random.Random(100 + seed)
    docs = corpus(rng)
    df = spark.createDataFrame([(i, d["name"], d["brand"], d["size"], d["tags"]) for i, d in docs.items()], "doc_id long, name string, brand string, size int, tags array<string>").repartition(3)
    deleted = set(rng.sample(sorted(docs), rng.choice([0, 6])))
    index = build(df)
    if deleted:
        index = index.with_tombstones(spark.createDataFrame([(i,) for i in deleted], "doc_id long"))
    queries = ["widget red", "wdget", "bolt", "ring plate 12", "zzz", "x", "gear wide blue", "", "red green blue ring widget bolt gear plate late", None]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for limit, cap, boosts in ((3, 5000, None), (15, 7, {"name": 3.0}), (1, 2, None)):
        filters, keep = rng.choice([(None, lambda d: True), ({"and": [{"field": "size", "op": ">", "value": 1}]}, lambda d: (d["size"] or 0) > 1)])
        got = retrieve.search_many(index, table, limit, cap, boosts, filters).collect()
        for q, text in enumerate(queries):
            own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            want = simulate(docs, deleted, text or "", limit, cap, boosts, keep)
            assert [(r.doc_id, r.hits) for r in own] == [(i, h) for i, _, h in want], (text, limit, cap, boosts)
            assert all(abs(r.score - w[1]) < 0.011 for r, w in zip(own, want)) and [r["rank"] for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("steps", [2, 7, 512])
def test_where_the_cap_is_reached(spark, monkeypatch, steps):
    monkeypatch.setattr(batch, "STEPS", steps)
    rng = random.Random(steps)
    docs = {i * i + 5: " ".join(rng.choice(WORDS) for _ in range(4)) for i in range(60)}
    index = build(spark.createDataFrame(list(docs.items()), "doc_id long, name string"))
    have = {}
    for i, text in docs.items():
        for g in A.tokenize(text):
            have.setdefault(g, []).append(i)
    for most in (1, 5, 12, 1000):
        found = batch.since(index, most)
        assert all(found[batch._ordinal(g)] == (v[-most] if len(v) > most else -(1 << 63)) for g, v in have.items())


def test_plans(spark):
    """Candidates read postings once and no text; documents' texts are read for the rows that are left only."""
    df = spark.createDataFrame([(i, f"red {i}", i) for i in range(50)], "doc_id long, name string, size int")
    index = build(df)

    def scans(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return [re.sub("#[0-9]+L?", "", x) for x in re.findall(r"FileScan parquet \[([^]]*)\]", plan)]

    filters = {"and": [{"field": "size", "op": ">", "value": 3}]}
    assert sorted(scans(retrieve.search(index, "red", 5, filters=filters))) == ["doc_id,name,size,n_trigrams", "doc_id,size", "trigram,doc_id"]
    assert sorted(scans(retrieve.search(index, "red", 5).select("doc_id", "score"))) == ["doc_id,n_trigrams", "trigram,doc_id"]
    plan = retrieve.search(index, "red", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigram" in plan


def test_empty_corpus_and_limits(spark):
    index = build(spark.createDataFrame([], "doc_id long, name string"))
    assert retrieve.search(index, "red").collect() == []
    index = build(spark.createDataFrame([(1, "red")], "doc_id long, name string"))
    assert retrieve.search(index, "red", limit=0).collect() == []
    assert retrieve.search(index, "").collect() == []


def test_highlights(spark):
    text = "one two  three four five six red seven eight nine ten eleven twelve <b>red</b>"
    df = spark.createDataFrame([(1, text, "nothing", ""), (2, "red", None, "Red!")], "doc_id long, name string, other string, third string")
    index = build(df)
    got = {r.doc_id: r.highlights for r in retrieve.search(index, "red", highlight=True).collect()}
    assert got[1] == {"name": "…two three four five six <mark>red</mark> seven eight nine ten eleven…"}
    assert got[2] == {"name": "<mark>red</mark>", "third": "<mark>Red!</mark>"}
    got = {r.doc_id: r.highlights for r in retrieve.search(index, "red", highlight=True, highlight_options={"excerpt": False, "tags": ("[", "]")}).collect()}
    assert got[1]["name"] == "one two three four five six [red] seven eight nine ten eleven twelve [<b>red</b>]"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("trigram")).write.parquet(str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where(F.col("trigram").isin("w1", "w2"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(trigram" in plan
