"""Analysis by tables, postings in ranges, and what of a stored index is written."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexigrove import workload
from lexigrove.functions import analyze as A
from lexigrove.functions import grams as G
from lexigrove.operators import batch, dynamic, retrieve
from lexigrove.operators import index as I
from lexigrove.operators.highlight import highlight, matching
from lexigrove.plans.engine import SearchEngine
from lexigrove.sources.workdir import shared_dir, written

TABLES = "/root/testdata/sf0.001"


def texts(seed, n=400):
    bits = ["<p>", "<", ">", "&eacute;", "&amp;", "&#x301;", "&AElig;", "&bogus;", "&", ";", "é", "ß", "Œ", "ﬃ", "ﬁ", "日", "😀", "́", "A", "b", "7", "#", " ", "\n", "-", "€", "aa", "\x00", "İ"]
    rng = random.Random(seed)
    return [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n))]


@pytest.mark.parametrize("chunk", [40, 1 << 19])
def test_ordinals_are_the_tokens(spark, monkeypatch, chunk):
    monkeypatch.setattr(G, "CHUNK", chunk)
    df = spark.createDataFrame(list(enumerate(texts(1))), "i int, x string")
    rows = df.select("x", G.ordinals(F.col("x")).alias("g"), G.ordinals(F.array("x", F.lit("Red é"), "x"), True).alias("many"), F.transform(G.ordinals(F.col("x")), G.spell).alias("s"))
    names = G.spelled()
    for r in rows.collect():
        assert [names[g] for g in r.g] == r.s == A.tokenize(r.x), repr(r.x)
        assert [names[g] for g in r.many] == list(dict.fromkeys([*A.tokenize(r.x), *A.tokenize("Red é")]))


@pytest.mark.parametrize("part", [3, 1 << 19])
def test_postings_in_ranges(spark, monkeypatch, part):
    """All postings once, a trigram's together and by id; those of a frequent one in ranges of ids."""
    monkeypatch.setattr(I, "PART", part)
    rows = [(i * 7 - 50, x) for i, x in enumerate(texts(2, 60))] + [(None, "red")]
    index = I.build(spark.createDataFrame(rows, "doc_id long, x string"))
    found = [(r.trigram, r.doc_id) for r in I.clustered(index.forward, index.dictionary).collect()]
    want = [(t, i) for i, x in rows for t in A.tokenize(x)]
    assert sorted(found, key=repr) == sorted(want, key=repr) == sorted(((r.trigram, r.doc_id) for r in index.postings.collect()), key=repr)
    df = {r.trigram: r.df for r in index.dictionary.collect()}
    assert df == {t: sum(u == t for u, _ in want) for t, _ in want}


def test_only_what_a_query_asks_for_is_written(spark, monkeypatch):
    """trigram_idf reads two small tables; it made all postings and sorted them before."""
    monkeypatch.setattr(workload, "_written", {})
    base = shared_dir(spark).removeprefix("file://") + f"/{uuid.uuid4().hex}"
    monkeypatch.setattr(workload, "shared_dir", lambda spark: f"file://{base}")
    assert workload.QUERIES["trigram_idf"](spark, TABLES).count()
    (folder,) = os.listdir(base)
    assert sorted(os.listdir(f"{base}/{folder}")) == ["analysed", "dictionary", "stats"]
    assert workload.QUERIES["search_intersection"](spark, TABLES).count()
    assert sorted(os.listdir(f"{base}/{folder}")) == ["analysed", "dictionary", "postings", "stats"]


def test_words_of_a_text_are_analysed_together(spark):
    """Highlighting made plans of expressions by word, each with a text analysis of its own, twice."""
    rows = [(0, "x " * 300 + "Réd <b>red</b> rings&amp;re " + "y " * 300), (1, None), (2, ""), (3, "blue  sky"), (4, "  red")]
    df = spark.createDataFrame(rows, "i int, x string")
    shown = df.select("i", highlight(F.col("x"), A.tokenize("red"), excerpt=False).alias("h"), matching(F.split("x", " "), ["#re"]).alias("m"), highlight(F.col("x"), [], excerpt=True).alias("none"))
    got = {r.i: r for r in shown.collect()}
    assert got[0].h == "x " * 300 + "<mark>Réd</mark> <mark><b>red</b></mark> <mark>rings&amp;re</mark> " + "y " * 299 + "y" and got[4].h == "<mark>red</mark>"
    assert got[1].h is got[2].h is got[3].h is got[1].m is None and got[3].m == [False] * 3 and all(r.none is None for r in got.values())
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_a_task_sends_the_last_postings_only(spark):
    """Beyond 1,000 rows a group Spark sends all rows of a trigram to one task, unless it is told otherwise."""
    index = I.build(spark.createDataFrame([(i, "red") for i in range(40)], "doc_id long, x string"))
    found = retrieve.recent(index.postings, 3000)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 120


@pytest.mark.parametrize("counts", [40, 1 << 22])
def test_many_queries_read_no_postings(spark, monkeypatch, counts):
    """The cap's places are counted in what each document has; all postings were read, up to three times, and needed to be there."""
    monkeypatch.setattr(batch, "COUNTS", counts)
    monkeypatch.setattr(batch, "COLUMNS", 3)
    rows = [(i * i, "red ring" if i % 3 else "red bolt") for i in range(50)]
    index = I.build(spark.createDataFrame(rows, "doc_id long, x string"))
    index.postings = None
    for most in (4, 20):
        found = batch.since(index, most)
        for g in ("#re", "rin", "bol"):
            have = [i for i, x in rows if g in A.tokenize(x)]
            assert found[batch._ordinal(g)] == (have[-most] if len(have) > most else -(1 << 63))
    many = retrieve.search_many(index, spark.createDataFrame([(7, "bolt")], "query_id long, query string"), 3, 4).collect()
    assert [r.doc_id for r in many] == [39 * 39, 42 * 42, 45 * 45]


def test_what_an_insert_leaves(spark, tmp_path):
    """Rows that were only numbered stayed until the commit; a field may have the name of a column of the store's own."""
    engine = SearchEngine(spark).open(str(tmp_path / "index"), "_grams string, x string")
    seen, write = [], engine.store._write
    engine.store._write = lambda *a: seen.append(os.listdir(engine.store.path)) or write(*a)
    engine.insert_bulk([{"_grams": "red", "x": "blue"}, {"_grams": None, "x": "Réd"}])
    assert seen and not any(n.startswith("rows-") for n in seen[0])
    index = engine.store.index()
    assert [(r.doc_id, r._grams, r.x, r.n_trigrams) for r in index.documents.orderBy("doc_id").collect()] == [(0, "red", "blue", 7), (1, None, "Réd", 3)]
    assert sorted((r.trigram, r.doc_id) for r in index.postings.collect()) == sorted([(t, i) for t in A.tokenize("red") for i in (0, 1)] + [(t, 0) for t in A.tokenize("blue")])
    engine.delete(0)
    engine.compact()
    assert [r.x for r in engine.search("red blue").collect()] == ["Réd"] and engine.store.index().postings.count() == 3


def test_strings_of_json_in_one_expression(spark):
    """Documents were walked level by level, each level from the start, and what lay deeper than eight was written down."""
    rng = random.Random(4)
    bits = ['"', "\\", ":", ",", "{", "}", "[", "]", "a", "é", "日", "😀", "\n", "\t", "\x01", "/", '":', " "]

    def word():
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))

    def value(depth):
        kind = rng.random()
        if depth > 12 or kind < 0.4:
            return rng.choice([word(), word(), 1, 1.5, None, True, 10**22])
        return [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind < 0.7 else {word(): value(depth + 1) for _ in range(rng.randint(0, 3))}

    def walk(v):
        if isinstance(v, str):
            yield v
        for x in v if isinstance(v, list) else [v[k] for k in sorted(v, key=str.encode)] if isinstance(v, dict) else ():
            yield from walk(x)

    docs = [json.dumps(value(0), ensure_ascii=rng.random() < 0.5) for _ in range(500)] + ['["' + "a\\n" * 100_000 + '"]', "[" * 300 + '"x"' + "]" * 300]
    df = spark.createDataFrame(list(enumerate([*docs, "no json", None])), "i long, j string")
    parsed = df.select("i", F.try_parse_json("j").alias("doc"))
    got = {r.i: r.t for r in parsed.select("i", dynamic.texts(F.col("doc")).alias("t")).collect()}
    assert [got[i] for i in range(len(docs))] == [list(walk(json.loads(d))) for d in docs] and got[len(docs)] is got[len(docs) + 1] is None
    rows = dynamic.strings(parsed, "i", "doc").where("i < 50").orderBy("i", "at").collect()
    assert [r.value for r in rows] == [s for d in docs[:50] for s in walk(json.loads(d))]
    plan = dynamic.build(df, "i", "j").documents._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Union", "Generate", "FileScan"))


@pytest.mark.parametrize("steps", [2, 3, 5])
def test_where_the_cap_is_reached_among_ids_without_gaps(spark, monkeypatch, steps):
    """The last range of a round was counted to its full size, with newer documents that had been counted already."""
    monkeypatch.setattr(batch, "STEPS", steps)
    index = I.build(spark.createDataFrame([(i, "red") for i in range(41)], "doc_id long, x string"))
    index = I.Index(*[written(x, "test") for x in (index.documents, index.postings, index.dictionary, index.stats)], None, (), written(index.forward, "test"))
    for most in (1, 4, 17, 27, 40):
        assert batch.since(index, most)[batch._ordinal("red")] == 41 - most
