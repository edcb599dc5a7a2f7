"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest is a fingerprint; k-grams and windows are
sized so that each run of SPAN words holds one.  Fingerprints of the corpus are joined with those of
the benchmark, and each hit is extended to the runs of SPAN words around it, so that every shared
run is found, wherever it lies, and nothing else.

Nulls and texts without words have no hits.  Items shorter than SPAN words are matched as a whole.
Repeated item ids count once; repeated rows are judged alike; other columns of the input pass through,
whatever their names and types.  Runs are found by hashes of 64 bits and taken as equal if a digest of
their words is, too; where fingerprints are shuffled, hashes of 128 bits decide.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import WORD_RE, fresh, sql_fold, stage, table, without

SPAN = 8  #: words of a shared run
GRAM = 4  #: words of a k-gram; SPAN - GRAM + 1 of them make a window
BROADCAST_RUNS = 1_000_000  #: benchmark runs up to which their hashes (32 bytes each) are sent to every executor
BROADCAST_IDS = 32 << 20  #: and the bytes of their items' ids


def winnow(h, doc, span: int, gram: int):
    """Starts of the fingerprints: k-grams that are least in a window of span - gram + 1 within one row."""
    width = span - gram + 1
    g = K.grams(h, gram)
    if len(h) < span:
        return np.zeros(0, np.int64), g
    least = g[: len(h) - span + 1].copy()
    for j in range(1, width):
        np.minimum(least, g[j : len(h) - span + 1 + j], out=least)
    whole = K.within(doc, span)
    chosen = np.zeros(len(g), dtype=bool)
    for j in range(width):
        chosen[j : j + len(least)] |= whole & (g[j : j + len(least)] == least)
    return np.flatnonzero(chosen), g


def _each(batches, text: str, tabs):
    for batch in batches:
        for lo, hi, data, offs in K.chunks(batch.column(batch.schema.get_field_index(text))):
            yield batch.slice(lo, hi - lo), K.Words(data, offs, tabs)


def _digest(words: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def runs(items: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The benchmark's runs: (item_id, n words, run hash, digest of its words, print: its fingerprint); a short item is one run without any."""
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), *T._parse_datatype_string("n int, run long, digest long, print long").fields])

    def f(batches):
        tabs = K.tables(K.WORD)
        for batch, w in _each(batches, text, tabs):
            ids = batch.column(batch.schema.get_field_index(item_id)).to_pylist()
            out = [[] for _ in range(5)]
            for i, key in enumerate(ids):
                a = int(w.first[i])
                h = w.hash[a : w.first[i + 1]]
                n = min(span, len(h))
                if not n:
                    continue
                run, g = K.grams(h, n), K.grams(h, gram)
                for s in range(len(run)):
                    own = K.signed(g[s : s + span - gram + 1].min(keepdims=True))[0] if n == span else None
                    for o, v in zip(out, (key, n, int(K.signed(run)[s]), _digest(w.run(a + s, a + s + n)), own)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (batch.schema.field(item_id).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item_id", "n", "run", "digest", "print"])

    return items.select(item_id, text).mapInArrow(K.tidy(f), schema)


def _result(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, *T._parse_datatype_string("n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>").fields])


def _spans(mask):
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _small(docs: DataFrame, text: str, tests, span: int, gram: int) -> DataFrame:
    """The join with a benchmark of checked size (an Arrow table), whose hashes every executor holds."""
    names, item = np.unique(tests.column("item").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    n_of, run_of, digest_of = (tests.column(c).to_numpy() for c in ("n", "run", "digest"))
    by = {}
    for n in np.unique(n_of).tolist():
        at = np.flatnonzero(n_of == n)
        run = run_of[at].view(np.uint64)
        order = np.argsort(run, kind="stable")
        values, first = np.unique(run[order], return_index=True)
        by[n] = (values, np.append(first, len(order)), digest_of[at[order]], item[at[order]].astype(np.int32))
    prints = tests.column("print").drop_null().unique().to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast((by, prints, pa.array(names.tolist(), pa.string())))
    schema = _result(docs.schema)

    def f(batches):
        tabs = K.tables(K.WORD)
        by, prints, ids = sent.value
        prints, tests = K.Lookup(prints), {n: K.Lookup(v[0]) for n, v in by.items()}
        for batch, w in _each(batches, text, tabs):
            hit, found = np.zeros(len(w.hash), dtype=bool), {}
            for n, test in tests.items():
                if len(w.hash) < n:
                    continue
                if n == span:  # fingerprints first; a hit is extended to the runs that hold it
                    at, g = winnow(w.hash, w.doc, span, gram)
                    at = at[prints.find(g[at])[0]]
                    at = np.unique(at[:, None] - np.arange(span - gram + 1)).ravel()
                    at = at[(at >= 0) & (at <= len(w.hash) - span)]
                    at = at[w.doc[at] == w.doc[at + span - 1]]
                    c = K.powers(0xD1342543DE82EF95, n)
                    run = np.zeros(len(at), dtype=np.uint64)
                    for j in range(n):
                        run += w.hash[at + j] * c[j + 1]
                    run = K.mix(run ^ K.U(n * 0x632BE59BD9B4E019 % 2**64))
                else:
                    run, at = K.grams(w.hash, n), np.flatnonzero(K.within(w.doc, n))
                    run = run[at]
                i, k = test.find(run)
                _, first, digests, items = by[n]
                for p, q in zip(at[i].tolist(), k.tolist()):
                    own = slice(first[q], first[q + 1])
                    same = items[own][digests[own] == _digest(w.run(p, p + n))]
                    if len(same):
                        hit[p : p + n] = True
                        found.setdefault(int(w.doc[p]), set()).update(same.tolist())
            many = np.diff(w.first)
            total = np.concatenate(([0], np.cumsum(hit)))
            hits = total[w.first[1:]] - total[w.first[:-1]]
            names = [sorted(ids[x].as_py() for x in found.get(i, ())) for i in range(len(many))]
            spans = [_spans(hit[w.first[i] : w.first[i + 1]]) if hits[i] else [] for i in range(len(many))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(many, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                [*batch.schema.names, "n_words", "n_hit", "items", "spans"],
            )

    return docs.mapInArrow(K.tidy(f), schema)


def _large(docs: DataFrame, text: str, tests: DataFrame, span: int, gram: int) -> DataFrame:
    """The join as a shuffle, for a benchmark of any size: fingerprints meet, and runs around them are compared."""
    width = span - gram + 1
    short = sorted(r["n"] for r in tests.where(F.col("n") < span).select("n").distinct().collect())  # at most span - 1 lengths
    key, places = fresh(docs, "key", "places")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))  # equal texts are judged alike

    def f(batches):
        tabs = K.tables(K.WORD)
        for batch, w in _each(batches, "text", tabs):
            at, g = winnow(w.hash, w.doc, span, gram)
            parts = []
            if len(at):
                run = K.grams(w.hash, span)
                start = at[:, None] - np.arange(width)
                fits = (start >= 0) & (start < len(run))
                start = np.where(fits, start, 0)
                fits &= (w.doc[start] == w.doc[at][:, None]) & (w.doc[np.minimum(start + span - 1, len(w.doc) - 1)] == w.doc[at][:, None])
                i, j = np.nonzero(fits)
                parts.append((g[at[i]], run[start[i, j]], start[i, j], np.full(len(i), span)))
            for n in short:
                run, s = K.grams(w.hash, n), np.flatnonzero(K.within(w.doc, n))
                parts.append((run[s], run[s], s, np.full(len(s), n)))
            for fp, run, s, n in parts:
                d = w.doc[s]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(K.signed(fp)), pa.array(K.signed(run)), pa.array((s - w.first[d]).astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "fp", "run", "at", "n"])

    prints = keyed.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(K.tidy(f), "key string, fp long, run long, at int, n int")
    tests = tests.select("item", "n", "run", F.when(F.col("n") == span, F.col("print")).otherwise(F.col("run")).alias("fp"))
    tests = tests.groupBy("fp", "run", "n").agg(F.collect_set("item").alias("own"))  # a run that many items have meets each document once
    found = prints.join(tests, ["fp", "run", "n"]).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"), F.collect_set(F.struct("at", "n")).alias(places))
    columns = docs.columns
    joined = keyed.join(found.withColumnRenamed("key", key), key, "left").select(*docs.columns, "items", places)
    schema = _result(docs.schema)

    def g(batches):
        tabs = K.tables(K.WORD)
        for batch, w in _each(batches, text, tabs):
            many = np.diff(w.first)
            hits, spans = [], []
            for n, found_at in zip(many.tolist(), batch.column(batch.schema.get_field_index(places)).to_pylist()):
                mask = np.zeros(n, dtype=bool)
                for x in found_at or ():
                    mask[x["at"] : x["at"] + x["n"]] = True
                hits.append(int(mask.sum()))
                spans.append(_spans(mask))
            names = [x or [] for x in batch.column(batch.schema.get_field_index("items")).to_pylist()]
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(many, pa.int64()), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                [*columns, "n_words", "n_hit", "items", "spans"],
            )

    return joined.mapInArrow(K.tidy(g), schema)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """docs with n_words, n_hit (words inside a shared run), items (ids as strings, sorted) and spans (of words hit).

    Columns of docs with the names of those it adds are replaced; items without an id take no part.  Up to ``broadcast_runs`` benchmark runs are sent
    to the executors; beyond that both sides' fingerprints are shuffled.  Results are the same.
    """
    docs = without(docs, "n_words", "n_hit", "items", "spans")
    tests = runs(items.where(F.col(item_id).isNotNull()), item_id, item_text, span, gram)
    tests = stage(tests.select(F.col("item_id").cast("string").alias("item"), "n", "run", "digest", "print").distinct(), "runs")
    n, ids = tests.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    if n <= broadcast_runs and ids <= BROADCAST_IDS:
        return _small(docs, text, tests.toArrow(), span, gram)
    return _large(docs, text, tests, span, gram)


def op1_winnowing_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def brute(docs, items, span: int = SPAN):
    """The same by plain search, for tests: docs and items are lists of (id, text)."""
    import re

    def words(x):
        return re.findall(WORD_RE, (x or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))

    tests = {}
    for key, text in items:
        w = words(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            tests.setdefault(n, {}).setdefault(tuple(w[s : s + n]), set()).add(str(key))
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n, by in tests.items():
            for s in range(len(w) - n + 1):
                if x := by.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= x
        yield key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


_WORDS = f"regexp_extract_all({sql_fold("coalesce(text, '')")}, '{WORD_RE}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(8, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS run FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM b)),
g AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS run FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM t))),
m AS (SELECT doc_id, s, n, item_id FROM g JOIN t USING (n, run)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
