"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words and of their
beginnings (hashed), as other languages inflect what one word says in English; the document's is a leaky noisy-or of its sentences: 1 - (1 - leak) * prod(1 - score).  Only documents
have labels; the likelihood of these trains the words' weights, and the sentences' scores then tell
where a document offends.

Scores depend on the text alone, so repeated rows and rows without id score like others.  Nulls and texts
without words have the leak as their score.  Columns of the input with the names of those added are
replaced.  Labels other than 0 and 1 count as none; with labels of one kind or none, all scores are alike.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import small_batches, stage, table, without

FEATURE_BITS = 20
PREFIXES = (4, 5, 6)  #: bytes of the beginnings
TRAIN_DOCS, TRAIN_WORDS = 8_000, 12_000_000  #: labelled documents, and their words (16 bytes each), that the weights are fitted on at most
THRESHOLD = 0.3


def _sentences(w, data, offs):
    """The sentence of each word (over the chunk), and the first word of each sentence."""
    stop = np.zeros(256, dtype=np.int32)
    stop[[10, 13, 33, 46, 63]] = 1  # line ends, ! . ?
    seen = np.concatenate(([0], np.cumsum(stop[data])))[w.start]
    new = np.ones(len(seen), dtype=bool)
    new[1:] = (np.diff(seen) > 0) | (np.diff(w.doc) > 0)
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _bags(batches, at: int):
    """(batch, row range, Words, features of each word (a row for each kind), sentence of each word, first words) of each chunk."""
    tabs = K.tables(K.WORD)
    for batch in batches:
        for lo, hi, data, offs in K.chunks(batch.column(at)):
            w = K.Words(data, offs, tabs)
            sentence, first = _sentences(w, data, offs)
            kinds = [w.hash, *(K.mix(w.prefix(n) + K.U(n)) for n in PREFIXES)]
            yield batch, lo, hi, w, np.stack([(h >> K.U(64 - FEATURE_BITS)).astype(np.int64) for h in kinds]), sentence, first


def _distinct(x):
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def fit(labels, docs, sentences, kinds, rounds: int = 120, rate: float = 0.3, decay: float = 0.02, least: int = 4, sure: float = 4.0):
    """Weights by feature, bias and leak.  labels: of documents; docs: of sentences; sentences: of words; kinds: features of words.

    Only features that stand in at least ``least`` documents labelled 1, and in more of these than of
    others by ``sure`` standard deviations, get a weight; the bias speaks for all that is harmless.
    """
    n_docs, n_s, y = len(labels), len(docs), labels.astype(bool)
    low, base = (1 << FEATURE_BITS) - 1, labels.mean()
    s, f = [], []
    for kind in kinds:
        pair = _distinct(sentences.astype(np.int64) << FEATURE_BITS | kind)  # a word counts once in a sentence
        seen = _distinct(docs[pair >> FEATURE_BITS].astype(np.int64) << FEATURE_BITS | pair & low)
        all_of, ones = np.bincount(seen & low, minlength=low + 1), np.bincount(seen[y[seen >> FEATURE_BITS]] & low, minlength=low + 1)
        good = (ones >= least) & (ones - base * all_of > sure * np.sqrt(base * (1 - base) * all_of))
        pair = pair[good[pair & low]]
        s.append(pair >> FEATURE_BITS)
        f.append(pair & low)
        del pair, seen
    s, f = np.concatenate(s), np.concatenate(f)
    names, f = np.unique(f, return_inverse=True)
    w, b, logit = np.zeros(len(names)), -6.0, -3.5
    grads = [np.zeros(len(names)) + 1e-8, 1e-8, 1e-8]  # Adagrad
    for _ in range(rounds):
        z = np.clip(b + np.bincount(s, w[f], n_s), -30, 30)
        p = 1 / (1 + np.exp(-z))
        a = np.bincount(docs, np.log1p(np.exp(z)), n_docs)
        leak = 1 / (1 + np.exp(-logit))
        none = (1 - leak) * np.exp(-a)  # that no sentence and no leak speaks
        g = np.where(y, none / np.maximum(1 - none, 1e-9), -1.0)  # of the likelihood, by a
        gs = g[docs] * p
        gw, gb, gl = np.bincount(f, gs[s], len(names)) - decay * w, gs.sum(), (g * leak).sum()
        grads = [grads[0] + gw * gw, grads[1] + gb * gb, grads[2] + gl * gl]
        w = w + rate * gw / np.sqrt(grads[0])
        b = min(b + rate * gb / np.sqrt(grads[1]), -3.0)
        logit = logit + rate * gl / np.sqrt(grads[2])
    return dict(zip(names.tolist(), w.tolist())), float(b), float(1 / (1 + np.exp(-logit)))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_DOCS, most_words: int = TRAIN_WORDS) -> dict:
    """{feature: weight, -1: bias, -2: leak} from documents whose label is 0 or 1.

    Of more than ``most`` labels those with the least hash of their id are taken, so at most ``most``
    documents are read again (the least text of a repeated id; the largest of several labels), and of these
    as many, in this order, as have ``most_words`` words together; texts of more than a hundredth of
    that are never learned from.  One task fits the weights, and at most 2**FEATURE_BITS of them come back.
    """
    small_batches(docs.sparkSession)
    few = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    few = few.orderBy(F.xxhash64("_id"), "_id").limit(most)  # a proven bound: this side is sent to every executor
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(few), "_id")
    sample = sample.groupBy("_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label", F.xxhash64("_id").alias("turn"), F.col("_id").cast("string"))

    def bags(batches):
        for batch, lo, hi, w, feature, sentence, first in _bags(batches, 0):
            many = np.diff(w.first)
            many[many > most_words // 100] = 0
            ends = np.append(first, len(w.hash))
            y = batch.column(1).to_numpy(zero_copy_only=False)[lo:hi]
            a, z = np.searchsorted(first, w.first[:-1]), np.searchsorted(first, w.first[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(many), pa.array(y.astype(np.int32)), pa.array([feature[:, w.first[i] : w.first[i] + many[i]].astype(np.int32).tobytes() for i in range(len(many))], pa.binary()), pa.array([np.diff(ends[a[i] : z[i] + 1]).astype(np.int32).tobytes() if many[i] else b"" for i in range(len(many))], pa.binary())],
                ["turn", "_id", "words", "label", "features", "lengths"],
            )

    def one(batches):
        rows = [(y, np.frombuffer(f, np.int32).reshape(1 + len(PREFIXES), -1), np.frombuffer(n, np.int32)) for b in batches for y, f, n in zip(*(b.column(i).to_pylist() for i in range(3)))]
        rows = [r for r in sorted(rows, key=lambda r: (r[0], len(r[2]), zlib.crc32(r[1]))) if len(r[2])]
        if not rows or len({r[0] for r in rows}) < 2:
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([-6.0, float(rows[0][0]) if rows else 0.0])], ["feature", "weight"])
            return
        lengths = np.concatenate([r[2] for r in rows])
        docs = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        w, b, leak = fit(np.array([r[0] for r in rows]), docs, np.repeat(np.arange(len(lengths)), lengths), (np.concatenate([r[1][k] for r in rows]) for k in range(1 + len(PREFIXES))))
        w = {k: v for k, v in w.items() if abs(v) > 1e-3} | {-1: b, -2: leak}
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.int64()), pa.array(list(w.values()), pa.float64())], ["feature", "weight"])

    packed = stage(sample.mapInArrow(K.tidy(bags), "turn long, _id string, words long, label int, features binary, lengths binary").where("words > 0"), "bags")
    so_far = F.sum("words").over(Window.orderBy("turn", "_id"))  # of at most ``most`` documents
    fit_on = packed.select("_id", "turn", "words").withColumn("so_far", so_far).where(F.col("so_far") <= most_words).select("_id")
    packed = packed.join(F.broadcast(fit_on), "_id", "left_semi").select("label", "features", "lengths")
    return {r["feature"]: r["weight"] for r in packed.coalesce(1).mapInArrow(K.tidy(one), "feature long, weight double").collect()} or {-1: -6.0, -2: 0.0}


def score(docs: DataFrame, model: dict, text: str = "text", spans: bool = False) -> DataFrame:
    """docs with score and, with ``spans``, offending: the sentences (first word, end, score) that score at least 0.5."""
    small_batches(docs.sparkSession)
    docs = without(docs, "score", "offending")
    weights = np.zeros(1 << FEATURE_BITS)
    for k, v in model.items():
        if k >= 0:
            weights[k] = v
    sent = docs.sparkSession.sparkContext.broadcast((weights, model[-1], model[-2]))
    columns = docs.columns
    at = columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    if spans:
        schema = schema.add("offending", T._parse_datatype_string("array<struct<start:int,end:int,score:double>>"))

    def f(batches):
        weights, bias, leak = sent.value
        for batch, lo, hi, w, feature, sentence, first in _bags(batches, at):
            z = np.full(len(first), bias)
            for kind in feature:
                value = weights[kind]
                use = np.flatnonzero(value)
                _, once = np.unique(sentence[use] << FEATURE_BITS | kind[use], return_index=True)  # a word counts once in a sentence
                z += np.bincount(sentence[use[once]], value[use[once]], len(first))
            z = np.clip(z, -30, 30)
            doc = w.doc[first]
            a = np.bincount(doc, np.log1p(np.exp(z)), hi - lo)
            out = [*batch.slice(lo, hi - lo).columns, pa.array(1 - (1 - leak) * np.exp(-a))]
            if spans:
                marks = [[] for _ in range(hi - lo)]
                ends = np.append(first[1:], len(w.hash))
                for i in np.flatnonzero(z >= 0).tolist():
                    d = int(doc[i])
                    marks[d].append({"start": int(first[i] - w.first[d]), "end": int(ends[i] - w.first[d]), "score": float(1 / (1 + np.exp(-z[i])))})
                out.append(pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, [*columns, "score", *["offending"] * spans])

    return docs.mapInArrow(K.tidy(f), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_noisy_or_toxicity(spark, sf_dir):
    """Scores of all documents by a model that never saw the labels of those held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
