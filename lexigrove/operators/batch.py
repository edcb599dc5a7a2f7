"""Many queries at once: documents are scored against blocks of queries as they are scanned.

There are at most 50,653 trigrams, so what is known of each has a proven bound.  Queries go to blocks, each a
file in the shared folder with a matrix of trigrams by queries.  A task scans its documents' trigrams once for
PASS blocks: hits of some documents with all queries of a block are one matrix product, and only documents that
may still be among a query's first ``limit`` get their rarest trigram and their weight.  What leaves a task are
``limit`` rows for each query at most, and the number of documents that have all of its trigrams.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.analyze import ALPHABET
from ..sources.workdir import shared_dir
from . import score as S
from .filters import condition
from .index import Index

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK, PASS = 256, 16  #: queries of a block, and blocks for which the documents are scanned once
TRIGRAMS = 37**3
DOCS = 256  #: documents of one matrix product


class Block:
    """Queries of a block: a column for each, a row for each trigram that any of them has."""

    def __init__(self, t: pa.Table):
        query, gram = t.column("query_id").to_numpy(), t.column("gram").to_numpy()
        self.ids, column = np.unique(query, return_inverse=True)
        grams, first, row = np.unique(gram, return_index=True, return_inverse=True)
        self.row = np.full(TRIGRAMS, -1, dtype=np.int32)
        self.row[grams] = np.arange(len(grams))
        self.has = np.zeros((len(grams), len(self.ids)), dtype=np.float32)
        self.has[row, column] = 1
        self.trank = np.full(self.has.shape, np.iinfo(np.int32).max, dtype=np.int32)
        self.trank[row, column] = t.column("trank").to_numpy()
        self.idf = t.column("idf").to_numpy()[first]
        self.k = self.has.sum(axis=0)
        self.full, self.held = np.zeros(len(self.ids), dtype=np.int64), [np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.int64, float, np.int64)]
        self.least = np.ones(len(self.ids))

    def add(self, doc, ok, size, at, gram, near, limit: int) -> None:
        """Documents: ids, whether filters pass, numbers of trigrams; and their trigrams: (document, trigram, whether the cap lets it count)."""
        row = self.row[gram]
        known = row >= 0
        row, at, near = row[known], at[known], near[known]
        own = np.zeros((len(doc), len(self.has)), dtype=np.float32)
        own[at[near], row[near]] = 1
        hits = own @ self.has
        self.full += ((hits == self.k) & (self.k > 0)).sum(axis=0)
        hits[~ok] = 0
        least = self.least
        if len(doc) > limit:
            least = np.maximum(least, np.partition(hits, len(doc) - limit, axis=0)[len(doc) - limit])
        d, q = np.nonzero(hits >= least)
        if not len(d):
            return
        first, rank, weight = np.searchsorted(at, np.arange(len(doc) + 1)), np.empty(len(d), dtype=np.int64), np.empty(len(d))
        ends = np.searchsorted(d, np.arange(len(doc) + 1))
        for i in np.unique(d).tolist():
            rows, columns = row[first[i] : first[i + 1]], q[ends[i] : ends[i + 1]]
            rank[ends[i] : ends[i + 1]] = self.trank[rows[near[first[i] : first[i + 1]]]][:, columns].min(axis=0)
            weight[ends[i] : ends[i + 1]] = self.idf[rows] @ self.has[rows][:, columns]
        self.held = [np.concatenate(x) for x in zip(self.held, (q, hits[d, q].astype(np.int64), rank, doc[d], weight, size[d]))]
        order = np.lexsort((self.held[3], self.held[2], -self.held[1], self.held[0]))
        place = np.arange(len(order)) - np.searchsorted(self.held[0][order], self.held[0][order])
        self.held = [x[order[place < limit]] for x in self.held]
        many = np.bincount(self.held[0], minlength=len(self.ids))
        last = np.cumsum(many) - 1
        self.least = np.where(many >= limit, self.held[1][np.maximum(last, 0)], 1)

    def rows(self):
        q, hits, rank, doc, weight, size = self.held
        some = np.flatnonzero(self.full)
        n = len(some)
        columns = [np.concatenate(x) for x in ((self.ids[q], self.ids[some]), (hits, self.full[some]), (rank, np.zeros(n, np.int64)), (weight, np.zeros(n)), (size, np.zeros(n, np.int64)), (self.k[q], self.k[some]))]
        ids = pa.array(np.concatenate((doc, np.zeros(n, np.int64))), mask=np.concatenate((np.zeros(len(doc), bool), np.ones(n, bool))))
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), ids, *map(pa.array, columns[1:-1]), pa.array(columns[-1].astype(np.int64))], ["query_id", "doc_id", "hits", "min_trank", "weight", "n_trigrams", "k"])


def _blocks(entries: DataFrame, n: int, base: str) -> list[str]:
    """Writes entries (query_id, gram, trank, idf) as n blocks and returns their files."""

    def save(t):
        from pyarrow import fs, ipc

        path = f"{base}/{uuid.uuid4().hex}.arrow"
        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(at) as f, ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
        return pa.table([pa.array([path])], names=["path"])

    blocks = entries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n))).groupBy("block").applyInArrow(save, "path string")
    return sorted(r["path"] for r in blocks.collect())  # a row for BLOCK queries


STEPS = 512  #: ranges of ids, at most, in which postings are counted at a time
COUNTS, COLUMNS = 1 << 22, 256  #: counts that a task holds, and trigrams of which it sends them together


def since(index: Index, most: int):
    """For each trigram, by ordinal, the oldest document that the cap of ``most`` postings lets it count for.

    Documents are counted by trigram and range of ids, finer and finer around the place where the cap is reached,
    so that no trigram's postings are sorted or sent to one task.  Tasks send sums.  It is kept with the index.
    """
    if ("since", most) not in index.seen:
        out = np.full(TRIGRAMS, -(1 << 63), dtype=np.int64)
        capped = np.array(sorted(_ordinal(r["trigram"]) for r in index.dictionary.where(F.col("df") > most).select("trigram").collect()), dtype=np.int64)  # at most TRIGRAMS
        lo, hi = index.forward.agg(F.min("doc_id"), F.max("doc_id")).first() if len(capped) else (0, 0)
        width = hi - lo + 1
        begin, end, need = (np.full(len(capped), x, dtype=np.int64) for x in (lo, hi + 1, most))
        while len(capped):  # where each one's cap is reached: in ``width`` ids at most, from begin to end, at the need-th newest of these
            steps = max(2, min(STEPS, COUNTS // len(capped)))
            rounds = 1
            while steps**rounds < width:
                rounds += 1
            step = max(-(-width // steps), int(width / width ** (1 / rounds)))  # about equal rounds
            rows = _counted(index.forward, capped, begin, end, need, width, step).collect()  # one for each trigram
            for column, at, left in rows:
                begin[column] += at * step
                need[column] = left
            end = np.minimum(end, begin + step)  # the last range may be cut short
            width = step
            if step == 1:
                break
        out[capped] = begin
        index.seen["since", most] = out
    return index.seen["since", most]


def _counted(forward: DataFrame, capped, begin, end, need, width: int, step: int) -> DataFrame:
    """(column, at, left): for each of the trigrams ``capped``, the range of ``step`` ids with the need-th newest of its documents from begin to end, and the number that is left of need there."""
    steps, column = -(-width // step), np.full(TRIGRAMS, -1, dtype=np.int32)
    column[capped] = np.arange(len(capped))
    sent = forward.sparkSession.sparkContext.broadcast((column, begin, end, need))

    def count(batches):
        column, begin, end, _ = sent.value
        total = np.zeros(len(begin) * steps, dtype=np.int64)
        for b in batches:
            lists = b.column(1)
            own = column[lists.flatten().to_numpy()]
            doc = np.repeat(b.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            doc, own = doc[own >= 0], own[own >= 0].astype(np.int64)
            some = (doc >= begin[own]) & (doc < end[own])
            doc, own = doc[some], own[some]
            key = own * steps + (doc - begin[own]) // step
            if 16 * len(key) > len(total):
                total += np.bincount(key, minlength=len(total))
            else:
                keys, n = np.unique(key, return_counts=True)
                total[keys] += n
        total = total.reshape(-1, steps)
        blocks = [a for a in range(0, len(total), COLUMNS) if total[a : a + COLUMNS].any()]
        for a in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([total[a : a + COLUMNS].tobytes()], pa.binary())], ["block", "counts"])

    def reach(batches):
        _, _, _, need = sent.value
        total: dict = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.frombuffer(counts, np.int64).reshape(-1, steps)
                total[block] = total[block] + n if block in total else n
        for block, n in total.items():
            upto = np.cumsum(n[:, ::-1], axis=1)  # from the newest range on
            own = need[block : block + len(n)]
            place = (upto < own[:, None]).sum(axis=1)
            left = own - np.where(place > 0, upto[np.arange(len(n)), np.maximum(place - 1, 0)], 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(block, block + len(n)), steps - 1 - place, left)], ["column", "at", "left"])

    sums = forward.where("doc_id IS NOT NULL").select("doc_id", "grams").mapInArrow(count, "block int, counts binary")
    return sums.repartition("block").mapInArrow(reach, "column long, at long, left long")


def _ordinal(trigram: str) -> int:
    a, b, c = map(ALPHABET.index, trigram)
    return (a * 37 + b) * 37 + c


def matches(index: Index, entries: DataFrame, n_queries: int, limit: int, max_candidates: int | None, filters: dict | None) -> DataFrame:
    """(query_id, doc_id, hits, min_trank, weight, n_trigrams) of each query's first ``limit`` candidates that pass the filters.

    entries: (query_id, trigram, df, trank), read once.  weight: the sum of the idf of all trigrams shared, uncapped.
    """
    spark, schema = entries.sparkSession, "query_id long, doc_id long, hits long, min_trank long, weight double, n_trigrams long, k long"
    n, _ = index.corpus()
    grams = entries.select("query_id", X.ordinal(F.col("trigram")).cast("int").alias("gram"), F.col("trank").cast("int").alias("trank"), S.idf(F.lit(float(n)), F.col("df")).alias("idf"))
    paths = _blocks(grams, max(1, -(-n_queries // BLOCK)), f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}")
    docs = index.forward
    if filters:
        docs = docs.join(index.documents.where(condition(filters, index.documents.schema)).select("doc_id", F.lit(True).alias("ok")), "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    else:
        docs = docs.withColumn("ok", F.lit(True))
    if index.tombstones is not None:
        docs = docs.join(index.tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
    docs = docs.select("doc_id", "ok", F.col("n_trigrams").cast("long"), "grams")
    sent = spark.sparkContext.broadcast(np.full(TRIGRAMS, -(1 << 63), dtype=np.int64) if max_candidates is None else since(index, max_candidates))

    def scan(some):
        def f(batches):
            from pyarrow import fs, ipc

            blocks = []
            for path in some:
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at) as file:
                    blocks.append(Block(ipc.open_stream(file).read_all()))
            for b in batches:
                for a in range(0, b.num_rows, DOCS):
                    part = b.slice(a, DOCS)
                    doc, lists = part.column(0).to_numpy(), part.column(3)
                    many = np.diff(lists.offsets.to_numpy())
                    at, gram = np.repeat(np.arange(len(doc)), many), lists.flatten().to_numpy()
                    near = doc[at] >= sent.value[gram]
                    for block in blocks:
                        block.add(doc, part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(), at, gram, near, limit)
            for block in blocks:
                yield block.rows()

        return f

    found = None
    for a in range(0, len(paths), PASS):
        own = docs.mapInArrow(scan(paths[a : a + PASS]), schema)
        found = own if found is None else found.union(own)
    if found is None or limit < 1:
        return spark.createDataFrame([], schema)
    # the intersection of each query, or, where it has fewer than ``limit`` documents, the union: its documents come first anyway
    per = Window.partitionBy("query_id")
    found = found.withColumn("full", F.sum(F.when(F.col("doc_id").isNull(), F.col("hits")).otherwise(0)).over(per))
    found = found.withColumn("_rank", F.row_number().over(per.orderBy(F.col("doc_id").isNull(), F.desc("hits"), "min_trank", "doc_id"))).where(F.col("doc_id").isNotNull() & (F.col("_rank") <= limit))
    found = found.where((F.col("full") < limit) | (F.col("hits") == F.col("k")))
    return found.select("query_id", "doc_id", "hits", "min_trank", "weight", "n_trigrams")
