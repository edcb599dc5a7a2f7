"""Retrieval: candidates by shared trigrams, adaptive intersection or union, filtered top-k, and BM25.

The order of candidates is (hits descending, rank of the rarest trigram that a document was found by,
doc_id); BM25 then orders the few that are left.  A single query reads the postings of its trigrams, once,
and documents only for filters and for the rows it returns; many queries are scored in blocks (batch.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analyze as A
from ..functions import text as X
from ..sources.workdir import written
from . import batch
from . import score as S
from .filters import condition
from .highlight import highlights
from .index import Index

MAX_CANDIDATES = 5000
SMALL_QUERY = 4096  #: trigrams of a query up to which they reach the scan of the postings as a filter
SMALL_RESULT = 100_000  #: rows of a result (ids and numbers) up to which they are sent to every executor


def query_table(spark, queries: dict[int, str]) -> DataFrame:
    """(query_id, trigram, pos) of queries given as text; analysed on the driver."""
    rows = [(q, t, i) for q, text in queries.items() for i, t in enumerate(A.tokenize(text))]
    return spark.createDataFrame(rows, "query_id long, trigram string, pos int")


def query_table_of(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """The same of a DataFrame of queries, however many; analysed by the executors."""
    return queries.select(F.col(id_col).cast("long").alias("query_id"), F.posexplode(X.tokenize(F.col(text_col))).alias("pos", "trigram")).select("query_id", "trigram", "pos")


def _entries(spark, rows: list[tuple]) -> DataFrame:
    """(query_id, trigram, df, trank) of rows on the driver; a few are part of the plan itself, which needs no job to send them."""
    if not 0 < len(rows) <= 1000:
        return spark.createDataFrame(rows, "query_id long, trigram string, df long, trank int")
    values = ", ".join(f"({q}L, '{t}', {n}L, {i})" for q, t, n, i in rows)  # trigrams are of a-z, 0-9 and #
    return spark.sql(f"SELECT * FROM VALUES {values} AS e(query_id, trigram, df, trank)")


def probe(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, trigram, df, trank, k): known trigrams of each query, the rarest first; k of them."""
    known = queries.join(dictionary, "trigram")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "pos"))
    return known.select("query_id", "trigram", "df", rank.alias("trank"), F.count("*").over(Window.partitionBy("query_id")).alias("k"))


def recent(postings: DataFrame, most: int | None) -> DataFrame:
    """The last ``most`` postings of each trigram, deleted documents included; None: all."""
    if most is None:
        return postings
    limits, conf = "spark.sql.optimizer.windowGroupLimitThreshold", postings.sparkSession.conf
    if 0 < int(conf.get(limits)) < most:  # so that a task sends the last ones that it has, not all, of each trigram
        conf.set(limits, str(most))
    order = Window.partitionBy("trigram").orderBy(F.desc("doc_id"))
    return postings.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")


def hits(index: Index, entries: DataFrame, max_candidates: int | None = MAX_CANDIDATES, literal: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, hits, min_trank, k): documents that share trigrams with a query.

    literal: the queries' trigrams, if few, which then reach the scan of the postings as a filter.
    """
    postings = index.postings
    if literal is not None:
        postings = postings.where(F.col("trigram").isin(literal)) if literal else postings.limit(0)
        found = recent(postings, max_candidates).join(F.broadcast(entries), "trigram")
    else:
        used = entries.select("trigram").distinct()
        found = recent(postings.join(used, "trigram", "left_semi"), max_candidates).join(entries, "trigram")
    if index.tombstones is not None:
        found = found.join(index.tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.min("trank").alias("min_trank"), F.max("k").alias("k"))


def intersection(found: DataFrame) -> DataFrame:
    return found.where("hits = k")


def adaptive(found: DataFrame, limit: int) -> DataFrame:
    """The intersection of each query, or, where it has fewer than ``limit`` documents, the union."""
    full = found.groupBy("query_id").agg(F.sum(F.when(F.col("hits") == F.col("k"), 1).otherwise(0)).alias("_full"))
    return found.join(full, "query_id").where((F.col("_full") < limit) | (F.col("hits") == F.col("k"))).drop("_full")


def _order(*first: Column) -> list[Column]:
    return [*first, F.desc("hits"), F.col("min_trank").asc(), F.col("doc_id").asc()]


def top(found: DataFrame, index: Index, limit: int, k: int, filters: dict | None = None) -> DataFrame:
    """The first ``limit`` candidates (doc_id, hits, min_trank, ...) of one query of k trigrams that pass the filters.

    As documents with all trigrams come first in the order, the adaptive choice between intersection and
    union only asks whether there are ``limit`` of them, and drops what follows.
    """
    if not filters:
        return found.orderBy(*_order()).limit(limit)
    docs = index.documents.where(condition(filters, index.documents.schema)).select("doc_id")
    full = found.agg(F.count_if(F.col("hits") == k).alias("_full"), F.min("min_trank").alias("_lo"), F.max("_weight").alias("_hi"))
    kept = found.join(docs, "doc_id").orderBy(*_order()).limit(limit)
    some = F.col("_lo").isNotNull() | F.col("_hi").isNotNull()  # always so; as both sides use the same columns, one scan and shuffle serves both
    return kept.crossJoin(F.broadcast(full)).where(some & ((F.col("_full") < limit) | (F.col("hits") == k))).drop("_full", "_lo", "_hi")  # one row


def _fetch(kept: DataFrame, index: Index, rows: int) -> DataFrame:
    """kept with its documents, which are read for these rows only; rows: how many there may be."""
    return (F.broadcast(kept) if rows <= SMALL_RESULT else kept).join(index.documents.drop("n_trigrams") if "n_trigrams" in kept.columns else index.documents, "doc_id")


def _scored(weight: Column, length: Column, index: Index) -> Column:
    """The score of a document by the sum of its trigrams' idf."""
    n, average = index.corpus()
    return F.coalesce(S.scaled(S.term(weight, S.norm(length, F.lit(average))), S.score_max(F.lit(float(n)))), F.lit(0.0))


def rank_boosted(kept: DataFrame, index: Index, entries: DataFrame, boosts: dict[str, float], single: bool = False) -> DataFrame:
    """kept with score: the mean of its string fields' scores, weighted by boosts (1 for fields not named)."""
    n, average = index.corpus()
    idfs = entries.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("trigram", S.idf(F.lit(float(n)), F.col("df"))))).alias("_idfs"))
    rows = kept.join(F.broadcast(idfs) if single else idfs, "query_id")
    strings = [f.name for f in index.documents.schema.fields if isinstance(f.dataType, T.StringType)]
    total, weight = F.lit(0.0), F.lit(0.0)
    rows = rows.withColumns({f"_t{i}": X.tokenize(F.col(f"`{name}`")) for i, name in enumerate(strings)})
    for i, name in enumerate(strings):
        boost, size = float(boosts.get(name, 1.0)), F.size(f"_t{i}")
        own = S.field_score(F.col(f"_t{i}"), F.col("_idfs"), S.norm(size, F.lit(average)))
        total = total + F.when(size > 0, own / S.score_max(F.lit(float(n))) * F.lit(boost)).otherwise(0.0)
        weight = weight + F.when(size > 0, F.lit(boost)).otherwise(0.0)
    out = F.when((weight == 0) | (F.col("n_trigrams") == 0), 0.0).otherwise(F.round(F.least(total / weight * 100.0, F.lit(100.0)), 2))
    return rows.withColumn("score", out).drop("_idfs", *[f"_t{i}" for i in range(len(strings))])


def _fields(index: Index) -> list[str]:
    return [c for c in index.documents.columns if c not in ("doc_id", "n_trigrams")]


def search(index: Index, query: str, limit: int = 20, max_candidates: int | None = MAX_CANDIDATES, boosts: dict[str, float] | None = None, filters: dict | None = None, highlight: bool = False, highlight_options: dict | None = None) -> DataFrame:
    """Documents that match the query, best first: (doc_id, score, hits, fields[, highlights])."""
    spark, limit = index.documents.sparkSession, max(0, limit)
    trigrams = A.tokenize(query)
    df = index.frequencies(trigrams)
    known = sorted(df, key=df.get)  # of equals the first in the query
    n, _ = index.corpus()
    entries = _entries(spark, [(0, t, df[t], i + 1) for i, t in enumerate(known)])
    terms = F.broadcast(entries.select("trigram", "trank", S.idf(F.lit(float(n)), F.col("df")).alias("idf")))  # a query's trigrams
    postings = index.postings.where(F.col("trigram").isin(known)) if 0 < len(known) <= SMALL_QUERY else index.postings.limit(0) if not known else index.postings
    capped = max_candidates is not None and max(df.values(), default=0) > max_candidates
    found = (recent(postings, max_candidates) if capped else postings).where("doc_id IS NOT NULL").join(terms, "trigram")
    found = found.groupBy("doc_id").agg(F.min("trank").alias("min_trank"), F.sum("idf").alias("_weight"), F.count("*").alias("hits"))
    if index.tombstones is not None:
        found = found.join(index.tombstones.select("doc_id").distinct(), "doc_id", "left_anti")
    kept = top(found, index, limit, len(known), filters)
    if capped and not boosts:  # weights are of all trigrams shared, capped or not
        kept = kept.drop("_weight")
        whole = postings.join(F.broadcast(kept.select("doc_id")) if limit <= SMALL_RESULT else kept.select("doc_id"), "doc_id", "left_semi").join(terms, "trigram")
        kept = kept.join(whole.groupBy("doc_id").agg(F.sum("idf").alias("_weight")), "doc_id", "left")
    out = _fetch(kept.withColumn("query_id", F.lit(0).cast("long")), index, limit)
    out = rank_boosted(out, index, entries, boosts, True) if boosts else out.withColumn("score", _scored(F.col("_weight"), F.col("n_trigrams"), index))
    out = out.orderBy(*_order(F.desc("score"))).limit(limit)  # as many as there are
    extra = []
    if highlight:
        out = out.withColumn("highlights", highlights(index.documents.select(*_fields(index)).schema, trigrams, **(highlight_options or {})))
        extra = ["highlights"]
    return out.select("doc_id", "score", "hits", *_fields(index), *extra)


def search_many(index: Index, queries: DataFrame, limit: int = 20, max_candidates: int | None = MAX_CANDIDATES, boosts: dict[str, float] | None = None, filters: dict | None = None, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """All queries of a DataFrame in one plan: (query_id, rank, doc_id, score, hits, fields)."""
    entries = probe(query_table_of(queries, id_col, text_col), F.broadcast(index.dictionary))  # of at most 50,653 rows
    entries = written(entries, "entries") if boosts else entries
    n, limit = queries.count(), max(0, limit)
    kept = batch.matches(index, entries, n, limit, max_candidates, filters).withColumnRenamed("weight", "_weight")
    out = _fetch(kept, index, n * limit)
    out = rank_boosted(out, index, entries, boosts) if boosts else out.withColumn("score", _scored(F.col("_weight"), F.col("n_trigrams"), index))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(F.desc("score"))))
    return out.select("query_id", rank.alias("rank"), "doc_id", "score", "hits", *_fields(index))
