"""The inverted index as DataFrames: postings, dictionary and corpus statistics."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams as G
from ..functions import text as X
from ..sources.workdir import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART, HELD = 1 << 19, 1 << 20  #: postings that a task sorts at once, and that it holds before it sends them on


def text_of(col: Column, kind: T.DataType) -> Column | None:
    """All strings in a column of any type as an array, nested ones too; null for a type without strings."""
    if isinstance(kind, T.StringType):
        return F.array(col)
    if isinstance(kind, T.ArrayType):
        inner = text_of(F.lit(None).cast(kind.elementType), kind.elementType)
        return None if inner is None else F.flatten(F.transform(col, lambda x: F.coalesce(text_of(x, kind.elementType), F.array().cast("array<string>"))))
    if isinstance(kind, T.MapType):
        return text_of(F.map_values(col), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields if (x := text_of(col.getField(f.name), f.dataType)) is not None]
        return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else None
    return None


def document_trigrams(schema: T.StructType, fields: list[str] | None = None) -> Column:
    """Distinct trigrams of all strings in the fields (by default all), as ordinals in order of first occurrence."""
    names = [f for f in schema.fields if fields is None or f.name in fields]
    found = [(f, strings) for f in names if (strings := text_of(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if not found:
        return F.array().cast("array<int>")
    if len(found) == 1 and isinstance(found[0][0].dataType, T.StringType):
        return G.ordinals(F.col(f"`{found[0][0].name}`"))
    return G.ordinals(F.concat(*[F.coalesce(strings, F.array().cast("array<string>")) for _, strings in found]), True)


@dataclass
class Index:
    """documents (doc_id, fields, n_trigrams), postings (trigram, doc_id), dictionary (trigram, df),
    stats (n, trigram_sum; one row), tombstones (doc_id) or None, and forward (doc_id, n_trigrams, grams: ordinals).

    Dictionary and statistics count deleted documents until compaction.  An index doesn't change, so what
    is looked up of these two is kept: one number for each trigram, of which there are at most 50,653.
    """

    documents: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    tombstones: DataFrame | None = None
    fields: tuple[str, ...] = ()
    forward: DataFrame | None = None
    seen: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.forward is None:
            grams = self.postings.groupBy("doc_id").agg(F.collect_list(X.ordinal(F.col("trigram")).cast("int")).alias("grams"))
            self.forward = grams.select("doc_id", F.size("grams").alias("n_trigrams"), "grams")

    def with_tombstones(self, tombstones: DataFrame) -> Index:
        return Index(self.documents, self.postings, self.dictionary, self.stats, tombstones, self.fields, self.forward, self.seen)

    def corpus(self) -> tuple[int, float]:
        """(documents, at least 1; average of their trigrams)."""
        if None not in self.seen:
            n, total = self.stats.select("n", "trigram_sum").first()
            self.seen[None] = (max(1, n), total / n if n else 0.0)
        return self.seen[None]

    def frequencies(self, trigrams: list[str]) -> dict[str, int]:
        """The document frequencies of those trigrams that the index has."""
        if new := [t for t in trigrams if t not in self.seen]:
            rows = self.dictionary.where(F.col("trigram").isin(new)) if len(new) <= 4096 else self.dictionary
            self.seen.update(dict.fromkeys(new, 0) | {r["trigram"]: r["df"] for r in rows.collect()})
        return {t: self.seen[t] for t in trigrams if self.seen[t]}


def postings_of(documents: DataFrame, grams: Column) -> DataFrame:
    return documents.select("doc_id", F.explode(grams).alias("_gram")).select(G.spell(F.col("_gram")).alias("trigram"), "doc_id")


def forward_of(documents: DataFrame, grams: Column) -> DataFrame:
    return documents.select("doc_id", F.size(grams).alias("n_trigrams"), grams.alias("grams"))


def dictionary_of(forward: DataFrame) -> DataFrame:
    """Each trigram's number of documents; postings are counted as ordinals, and only these are spelled."""
    return forward.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).select(G.spell(F.col("gram")).alias("trigram"), "df")


def clustered(forward: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(trigram, doc_id) of forward, in ranges of trigrams and, in each, by trigram and doc_id; dictionary: that of forward, written down.

    The ranges, of about PART postings, follow from the dictionary, so nothing is sampled; a trigram with
    more than that has ranges of ids.  Postings go from task to task as bytes.
    """
    names, rank = pa.array(sorted(G.spelled())), np.empty(G.TRIGRAMS, np.uint16)
    rank[np.argsort(G.spelled())] = np.arange(G.TRIGRAMS)
    df = np.zeros(G.TRIGRAMS, np.int64)
    found = dictionary.select(X.ordinal(F.col("trigram")).alias("gram"), "df").collect()  # at most TRIGRAMS
    for gram, n in found:
        df[rank[gram]] = n
    ends = forward.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first() if df.max() > PART else None
    lo, width = (ends["lo"], ends["hi"] - ends["lo"] + 1) if ends else (0, 1)
    cores = forward.sparkSession.sparkContext.defaultParallelism
    most = max(1 << 14, min(PART, int(df.sum()) // (4 * cores)))
    pieces = np.maximum(1, -(-df // PART))
    first, part, held = np.zeros(G.TRIGRAMS, np.int64), 0, 0
    for i in np.flatnonzero(df).tolist():
        if held and held + df[i] > most:
            part, held = part + 1, 0
        first[i] = part
        held += int(df[i])
        if pieces[i] > 1:
            part, held = part + int(pieces[i]), 0
    first, pieces = first[rank].astype(np.int32), pieces[rank].astype(np.int32)  # by ordinal
    kind = np.dtype([("rank", "<u2"), ("doc", "<i8")])

    def cut(batches):
        docs, grams, held = [], [], 0

        def packed():
            doc, gram = np.concatenate(docs), np.concatenate(grams)
            at, many = first[gram], pieces[gram]
            at = at + np.where(many > 1, ((doc - lo) / width * many).astype(np.int64), 0)
            by = np.argsort(at if part >> 16 else at.astype(np.uint16), kind="stable")
            out = np.empty(len(by), kind)
            out["rank"], out["doc"], at = rank[gram[by]], doc[by], at[by]
            new = np.flatnonzero(np.diff(at, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(at[new].astype(np.int32)), pa.array([out[a:z].tobytes() for a, z in zip(new, np.append(new[1:], len(out)))], pa.binary())], ["part", "found"])

        for b in batches:
            column = b.column(1)
            many = np.diff(column.offsets.to_numpy())
            docs.append(np.repeat(b.column(0).to_numpy(), many))
            grams.append(column.flatten().to_numpy())
            held += len(grams[-1])
            if held >= HELD:
                yield packed()
                docs, grams, held = [], [], 0
        if held:
            yield packed()

    def merge(batches):
        now, blobs = None, []

        def sort(blobs):
            p = np.frombuffer(b"".join(blobs), kind)
            own, doc = p["rank"].astype(np.int64), p["doc"]
            least = int(doc.min()) if len(p) else 0
            if len(p) and int(doc.max()) - least < 1 << 47:
                key = np.sort(own << 47 | (doc - least))
                own, doc = key >> 47, (key & ((1 << 47) - 1)) + least
            else:
                by = np.lexsort((doc, own))
                own, doc = own[by], doc[by]
            for a in range(0, len(p), 1 << 16):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own[a : a + (1 << 16)])), pa.array(doc[a : a + (1 << 16)])], ["trigram", "doc_id"])

        for b in batches:
            for at, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at != now:
                    yield from sort(blobs)
                    now, blobs = at, []
                blobs.append(blob)
        yield from sort(blobs)

    sent = forward.where("doc_id IS NOT NULL").select("doc_id", "grams").mapInArrow(cut, "part int, found binary")
    out = sent.repartition(max(min(part + 1, 3 * cores), (part + 1) // 4), "part").sortWithinPartitions("part").mapInArrow(merge, "trigram string, doc_id long")
    return out.union(postings_of(forward.where("doc_id IS NULL"), F.col("grams")))


def stats_of(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_trigrams"), F.lit(0)).cast("long").alias("trigram_sum"))


def build(df: DataFrame, id_col: str = "doc_id", text_cols: list[str] | None = None, keep=None) -> Index:
    """An index over any DataFrame, as lazy plans.  text_cols: the fields to index, by default all with strings.

    keep: what writes down and rereads the analysed documents, so that postings don't analyse them again.
    """
    fields = [c for c in df.columns if c != id_col]
    docs = spread(df).select(F.col(id_col).cast("long").alias("doc_id"), *fields)
    grams = document_trigrams(T.StructType([f for f in docs.schema.fields if f.name != "doc_id"]), text_cols)
    return built(docs.withColumn("_grams", grams).withColumn("n_trigrams", F.size("_grams")), tuple(text_cols or fields), keep)


def built(analysed: DataFrame, fields: tuple[str, ...], keep=None) -> Index:
    """An index of documents (doc_id, fields, _grams, n_trigrams)."""
    analysed = keep(analysed) if keep else analysed
    documents, forward = analysed.drop("_grams"), forward_of(analysed, F.col("_grams"))
    return Index(documents, postings_of(analysed, F.col("_grams")), dictionary_of(forward), stats_of(documents), None, fields, forward)
