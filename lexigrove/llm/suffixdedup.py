"""Exact substring de-duplication over a logarithmic family of sparse suffix arrays.

Bytes covered by a string of SPAN bytes that also starts elsewhere are found without an entry for every
suffix, as that would take some twenty times the input.  Every window of SPAN bytes has an anchor, the
leftmost GRAM bytes of least hash in it; equal windows have it at the same place.  Only the suffixes
that begin at anchors are indexed (one in about 88).  An entry is a run of window starts with one
anchor: its suffix's first GRAM bytes, as three numbers in the order of the bytes, and a hash of the
run's whole text.

Documents come in batches.  Each batch gets a suffix array of its own, sorted by these bytes, and is
merge-scanned against the levels that are there: entries that meet in GRAM bytes are matches.  Levels
of one size merge, and that scan is the merge itself, so that each entry is merged about log2(batches)
times.  Matches whose runs are equal as a whole repeat as a whole.  The others are the ends of
passages: their texts are read again and get a plain suffix array, over all their windows, by prefix
doubling, in which neighbours with a common prefix of SPAN bytes or more repeat.

Matches never cross documents; texts shorter than SPAN have none; nulls are empty.  Strings are judged
on the input, so copies don't protect each other.  Equal rows are different places, each a copy of the
other.  Texts of any length are read in pieces.  Columns of docs with the names of those added are
replaced, others pass through whatever their names.  Whole runs are taken as equal if their hashes of
64 bits are, and windows of groups of more than GROUP ends, too; other ends are compared by their bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import drop_path, fresh, likely, stage, table, without, work_path

SPAN, GRAM = 200, 24
PIECE = 1 << 21  #: window starts handled at once
GROUP = 4096  #: distinct runs of one key up to which one task compares them; beyond it windows are shuffled
PARTS = "array<struct<a:int,z:int>>"
KEY = ["k0", "k1", "k2"]  #: the first GRAM bytes of a suffix, in their order
_PLACE = 24


def _runs(data, offs, span: int):
    """(row, first window start in the row, windows - 1, key, text hash) of each run in a chunk of whole rows."""
    n = len(data)
    if n < span:
        return None
    view = K.eights(data)[: n - 7]
    m = K.mix(view)
    g = K.mix(m[:-16] * K.U(0x9FB21C651E98DF25) + m[8:-8] * K.U(0xD1342543DE82EF95) + m[16:] * K.U(0xC2B2AE3D27D4EB4F))
    low = K.U((1 << _PLACE) - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)  # the least hash, leftmost
    want, have = span - GRAM + 1, 1
    while have * 2 <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if want > have:
        least = np.minimum(least[: n - span + 1], least[want - have : want - have + n - span + 1])
    anchor = (least[: n - span + 1] & low).astype(np.int64)
    many = np.diff(offs)
    whole = np.zeros(n - span + 1 + 1, dtype=np.int8)  # +1 where a row's windows begin, -1 after them
    has = many >= span
    np.add.at(whole, offs[:-1][has], 1)
    np.add.at(whole, offs[1:][has] - span + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[offs[:-1][has]] = True
    first = np.flatnonzero(new & whole)
    row = np.searchsorted(offs, first, "right") - 1
    stop = np.append(first[1:], n)
    last = np.minimum(stop - 1, offs[row + 1] - span)  # the next run, or the row's last window
    at = anchor[first]
    key = [(view[at + i].byteswap() ^ K.U(1 << 63)).view(np.int64) for i in (0, 8, 16)]
    return row, first - offs[row], last - first, key, K.byte_hash(data, first, last + span, 512)


def _pieces(column, span: int):
    """(rows, bytes, offsets, skip): chunks of whole texts, and overlapping pieces of texts too long for one."""
    for lo, hi, data, offs in K.chunks(column, min(K.CHUNK, PIECE)):
        if len(data) <= PIECE + span:
            yield lo, hi, data, offs, 0
            continue
        for a in range(0, max(1, len(data) - span + 1), PIECE):  # a chunk this large is one text
            part = data[a : a + PIECE + span - 1]
            yield lo, hi, part, np.array([0, len(part)]), a


def entries(docs: DataFrame, batches: int, span: int = SPAN) -> DataFrame:
    """(d, t: key of the row, batch, k0, k1, k2, run, lo, n): the index entries of docs (d, t, text)."""

    def f(found):
        for b in found:
            d, t, batch = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for lo, _, data, offs, skip in _pieces(b.column(3), span):
                if (x := _runs(data, offs, span)) is None:
                    continue
                row, first, n, key, run = x
                row = row + lo
                yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(t[row]), pa.array(batch[row]), *map(pa.array, key), pa.array(K.signed(run)), pa.array((first + skip).astype(np.int64)), pa.array(n.astype(np.int32))], ["d", "t", "batch", *KEY, "run", "lo", "n"])

    rows = docs.select("d", "t", F.pmod(F.xxhash64("t", "d"), F.lit(batches)).cast("int").alias("batch"), "text")
    return rows.mapInArrow(K.tidy(f), "d long, t long, batch int, k0 long, k1 long, k2 long, run long, lo long, n int")


class Family:
    """Levels of entries in the order of their suffixes: (k0, k1, k2, times, low, high).

    times: the entries of this key; low, high: their least and largest run, equal if all have one text.
    A level's size is the number of its batches; two levels of one size become one of twice the size.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.met = spark, [], []  # levels: (batches, path), the largest first; met: paths of matches

    @staticmethod
    def _merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEY).agg(F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))

    def _write(self, df: DataFrame, name: str = "level") -> str:
        path = work_path(self.spark, name)
        df.sortWithinPartitions(*KEY).select(*KEY, "times", "low", F.col("high").bitwiseXOR(F.col("low")).alias("more")).write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("k0 long, k1 long, k2 long, times long, low long, more long").parquet(path).select(*KEY, "times", "low", F.col("low").bitwiseXOR(F.col("more")).alias("high"))

    def insert(self, batch: DataFrame) -> None:
        """Adds a batch of entries (k0, k1, k2, run), matches it with all levels and merges those of equal size."""
        one = F.lit(1).cast("long").alias("times")
        size, path = 1, self._write(self._merge(batch.select(*KEY, one, F.col("run").alias("low"), F.col("run").alias("high"))))
        while self.levels and self.levels[-1][0] == size:  # what meets here has times > 1 from now on
            _, other = self.levels.pop()
            merged = self._write(self._merge(self._read(other).union(self._read(path))))
            drop_path(self.spark, other)
            drop_path(self.spark, path)
            size, path = 2 * size, merged
        for _, other in self.levels:
            old, new = self._read(other).alias("o"), self._read(path).alias("n")
            both = old.join(new, KEY).select(*KEY, (F.col("o.times") + F.col("n.times")).alias("times"), F.least("o.low", "n.low").alias("low"), F.greatest("o.high", "n.high").alias("high"))
            self.met.append(self._write(both, "met"))
        self.levels.append((size, path))

    def repeated(self) -> DataFrame:
        """(k0, k1, k2, same: whether all of its entries have one text) of the keys with more than one entry in the whole family."""
        rows = None
        for path in [*(p for _, p in self.levels), *(self.met if len(self.levels) > 1 else ())]:
            own = self._read(path).where("times > 1")
            rows = own if rows is None else rows.union(own)
        return rows.groupBy(*KEY).agg((F.min("low") == F.max("high")).alias("same")) if len(self.levels) > 1 else rows.select(*KEY, (F.col("low") == F.col("high")).alias("same"))


def marks(docs: DataFrame, batches: int = 4, span: int = SPAN) -> DataFrame:
    """(d, t, marks: [(lo, n)]): the window starts lo to lo + n of docs (d, t, text) whose window repeats."""
    spark = docs.sparkSession
    occ = stage(entries(docs, batches, span), "entries")
    family = Family(spark)
    for i in range(batches):
        family.insert(occ.where(F.col("batch") == i))
    hits = stage(occ.drop("batch").join(family.repeated(), KEY).select(F.xxhash64(*KEY).alias("key"), "d", "t", "run", "lo", "n", "same"), "hits")

    # passage ends: one place for each distinct run of a key with several
    ends = hits.where("NOT same").groupBy("key", "run").agg(F.count("*").alias("times"), F.min(F.struct("d", "t", "lo", "n")).alias("x"))
    ends = stage(ends.select("key", "run", "times", "x.*"), "ends")
    hot = stage(ends.groupBy("key").agg(F.count("*").alias("runs")).where(F.col("runs") > GROUP).select("key"), "hot")
    places = ends.groupBy("d", "t").agg(F.collect_list(F.struct("key", "run", "lo", "n")).alias("runs"))  # as many as the text has
    texts = docs.where(likely(ends, "d", "t")).select("d", "t", "text").dropDuplicates(["d", "t"])
    cuts = stage(texts.join(places, ["d", "t"]).select("text", "runs").mapInArrow(_cut(span), "key long, run long, n int, part binary"), "cuts")
    few = cuts.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(span), f"key long, run long, parts {PARTS}")
    one = cuts.join(hot, "key", "left_semi").mapInArrow(_windows(span), "h long, key long, run long, i int")
    twice = one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    many = one.join(twice, "h").groupBy("key", "run").agg(F.collect_set(F.struct(F.col("i").alias("a"), F.col("i").alias("z"))).alias("parts"))
    ends = ends.select("key", "run", "times").join(few.union(many), ["key", "run"], "left")
    ends = ends.select("key", "run", F.when(F.col("times") > 1, F.lit(None)).otherwise(F.coalesce("parts", F.array().cast(PARTS))).alias("parts"))
    whole = hits.where("same").select("d", "t", "lo", "n", F.lit(None).cast(PARTS).alias("parts"))
    partly = hits.where("NOT same").join(ends, ["key", "run"]).select("d", "t", "lo", "n", "parts").where("parts IS NULL OR size(parts) > 0")
    return stage(whole.union(partly).groupBy("d", "t").agg(F.collect_set(F.struct("lo", "n", "parts")).alias("marks")), "marks")


def _cut(span: int):
    """The text of each run in (text, runs), so that it can be compared with others of its key."""

    def f(batches):
        for b in batches:
            texts = b.column(0).cast(pa.large_binary())
            out = [[] for _ in range(4)]
            for i, runs in enumerate(b.column(1).to_pylist()):
                data = texts[i].as_buffer()
                for x in runs:
                    for o, v in zip(out, (x["key"], x["run"], x["n"], data.slice(x["lo"], x["n"] + span).to_pybytes())):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "run", "n", "part"])

    return f


def _texts(t):
    """(row, window, its place in the bytes, the bytes) of all windows of the runs in t (n, part)."""
    many = t.column("n").to_numpy().astype(np.int64) + 1
    parts = t.column("part").combine_chunks() if isinstance(t.column("part"), pa.ChunkedArray) else t.column("part")
    offs = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    data = np.frombuffer(parts.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    row = np.repeat(np.arange(len(many)), many)
    window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return row, window, (offs[:-1] - offs[0])[row] + window, data


def _windows(span: int):
    def f(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                t = b.slice(a, 2000)
                row, window, at, data = _texts(t)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(K.window_hash(data, span)[at])), t.column("key").take(rows), t.column("run").take(rows), pa.array(window.astype(np.int32))], ["h", "key", "run", "i"])

    return f


def prefix_ranks(data, at, span: int):
    """Ranks, in the order of bytes, of the ``span`` bytes from each place in ``at`` on: suffixes with one rank share them.

    By prefix doubling: the rank of 2n bytes is that of the pair of ranks of n bytes.
    """
    _, rank = np.unique(K.eights(data)[: len(data) - 7].byteswap(), return_inverse=True)
    size = 8
    while size * 2 <= span:
        _, rank = np.unique(rank[:-size].astype(np.uint64) << K.U(32) | rank[size:].astype(np.uint64), return_inverse=True)
        size *= 2
    _, rank = np.unique(rank[at].astype(np.uint64) << K.U(32) | rank[at + span - size].astype(np.uint64), return_inverse=True)
    return rank


def _compare(span: int):
    """The repeated windows of runs (key, run, n, part), which come sorted by key, as parts a to z of the windows.

    Equal windows have equal keys, so whatever holds all runs of its keys can be compared at once.
    """

    def found(t):
        row, window, at, data = _texts(t)
        rank = prefix_ranks(data, at, span)
        again = np.bincount(rank)[rank] > 1
        first = again.copy()
        first[1:] &= ~(again[:-1] & (row[1:] == row[:-1]))
        last = again.copy()
        last[:-1] &= ~(again[1:] & (row[1:] == row[:-1]))
        a, z = np.flatnonzero(first), np.flatnonzero(last)
        ends = np.searchsorted(row[a], np.arange(len(t) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(window[a].astype(np.int32)), pa.array(window[z].astype(np.int32))], ["a", "z"])
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("run").combine_chunks(), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], ["key", "run", "parts"])

    def f(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if cut:
                yield found(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield found(rest.combine_chunks())

    return f


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 4, span: int = SPAN) -> DataFrame:
    """docs with kept (binary: the bytes left), n_bytes, n_removed and spans (start, end of the removed runs, in bytes)."""
    docs = without(docs, "kept", "n_bytes", "n_removed", "spans")
    columns = docs.columns
    d, t, found_in = fresh(docs, "d", "t", "marks")
    rows = docs.withColumns({d: F.xxhash64(F.lit(3), doc_id), t: F.xxhash64(text, doc_id)})
    found = marks(rows.select(F.col(d).alias("d"), F.col(t).alias("t"), F.col(text).alias("text")), batches, span)
    some = likely(found, "d", "t", named=[d, t])
    kept = F.coalesce(F.col(text), F.lit("")).cast("binary")
    added = "kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])
    clean = rows.where(~some).select(*columns, kept.alias("kept"), F.length(kept).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    touched = rows.where(some).join(found.select(F.col("d").alias(d), F.col("t").alias(t), F.col("marks").alias(found_in)), [d, t], "left").select(*columns, found_in)

    def f(batches):
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            own = b.select(columns)
            texts = b.column(b.schema.get_field_index(text)).cast(pa.large_binary())
            out = [[], [], [], []]
            for i, ms in enumerate(b.column(b.schema.get_field_index(found_in))):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8) if texts[i].is_valid else np.zeros(0, np.uint8)
                spans, gone = [], None
                if ms.is_valid:
                    edge = np.zeros(len(data) + 1, dtype=np.int32)
                    for m in ms.as_py():
                        for p in [{"a": 0, "z": m["n"]}] if m["parts"] is None else m["parts"]:
                            edge[m["lo"] + p["a"]] += 1
                            edge[m["lo"] + p["z"] + span] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    at = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(at[::2], at[1::2])]
                out[0].append((data if gone is None else data[~gone]).tobytes())
                out[1].append(len(data))
                out[2].append(0 if gone is None else int(gone.sum()))
                out[3].append(spans)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], span_type)], [*columns, "kept", "n_bytes", "n_removed", "spans"])

    return clean.union(touched.mapInArrow(K.tidy(f), schema))


def op10_suffix_family(spark, sf_dir):
    """What is left of all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(generate_series(0, len(h) // 2 - {SPAN})) AS i FROM d WHERE len(h) >= {2 * SPAN}),
w AS MATERIALIZED (SELECT r, i, md5_number(array_slice(h, 2 * i + 1, 2 * i + {2 * SPAN})) AS k FROM p),
m AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {SPAN} THEN 0 ELSE 1 END AS new FROM m)),
s AS (SELECT r, min(i) AS a, max(i) + {SPAN} AS z FROM g GROUP BY r, run),
c AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM s),
l AS (SELECT r, string_agg(array_slice(d.h, 2 * y + 1, 2 * a), '' ORDER BY a) || array_slice(any_value(d.h), 2 * max(z) + 1, len(any_value(d.h))) AS kept, sum(z - a) AS n_removed, count(*) AS n_spans FROM c JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""


def brute(docs, span: int = SPAN):
    """The same by counting all strings, for tests: docs is a list of (id, text)."""
    from collections import Counter

    docs = [(k, (x or "").encode()) for k, x in docs]
    seen = Counter(x[i : i + span] for _, x in docs for i in range(len(x) - span + 1))
    for k, x in docs:
        gone = [False] * len(x)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        left = bytes(b for b, g in zip(x, gone) if not g)
        yield k, len(x), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()
