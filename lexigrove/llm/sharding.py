"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into buckets that fit a task's memory, by a seeded hash of their id and
text; pass two puts each bucket into a fixed order, shuffles it (Fisher-Yates, seeded by the bucket) and
writes it.  The buckets, one after another, are one shuffled sequence; shards are equal cuts of it, so
that their counts of rows are at most one apart, and each bucket falls into one shard or two.

The number of buckets follows from the bytes of the table.  Rows of one id and text all have one hash;
where these alone would overfill a bucket, they are numbered, by their other columns, and each
bucketful of them has a hash of its own.  Buckets' counts of rows are all that the driver holds, 8 bytes
for each BUCKET_BYTES of the table.

Null texts have no bytes, null ids are a value like others, an empty table makes no shard files.
Columns named shard or slot are replaced, others pass through whatever their names and types.  The same
rows, seed and bucket size give the same shards and slots, however the rows come, up to exchanges
between rows that are equal in all columns.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import fresh, likely, numbered, row_hash, stage, table, without, work_path

BUCKET_BYTES = 12 << 20  #: bytes of text, and 64 a row, that a bucket holds on average
TASKS = 50_000  #: tasks of pass two at most; beyond it, a task takes several buckets, one after another


def _size(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 17, path: str | None = None, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs in shuffled order to ``path``/shard=N and reads them back, with shard and slot."""
    spark = docs.sparkSession
    docs = without(docs, "shard", "slot")
    columns, kinds = docs.columns, docs.schema.fields
    schema = T.StructType([*kinds, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    key, tie, rank, salt, bucket, per = fresh(docs, "key", "tie", "rank", "salt", "bucket", "per")
    docs = docs.withColumns({key: F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), tie: row_hash(docs)})

    keys = stage(docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(_size(text) + 64).alias("bytes")), "keys")
    total, held = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], schema)
    buckets = max(1, -(-held // bucket_bytes))

    def place(k, salt):
        return F.pmod(F.xxhash64(F.lit(seed + 1), k, salt), F.lit(buckets)).cast("int")

    zero = F.lit(0).cast("long")
    counts = keys.select(place(F.col("key"), zero).alias("bucket"), "n")
    hot = keys.where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select(F.col("key").alias(key), F.greatest(F.lit(1), F.floor(bucket_bytes * F.col("n") / F.col("bytes"))).cast("long").alias(per))
    if hot.isEmpty():
        placed = docs.withColumn(bucket, place(F.col(key), zero))
    else:
        hot = stage(hot, "hot")
        some = likely(hot, key)
        split = numbered(docs.where(some).join(hot, key), [key, tie], rank, (key,)).withColumn(salt, F.floor((F.col(rank) - 1) / F.col(per)).cast("long"))
        split = stage(split.withColumn(bucket, place(F.col(key), F.col(salt))).select(*columns, key, tie, bucket), "split")
        rest = docs.where(~some).union(docs.where(some).join(hot, key, "left_anti").select(docs.columns)).withColumn(bucket, place(F.col(key), zero))
        placed = rest.select(*columns, key, tie, bucket).union(split)
        counts = keys.join(hot.withColumnRenamed(key, "key"), "key", "left_anti").select(place(F.col("key"), zero).alias("bucket"), "n").union(split.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("n")))
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    rows_of = np.zeros(buckets, dtype=np.int64)
    rows_of[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    before = spark.sparkContext.broadcast(np.cumsum(rows_of) - rows_of)  # the rows in earlier buckets
    small, extra = divmod(total, shards)  # the first ``extra`` shards hold a row more
    firsts = np.cumsum([0] + [small + (s < extra) for s in range(shards)])

    def shuffled(kept):
        """One bucket in shuffled order, with shard and slot; takes the batches out of the list, so that they aren't held twice."""
        t = pa.Table.from_batches(kept)
        kept.clear()
        b = t.column(bucket)[0].as_py()
        own = np.lexsort((t.column(tie).to_numpy(), t.column(key).to_numpy())).tolist()
        swap = (np.random.default_rng([seed, b]).random(len(own)) * np.arange(1, len(own) + 1)).astype(np.int64).tolist()
        for i in range(len(own) - 1, 0, -1):  # Fisher-Yates: row i changes places with one of 0 to i
            j = swap[i]
            own[i], own[j] = own[j], own[i]
        at = int(before.value[b]) + np.arange(len(own))
        shard = np.searchsorted(firsts, at, "right") - 1
        out = t.select(columns).combine_chunks().take(pa.array(own, pa.int64()))
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - firsts[shard]))

    def f(batches):
        kept, now = [], None
        for b in batches:
            while b.num_rows:
                ids = b.column(b.schema.get_field_index(bucket)).to_numpy()
                if now is not None and ids[0] != now:
                    yield from shuffled(kept).to_batches(max_chunksize=500)
                now = ids[0]
                other = np.flatnonzero(ids != now)
                end = int(other[0]) if len(other) else b.num_rows
                kept.append(b.slice(0, end))
                b = b.slice(end)
        if kept:
            yield from shuffled(kept).to_batches(max_chunksize=500)

    path = path or work_path(spark, "shards")
    tasks = min(buckets, TASKS)
    # a task's buckets come one after another
    placed = placed.repartitionById(tasks, F.pmod(F.col(bucket), F.lit(tasks)).cast("int"))
    if tasks < buckets:
        placed = placed.sortWithinPartitions(bucket)
    placed.mapInArrow(K.tidy(f), schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op5_external_shuffle(spark, sf_dir):
    """All documents in eight shards, in shuffled order."""
    out = external_shuffle(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", (_size("text") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
