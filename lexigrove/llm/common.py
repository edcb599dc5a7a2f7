"""Tables, shared folders and small DataFrame helpers of the training-data operators."""

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workdir import shared_dir, spread

WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_scratch: list[str] = []  # folders of work_path(), in order


def work_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; it stays, as results that read it are lazy, until sweep() or the end of the shared folder."""
    _scratch.append(f"{shared_dir(spark)}/lexigrove-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Lets rows go to Python workers a few at a time where the session leaves that at its default.

    Texts may be long and there are several workers to a core, each with a batch of its own; the
    kernels gain nothing from more than a few MB.
    """
    for name, (default, value) in BATCH.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, step):
    """step(), a DataFrame that stage() has just written; all else that was written meanwhile is deleted."""
    mark = len(_scratch)
    out = step()
    kept = _scratch.pop()
    for path in _scratch[mark:]:
        drop_path(spark, path)
    _scratch[mark:] = [kept]
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of work_path()."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def sql_fold(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, which an operator adds anew."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that df has not, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def beside(docs: DataFrame, added: tuple[str, ...], step) -> DataFrame:
    """The rows that step(docs) leaves, with the columns of docs as they were, though step replaces those named in ``added``."""
    other = docs.withColumns({c: F.lit(None).cast("int") for c in added if c.lower() not in {x.lower() for x in docs.columns}})
    clash = [c for c in docs.columns if c.lower() in {a.lower() for a in added}]
    back = dict(zip(clash, fresh(other, *clash)))
    out = step(docs.withColumnsRenamed(back))
    return out.select(*[F.col(f"`{back.get(c, c)}`").alias(c) for c in docs.columns])


def row_hash(df: DataFrame):
    """A hash of whole rows, whatever the types of their columns."""

    def plain(kind) -> bool:
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return F.xxhash64(*[F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields])


def one_of(df: DataFrame, *keys: str) -> DataFrame:
    """One row of df for each value of ``keys``, the same in every run: that whose JSON text is least."""
    row, text = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    found = df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.coalesce(text, F.lit(""))).alias("row"))
    return found.select("row.*")


def numbered(df: DataFrame, order: list, name: str, per: tuple[str, ...] = ()) -> DataFrame:
    """df, written down, with ``name``: its number from 1 on in this order, within ``per``, columns that the order begins with.

    Rows are cut into ranges, numbered in each and offset by the rows of the ranges before, which are
    counted first, so that no task sees all rows of a group.
    """
    part, at, first, before = fresh(df, "part", "at", "first", "before")
    own = [f"{c}_" for c in fresh(df, *per)]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at))
    rows = stage(rows, "numbered")
    counts = rows.groupBy(part, *per).agg(F.count("*").alias("n"), F.min(at).alias(first))  # a row for each range and group in it
    earlier = Window.partitionBy(*per).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(part).alias("part_"), *[F.col(c).alias(o) for c, o in zip(per, own)], first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    same = F.col(part) == F.col("part_")
    for c, o in zip(per, own):
        same &= F.col(c).eqNullSafe(F.col(o))
    return rows.join(counts, same).withColumn(name, F.col(before) + F.col(at) - F.col(first) + 1).select(*df.columns, name)


FILTER = 1 << 21  #: buckets of the filter of likely()


def likely(keys: DataFrame, *columns: str, named: list[str] | None = None):
    """A condition that holds for all rows whose ``columns`` (there ``named``) are in keys, and for few others as long as keys are few.

    One bit for each of FILTER buckets of the columns' hash, whatever the number of keys: what is sent
    to the executors has this fixed size.  It spares rows without a partner the shuffle of a join that
    follows, and decides nothing.
    """

    def bucket(names):
        return F.pmod(F.xxhash64(*names), F.lit(FILTER)).cast("int")

    ones = np.zeros(FILTER, dtype=bool)
    ones[keys.select(bucket(columns).alias("b")).distinct().toPandas()["b"].to_numpy(dtype=np.int64)] = True
    sent = keys.sparkSession.sparkContext.broadcast(np.packbits(ones))

    @F.pandas_udf("boolean")
    def has(b):
        import pandas as pd

        b = b.to_numpy()
        return pd.Series((sent.value[b >> 3] >> (7 - (b & 7)) & 1).astype(bool))

    return has(bucket(named or columns))
