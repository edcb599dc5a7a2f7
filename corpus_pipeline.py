"""A cleaning pipeline over documents: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is
written and read again before the next.  All but the last return the columns of documents, extra ones
too, whatever their names.  Rows without doc_id, null and empty texts pass the filters; rows that repeat a
doc_id are one document to the near-duplicate stage, which keeps one of them.  Texts of any length are
read whole.  Empty tables give empty stages: without labels nothing is toxic, without benchmark
nothing contaminated.
"""

from pyspark.sql import functions as F

from lexigrove.llm import decontaminate, mixing, neardup, sharding, toxicity
from lexigrove.llm.common import beside, likely, one_of, stage, sweep, table


def drop_toxic(spark, docs, sf_dir):
    """Drops documents that the noisy-or of their sentences scores at toxicity.THRESHOLD or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return beside(docs, ("score", "offending"), lambda x: toxicity.score(x, model).where(F.col("score") < toxicity.THRESHOLD))


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps the document of least doc_id of each near-duplicate class; of rows that repeat its id, that whose JSON text is least."""
    kept = stage(neardup.near_duplicates(docs), "kept")
    gone = kept.where("NOT kept").select("doc_id").distinct()
    again = kept.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    touched = likely(gone.union(again), "doc_id")
    some = docs.where(touched).join(gone, "doc_id", "left_anti").select(*docs.columns)
    one = one_of(some.join(again, "doc_id", "left_semi").select(*docs.columns), "doc_id")
    return docs.where(~touched).union(some.join(again, "doc_id", "left_anti").select(*docs.columns)).union(one)


def drop_contaminated(spark, docs, sf_dir):
    """Drops documents that share a run of words with any benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return beside(docs, ("n_words", "n_hit", "items", "spans"), lambda x: decontaminate.decontaminate(x, items).where(F.size("items") == 0))


def mix_sources(spark, docs, sf_dir):
    """Repeats each document by its copies under the mix, none to three."""
    return mixing.expand(docs)


def shard(spark, docs, sf_dir):
    """Writes the documents in shuffled order to eight shards."""
    return sharding.external_shuffle(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # a trained model and seeded shuffles; tests/llm hold each stage against brute force


def run(spark, sf_dir):
    """The documents that all stages kept, in shards."""

    def stages():
        docs = table(spark, sf_dir, "documents")
        for name, step in STAGES:
            docs = sweep(spark, lambda f=step, given=docs, n=name: stage(f(spark, given, sf_dir), f"pipeline-{n}"))
        return docs

    return sweep(spark, stages)  # what a stage wrote for itself goes with it, and in the end the stages' results but the last
