"""A stored index: immutable Parquet segments, and manifests that name those of each version.

Every commit writes new segment folders and then the next manifest, by a rename, so readers see a whole
version or the one before, and what a crash leaves behind belongs to no version.  Opening takes no lock.  The
last KEEP versions, and those younger than KEEP_SECONDS, keep their segments, so that what reads them isn't
disturbed by later commits; commits sweep the rest.  Segments: documents (doc_id, fields, n_trigrams; of inserted ones what they were analysed to, too), forward
(doc_id, n_trigrams, grams), postings (trigram, doc_id; clustered by trigram) and tombstones (doc_id).  The
dictionary and the statistics are kept per segment and summed.  FAN segments of about one size are merged, from
what is written down, so that few are left however often documents are added.

The folder is on any file system that driver and executors share.
"""

from __future__ import annotations

import gc
import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import Index, clustered, dictionary_of, document_trigrams, forward_of, stats_of
from .files import Files
from .lock import Lock

VERSION = 2
KEEP, KEEP_SECONDS = 3, 600
FAN = 8
LARGE = 10_000  #: documents of a segment after which shuffles are cleared away
_KINDS = {
    "postings": "trigram string, doc_id long",
    "forward": "doc_id long, n_trigrams int, grams array<int>",
    "dictionary": "trigram string, df long",
    "stats": "n long, trigram_sum long",
    "tombstones": "doc_id long",
}


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, lock_timeout: float = 5.0):
        self.spark, self.files = spark, Files(spark, path)
        local = self.files.local
        self.path = local or self.files.base
        self.lock = Lock(f"{local}/.lock", lock_timeout) if local else Lock(".lock", lock_timeout, files=self.files)
        if self.files.exists("") and self._versions():
            self._load()
            if schema is not None and schema != self.schema:
                raise ValueError("the stored index has another schema")
        else:
            if schema is None:
                raise ValueError(f"{path} has no index; give the schema of its documents")
            self.files.make()
            with self.lock:
                if self._versions():  # another was faster
                    self._load()
                else:
                    self.state = {"format_version": VERSION, "version": 0, "schema": json.loads(schema.json()), "next_id": 0, "segments": [], "tombstones": [], "n": 0, "deleted": 0}
                    self._commit(self.state)

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json"))

    @property
    def schema(self) -> T.StructType:
        """The schema of the documents' own fields."""
        return T.StructType.fromJson(self.state["schema"])

    def _manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"manifest-{version:012d}.json"))

    def _load(self) -> None:
        state = self._manifest(self._versions()[-1])
        if state.get("format_version") != VERSION:
            raise ValueError(f"{self.path}: format {state.get('format_version')} isn't {VERSION}")
        self.state = state

    def _commit(self, state: dict) -> None:
        state = dict(state) | {"version": state["version"] + 1, "time": time.time()}
        temporary = f"manifest.{uuid.uuid4().hex}"
        self.files.write(temporary, json.dumps(state))
        if not self.files.rename(temporary, f"manifest-{state['version']:012d}.json"):
            raise OSError(f"{self.path}: version {state['version']} is there already")
        self.state = state

    def _sweep(self) -> None:
        """Deletes what no version that is kept refers to."""
        used, now = {".lock"}, time.time()
        for i, version in enumerate(reversed(self._versions())):
            state = self._manifest(version)
            if i < KEEP or now - state["time"] < KEEP_SECONDS:
                used |= {f"manifest-{version:012d}.json", *(s["name"] for s in state["segments"]), *state["tombstones"]}
        for name in self.files.names():
            if name not in used and not name.endswith(".crc"):
                self.files.delete(name)

    def _write(self, name: str, rows: DataFrame | None, forward: DataFrame, stats: DataFrame | None = None, dictionary: DataFrame | None = None) -> None:
        """Writes the tables of a segment, those that don't need each other at the same time; postings follow from forward.  rows: None if they are there."""
        at = self.files.path(name)

        def inverted():
            forward.write.parquet(f"{at}/forward")
            grams = self._read("forward", [name], _KINDS["forward"])
            (dictionary if dictionary is not None else dictionary_of(grams)).write.parquet(f"{at}/dictionary")
            clustered(grams, self._read("dictionary", [name], _KINDS["dictionary"])).write.parquet(f"{at}/postings")

        def documents():
            if rows is not None:
                rows.write.parquet(f"{at}/documents")
            own = stats if stats is not None else stats_of(self.spark.read.schema(self._documents_schema()).parquet(f"{at}/documents"))
            own.coalesce(1).write.parquet(f"{at}/stats")

        with ThreadPoolExecutor(2) as pool:
            for job in [pool.submit(inverted), pool.submit(documents)]:
                job.result()

    def _segment(self, documents: DataFrame, grams, source: str) -> tuple[str, int]:
        """Writes documents (doc_id, fields), read from the folder ``source``, with their postings as one segment; its name and number of documents.

        What they were analysed to is a column beside the fields, from which the other tables follow; source goes once it is there.
        """
        name, own = f"segment-{uuid.uuid4().hex}", "_grams"
        while own.lower() in {c.lower() for c in documents.columns}:
            own = f"_{own}"
        rows = documents.withColumn(own, grams).withColumn("n_trigrams", F.size(own))
        rows.write.parquet(self.files.path(f"{name}/documents"))
        self.files.delete(source)
        rows = self.spark.read.schema(rows.schema).parquet(self.files.path(f"{name}/documents"))
        self._write(name, None, forward_of(rows, F.col(own)))
        n = self._read("stats", [name], _KINDS["stats"]).first()["n"]
        if n >= LARGE:
            self._free()
        return name, n

    def _merged(self, state: dict) -> dict:
        """state with each FAN segments of about one size made one, from the tables that they have."""
        segments = state["segments"]
        while True:
            by: dict[int, list[dict]] = {}
            for s in segments:
                size = 0
                while FAN ** (size + 1) <= s["n"]:
                    size += 1
                by.setdefault(size, []).append(s)
            some = next((v for _, v in sorted(by.items()) if len(v) >= FAN), None)
            if some is None:
                return dict(state) | {"segments": segments}
            names, name = [s["name"] for s in some], f"segment-{uuid.uuid4().hex}"
            stats, dictionary = self._read("stats", names, _KINDS["stats"]), self._read("dictionary", names, _KINDS["dictionary"])
            self._write(
                name, self._read("documents", names, self._documents_schema()), self._read("forward", names, _KINDS["forward"]),
                stats.agg(F.sum("n").alias("n"), F.sum("trigram_sum").alias("trigram_sum")), dictionary.groupBy("trigram").agg(F.sum("df").alias("df")),
            )
            segments = [s for s in segments if s not in some] + [{"name": name, "n": sum(s["n"] for s in some)}]

    def _read(self, kind: str, names: list[str], schema) -> DataFrame:
        paths = [self.files.path(f"{n}/{kind}" if kind != "tombstones" else n) for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _documents_schema(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", T.LongType()), *self.schema.fields, T.StructField("n_trigrams", T.IntegerType())])

    def _index(self, s: dict) -> Index:
        names = [x["name"] for x in s["segments"]]
        dictionary = self._read("dictionary", names, _KINDS["dictionary"])
        stats = self._read("stats", names, _KINDS["stats"])
        if len(names) > 1:
            dictionary = dictionary.groupBy("trigram").agg(F.sum("df").alias("df"))
        stats = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("trigram_sum"), F.lit(0)).alias("trigram_sum"))
        return Index(
            self._read("documents", names, self._documents_schema()), self._read("postings", names, _KINDS["postings"]), dictionary, stats,
            self._read("tombstones", s["tombstones"], _KINDS["tombstones"]) if s["tombstones"] else None, tuple(f.name for f in self.schema.fields), self._read("forward", names, _KINDS["forward"]),
        )

    def index(self) -> Index:
        """The newest version as an index; later commits don't touch it as long as it is kept."""
        if (version := self._versions()[-1]) != self.state["version"]:
            self._load()
        if getattr(self, "_current", (None,))[0] != version:
            self._current = version, self._index(self.state)
        return self._current[1]

    def _free(self) -> None:
        """Lets Spark delete the files of shuffles that are done, which it does when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _number(self, df: DataFrame, order: list[str] | None, first: int) -> tuple[DataFrame, str]:
        """df with doc_id from ``first`` on: in the order of columns, or as the rows come; and the folder that it is read from.

        Rows are numbered in each partition and offset by the rows of those before it, which are
        counted first, so that no single task sees them all.
        """
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        name = f"rows-{uuid.uuid4().hex}"
        path = self.files.path(name)
        rows = rows.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
        rows.write.parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        if order:
            self._free()
        parts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # one row for each partition
        offsets = parts.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        out = rows.join(F.broadcast(offsets), "_p")
        return out.withColumn("doc_id", F.lit(first) + F.col("_o") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_o", "_first"), name

    def _rows(self, documents: DataFrame) -> DataFrame:
        names = {c.lower() for c in documents.columns}
        return documents.select(*[(F.col(f"`{f.name}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def insert(self, documents: DataFrame, order: list[str] | None = None, remove: DataFrame | None = None, note: dict | None = None) -> DataFrame:
        """Adds documents in one commit and returns their doc_ids, in order.

        remove: ids (doc_id) deleted in the same commit.  note: entries that the manifest gets with it.
        """
        with self.lock:
            self._load()
            state = dict(self.state)
            first = state["next_id"]
            numbered, source = self._number(self._rows(documents), order, first)
            name, n = self._segment(numbered.select("doc_id", *[f.name for f in self.schema.fields]), document_trigrams(self.schema), source)
            state |= {"segments": [*state["segments"], {"name": name, "n": n}] if n else state["segments"], "next_id": first + n, "n": state["n"] + n}
            state |= note or {}
            if remove is not None:
                self._tombstone(state, remove)
            self._commit(self._merged(state))
            self._sweep()
            return self.spark.range(first, first + n).select(F.col("id").alias("doc_id"))

    def _tombstone(self, state: dict, ids: DataFrame) -> None:
        name = f"tombstones-{uuid.uuid4().hex}"
        new = ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
        if state["tombstones"]:
            new = new.join(self._read("tombstones", state["tombstones"], _KINDS["tombstones"]), "doc_id", "left_anti")
        new.write.parquet(self.files.path(name))
        n = self._read("tombstones", [name], _KINDS["tombstones"]).count()
        if n:
            state |= {"tombstones": [*state["tombstones"], name], "deleted": state["deleted"] + n}

    def delete(self, ids: DataFrame) -> None:
        """Marks ids (doc_id) as deleted, known or not; a second time changes nothing."""
        with self.lock:
            self._load()
            state = dict(self.state)
            self._tombstone(state, ids)
            self._commit(state)
            self._sweep()

    def count(self) -> int:
        return self.state["n"] - self.state["deleted"]

    def fragmentation(self) -> int:
        """Deleted documents in percent of all written since the last compaction, rounded."""
        n = self.state["n"]
        return int(100 * self.state["deleted"] / n + 0.5) if n else 0

    def compact(self) -> None:
        """Rewrites everything as one segment without deleted documents; doc_ids stay.  Nothing is analysed again."""
        with self.lock:
            self._load()
            index = self._index(self.state)
            name = f"segment-{uuid.uuid4().hex}"
            tables = [index.documents, index.forward]
            if index.tombstones is not None:
                tables = [t.join(index.tombstones, "doc_id", "left_anti") for t in tables]
            docs = tables[0].select("doc_id", *[f.name for f in self.schema.fields], "n_trigrams")
            self._write(name, docs, tables[1].select("doc_id", "n_trigrams", "grams"))
            n = self._read("stats", [name], _KINDS["stats"]).first()["n"]
            self._commit(dict(self.state) | {"segments": [{"name": name, "n": n}] if n else [], "tombstones": [], "n": n, "deleted": 0})
            self._sweep()

    def reset(self) -> None:
        with self.lock:
            self._load()
            self._commit(dict(self.state) | {"segments": [], "tombstones": [], "next_id": 0, "n": 0, "deleted": 0})
            self._sweep()
