"""A full-text search engine over a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import retrieve
from ..sources.store import Store


class SearchEngine:
    """open, insert, insert_bulk, update, delete, search, count, fragmentation_rate, compact, reset, close."""

    def __init__(self, spark: SparkSession):
        self.spark, self._store = spark, None

    def open(self, path: str, schema: T.StructType | str | None = None, lock_timeout: float = 5.0) -> SearchEngine:
        """Opens the index under ``path``; ``schema`` (of the documents' fields) makes a new one."""
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        self._store = Store(self.spark, path, schema, lock_timeout)
        return self

    def close(self) -> None:
        self._store = None

    @property
    def store(self) -> Store:
        if self._store is None:
            raise RuntimeError("the engine is not open")
        return self._store

    def _rows(self, documents: list[dict]) -> DataFrame:
        schema = self.store.schema
        return self.spark.createDataFrame([tuple(d.get(f.name) for f in schema.fields) for d in documents], schema).coalesce(1)

    def insert(self, document: dict) -> int:
        return self.insert_bulk([document])[0]

    def insert_bulk(self, documents: list[dict] | DataFrame, order: list[str] | None = None) -> list[int] | DataFrame:
        """Adds documents in one commit: a list gives a list of ids, a DataFrame of any size one of ids."""
        if isinstance(documents, DataFrame):
            return self.store.insert(documents, order)
        return [r["doc_id"] for r in self.store.insert(self._rows(documents)).collect()] if documents else []

    def update(self, doc_id: int, document: dict) -> int:
        """Deletes doc_id and adds the document under a new id, in one commit."""
        ids = self.spark.createDataFrame([(doc_id,)], "doc_id long")
        return self.store.insert(self._rows([document]), remove=ids).first()["doc_id"]

    def delete(self, doc_id: int | list[int] | DataFrame) -> None:
        if not isinstance(doc_id, DataFrame):
            doc_id = self.spark.createDataFrame([(i,) for i in (doc_id if isinstance(doc_id, list) else [doc_id])], "doc_id long")
        self.store.delete(doc_id)

    def get(self, doc_id: int) -> DataFrame:
        """The document of this id, if there is one that isn't deleted."""
        index = self.store.index()
        rows = index.documents.where(F.col("doc_id") == doc_id)
        return rows if index.tombstones is None else rows.join(index.tombstones, "doc_id", "left_anti")

    def search(self, query: str, limit: int = 20, max_candidates: int = retrieve.MAX_CANDIDATES, boosts: dict[str, float] | None = None, filters: dict | None = None, highlight: bool = False, highlight_options: dict | None = None) -> DataFrame:
        return retrieve.search(self.store.index(), query, limit, max_candidates, boosts, filters, highlight, highlight_options)

    def search_many(self, queries: DataFrame, **options) -> DataFrame:
        return retrieve.search_many(self.store.index(), queries, **options)

    def count(self) -> int:
        return self.store.count()

    def fragmentation_rate(self) -> int:
        return self.store.fragmentation()

    def compact(self) -> None:
        self.store.compact()

    def reset(self) -> None:
        self.store.reset()
