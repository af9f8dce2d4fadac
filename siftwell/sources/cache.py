"""Scores that are computed once: a cache of rows by query, keyed by digests of what they were made from.

A key is the SHA-256 of its named parts (digests of matrix and catalog, seed, window), so a changed catalog or another
window is another key and never mixes. Each fill writes a batch of its own, the queries that it covers and their rows, and then
renames one small file into the folder of committed batches. Readers take committed batches alone, so a fill that dies leaves
nothing that counts, and two fills at once at worst compute a query twice, of which the batch of the smaller name counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ScoreCache:
    """``schema`` (DDL) of the rows, which hold the query's id in ``by``; ``parts`` name what the rows depend on."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str = "qid", **parts):
        self.spark, self.by, self.schema = spark, by, schema
        self.key = hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.folder = f"{path.rstrip('/')}/{self.key}"
        self.parts = parts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        at = self._path(f"{self.folder}/committed")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _owned(self) -> DataFrame:
        """``by, batch``: the batch that counts for each query."""
        names = self.batches()
        kind = f"`{self.by}` {dict(self.spark.createDataFrame([], self.schema).dtypes)[self.by]}, batch string"
        if not names:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{n}/queries" for n in names]).groupBy(self.by).agg(F.min("batch").alias("batch"))

    def rows(self) -> DataFrame:
        """The rows of all queries that are known."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        every = self.spark.read.schema(f"{self.schema}, batch string").parquet(*[f"{self.folder}/{n}/rows" for n in names])
        return every.join(self._owned(), [self.by, "batch"], "left_semi").drop("batch")

    def missing(self, queries: DataFrame) -> DataFrame:
        """Those of ``queries`` that no batch covers."""
        return queries.join(self._owned(), self.by, "left_anti")

    def fill(self, queries: DataFrame, compute) -> int:
        """Compute (``compute(queries) -> rows``) what is missing; the number of queries that were computed.

        A query for which there are no rows is covered as well, and not asked again.
        """
        batch = uuid.uuid4().hex
        at = f"{self.folder}/{batch}"
        self.missing(queries).withColumn("batch", F.lit(batch)).write.parquet(f"{at}/todo")
        todo = self.spark.read.parquet(f"{at}/todo").drop("batch")
        n = todo.select(self.by).distinct().count()
        if n:
            names = self.spark.createDataFrame([], self.schema).columns
            compute(todo).select(*names).withColumn("batch", F.lit(batch)).write.parquet(f"{at}/rows")
            todo.select(self.by).distinct().withColumn("batch", F.lit(batch)).write.parquet(f"{at}/queries")
            self._commit(batch)
        self._fs.delete(self._path(f"{at}/todo" if n else at), True)
        return n

    def _commit(self, batch: str) -> None:
        told = self._path(f"{self.folder}/{batch}/parts.json")
        out = self._fs.create(told, True)
        out.write(json.dumps({"parts": self.parts, "batch": batch}, sort_keys=True, default=str).encode())
        out.close()
        self._fs.mkdirs(self._path(f"{self.folder}/committed"))
        if not self._fs.rename(told, self._path(f"{self.folder}/committed/{batch}")):
            raise OSError(f"batch {batch} could not be committed")
