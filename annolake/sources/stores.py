"""Stores of named things: dictionaries, datasets, pipelines, results. A store is an
append-only table: saving or deleting a name adds a version of it, and what is read are each name's newest rows. So
writers never rewrite what readers read, and any path that Spark opens will do."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.operators import analytics
from annolake.plans import pipeline
from annolake.schema import SPANS, checked

SAFE_NAME = r"[A-Za-z0-9][A-Za-z0-9_.\-]*"
DOCUMENT_ROWS = f"doc_id string, text string, metadata map<string,string>, spans {SPANS}"


class Store:
    """Rows of ``schema`` under names, one folder for each name."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, version long, gone boolean, name string"
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("name").parquet(path)

    def _log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _newest(self, log: DataFrame) -> DataFrame:
        newest = log.groupBy("name").agg(F.max("version").alias("version"))
        # one row a name: a shuffle by name would put a dataset's whole texts into one task
        return log.join(F.broadcast(newest), ["name", "version"])

    def _add(self, name: str, rows: DataFrame, gone: bool) -> None:
        last = self._log().where(F.col("name") == name).agg(F.max("version")).first()[0]
        marked = rows.select(*self.columns, F.lit((last or 0) + 1).cast("long").alias("version"), F.lit(gone).alias("gone"), F.lit(name).alias("name"))
        marked.write.mode("append").partitionBy("name").parquet(self.path)

    def _stub(self) -> DataFrame:
        """One row that marks a version that holds none of its own."""
        types = dict(self.spark.createDataFrame([], self.schema).dtypes)
        return self.spark.range(1).select(*[F.lit(None).cast(types[c]).alias(c) for c in self.columns])

    def current(self) -> DataFrame:
        """name and the rows of every name that wasn't deleted."""
        return self._newest(self._log()).where("NOT gone").select("name", *self.columns)

    def names(self) -> list[str]:
        return [r[0] for r in self._newest(self._log().select("name", "version", "gone")).where("NOT gone").select("name").distinct().orderBy("name").collect()]

    def exists(self, name: str) -> bool:
        return not self._newest(self._log().where(F.col("name") == name)).where("NOT gone").isEmpty()

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(f"nothing is named {name!r}; known: {self.names()}")
        return self.current().where(F.col("name") == name).drop("name")

    def save(self, name: str, rows: DataFrame, overwrite: bool = True) -> None:
        if not re.fullmatch(SAFE_NAME, name):
            raise ValueError(f"not a name: {name!r}")
        if not overwrite and self.exists(name):
            raise ValueError(f"{name!r} is there already")
        self._add(name, rows, False)

    def delete(self, name: str) -> None:
        self.load(name)
        self._add(name, self._stub(), True)

    def rename(self, name: str, to: str) -> None:
        self.save(to, self.load(name), overwrite=False)
        self.delete(name)


class Dictionaries(Store):
    """Term lists by kind (whitelist, blacklist) and, for whitelists, label; named kind.label.name or kind.name."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "kind string, label string, title string, term string")

    @staticmethod
    def key(kind: str, title: str, label: str | None = None) -> str:
        if kind not in ("whitelist", "blacklist"):
            raise ValueError(f"unknown kind {kind!r}")
        return ".".join(x for x in (kind, label, title) if x)

    def put(self, kind: str, title: str, terms: DataFrame, label: str | None = None) -> None:
        """Saves a list, or replaces it: terms trimmed, blank and repeated ones left out."""
        clean = terms.select(F.trim("term").alias("term")).where("term != ''").distinct()
        self.save(self.key(kind, title, label), clean.select(F.lit(kind).alias("kind"), F.lit(label).cast("string").alias("label"), F.lit(title).alias("title"), "term"))

    def listing(self, kind: str | None = None, label: str | None = None) -> DataFrame:
        """(kind, label, title, terms) of every list."""
        d = self.current()
        d = d.where(F.col("kind") == kind) if kind else d
        d = d.where(F.col("label") == label) if label else d
        return d.groupBy("kind", "label", "title").agg(F.count("*").alias("terms"))

    def preview(self, kind: str, title: str, label: str | None = None, n: int = 20) -> DataFrame:
        return self.load(self.key(kind, title, label)).select("term").orderBy(F.lower("term"), "term").limit(n)

    def merged(self, kind: str, titles: list[str] | None = None) -> DataFrame:
        """The different terms of several lists of a kind, whatever their label."""
        d = self.current().where(F.col("kind") == kind)
        return (d.where(F.col("title").isin(list(titles))) if titles is not None else d).select("term").distinct()


class Datasets(Store):
    """Annotated corpora, and a manifest row for each."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, DOCUMENT_ROWS)
        self.manifests = Store(spark, f"{path.rstrip('/')}-manifests", "manifest string, error string")

    def commit(self, name: str, docs: DataFrame, overwrite: bool = False) -> None:
        meta = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
        rows = checked(docs.withColumn("metadata", meta)).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "metadata", "spans")
        if rows.isEmpty():
            raise ValueError("the corpus is empty")
        self.save(name, rows, overwrite)
        self.refresh(name)

    def refresh(self, name: str) -> None:
        """Counts a dataset anew. A dataset that can't be read gets a manifest that says why."""
        try:
            b = analytics.bundle(self.load(name))
            row = b.select(F.to_json(F.struct(*b.columns)).alias("manifest"), F.lit(None).cast("string").alias("error"))
            self.manifests.save(name, row)
        except (AnalysisException, SparkRuntimeException) as e:  # what a broken dataset raises; a lost executor is no such thing
            self.manifests.save(name, self.spark.createDataFrame([(None, str(e).splitlines()[0])], "manifest string, error string"))

    def refresh_all(self) -> None:
        """Every dataset by itself, so that a broken one keeps none of the others."""
        for name in self.names():
            self.refresh(name)

    def remove(self, name: str) -> None:
        self.delete(name)
        if self.manifests.exists(name):
            self.manifests.delete(name)


class Pipelines(Store):
    """Pipelines as JSON under names; only valid ones are saved."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "config string")

    def put(self, name: str, config: dict) -> None:
        if wrong := pipeline.validate(config):
            raise ValueError("; ".join(wrong))
        self.save(name, self.spark.createDataFrame([(pipeline.dump(config),)], "config string"))

    def config(self, name: str) -> dict:
        return json.loads(self.load(name).first()["config"])


class Results(Store):
    """Stored evaluations and runs; each adds a row, nothing is replaced."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "created timestamp, pipeline string, source string, documents long, metrics string")

    def add(self, name: str, pipeline_name: str, source: str, documents: int, metrics: DataFrame) -> None:
        row = metrics.select(F.current_timestamp().alias("created"), F.lit(pipeline_name).alias("pipeline"), F.lit(source).alias("source"), F.lit(documents).cast("long").alias("documents"), F.to_json(F.struct(*metrics.columns)).alias("metrics"))
        self.save(name, row, overwrite=False)

    def newest(self, pipeline_name: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """One page of the results, newest first."""
        d = self.current()
        d = d.where(F.col("pipeline") == pipeline_name) if pipeline_name else d
        return d.orderBy(F.desc("created"), F.desc("name")).offset(offset).limit(limit)
