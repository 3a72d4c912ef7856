"""A corpus whose documents can be changed one by one. It lies in hash buckets of doc_id; a change writes anew only the buckets
that it touches, then one small manifest of all buckets' folders, whose newest version is what readers see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.schema import SPANS, checked

ROWS = f"doc_id string, text string, metadata map<string,string>, spans {SPANS}"
MANIFEST = "version long, bucket int, path string"


class BucketedCorpus:
    """Documents below ``root``: data/{write}/bucket={k}, and manifest, a table of (version, bucket, path).

    A version is one file of the manifest, written last and by one task, so readers see all of it or nothing. Folders are
    never changed: a write that fails leaves the version before it as it was, and older versions stay readable.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{self.root}/manifest")

    # ----------------------------------------------------------------------- versions

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        log = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").where("version IS NOT NULL")
        return [r[0] for r in log.groupBy("version").agg(F.count("*").alias("n")).where(F.col("n") == self.buckets).orderBy("version").select("version").collect()]

    def folders(self, version: int | None = None) -> dict[int, str | None]:
        """Each bucket's folder, null for one without documents."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise KeyError(f"no version {version}; known: {known}")
        log = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        return {r["bucket"]: r["path"] for r in log.where(F.col("version") == (known[-1] if version is None else version)).collect()}

    def read(self, version: int | None = None) -> DataFrame:
        """The documents of a version, the newest without one."""
        return self._open([p for p in self.folders(version).values() if p])

    def _open(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    # ----------------------------------------------------------------------- writes

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("doc_id")), F.lit(self.buckets)).cast("int")

    def _plain(self, docs: DataFrame) -> DataFrame:
        meta = F.col("metadata") if "metadata" in docs.columns else F.create_map().cast("map<string,string>")
        return checked(docs.withColumn("metadata", meta)).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "metadata", "spans")

    def _put(self, rows: DataFrame, old: dict[int, str | None], touched: list[int]) -> int:
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(at)
        written = self.spark.read.schema(f"{ROWS}, bucket int").parquet(at)
        filled = {r[0] for r in written.select("bucket").distinct().collect()}
        new = old | {k: f"{at}/bucket={k}" if k in filled else None for k in touched}
        known = self.versions()
        version = (known[-1] if known else 0) + 1
        self.spark.createDataFrame([(version, k, p) for k, p in sorted(new.items())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def create(self, docs: DataFrame) -> int:
        """The first version. Repeated doc_ids fail, as one of them could not be changed."""
        if self.versions():
            raise ValueError("the corpus is there already")
        rows = self._plain(docs)
        twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(5).collect()
        if twice:
            raise ValueError(f"missing or repeated doc_ids: {[r[0] for r in twice]}")
        return self._put(rows, {}, list(range(self.buckets)))

    def _touched(self, ids: DataFrame) -> list[int]:
        return sorted(r[0] for r in ids.select(self._bucket().alias("k")).distinct().collect())

    def update(self, changed: DataFrame) -> int:
        """A version in which ``changed`` stands for the documents of the same doc_ids, all of which must be there. Reads and
        writes the buckets of these, no others."""
        new = self._plain(changed)
        old, touched = self.folders(), self._touched(new)
        before = self._open([p for k in touched if (p := old[k])])
        missing = new.join(before.select("doc_id"), "doc_id", "left_anti").select("doc_id").limit(5).collect()
        if missing:
            raise KeyError(f"no such documents: {[r[0] for r in missing]}")
        return self._put(before.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new), old, touched)

    def remove(self, ids: DataFrame) -> int:
        """A version without the documents of ``ids`` (doc_id)."""
        gone = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        old, touched = self.folders(), self._touched(gone)
        before = self._open([p for k in touched if (p := old[k])])
        return self._put(before.join(gone, "doc_id", "left_anti"), old, touched)
