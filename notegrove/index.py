"""A vault's tables on disk, kept up to date: what changed is found by a manifest, only that is parsed, and only the buckets of
changed documents are written again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .operators import catalogue, markdown
from .sources import vault
from .storage import settled

BUCKETS = 256
MANIFEST = "path string, mtime long, file_size long, hash string"


@dataclass
class SavedVault:
    """Tables by bucket of their document below root, a manifest of the files they come from, and a log of what was done."""

    spark: SparkSession
    root: str

    def tables(self) -> catalogue.Tables:
        return catalogue.load(self.spark, self.root)

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    def events(self) -> DataFrame:
        """path, action (insert, update, delete) and at, of every refresh."""
        return self._read("events", "path string, action string, at timestamp")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing saved yet
            return self.spark.createDataFrame([], schema)

    def refresh(self, folder: str, full: bool = False, only: DataFrame | None = None) -> DataFrame:
        """Bring the tables up to the files of a folder; only: paths (path) to look at, else all. Returns path and action of what
        changed. The manifest is written last: a refresh that failed is done again by the next, to the same end."""
        files = vault.files(self.spark, folder)
        known = self.manifest()
        if only is not None:
            paths = only.select("path").distinct()
            files, known = (x.join(paths, "path", "left_semi") for x in (files, known))
        hashed = files.select("path", "mtime", "file_size", F.sha2("content", 256).alias("hash"))
        found = settled(catalogue.changes(hashed, known, full).filter("action <> 'unchanged'"), "changes")
        if not found.isEmpty():
            new = files.select("path", "content").join(found.filter("action <> 'delete'").select("path"), "path", "left_semi")
            parsed = markdown.tables(settled(markdown.parse(new), "parsed"))
            self._replace(parsed, found.select(F.col("path").alias("doc_id")))
            found.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/events")
        kept = self.manifest().join(found.filter("action = 'delete'").select("path"), "path", "left_anti").join(hashed.select("path"), "path", "left_anti")
        settled(kept.unionByName(hashed), "manifest").write.mode("overwrite").parquet(f"{self.root}/manifest")
        return found

    def _replace(self, new: catalogue.Tables, changed: DataFrame) -> None:
        """The buckets of the changed documents, with their rows out and the new ones in; buckets left empty are deleted."""
        buckets = [r["b"] for r in changed.select(catalogue.bucket("doc_id", BUCKETS).alias("b")).distinct().collect()]  # BUCKETS at most
        conf, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        for name, rows in new.items():
            owner, where = catalogue.OWNER.get(name, "doc_id"), f"{self.root}/{name}"
            rows = rows.withColumn("doc_bucket", catalogue.bucket(owner, BUCKETS))
            try:
                old = self.spark.read.schema(rows.schema).parquet(where).filter(F.col("doc_bucket").isin(buckets))
                rows = rows.unionByName(old.join(changed.withColumnRenamed("doc_id", owner), owner, "left_anti").select(rows.columns))
            except AnalysisException:
                pass
            rows = settled(rows.repartition("doc_bucket"), f"index-{name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(where)
            full = {r["doc_bucket"] for r in rows.select("doc_bucket").distinct().collect()}
            for b in set(buckets) - full:
                gone = jvm.org.apache.hadoop.fs.Path(f"{where}/doc_bucket={b}")
                gone.getFileSystem(conf).delete(gone, True)

    def applier(self, folder: str) -> Callable[[DataFrame, DataFrame], None]:
        """What streaming.watch.sync calls with the upserted and removed paths of a batch. Doing a batch twice changes nothing:
        files whose time and size, or hash, the manifest knows are left alone."""

        def apply(upserts: DataFrame, removals: DataFrame) -> None:
            self.refresh(folder, only=upserts.unionByName(removals))

        return apply


def save_embeddings(embeddings: DataFrame, model: str, root: str) -> None:
    """id and embedding of a model's nodes, in place of an earlier version of that model's."""
    rows = embeddings.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(model).alias("model"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(root)


def load_embeddings(spark: SparkSession, root: str, model: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """id, embedding and model of all saved nodes, of one model, or of some ids; filters reach the scan."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("model", T.StringType())])
    rows = spark.read.schema(schema).parquet(root)
    rows = rows.filter(F.col("model") == model) if model is not None else rows
    return rows.filter(F.col("id").isin(ids)) if ids is not None else rows
