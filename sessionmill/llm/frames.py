"""Frames the operators share: the documents they read, the folder they write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch: a batch of whole texts must fit a Python worker beside its arrays.
BATCH_ROWS = 512
# Where a local session without ``spark.checkpoint.dir`` keeps its tables, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Tasks see texts in batches of at most ``BATCH_ROWS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text (null: empty) and the named columns; any others are left behind, whatever their names."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *(F.col(name) for name in more),
    )


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no fold (-1)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset (tests, a laptop) a temporary folder of this machine takes its place; a master other than
    local needs the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_ROOTS.get(app) or _LOCAL_ROOTS.setdefault(app, tempfile.mkdtemp(prefix="sessionmill-"))
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


class Steps:
    """Intermediate tables of one run. Each cuts the lineage: a lost executor costs the running step only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, shared_folder(spark)
        # A finished step has its table; Spark is to delete the shuffle files that led to it.
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.mode("error").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def keep_by(self, frame: DataFrame, name: str, key: str, parts: int) -> DataFrame:
        """A table whose files are dealt by ``key``: grouping by it moves no row."""
        table = "llm_" + self.folder.rpartition("-")[2] + "_" + name
        frame.write.bucketBy(parts, key).option("path", f"{self.folder}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables of this run that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
