"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_LONG_CONF = {_BATCH: str(1 << 20), "spark.sql.parquet.enableNestedColumnVectorizedReader": "false"}
_LONG_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4"}


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches between the JVM and Python have 8 MB at most, or one row if that is larger.

    The JVM's pool for them never shrinks, and with the default of 64 MB it takes hundreds of MB of every executor.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= _BATCH_BYTES:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new temporary folder on one machine and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def _held(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Writes DataFrames as Parquet under the shared folder, so that lineage ends there and a lost executor costs a reread.

    The shuffle files of a written plan go once it is written, and drop() removes tables that nothing reads any more.
    long_rows: for tables with rows of megabytes. While one is written, batches to Python have 1 MB or one row, rows with
    arrays are read one by one, and Parquet's row groups have 16 MB; else the JVM holds many such rows several times over.
    """

    def __init__(self, spark: SparkSession, tag: str, long_rows: bool = False):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._n, self._kept = 0, []
        small_batches(spark)
        self._conf, self._options = (_CLEANUP | _LONG_CONF, _LONG_GROUPS) if long_rows else (_CLEANUP, {})

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df as a table, in folders by a column if one is named; that column then comes last."""
        self._n += 1
        path, schema = f"{self.base}/{self._n}", df.schema
        with _held(self.spark, self._conf):
            write = df.write.options(**self._options)
            (write.partitionBy(by) if by else write).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        self._kept.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Drops every table but these, which a result still reads."""
        for path in set(self._kept) - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        if path in self._kept:
            self._kept.remove(path)
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
