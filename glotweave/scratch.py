"""Scratch tables that outlive executors, and their removal when nothing reads them any more."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local master may go without one and gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="glotweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Spark deletes an execution's shuffle files at its end if this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the scratch folder and read it back: lost executors recompute from the files.

    The write's shuffle files are deleted when it has ended, as nothing reads them any more.  A failed or repeated call
    writes to a new folder, so it never sees half a table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/glotweave/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where each table that ``materialise`` returned lies, as long as it is in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_path(table: DataFrame) -> str:
    """The folder of a table that ``materialise`` returned, for callers that want to delete it."""
    return _PATHS[table]


class Scratch:
    """Scratch tables of one operator: those of ``table`` are deleted at the end of the ``with`` block, also after a failure.

    What the block returns must not read them; it is written with ``materialise``, whose folder stays for the caller.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        self._paths.append((out, scratch_path(out)))
        return out

    def adopt(self, table: DataFrame) -> DataFrame:
        """Take over a table that ``materialise`` returned."""
        self._paths.append((table, scratch_path(table)))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete some of the tables now."""
        for entry in [e for e in self._paths if any(e[0] is t for t in tables)]:
            self._delete(entry[1])
            self._paths.remove(entry)

    def __exit__(self, *_) -> None:
        for _, path in self._paths:
            self._delete(path)
        self._paths.clear()

    def _delete(self, path: str) -> None:
        jvm = self._spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(where, True)
