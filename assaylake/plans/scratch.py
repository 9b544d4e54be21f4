"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage with a written table, so that a lost
executor costs a task and never the whole history. The folder is the one the
cluster names in ``spark.checkpoint.dir``. Only a ``local`` master, whose tasks
all run on one machine, may go without it and gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process that nobody has released yet, each with its session.
_open: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session; a temporary one on a ``local`` master that names none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="assaylake-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Removes the tables of all operators of this session so far, and says of how many.

    For long sessions, once the results have been written or collected: a result
    that is still to be computed may read these tables.
    """
    mine = [root for root, owner in _open.items() if owner.sparkContext is spark.sparkContext]
    for root in mine:
        _delete(spark, root)
        del _open[root]
    return len(mine)


class Scratch:
    """Tables of one running operator.

    An operator drops what it has read for the last time. What its result still
    reads stays until :func:`release`, or until the session's JVM ends: its file
    system then deletes the folder, whatever becomes of the Python process.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _open[self.root] = spark

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it as read back, with its lineage cut."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")
