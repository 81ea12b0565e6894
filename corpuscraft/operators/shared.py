"""The folder that driver and executors share, and scratch tables in it."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local session gets a temporary folder for its application (a running session
    cannot change the setting); on a cluster that is an error, since no machine's own folder is seen by the others."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="corpuscraft-")
        path = _own[application]
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def passing(spark: SparkSession, root: str) -> None:
    """Marks a folder to be deleted when the driver's process ends."""
    _open[root] = (spark._jvm, spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables written to the shared folder, so that what is computed once survives the loss of executors and is never recomputed.

    Results may read them lazily, so they stay until dropped; what is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        passing(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def sweep() -> None:
    """Deletes all scratch of this process; also called when it ends. A root that cannot be reached any more is left."""
    while _open:
        root, (jvm, conf) = _open.popitem()
        with contextlib.suppress(Exception):
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(conf).delete(path, True)


atexit.register(sweep)
