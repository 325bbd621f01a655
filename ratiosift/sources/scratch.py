"""Tables that an estimator reads many times, written once to the folder all executors share.

The folder is ``spark.checkpoint.dir``. Only a local session that names none gets a temporary one; on a cluster such a
folder would be another on each machine, so there it is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark takes it for, in the form Arrow reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    return "s3://" + uri.partition("://")[2] if uri.startswith(("s3a://", "s3n://")) else uri


class Written:
    """``keep`` writes a table and gives it back as read; ``close`` deletes what was written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def path(self) -> str:
        self.paths.append(f"{shared_dir(self.spark)}/fit-{uuid.uuid4().hex}")
        return self.paths[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            at = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            at.getFileSystem(conf).delete(at, True)
