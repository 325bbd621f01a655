"""Tables that are written to the folder all executors share, and read again.

Cutting a plan this way bounds lineage and survives lost executors. The folder is ``spark.checkpoint.dir``, as in
``ratiosift.sources.scratch``.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import qualified, shared_dir
from .textkernel import release


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that travel to a Python worker at once: whole texts are long, and 10,000 of them (Spark's default) are 30 MB and more
#: for each running task, several times over.
MOST_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """The intermediate tables of one operator. ``keep`` writes one; ``close`` deletes all but those marked ``last``.

    Lowers the session's Arrow batch size to ``MOST_ROWS`` where it is larger.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        if not 0 < int(spark.conf.get(_BATCH)) <= MOST_ROWS:
            spark.conf.set(_BATCH, str(MOST_ROWS))
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._made: list[str] = []
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{name}-{self._count}"

    def keep(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        if not last:
            self._made.append(path)
        release()
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder for files that tasks write by themselves."""
        self._made.append(self.path(name))
        return qualified(self.spark, self._made[-1])

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        for path in self._made:
            self.drop(path)
        self._made = []
        gc.collect()  # frames refer to each other, and each holds its plan in the JVM
        release()
