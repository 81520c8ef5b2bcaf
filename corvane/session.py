"""What a Spark session needs to run this library: its source on executors, and a shared folder for what loops write."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where Spark is one process and names none, a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _LOCAL[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder: its lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """As ``cut``, kept by ``key``, by which ``df`` is dealt already: joins by it read the table where it lies, however often."""
    spark, name = df.sparkSession, f"corvane_by_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


#: Rows of a task that holds what it groups; sizes of tasks by bytes would make it many more, as pairs of numbers pack well.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: float) -> int:
    """How many tasks ``rows`` are dealt over, so that a task's memory does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // TASK_ROWS) + 1)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="corvane-src-"), "corvane.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
