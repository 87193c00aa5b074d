"""Session settings and shipping of the package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applications that have the package already.
_SHIPPED: set[str] = set()


def get_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``master`` and ``partitions`` only where given."""
    builder = SparkSession.builder.appName("notewell")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    # checkpoints that nothing refers to any more are deleted
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session or its context names it. A local session may do without and gets a temporary one; on a cluster
    executors could not read such a folder, so there it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-notewell-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of ``scratch``, in whatever file system the shared folder is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, for what several parts of a plan read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``durable``, and later joins and groups know by which keys the rows are dealt out, so that they need not shuffle them again.

    Adaptive execution would forget that, so this one plan is made without it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return durable(df)
    finally:
        conf.set(key, before)


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Rows of a small table (``most`` bytes by Spark's estimate) dealt out to all cores; one file with one group of rows is else read by a single task."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > most:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once an application, for the functions that run in Python."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="notewell-")) / "notewell.zip"
    with zipfile.ZipFile(archive, "w") as zipped:
        for file in sorted(package.rglob("*.py")):
            zipped.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
