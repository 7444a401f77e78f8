"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, types as T

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Tasks import it by name; a driver's own path does not reach the executors.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        _SHIPPED.add(application)
        package = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(package):  # else it came as an archive, which is on the path
            archive = os.path.join(tempfile.mkdtemp(prefix="sprintgauge-"), "sprintgauge.zip")
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
                for folder, _, names in os.walk(package):
                    for name in names:
                        if name.endswith(".py"):
                            path = os.path.join(folder, name)
                            file.write(path, os.path.relpath(path, os.path.dirname(package)))
            spark.sparkContext.addPyFile(archive)
    return spark


def build_session(master: str | None = None, app: str = "sprintgauge", **conf: str) -> SparkSession:
    """A session with adaptive execution on; sizes stay with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def staging_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: elsewhere
    executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="sprintgauge-")
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/sprintgauge"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the staging folder and read it back.

    This cuts lineage for plans that read the same rows more than once, and it
    survives the loss of executors.
    """
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffles_removed(df.sparkSession):
        writer.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    out = df.sparkSession.read.schema(nullable).parquet(path)
    out.staged_at = path
    return out


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of the executions inside are removed as each of them ends."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)


def drop_stage(*staged: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote and no plan reads any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def use_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{staging_root(spark)}/checkpoints")
