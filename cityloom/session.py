"""Session settings and lineage cuts shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cityloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution on; the master normally comes from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; unset, a temp folder in local mode and an error elsewhere."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="spark-cityloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for tables a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def merged(df: DataFrame) -> DataFrame:
    """``df`` for joins by sort and merge, unless the join asks for a broadcast by name.

    Spark judges files by their compressed size, and keys in order compress so well that a feature table of a few MB
    took 544 MB of the driver when it was broadcast; so no table that grows with the input is broadcast by that size.
    """
    return df.hint("merge")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None, frees: bool = False) -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it back.

    Loops keep short plans and survive lost executors; unlike a checkpointed plan, the table also has real
    size statistics, so estimates do not multiply from round to round. The table behind ``replaces`` (an
    earlier round that nothing reads any more) is removed; ``frees`` drops the job's shuffle files as soon as the table stands.
    The table is joined by sort and merge (:func:`merged`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    old = spark.conf.get(_CLEANUP, None)
    if frees:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if frees:
            spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)
    if replaces is not None:
        for old in {f.rsplit("/", 1)[0] for f in replaces.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(old)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return merged(spark.read.schema(df.schema).parquet(path))
