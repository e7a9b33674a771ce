"""Tables that a job writes to the shared folder and reads back, and helpers around Arrow tasks."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from cityloom.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Lost executors cost only the tasks they held, later jobs have real sizes to plan by, and the shuffle files of the
    job are freed as soon as the table stands.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that do not occur in ``taken`` (Spark compares names without case)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, so they need no copy of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "cityloom.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
