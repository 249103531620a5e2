"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_scratch: str | None = None
_shipped: set[str] = set()


def build_session(app: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; ``conf`` overrides any of them.

    Shuffle partitions start high and adaptive execution merges them down to the advisory size, so
    the same settings serve a laptop and a large cluster. Skewed join partitions are split at run time.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else each column call walks the stack
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset falls back to a temporary folder of this machine, which goes when the process ends.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="wardline-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        base = _local_scratch
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_tables(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to the shared folder and gives it back as read from there.

    A written table is computed once, cuts the lineage, and has a size by which Spark chooses its joins.
    """
    folder, numbers = scratch_dir(spark, name), itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(numbers)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers; needed once per session by model plug-ins."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="wardline-zip-"), "wardline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when the input has fewer splits than the session has cores.

    Text scoring is CPU bound, so a table stored in a few large row groups would leave cores idle.
    A table with enough splits, which is every large one, is returned as it is: no shuffle. The
    repartition hashes a key, so a retried task sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
