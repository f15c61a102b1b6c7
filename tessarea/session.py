"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot key even where that costs one more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators are designed for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """The package on the executors' Python path, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="ship-")  # the driver serves it from here
        archive = shutil.make_archive(
            os.path.join(folder, "tessarea"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on ``local``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="tessarea-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessarea/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The copy survives the loss of executors, later plans do not repeat the work
    behind it, and its true size is known to the planner, so that Spark's own
    broadcast threshold decides on facts and not on an estimate.

    It also matters for totals that are joined back to their members. Adaptive
    execution splits a hot key only where both join inputs come straight from a
    shuffle, not where one is aggregated in the same stage; a stored total does.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
