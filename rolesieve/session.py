"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions and splits skewed join partitions at run time.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key keeps its last value, as in most JSON parsers, instead of spoiling its board.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder is the one named in ``spark.checkpoint.dir``, by the cluster or by whoever starts
    the session; without one the call is refused, as nothing else is sure to be shared.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which goes when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
