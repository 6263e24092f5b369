"""Shared folder, written tables and small expressions for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver's JVM ends; without that
    setting nothing is sure to be shared, and the call is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Enough partitions for ``rows_each`` rows in each, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
