"""Running aggregates over time that no single key can overload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.session import checkpointed

_MERGE = {"max": F.max, "sum": F.sum}


#: A bucket holds 2 to this power rows at most.
BUCKET_BITS = 20
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def bucketed(df: DataFrame, ts: str, ties: Sequence[str], buckets: int | None = None,
             bits: int = BUCKET_BITS) -> DataFrame:
    """``df`` with ``_bucket``, which grows with (``ts``, ``ties``); no bucket has over 2**bits rows.

    The rows are sorted into ranges, as many as the session's shuffle partitions or ``buckets``,
    and each range is cut by row number, so a bucket's size does not depend on how many rows there
    are, and nothing has to be counted beforehand.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, ts, *ties).sortWithinPartitions(ts, *ties)
    return ranges.withColumn("_bucket", F.shiftright(F.monotonically_increasing_id(), bits))


def running(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str],
            measures: Mapping[str, tuple[str, Column]], buckets: int | None = None,
            inclusive: bool = True, bits: int = BUCKET_BITS) -> DataFrame:
    """Adds running values over (``ts``, ``ties``) within ``keys``.

    ``measures`` maps a new column to ``("max" | "sum", value)``. A plain window would sort all
    rows of a key in one task. Here the rows of all keys are range-sorted by (``ts``, ``ties``)
    and cut into buckets of at most 2**``bits`` rows: neither a stray time nor a burst at one instant
    nor the length of the log makes one of them larger. Every (key, bucket) is first aggregated, the
    aggregates run over the buckets of a key in two levels (the buckets of a range, then the
    ranges), and each bucket then starts from what came before it. Exact for any number of buckets,
    because both aggregates can be put together from parts. The buckets are written once, so that a
    task that runs again finds the same ones. Rows that are equal in key, time and ties come in any order.
    """
    values = {name: (_MERGE[kind], f"_v_{name}") for name, (kind, _) in measures.items()}
    valued = df.select("*", *(v.alias(f"_v_{name}") for name, (_, v) in measures.items()))
    rows = checkpointed(bucketed(valued, ts, ties, buckets, bits))

    def earlier(order: str, *by: str):
        return Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    parts = rows.groupBy(*keys, "_bucket").agg(*(merge(v).alias(v) for merge, v in values.values())) \
        .withColumn("_range", F.shiftright("_bucket", _ROW_BITS - bits))
    ranges = parts.groupBy(*keys, "_range").agg(*(merge(v).alias(v) for merge, v in values.values()))
    # What came in earlier ranges stands with the first bucket of a range, as a bucket before it.
    before = ranges.select(*keys, "_range", (F.shiftleft("_range", _ROW_BITS - bits) - 1).alias("_bucket"), *(
        merge(v).over(earlier("_range")).alias(v) for merge, v in values.values()))
    carried = parts.unionByName(before.select(parts.columns)).select(
        *keys, "_bucket", "_range", F.lit(True).alias("_carried"),
        *(merge(v).over(earlier("_bucket", "_range")).alias(v) for merge, v in values.values()))
    carried = carried.filter(F.shiftright("_bucket", _ROW_BITS - bits) == F.col("_range")).drop("_range")
    both = rows.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    here = Window.partitionBy(*keys, "_bucket") \
        .orderBy(F.col("_carried").desc(), ts, *ties) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = both.select("*", *(merge(v).over(here).alias(name) for name, (merge, v) in values.items()))
    return out.filter(~F.col("_carried")).select(*df.columns, *measures)
