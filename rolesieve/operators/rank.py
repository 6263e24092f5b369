"""Stable ranking: SRT-1, SRT-3, SRT-5, WIN-2."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def rank_order() -> list[Column]:
    """SRT-1: best score first, equal scores in input order."""
    return [F.col("score").desc(), F.col("seq").asc()]


def sort_by_rank(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*rank_order())


def top_k(matches: DataFrame, k: int) -> DataFrame:
    """SRT-1 / WIN-2: the best ``k`` with their rank.

    Every task keeps its own best ``k`` first, so the numbering sees ``k`` rows only.
    """
    best = matches.orderBy(*rank_order()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())).cast("long"))


def rank_all(matches: DataFrame) -> DataFrame:
    """WIN-2: every row with its rank 1..n, without bringing all rows into one task.

    The rows are range-sorted by (score, seq) over many tasks and written once to the shared
    checkpoint folder with their place inside their partition. A rank is that place plus the
    number of rows in earlier partitions. Partitions are counted once, here; their counts, one
    number per partition, are added up on the driver and broadcast, so whatever reads the result
    scans the ranked rows once. The result comes in rank order, partition by partition: a sink
    that keeps partitions apart need not sort it again.
    """
    spark = matches.sparkSession
    placed = checkpointed(
        sort_by_rank(matches).withColumn("_place", F.monotonically_increasing_id()))
    partition = F.shiftright("_place", _ROW_BITS).alias("_part")
    sizes = sorted(placed.groupBy(partition).agg(F.count(F.lit(1)).alias("_n")).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    before = spark.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, starts)], "_part long, _before long")
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_part", partition).join(F.broadcast(before), "_part") \
        .withColumn("rank", F.col("_before") + row + 1).drop("_part", "_place", "_before")


def first_n(jobs: DataFrame, n: int) -> DataFrame:
    """SRT-3: the first ``n`` rows in input order."""
    return jobs.orderBy("seq").limit(n)


def in_input_order(df: DataFrame) -> DataFrame:
    """SRT-5: input order, for the sink only; nothing before it depends on order."""
    return df.orderBy("seq")
