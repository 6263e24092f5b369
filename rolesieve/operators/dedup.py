"""Keep the first row of every page: WIN-1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.values import normalize_url


def keyed(jobs: DataFrame, seq: str) -> tuple[DataFrame, list[str]]:
    """Adds the page key: normalised URL, ``seq`` where there is none, and a hash of both.

    The hash comes first because sorting compares the first eight bytes of a key at once; those
    are the same for nearly all URLs. The other two keep the key exact.
    """
    rows = jobs.withColumn("_url", normalize_url("url")).withColumn(
        "_blank", F.when(F.col("_url") == "", F.col(seq)))
    return rows.withColumn("_hash", F.xxhash64("_url", "_blank")), ["_hash", "_url", "_blank"]


def deduplicate(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """WIN-1: first row by ``seq`` of every normalised URL. A row without a URL stands for itself.

    The smallest row of a key is an aggregate, so every task first reduces what it holds to one
    row per key: however many copies a page has, each map task sends one of them at most.
    Rows without a URL are keyed by their own ``seq`` and spread over all tasks.
    """
    rows, key = keyed(jobs, seq)
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*jobs.columns), F.col(seq)).alias("_row"))
    return first.select(*(F.col("_row")[n].alias(n) for n in jobs.columns))


def first_seqs(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """The ``seq`` of every row ``deduplicate`` keeps, from the URL and ``seq`` columns alone."""
    rows, key = keyed(jobs.select("url", seq), seq)
    return rows.groupBy(*key).agg(F.min(seq).alias(seq)).select(seq)
