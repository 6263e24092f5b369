"""What the filters did: AGG-1 to AGG-4, AGG-15, SRT-2. Input is a labelled table (FIL-6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import first_truthy, looks_technical

_COMPANY, _ROLE, _SENIORITY, _LOCATION = fixed.REASONS


def rejections_by_reason(labelled: DataFrame) -> DataFrame:
    """AGG-1: rows per reason; a reason nothing failed is absent.

    The kept rows form a group of their own that counts to zero and is dropped afterwards: a
    filter on the reason itself would be moved below it and run all rules a second time.
    """
    return labelled.groupBy("reject_reason").agg(F.count("reject_reason").alias("rows")) \
        .filter(F.col("rows") > 0)


def frequencies(rows: DataFrame, value, name: str) -> DataFrame:
    """AGG-2: rows per value and where the value came up first."""
    return rows.groupBy(value.alias(name)).agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"))


def most_common(table: DataFrame, n: int | None = None) -> DataFrame:
    """SRT-2: most frequent first, ties by first appearance."""
    ordered = table.orderBy(F.col("rows").desc(), F.col("first_seq"))
    return ordered if n is None else ordered.limit(n)


def rejected_role_titles(labelled: DataFrame) -> DataFrame:
    return frequencies(labelled.filter(F.col("reject_reason") == _ROLE), F.col("title"), "title")


def rejected_seniority_titles(labelled: DataFrame) -> DataFrame:
    return frequencies(labelled.filter(F.col("reject_reason") == _SENIORITY), F.col("title"), "title")


def rejected_locations(labelled: DataFrame) -> DataFrame:
    return frequencies(labelled.filter(F.col("reject_reason") == _LOCATION),
                       first_truthy("location", F.lit(fixed.NO_LOCATION)), "location")


def rejected_technical_titles(labelled: DataFrame) -> DataFrame:
    """AGG-2: role rejections that look technical after all.

    The keyword test runs on the counted titles, once per title instead of once per row.
    """
    return rejected_role_titles(labelled).filter(looks_technical("title"))


def per_company(labelled: DataFrame) -> DataFrame:
    """AGG-3."""
    return labelled.groupBy("company").agg(
        F.count(F.lit(1)).alias("collected"),
        F.count_if(F.col("reject_reason") == _ROLE).alias("rejected_for_role"),
        F.count_if(F.col("reject_reason").isNull()).alias("kept"))


def per_source(jobs: DataFrame, sources: tuple[str, ...] = (fixed.BOARD_A, fixed.BOARD_B, fixed.SEARCH)) -> DataFrame:
    """AGG-4: jobs per source, zero for a known source that gave none; others are listed as well."""
    known = jobs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    counted = jobs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "source", "full").select(
        "source", F.coalesce("n", F.lit(0)).alias("jobs"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """AGG-15: one row per stage, zero for an empty stage. Each stage is counted where it is."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
              for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
