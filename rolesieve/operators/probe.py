"""Board probe over landed payloads: AGG-12 to AGG-14, FIL-8, JOI-5, SET-2, SC-24 to SC-26."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import col, contains_phrase, names_agree


def home_or_remote(location) -> Column:
    """SC-26."""
    return contains_phrase(location, fixed.PROBE_COUNTRY_OR_REMOTE)


def home_only(location) -> Column:
    """SC-26."""
    return contains_phrase(location, fixed.PROBE_COUNTRY)


def engineering(title) -> Column:
    """SC-26."""
    return contains_phrase(title, fixed.PROBE_TITLE_WORDS)


def summarize(postings: DataFrame, *board: str, near=home_or_remote, home=home_only,
              technical=engineering) -> DataFrame:
    """AGG-12 / FIL-8: postings per board, loosely and strictly relevant, and the technical ones of both.

    A row without ``pos`` stands for a board without postings and counts to zero.
    """
    a, b, t = near("location"), home("location"), technical("title")
    return postings.groupBy(*board).agg(
        F.count("pos").alias("total_jobs"),
        F.count_if(a).alias("india_or_remote_jobs"),
        F.count_if(a & t).alias("engineering_jobs_india_or_remote"),
        F.count_if(b).alias("explicit_india_jobs"),
        F.count_if(b & t).alias("engineering_jobs_explicit_india"))


SUMMARY_COLUMNS = ("total_jobs", "india_or_remote_jobs", "engineering_jobs_india_or_remote",
                   "explicit_india_jobs", "engineering_jobs_explicit_india")


def summarize_all(boards: DataFrame, postings: DataFrame, *board: str, **tests) -> DataFrame:
    """AGG-12 with zeros for boards that have no posting."""
    summary = summarize(postings, *board, **tests)
    return boards.join(summary, list(board), "left").fillna(0, list(SUMMARY_COLUMNS))


def sample_titles(postings: DataFrame, *board: str, n: int = fixed.SAMPLE_TITLES) -> DataFrame:
    """AGG-13: the first ``n`` titles of every board in order.

    Every task first cuts each board to its own first ``n`` rows, so a board of any size sends
    few rows, and the list is built from ``n`` at most.
    """
    first = postings.filter(F.col("pos").isNotNull()).select(*board, "pos", "title").withColumn(
        "_n", F.row_number().over(Window.partitionBy(*board).orderBy("pos"))).filter(F.col("_n") <= n)
    return first.groupBy(*board).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda r: r["title"]).alias("sample_titles"))


def first_posting(postings: DataFrame, value, *board: str) -> DataFrame:
    """Value of a board's first posting (SC-25 reads the board's name from it)."""
    return postings.groupBy(*board).agg(F.min_by(F.struct(col(value).alias("v")), "pos")["v"].alias("first_value"))


def mark_verified(hits: DataFrame, board_name="board_name", hint="hint") -> DataFrame:
    """SC-24: whether the board's own name agrees with the one looked for."""
    return hits.withColumn("verified", names_agree(board_name, hint))


def verified_counts(hits: DataFrame) -> DataFrame:
    """AGG-14: hits by verification."""
    return hits.groupBy("verified").agg(F.count(F.lit(1)).alias("hits"))


def misses(companies: DataFrame, hits: DataFrame) -> DataFrame:
    """JOI-5 / SET-2: companies without any hit, once each."""
    return companies.select("company").join(hits.select("company"), "company", "left_anti").distinct()
