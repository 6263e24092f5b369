"""Attempt-log analytics: WIN-3, WIN-4, AGG-10, AGG-11, SCO-4.

One row per call: ``job_id, ts, error_type`` (null when the call succeeded), ``message,
retry_after``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.values import rate_limit_wait, round3
from rolesieve.operators.running import running


def is_rate_limit(error_type="error_type") -> Column:
    return F.coalesce(F.col(error_type) == fixed.RATE_LIMIT_ERROR, F.lit(False))


def is_other_retryable(error_type="error_type") -> Column:
    return F.coalesce(F.col(error_type).isin(*fixed.RETRYABLE_ERRORS), F.lit(False))


def retry_numbers(log: DataFrame, key: str = "job_id", ts: str = "ts", ties: Sequence[str] = (),
                  buckets: int | None = None) -> DataFrame:
    """WIN-4: per job and call, how often each error family came before it.

    The two families have budgets of their own and are counted apart.
    """
    def before(flag: Column) -> tuple[str, Column]:
        return "sum", flag.cast("long")

    counted = running(log, [key], ts, ties, {
        "rate_limit_retry": before(is_rate_limit()), "other_retry": before(is_other_retryable()),
    }, buckets, inclusive=False)
    return counted.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rate_limit_retry", "other_retry")})


def with_waits(numbered: DataFrame, jitter=None) -> DataFrame:
    """SC-19 on a log with retry numbers: wait in seconds after a rate-limited call, else null.

    The call that spends a job's budget gives up at once: it neither waits nor delays others.
    """
    return numbered.withColumn("wait_seconds", F.when(
        _goes_on(), rate_limit_wait("retry_after", "message", "rate_limit_retry", jitter)))


def _goes_on() -> Column:
    """A rate-limited call that is retried."""
    return is_rate_limit() & (F.col("rate_limit_retry") < fixed.MAX_RATE_LIMIT_RETRIES)


def cooldown(log: DataFrame, account: Sequence[str], ts: str, wait: str, ties: Sequence[str] = (),
             buckets: int | None = None) -> DataFrame:
    """WIN-3: shared resume time after each call, and what is left to wait at that moment.

    The resume time only moves later. Times are in microseconds since 1970; a call without a
    wait leaves the resume time as it is.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    until = at + F.round(F.col(wait) * 1_000_000).cast("long")
    held = running(log, account, ts, ties, {"resume_at_us": ("max", until)}, buckets)
    return held.withColumn("remaining_us", F.greatest(
        F.coalesce(F.col("resume_at_us") - at, F.lit(0)), F.lit(0)))


def rate_limit_totals(held: DataFrame) -> DataFrame:
    """AGG-10: rate-limited calls that went on to wait, and the seconds left of the shared cooldown
    when each of them began to; zeros for an empty log. ``held`` comes from ``cooldown``."""
    return held.agg(
        F.count_if(_goes_on()).alias("rate_limit_hits"),
        round3(F.coalesce(F.sum(F.when(_goes_on(), F.col("remaining_us"))), F.lit(0)) / 1_000_000)
        .alias("rate_limit_wait_seconds"))


def outcomes(log: DataFrame, key: str = "job_id", ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """AGG-11 / SCO-4: calls per job, its last error, and whether a retry budget ran out.

    A job whose last call succeeded has no ``error_type``. The counts are the true ones of the log.
    """
    last = F.max_by(F.struct("error_type"), F.struct(ts, *ties))["error_type"]
    return log.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("attempts"),
        last.alias("error_type"),
        F.count_if(is_rate_limit()).alias("rate_limit_errors"),
        F.count_if(is_other_retryable()).alias("other_errors"),
    ).withColumn("budget_spent", F.col("error_type").isNotNull() & (
        (is_rate_limit() & (F.col("rate_limit_errors") > fixed.MAX_RATE_LIMIT_RETRIES))
        | (is_other_retryable() & (F.col("other_errors") > fixed.MAX_OTHER_RETRIES))))


def failed_jobs(log: DataFrame, key: str = "job_id", ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """AGG-11: jobs whose last call failed."""
    return outcomes(log, key, ts, ties).filter(F.col("error_type").isNotNull())


def errors_by_type(failed: DataFrame) -> DataFrame:
    """AGG-11: failed jobs per error, with the span of their attempts."""
    return failed.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("attempts").alias("min_attempts"),
        F.max("attempts").alias("max_attempts"))
