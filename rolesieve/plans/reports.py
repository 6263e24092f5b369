"""Q-2, Q-3, Q-4, Q-6 and Q-7: reports over jobs, runs and attempt logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.operators import attempts, filters, funnel, rank, runs
from rolesieve.profile import Profile
from rolesieve.session import checkpointed
from rolesieve.sinks import files


def filter_funnel(jobs: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    """Q-2. The rules run once, over the four columns they need; all reports read the result."""
    labelled = checkpointed(filters.label(jobs.select("seq", "title", "company", "location"), profile))
    return {
        "rejections": funnel.rejections_by_reason(labelled),
        "rejected_locations": funnel.most_common(funnel.rejected_locations(labelled), fixed.TOP_LOCATIONS),
        "rejected_role_titles": funnel.most_common(funnel.rejected_role_titles(labelled), fixed.TOP_TITLES),
        "rejected_seniority_titles": funnel.most_common(funnel.rejected_seniority_titles(labelled)),
        "rejected_technical_titles": funnel.most_common(funnel.rejected_technical_titles(labelled)),
        "per_company": funnel.per_company(labelled).orderBy("company"),
    }


def run_report(stages: dict[str, DataFrame], stats: DataFrame, profile: Profile, usage: DataFrame,
               model: str) -> dict[str, DataFrame]:
    """Q-3: jobs per source, rows per stage, rejections, dropped skills, calls, tokens and cost.

    ``stages`` is as ``match_and_rank.stage_tables`` gives it.
    """
    sums = runs.token_sums(usage).withColumn("model", F.lit(model))
    return {
        "per_source": funnel.per_source(stages["collected"]),
        "stages": funnel.stage_counts(stages),
        "rejections": funnel.rejections_by_reason(filters.label(
            stages["collected"].select("seq", "title", "company", "location"), profile)),
        "dropped_skills": stats.select("dropped_matched_skills", "dropped_missing_skills"),
        "tokens": runs.with_cost(sums),
    }


def run_report_lines(report: dict[str, DataFrame], head: Mapping[str, object] | None = None) -> DataFrame:
    """Q-3 / SNK-5: the run report as ordered lines of one JSON object, a line per part of it.

    Its tables have a row per source, stage or rule, or one row at all, so no line grows with the jobs.
    """
    keyed = {"per_source": ("source", "jobs"), "stages": ("stage", "rows"), "rejections": ("reject_reason", "rows")}
    fields = []
    for name, table in report.items():
        if name in keyed:
            key, value = (F.col(c).alias(a) for c, a in zip(keyed[name], ("key", "value")))
            fields.append(table.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name)))
        else:
            fields.append(table.select(F.struct("*").alias(name)))
    return files.object_lines(fields, head or {})


def rows_to_compare(survivors: DataFrame, minimum: int = fixed.MIN_ROWS_TO_COMPARE,
                    cap: int = fixed.MAX_ROWS_TO_COMPARE) -> DataFrame | None:
    """Q-4: the same first rows for every worker count, null when there are too few to compare."""
    return rank.first_n(survivors, cap) if filters.has_rows(survivors, minimum) else None


def worker_comparison(run_rows: DataFrame) -> DataFrame:
    """Q-4: one line per worker count, in numeric order."""
    return runs.by_worker_count(runs.worker_table(runs.worker_results(run_rows)))


def attempt_report(log: DataFrame, account: Sequence[str] = (), ties: Sequence[str] = (),
                   jitter=None) -> dict[str, DataFrame]:
    """Q-6: waits with the shared cooldown, totals, outcomes per job and per error."""
    waits = attempts.with_waits(attempts.retry_numbers(log, ties=ties), jitter)
    failed = attempts.failed_jobs(log, ties=ties)
    held = attempts.cooldown(waits, list(account), "ts", "wait_seconds", ties)
    return {
        "cooldown": held,
        "totals": attempts.rate_limit_totals(held),
        "failed_jobs": failed,
        "errors_by_type": attempts.errors_by_type(failed),
    }


def reproducibility(first: DataFrame, second: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Q-7."""
    compared = runs.compare_runs(first, second, key)
    return {"per_job": compared, "totals": runs.comparison_totals(compared)}
