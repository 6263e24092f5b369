"""Q-1: collect, filter, deduplicate, score, rank, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rolesieve.operators import dedup, filters, rank, scoring
from rolesieve.profile import Profile
from rolesieve.session import checkpointed
from rolesieve.sinks import files
from rolesieve.sources.boards import Collected

# Our own wording; a caller with a model passes the prompt that model needs.
DEFAULT_SYSTEM_PROMPT = (
    "Judge how well the JOB fits the PROFILE. Reply in JSON with score (0 to 100), "
    "matched_skills (from the PROFILE's skills, spelled as there), missing_skills (required "
    "by the JOB, not in the PROFILE) and rationale."
)


@dataclass(frozen=True)
class Stages:
    """One table per stage; ``kept`` passed the rules, ``filtered`` is that without copies."""

    jobs: DataFrame
    kept: DataFrame
    filtered: DataFrame
    matches: DataFrame
    skips: DataFrame
    stats: DataFrame


def survivors(jobs: DataFrame, profile: Profile) -> DataFrame:
    """Filter, then deduplicate. The order matters: copies may differ in title and place."""
    return dedup.deduplicate(filters.keep(jobs, profile))


def match(jobs: DataFrame, profile: Profile, scorer: Callable | None = None,
          system_prompt: str = DEFAULT_SYSTEM_PROMPT,
          max_workers: int | None = None) -> Stages:
    """Everything up to the scored tables. Without a scorer the offline one is used.

    What later steps read more than once is written once: the survivors when a scorer reads them
    apart from the join with its replies, and the scored table, which ranking and the reports read.
    """
    if scorer is None:
        filtered = survivors(jobs, profile)
        attached = scoring.attach_offline(filtered, profile)
    else:
        filtered = checkpointed(survivors(jobs, profile))
        replies = scoring.score(scoring.requests(filtered, profile, system_prompt), scorer, max_workers)
        attached = scoring.attach(filtered, scoring.parse_replies(replies))
    attached = checkpointed(attached)
    return Stages(jobs, filters.keep(jobs, profile), attached.select("seq", "job.*"), scoring.matched(attached, profile),
                  scoring.skipped(attached), scoring.scoring_stats(attached, profile))


def export(stages: Stages, folder: str, top: int | None = None, title: str = "Job Matches") -> DataFrame:
    """Rank and write all documents; with ``top`` only the best, each in a single file.

    All rows are sorted once, by the ranking; the documents are written from its partitions.
    """
    ranked = rank.rank_all(stages.matches) if top is None else rank.top_k(stages.matches, top)
    single = top is not None
    files.write_markdown(ranked, f"{folder}/jobs.md", title, single, in_order=True)
    files.write_csv(ranked, f"{folder}/jobs.csv", single, in_order=True)
    files.write_json_array(ranked, f"{folder}/jobs.json", single, in_order=True)
    files.write_skip_report(stages.skips, f"{folder}/skipped.json")
    return ranked


def run(collected: Collected, profile: Profile, folder: str | None = None, scorer: Callable | None = None,
        system_prompt: str = DEFAULT_SYSTEM_PROMPT, max_workers: int | None = None,
        title: str = "Job Matches") -> tuple[Stages, DataFrame]:
    """Q-1 as a whole: from collected payloads to ranked rows and, with ``folder``, to documents.

    Collect with ``written=True``, as jobs and bad records are read apart. What gave no job is
    written beside the documents, in input order.
    """
    stages = match(collected.jobs, profile, scorer, system_prompt, max_workers)
    if folder is None:
        return stages, rank.rank_all(stages.matches)
    ranked = export(stages, folder, title=title)
    rank.in_input_order(collected.bad_records).write.mode("overwrite").json(f"{folder}/bad_records.json")
    collected.bad_payloads.write.mode("overwrite").json(f"{folder}/bad_payloads.json")
    return stages, ranked


def stage_tables(stages: Stages, ranked: DataFrame) -> dict[str, DataFrame]:
    """AGG-15: the tables whose rows a run report counts."""
    return {"collected": stages.jobs, "filtered": stages.kept, "deduplicated": stages.filtered,
            "scored": stages.matches, "skipped": stages.skips, "ranked": ranked}
