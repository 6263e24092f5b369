"""Rule filters and the first failing rule of a row: FIL-1 to FIL-9, JOI-1.

Experience, skills and descriptions are not filtered on: they need judgement, which is the
scorer's part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import col, contains_phrase, fold, normalize_location, remote_pattern
from rolesieve.profile import Profile


def excluded_company(company, names) -> Column:
    """FIL-1: same name but for case and outer white space. No names exclude nothing."""
    folded = sorted({n.strip().lower() for n in names})
    return F.coalesce(fold(company).isin(*folded), F.lit(False)) if folded else F.lit(False)


def drop_excluded_companies(jobs: DataFrame, excluded: DataFrame) -> DataFrame:
    """JOI-1: the same against a table with a ``company`` column, of any size.

    No broadcast hint: Spark broadcasts the names by itself below its size threshold, and
    splits a company with very many jobs at run time when it sorts and merges.
    """
    names = excluded.select(fold("company").alias("_name"))
    return jobs.join(names, fold("company") == F.col("_name"), "left_anti")


def matches_role(title, profile: Profile) -> Column:
    """FIL-2: a configured phrase keeps; else a management word drops; else a technical word keeps."""
    if not profile.roles:
        return F.lit(True)
    return F.when(contains_phrase(title, profile.roles), True) \
        .when(contains_phrase(title, profile.management_words), False) \
        .otherwise(contains_phrase(title, profile.technical_words))


def has_excluded_word(title, profile: Profile) -> Column:
    """FIL-3."""
    return contains_phrase(title, profile.exclude_title_words)


def matches_location(location, profile: Profile) -> Column:
    """FIL-4: any configured place, under any of its names, inside the normalised text."""
    if not profile.locations:
        return F.lit(True)
    wanted = [w.strip().lower() for w in profile.locations]
    names = [n for w in wanted if w != profile.remote_word
             for n in profile.location_aliases.get(w, (w,))]
    tests = [re.escape(n) for n in dict.fromkeys(names)]
    if profile.remote_word in wanted:
        tests.append(remote_pattern(profile.home_country, profile.remote_word))
    # One pattern over the normalised text, so that it is worked out once per row.
    place = F.coalesce(col(location), F.lit(""))
    return (place != "") & normalize_location(place).rlike("|".join(tests))


def reject_reason(profile: Profile) -> Column:
    """FIL-6: name of the first rule a row fails, null for a row that passes all."""
    company, role, seniority, location = fixed.REASONS
    return F.when(excluded_company("company", profile.excluded_companies), company) \
        .when(~matches_role("title", profile), role) \
        .when(has_excluded_word("title", profile), seniority) \
        .when(~matches_location("location", profile), location)


def label(jobs: DataFrame, profile: Profile) -> DataFrame:
    """FIL-6: adds ``reject_reason``."""
    return jobs.withColumn("reject_reason", reject_reason(profile))


def keep(jobs: DataFrame, profile: Profile) -> DataFrame:
    """FIL-5: rows that pass every rule, cheapest rule first."""
    return jobs.filter(
        ~excluded_company("company", profile.excluded_companies)
        & matches_role("title", profile)
        & ~has_excluded_word("title", profile)
        & matches_location("location", profile))


def has_rows(df: DataFrame, minimum: int = fixed.MIN_ROWS_TO_COMPARE) -> bool:
    """FIL-9: whether there are at least ``minimum`` rows; stops counting there."""
    return df.limit(minimum).count() >= minimum


def gate(df: DataFrame, minimum: int = fixed.MIN_ROWS_TO_COMPARE) -> DataFrame:
    """FIL-9: one row saying whether a comparison would stop, and why. Empty input gives zero."""
    rows = df.agg(F.count(F.lit(1)).alias("jobs_after_filter"))
    stopped = F.col("jobs_after_filter") < minimum
    before, after = fixed.STOP_REASON.format(rows="|", minimum=minimum).split("|")
    reason = F.concat(F.lit(before), F.col("jobs_after_filter"), F.lit(after))
    return rows.select("jobs_after_filter", stopped.alias("stopped"), F.when(stopped, reason).alias("reason"))
