"""Request text for a scorer: SC-12, SC-13, SC-14."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import col, first_truthy
from rolesieve.profile import Profile


def description_text(description, max_chars: int | None = None) -> Column:
    """SC-12: a fixed phrase when missing; whole, or cut at the limit a scorer sets."""
    whole = first_truthy(col(description), F.lit(fixed.NO_DESCRIPTION))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def is_cut(description, max_chars: int | None = None) -> Column:
    """Whether ``description_text`` leaves something out."""
    return F.lit(False) if max_chars is None else F.coalesce(F.length(col(description)) > max_chars, F.lit(False))


def experience_text(min_years: int | None, max_years: int | None) -> str:
    """SC-13."""
    if min_years is None and max_years is None:
        return fixed.NOT_SPECIFIED
    low = 0 if min_years is None else min_years
    high = "?" if max_years is None else max_years
    return f"{low}-{high} years"


def experience_column(min_years, max_years) -> Column:
    """SC-13 over columns."""
    low, high = col(min_years).cast("string"), col(max_years).cast("string")
    span = F.concat(F.coalesce(low, F.lit("0")), F.lit("-"), F.coalesce(high, F.lit("?")),
                    F.lit(" years"))
    return F.when(low.isNull() & high.isNull(), F.lit(fixed.NOT_SPECIFIED)).otherwise(span)


def user_prompt(profile: Profile, max_chars: int | None = None) -> Column:
    """SC-14: profile block, then the job's labelled lines. Id, URL and source stay out."""
    # Labels of the request text.
    head = "\n".join((
        "PROFILE:",
        "Target roles: " + ", ".join(profile.roles),
        "Experience: " + experience_text(profile.min_years, profile.max_years),
        "Skills: " + ", ".join(profile.skills),
        "",
        "JOB:",
        "Title: ",
    ))
    return F.concat(
        F.lit(head), F.col("title"),
        F.lit("\nCompany: "), F.col("company"),
        F.lit("\nLocation: "), first_truthy("location", F.lit(fixed.NOT_SPECIFIED)),
        F.lit("\nDescription: "), description_text("description", max_chars),
    )
