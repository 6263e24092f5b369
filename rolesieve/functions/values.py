"""Dates, URLs, waits, costs and score expressions: SC-8, SC-9, SC-16 to SC-21, SC-29."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import col, fold, strip

_MS_PER_DAY = 86_400_000
_FIRST_DAY, _LAST_DAY = -719_162, 2_932_896  # 0001-01-01 and 9999-12-31


def epoch_ms_to_date(ms) -> Column:
    """SC-8: UTC date of an epoch in milliseconds; null outside years 1 to 9999."""
    days = F.floor(col(ms).cast("double") / _MS_PER_DAY)
    return F.when(days.between(_FIRST_DAY, _LAST_DAY), F.date_from_unix_date(days.cast("int")))


def normalize_url(url) -> Column:
    """SC-9: strip, drop the fragment, keep everything else that names the page.

    A lone trailing question mark, tabs and line breaks inside, and the case of the scheme
    do not tell two pages apart. The steps are plain rather than behind tests of their own:
    that way Spark works out each step once per row, however often the next one uses it.
    """
    raw = strip(F.coalesce(col(url), F.lit("")))
    u = F.substring_index(F.regexp_replace(raw, "[\t\r\n]+", ""), "#", 1)
    u = F.when(u.endswith("?"), F.regexp_replace(u, r"^([^?]*)\?$", "$1")).otherwise(u)
    scheme = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    lowered = F.concat(F.lower(scheme), u.substr(F.length(scheme) + 1, F.length(u)))
    return F.when(u.rlike("^[a-z0-9+.-]*[A-Z][A-Za-z0-9+.-]*:"), lowered).otherwise(u)


def keep_known(skills, known: Sequence[str]) -> Column:
    """SC-16: entries that are in ``known``, compared folded, original spelling kept."""
    table = _folded(known)
    return F.filter(col(skills), lambda s: F.array_contains(table, fold(s)))


def keep_unknown(skills, known: Sequence[str]) -> Column:
    """SC-16: entries that are not in ``known``."""
    table = _folded(known)
    return F.filter(col(skills), lambda s: ~F.array_contains(table, fold(s)))


def _folded(known: Sequence[str]) -> Column:
    return F.array(*(F.lit(k.strip().lower()) for k in known)).cast("array<string>")


def wait_from_header(header) -> Column:
    """SC-18: seconds from a header value, null when it is no number."""
    return strip(header).try_cast("double")


def wait_from_message(message) -> Column:
    """SC-17: seconds from a "try again in ..." text, null without one."""
    m = col(message)
    amount = F.regexp_extract(m, fixed.WAIT_MESSAGE_PATTERN, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(m, fixed.WAIT_MESSAGE_PATTERN, 2))
    return F.when(unit == "ms", amount / 1000).otherwise(amount)


def backoff_seconds(retry_number) -> Column:
    """SC-20: 1, 2, 4, ... seconds for retry 0, 1, 2, ..."""
    return F.lit(fixed.BACKOFF_SECONDS) * F.pow(F.lit(2.0), col(retry_number))


def rate_limit_wait(header, message, retry_number, jitter=None) -> Column:
    """SC-19: header, else message, else backoff; jitter on top, all of it capped."""
    base = F.coalesce(wait_from_header(header), wait_from_message(message),
                      backoff_seconds(retry_number))
    extra = F.rand() * fixed.WAIT_JITTER_SECONDS if jitter is None else col(jitter)
    return F.least(base + extra, F.lit(fixed.WAIT_CAP_SECONDS))


def estimated_cost(model, prompt_tokens, completion_tokens) -> Column:
    """SC-21: cost at the one known price, null for every other model."""
    cost = (col(prompt_tokens) / 1_000_000) * fixed.PRICE_PER_MILLION_PROMPT \
        + (col(completion_tokens) / 1_000_000) * fixed.PRICE_PER_MILLION_COMPLETION
    return F.when(col(model) == fixed.PRICED_MODEL, round_half_even(cost, 6))


def score_band(score) -> Column:
    """SC-29: name of the band a score from 0 to 100 falls in."""
    band = None
    for floor, label in fixed.SCORE_BANDS:
        test = col(score) >= floor
        band = F.when(test, label) if band is None else band.when(test, label)
    return band


def round_half_even(c, digits: int) -> Column:
    """Rounding of the double's exact value, halves to even; Spark's own rounds its decimal text.

    The two differ for a number like 8.1025, whose nearest double lies below the half. The part
    behind the point is a whole number of 2**-52, so decimal arithmetic decides the case exactly.
    """
    value, unit = col(c).cast("double"), 2 ** 52
    x = F.abs(value)
    whole = F.floor(x)
    scaled = (x - whole) * float(unit)
    parts = F.floor(scaled)
    n = parts.cast("decimal(16,0)") * F.lit(10 ** digits).cast("decimal(7,0)")
    rest = n % F.lit(unit).cast("decimal(16,0)")
    down = ((n - rest) / F.lit(unit).cast("decimal(16,0)")).cast("long")
    half = F.lit(unit // 2).cast("decimal(16,0)")
    # What is left of a small number behind the last whole part counts as well.
    beyond = (rest - half).cast("double") + (scaled - parts) * float(10 ** digits)
    up = (beyond > 0) | ((beyond == 0) & (down % 2 == 1))
    exact = whole.cast("decimal(16,0)") * F.lit(10 ** digits).cast("decimal(7,0)") + (down + up.cast("long")).cast("decimal(7,0)")
    rounded = (exact / F.lit(10 ** digits).cast("decimal(7,0)")).cast("double")
    # From 2**52 on a double is a whole number, and stays as it is.
    return F.when(x < float(unit), F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)


def round3(c) -> Column:
    """SC-30."""
    return round_half_even(c, 3)
