"""Q-5: which companies have a public board, judged from landed payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import board_name_from_url, display_name, slug_variants
from rolesieve.operators import probe
from rolesieve.sources.boards import check_payloads, union_sources
from rolesieve.session import checkpointed

BOARD = ("platform", "slug")

# Where a payload keeps location, title and link.
_PATHS = {
    fixed.BOARD_A: ("$.location.name", "$.title", "$.absolute_url"),
    fixed.BOARD_B: ("$.categories.location", "$.text", "$.hostedUrl"),
}


@dataclass(frozen=True)
class ProbeReport:
    hits: DataFrame
    misses: DataFrame


def candidates(companies: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """SC-22: ``company, slug, hint`` guesses, both platforms each."""
    return companies.select("company", F.explode(slug_variants("company", aliases)).alias("g")).select(
        "company", "g.slug", "g.hint",
        F.explode(F.array(F.lit(fixed.BOARD_A), F.lit(fixed.BOARD_B))).alias("platform"))


def extra_candidates(slugs: DataFrame) -> DataFrame:
    """``platform, slug`` rows to look at directly, without guessing."""
    return slugs.select(display_name("slug").alias("company"), "slug", F.col("slug").alias("hint"), "platform")


def landed_postings(payloads: DataFrame, platform: str) -> DataFrame:
    """Postings of the usable boards; a board without any has one row with nothing in it.

    An unusable payload is a miss, never an error (SRC-4).
    """
    location, title, url = _PATHS[platform]
    checked = check_payloads(payloads.select(F.col("token").alias("slug"), "payload"), platform) \
        .filter(F.col("payload_error").isNull())
    rows = checked.select(F.lit(platform).alias("platform"), "slug",
                          F.posexplode_outer("records").alias("pos", "r"))

    def text(path: str):
        return F.try_variant_get("r", path, "string")

    return rows.select(*BOARD, "pos", text(location).alias("location"), text(title).alias("title"),
                       text(url).alias("url"))


def board_probe(guesses: DataFrame, companies: DataFrame, board_a: DataFrame, board_b: DataFrame,
                board_names: DataFrame) -> ProbeReport:
    """``board_a`` and ``board_b`` hold ``token, payload``; ``board_names`` the names of A boards
    (``slug, board_name``). Payloads are parsed once and the few fields needed written once;
    boards are summed up before guesses are joined to them.
    """
    wanted = guesses.select(F.col("slug").alias("token")).distinct()
    postings = checkpointed(union_sources(*(
        landed_postings(payloads.join(wanted, "token", "left_semi"), platform)
        for platform, payloads in ((fixed.BOARD_A, board_a), (fixed.BOARD_B, board_b)))))
    on = list(BOARD)
    given = board_names.select(F.lit(fixed.BOARD_A).alias("platform"), "slug", "board_name")
    own = F.when(F.col("platform") == fixed.BOARD_B, board_name_from_url("first_value"))
    found = probe.summarize(postings, *on) \
        .join(probe.first_posting(postings, "url", *on), on) \
        .join(given, on, "left") \
        .withColumn("board_name", F.coalesce("board_name", own)).drop("first_value") \
        .join(probe.sample_titles(postings, *on), on, "left")
    hits = probe.mark_verified(guesses.join(found, on))
    return ProbeReport(hits, probe.misses(companies, hits))
