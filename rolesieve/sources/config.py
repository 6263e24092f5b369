"""Which sources to read, and with which display names: SRC-6, SRC-8, SRC-9."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.text import col, first_truthy
from rolesieve.profile import Profile

BOARD_SCHEMA = "token string, company string, board_ord long"


def _section(profile: Profile, name: str) -> dict:
    section = profile.sources.get(name) or {}
    return section if section.get("enabled") else {}


def configured_boards(spark: SparkSession, profile: Profile, source: str) -> DataFrame:
    """SRC-6: enabled boards with a token, in the order they are configured.

    The table is as long as the profile's list, so it may be broadcast.
    """
    if source == fixed.BOARD_A:
        entries, key = _section(profile, source).get("boards") or [], "token"
    elif source == fixed.BOARD_B:
        entries, key = _section(profile, source).get("companies") or [], "slug"
    else:
        raise ValueError(f"no board list for source {source!r}")
    rows = [(e[key], e.get("company")) for e in entries if e.get(key)]
    boards = [(token, company, n) for n, (token, company) in enumerate(rows)]
    return spark.createDataFrame(boards, BOARD_SCHEMA).withColumn(
        "company", display_company("company", "token"))


def display_company(company, token) -> Column:
    """SRC-8: the configured name, the token when there is none."""
    return first_truthy(company, col(token))


def expand_boards(entries: DataFrame) -> DataFrame:
    """SRC-6 over a table of configurations.

    ``entries`` has ``source, enabled, boards array<struct<token, company>>``; the result has
    one row per usable board with its place in its list.
    """
    usable = entries.filter("enabled").select(
        "source", F.posexplode("boards").alias("board_ord", "board"))
    return usable.filter(F.coalesce(F.col("board.token"), F.lit("")) != "").select(
        "source", F.col("board_ord").cast("long").alias("board_ord"), F.col("board.token").alias("token"),
        display_company("board.company", "board.token").alias("company"))


def search_requests(profiles: DataFrame, max_items: int = fixed.DEFAULT_MAX_ITEMS,
                    max_pages: int = fixed.DEFAULT_MAX_PAGES, max_searches: int | None = None) -> DataFrame:
    """SRC-9: one request per location; none without roles or locations.

    ``profiles`` has ``profile_id, roles array<string>, locations array<string>``. A service that
    takes only so many searches sets ``max_searches``; ``left_out`` then lists the other locations.
    """
    used = F.col("locations") if max_searches is None else F.slice("locations", 1, max_searches)
    left_out = F.slice("locations", F.lit(1 if max_searches is None else max_searches + 1), F.lit(0) if max_searches is None else F.greatest(F.size("locations"), F.lit(1)))
    return (
        profiles.filter(F.size("roles") > 0)
        .select("profile_id", F.array_join("roles", " OR ").alias("keywords"),
                left_out.alias("left_out"), F.posexplode(used).alias("pos", "location"))
        .select("profile_id", F.col("pos").cast("long").alias("request_ord"),
                F.lit("search").alias("mode"), "keywords", "location",
                F.lit(max_items).alias("max_items"), F.lit(max_pages).alias("max_pages"), "left_out")
    )


def profile_search_requests(spark: SparkSession, profile: Profile) -> DataFrame:
    """SRC-9 for one profile, with the bounds its search section sets."""
    section = _section(profile, fixed.SEARCH)
    one = spark.createDataFrame(
        [("profile", list(profile.roles), list(profile.locations))] if section else [],
        "profile_id string, roles array<string>, locations array<string>")
    return search_requests(one, section.get("max_items", fixed.DEFAULT_MAX_ITEMS),
                           section.get("max_pages", fixed.DEFAULT_MAX_PAGES), section.get("max_searches"))


def load_payload_files(spark: SparkSession, folder: str, up_to: int | None = None) -> DataFrame:
    """Landed payload files, one per board, named after its token: ``token, payload``.

    ``up_to`` leaves out files of more bytes, for :func:`rolesieve.sources.pieces.load_pieces`.
    """
    files = spark.read.text(str(PurePosixPath(folder) / "*.json"), wholetext=True)
    if up_to is not None:
        files = files.where(F.col("_metadata.file_size") <= up_to)
    return files.select(
        F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("token"),
        F.col("value").alias("payload"))


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """What has landed, from the folder's listing alone: ``token, bytes, landed_at``; no file is read."""
    files = spark.read.format("binaryFile").load(str(PurePosixPath(folder) / "*.json"))
    return files.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("token"),
                        F.col("length").alias("bytes"), F.col("modificationTime").alias("landed_at"))
