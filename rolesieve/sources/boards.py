"""Board payloads and search items to job rows: SRC-1 to SRC-5, SRC-7, SRC-10.

A payload is one JSON text per board. It is parsed once, its records become rows, and every
record is checked field by field: a good one becomes a job, a bad one a row with the reason.
Nothing is inferred from the data, and no step needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve import fixed
from rolesieve.functions.html import html_to_text, sections_text
from rolesieve.functions.text import col, strip, truthy
from rolesieve.functions.values import epoch_ms_to_date
from rolesieve.profile import Profile
from rolesieve.schema import JOB_SCHEMA, make_seq
from rolesieve.session import checkpointed
from rolesieve.sources.config import configured_boards
from rolesieve.sources.pieces import split
from rolesieve.sources.variant import Field, first_reason, parse_whole

# Order in which sources are read.
SOURCE_ORDER = {fixed.BOARD_A: 0, fixed.BOARD_B: 1, fixed.SEARCH: 2}

# A variant holds no more; a larger value is named as such. Larger files are read as pieces.
MAX_PAYLOAD_BYTES = 128 * 1024 * 1024

_PATH = {fixed.BOARD_A: "$.jobs", fixed.BOARD_B: "$", fixed.SEARCH: "$"}
_WANTED = {
    fixed.BOARD_A: "expected a 'jobs' list",
    fixed.BOARD_B: "expected a JSON list",
    fixed.SEARCH: "expected a JSON list",
}


@dataclass(frozen=True)
class Collected:
    """Job rows, and the payloads and records that gave none."""

    jobs: DataFrame
    bad_records: DataFrame
    bad_payloads: DataFrame


def check_payloads(payloads: DataFrame, source: str) -> DataFrame:
    """SRC-4: adds ``records`` (null when unusable) and ``payload_error`` (null when fine)."""
    parsed = payloads.withColumn("_v", parse_whole("payload"))
    records = F.try_variant_get("_v", _PATH[source], "array<variant>")
    too_large = F.octet_length("payload") > MAX_PAYLOAD_BYTES
    error = F.when(F.col("_v").isNull() & too_large, "payload too large to parse whole") \
        .when(F.col("_v").isNull(), "invalid JSON") \
        .when(F.col("records").isNull(), _WANTED[source])
    return parsed.withColumn("records", records).withColumn("payload_error", error).drop("_v")


def payload_records(checked: DataFrame, strict: bool) -> DataFrame:
    """One row per record with its position. Strict: an unusable payload is an error naming the board."""
    if strict:
        # Naming the board's place as well ties the check to the configured boards: it cannot
        # be moved below the join with them and fail on a payload nobody asked for.
        complaint = F.concat(F.lit("board '"), F.col("token"), F.lit("' (number "),
                             F.col("board_ord") + 1, F.lit("): "), F.col("payload_error"))
        checked = checked.withColumn("records", F.when(F.col("payload_error").isNull(), F.col("records"))
                                     .otherwise(F.raise_error(complaint)))
    # The outer form and a filter: the plain form makes Spark test the list for rows before it
    # explodes it, which parses every payload a second time.
    return checked.select(
        "token", "company", "board_ord", F.posexplode_outer("records").alias("pos", "record"),
    ).filter(F.col("pos").isNotNull())


@dataclass(frozen=True)
class _Parts:
    id: Field
    title: Column
    company: Column
    location: Column
    description: Column
    url: Column
    posted_date: Column
    reason: Column


def _required_text(f: Field, name: str) -> tuple[Column, str]:
    return ~f.is_string, f"{name} is missing or not text"


def _nested_location(holder: Field, name: Field) -> tuple[Column, list[tuple[Column, str]]]:
    location = F.when(holder.is_object, truthy(strip(name.string)))
    return location, [(~holder.empty & ~holder.is_object, "location is not an object"),
                      (holder.is_object & name.odd, "location name is not text")]


def _board_a(r: str) -> _Parts:
    rid, title, url = Field(r, "$.id"), Field(r, "$.title"), Field(r, "$.absolute_url")
    content = Field(r, "$.content")
    location, location_checks = _nested_location(Field(r, "$.location"), Field(r, "$.location.name"))
    return _Parts(
        id=rid, title=title.text, company=F.col("company"), location=location,
        description=html_to_text(content.string), url=url.text,
        # Only a last-changed time exists upstream, which is not a posting date.
        posted_date=F.lit(None).cast("date"),
        reason=first_reason(
            (~rid.is_scalar, "id is missing"), _required_text(title, "title"),
            _required_text(url, "absolute_url"), *location_checks,
            (content.odd, "content is not text")))


def _board_b(r: str) -> _Parts:
    rid, title = Field(r, "$.id"), Field(r, "$.text")
    hosted, apply = Field(r, "$.hostedUrl"), Field(r, "$.applyUrl")
    location, location_checks = _nested_location(
        Field(r, "$.categories"), Field(r, "$.categories.location"))
    mains = [Field(r, p) for p in (
        "$.descriptionHtml", "$.description", "$.content.descriptionHtml", "$.content.description")]
    main_is_odd = F.coalesce(*(F.when(~m.empty, m.odd) for m in mains), F.lit(False))
    items = F.coalesce(F.try_variant_get(col(r), "$.lists", "array<variant>"),
                       F.try_variant_get(col(r), "$.content.lists", "array<variant>"))
    objects = F.filter(items, lambda i: F.coalesce(
        F.schema_of_variant(i).startswith("OBJECT<"), F.lit(False)))
    sections = F.transform(objects, lambda i: F.struct(
        Field(i, "$.text").string.alias("heading"), Field(i, "$.content").string.alias("content")))
    odd_section = F.coalesce(F.exists(objects, lambda i: Field(i, "$.content").odd | (
        Field(i, "$.content").is_string & Field(i, "$.text").odd)), F.lit(False))
    created = Field(r, "$.createdAt")
    return _Parts(
        id=rid, title=title.text, company=F.col("company"), location=location,
        description=sections_text(F.coalesce(*(m.string for m in mains)), sections),
        url=F.coalesce(hosted.string, apply.text),
        posted_date=F.when(created.is_number, epoch_ms_to_date(
            F.try_variant_get(col(r), "$.createdAt", "double"))),
        reason=first_reason(
            (~rid.is_scalar, "id is missing"), _required_text(title, "text"),
            (hosted.odd, "hostedUrl is not text"),
            (hosted.empty & ~apply.is_string, "hostedUrl and applyUrl are missing or not text"),
            *location_checks, (main_is_odd, "description is not text"),
            (odd_section, "a list section is not text")))


def _search(r: str) -> _Parts:
    rid, title, company = Field(r, "$.jobId"), Field(r, "$.title"), Field(r, "$.companyName")
    public, url = Field(r, "$.publicUrl"), Field(r, "$.url")
    location, description = Field(r, "$.locationText"), Field(r, "$.description")
    return _Parts(
        id=rid, title=title.text, company=company.text,
        # Taken as it is, not even stripped.
        location=F.when(location.is_string, location.text),
        description=html_to_text(description.string),
        url=F.coalesce(public.string, url.text), posted_date=F.lit(None).cast("date"),
        reason=first_reason(
            (~rid.is_scalar, "jobId is missing"), _required_text(title, "title"),
            _required_text(company, "companyName"), (public.odd, "publicUrl is not text"),
            (public.empty & ~url.is_string, "publicUrl and url are missing or not text"),
            (~location.missing & ~location.is_string, "locationText is not text"),
            (description.odd, "description is not text")))


_PARSERS: dict[str, Callable[[str], _Parts]] = {
    fixed.BOARD_A: _board_a, fixed.BOARD_B: _board_b, fixed.SEARCH: _search,
}


def parse_records(records: DataFrame, source: str) -> DataFrame:
    """SRC-1, SRC-2, SRC-3, SRC-5: job columns plus ``reject_reason`` for every record.

    ``records`` has ``token, company, board_ord, pos, record`` (a variant). Tables landed one
    record per row come in here directly.
    """
    parts = _PARSERS[source]("record")
    return records.select(
        make_seq(SOURCE_ORDER[source], "board_ord", "pos").alias("seq"),
        parts.id.text.alias("id"), parts.title.alias("title"), parts.company.alias("company"),
        parts.location.alias("location"), parts.description.alias("description"),
        parts.url.alias("url"), F.lit(source).alias("source"),
        parts.posted_date.alias("posted_date"), parts.reason.alias("reject_reason"),
        F.col("token"))


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select(*JOB_SCHEMA.fieldNames())


def bad_records(parsed: DataFrame) -> DataFrame:
    """SRC-5: what was left out and why; a record without an id goes by ``unknown``."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        "seq", "source", "token", F.coalesce("id", F.lit("unknown")).alias("id"), "reject_reason")


def read_payloads(payloads: DataFrame, source: str, strict: bool = True, written: bool = False) -> Collected:
    """SRC-1 to SRC-5 for ``payloads`` with ``token, company, board_ord, payload``.

    Strict, as a collection run is: a bad payload fails the job that reads it. Otherwise it
    is listed in ``bad_payloads``. A bad record never stops the others. With ``written`` the parsed
    records go to the checkpoint folder, for callers that read jobs or bad records more than once.
    """
    checked = check_payloads(payloads, source)
    parsed = parse_records(payload_records(checked, strict), source)
    parsed = checkpointed(parsed) if written else parsed
    broken = checked.filter(F.col("payload_error").isNotNull()).select(
        F.lit(source).alias("source"), "token", "payload_error")
    return Collected(good_records(parsed), bad_records(parsed), broken)


def read_pieces(pieces: DataFrame, source: str, strict: bool = True, written: bool = False) -> Collected:
    """SRC-1 to SRC-5 for boards of any size, as pieces with ``token, company, board_ord, place, text``.

    The same rows as :func:`read_payloads` gives for the pieces put together. Strict, the first
    bad payload is an error at once.
    """
    names = pieces.groupBy("token", "board_ord").agg(F.first("company").alias("company"))
    found = split(pieces, "jobs" if _PATH[source] == "$.jobs" else None, _WANTED[source], names)
    broken = found.boards.filter(F.col("payload_error").isNotNull())
    for board in broken.orderBy("board_ord", "token").take(1) if strict else ():
        raise RuntimeError(f"board '{board.token}' (number {board.board_ord + 1}): {board.payload_error}")
    parsed = parse_records(found.records, source)
    parsed = checkpointed(parsed) if written else parsed
    return Collected(good_records(parsed), bad_records(parsed), broken.select(F.lit(source).alias("source"), "token", "payload_error"))


def configured_payloads(spark: SparkSession, profile: Profile, source: str,
                        payloads: DataFrame) -> DataFrame:
    """SRC-6: landed ``token, payload`` rows of the configured boards, with name and order.

    No hint: Spark broadcasts the board table as long as it is below its own threshold.
    """
    return payloads.join(configured_boards(spark, profile, source), "token")


def missing_boards(spark: SparkSession, profile: Profile, source: str,
                   payloads: DataFrame) -> DataFrame:
    """Configured boards for which nothing has landed."""
    return configured_boards(spark, profile, source).join(
        payloads.select("token"), "token", "left_anti")


def gate_runs(items: DataFrame, runs: DataFrame, strict: bool = True) -> DataFrame:
    """SRC-10: search items joined to their run; only finished runs with a dataset count.

    ``runs`` has ``token, dataset_id, status, status_message``. Adds ``run_error``, null for a
    usable run. Strict: a failed run is an error, not "no rows".
    """
    joined = items.join(_one_run(runs), "token", "left").withColumn("run_error", run_error()).drop("_runs")
    if not strict:
        return joined
    complaint = F.concat(F.lit("search run for '"), F.col("token"), F.lit("': "), F.col("run_error"))
    # In a filter, so that leaving the column out of a later select cannot leave the check out.
    return joined.filter(F.when(F.col("run_error").isNotNull(), F.raise_error(complaint).cast("boolean")).otherwise(True))


def _one_run(runs: DataFrame) -> DataFrame:
    """A row per token, so that no item doubles; how many runs there were is in ``_runs``."""
    return runs.groupBy("token").agg(
        F.max(F.struct("dataset_id", "status", "status_message")).alias("_run"), F.count(F.lit(1)).alias("_runs")
    ).select("token", "_run.*", "_runs")


def run_error() -> Column:
    """SRC-10: more than one run of a token, a run without a dataset, a run that did not succeed."""
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    message = F.coalesce(F.col("status_message"), F.lit("none"))
    return F.when(F.col("_runs") > 1, "more than one run") \
        .when(F.coalesce(F.col("dataset_id"), F.lit("")) == "", "no dataset") \
        .when(status != fixed.RUN_SUCCEEDED,
              F.concat(F.lit("status="), status, F.lit(", message="), message))


def failed_runs(runs: DataFrame) -> DataFrame:
    """SRC-10: runs that are an error, also those that left no item behind."""
    return _one_run(runs).withColumn("run_error", run_error()).drop("_runs").filter(F.col("run_error").isNotNull())


def union_sources(*tables: DataFrame) -> DataFrame:
    """SRC-7 / SET-1: bag union; ``seq`` already carries the order of sources and boards."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def union_collected(*parts: Collected) -> Collected:
    """SRC-7: what several sources gave, as one."""
    return Collected(union_sources(*(p.jobs for p in parts)),
                     union_sources(*(p.bad_records for p in parts)),
                     union_sources(*(p.bad_payloads for p in parts)))


def collect_jobs(spark: SparkSession, profile: Profile, board_a: DataFrame | Sequence[DataFrame] | None = None,
                 board_b: DataFrame | Sequence[DataFrame] | None = None, search: DataFrame | None = None,
                 runs: DataFrame | None = None, strict: bool = True, written: bool = False,
                 landed: Mapping[str, DataFrame] | None = None) -> Collected:
    """SRC-7: jobs of every enabled source in configured order.

    ``board_a`` and ``board_b`` hold ``token, payload``, or ``token, place, text`` for boards that
    are read as pieces, or are a list of such tables; ``search`` holds ``token`` (the
    location searched), ``board_ord`` (the request's place) and ``payload``, and ``runs`` the
    state of each search run. Strict, anything missing or failed is an error; otherwise a failed
    run gives no rows. ``landed`` names the tokens that have landed by source, as ``landed_files`` lists
    them; without it the strict check reads the payloads once more.
    """
    parts: list[Collected] = []
    for source, payloads in ((fixed.BOARD_A, board_a), (fixed.BOARD_B, board_b)):
        if payloads is None:
            continue
        tables = payloads if isinstance(payloads, (list, tuple)) else [payloads]
        if strict:
            tokens = (landed or {}).get(source)
            if tokens is None:
                tokens = union_sources(*(t.select("token") for t in tables))
            absent = [r.token for r in missing_boards(spark, profile, source, tokens).take(1)]
            if absent:
                raise RuntimeError(f"board '{absent[0]}': no payload has landed")
        for table in tables:
            read = read_pieces if "place" in table.columns else read_payloads
            parts.append(read(configured_payloads(spark, profile, source, table), source, strict, written))
    if search is not None and (profile.sources.get(fixed.SEARCH) or {}).get("enabled") \
            and profile.roles and profile.locations:
        if runs is None and strict:
            raise RuntimeError("search items without the state of their runs")
        if runs is not None:
            failed = failed_runs(runs).take(1) if strict else []
            if failed:
                raise RuntimeError(f"search run for '{failed[0].token}': {failed[0].run_error}")
            search = gate_runs(search, runs, strict).filter(F.col("run_error").isNull())
        rows = search.select("token", F.lit(None).cast("string").alias("company"), "board_ord", "payload")
        parts.append(read_payloads(rows, fixed.SEARCH, strict, written))
    if not parts:
        return Collected(
            spark.createDataFrame([], JOB_SCHEMA),
            spark.createDataFrame([], "seq long, source string, token string, id string, reject_reason string"),
            spark.createDataFrame([], "source string, token string, payload_error string"))
    return union_collected(*parts)
