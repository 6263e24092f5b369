"""Batch scoring with failures as data: SCO-1 to SCO-8, JOI-2, JOI-4, AGG-8, AGG-9.

Requests, replies and skips are tables. The scorer is any function of two texts; it runs inside
tasks, once per row, and what it returns is written before anything reads it.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rolesieve import fixed
from rolesieve.functions.prompt import is_cut, user_prompt
from rolesieve.functions.text import let, once, phrases_in
from rolesieve.functions.values import keep_known, keep_unknown
from rolesieve.profile import Profile
from rolesieve.schema import REPLY_SCHEMA, job_struct
from rolesieve.session import checkpointed, new_folder
from rolesieve.sources.variant import Field, parse_whole

REPLY_COLUMNS = REPLY_SCHEMA.fieldNames()
LEDGER_SCHEMA = StructType([*REPLY_SCHEMA.fields, StructField("request", StringType())])
#: Requests that a lost task may have to ask again.
CHUNK_ROWS = 1000


@dataclass(frozen=True)
class Reply:
    """What a scorer may return instead of a bare mapping."""

    content: dict | str | None = None
    refusal: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class ScoringError(RuntimeError):
    """A failure a scorer reports with its own type and number of attempts."""

    def __init__(self, message: str, error_type: str, attempts: int = 1):
        super().__init__(message)
        self.error_type, self.attempts = error_type, attempts


def requests(jobs: DataFrame, profile: Profile, system_prompt: str, max_chars: int | None = None) -> DataFrame:
    """SCO-1: one request per job. ``max_chars`` cuts long descriptions; ``description_cut`` says where."""
    return jobs.select("seq", "id", F.lit(system_prompt).alias("system_prompt"),
                       user_prompt(profile, max_chars).alias("user_prompt"),
                       is_cut("description", max_chars).alias("description_cut"),
                       F.lit(fixed.TEMPERATURE).alias("temperature"))


def _one(scorer: Callable, row) -> tuple:
    try:
        got = scorer(row.system_prompt, row.user_prompt)
    except Exception as exc:  # one row's failure never reaches the others
        kind = getattr(exc, "error_type", type(exc).__name__)
        return None, None, kind, str(exc), int(getattr(exc, "attempts", 1)), None, None
    reply = got if isinstance(got, Reply) else Reply(content=got)
    text = reply.content if isinstance(reply.content, str) or reply.content is None \
        else json.dumps(reply.content)
    return text, reply.refusal, None, None, 1, reply.prompt_tokens, reply.completion_tokens


def score(reqs: DataFrame, scorer: Callable, max_workers: int | None = None, ledger: str | None = None,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """SCO-2: a reply row per request, from a ledger of replies that asks only for what is missing.

    ``scorer(system_prompt, user_prompt)`` returns a mapping, JSON text or ``Reply``, or raises.
    Requests are asked in chunks of about ``chunk_rows``, a chunk to a task, and the replies of a
    chunk come into the ledger as one file when its task ends, whatever becomes of the others. So
    a lost executor, a failed job or a lost driver costs the chunks that were under way: the same
    call with the same ``ledger`` folder goes on from there, and asks nothing that has a reply. A
    request is known by its ``seq`` and its two texts; a changed text is asked anew. Without
    ``ledger`` a new folder below ``spark.checkpoint.dir`` serves for this call. ``max_workers`` bounds
    the calls in flight, for a service that allows only so many: chunks then go in rounds.
    """
    # Tasks get these few helpers with the scorer, so workers need not have the package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark, folder = reqs.sparkSession, ledger or new_folder(reqs.sparkSession)
    texts = F.concat(F.length("system_prompt"), F.lit(":"), "system_prompt", "user_prompt")
    asked = reqs.select("seq", F.sha2(texts, 256).alias("request"), "system_prompt", "user_prompt")
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(folder)
    known = spark.read.schema(LEDGER_SCHEMA).parquet(folder)
    missing = checkpointed(asked.join(known.select("seq", "request"), ["seq", "request"], "left_anti"))
    chunks = -(-missing.count() // chunk_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row.seq, *_one(scorer, row), row.request) for row in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*REPLY_COLUMNS, "request"]).astype(
                {"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    rounds = -(-chunks // (max_workers or max(chunks, 1)))
    for r in range(rounds):
        part = missing.where(F.pmod(F.xxhash64("seq"), F.lit(rounds)) == r).repartition(max_workers or chunks)
        # The second way of committing shows a task's file when the task ends, not when the job does.
        part.mapInPandas(run, LEDGER_SCHEMA).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    found = spark.read.schema(LEDGER_SCHEMA).parquet(folder).join(asked.select("seq", "request"), ["seq", "request"], "left_semi")
    # A task that was lost after its file came in has asked twice; one reply counts.
    return found.groupBy("seq", "request").agg(F.min(F.struct(*REPLY_COLUMNS)).alias("_r")).select("_r.*")


def offline_replies(jobs: DataFrame, profile: Profile) -> DataFrame:
    """SCO-8: replies without a model: the share of profile skills named in the description."""
    return jobs.select("seq", once(offline_result(profile)).alias("_r")).select(
        "seq", F.to_json("_r").alias("reply_json"), F.lit(None).cast("string").alias("refusal"),
        F.lit(None).cast("string").alias("error_type"),
        F.lit(None).cast("string").alias("error_message"), F.lit(1).alias("attempts"),
        F.lit(None).cast("long").alias("prompt_tokens"),
        F.lit(None).cast("long").alias("completion_tokens"))


def offline_result(profile: Profile) -> Column:
    """SCO-8 as one struct column in the reply's own shape."""
    size = max(len(profile.skills), 1)
    return let(phrases_in("description", profile.skills), lambda hits: F.struct(
        F.round(F.size(hits) * F.lit(100.0) / size, 3).alias("score"),
        hits.alias("matched_skills"), F.array().cast("array<string>").alias("missing_skills"),
        F.concat(F.size(hits), F.lit(f" of {len(profile.skills)} profile skills named")).alias("rationale")))


def parse_replies(replies: DataFrame) -> DataFrame:
    """SCO-3 / SCO-4: the reply's fields where it is valid, ``error_type`` where it is not.

    An error from the scorer comes first, then a refusal, then no reply, then a reply that does
    not have the required shape.
    """
    parsed = replies.select("*", once(parse_whole("reply_json")).alias("_v"))
    score, rationale = Field("_v", "$.score"), Field("_v", "$.rationale")
    lists = {n: Field("_v", f"$.{n}") for n in ("matched_skills", "missing_skills")}
    number = F.try_variant_get("_v", "$.score", "double")
    bad_score = score.missing | ~F.coalesce(
        score.type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING)")
        & number.between(fixed.SCORE_MIN, fixed.SCORE_MAX), F.lit(False))
    # A list left out is empty; anything but a list of texts is wrong.
    bad_list = [f.type.isNotNull() & (~((f.type == "ARRAY<STRING>") | (F.to_json(f.value) == "[]")) | F.coalesce(
        F.exists(F.try_variant_get("_v", f"$.{n}", "array<string>"), lambda x: x.isNull()), F.lit(False)))
                for n, f in lists.items()]
    invalid = F.col("_v").isNull() | bad_score | ~rationale.is_string | bad_list[0] | bad_list[1]
    refused = F.coalesce(F.col("refusal"), F.lit("")) != ""
    error = F.when(F.col("error_type").isNotNull(), F.col("error_type")) \
        .when(refused, "Refusal") \
        .when(F.col("reply_json").isNull(), "NoStructuredResult") \
        .when(invalid, "ValidationError")
    message = F.when(F.col("error_type").isNotNull(), F.col("error_message")) \
        .when(refused, F.concat(F.lit("scorer refused: "), F.col("refusal"))) \
        .when(F.col("reply_json").isNull(), "scorer returned no structured result") \
        .when(invalid, "reply does not have the required fields")
    attempts = F.when(F.col("error_type").isNotNull(), F.col("attempts")).otherwise(F.lit(1))
    empty = F.array().cast("array<string>")
    return parsed.select(
        "seq", error.alias("error_type"), message.alias("error_message"),
        attempts.cast("int").alias("attempts"), number.alias("score"),
        *(F.coalesce(F.try_variant_get("_v", f"$.{n}", "array<string>"), empty).alias(n) for n in lists),
        rationale.text.alias("rationale"))


def attach(jobs: DataFrame, parsed: DataFrame) -> DataFrame:
    """JOI-4: each job with its reply, by position."""
    return jobs.select("seq", job_struct().alias("job")).join(parsed, "seq")


def attach_offline(jobs: DataFrame, profile: Profile) -> DataFrame:
    """SCO-8 straight to the attached form: the result is a column of the job's own row, so no join."""
    none = F.lit(None).cast("string")
    return jobs.select("seq", job_struct().alias("job"), offline_result(profile).alias("_r")).select(
        "seq", "job", none.alias("error_type"), none.alias("error_message"), F.lit(1).alias("attempts"),
        "_r.score", "_r.matched_skills", "_r.missing_skills", "_r.rationale")


def matched(attached: DataFrame, profile: Profile) -> DataFrame:
    """SCO-5 / SCO-6: scored jobs with the skill rules applied, plus how many entries they dropped."""
    ok = attached.filter(F.col("error_type").isNull())
    kept = ok.withColumns({
        "_matched": keep_known("matched_skills", profile.skills),
        "_missing": keep_unknown("missing_skills", profile.skills),
    })
    return kept.select(
        "seq", "job", "score", F.col("_matched").alias("matched_skills"),
        F.col("_missing").alias("missing_skills"), "rationale",
        (F.size("matched_skills") - F.size("_matched")).alias("dropped_matched"),
        (F.size("missing_skills") - F.size("_missing")).alias("dropped_missing"))


def skipped(attached: DataFrame) -> DataFrame:
    """SCO-5: one row per job without a score, with the reason."""
    return attached.filter(F.col("error_type").isNotNull()).select(
        "seq", "job.id", "job.title", "job.company", "error_type", "error_message", "attempts")


def unanswered(jobs: DataFrame, replies: DataFrame) -> DataFrame:
    """JOI-4: jobs for which no reply row exists at all."""
    return jobs.join(replies.select("seq"), "seq", "left_anti")


def scoring_stats(attached: DataFrame, profile: Profile) -> DataFrame:
    """SCO-7 / AGG-9: one row of totals and the warning text, in one pass; zeros for empty input."""
    ok = F.col("error_type").isNull()

    def dropped(name: str, kept: Column) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.size(name) - F.size(kept))), F.lit(0)).alias(f"dropped_{name}")

    sums = attached.agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(~ok).alias("skipped_jobs"),
        dropped("matched_skills", keep_known("matched_skills", profile.skills)),
        dropped("missing_skills", keep_unknown("missing_skills", profile.skills)))
    return sums.withColumn("warning", F.when(F.col("skipped_jobs") > 0, F.concat(
        F.col("skipped_jobs"), F.lit(" of "), F.col("jobs"), F.lit(" jobs skipped"))))
