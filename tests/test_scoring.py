import json

import pytest
from pyspark.sql import functions as F

from rolesieve import JOB_SCHEMA, Profile
from rolesieve.functions import prompt
from rolesieve.functions.values import keep_known, keep_unknown, score_band
from rolesieve.operators import scoring
from rolesieve.plans.match_and_rank import export, match

PROFILE = Profile.from_dict({"roles": ["Backend Engineer", "SDE"], "skills": ["Python", "SQL", "C++"],
                             "experience": {"min_years": 0, "max_years": 2}, "exclude_title_words": []})


def jobs(spark, n=4, **over):
    base = dict(title="Engineer", company="Acme", location=None, description="python and sql", source="greenhouse",
                posted_date=None)
    rows = [(i, f"id{i}", *(base | over).values()) for i in range(n)]
    names = ["seq", "id", *(base | over)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'seq' else 'date' if c == 'posted_date' else 'string'}" for c in names))
    return df.withColumn("url", F.concat(F.lit("u"), "seq")).select(*JOB_SCHEMA.fieldNames())


def test_prompt(spark):
    row = scoring.requests(jobs(spark, 1, description="x" * 13000), PROFILE, "sys").first()
    assert row.user_prompt.startswith(
        "PROFILE:\nTarget roles: Backend Engineer, SDE\nExperience: 0-2 years\nSkills: Python, SQL, C++\n\nJOB:\n"
        "Title: Engineer\nCompany: Acme\nLocation: Not specified\nDescription: xxx")
    assert "x" * 13000 in row.user_prompt and not row.description_cut
    row = scoring.requests(jobs(spark, 1, description="x" * 13000), PROFILE, "sys", max_chars=12000).first()
    assert row.description_cut
    assert "x" * 12000 in row.user_prompt and "x" * 12001 not in row.user_prompt and "greenhouse" not in row.user_prompt and "id0" not in row.user_prompt
    assert "Description: Not provided" in scoring.requests(jobs(spark, 1, description=""), PROFILE, "s").first().user_prompt
    assert [prompt.experience_text(*a) for a in ((None, None), (None, 3), (2, None), (0, 2))] \
        == ["Not specified", "0-3 years", "2-? years", "0-2 years"]


def parse(spark, *replies):
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r), None, None, None, 1) for i, r in enumerate(replies)]
    df = spark.createDataFrame(rows, "seq long, reply_json string, refusal string, error_type string, error_message string, attempts int")
    return scoring.parse_replies(df).orderBy("seq").collect()


def test_reply_validation(spark):
    good = {"score": 80, "rationale": "r"}
    got = parse(spark, good, good | {"score": 0.5, "matched_skills": ["a"], "missing_skills": []}, good | {"score": 100},
                good | {"score": "80"}, good | {"score": 999}, good | {"score": -1}, {"rationale": "r"}, {"score": 1},
                good | {"rationale": None}, good | {"matched_skills": None}, good | {"matched_skills": [1]},
                good | {"matched_skills": "a"}, "no json", "[]", "{} x", None, json.dumps(good) + " trailing")
    assert [r.error_type for r in got[:4]] == [None] * 4
    assert [r.score for r in got[:4]] == [80.0, 0.5, 100.0, 80.0]
    assert got[0].matched_skills == [] and got[1].matched_skills == ["a"]
    assert {r.error_type for r in got[4:15]} == {"ValidationError"}
    assert got[15].error_type == "NoStructuredResult"
    assert got[16].error_type == "ValidationError"


def test_failures_are_rows_and_others_go_on(spark):
    def scorer(system, user):
        if "Title: bad" in user:
            raise scoring.ScoringError("slow down", "RateLimitError", attempts=7)
        if "Title: odd" in user:
            raise KeyError("x")
        if "Title: refuse" in user:
            return scoring.Reply(refusal="will not")
        if "Title: none" in user:
            return None
        return scoring.Reply({"score": 70, "matched_skills": [" python ", "Rust", "C++"],
                              "missing_skills": ["sql", "Go"], "rationale": "ok"}, prompt_tokens=5, completion_tokens=2)

    titles = ["ok", "bad", "odd", "refuse", "none", "ok"]
    table = jobs(spark, 6).withColumn("title", F.element_at(F.array(*map(F.lit, titles)), F.col("seq").cast("int") + 1))
    stages = match(table, PROFILE.__class__(skills=PROFILE.skills), scorer, "sys", max_workers=2)
    skips = {r.seq: r for r in stages.skips.collect()}
    assert {s: (r.error_type, r.attempts) for s, r in skips.items()} == {
        1: ("RateLimitError", 7), 2: ("KeyError", 1), 3: ("Refusal", 1), 4: ("NoStructuredResult", 1)}
    assert skips[1].error_message == "slow down" and skips[1].title == "bad"
    got = stages.matches.orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 5]
    assert got[0].matched_skills == [" python ", "C++"] and got[0].missing_skills == ["Go"]
    assert got[0].job.title == "ok" and got[0].score == 70.0
    stats = stages.stats.first()
    assert (stats.jobs, stats.skipped_jobs, stats.dropped_matched_skills, stats.dropped_missing_skills) == (6, 4, 2, 2)
    assert stats.warning == "4 of 6 jobs skipped"


def test_scorer_runs_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(system, user):
        calls.add(1)
        return {"score": 1, "rationale": "r"}

    replies = scoring.score(scoring.requests(jobs(spark, 5), PROFILE, "s"), scorer, 3)
    assert replies.count() == 5 and replies.filter("attempts = 1").count() == 5
    assert calls.value == 5


def test_empty_input(spark, tmp_path):
    stages = match(jobs(spark, 1).limit(0), PROFILE)
    stats = stages.stats.first()
    assert (stats.jobs, stats.skipped_jobs, stats.dropped_matched_skills, stats.warning) == (0, 0, 0, None)
    export(stages, str(tmp_path / "new" / "out"), top=3)
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / "new" / "out" / name).glob("part-*")))
    assert json.loads(read("jobs.json")) == []
    assert json.loads(read("skipped.json")) == {"skipped_jobs": 0, "skipped_details": []}
    assert read("jobs.md") == "# Job Matches\n\nNo matching jobs found.\n"
    assert read("jobs.csv").strip() == "rank,score,title,company,location,source,url,matched_skills,missing_skills,rationale"


def test_offline_scores(spark):
    table = jobs(spark, 3).withColumn("description", F.element_at(F.array(
        F.lit("Python, SQL."), F.lit("pythonic"), F.lit(None)), F.col("seq").cast("int") + 1))
    got = match(table, PROFILE).matches.orderBy("seq").collect()
    assert [(r.score, r.matched_skills, r.missing_skills) for r in got] == [
        (66.667, ["Python", "SQL"], []), (0.0, [], []), (0.0, [], [])]
    by_reply = scoring.matched(scoring.attach(table, scoring.parse_replies(scoring.offline_replies(table, PROFILE))), PROFILE)
    assert [r.score for r in by_reply.orderBy("seq").collect()] == [66.667, 0.0, 0.0]
    assert scoring.unanswered(table, by_reply.filter("seq > 0")).count() == 1


@pytest.mark.parametrize("entries,known,unknown", [
    (["Python", " sql", "PYTHON "], ["Python", " sql", "PYTHON "], []), (["Golang", "Go"], [], ["Golang", "Go"]), ([], [], []),
])
def test_skill_lists(spark, entries, known, unknown):
    row = spark.createDataFrame([(entries,)], "s array<string>").select(
        keep_known("s", PROFILE.skills).alias("k"), keep_unknown("s", PROFILE.skills).alias("u")).first()
    assert (row.k, row.u) == (known, unknown)


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (100.0, 90.0, 89.9, 75.0, 60.0, 40.0, 39.9, 0.0)], "s double")
    assert [r.b.split()[0] for r in df.select(score_band("s").alias("b")).collect()] == [
        "exceptional", "exceptional", "strong", "strong", "reasonable", "weak", "poor", "poor"]


def test_replies_are_worked_out_once(spark):
    """The filter on errors is not moved below the reply, where each of its uses would search the text again."""
    jobs = spark.createDataFrame([(1, "the cat"), (2, None)], "seq long, description string")
    jobs = jobs.select("seq", *(F.lit("x").alias(n) for n in ("id", "title", "company", "location", "url", "source")), "description", F.lit(None).cast("date").alias("posted_date"))
    profile = Profile(skills=("the", "of"))
    out = scoring.matched(scoring.attach(jobs, scoring.parse_replies(scoring.offline_replies(jobs, profile))), profile)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and plan.count("parseJson(") == 1
    assert [(r.seq, r.score, r.matched_skills) for r in out.orderBy("seq").collect()] == [(1, 50.0, ["the"]), (2, 0.0, [])]
