import json

import pytest
from pyspark.sql import functions as F

from rolesieve import Profile
from rolesieve.plans import board_probe as probing
from rolesieve.plans import reports
from rolesieve.plans.match_and_rank import export, match, run, stage_tables
from rolesieve.sources import boards


def payloads(spark, rows):
    return spark.createDataFrame([(t, p if isinstance(p, str) else json.dumps(p)) for t, p in rows], "token string, payload string")


def test_board_probe(spark):
    companies = spark.createDataFrame([("Acme Corp",), ("eternal",), ("Nobody",), ("Broken",)], "company string")
    a = payloads(spark, [
        ("acme-corp", {"jobs": [
            {"title": "Engineer", "location": {"name": "Remote - US"}}, {"title": "Software Developer", "location": {"name": "Pune, India"}},
            {"title": "Engineering Lead", "location": {"name": "Indianapolis"}}, {"title": None, "location": None}]}),
        ("acme", {"jobs": []}), ("broken", "<html>"), ("unrelated", {"jobs": []})])
    b = payloads(spark, [("zomato", [{"text": "Chef", "hostedUrl": "https://jobs.lever.co/zomato/1",
                                      "categories": {"location": "India"}}]), ("broken", {"jobs": []})])
    names = spark.createDataFrame([("acme-corp", "ACME Corp."), ("acme", "Other")], "slug string, board_name string")
    guesses = probing.candidates(companies, {"eternal": ["zomato"]})
    report = probing.board_probe(guesses, companies, a, b, names)
    hits = {r.slug: r for r in report.hits.collect()}
    assert set(hits) == {"acme-corp", "acme", "zomato"}
    hit = hits["acme-corp"]
    assert (hit.total_jobs, hit.india_or_remote_jobs, hit.engineering_jobs_india_or_remote, hit.explicit_india_jobs,
            hit.engineering_jobs_explicit_india) == (4, 2, 2, 1, 1)
    assert hit.sample_titles == ["Engineer", "Software Developer", "Engineering Lead"] and hit.verified
    assert hits["acme"].total_jobs == 0 and not hits["acme"].verified
    assert hits["zomato"].verified and hits["zomato"].company == "eternal" and hits["zomato"].board_name == "zomato"
    assert sorted(r.company for r in report.misses.collect()) == ["Broken", "Nobody"]
    extra = spark.createDataFrame([("lever", "zomato")], "platform string, slug string")
    direct = probing.board_probe(probing.extra_candidates(extra), companies, a, b, names).hits.collect()
    assert [(r.company, r.verified) for r in direct] == [("Zomato", True)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, str(i), ["Backend Engineer", "Senior Engineer", "Chef"][i % 3], f"c{i % 4}", ["Pune", "Oslo"][i % 2],
             "python sql" if i % 4 else "sql", f"https://x/{i % 30}", "greenhouse") for i in range(120)]
    return spark.createDataFrame(rows, "seq long, id string, title string, company string, location string, description string, "
                                       "url string, source string").withColumn("posted_date", F.lit(None).cast("date"))


PROFILE = Profile(roles=("Backend Engineer",), locations=("Pune",), skills=("Python", "SQL"))


def test_whole_run(spark, table, tmp_path):
    stages = match(table, PROFILE)
    ranked = export(stages, str(tmp_path), title="T")
    rows = ranked.orderBy("rank").collect()
    # Seq 0, 6, 12, ... pass the rules; seq and seq + 30 share a page.
    assert [r.seq for r in rows] == [6, 18, 0, 12, 24]
    assert [r.score for r in rows] == [100.0, 100.0, 50.0, 50.0, 50.0]
    docs = json.loads("".join(p.read_text() for p in sorted((tmp_path / "jobs.json").glob("part-*"))))
    assert [d["job"]["id"] for d in docs] == ["6", "18", "0", "12", "24"]
    usage = spark.createDataFrame([(10, 5, 15)], "prompt_tokens int, completion_tokens int, total_tokens int")
    report = reports.run_report(stage_tables(stages, ranked), stages.stats, PROFILE, usage, "gpt-4.1-mini")
    counts = {"collected": 120, "filtered": 20, "deduplicated": 5, "scored": 5, "skipped": 0, "ranked": 5}
    assert {r.stage: r.rows for r in report["stages"].collect()} == counts
    assert {r.source: r.jobs for r in report["per_source"].collect()} == {"greenhouse": 120, "lever": 0, "apify": 0}
    assert report["tokens"].first().calls == 1
    for head in ({}, {"title": 'a "b"'}):
        lines = reports.run_report_lines(report, head).orderBy("section", "line").collect()
        doc = json.loads("".join(r.value for r in lines))
        assert doc["stages"] == counts and doc["rejections"] == {"role": 40, "seniority": 40, "location": 20}
        assert doc["tokens"]["total_tokens"] == 15 and doc["dropped_skills"] == {"dropped_matched_skills": 0, "dropped_missing_skills": 0}
        assert doc.get("title") == head.get("title")


def test_from_payloads_to_documents(spark, tmp_path):
    def a(n, title, url):
        return {"id": n, "title": title, "absolute_url": url, "location": {"name": "Pune"}, "content": "<p>Python</p>"}

    board_a = payloads(spark, [
        ("one", {"jobs": [a(1, "Backend Engineer", "https://x/1"), a(2, "Chef", "https://x/2"), {"id": 3}]}), ("unlisted", "broken")])
    board_b = payloads(spark, [("two", [
        {"id": "4", "text": "Backend Engineer", "hostedUrl": "https://x/1#apply", "categories": {"location": "Pune"}},
        {"id": "5", "text": "Backend Engineer", "hostedUrl": "https://x/5", "categories": {"location": "Pune"}, "description": "SQL, python"}])])
    profile = Profile(roles=PROFILE.roles, locations=PROFILE.locations, skills=PROFILE.skills, sources={
        "greenhouse": {"enabled": True, "boards": [{"token": "one", "company": "One"}]},
        "lever": {"enabled": True, "companies": [{"slug": "two"}]}})
    collected = boards.collect_jobs(spark, profile, board_a, board_b, written=True)
    stages, ranked = run(collected, profile, str(tmp_path / "out"))
    assert [(r.rank, r.job.id, r.score) for r in ranked.orderBy("rank").collect()] == [(1, "5", 100.0), (2, "1", 50.0)]
    assert stages.kept.count() == 3 and stages.jobs.count() == 4
    docs = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out/jobs.json").glob("part-*"))))
    assert [(d["job"]["id"], d["job"]["company"]) for d in docs] == [("5", "two"), ("1", "One")]
    bad = [json.loads(x) for p in sorted((tmp_path / "out/bad_records.json").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(b["id"], b["reject_reason"]) for b in bad] == [("3", "title is missing or not text")]


def test_funnel_report(table):
    report = reports.filter_funnel(table, PROFILE)
    rejected = {r.reject_reason: r.rows for r in report["rejections"].collect()}
    assert rejected == {"role": 40, "seniority": 40, "location": 20}
    assert [(r.title, r.rows) for r in report["rejected_role_titles"].collect()] == [("Chef", 40)]
    assert [r.company for r in report["per_company"].collect()] == ["c0", "c1", "c2", "c3"]


def test_rows_to_compare(table):
    assert reports.rows_to_compare(table).count() == 60
    assert reports.rows_to_compare(table.limit(29)) is None
