import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from rolesieve.operators import rank
from rolesieve.sinks import files

JOB = "struct<id:string,title:string,company:string,location:string,description:string,url:string,source:string,posted_date:date>"
SCHEMA = (f"seq long, job {JOB}, score double, matched_skills array<string>, missing_skills array<string>, rationale string")


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [
        (1, ("1", 'Dev "Lead", x', "Acmé", None, None, "https://x/1", "greenhouse", None), 70.0, ["A", "B"], [], "two\nlines"),
        (2, ("2", "SDE", "B", "Pune", "d", "https://x/2", "lever", None), 90.5, [], ["C"], "ok — fine"),
    ]
    return rank.rank_all(spark.createDataFrame(rows, SCHEMA))


def text_of(folder):
    return "".join(p.read_bytes().decode() for p in sorted(folder.glob("part-*")))


@pytest.mark.parametrize("single", [True, False])
def test_csv(ranked, tmp_path, single):
    files.write_csv(ranked, str(tmp_path / "a" / "b"), single)
    content = text_of(tmp_path / "a" / "b")
    assert content.startswith("rank,score,title,") and "\r\n" in content
    rows = list(csv.DictReader(io.StringIO(content, newline="")))
    assert [(r["rank"], r["score"], r["title"], r["location"], r["matched_skills"], r["missing_skills"]) for r in rows] == [
        ("1", "90.5", "SDE", "Pune", "None", "C"), ("2", "70.0", 'Dev "Lead", x', "", "A, B", "None")]
    assert rows[1]["company"] == "Acmé" and rows[1]["rationale"] == "two\nlines"


@pytest.mark.parametrize("single", [True, False])
def test_json_array(ranked, tmp_path, single):
    files.write_json_array(ranked, str(tmp_path / "j"), single)
    docs = json.loads(text_of(tmp_path / "j"))
    assert [d["rank"] for d in docs] == [1, 2]
    assert docs[1]["job"] == {"id": "1", "title": 'Dev "Lead", x', "company": "Acmé", "location": None, "description": None,
                              "url": "https://x/1", "source": "greenhouse", "posted_date": None}
    assert docs[1]["matched_skills"] == ["A", "B"] and docs[1]["missing_skills"] == [] and docs[0]["score"] == 90.5


def test_json_lines(ranked, tmp_path):
    files.write_json_lines(ranked, str(tmp_path / "l"))
    docs = [json.loads(line) for line in text_of(tmp_path / "l").splitlines()]
    assert [d["job"]["id"] for d in docs] == ["2", "1"] and "location" in docs[1]["job"]


def test_markdown(ranked, tmp_path):
    files.write_markdown(ranked, str(tmp_path / "m"), "My Matches")
    assert text_of(tmp_path / "m") == (
        "# My Matches\n\n## 1. SDE — B\n\n**Score:** 90.5/100\n**Location:** Pune\n**Source:** lever\n**URL:** https://x/2\n\n"
        "**Matched Skills:** None\n**Missing Skills:** C\n\n**Why it matches:** ok — fine\n"
        '\n## 2. Dev "Lead", x — Acmé\n\n**Score:** 70.0/100\n**Location:** Not specified\n**Source:** greenhouse\n'
        "**URL:** https://x/1\n\n**Matched Skills:** A, B\n**Missing Skills:** None\n\n**Why it matches:** two\nlines\n")


def test_skip_report(spark, tmp_path):
    schema = "seq long, id string, title string, company string, error_type string, error_message string, attempts int"
    rows = [(5, "5", "t5", "c", "RateLimitError", 'said "no"', 7), (2, "2", "t2", "c", "Refusal", None, 1)]
    files.write_skip_report(spark.createDataFrame(rows, schema), str(tmp_path / "s"))
    report = json.loads(text_of(tmp_path / "s"))
    assert report["skipped_jobs"] == 2
    assert [d["id"] for d in report["skipped_details"]] == ["2", "5"]
    assert report["skipped_details"][1] == {"id": "5", "title": "t5", "company": "c", "error_type": "RateLimitError",
                                            "error_message": 'said "no"', "attempts": 7}


def test_documents_of_many_partitions_without_a_sort(spark, tmp_path):
    jobs = spark.range(3000).select(
        F.col("id").alias("seq"), F.struct(*(F.lit(None).cast("date").alias(c) if c == "posted_date" else F.col("id").cast("string").alias(c)
                                             for c in ("id", "title", "company", "location", "description", "url", "source", "posted_date"))).alias("job"),
        (F.col("id") * 37 % 101).cast("double").alias("score"), F.array(F.lit("A")).alias("matched_skills"),
        F.array().cast("array<string>").alias("missing_skills"), F.lit('a, "b"').alias("rationale")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranked = rank.rank_all(jobs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(range(3000), key=lambda i: (-(i * 37 % 101), i))
    writers = {"md": files.write_markdown, "csv": files.write_csv, "json": files.write_json_array}
    for name, write in writers.items():
        write(ranked, str(tmp_path / name), in_order=True)
        write(ranked, str(tmp_path / f"{name}-sorted"))
        assert len(list((tmp_path / name).glob("part-*"))) > 3
        assert text_of(tmp_path / name) == text_of(tmp_path / f"{name}-sorted")
    assert [int(d["job"]["id"]) for d in json.loads(text_of(tmp_path / "json"))] == want
    rows = list(csv.DictReader(io.StringIO(text_of(tmp_path / "csv"), newline="")))
    assert [int(r["title"]) for r in rows] == want and {r["rationale"] for r in rows} == {'a, "b"'}
    files.write_json_lines(ranked, str(tmp_path / "lines"), in_order=True)
    assert [json.loads(x)["rank"] for x in text_of(tmp_path / "lines").splitlines()] == list(range(1, 3001))
    for lines in (files.csv_lines(ranked), files.json_array_lines(ranked), files.markdown_lines(ranked)):
        plan = lines.filter("section = 1")._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "rangepartitioning" not in plan


def test_documents_without_rows(spark, ranked, tmp_path):
    none = rank.rank_all(ranked.drop("rank").limit(0))
    files.write_json_array(none, str(tmp_path / "new" / "j"), in_order=True)
    files.write_markdown(none, str(tmp_path / "new" / "m"), in_order=True)
    files.write_csv(none, str(tmp_path / "new" / "c"), in_order=True)
    assert json.loads(text_of(tmp_path / "new" / "j")) == []
    assert text_of(tmp_path / "new" / "m").startswith("# Job Matches\n\n") and text_of(tmp_path / "new" / "c").count("\r\n") == 1
