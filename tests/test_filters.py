import pytest
from pyspark.sql import functions as F

from rolesieve import Profile, fixed
from rolesieve.functions import text
from rolesieve.operators import filters, funnel

ROLES = ("Software Engineer", "Backend Engineer", "SDE", "AI Engineer", "GenAI Engineer")
CITIES = ("Bangalore", "Hyderabad", "Pune", "Noida", "Gurgaon", "Remote")


def values(spark, items, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("company,names,out", [
    ("TCS", ["TCS", "Infosys"], True), (" tcs ", ["TCS"], True), ("Tcs", [" tcs"], True),
    ("Acme", ["TCS"], False), ("TCS", [], False), ("TCS India", ["TCS"], False),
])
def test_excluded_company(spark, company, names, out):
    assert values(spark, [company], lambda c: filters.excluded_company(c, names)) == [out]


ROLE_CASES = {
    "Software Engineer": True, "Senior Backend Engineer": True, "software engineer ii": True, "SDE": True,
    "Software Development Engineer": True, "Machine Learning Engineer": True, "AI/ML Engineer": True,
    "Backend Developer": True, "Sales Executive": False, "HR Business Partner": False,
    "Engineering Manager": False, "Software Engineering Manager": False, "Director of Engineering": False,
    "VP of Engineering": False, "Head of Engineering": False, "Chief Technology Officer": False,
    "Engineer Manager": False, "Vice President, Developer": False, "Manager, Software Engineer": True,
    "Reengineered": False, "éengineer": False,
}


def test_role_truth_table(spark):
    got = values(spark, list(ROLE_CASES), lambda c: filters.matches_role(c, Profile(roles=ROLES)))
    assert dict(zip(ROLE_CASES, got)) == ROLE_CASES
    assert values(spark, ["Anything"], lambda c: filters.matches_role(c, Profile())) == [True]


def test_seniority(spark):
    titles = [f"Backend Engineer - {w}" for w in fixed.SENIORITY_WORDS]
    titles += ["Sr. Backend Engineer", "Engineer, Staff Level", "SENIOR dev"]
    assert all(values(spark, titles, lambda c: filters.has_excluded_word(c, Profile())))
    fine = ["Staffing Coordinator", "Intermediate Backend Engineer", "Leader", "L55", "sr_dev"]
    assert not any(values(spark, fine, lambda c: filters.has_excluded_word(c, Profile())))
    off = Profile.from_dict({"exclude_title_words": []})
    assert values(spark, ["Senior"], lambda c: filters.has_excluded_word(c, off)) == [False]
    own = Profile.from_dict({"exclude_title_words": ["intern"]})
    assert values(spark, ["Senior", "Intern x"], lambda c: filters.has_excluded_word(c, own)) == [False, True]


LOCATION_CASES = [
    ("bangalore, india", ("Bangalore",), True), ("Bengaluru", ("Bangalore",), True),
    ("Bengaluru, India", ("Hyderabad",), False), ("Remote - India", ("Remote",), True), ("Remote", ("Remote",), True),
    ("Remote, remote (REMOTE)", ("Remote",), True), ("Remote - California", ("Remote",), False),
    ("rremoteemote", ("Remote",), False), ("New Delhi / Noida", ("Noida",), True), ("Mumbai", ("Bangalore",), False),
    ("Gurgaon, India", CITIES, True), ("Chennai", CITIES, False), ("Remote - California", CITIES, False),
    ("San Francisco, California", ("Bangalore", "Remote"), False), (None, ("Bangalore",), False),
    ("", ("Remote",), False), (None, (), True), ("Anywhere", (), True),
    ("Mumbai, India", ("Remote",), True), ("Indianapolis", ("Remote",), True), ("---", ("Remote",), True),
    ("東京", ("Remote",), True), ("St. Ives", ("St. Ives",), False), ("nation 10", ("nation 1",), True),
]


@pytest.mark.parametrize("location,configured,out", LOCATION_CASES)
def test_location(spark, location, configured, out):
    df = spark.createDataFrame([(location,)], "x string")
    assert df.select(filters.matches_location("x", Profile(locations=configured)).alias("v")).first().v is out


def test_phrases_next_to_punctuation(spark):
    assert values(spark, ["C++ Developer", "a C++y", "xC++y"], lambda c: text.contains_phrase(c, ["C++"])) \
        == [False, True, False]
    assert values(spark, ["ÉTUDE", "étude x", "étudex"], lambda c: text.contains_phrase(c, ["étude", "zz"])) \
        == [True, True, False]
    assert values(spark, [None, "x"], lambda c: text.contains_phrase(c, [])) == [False, False]
    assert values(spark, [None], lambda c: text.contains_phrase(c, ["a"])) == [False]


def test_profile_documents(tmp_path):
    for bad in ({"roles": [" "]}, {"exclude_title_words": None}, {"exclude_title_words": [""]}):
        with pytest.raises(ValueError):
            Profile.from_dict(bad)
    assert Profile.from_dict(None).exclude_title_words == fixed.SENIORITY_WORDS
    assert Profile.from_dict({"roles": None, "experience": None}).roles == ()
    (tmp_path / "p.json").write_text('{"skills": ["A"], "experience": {"min_years": 1}}')
    loaded = Profile.load(tmp_path / "p.json")
    assert loaded.skills == ("A",) and (loaded.min_years, loaded.max_years) == (1, None)
    (tmp_path / "p.yaml").write_text("skills: [A]\nexclude_title_words: []\n")
    pytest.importorskip("yaml")
    assert Profile.load(tmp_path / "p.yaml").exclude_title_words == ()


JOBS = [
    (0, "Backend Engineer", "TCS", "Pune"), (1, "Chef", "A", "Pune"), (2, "Chef", "A", "Pune"),
    (3, "Data Analyst Manager", "B", "Pune"), (4, "Senior Engineer", "B", "Pune"), (5, "Engineer", "A", None),
    (6, "Engineer", "A", ""), (7, "Engineer", "C", "Oslo"), (8, "Engineer", "C", "Pune"), (9, "Engineer", "C", "Pune"),
]
PROFILE = Profile(roles=ROLES, locations=CITIES, excluded_companies=("tcs",))


@pytest.fixture(scope="module")
def labelled(spark):
    return filters.label(spark.createDataFrame(JOBS, "seq long, title string, company string, location string"), PROFILE)


def test_funnel(labelled):
    reasons = {r.reject_reason: r.rows for r in funnel.rejections_by_reason(labelled).collect()}
    assert reasons == {"excluded_company": 1, "role": 3, "seniority": 1, "location": 3}
    kept = filters.keep(labelled.drop("reject_reason"), PROFILE)
    assert kept.count() + sum(reasons.values()) == len(JOBS)
    assert sorted(r.seq for r in kept.collect()) == [8, 9]
    assert [(r.title, r.rows) for r in funnel.most_common(funnel.rejected_role_titles(labelled), 1).collect()] == [("Chef", 2)]
    assert [r.title for r in funnel.rejected_technical_titles(labelled).collect()] == ["Data Analyst Manager"]
    assert [(r.location, r.rows) for r in funnel.most_common(funnel.rejected_locations(labelled)).collect()] \
        == [("(none)", 2), ("Oslo", 1)]
    company = {r.company: (r.collected, r.rejected_for_role, r.kept) for r in funnel.per_company(labelled).collect()}
    assert company == {"TCS": (1, 0, 0), "A": (4, 2, 0), "B": (2, 1, 0), "C": (3, 0, 2)}


def test_not_filtered_on_skills_or_experience(spark):
    row = spark.createDataFrame([(1, "Engineer", "A", "Pune", "10 years of COBOL")],
                                "seq long, title string, company string, location string, description string")
    strict = Profile(roles=ROLES, locations=CITIES, skills=("Java",), min_years=0, max_years=1)
    assert filters.keep(row, strict).count() == 1


def test_company_table(spark, labelled):
    names = spark.createDataFrame([(" a ",), ("A",), (None,)], "company string")
    assert sorted(r.seq for r in filters.drop_excluded_companies(labelled, names).collect()) == [0, 3, 4, 7, 8, 9]


def test_gates(spark, labelled):
    assert filters.has_rows(labelled, 10) and not filters.has_rows(labelled, 11)
    row = filters.gate(labelled).first()
    assert row.stopped and row.reason == "Only 10 jobs survived the filter (minimum 30 required)."
    assert filters.gate(labelled.limit(0)).first().jobs_after_filter == 0


def test_per_source_reports_zero(spark):
    df = spark.createDataFrame([("greenhouse",)], "source string")
    assert {r.source: r.jobs for r in funnel.per_source(df).collect()} == {"greenhouse": 1, "lever": 0, "apify": 0}
    other = spark.createDataFrame([("elsewhere",), (None,)], "source string")
    assert {r.source: r.jobs for r in funnel.per_source(other).collect()} == {"greenhouse": 0, "lever": 0, "apify": 0, "elsewhere": 1, None: 1}


def test_slugs_and_names(spark):
    got = spark.createDataFrame([("Goldman Sachs",), (" ola ",), ("  ",), ("A  B",)], "c string").select(
        text.slug_variants("c", {"goldman sachs": ["goldmansachs", "gs"]}).alias("s")).collect()
    assert [[(g.slug, g.hint) for g in r.s] for r in got] == [
        [("goldmansachs", "Goldman Sachs"), ("goldman-sachs", "Goldman Sachs"), ("goldman", "Goldman Sachs"), ("gs", "gs")],
        [("ola", " ola ")], [], [("ab", "A  B"), ("a--b", "A  B"), ("a", "A  B")]]
    pairs = spark.createDataFrame([("J.P. Morgan", "jpmorgan"), ("Zomato", "eternal"), ("", "x"), (None, "x"), ("x", "--")],
                                  "a string, b string")
    assert [r.v for r in pairs.select(text.names_agree("a", "b").alias("v")).collect()] == [True, False, False, False, False]
    assert values(spark, ["gitLab", "a b"], text.display_name) == ["Gitlab", "A b"]
    assert values(spark, ["https://jobs.lever.co/acme/1", "https://jobs.lever.co/acme", None], text.board_name_from_url) \
        == ["acme", None, None]
