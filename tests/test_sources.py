import datetime
import json

import pytest
from pyspark.sql import functions as F

from rolesieve import Profile, fixed
from rolesieve.plans import catalog
from rolesieve.sources import boards, config

A, B, S = fixed.BOARD_A, fixed.BOARD_B, fixed.SEARCH


def payloads(spark, *rows):
    return spark.createDataFrame(
        [(t, c, o, p if isinstance(p, str) else json.dumps(p)) for t, c, o, p in rows],
        "token string, company string, board_ord long, payload string")


def jobs(collected):
    return [r.asDict() for r in collected.jobs.orderBy("seq").collect()]


def test_board_a_maps_all_fields(spark):
    got = jobs(boards.read_payloads(payloads(spark, ("acme", "Acme Inc", 0, {"jobs": [{
        "id": 12345, "title": "Backend Engineer", "absolute_url": "https://x/1",
        "location": {"name": " Pune, India "}, "content": "<p>We build <b>things</b>.</p>",
        "updated_at": "2026-01-01T00:00:00Z"}]})), A))
    assert len(got) == 1
    assert got[0]["id"] == "12345"
    assert got[0]["company"] == "Acme Inc"
    assert got[0]["location"] == "Pune, India"
    assert got[0]["description"] == "We build things."
    assert got[0]["source"] == A
    assert got[0]["posted_date"] is None


def test_board_a_optional_fields_and_quarantine(spark):
    c = boards.read_payloads(payloads(spark, ("acme", "acme", 3, {"jobs": [
        {"id": 1, "title": "A", "absolute_url": "u1"},
        {"id": 2},
        7,
        {"id": None, "title": "A", "absolute_url": "u"},
        {"id": 5, "title": 9, "absolute_url": "u"},
        {"id": 6, "title": "ok", "absolute_url": "u6", "location": {"name": "  "}, "content": ""},
        {"id": 7, "title": "x", "absolute_url": "u7", "location": "Remote"},
        {"id": 8, "title": "x", "absolute_url": "u8", "location": {"name": 4}},
        {"id": 9, "title": "x", "absolute_url": "u9", "content": 4},
    ]})), A)
    got = jobs(c)
    assert [(j["id"], j["location"], j["description"]) for j in got] == [("1", None, None), ("6", None, None)]
    bad = {r.id: r.reject_reason for r in c.bad_records.collect()}
    assert set(bad) == {"2", "unknown", "5", "7", "8", "9"}
    assert c.bad_records.count() == 7
    assert c.bad_payloads.count() == 0


@pytest.mark.parametrize("source,payload,text", [
    (A, "not json", "invalid JSON"), (A, "[]", "'jobs' list"), (A, '{"jobs": {}}', "'jobs' list"),
    (B, '{"jobs": []}', "JSON list"), (B, "{", "invalid JSON"),
])
def test_bad_envelope_names_the_board(spark, source, payload, text):
    table = payloads(spark, ("my-board", "c", 0, payload))
    with pytest.raises(Exception, match="my-board"):
        boards.read_payloads(table, source).jobs.collect()
    lenient = boards.read_payloads(table, source, strict=False)
    assert lenient.jobs.count() == 0
    row = lenient.bad_payloads.first()
    assert row.token == "my-board" and text in row.payload_error


def test_empty_lists_are_fine(spark):
    assert jobs(boards.read_payloads(payloads(spark, ("t", "c", 0, {"jobs": []})), A)) == []
    assert jobs(boards.read_payloads(payloads(spark, ("t", "c", 0, [])), B)) == []


def test_board_b(spark):
    c = boards.read_payloads(payloads(spark, ("cred", "CRED", 0, [
        {"id": "abc", "text": "Backend", "hostedUrl": "https://h/1", "applyUrl": "https://a/1",
         "categories": {"location": " Bangalore ", "team": "x"}, "description": "<p>About us</p>",
         "lists": [{"text": "What you'll do", "content": "<li>Build</li>"}, "junk", {"text": "Empty"},
                   {"content": "<li>Plain</li>"}], "createdAt": 1700000000000},
        {"id": "only-apply", "text": "T", "hostedUrl": "", "applyUrl": "https://a/2", "createdAt": "soon"},
        {"id": "bad"},
        {"id": "nested", "text": "T", "hostedUrl": "h", "content": {
            "description": "<b>Deep</b>", "lists": [{"text": "L", "content": "item"}]}, "createdAt": -1},
        {"id": "html", "text": "T", "hostedUrl": "h", "descriptionHtml": "<p>H</p>", "description": "no",
         "categories": None, "createdAt": 1e20},
        {"id": "odd-main", "text": "T", "hostedUrl": "h", "description": 5},
        {"id": "odd-section", "text": "T", "hostedUrl": "h", "lists": [{"content": 5}]},
        {"id": "odd-host", "text": "T", "hostedUrl": 5, "applyUrl": "x"},
        {"id": "odd-cat", "text": "T", "hostedUrl": "h", "categories": "Pune"},
    ])), B)
    got = {j["id"]: j for j in jobs(c)}
    assert set(got) == {"abc", "only-apply", "nested", "html"}
    assert got["abc"]["url"] == "https://h/1"
    assert got["abc"]["location"] == "Bangalore"
    assert got["abc"]["description"] == "About us\n\nWhat you'll do: Build\n\nPlain"
    assert got["abc"]["posted_date"] == datetime.date(2023, 11, 14)
    assert got["only-apply"]["url"] == "https://a/2"
    assert got["only-apply"]["description"] is None and got["only-apply"]["posted_date"] is None
    assert got["nested"]["description"] == "Deep\n\nL: item"
    assert got["nested"]["posted_date"] == datetime.date(1969, 12, 31)
    assert got["html"]["description"] == "H" and got["html"]["posted_date"] is None
    assert {r.id for r in c.bad_records.collect()} == {"bad", "odd-main", "odd-section", "odd-host", "odd-cat"}


def test_search_items(spark):
    c = boards.read_payloads(payloads(spark, ("Pune", None, 0, [
        {"jobId": 1, "title": "T", "companyName": "C", "locationText": " Pune ", "publicUrl": "p", "url": "u",
         "description": "<p>d</p>"},
        {"jobId": "2", "title": "T", "companyName": "C", "url": "u2"},
        {"jobId": "3", "title": "T"},
        {"jobId": "4", "title": "T", "companyName": "C", "url": None},
    ])), S)
    got = jobs(c)
    assert [(j["id"], j["company"], j["location"], j["url"], j["description"]) for j in got] == [
        ("1", "C", " Pune ", "p", "d"), ("2", "C", None, "u2", None)]
    assert {r.id for r in c.bad_records.collect()} == {"3", "4"}


PROFILE = Profile.from_dict({
    "roles": ["A", "B"], "locations": ["Pune"],
    "sources": {
        A: {"enabled": True, "boards": [{"token": "b2", "company": ""}, {"token": ""}, {"company": "x"},
                                        {"token": "b1", "company": "One"}]},
        B: {"enabled": False, "companies": [{"slug": "s1"}]},
        S: {"enabled": True, "max_items": 7},
    }})


def test_collect_in_configured_order(spark):
    def one(n):
        return json.dumps({"jobs": [{"id": f"{n}{i}", "title": "t", "absolute_url": "u"} for i in range(2)]})

    board_a = spark.createDataFrame([("b1", one("x")), ("b2", one("y")), ("other", "broken")],
                                    "token string, payload string")
    board_b = spark.createDataFrame([("s1", "broken")], "token string, payload string")
    search = spark.createDataFrame(
        [("Pune", 0, json.dumps([{"jobId": "s", "title": "t", "companyName": "c", "url": "u"}]))],
        "token string, board_ord long, payload string")
    with pytest.raises(RuntimeError, match="state of their runs"):
        boards.collect_jobs(spark, PROFILE, search=search)
    runs = spark.createDataFrame([("Pune", "d", "ABORTED", "m")], "token string, dataset_id string, status string, status_message string")
    fine = runs.withColumn("status", F.lit("SUCCEEDED"))
    got = jobs(boards.collect_jobs(spark, PROFILE, board_a, board_b, search, fine))
    assert [j["id"] for j in got] == ["y0", "y1", "x0", "x1", "s"]
    assert [j["company"] for j in got] == ["b2", "b2", "One", "One", "c"]
    assert jobs(boards.collect_jobs(spark, Profile.from_dict({}), board_a, board_b)) == []
    with pytest.raises(RuntimeError, match="Pune.*ABORTED"):
        boards.collect_jobs(spark, PROFILE, search=search, runs=runs)
    assert jobs(boards.collect_jobs(spark, PROFILE, search=search, runs=runs, strict=False)) == []
    assert len(jobs(boards.collect_jobs(spark, PROFILE, search=search, runs=fine))) == 1
    with pytest.raises(RuntimeError, match="b1"):
        boards.collect_jobs(spark, PROFILE, board_a.filter("token <> 'b1'"))


def test_the_check_of_what_landed_reads_no_payload(spark, tmp_path):
    for token in ("b1", "b2", "no.dots"):
        (tmp_path / f"{token}.json").write_text(json.dumps({"jobs": [{"id": token, "title": "t", "absolute_url": "u"}]}))
    folder = str(tmp_path)
    landed = config.landed_files(spark, folder)
    assert sorted((r.token, r.bytes) for r in landed.select("token", "bytes").collect()) == sorted(
        (f.stem, f.stat().st_size) for f in tmp_path.glob("*.json"))
    unreadable = config.load_payload_files(spark, folder).withColumn("payload", F.raise_error(F.lit("read")).cast("string")) \
        .withColumn("token", F.when(F.col("payload").isNull(), "").otherwise(F.col("token")))
    boards.collect_jobs(spark, PROFILE, unreadable, landed={A: landed})  # nothing runs over the payloads yet
    with pytest.raises(Exception, match="read"):
        boards.collect_jobs(spark, PROFILE, unreadable)
    got = jobs(boards.collect_jobs(spark, PROFILE, config.load_payload_files(spark, folder), landed={A: landed}))
    assert [j["id"] for j in got] == ["b2", "b1"]
    (tmp_path / "b1.json").unlink()
    with pytest.raises(RuntimeError, match="b1"):
        boards.collect_jobs(spark, PROFILE, unreadable, landed={A: config.landed_files(spark, folder)})


def test_search_requests(spark):
    got = config.profile_search_requests(spark, PROFILE).collect()
    assert [(r.keywords, r.location, r.max_items, r.max_pages, r.mode) for r in got] == [
        ("A OR B", "Pune", 7, 2, "search")]
    many = spark.createDataFrame([("p", ["r"], [f"l{i}" for i in range(10)]), ("none", [], ["l"]),
                                  ("nowhere", ["r"], [])],
                                 "profile_id string, roles array<string>, locations array<string>")
    few = config.search_requests(many, max_searches=5).orderBy("request_ord").collect()
    assert [r.location for r in few] == ["l0", "l1", "l2", "l3", "l4"]
    assert few[0].left_out == ["l5", "l6", "l7", "l8", "l9"]
    assert [(r.location, r.left_out) for r in config.search_requests(many).orderBy("request_ord").collect()] == [
        (f"l{i}", []) for i in range(10)]


def test_run_gate(spark):
    items = spark.createDataFrame([("ok", 1), ("nodata", 2), ("failed", 3), ("absent", 4)], "token string, n int")
    runs = spark.createDataFrame([("ok", "d", "SUCCEEDED", None), ("nodata", None, "SUCCEEDED", None),
                                  ("failed", "d", "FAILED", "boom")],
                                 "token string, dataset_id string, status string, status_message string")
    got = {r.token: r.run_error for r in boards.gate_runs(items, runs, strict=False).collect()}
    assert got == {"ok": None, "nodata": "no dataset", "failed": "status=FAILED, message=boom",
                   "absent": "no dataset"}
    with pytest.raises(Exception, match="failed"):
        boards.gate_runs(items.filter("token = 'failed'"), runs).collect()
    assert boards.gate_runs(items.filter("token = 'ok'"), runs).count() == 1
    with pytest.raises(Exception, match="boom"):
        boards.gate_runs(items.filter("token = 'failed'"), runs).select("n").collect()
    with pytest.raises(Exception, match="boom"):
        boards.gate_runs(items.filter("token = 'failed'"), runs).count()
    twice = boards.gate_runs(items.filter("token = 'ok'"), runs.union(runs), strict=False).collect()
    assert [r.run_error for r in twice] == ["more than one run"]


def test_payload_files(spark, tmp_path):
    (tmp_path / "acme.json").write_text('{"jobs": [\n{"id": 1, "title": "t", "absolute_url": "u"}]}')
    table = config.load_payload_files(spark, str(tmp_path))
    assert [r.token for r in table.collect()] == ["acme"]
    got = boards.read_payloads(table.withColumn("company", F.lit("Acme")).withColumn("board_ord", F.lit(0)), A)
    assert got.jobs.count() == 1


def test_boards_of_repeated_keys_do_not_grow_with_the_pages(spark, monkeypatch):
    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
    monkeypatch.setattr(catalog.v, "table", lambda *_: pages)
    seen, read = [], catalog.boards.read_payloads
    monkeypatch.setattr(catalog.boards, "read_payloads", lambda payloads, source: seen.append(payloads) or read(payloads, source))
    rows = catalog.repeated_keys(spark, "").collect()
    assert sorted((r.id, r.token, r.url) for r in rows) == [(i, str(i % 5), f"http://h/{i}") for i in range(12_000)]
    assert seen[0].select(F.max(F.regexp_count("payload", F.lit('"id"')))).first()[0] <= 200
    assert seen[0].select("board_ord").distinct().count() == seen[0].count()
