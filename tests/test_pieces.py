"""Boards read as pieces give what they give when they are parsed whole, and can be of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rolesieve import Profile, fixed
from rolesieve.sources import boards, config, pieces

A, B = fixed.BOARD_A, fixed.BOARD_B
GOOD = {"id": 1, "title": "Dev } \" \\ [", "absolute_url": "u{1}", "location": {"name": " Pune "}, "content": "<p>a, \\\"b\\\" {c}</p>"}

PAYLOADS = [
    json.dumps({"jobs": [GOOD, {**GOOD, "id": 2}, 7, None, "x,]}", [1, {"a": 2}], {"id": None}]}),
    json.dumps({"before": [{"jobs": [1]}, 2], "jobs": [GOOD], "meta": {"total": 1, "jobs": [GOOD, GOOD]}}, indent=2),
    '{"jobs":[]}', '{ "jobs" : [ \n ] }', '{"jobs":[{}]}', '{"jobs":{}}', '{"jobs":null}', '{"jobs":"[]"}', "{}", "[]", '[{"jobs":[1]}]', "7", '"jobs"', "null",
    '{"jobs":[1,]}', '{"jobs":[,]}', '{"jobs":[1 2]}', '{"jobs":[{"id":1,"title":}]}', '{"jobs":[1]', '{"jobs":[1]}]', '{"jobs":[1]}}', '{"jobs":[1}', '{"jobs":["a]}', "", " ",
    '{"jobs":[1]} x', '{"jobs":[1],}', '{"jobs":[{"id":1}],"x":{"a":1,}}', '{"jobs":[1],"jobs":[{"id":5,"title":"t","absolute_url":"u"}]}', '{"jobs":[1],"jobs":3}',
    '{"\\u006aobs":[1],"x\\"jobs":[2]}', '{"a}b":[{"c":1}],"jobs":[3]}', '{"jobs":[{"id":"\\\\"},{"id":"\\\\\\""}]}', "[" * 50 + "]" * 50,
    json.dumps([{"id": "7", "text": "T", "hostedUrl": "h", "lists": [{"text": "Do, all", "content": "<li>x</li>"}], "createdAt": 1.7e12}, 3, []]), "[1,[2],{}]", "[,1]", "[1",
]


def cut(text, rng):
    """Somewhere, but not within an escape."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + rng.randint(1, 9))
        while end < len(text) and text[end - 1] == "\\" or text[max(0, end - 5):end].count("\\u"):
            end += 1
        out.append(text[at:end])
        at = end
    return out or [""]


def outcome(collected):
    return (sorted(map(str, collected.jobs.collect())), sorted(map(str, collected.bad_records.collect())),
            sorted((r.token, r.payload_error) for r in collected.bad_payloads.collect()))


@pytest.mark.parametrize("source", [A, B])
def test_pieces_against_whole_payloads(spark, source):
    rng = random.Random(2)
    whole = [(f"t{i}", None if i % 4 else "Name", i, p) for i, p in enumerate(PAYLOADS)]
    parts = [(t, c, o, 10 * k, x) for t, c, o, p in whole for k, x in enumerate(cut(p, rng))]
    rng.shuffle(parts)
    want = outcome(boards.read_payloads(spark.createDataFrame(whole, "token string, company string, board_ord long, payload string"), source, strict=False))
    got = outcome(boards.read_pieces(spark.createDataFrame(parts, "token string, company string, board_ord long, place long, text string"), source, strict=False))
    assert want[0] and want[1] and want[2]
    assert got[2] == want[2] and got[1] == want[1] and got[0] == want[0]


def test_strict_names_the_board_and_nothing_gives_nothing(spark):
    schema = "token string, company string, board_ord long, place long, text string"
    with pytest.raises(RuntimeError, match=r"board 'x' \(number 3\): invalid JSON"):
        boards.read_pieces(spark.createDataFrame([("x", "X", 2, 0, '{"jobs":[')], schema), A)
    assert outcome(boards.read_pieces(spark.createDataFrame([], schema), A)) == ([], [], [])


def test_files_of_any_size(spark, tmp_path):
    """A board of more than a value can hold, next to small ones and ones that end in odd ways."""
    filler = "word } [ " + "text [ \\\" , " * 430
    n = 27_000
    with open(tmp_path / "large.json", "w") as f:
        f.write('{"jobs":[')
        for i in range(n):
            f.write(("," if i else "") + json.dumps({"id": i, "title": f"T{i}", "absolute_url": f"u{i}"})[:-1] + ', "content": "' + filler + '"}')
        f.write("]}")
    size = (tmp_path / "large.json").stat().st_size
    assert size > boards.MAX_PAYLOAD_BYTES
    (tmp_path / "small.json").write_text(json.dumps({"jobs": [GOOD]}))
    profile = Profile.from_dict({"roles": [], "locations": [], "sources": {A: {"enabled": True, "boards": [{"token": "small"}, {"token": "large", "company": "L"}]}}})
    small = config.load_payload_files(spark, str(tmp_path), up_to=1 << 20)
    large = pieces.load_pieces(spark, str(tmp_path), above=1 << 20)
    found = boards.collect_jobs(spark, profile, board_a=[small, large])
    rows = found.jobs.select("id", "company", "seq").collect()
    by_company = {c: [r for r in rows if r.company == c] for c in ("small", "L")}
    assert len(by_company["small"]) == 1 and sorted(int(r.id) for r in by_company["L"]) == list(range(n))
    assert [int(r.id) for r in sorted(by_company["L"], key=lambda r: r.seq)] == list(range(n))


@pytest.mark.parametrize("text", ['{"jobs":[1]}', '{"jobs":[1]}\n', '{"jobs":[1]', "[1]", '{"jobs":[1]}}', "", "}", "{}{}"])
def test_pieces_put_together_are_the_file(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    rows = pieces.load_pieces(spark, str(tmp_path), above=-1).orderBy("place").collect()
    assert "".join(r.text for r in rows) == text


def test_records_of_one_board_are_spread(spark):
    """No join brings the records of a board together, in the split or where they are named and parsed."""
    n, conf = 6000, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        texts = ['{"jobs":['] + [("," if i else "") + json.dumps({"id": i, "title": f"t{i}", "absolute_url": "u"}) for i in range(n)] + ["]}"]
        table = spark.createDataFrame([("all", "All", 0, i, t) for i, t in enumerate(texts)], "token string, company string, board_ord long, place long, text string")
        jobs = boards.read_pieces(table, "greenhouse").jobs
        assert sorted(int(r.id) for r in jobs.where("company = 'All'").collect()) == list(range(n))
        sizes = [r["count"] for r in jobs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= n / 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
