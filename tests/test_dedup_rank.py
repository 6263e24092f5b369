import random

import pytest
from pyspark.sql import functions as F

from rolesieve.functions.values import normalize_url
from rolesieve.operators import dedup, rank
from rolesieve.operators.seen import SeenPages


def kept(spark, urls, **conf):
    df = spark.createDataFrame([(i, u, f"t{i}") for i, u in enumerate(urls)], "seq long, url string, title string")
    return [(r.seq, r.title) for r in dedup.deduplicate(df.repartition(3)).orderBy("seq").collect()]


def test_first_wins_and_order_stays(spark):
    assert kept(spark, ["A", "B", "A", "C", "B"]) == [(0, "t0"), (1, "t1"), (3, "t3")]
    assert kept(spark, []) == []


def test_fragment_white_space_and_blanks(spark):
    urls = ["https://x/1", "https://x/1#apply", " https://x/1\t", "https://x/1?a=1", "", "  ", "#apply", None, "https://x/2"]
    assert [s for s, _ in kept(spark, urls)] == [0, 3, 4, 5, 6, 7, 8]


def test_dedup_is_idempotent_and_independent_of_partitions(spark):
    rng = random.Random(7)
    urls = [f"https://x/{rng.randrange(40)}#{i}" if rng.random() > 0.3 else "https://x/hot" for i in range(400)]
    first = {}
    for i, u in enumerate(urls):
        first.setdefault(u.split("#")[0], i)
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert [s for s, _ in kept(spark, urls)] == sorted(first.values())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    df = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    once = dedup.deduplicate(df)
    assert sorted(dedup.deduplicate(once).collect()) == sorted(once.collect())
    assert sorted(r.seq for r in dedup.first_seqs(df).collect()) == sorted(first.values())


def test_url_form(spark):
    urls = ["HTTPS://X.example/Path?Q=1#f", "http://a/b?", "http://a/b??", "http://a/b?#x", "http://a/\tb\n", "/path?x",
            "a b #c", "mailto:X@y", "http://a/b?x=1?", "http://a//b", "", "#only"]
    got = [r.v for r in spark.createDataFrame([(u,) for u in urls], "u string").select(normalize_url("u").alias("v")).collect()]
    assert got == ["https://X.example/Path?Q=1", "http://a/b", "http://a/b??", "http://a/b", "http://a/b", "/path?x",
                   "a b ", "mailto:X@y", "http://a/b?x=1?", "http://a//b", "", ""]


def test_collections_one_by_one_give_the_rows_of_one_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, i // 100, rng.choice(["", None, "#x"]) if rng.random() < 0.1 else f"https://x/{rng.randrange(60)}#{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, day long, url string")
    want = sorted(tuple(r) for r in dedup.deduplicate(df).collect())
    seen = SeenPages(spark, f"file://{tmp_path}/seen")
    days = [df.filter(F.col("day") == d) for d in range(3)]
    got = [seen.keep_new(rows, f"day {d}").collect() for d, rows in enumerate(days)]
    assert sorted(tuple(r) for day in got for r in day) == want and [len(x) > 0 for x in got] == [True] * 3
    assert sorted(seen.keep_new(days[1], "day 1").collect()) == sorted(got[1]) and len(seen.claims()) == 3
    assert all(r.url in ("", None, "#x") for r in seen.keep_new(df, "all again").collect())
    assert seen.keep_new(df.limit(0), "nothing").count() == 0 and len(seen.claims()) == 5


def test_of_two_collections_at_once_one_comes_in(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "https://x/1")], "seq long, url string")
    seen = SeenPages(spark, f"file://{tmp_path}/seen")
    old = seen.claims()
    assert seen.keep_new(df, "a").count() == 1
    with monkeypatch.context() as m:
        m.setattr(SeenPages, "claims", lambda self: old)  # read before "a" came in
        with pytest.raises(RuntimeError, match="run it again"):
            seen.keep_new(df, "b")
    assert seen.keep_new(df, "b").count() == 0 and [name for name, _ in seen.claims()] == ["a", "b"]


def test_rank_is_stable(spark):
    rows = [(1, 70.0), (2, 90.0), (3, 70.0), (4, 90.0)]
    df = spark.createDataFrame(rows, "seq long, score double").repartition(4)
    want = [(1, 2), (2, 4), (3, 1), (4, 3)]
    assert [(r.rank, r.seq) for r in rank.rank_all(df).orderBy("rank").collect()] == want
    assert [(r.rank, r.seq) for r in rank.top_k(df, 3).orderBy("rank").collect()] == want[:3]
    assert rank.rank_all(df.limit(0)).count() == 0
    assert [r.seq for r in rank.first_n(df, 2).collect()] == [1, 2]


def test_full_rank_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(i, 50.0 if i % 3 else float(rng.randrange(100))) for i in range(5000)]
    df = spark.createDataFrame(rows, "seq long, score double").repartition(16)
    want = [s for s, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    got = rank.rank_all(df).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [r.seq for r in got] == want


def test_no_single_task_in_the_full_rank(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.lit(1.0).alias("score"))
    plan = rank.rank_all(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]
