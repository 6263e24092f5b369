import datetime
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rolesieve.functions import values
from rolesieve.operators import attempts, running, runs
from rolesieve.plans import reports
from rolesieve.sinks import files

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
LOG = "seq long, job_id string, ts timestamp, error_type string, message string, retry_after string"


def log(spark, rows):
    return spark.createDataFrame(
        [(i, j, START + datetime.timedelta(seconds=s), e, m, h) for i, (j, s, e, m, h) in enumerate(rows)], LOG)


@pytest.mark.parametrize("message,header,retry,out", [
    ("Please try again in 245ms.", None, 0, 0.245), ("Please TRY again in  3.2s.", None, 0, 3.2),
    ("try again in 3.2 sec", None, 1, 2.0), ("nothing", None, 3, 8.0), (None, None, 0, 1.0),
    ("try again in 5s", "12", 0, 12.0), ("try again in 5s", "soon", 0, 5.0), (None, " 7.5 ", 0, 7.5),
    (None, "1000", 0, 60.0), ("try again in 1.2.3s", None, 2, 4.0),
])
def test_wait(spark, message, header, retry, out):
    df = spark.createDataFrame([(message, header, retry)], "m string, h string, n int")
    assert df.select(values.rate_limit_wait("h", "m", "n", F.lit(0.0)).alias("w")).first().w == pytest.approx(out)
    jittered = df.select(values.rate_limit_wait("h", "m", "n").alias("w")).first().w
    assert min(out, 60.0) <= jittered <= min(out + 1.0, 60.0)


def brute(rows):
    """Retry numbers and cooldown by walking the log once."""
    seen, until, out = {}, {}, {}
    for i, (job, s, error, _, wait) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        rate, other = seen.get(job, (0, 0))
        if error == "RateLimitError":
            until["a"] = max(until.get("a", 0.0), s + float(wait))
        out[i] = (rate, other, until.get("a"), max(until.get("a", 0.0) - s, 0.0))
        seen[job] = (rate + (error == "RateLimitError"), other + (error == "APITimeoutError"))
    return out


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_running_values_match_a_walk_for_any_number_of_buckets(spark, buckets):
    rng = random.Random(buckets)
    kinds = ["RateLimitError", "APITimeoutError", None]
    rows = [(rng.choice(["hot", "hot", "b", "c"]), rng.randrange(300), rng.choice(kinds), None, str(rng.randrange(1, 90)))
            for _ in range(300)]
    rows += [("hot", 10**8, None, None, "1")] + [("hot", 77, rng.choice(kinds), None, "3") for _ in range(60)]  # a stray time, a burst
    want = brute(rows)
    numbered = attempts.retry_numbers(log(spark, rows), ties=["seq"], buckets=buckets)
    held = attempts.cooldown(numbered.withColumn("w", F.when(attempts.is_rate_limit(), F.col("retry_after").cast("double")))
                             .withColumn("account", F.lit("a")), ["account"], "ts", "w", ["seq"], buckets).collect()
    base = int(START.timestamp() * 1_000_000)
    assert len(held) == len(rows)
    for r in held:
        resume = None if r.resume_at_us is None else (r.resume_at_us - base) / 1e6
        assert (r.rate_limit_retry, r.other_retry, resume, r.remaining_us / 1e6) == want[r.seq]


def test_buckets_are_even_under_a_stray_time_and_a_burst(spark):
    df = spark.range(20_000).selectExpr(
        "id as seq", "case when id = 0 then timestamp'1970-01-01' when id < 12000 then timestamp'2024-01-01' "
        "else timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) end as ts")
    sizes = running.bucketed(df, "ts", ["seq"], 10).groupBy("_bucket").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 4_000


def test_buckets_do_not_grow_with_the_rows(spark):
    largest = []
    for n in (3_000, 30_000):
        df = spark.range(n).selectExpr("id as seq", "'hot' as k", "timestamp'2024-01-01' as ts", "id % 7 as x")
        sizes = running.bucketed(df, "ts", ["seq"], 4, bits=8).groupBy("_bucket").count().collect()
        largest.append(max(r["count"] for r in sizes))
        for inclusive in (True, False):
            got = running.running(df, ["k"], "ts", ["seq"], {"total": ("sum", F.col("x")), "top": ("max", F.col("x"))}, 4, inclusive, 8)
            want = df.selectExpr("seq", "(seq div 7) * 21 + (seq % 7) * (seq % 7 + 1) div 2 as total", "least(seq, 6) as top")
            assert got.columns == [*df.columns, "total", "top"]
            if inclusive:
                assert got.select("seq", "total", "top").exceptAll(want).count() == 0 and got.count() == n
            else:
                first = [tuple(r) for r in got.select("total", "top").where("seq < 3").orderBy("seq").collect()]
                assert first == [(None, None), (0, 0), (1, 1)]
                after = got.selectExpr("seq", "coalesce(total, 0) + x as total", "greatest(coalesce(top, 0), x) as top")
                assert after.exceptAll(want).count() == 0
    assert largest == [256, 256]


def test_cooldown_only_moves_later(spark):
    rows = [("j", 0, "RateLimitError", None, "5"), ("j", 1, "RateLimitError", None, "0.5"), ("j", 2, None, None, None)]
    df = log(spark, rows).withColumn("w", F.col("retry_after").cast("double"))
    got = attempts.cooldown(df, ["job_id"], "ts", "w").orderBy("seq").collect()
    assert [r.remaining_us / 1e6 for r in got] == [5.0, 4.0, 3.0]


def test_outcomes(spark):
    rows = [("done", 0, "RateLimitError", None, "1"), ("done", 1, None, None, None)]
    rows += [("limited", i, "RateLimitError", None, "1") for i in range(7)]
    rows += [("slow", i, "APITimeoutError", None, None) for i in range(4)]
    rows += [("fatal", 0, "BadRequestError", None, None)]
    table = log(spark, rows)
    got = {r.job_id: (r.attempts, r.error_type, r.budget_spent) for r in attempts.outcomes(table).collect()}
    assert got == {"done": (2, None, False), "limited": (7, "RateLimitError", True), "slow": (4, "APITimeoutError", True),
                   "fatal": (1, "BadRequestError", False)}
    report = reports.attempt_report(table, jitter=F.lit(0.0))
    totals = report["totals"].first()
    assert (totals.rate_limit_hits, totals.rate_limit_wait_seconds) == (7, 7.0)
    assert {r.error_type: r.jobs for r in report["errors_by_type"].collect()} == {
        "RateLimitError": 1, "APITimeoutError": 1, "BadRequestError": 1}
    assert report["cooldown"].count() == len(rows)
    empty = reports.attempt_report(table.limit(0))["totals"].first()
    assert (empty.rate_limit_hits, empty.rate_limit_wait_seconds) == (0, 0.0)


def test_overlapping_waits_add_what_is_left(spark):
    rows = [("a", 0, "RateLimitError", None, "5"), ("b", 1, "RateLimitError", None, "0.5")]
    totals = reports.attempt_report(log(spark, rows), jitter=F.lit(0.0))["totals"].first()
    assert (totals.rate_limit_hits, totals.rate_limit_wait_seconds) == (2, 9.0)
    spent = [("a", i, "RateLimitError", None, "9") for i in range(7)] + [("b", 20, None, None, None)]
    held = {r.seq: r.remaining_us for r in reports.attempt_report(log(spark, spent), ties=["seq"], jitter=F.lit(0.0))["cooldown"].collect()}
    assert held[5] == 9_000_000 and held[6] == 8_000_000  # the last call gives up and moves nothing


def test_exact_medians_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", rng.choice([rng.random() * 1e6, 5.0]),
             None if i % 11 == 0 else float(i % 4)) for i in range(20_000)]
    got = {r.k: (r.median_a, r.median_b) for r in runs.medians(
        spark.createDataFrame(rows, "k string, a double, b double"), ["k"], ["a", "b"]).collect()}
    keys = {r[0] for r in rows}
    assert got == {k: (statistics.median(a for g, a, _ in rows if g == k),
                       statistics.median(b for g, _, b in rows if g == k and b is not None)) for k in keys}


@pytest.mark.parametrize("short", [3, 40])
def test_medians_by_narrowed_brackets(spark, short):
    rng = random.Random(2)
    drawn = {
        "spread": [rng.gauss(0, 1) for _ in range(30_001)], "even": [float(i) for i in range(20_000)],
        "two": [1.0] * 500 + [2.0] * 500, "ties": [float(rng.randint(0, 6)) for _ in range(9_000)],
        "edge": [0.0] * 4_999 + [rng.random() for _ in range(5_000)] + [9.0], "one": [7.5], "pair": [1.0, 4.0], "none": [None] * 5,
    }
    rows = [(k, x, None if x is None else -x) for k, xs in drawn.items() for x in rng.sample(xs, len(xs))]
    got = {r.k: (r.median_a, r.median_b) for r in runs.medians(
        spark.createDataFrame(rows, "k string, a double, b double"), ["k"], ["a", "b"], short=short).collect()}
    assert got.pop("none") == (None, None)
    assert got == {k: (statistics.median(xs), -statistics.median(xs)) for k, xs in drawn.items() if k != "none"}
    assert runs.medians(spark.createDataFrame([], "k string, a double"), ["k"], ["a"]).count() == 0


def test_median_of_one_group_with_ten_million_distinct_values(spark):
    n = 10_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit("all").alias("k"), ((F.col("id") * 7_654_321) % n).alias("a"))
    assert runs.medians(rows, ["k"], ["a"], short=10_000).first().median_a == (n - 1) / 2


def run_rows(spark):
    rows = [(1, 8, 15.904), (2, 8, 14.26), (3, 8, 31.056), (1, 1, 107.316), (1, 10, 9.0), (2, 10, 10.0)]
    df = spark.createDataFrame(rows, "run_id int, workers int, seconds double")
    constants = {m: 1.0 for m in runs.RUN_METRICS if m != "seconds"} | {"jobs_matched": 60}
    return df.select("*", *(F.lit(x).alias(m) for m, x in constants.items()))


def test_worker_comparison(spark):
    got = reports.worker_comparison(run_rows(spark)).collect()
    assert [(r.workers, r.match_s, r.matched) for r in got] == [(1, 107.316, 59.0), (8, 15.904, 59.0), (10, 9.5, 59.0)]
    lists = {r.workers: r.all_run_seconds for r in runs.run_times_list(run_rows(spark), ["workers"]).collect()}
    assert lists[8] == [15.904, 14.26, 31.056]
    with pytest.raises(Exception, match="too many runs"):
        runs.run_times_list(run_rows(spark), ["workers"], limit=2).collect()
    report = files.worker_report_lines(runs.worker_results(run_rows(spark)), {"model": "m", "jobs_collected_total": 5})
    doc = json.loads("".join(r.value for r in report.orderBy("section", "line").collect()))
    assert doc["jobs_collected_total"] == 5
    assert list(doc["by_workers"]) == ["1", "8", "10"] and doc["model"] == "m"
    assert doc["by_workers"]["8"]["median_seconds"] == 15.904 and doc["by_workers"]["8"]["runs"] == 3


def test_costs_and_merging(spark):
    sums = spark.createDataFrame([(32911, 2495, 35406)], "prompt_tokens long, completion_tokens long, total_tokens long")
    assert runs.with_cost(sums.withColumn("model", F.lit("gpt-4.1-mini"))).first().estimated_cost_usd == 0.017156
    assert runs.with_cost(sums.withColumn("model", F.lit("other"))).first().estimated_cost_usd is None
    zero = runs.token_sums(sums.limit(0)).first()
    assert (zero.calls, zero.prompt_tokens) == (0, 0)
    old = spark.createDataFrame([(1, 1, "old"), (8, 1, "old")], "workers int, ts int, v string")
    new = spark.createDataFrame([(8, 2, "new"), (4, 2, "new")], "workers int, ts int, v string")
    assert sorted(map(tuple, runs.merge_results(old, new, "workers", ["ts"]).collect())) == [
        (1, 1, "old"), (4, 2, "new"), (8, 2, "new")]


def test_reproducibility(spark):
    a = spark.createDataFrame([("1", 45.0), ("2", 50.0), ("3", None)], "id string, score double")
    b = spark.createDataFrame([("1", 45.0), ("2", 55.0), ("3", None), ("4", 1.0)], "id string, score double")
    report = reports.reproducibility(a, b)
    assert {r.id: r.differs for r in report["per_job"].collect()} == {"1": False, "2": True, "3": False}
    assert tuple(report["totals"].first()) == (3, 1)


def test_rounding_follows_the_exact_value(spark):
    rng = random.Random(5)
    numbers = [8.1025, (8.102 + 8.103) / 2, 2.5, 0.0625, 0.1875, 0.0005, 0.0015, 1e-300, 0.0, 1 / 3, 123456.0005, 0.9999999, 1e9 + 0.0625, 4e12 + 1 / 3, 2.0 ** 52 + 1, 1e300]
    numbers += [rng.randrange(10**6) / 2000 for _ in range(500)] + [rng.random() * 1000 for _ in range(500)]
    numbers += [-x for x in numbers[:20]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = df.select("i", values.round3("x").alias("a"), values.round_half_even("x", 6).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(round(x, 3), round(x, 6)) for x in numbers]
